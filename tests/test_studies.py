"""Draws, learners and keyed fits."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigate.operators import learn, metrics, models, perceptron, studies


def made(n, seed):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"a": rng.normal(3, 2, n), "b": rng.normal(size=n), "kind": rng.choice(["x", "y", "z"], n)})
    frame["label"] = ((frame.a - 3 + (frame.kind == "x") * 2 + 0.3 * rng.normal(size=n)) > 0.8).astype(float)
    frame["row_id"] = [f"r{i}" for i in range(n)]
    return frame


def test_logistic_minimises_its_loss():
    frame = made(400, 1)
    how = models.encoder(frame, ["a", "b"], ["kind"])
    x, y = models.encode(how, frame), frame.label.to_numpy()
    w = models.balanced_weights(y)
    b = models.logistic(x, y, w, 0.7)
    design = np.c_[x, np.ones(len(x))]
    p = 1 / (1 + np.exp(-design @ b))
    assert np.abs(0.7 * design.T @ (w * (p - y)) + b).max() < 1e-5
    assert models.names(how) == ["a", "b", "kind=x", "kind=y", "kind=z"]
    with pytest.raises(ValueError):
        models.balanced_weights(np.ones(3))


@pytest.mark.parametrize("learner", ["logistic", "boosting"])
def test_learners_predict_held_out_rows(learner):
    model = json.loads(models.fit(made(600, 2), "label", ["a", "b"], ["kind"], learner, 1.0, 3))
    fresh = made(500, 4).assign(kind=lambda f: f.kind.where(f.index > 5, "new"))
    p = models.probability(model, fresh)
    assert ((p >= 0.5) == (fresh.label == 1)).mean() > 0.9 and ((p > 0) & (p < 1)).all()


def test_gradient_of_the_perceptron():
    rng = np.random.default_rng(5)
    flat = perceptron.start(4, (5, 3), 1)
    x, y, w = rng.normal(size=(20, 4)), rng.integers(0, 2, 20).astype(float), rng.uniform(0.5, 2, 20)
    loss = lambda v: perceptron.loss_and_gradient(perceptron.unpack(v, 4, (5, 3)), x, y, w)
    slope = loss(flat)[1]
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert math.isclose(slope[i], (loss(flat + step)[0] - loss(flat - step)[0]) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_perceptrons_of_several_samples_train_together(spark):
    """Weighted loss, early stop on held-out rows, and the same result however rows are dealt."""
    parts = []
    for name, n in (("one", 300), ("two", 200)):
        frame = made(n, n)
        if name == "two":  # noise cannot be learned: the held-out loss stops it early
            frame["label"] = np.random.default_rng(1).permutation(frame.label)
        how = models.encoder(frame, ["a", "b"], ["kind"])
        parts.append(pd.DataFrame({
            "model": name, "x": models.encode(how, frame).tolist(), "y": frame.label, "w": models.balanced_weights(frame.label.to_numpy()),
            "held": np.arange(n) % 10 == 0,
        }))
    schema = "model string, x array<double>, y double, w double, held boolean"
    rows = spark.createDataFrame(pd.concat(parts), schema)
    found = perceptron.fit(rows.repartition(3), {"one": 5, "two": 5}, steps=25, patience=4)
    again = perceptron.fit(rows.repartition(1), {"one": 5, "two": 5}, steps=25, patience=4)
    for name in ("one", "two"):
        for (w, b), (w2, b2) in zip(found[name][0], again[name][0]):
            assert np.allclose(w, w2, atol=1e-6) and np.allclose(b, b2, atol=1e-6)
    right = (models.perceptron_margin(found["one"][0], np.array(parts[0].x.tolist())) >= 0) == (parts[0].y == 1)
    assert right.mean() > 0.9 and found["two"][1] < found["one"][1] <= 25


def test_draws_are_nested_and_checked(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("pool"), (F.col("id") / 4).cast("int").alias("cluster"),
        F.col("id").alias("row_id"), F.lit(1.0).alias("x"),
    )
    quotas = lambda n: spark.createDataFrame([("p", n), ("q", 2 * n)], "pool string, quota int")
    big = studies.draw(rows, ["pool"], "cluster", "row_id", quotas(200), [1, 2]).collect()
    small = studies.draw(rows, ["pool"], "cluster", "row_id", quotas(50), [1, 2]).collect()
    assert len(big) == 1200 and len({(r.pool, r.seed, r.cluster) for r in big}) == 1200
    assert set(small) == {r for r in big if r.draw < (50 if r.pool == "p" else 100)}
    assert {r.cluster for r in big if r.seed == 1} != {r.cluster for r in big if r.seed == 2}
    assert all(r.row_id // 4 == r.cluster for r in big)
    with pytest.raises(ValueError, match="requested 2000"):
        studies.draw(rows, ["pool"], "cluster", "row_id", quotas(1000), [1])


def test_keyed_fits_scores_and_choice(spark):
    frame = pd.concat([made(150, s).assign(seed=s, training_label=lambda f: f.label) for s in (1, 2)])
    samples = spark.createDataFrame(frame)
    features = learn.Features(("a", "b"), ("kind",))
    fitted = studies.fit_all(samples, ["seed"], [("logistic", 0.1), ("logistic", 10.0), ("perceptron", 0.0)], features)
    rows = [r.asDict() for r in fitted.orderBy("seed", "learner", "c").collect()]
    assert [(r["seed"], r["learner"], r["c"]) for r in rows] == [
        (s, a, c) for s in (1, 2) for a, c in (("logistic", 0.1), ("logistic", 10.0), ("perceptron", 0.0))
    ]
    rows.append({**rows[0], "mask": "role"})
    fresh = made(300, 9)
    scored = studies.score_all(spark.createDataFrame(fresh), rows, features, ("row_id", "label"), {"role": ("kind",)})
    table = scored.toPandas()
    right = [((table.scores.str[i] >= 0.5) == (table.label == 1)).mean() for i in range(7)]
    assert min(right[:6]) > 0.85 and right[6] < right[0]
    long = studies.by_model(scored)
    cuts = {r.model: r.threshold for r in studies.coverage_thresholds(long, [0.2]).collect()}
    for i in range(7):
        assert cuts[i] == np.quantile(table.scores.str[i], 0.8, method="higher")
    named = studies.coefficients(fitted.filter("learner = 'logistic'"), ["seed", "c"])
    assert named.count() == 2 * 2 * 5


def studied(spark):
    """Models of three learners and rows in clusters, as pandas and as a table."""
    frame = pd.concat([made(150, s).assign(seed=s, training_label=lambda f: f.label) for s in (1, 2)])
    tried = [("logistic", 0.1), ("boosting", 0.0), ("perceptron", 0.0)]
    features = learn.Features(("a", "b"), ("kind",))
    fitted = studies.fit_all(spark.createDataFrame(frame), ["seed"], tried, features)
    fitted = [r.asDict() for r in fitted.orderBy("seed", "learner", "c").collect()]
    fitted += [{**m, "mask": "role"} for m in fitted[:3]] + [{**m, "mask": "cost"} for m in fitted[:3]]
    rng = np.random.default_rng(3)
    fresh = made(900, 9).assign(
        a=lambda f: f.a.round(1), kind=lambda f: f.kind.where(f.index % 50 > 0, "new"),
        evaluation_cluster_id=[f"c{i}" for i in rng.integers(0, 300, 900)], authorization_harm=rng.integers(0, 2, 900),
        authority_laundering=rng.random(900) < 0.2, full_utility=rng.normal(size=900), odd=rng.random(900) < 0.5,
    )
    return features, fitted, {"role": ("kind",), "cost": ("a",)}, fresh, spark.createDataFrame(fresh).repartition(3)


def test_stacked_models_score_like_single_ones_in_any_batch(spark):
    features, fitted, masks, fresh, _ = studied(spark)
    stack = studies._stack(fitted, features, masks)
    whole = stack.scores(fresh)
    for i, m in enumerate(fitted):
        hidden = {"role": {"kind": "masked"}, "cost": {"a": 0.0}}.get(m.get("mask"), {})
        assert np.allclose(whole[:, i], models.probability(json.loads(m["model"]), fresh.assign(**hidden)), atol=1e-12)
    pieces = np.vstack([stack.scores(fresh.iloc[lo : lo + 7]) for lo in range(0, len(fresh), 7)])
    assert (pieces == whole).all()


def test_thresholds_and_rates_move_no_scores(spark):
    features, fitted, masks, fresh, rows = studied(spark)
    scores = studies._stack(fitted, features, masks).scores(fresh)
    targets = (0.05, 0.2, 0.5)
    for cells, handed_on in ((4, 1), (1024, 10), (1024, 10_000)):
        cuts = studies.exact_thresholds(rows, fitted, features, targets, masks, cells, handed_on)
        for i, cut in enumerate(cuts):
            assert cut == {t: np.quantile(scores[:, i], 1 - t, method="higher") for t in targets}
    rulings = [(i, cut[t]) for i, cut in enumerate(cuts) for t in targets] + [(0, 2.0)]
    frames = {"all": F.lit(True), "odd": F.col("odd")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        found = {(r.ruling, r.frame): r for r in studies.cluster_rates(rows, fitted, rulings, features, frames, masks).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    long = pd.concat([
        fresh.assign(ruling=k, authorized=scores[:, m] >= cut, frame=name)[keep]
        for k, (m, cut) in enumerate(rulings) for name, keep in (("all", np.ones(900, bool)), ("odd", fresh.odd))
    ])
    plain = spark.createDataFrame(long.drop(columns=["a", "b", "kind", "label"]))
    expected = metrics.cluster_rate_bounds(plain, ["ruling", "frame"]).collect()
    assert len(found) == len(expected) == 2 * len(rulings)
    for e in expected:
        row = found[e.ruling, e.frame].asDict()
        for name, value in e.asDict().items():
            assert row[name] == value if value is None or isinstance(value, str) else math.isclose(row[name], value, abs_tol=1e-9)


def test_draw_takes_a_larger_part_when_the_first_is_short(spark, monkeypatch):
    rows = spark.range(3000).select(F.lit("p").alias("pool"), F.col("id").alias("cluster"), F.col("id").alias("row_id"), F.lit(1.0).alias("x"))
    quotas = spark.createDataFrame([("p", 40)], "pool string, quota int")
    drawn = studies.draw(rows, ["pool"], "cluster", "row_id", quotas, [1, 2])
    number = studies.draw_number(F.lit("cluster"), F.lit("p"), F.lit(1), F.col("cluster"))
    first = [r.cluster for r in rows.select("cluster", number.alias("n")).orderBy("n").limit(40).collect()]
    assert [r.cluster for r in drawn.filter("seed = 1").orderBy("draw").collect()] == first
    # A part of the range as if it held a thousandth: too few at first, the same in the end.
    monkeypatch.setattr(studies, "NUMBERS", studies.NUMBERS / 1000)
    short = studies.draw(rows, ["pool"], "cluster", "row_id", quotas, [1, 2])
    assert sorted(short.collect()) == sorted(drawn.collect())


def test_perceptrons_of_bounded_samples_need_no_job_a_step(spark):
    """Each sample is trained in a task, with the steps of the distributed fit; one job for all
    learners, where a job for each of up to 60 steps ran before."""
    frame = pd.concat([made(n, n).assign(seed=n, training_label=lambda f: f.label) for n in (60, 120)])
    features = learn.Features(("a", "b"), ("kind",))
    tried = [("logistic", 1.0), ("boosting", 0.0), ("perceptron", 0.0)]
    spark.sparkContext.setJobGroup("fits", "fits")
    try:
        fitted = studies.fit_all(spark.createDataFrame(frame), ["seed"], tried, features).collect()
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fits")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(fitted) == 6 and len(jobs) < 10
    one = frame[frame.seed == 60].assign(_id=lambda f: f.row_id.astype(str)).sort_values("_id")
    held = {r[0] for r in spark.createDataFrame(one[["_id", "seed"]]).filter("pmod(xxhash64(_id, seed), 10) = 0").select("_id").collect()}
    how = models.encoder(one, ["a", "b"], ["kind"])
    rows = pd.DataFrame({
        "model": "60", "x": models.encode(how, one).tolist(), "y": one.label, "w": models.balanced_weights(one.label.to_numpy()),
        "held": one._id.isin(held),
    })
    rows = spark.createDataFrame(rows, "model string, x array<double>, y double, w double, held boolean")
    layers, steps = perceptron.fit(rows, {"60": models.encode(how, one).shape[1]})["60"]
    found = next(r for r in fitted if r.seed == 60 and r.learner == "perceptron")
    assert found.steps == steps
    for (w, b), (w2, b2) in zip(layers, json.loads(found.model)["layers"]):
        assert np.allclose(w, w2, atol=1e-6) and np.allclose(b, b2, atol=1e-6)


def test_only_models_with_crowded_cells_are_scored_again(spark, monkeypatch):
    features, fitted, masks, fresh, rows = studied(spark)
    widths, counts = [], studies._cell_counts
    monkeypatch.setattr(studies, "_cell_counts", lambda ready, stack, *rest: widths.append(stack.width) or counts(ready, stack, *rest))
    scores = studies._stack(fitted, features, masks).scores(fresh)
    # In cells of a quarter few models have as many rows.
    cuts = studies.exact_thresholds(rows, fitted, features, (0.2,), masks, 4, 500)
    for i, cut in enumerate(cuts):
        assert cut == {0.2: np.quantile(scores[:, i], 0.8, method="higher")}
    assert widths[0] == len(fitted) and all(w < len(fitted) for w in widths[1:])
