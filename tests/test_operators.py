"""Hand-made frames: missing values, ties, boundaries, skew, malformed input."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigate.functions.columns import impact_bps, stable_seed
from verdigate.operators import calibration as C
from verdigate.operators import certify, labels, metrics, ranks, resample, rules
from verdigate.operators import proposals as P
from verdigate.operators import structure as X
from verdigate.operators import text as TX
from verdigate.operators.distributed import (
    global_position, grouped_quantiles, hash_position, quantile_bins,
)
from verdigate.operators.timeseries import asof_join, asof_many, busy_spans, quote_spans, sliced_lag, with_slices
from verdigate.sources.ingest import clean_doubles, parse_bars, require_columns

BASE = {
    "row_id": "a", "event_cluster_id": 1, "confidence": 0.9, "uncertainty": 0.1,
    "expected_edge_bps": 60.0, "liquidity_cost_bps": 5.0, "turnover_cost_bps": 5.0, "fee_bps": 5.0,
    "volatility_proxy": 0.5, "source_role": "edge_proposer", "candidate_action": 1,
    "full_utility": 0.01, "reduced_utility": 0.004, "original_source_eligible": True,
    "certification_eligible": True, "opportunity_slice": "ordinary",
}


def frame(spark, *changes):
    rows = [{**BASE, "row_id": str(i), **c} for i, c in enumerate(changes)]
    schema = (
        "row_id STRING, event_cluster_id BIGINT, confidence DOUBLE, uncertainty DOUBLE, "
        "expected_edge_bps DOUBLE, liquidity_cost_bps DOUBLE, turnover_cost_bps DOUBLE, "
        "fee_bps DOUBLE, volatility_proxy DOUBLE, source_role STRING, candidate_action INT, "
        "full_utility DOUBLE, reduced_utility DOUBLE, original_source_eligible BOOLEAN, "
        "certification_eligible BOOLEAN, opportunity_slice STRING"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return clean_doubles(spark.createDataFrame([[r[n] for n in names] for r in rows], schema))


def routes(df, registry=None):
    ruled = rules.decide(df, registry or rules.core_rules())
    return {(r["row_id"], r["rule"]): r["decision"] for r in ruled.collect()}


def test_rules_with_missing_features(spark):
    nan = float("nan")
    d = routes(frame(spark, {}, {"confidence": nan}, {"source_role": None}, {"uncertainty": None}))
    assert d["0", "Lifecycle Checklist"] == "execute"
    assert d["1", "Confidence Gate"] == "abstain"
    assert d["2", "Hard Role Gate"] == "abstain" and d["2", "Lifecycle Checklist"] == "review"
    assert d["3", "Uncertainty Gate"] == "abstain" and d["3", "Lifecycle Checklist"] == "execute"


def test_margin_boundaries_differ_between_families(spark):
    df = frame(spark, {"expected_edge_bps": 35.0}, {"expected_edge_bps": 15.0})
    d = routes(df)
    assert d["0", "Lifecycle Checklist"] == "reduce" and d["1", "Lifecycle Checklist"] == "abstain"
    grid = rules.grid_rules({"lifecycle": (("x", 20.0, 0.75, 1.0),)})
    assert routes(df, grid)["0", "Lifecycle Checklist [x]"] == "execute"


def test_candidate_without_action_abstains(spark):
    d = routes(frame(spark, {"candidate_action": 0}, {}), rules.two_task_rules())
    assert {v for (i, _), v in d.items() if i == "0"} == {"abstain"}
    assert d["1", "Direct Prior"] == "execute"


def test_lineage_gate(spark):
    rows = [
        ("clean", True, "edge_proposer", True, "edge_proposer|learned_prior", "execute"),
        ("tainted", True, "edge_proposer", True, "edge_proposer|risk_critic", "abstain"),
        ("empty", True, "edge_proposer", True, "", "abstain"),
        ("unattested", True, "edge_proposer", False, "edge_proposer", "review"),
        ("unverified", False, "edge_proposer", True, "edge_proposer", "abstain"),
        ("missing", None, None, None, None, "abstain"),
    ]
    df = spark.createDataFrame(
        rows, "row_id STRING, current_role_verified BOOLEAN, verified_current_role STRING, "
        "lineage_attested BOOLEAN, lineage_role_chain STRING, want STRING"
    )
    gate = [r for r in rules.provenance_rules() if r.name == "Provenance Hard Gate"]
    assert rules.decide(df, gate).filter("decision <> want").count() == 0


def test_zero_authorized_is_not_applicable(spark):
    d = labels.decision_outcomes(rules.decide(frame(spark, {}, {}), rules.core_rules()))
    m = metrics.profile_metrics(d, labels.certification_profiles())
    row = m.filter("rule = 'No Action' AND profile = 'overall'").first()
    assert row["far"] is None and row["upa"] is None and row["cau"] == 0.0 and row["zero_action"]
    assert math.isclose(row["moc"], 0.02) and math.isclose(row["tla"], -0.01)


def test_metrics_do_not_depend_on_row_order(spark):
    df = frame(spark, *[{"full_utility": (i % 7 - 3) / 100, "event_cluster_id": i % 4} for i in range(60)])
    d = labels.decision_outcomes(rules.decide(df, rules.core_rules()))
    one = metrics.profile_metrics(d, labels.certification_profiles())
    two = metrics.profile_metrics(d.repartition(5).orderBy(F.rand(3)), labels.certification_profiles())
    fields = ["coverage", "far", "cau", "moc", "tla"]
    assert metrics.tables_equal(one, two, ["rule", "profile"], fields, 1e-12).filter("NOT equal").count() == 0
    broken = one.filter(F.abs(F.col("coverage") - F.col("execute_rate") - F.col("reduce_rate")) > 1e-12)
    assert broken.count() == 0


def test_coverage_relations(spark):
    m = spark.createDataFrame(
        [("same", "ordinary", 0.4), ("same", "stress", 0.4), ("none", "ordinary", 0.0),
         ("none", "stress", 0.2), ("less", "ordinary", 0.5), ("less", "stress", 0.1),
         ("more", "ordinary", 0.1), ("more", "stress", 0.5)],
        "rule STRING, profile STRING, coverage DOUBLE",
    )
    got = {r["rule"]: r["coverage_relation"] for r in metrics.coverage_collapse(m).collect()}
    assert got == {"same": "UNIFORM", "none": "UNDEFINED_ZERO_ORDINARY", "less": "COLLAPSE",
                   "more": "EXPANSION"}


def test_impact_is_capped_for_unusable_depth(spark):
    df = spark.createDataFrame([(None,), (0.0,), (-5.0,), (float("nan"),), (1e6,), (1.0,)], "d DOUBLE")
    got = [r[0] for r in df.select(impact_bps(F.lit(100000.0), F.col("d"))).collect()]
    assert got == [100.0, 100.0, 100.0, 100.0, 5.0, 100.0]


@pytest.mark.parametrize("hot", [0.0, 0.4])
@pytest.mark.parametrize("sorted_rows, cells", [(100_000, 1000), (300, 20)])
def test_quantiles_match_numpy(spark, hot, sorted_rows, cells):
    """Rounds of narrowing on a large group with ties, next to small ones and a null key."""
    rng = np.random.default_rng(5)
    values = {g: rng.normal(size=n) for g, n in (("a", 1), ("b", 7), ("c", 20_000), (None, 90))}
    values["c"][: int(hot * 20_000)] = 0.25
    values["c"][-500:] = 10.0 ** -np.arange(500)
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("b", None), ("d", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(4)
    for method in ("linear", "higher"):
        probs = {"q00": 0.0, "q05": 0.05, "q50": 0.5, "q80": 0.8, "q100": 1.0}
        got = grouped_quantiles(
            df, ["g"], "v", probs, method=method, sorted_rows=sorted_rows, cells=cells
        ).collect()
        assert len(got) == 20
        for r in got:
            want = np.quantile(values[r["g"]], probs[r["quantile"]], method=method)
            assert math.isclose(r["value"], want, rel_tol=1e-12, abs_tol=1e-12)
            assert r["n"] == len(values[r["g"]])


def test_no_task_sorts_more_values_than_stated(spark, monkeypatch):
    """One group holds all rows; what is left to sort after the rounds is small."""
    from verdigate.operators import distributed

    seen = []
    inside = distributed._inside

    def watched(rows, group, parts):
        made = inside(rows, group, parts)
        seen.append(made)
        return made

    monkeypatch.setattr(distributed, "_inside", watched)
    df = spark.range(30_000).select(F.lit("g").alias("g"), F.sqrt("id").alias("v"))
    got = grouped_quantiles(df, ["g"], "v", {"m": 0.5}, sorted_rows=100, cells=50).first()
    assert math.isclose(got["value"], (math.sqrt(14_999) + math.sqrt(15_000)) / 2, rel_tol=1e-12)
    assert seen[-1].groupBy("_lo", "_hi").agg(F.countDistinct("_v").alias("n")).agg(F.max("n")).first()[0] <= 100


def test_bins_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": np.r_[rng.integers(0, 6, 200).astype(float), [np.nan]], "y": rng.normal(size=201)})
    df = clean_doubles(spark.createDataFrame(pdf.reset_index(names="i")))
    bins = quantile_bins(df, ["x", "y"])
    got = df.select("i", *[e.alias(f"{c}_bin") for c, e in bins.items()]).toPandas().sort_values("i")
    for c in ("x", "y"):
        want = pd.qcut(pdf[c], 5, labels=False, duplicates="drop").fillna(-1).astype(int)
        assert (got[f"{c}_bin"].to_numpy() == want.to_numpy()).all()


def test_positions_cover_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    got = global_position(df, ["k", "id"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(3000))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)
    h = hash_position(df.select("id"), "id")
    assert h.agg(F.countDistinct("position")).first()[0] == 3000


@pytest.mark.parametrize("slice_rows", [50_000, 15])
def test_asof_matches_pandas(spark, slice_rows):
    """One key holds most quotes, a third of them in one busy spell."""
    rng = np.random.default_rng(3)
    n = 400
    seconds = np.where(rng.random(n) < 0.3, rng.integers(2000, 2040, n), rng.integers(0, 4000, n))
    quotes = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n)),
        "qs": np.sort(seconds) * 10, "v": rng.normal(size=n), "i": np.arange(n)})
    probes = pd.DataFrame({"k": rng.integers(0, 4, 150), "ps": np.sort(rng.integers(0, 4000, 150)) * 10,
                           "pid": np.arange(150)})
    q = spark.createDataFrame(quotes).withColumn("qt", F.timestamp_seconds("qs"))
    p = spark.createDataFrame(probes).withColumn("pt", F.timestamp_seconds("ps"))
    cases = [("backward", False, 500), ("backward", True, None), ("forward", False, None), ("forward", True, 500)]
    for direction, strict, age in cases:
        got = asof_join(p, q, ["k"], "pt", "qt", ["v", "i"], "i", direction, strict, age,
                        slice_seconds=9000, slice_rows=slice_rows).select("pid", "i").toPandas().set_index("pid")["i"]
        left = probes.sort_values("ps")
        for row in left.itertuples():
            own = quotes[quotes.k == row.k]
            if direction == "backward":
                hit = own[own.qs < row.ps] if strict else own[own.qs <= row.ps]
                hit = hit.sort_values(["qs", "i"]).tail(1)
            else:
                hit = own[own.qs > row.ps] if strict else own[own.qs >= row.ps]
                hit = hit.sort_values(["qs", "i"]).head(1)
            ok = len(hit) and (age is None or abs(int(hit.qs.iloc[0]) - row.ps) <= age)
            assert (pd.isna(got[row.pid]) and not ok) or (ok and got[row.pid] == hit.i.iloc[0])


def test_no_slice_holds_more_rows_than_stated(spark):
    """All rows of one key in one busy minute of a day, and equal times that cannot be cut."""
    busy = spark.range(4000).select(F.lit("a").alias("k"), (F.pow(F.col("id") / 4000, 3) * 60_000_000).cast("bigint").alias("_t"))
    tied = spark.range(300).select(F.lit("b").alias("k"), F.lit(77).cast("bigint").alias("_t"))
    rows = busy.unionByName(tied)
    cut = with_slices(rows, ["k"], 86_400_000_000, busy_spans(rows, ["k"], 86_400_000_000, 100))
    sizes = {r["k"]: r["n"] for r in cut.groupBy("k", "_slice").count().groupBy("k").agg(F.max("count").alias("n")).collect()}
    assert sizes["a"] <= 100 and sizes["b"] == 300 and cut.count() == 4300
    assert busy_spans(rows, ["k"], 1_000, 100_000) is None


def test_asof_probe_without_key_finds_nothing(spark):
    q = spark.createDataFrame([(None, 5, 1), ("a", 5, 2)], "k string, s int, i int").withColumn("t", F.timestamp_seconds("s"))
    p = spark.createDataFrame([(None, 9, 1), ("a", None, 2), ("a", 9, 3)], "k string, s int, pid int").withColumn("pt", F.timestamp_seconds("s"))
    got = {r["pid"]: r["i"] for r in asof_join(p.drop("s"), q.drop("s"), ["k"], "pt", "t", ["i"], "i").collect()}
    assert got == {1: None, 2: None, 3: 2}


def test_sliced_lag_matches_plain_lag(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id",
                                 F.timestamp_seconds(F.col("id") * 7000).alias("t"))
    for rows in (50_000, 10):
        got = sliced_lag(df, ["k"], "t", ["id"], "id", "prev", 500_000, rows)
        assert got.count() == 500
        assert got.filter(~F.col("prev").eqNullSafe(F.when(F.col("id") >= 3, F.col("id") - 3))).count() == 0


def test_checked_join_rejects_bad_keys(spark):
    one = spark.createDataFrame([(1, "x"), (2, "y")], "id INT, a STRING")
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "id INT, b DOUBLE")
    with pytest.raises(ValueError, match="right keys"):
        X.checked_join(one, twice, ["id"])
    with pytest.raises(ValueError, match="left keys"):
        X.checked_join(twice, one, ["id"])
    with pytest.raises(ValueError, match="lack"):
        X.checked_join(one, twice.limit(1), ["id"], required=["b"])
    with pytest.raises(ValueError, match="missing required"):
        require_columns(one, ["id", "zzz"])


def test_hash_halves_need_an_even_count(spark):
    with pytest.raises(ValueError, match="even"):
        X.hash_halves(spark.range(3), "id", "n")
    odd = X.hash_halves(spark.range(7), "id", "n", spare="left").groupBy("destination").count().collect()
    assert {r["destination"]: r["count"] for r in odd} == {"paper_test": 3, "community_hidden": 3, "left": 1}
    got = X.hash_halves(spark.range(10), "id", "n").groupBy("destination").count().collect()
    assert sorted(r["count"] for r in got) == [5, 5]


def test_seed_matches_hashlib(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"ns/7/label").digest()[:4], "big")
    assert spark.range(1).select(stable_seed("ns", 7, F.lit("label"))).first()[0] == want


def test_quotas():
    assert X.curriculum_quotas(10, {"a": 0.55, "b": 0.45}) == {"a": 6, "b": 4}
    with pytest.raises(ValueError):
        X.curriculum_quotas(10, {"a": 0.5, "b": 0.4})
    with pytest.raises(ValueError):
        X.curriculum_quotas(1, {"a": 0.9, "b": 0.1})


def test_fingerprint_sees_copies_but_not_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x INT, y STRING")

    def fp(d):
        return X.dataset_fingerprint(d).first()["fingerprint"]

    assert fp(df) == fp(df.repartition(3).orderBy(F.desc("x")))
    assert fp(df) != fp(df.distinct())


def _pairs(spark, xs, ys):
    return spark.createDataFrame(
        [(f"r{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))],
        "rule STRING, controlled DOUBLE, observed DOUBLE",
    )


def test_rank_statistics_with_ties(spark):
    xs, ys = [1, 2, 2, 4, 5, 6], [3, 1, 1, 6, 5, 2]
    got = ranks.rank_statistics(_pairs(spark, xs, ys)).first()
    rx, ry = pd.Series(xs).rank(), pd.Series(ys).rank()
    assert math.isclose(got["spearman_rho"], np.corrcoef(rx, ry)[0, 1], rel_tol=1e-12)
    s = sum(np.sign(xs[i] - xs[j]) * np.sign(ys[i] - ys[j]) for i in range(6) for j in range(i))
    tx = sum(xs[i] != xs[j] for i in range(6) for j in range(i))
    ty = sum(ys[i] != ys[j] for i in range(6) for j in range(i))
    assert math.isclose(got["kendall_tau_b"], s / math.sqrt(tx * ty), rel_tol=1e-12)


def test_rank_reasons(spark):
    few = _pairs(spark, [1, 2], [1, 2])
    flat = _pairs(spark, [1, 1, 1], [1, 2, 3])
    gap = _pairs(spark, [1, 2, 3], [1, 2, 3]).withColumn(
        "observed", F.when(F.col("rule") != "r1", F.col("observed")))
    assert ranks.rank_statistics(few).first()["reason"] == "fewer_than_three_aligned_rules"
    assert ranks.rank_statistics(flat).first()["reason"].startswith("controlled_ranking")
    assert ranks.rank_statistics(gap).first()["reason"] == "missing_or_na_rule_scores"
    assert ranks.exact_permutation(flat).first()["exact_p_value"] is None


def test_exact_permutation_by_enumeration(spark):
    xs, ys = [1, 2, 3, 4, 5], [4, 5, 2, 2, 1]
    got = ranks.exact_permutation(_pairs(spark, xs, ys)).first()
    rx, ry = pd.Series(xs).rank().to_numpy(), pd.Series(ys).rank().to_numpy()
    rho = np.corrcoef(rx, ry)[0, 1]
    all_ = [np.corrcoef(rx, p)[0, 1] for p in itertools.permutations(ry)]
    assert got["permutations"] == 120
    assert math.isclose(got["exact_p_value"], np.mean([v <= rho + 1e-12 for v in all_]))


def test_holm_with_ties(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.02), ("d", 0.5)], "name STRING, raw_p DOUBLE")
    got = {r["name"]: r for r in ranks.holm(df).collect()}
    assert [round(got[k]["holm_adjusted_p"], 10) for k in "abcd"] == [0.04, 0.06, 0.06, 0.5]
    assert [got[k]["reject"] for k in "abcd"] == [True, False, False, False]


def test_student_tail_and_power():
    assert math.isclose(ranks._t_tail(2.0, 10), 0.03669401738537018, rel_tol=1e-9)
    assert math.isclose(ranks._t_tail(-2.0, 10), 1 - 0.03669401738537018, rel_tol=1e-9)
    # Published design: SD 0.0342 over 500 dates, effect 0.015.
    assert ranks.two_sided_power(0.015, 0.0342, 500) > 0.99
    n = ranks.required_clusters(0.02, 0.1, 0.8)
    assert ranks.two_sided_power(0.02, 0.1, n) >= 0.8 > ranks.two_sided_power(0.02, 0.1, n - 2)


def test_t_test_without_variance(spark):
    rows = [("z", 0.0), ("z", 0.0), ("c", 2.0), ("c", 2.0), ("n", -0.1), ("n", -0.1), ("one", 0.05)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")

    def p(**options):
        return {r["g"]: r["raw_p"] for r in ranks.t_test(df, "v", ["g"], **options).collect()}

    assert p() == {"z": 1.0, "c": 0.0, "n": 0.0, "one": 1.0}
    assert p(alternative="greater") == {"z": 1.0, "c": 0.0, "n": 1.0, "one": 1.0}
    assert set(p(required_pairs=3).values()) == {1.0}


def test_gate_needs_every_condition(spark):
    rows = [(500, 4, 0.8), (499, 4, 0.9), (500, 3, 0.9), (500, 4, 0.79)]
    df = spark.createDataFrame(rows, "test_clusters INT, active_rules INT, power_lcb95 DOUBLE")
    got = ranks.gate_conditions(df).collect()
    assert [r["classification"] == "confirmatory_eligible" for r in got] == [True, False, False, False]
    assert got[2]["power_lcb95"] == 0.0


def test_bootstrap_routes_agree(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"c": np.arange(9000), "x": rng.normal(1.0, 2.0, 9000)})
    df = spark.createDataFrame(pdf)
    means = {}
    for method in ("draws", "blocks"):
        out = resample.resampled_sums(df, "c", ["x"], 60, 11, method=method).toPandas()
        assert len(out) == 60 and (out["clusters"] == 9000).all()
        means[method] = out["x"] / 9000
    se = pdf.x.std() / math.sqrt(9000)
    for m in means.values():
        assert abs(m.mean() - pdf.x.mean()) < 4 * se / math.sqrt(60) + 1e-9
        assert 0.7 * se < m.std() < 1.3 * se


def test_draws_do_not_depend_on_the_partitions(spark):
    df = spark.range(5000).select(
        F.col("id").alias("c"), (F.col("id") % 2).alias("g"), (F.col("id") % 97).cast("double").alias("x"),
        F.lit(1.0).alias("one"),
    )
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions, chunk in ((3, 1 << 20), (8, 100)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        old, resample.CHUNK = resample.CHUNK, chunk
        try:
            out = resample.resampled_sums(df, "c", ["x", "one"], 30, 5, ["g"]).toPandas()
        finally:
            resample.CHUNK = old
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert (out["one"] == 2500).all() and (out["clusters"] == 2500).all()
        found.append(out.sort_values(["g", "replicate"])["x"].tolist())
    assert len(found[0]) == 60 and found[0] == found[1]
    assert len(set(found[0])) > 50


def test_moving_block_keeps_n(spark):
    df = spark.range(10).select(F.col("id").alias("c"), F.lit(1.0).alias("x"))
    for length in (4, 30):
        out = resample.resampled_sums(df, "c", ["x"], 25, 3, block_length=length).toPandas()
        assert len(out) == 25 and (out["x"] == 10.0).all()


def test_draws_are_counted_before_they_are_shuffled(spark):
    """What a task hands on does not grow with replicates times clusters."""
    df = spark.range(20000).select(F.col("id").alias("c"), F.lit(1.0).alias("x"))
    for length in (None, 7):
        out = resample.resampled_sums(df, "c", ["x"], 40, 3, block_length=length)
        assert "_slot" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r["x"] for r in out.collect()} == {20000.0}


def test_moving_blocks_over_several_ranges(spark):
    """Every block is added up as a plain loop does, around the end and over range ends."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 47).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"c": np.arange(47), "x": x}))
    old, resample.WIDE, chunk, resample.CHUNK = resample.WIDE, 5, resample.CHUNK, 4
    try:
        got = resample.resampled_sums(df, "c", ["x"], 20, 9, block_length=7).toPandas().set_index("replicate")["x"]
    finally:
        resample.WIDE, resample.CHUNK = old, chunk
    for r, own in enumerate(resample.replicate_hashes(np.arange(20), 9)):
        starts = resample._starts(47, own, resample._slot_hashes(0, 7), 0)
        taken = [(s + o) % 47 for i, s in enumerate(starts) for o in range(7) if i * 7 + o < 47]
        assert got[r] == x[taken].sum()


def test_steps_of_a_byte(spark):
    for starts in ([0], [255, 255, 510], [3, 3, 4, 70000], [254, 1000]):
        assert resample._decoded(resample._coded(np.array(starts))).tolist() == starts


def test_only_wanted_ngrams_are_counted(spark):
    left = spark.createDataFrame([("a b c d a b",), ("x y a b",), (None,)], "text STRING")
    right = spark.createDataFrame([("a b q",), ("b c",)], "text STRING")
    bench = TX.ngram_counts(right, "text", (2, 3))
    found = {(r.n, r.ngram): r.occurrences for r in TX.ngram_counts(left, "text", (2, 3), bench).collect()}
    assert found == {(2, "a b"): 3, (2, "b c"): 1}
    rows = {r.n: r for r in TX.ngram_overlap(TX.ngram_rows(left, "text", (2, 3)), TX.ngram_rows(right, "text", (2, 3))).collect()}
    assert (rows[2].left_unique, rows[2].right_unique, rows[2].shared_unique) == (6, 3, 2)
    assert (rows[3].left_unique, rows[3].right_unique, rows[3].shared_unique) == (6, 1, 0)
    plan = TX.ngram_overlap(TX.ngram_rows(left, "text", (2,)), TX.ngram_rows(right, "text", (2,)))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_a_fit_reads_its_training_rows_once(spark):
    from verdigate.operators import learn

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(400).select(
        (F.col("id") % 7 / 7.0).alias("a"), F.concat(F.lit("k"), F.col("id") % 3).alias("b"),
        (F.col("id") % 2).cast("int").alias("training_label"),
    )
    features = learn.Features(("a",), ("b",))
    model = learn.fit(rows.mapInPandas(seen, rows.schema), features)
    assert read.value == 400
    assert learn.score(model, rows, features).filter("score between 0 and 1").count() == 400


def test_pareto_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", *map(float, rng.integers(0, 4, 4))) for i in range(25)] + [("na", 9.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "rule STRING, coverage DOUBLE, far DOUBLE, alr DOUBLE, moc DOUBLE")
    got = {r["rule"]: r["pareto_efficient"] for r in certify.pareto_flags(df, ["rule"]).collect()}

    def beats(b, a):
        no_worse = b[1] >= a[1] and all(b[i] <= a[i] for i in (2, 3, 4))
        return no_worse and (b[1] > a[1] or any(b[i] < a[i] for i in (2, 3, 4)))

    full = rows[:-1]
    assert got == {**{a[0]: not any(beats(b, a) for b in full) for a in full}, "na": False}


def test_surface_fails_missing_bounds(spark):
    b = spark.createDataFrame(
        [("ok", "overall", 0.0, 0.0, 1.0), ("na", "overall", None, 0.0, 1.0)],
        "rule STRING, profile STRING, far_ucb95 DOUBLE, alr_ucb95 DOUBLE, coverage_lcb95 DOUBLE")
    s = certify.certification_surface(b)
    assert s.count() == 240
    v = {r["rule"]: r["certification_volume"] for r in certify.certification_volume(s).collect()}
    assert v == {"ok": 1.0, "na": 0.0}


def test_similar_bits_by_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, (30, 2))
    rows = []
    for hi, lo in base:
        for flips in range(9):
            h, l = int(hi), int(lo)
            for b in rng.choice(64, flips, replace=False):
                h, l = (h ^ (1 << int(b)), l) if b < 32 else (h, l ^ (1 << (int(b) - 32)))
            rows.append((h, l))
    left = spark.createDataFrame(rows[:150] * 3, "hi BIGINT, lo BIGINT")
    right = spark.createDataFrame(rows[100:], "hi BIGINT, lo BIGINT")
    got = TX.similar_bits(left, right)
    want = {(a, b) for a in set(rows[:150]) for b in set(rows[100:])
            if (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count() <= 5}
    pairs = [((r["left_hi"], r["left_lo"]), (r["right_hi"], r["right_lo"])) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_seed_numbers(spark):
    texts = [
        '{"seeds": {"a": 11, "b": "12", "c": 13.5, "d": true, "e": -4, "f": null, "g": {"h": 14}}}',
        ' {"seeds": [15], "x": {"seeds": {"y": 16}}}', '{"seeds": {"a": 17}', '["seeds"]', "", None,
        "SEEDS : 21, x22 23\r24\nseeds 25\x0cseeds:\n26", "my_seed: 31 random_state=32 default_rng( 33 )",
        '{"seeds": {}}', '{"seeds": {"a": 11, "big": 18446744073709551616}}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert sorted(r["seed"] for r in TX.seed_numbers(df, "t").collect()) == [-4, 11, 21, 23, 31, 32, 33]
    assert TX.seed_numbers(df.limit(0), "t").count() == 0


def test_ngrams_and_markup(spark):
    df = spark.createDataFrame([(r"% note" + "\n" + r"\textbf{Big} cats-eat \cite{x} fish",), ("two",)], "t STRING")
    got = [r[0] for r in df.select(TX.tokens(F.col("t"))).collect()]
    assert got == [["cats-eat", "fish"], ["two"]]
    nested = "word"
    for _ in range(9):
        nested = r"\emph{" + nested + "}"
    deep = spark.createDataFrame([("a " + nested + " b",), ("}} { " + nested,), (None,), ("{x} \\",)], "t STRING")
    assert [r[0] for r in deep.select(TX.tokens(F.col("t"))).collect()] == [["a", "b"], [], None, ["x"]]
    grams = df.select(TX.ngrams(TX.tokens(F.col("t")), 2)).collect()
    assert [r[0] for r in grams] == [["cats-eat fish"], []]


def test_projection_and_sensitive_values(spark):
    assert TX.forbidden_field("Raw-Response") and TX.forbidden_field("evidence_quote")
    assert not TX.forbidden_field("confidence") and TX.duplicate_headers(["A b", "a_B"]) == ["a_b"]
    df = spark.createDataFrame(
        [("sealed", ["/x/raw/a", "fine"]), ("a/b", [r"C:\keys\hidden\key.pem"]), ("plain", [])],
        "s STRING, l ARRAY<STRING>")
    got = [(r["s"], r["l"]) for r in TX.public_projection(df).collect()]
    assert got == [(None, ["fine"]), ("a/b", []), ("plain", [])]


def test_proposal_reasons(spark):
    good = ('{"context_id":"%s","task_id":"directional_execution","action":"%s","confidence":0.5,'
            '"uncertainty":0.2,"expected_edge_bps":3,"review_recommended":true,"rationale":"r",'
            '"evidence_fields":["symbol"],"risk_flags":[]}')
    payload = '{"proposals":[%s,%s,%s,%s]}' % (
        good % ("a", "long"), good % ("a", "short"), good % ("b", "hold"), good % ("zz", "long"))
    sent = spark.createDataFrame([(1, payload), (2, "{broken")], "batch_id INT, payload STRING")
    asked = spark.createDataFrame(
        [(1, c, "directional_execution") for c in "abc"] + [(2, "d", "directional_execution")],
        "batch_id INT, context_id STRING, task_id STRING")
    v = P.validate_proposals(sent, asked)
    got = {r["context_id"]: r for r in v.collect()}
    assert got["a"]["raw_schema_valid"] and got["a"]["action"] == "long" and got["a"]["candidate_action"] == 1
    assert got["b"]["malformed_reason"] == "action_mismatch_placeholder"
    assert got["c"]["malformed_reason"] == "missing_context_placeholder"
    assert got["d"]["malformed_reason"] == "unparseable_provider_response"
    assert got["c"]["action"] == "abstain" and got["c"]["uncertainty"] == 1.0
    audit = {r["batch_id"]: r for r in P.batch_audit(v, P.proposal_records(sent, "batch_id", "payload")).collect()}
    assert audit[1]["ignored_extra_records"] == 1 and audit[1]["ignored_duplicate_records"] == 1


def test_bars_drop_headers(spark):
    raw = spark.createDataFrame(
        [("open_time", "open", "high", "low", "close", "volume"),
         ("1700000000000", "1.5", "2", "1", "1.7", "3"), ("x", "1", "1", "1", "1", "1")],
        "open_time STRING, open STRING, high STRING, low STRING, close STRING, volume STRING")
    assert [r["open"] for r in parse_bars(raw).collect()] == [1.5]


def test_folds_follow_array_split(spark):
    df = spark.range(13).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("t"))
    got = X.contiguous_folds(df, "id", "t", 5).orderBy("id").toPandas()["fold"]
    want = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(13), 5))])
    assert (got.to_numpy() == want).all()


def test_permuted_bundle_keeps_the_multiset(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("a"), (F.col("id") * 2).alias("b"))
    out = C.permute_columns(df, "row_id", ["a", "b"], 3)
    assert sorted(r["b"] for r in out.collect()) == [2 * i for i in range(200)]
    assert out.filter(F.col("a") != (F.col("b") / 2) % 5).count() == 0
    assert out.filter(F.col("b") != F.col("row_id") * 2).count() > 150


def test_stream_router(spark, tmp_path):
    from verdigate.streaming.router import start_router

    rows = spark.createDataFrame(
        [(1, "train"), (2, "test"), (3, "test"), (4, "validation"), (5, "test")],
        "event_cluster_id BIGINT, split STRING")
    rows.write.csv(str(tmp_path / "in"), header=True)
    halves = spark.createDataFrame(
        [(2, "paper_test"), (3, "community_hidden")], "event_cluster_id BIGINT, destination STRING")
    query = start_router(spark, str(tmp_path / "in"), rows.schema, halves, str(tmp_path / "out"),
                         str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {r["event_cluster_id"]: r["destination"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "train", 2: "paper_test", 3: "community_hidden", 4: "validation"}


def test_public_projection_reaches_maps_and_nested_strings(spark):
    df = spark.sql(
        """SELECT 1 AS id, map('api_key_path', 'x', 'ok', 'sealed', 'fine', 'v') AS m,
        named_struct('rationale', 'r') AS gone, array(named_struct('a', 'x/raw/y', 'b', 2)) AS list,
        named_struct('inner', named_struct('p', '/data/k.pem', 'q', 'plain')) AS deep"""
    )
    got = TX.public_projection(df)
    assert got.columns == ["id", "m", "list", "deep"]
    row = got.first()
    assert row["m"] == {"ok": None, "fine": "v"}
    assert row["list"][0]["a"] is None and row["list"][0]["b"] == 2
    assert row["deep"]["inner"].asDict() == {"p": None, "q": "plain"}
    found = {(r["field"], r["reason"]) for r in TX.sensitive_findings(df, "id").collect()}
    assert ("list[0].a", "raw, sealed, log, or snapshot path") in found
    assert ("deep.inner.p", "absolute hidden or private key path") in found
    assert any(f.startswith("m[") for f, _ in found)


def test_file_fingerprints_name_what_they_skip(spark, tmp_path):
    from verdigate.sources import ingest

    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "b").write_bytes(b"1")
    got = {r["path"][-1]: r for r in ingest.file_fingerprints(spark, str(tmp_path), max_bytes=3).collect()}
    assert got["a"]["sha256"] is None and got["a"]["reason"] and got["b"]["sha256"] and got["b"]["reason"] is None


def test_features_are_read_from_the_expression(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", True)], "confidence DOUBLE, `odd name` DOUBLE, row_id STRING, other BOOLEAN")
    hidden = rules.Rule("Hidden", ("confidence",), lambda t: rules.gate((F.col("confidence") > t["confidence"]) & F.col("other")))
    boast = rules.Rule("Boast", ("confidence", "row_id"), lambda t: rules.gate(F.col("confidence") > 0))
    odd = rules.Rule("Odd", ("odd name",), lambda t: rules.gate(F.col("`odd name`") > 0))
    assert rules.features_read(df, hidden) == ["confidence", "other"]
    assert rules.features_read(df, odd) == ["odd name"]
    got = {r["rule"]: r for r in rules.feature_access(df, [hidden, boast, odd], "t", ("confidence", "other", "odd name"), (), ("row_id",)).collect()}
    assert (got["Hidden"]["status"], got["Hidden"]["undeclared_features"]) == ("INVALID", ["other"])
    assert (got["Boast"]["status"], got["Boast"]["features_used"]) == ("VALID", ["confidence"])
    assert got["Odd"]["status"] == "VALID"


def test_decisions_from_a_relation_of_thresholds(spark):
    df = spark.createDataFrame([(0.3,), (0.65,), (0.95,)], "confidence DOUBLE").withColumn("uncertainty", 1 - F.col("confidence"))
    chosen = spark.createDataFrame([("Confidence Gate", {"confidence": 0.9})], "rule STRING, chosen MAP<STRING, DOUBLE>")
    own = [r for r in rules.core_rules() if r.name in ("Confidence Gate", "Uncertainty Gate")]
    got = {(r["rule"], r["confidence"]): r["decision"] for r in rules.decide_with(df, own, chosen).collect()}
    assert got["Confidence Gate", 0.65] == "abstain" and got["Confidence Gate", 0.95] == "execute"
    assert got["Uncertainty Gate", 0.65] == "execute" and got["Uncertainty Gate", 0.3] == "abstain"


def test_published_partitions_are_counted_and_never_overwritten(spark, tmp_path):
    import os

    from verdigate.sources.sinks import publish_partitions

    df = spark.range(100).select("id", F.when(F.col("id") < 60, "a").otherwise("b").alias("destination"))
    path = str(tmp_path / "out")
    assert publish_partitions(df, path, ("a", "b", "c")) == {"a": 60, "b": 40, "c": 0}
    assert spark.read.parquet(path).where("destination = 'a'").count() == 60
    with pytest.raises(FileExistsError):
        publish_partitions(df, path, ("a", "b"))
    with pytest.raises(ValueError, match="40 rows have no listed destination"):
        publish_partitions(df, str(tmp_path / "other"), ("a",))
    lost = df.withColumn("destination", F.when(F.col("id") > 2, F.col("destination")))
    with pytest.raises(ValueError, match="3 rows"):
        publish_partitions(lost, str(tmp_path / "other"), ("a", "b"))
    assert sorted(os.listdir(tmp_path)) == ["out"]
    assert publish_partitions(df.limit(0), str(tmp_path / "none"), ("a",)) == {"a": 0}


def test_several_asof_joins_in_one_pass(spark):
    """Tagged probes of one pass give what single joins give, ties and missing times included."""
    rng = np.random.default_rng(12)
    quotes = pd.DataFrame({"k": rng.integers(0, 3, 200), "qs": rng.integers(0, 300, 200), "v": rng.normal(size=200), "i": np.arange(200)})
    probes = pd.DataFrame({"pid": np.arange(60), "k": rng.integers(0, 4, 60), "a": rng.integers(0, 300, 60), "b": rng.integers(0, 300, 60)})
    q = spark.createDataFrame(quotes).withColumn("qt", F.timestamp_seconds("qs"))
    p = spark.createDataFrame(probes).withColumns({
        "at": F.timestamp_seconds("a"), "bt": F.when(F.col("pid") % 7 > 0, F.timestamp_seconds("b"))})
    for direction in ("backward", "forward"):
        busy = quote_spans(q, ["k"], "qt", 1000, 20)
        got = asof_many(p, q, ["k"], "pid", [("x_", "at", True, ("v", "i")), ("y_", "bt", False, ("i",))], "qt", "i", direction, 40, 1000, busy)
        one = asof_join(p, q, ["k"], "at", "qt", ["v", "i"], "i", direction, True, 40, prefix="x_")
        both = asof_join(one, q, ["k"], "bt", "qt", ["i"], "i", direction, False, 40, prefix="y_")
        key = lambda r: r["pid"]
        assert busy is not None and sorted(got.collect(), key=key) == sorted(both.select(*got.columns).collect(), key=key)


def test_white_space_does_not_hide_a_sensitive_value(spark):
    df = spark.createDataFrame([(w + "hidden" + w,) for w in ("", " ", "\t", "\n", "\r\n", "\x0b\x0c")] + [("plain",)], "v STRING")
    reasons = [r[0] for r in df.select(TX.sensitive_value(F.col("v"))).collect()]
    assert reasons[0] is not None and len(set(reasons[:6])) == 1 and reasons[6] is None


def test_joins_are_checked_by_keys_alone(spark):
    """The same verdicts as the join itself, null keys included, for both kinds of join."""
    make = lambda rows, name: spark.createDataFrame(rows, f"id int, {name} string")
    left, right = make([(1, "a"), (2, "b"), (3, "c")], "a"), make([(1, "x"), (2, "y"), (3, "z"), (4, None)], "b")
    X.assert_joins(left, right, ["id"], required=["b"])
    X.assert_joins(left, right.limit(2), ["id"], "inner", required=["b"])
    X.assert_joins(left.unionByName(left), right, ["id"], "left", "many_to_one", ["b"])
    for bad, how in ((left.unionByName(make([(4, "d")], "a")), "inner"), (left.unionByName(make([(None, "d")], "a")), "left")):
        with pytest.raises(ValueError, match="lack"):
            X.assert_joins(bad, right.unionByName(make([(None, "n")], "b")), ["id"], how, required=["b"])
    with pytest.raises(ValueError, match="right keys"):
        X.assert_joins(left, right.unionByName(right), ["id"], "left", "many_to_one", ["b"])
    with pytest.raises(ValueError, match="left keys"):
        X.assert_joins(left.unionByName(left), right, ["id"])


def test_calibration_run_joins_lines_to_orders_once(spark, monkeypatch):
    from verdigate.plans import calibration, proxies

    reads, joined = [], proxies.lines_with_orders
    monkeypatch.setattr(proxies, "lines_with_orders", lambda *a: reads.append(a) or joined(*a))
    assert calibration.calibration_run(spark, "/root/testdata/sf0.001").count() == 3
    assert len(reads) == 1
