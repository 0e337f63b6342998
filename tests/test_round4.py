"""Rank power by simulation, queries that meet shards without a broadcast, rules summed in
columns, n-grams counted by hashes in arrays."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigate.llm import neighbours
from verdigate.operators import labels, metrics, overlap, ranks, resample, rules
from verdigate.plans import pipelines, texts
from verdigate.plans.proxies import decision_view
from verdigate.plans.ranks import power_gate


def _design(spark, rules, attenuation):
    return spark.createDataFrame([(rules, attenuation)], "active_rules INT, attenuation DOUBLE")


def test_rank_power_agrees_with_normal_draws(spark):
    rng, n, draws = np.random.default_rng(5), 7, 20000
    pairs = rng.multivariate_normal([0.0, 0.0], [[1.0, 0.45], [0.45, 1.0]], size=(draws, n))
    x, y = (pairs[:, :, i].argsort(axis=1).argsort(axis=1) for i in (0, 1))
    rho = 1.0 - 6.0 * ((x - y) ** 2).sum(axis=1) / (n * (n * n - 1))
    # Of seven rules a rho of 0.75 has p = 0.052 and the next, 0.7857, has p = 0.036.
    expected = (rho > 0.76).mean()
    row = ranks.rank_power(_design(spark, n, 0.9), 0.5, 10000, 11).first()
    assert row["estimated_power"] == pytest.approx(expected, abs=0.02)
    error = math.sqrt(row["estimated_power"] * (1 - row["estimated_power"]) / 10000)
    assert row["monte_carlo_standard_error"] == pytest.approx(error)
    assert row["power_lcb95"] == pytest.approx(row["estimated_power"] - 1.96 * error)


def test_rank_power_needs_four_rules_and_grows_with_the_signal(spark):
    assert ranks.rank_power(_design(spark, 3, 1.0), 0.5, 100, 1).first()["power_lcb95"] == 0.0
    weak, strong = (ranks.rank_power(_design(spark, 8, a), 0.9, 2000, 1).first()["estimated_power"] for a in (0.0, 1.0))
    # Without correlation the positive half of 5 % is found.
    assert 0.01 < weak < 0.045 and strong > 0.85
    assert ranks._rho_p(1.0, 8) == 0.0 and ranks._rho_p(None, 8) == 1.0
    assert ranks._rho_p(0.75, 7) == pytest.approx(0.0522, abs=1e-4)


def test_the_power_of_the_gate_is_simulated(spark):
    row = power_gate(spark, "/root/testdata/sf0.001", replicates=500).first()
    p = row["estimated_power"]
    assert 0.0 < p < 1.0 and row["power_lcb95"] == pytest.approx(max(0.0, p - 1.96 * math.sqrt(p * (1 - p) / 500)))
    lines = decision_view(spark, "/root/testdata/sf0.001").filter("split = 'test'")
    assert row["test_clusters"] == lines.select("event_cluster_id").distinct().count()
    conditions = ("test_clusters_per_source", "test_clusters_met", "active_rules_met", "power_met", "point_in_time_checks", "feature_access")
    met = all(row[c] for c in conditions)
    assert row["classification"] == ("confirmatory_eligible" if met else "exploratory_only")


def test_queries_meet_shards_without_a_join(spark, monkeypatch):
    plans = []

    class Recorded(neighbours.Scratch):
        def table(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().table(df)

    monkeypatch.setattr(neighbours, "Scratch", Recorded)
    rng = np.random.default_rng(3)
    v = [rng.standard_normal(6 if i % 3 else 4) for i in range(400)]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(table, every=10, shard_rows=60, block_rows=7).toPandas()
    # A join of shards and queries is broadcast by the size of the queries before the explode.
    assert len(plans) == 2 and not any("Join" in plan or "Broadcast" in plan for plan in plans)
    for q in range(0, 400, 10):
        same = [i for i in range(400) if i != q and len(v[i]) == len(v[q])]
        cos = [v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i]) for i in same]
        assert found[found.query_id == q].sort_values("rank").vec_id.tolist() == [same[i] for i in np.argsort(cos)[::-1][:5]]


def test_rules_in_columns_give_the_sums_of_rules_in_rows(spark):
    view = decision_view(spark, "/root/testdata/sf0.001").withColumn("reduced_utility", F.expr("nullif(full_utility, full_utility)"))
    view = view.withColumn("event_cluster_id", F.expr("nullif(event_cluster_id % 50, 7)"))
    registry, profiles = rules.core_rules(), labels.stress_profiles()
    names = [r.name for r in registry]
    wide, layout = metrics.wide_cluster_sums(view, registry, profiles)
    fields = ["rows", "authorized", "harmful", "laundering", "utility"]
    d = labels.explode_profiles(labels.decision_outcomes(rules.decide(view, registry)), profiles)
    expected = metrics.cluster_sums(d).toPandas().set_index(["profile", "event_cluster_id", "rule"])[fields].astype(float).sort_index()
    got = resample.lengthen(wide, ["profile", "event_cluster_id"], layout, "rule").toPandas()
    got = got.set_index(["profile", "event_cluster_id", "rule"])[fields].sort_index()
    assert got.index.equals(expected.index) and np.allclose(got, expected) and set(layout) == set(names)


def test_replay_rows_are_not_written_once_for_each_rule(spark, monkeypatch):
    written, real = [], pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df: written.append(real(df)) or written[-1])
    assert pipelines.public_replay(spark, "/root/testdata/sf0.01").count() == 20
    assert written and all("rule" not in df.columns for df in written)


def _grams(corpus, n):
    return {tuple(w[i:i + n]) for w in (t.split() for t in corpus if t) for i in range(len(w) - n + 1)}


def test_overlap_counts_the_ngrams_of_both_corpora(spark):
    rng = np.random.default_rng(8)
    left = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 30))) for _ in range(60)] + [None, "", "a", "a a a a a a", "b a b"]
    right = [" ".join(rng.choice(["b", "c", "d"], rng.integers(0, 30))) for _ in range(20)] + [None, "a a a a a"]
    sizes = (1, 3, 5, 12, 29)
    frames = [spark.createDataFrame([(t,) for t in c], "text string") for c in (left, right)]
    rows = {r["n"]: r for r in overlap.corpus_overlap(*frames, "text", sizes).collect()}
    for n in sizes:
        a, b = _grams(left, n), _grams(right, n)
        assert a or b or n not in rows
        if a or b:
            got = [rows[n][c] for c in ("left_unique", "right_unique", "shared_unique", "left_rate", "right_rate")]
            assert got == [len(a), len(b), len(a & b), len(a & b) / max(len(a), 1), len(a & b) / max(len(b), 1)]
    nothing = [f.limit(0) for f in frames]
    assert overlap.corpus_overlap(*nothing, "text", sizes).count() == 0


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_ngrams_do_not_depend_on_chunks(monkeypatch, at_once):
    monkeypatch.setattr(overlap, "CHUNK_TOKENS", at_once)
    words = [[str(i % 5) for i in range(k)] for k in (0, 9, 3, 40, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())).slice(1)], names=["_t"])
    packed = list(overlap._packed(1, (2, 7), 3)(iter([batch])))
    counted = next(overlap._counted(iter(packed))).to_pydict()
    assert dict(zip(counted["n"], counted["_l"])) == {n: len(_grams([" ".join(w) for w in words if w], n)) for n in (2, 7)}
    assert set(counted["_r"]) == set(counted["_s"]) == {0}


def test_ngrams_are_not_made_as_rows(spark):
    plan = texts.ngram_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
