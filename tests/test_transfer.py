"""Rank transfer over all sets, against plain Python on small frames."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from verdigate.operators import ranks, transfer

RULES = ["a", "b", "c", "d"]


def _frame(spark):
    """Rule r hits in (r + 1) of 6 rows of a date; the last date has no model and rule d never acts
    for model m2."""
    rows = []
    for day in range(12):
        model = None if day == 11 else f"m{day % 2 + 1}"
        for i, rule in enumerate(RULES):
            for k in range(6):
                taken = not (rule == "d" and model == "m2")
                rows.append((f"d{day}", model, rule, taken and k <= i, taken))
    rows.append((None, "m1", "a", True, True))
    return spark.createDataFrame(rows, "event_cluster_id STRING, model STRING, rule STRING, hit BOOLEAN, taken BOOLEAN")


def _parts():
    return {"rate": (F.col("hit").cast("double"), F.col("taken").cast("double"))}


def _controlled(spark, scores):
    return spark.createDataFrame(list(scores.items()), "rule STRING, controlled DOUBLE")


@pytest.fixture(scope="module")
def surface(spark):
    controlled = _controlled(spark, {"a": 4.0, "b": 3.0, "c": 2.0, "d": 1.0, "unknown": 9.0})
    return transfer.transfer_scores(_frame(spark), controlled, _parts(), ["model"], RULES, 40, 5)


def test_views(surface):
    rows = {(r["part"], r["member"]): r for r in transfer.transfer_views(*surface, RULES, 40).collect()}
    assert set(rows) == {("overall", ""), ("model", "m1"), ("model", "m2"), ("model", transfer.NO_VALUE),
                         *[("leave_one_out", r) for r in RULES]}
    overall = rows["overall", ""]
    assert overall["spearman_rho"] == -1.0 and overall["kendall_tau_b"] == -1.0
    assert overall["clusters"] == 12 and overall["valid_replicate_fraction"] == 1.0
    assert overall["probability_below_zero"] == 1.0 and overall["spearman_ucb95"] == -1.0
    least = sum(1 for p in permutations(range(4)) if sum(i * p[i] for i in range(4)) <= sum(i * (3 - i) for i in range(4)))
    assert overall["exact_p_value"] == least / 24 and overall["primary_support"] is True
    out = rows["leave_one_out", "b"]
    assert (out["n_rules"], out["spearman_rho"], out["exact_p_value"]) == (3, -1.0, 1 / 6)
    assert out["primary_support"] is None and out["clusters"] == 12
    silent = rows["model", "m2"]
    assert (silent["valid"], silent["reason"]) == (False, "missing_or_na_rule_scores")
    assert silent["exact_p_value"] is None and silent["valid_replicates"] == 0
    assert rows["model", transfer.NO_VALUE]["clusters"] == 1


def test_pairs(surface):
    rows = {(r["rule_a"], r["rule_b"]): r for r in transfer.transfer_pairs(*surface, 40).collect()}
    assert len(rows) == 6 and all(r["reversal"] and r["probability_of_reversal"] == 1.0 for r in rows.values())
    day = rows["b", "c"]
    assert day["observed_delta_lcb95"] == pytest.approx(-1 / 6) and day["observed_delta_ucb95"] == pytest.approx(-1 / 6)


def test_row_without_cluster_counts_in_the_score_alone(surface):
    point, drawn = surface
    score = point.filter("part = 'overall' AND rule = 'a'").first()["observed"]
    assert score == pytest.approx((12 + 1) / (72 + 1))
    assert drawn.filter("part = 'overall' AND rule = 'a'").agg(F.max("observed")).first()[0] == pytest.approx(1 / 6)


def test_tied_reference_is_undefined(spark):
    flat = _controlled(spark, {r: 1.0 for r in RULES})
    point, drawn = transfer.transfer_scores(_frame(spark), flat, _parts(), [], RULES, 5, 1)
    rows = transfer.transfer_views(point, drawn, RULES, 5).collect()
    assert {r["reason"] for r in rows} == {"controlled_ranking_constant_or_fully_tied"}
    assert all(r["primary_support"] is None for r in rows)
    assert {r["reason"] for r in transfer.transfer_pairs(point, drawn, 5).collect()} == {"pair_tied_n_a"}


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no event clusters"):
        transfer.transfer_scores(_frame(spark).limit(0), _controlled(spark, {"a": 1.0}), _parts(), ["model"], RULES, 5, 1)


def test_confirmatory_gate(spark):
    def gate(sources, checks=((True,),), access=(("VALID",),)):
        return ranks.confirmatory_gate(
            spark.createDataFrame(list(sources), "source STRING, test_clusters BIGINT, active_rules BIGINT, power_lcb95 DOUBLE"),
            spark.createDataFrame(list(checks), "passed BOOLEAN"),
            spark.createDataFrame(list(access), "status STRING"), per_source=10, combined=25,
        ).first().asDict()

    good = [("a", 12, 5, 0.9), ("b", 14, 4, 0.85)]
    assert gate(good)["classification"] == "confirmatory_eligible"
    assert gate(good, (), ())["classification"] == "confirmatory_eligible"
    for sources, extra, failing in (
        (good, {"checks": ((True,), (False,))}, {"point_in_time_checks"}),
        (good, {"access": (("VALID",), ("INVALID",))}, {"feature_access"}),
        ([("a", 9, 5, 0.9), ("b", 20, 4, 0.9)], {}, {"test_clusters_per_source"}),
        ([("a", 12, 5, 0.9), ("b", 12, 4, 0.9)], {}, {"test_clusters_combined"}),
        ([("a", 30, 3, 0.9)], {}, {"active_rule_configurations", "validation_power"}),
        ([("a", 30, 5, None)], {}, {"validation_power"}),
    ):
        row = gate(sources, **extra)
        assert {k for k, v in row.items() if v is False} == failing and row["classification"] == "exploratory_only"
    assert sum(v is False for v in gate([]).values()) == 4


def test_transfer_scores_join_lines_to_orders_once(spark, monkeypatch):
    """Regimes, decisions and the controlled ranking share one join, and what is read several
    times is a written table, not a plan over the rows."""
    from verdigate.plans import proxies, ranks as plan, tasks

    reads, joined = [], proxies.lines_with_orders
    monkeypatch.setattr(proxies, "lines_with_orders", lambda *a: reads.append(a) or joined(*a))
    monkeypatch.setattr(plan, "REPLICATES", 20)
    point, drawn = plan.transfer_scores(spark, "/root/testdata/sf0.001")
    assert point.count() and drawn.count() and len(reads) == 1
    ranking = plan.controlled_scores(spark, "/root/testdata/sf0.001")
    assert all("/table-" in f for f in ranking.inputFiles())
    regimes = tasks.with_regime(tasks.task_frame(spark, "/root/testdata/sf0.001"))
    assert any("/table-" in f for f in regimes.inputFiles())
