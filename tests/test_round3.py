"""Empty order books, payloads parsed once, block sums added up within a task."""

import pandas as pd
from pyspark.sql import functions as F

from verdigate.operators import proposals, resample, structure


def test_an_order_book_without_rows_meets_the_checks_on_rows(spark):
    rows = spark.createDataFrame([], (
        "row_id string, event_cluster_id string, symbol string, prior_family string, split string, instrument_id int, "
        "source_timestamp timestamp, decision_timestamp timestamp, action_timestamp timestamp, outcome_timestamp timestamp, "
        "depth_snapshot_age_seconds double"
    ))
    sealed = spark.createDataFrame([], "row_id string, outcome_depth_snapshot_age_seconds double")
    audit = structure.order_book_audit(
        rows, sealed, 36, ("S0", "S1"), ["a", "b"], 60.0, {"development": 20}, 0.0, (0.0, 1.0), (0.0, 1.0)
    )
    passed = {r["check"]: r["passed"] for r in audit.collect()}
    assert {c for c, ok in passed.items() if not ok} == {"development_clusters"}


def test_payloads_are_unpacked_once(spark):
    payloads = spark.createDataFrame(
        [("b", "p1", '{"proposals": []}'), ("c", "p1", "not json"), ("d", "p1", '{"other": 1}')], "batch_id string, part string, payload string"
    )
    asked = spark.createDataFrame([(b, b + "1", "directional_execution") for b in "bcde"], "batch_id string, context_id string, task_id string")
    checked = proposals.validate_proposals(payloads, asked, sequence="part")
    reasons = {r.batch_id: r.malformed_reason for r in checked.collect()}
    assert reasons == {
        "b": "missing_context_placeholder", "c": "unparseable_provider_response", "d": "missing_context_placeholder",
        "e": "unparseable_provider_response",
    }
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_blocks_of_a_task_are_added_up_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", 16)
    handed = []
    added = resample._added_up
    monkeypatch.setattr(resample, "_added_up", lambda parts, *a: handed.append(parts.count()) or added(parts, *a))
    made = pd.DataFrame({"s": ["y" if i % 2 else "x" for i in range(400)], "k": range(400), "one": 1.0, "v": [float(i % 7) for i in range(400)]})
    clusters = spark.createDataFrame(made, "s string, k long, one double, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = resample.resampled_sums(clusters, "k", ["one", "v"], 10, 3, ["s"], "blocks").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    # Two tasks and strata at most, not one part for each of 13 blocks.
    assert handed[0] <= 2 * 2 * 10
    assert len(rows) == 20 and (rows.one == 200).all() and rows.v.between(400, 800).all()


def test_points_of_a_replay_are_made_once(spark):
    from verdigate.plans import markets

    files = markets.replay(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/table-" in f for f in files)
