"""Feature and outcome sides of a data set."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from verdigate.operators import sealing
from verdigate.operators.distributed import shared_folder

SEAL = sealing.Seal(["row_id"], ["outcome_", "exit_"], [("development", 2), ("paper_test", 2)], "hidden")
SCHEMA = ("row_id STRING, event_cluster_id STRING, decision_timestamp TIMESTAMP, feature DOUBLE, "
          "outcome_timestamp TIMESTAMP, exit_price DOUBLE")


def _rows(spark, days=6, per_day=3, **changed):
    rows = []
    for d in range(days):
        for i in range(per_day):
            at = dt.datetime(2024, 1, 1 + d, 10 + i)
            row = {"row_id": f"{d}-{i}", "event_cluster_id": f"c{d}", "decision_timestamp": at, "feature": float(i),
                   "outcome_timestamp": at + dt.timedelta(hours=1), "exit_price": d + i / 10}
            rows.append(tuple({**row, **(changed if (d, i) == (0, 0) else {})}.values()))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def path(spark):
    return f"{shared_folder(spark)}/sides-{uuid.uuid4().hex}"


def test_round_trip(spark, path):
    rows = _rows(spark)
    assert sealing.publish_sides(rows, path, SEAL) == {"development": 6, "paper_test": 6, "hidden": 6}
    features = sealing.read_side(spark, path, sealing.FEATURES, SEAL.splits)
    outcomes = sealing.read_side(spark, path, sealing.OUTCOMES, SEAL.splits)
    assert set(features.columns) & set(outcomes.columns) == {"row_id", "event_cluster_id", "split"}
    assert set(outcomes.columns) == {"row_id", "event_cluster_id", "split", "outcome_timestamp", "exit_price"}
    back = sealing.unseal(spark, path, SEAL, ["development", "paper_test"], ["exit_price"])
    want = rows.filter("event_cluster_id < 'c4'")
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, want.collect()))
    registry = {r["event_cluster_id"]: r["split"] for r in spark.read.parquet(f"{path}/{sealing.REGISTRY}").collect()}
    assert registry == {"c0": "development", "c1": "development", "c2": "paper_test", "c3": "paper_test",
                        "c4": "hidden", "c5": "hidden"}


def test_hidden_split_and_second_run_are_refused(spark, path):
    sealing.publish_sides(_rows(spark), path, SEAL)
    with pytest.raises(ValueError, match="may not be unsealed"):
        sealing.unseal(spark, path, SEAL, ["hidden"])
    with pytest.raises(Exception, match="(?i)exist"):
        sealing.publish_sides(_rows(spark), path, SEAL)


def test_missing_outcomes_and_repeated_keys(spark, path):
    sealing.publish_sides(_rows(spark, exit_price=None), path, SEAL)
    assert sealing.unseal(spark, path, SEAL, ["development"]).count() == 6
    with pytest.raises(ValueError, match="lack"):
        sealing.unseal(spark, path, SEAL, ["development"], ["exit_price"])
    other = path + "-repeated"
    sealing.publish_sides(_rows(spark, row_id="0-1"), other, SEAL)
    with pytest.raises(ValueError, match="not unique"):
        sealing.unseal(spark, other, SEAL, ["development"])


def test_row_without_cluster_and_wrong_columns(spark, path):
    with pytest.raises(Exception, match="no cluster"):
        sealing.publish_sides(_rows(spark, event_cluster_id=None), path, SEAL)
    with pytest.raises(ValueError, match="begins with"):
        sealing.two_sides(_rows(spark).drop("exit_price"), SEAL)
    with pytest.raises(ValueError, match="cannot be sealed"):
        sealing.two_sides(_rows(spark), sealing.Seal(["row_id"], ["row_"], SEAL.bounds, "hidden"))


def test_no_rows(spark, path):
    assert sealing.publish_sides(_rows(spark).limit(0), path, SEAL) == {"development": 0, "paper_test": 0, "hidden": 0}


@pytest.mark.parametrize("name", ["PL7_order_book_sides", "PL9_context_sides", "PL11_order_book_evaluation"])
def test_no_complete_day_gives_no_rows(spark, tmp_path, name):
    """Without a day whose bars are all there, the data sets are empty and so are the results."""
    import __spark_entry__ as entry

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("value", -F.abs("value")).write.parquet(str(tmp_path / "events.parquet"))
    assert entry.queries()[name](spark, str(tmp_path)).collect() == []
