"""Registered queries against their SQL.  VERDIGATE_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from compare import check, duck

DIRECTORY = os.environ.get("VERDIGATE_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "R1_R8_core_rules", "R18_R21_public_grid_rules", "R10_R15_R17_provenance_rules",
    "R22_two_task_rules", "R25_feature_access_audit", "PRJ1_decision_outcomes", "PRJ5_lineage_labels",
    "PRJ6_lineage_serialisation", "A1_profile_metrics", "A3_laundering_breakdowns",
    "A5_A6_two_task_metrics", "A14_coverage_collapse", "A19_ambiguity_bound",
    "B1_cluster_bootstrap_bounds", "B5_moving_block_bootstrap", "ST1_ST2_rank_statistics",
    "J16_ST17_pareto_efficiency", "J8_asof_backward", "J9_asof_backward_strict",
    "W7_resample_and_volatility", "U5_hash_halves", "U8_one_row_per_cluster",
    "W8_chronological_split", "A25_dataset_fingerprint", "AU1_point_in_time_audit",
    "PRJ22_market_replay", "T5_quota_selection", "T1_calibration_selection",
    "AU8_proposal_validation", "PRJ9_public_projection", "J19_similar_bit_strings",
)
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("VERDIGATE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(DIRECTORY)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    verdict, *_ = check(spark, name, entry.queries()[name], ORACLES[name], DIRECTORY, con)
    assert verdict == "" or verdict.startswith("~"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
