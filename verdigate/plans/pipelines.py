"""Composite audits that assemble the operators end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import calibration as C
from verdigate.operators import certify, labels, metrics, ranks, resample, rules
from verdigate.operators import structure as X
from verdigate.operators.distributed import materialize, rank_min, shared_folder
from verdigate.operators.text import jensen_shannon_drift
from verdigate.plans import sql_rules as S
from verdigate.plans.calibration import FOLD_SQL, selection
from verdigate.plans.coverage import COLLAPSE_CTES, PUBLIC_GRID, PUBLIC_SQL, WITH_D, core_decisions
from verdigate.plans.inference import (
    CORE_NAMES, MEASURES, PAIR, PAIR_SQL, POLICY_SQL, REPLICATES, SEED, SURFACE_SQL, bounds_of_dp, core_bounds,
    draws_sql, pair_tests_sql, surface_of_bounds,
)
from verdigate.plans.markets import REPLAY_SQL, STRESS_SQL, UTILITY_SQL, replay
from verdigate.plans.provenance import (
    LAUNDERING_DOUBLES, LAUNDERING_FIELDS, WITH_L, provenance_decisions,
)
from verdigate.plans.proxies import DECISION_SQL, PROVENANCE_SQL, decision_view, provenance_view
from verdigate.plans.registry import query
from verdigate.plans.structure import DESTINATIONS, test_clusters
from verdigate.plans.tasks import task_decisions, task_frame
from verdigate.plans.texts import TEXT_SQL, signals
from verdigate.plans.timeseries import (
    BOOK_FULL_SQL, BOOK_GROSS_SQL, BOOK_REDUCED_SQL, BOOK_STRESS_SQL, PRIOR_ROWS_SQL, prior_rows,
)
from verdigate.sources.sinks import publish_partitions


@query(
    "PL1_coverage_audit",
    f"""{SURFACE_SQL}, {COLLAPSE_CTES}
    SELECT rule, coverage, far, alr, cau, worst_profile_certification_volume, stress_coverage_ratio,
      coverage_relation, rank() OVER (ORDER BY far NULLS LAST) AS raw_far_rank,
      rank() OVER (ORDER BY cau DESC) AS raw_cau_rank,
      rank() OVER (ORDER BY worst_profile_certification_volume DESC) AS certified_rank
    FROM m JOIN cert USING (rule) JOIN collapse2 USING (rule) WHERE profile = 'overall'""",
    ("coverage", "far", "alr", "cau", "worst_profile_certification_volume", "stress_coverage_ratio"),
)
def coverage_audit(spark, directory):
    """Raw against certified ranking of all core rules.

    Cluster sums are the only large intermediate; metrics, bounds, surface and ranks
    are result-sized.
    """
    m = metrics.profile_metrics(
        core_decisions(spark, directory), labels.certification_profiles(), tail=False
    )
    scored = core_bounds(spark, directory).filter(F.col("profile").isin("overall", "stress"))
    certified = certify.worst_profile_volume(
        certify.certification_volume(certify.certification_surface(scored))
    )
    ranking = (
        m.filter(F.col("profile") == "overall")
        .join(certified, "rule").join(metrics.coverage_collapse(m), "rule")
    )
    return ranking.select(
        "rule", "coverage", "far", "alr", "cau", "worst_profile_certification_volume",
        "stress_coverage_ratio", "coverage_relation",
        rank_min("far", missing="bottom").cast("bigint").alias("raw_far_rank"),
        rank_min("cau", descending=True).cast("bigint").alias("raw_cau_rank"),
        rank_min("worst_profile_certification_volume", descending=True).cast("bigint").alias(
            "certified_rank"
        ),
    )


def one_profile_bounds(ruled: DataFrame, names: list[str], replicates: int = REPLICATES) -> DataFrame:
    sums = metrics.cluster_sums(ruled.withColumn("profile", F.lit("overall")))
    return resample.cluster_bootstrap_bounds(sums, names, replicates, SEED)


PL2_FIELDS = (*LAUNDERING_DOUBLES, "coverage_lcb95", "far_ucb95", "alr_ucb95")


@query(
    "PL2_provenance_audit",
    f"""{WITH_L}, cs AS (
      SELECT rule, event_cluster_id, count(*) AS rows, count(*) FILTER (WHERE authorized) AS au,
        count(*) FILTER (WHERE selected_harm) AS ha, count(*) FILTER (WHERE selected_laundering) AS la
      FROM l GROUP BY 1, 2),
    cl AS (SELECT event_cluster_id, row_number() OVER (
        ORDER BY md5(CAST(event_cluster_id AS VARCHAR)), event_cluster_id) - 1 AS position
      FROM (SELECT DISTINCT event_cluster_id FROM cs)),
    sz AS (SELECT 0 AS g, count(*) AS n FROM cl), {draws_sql("sz", "g")},
    w AS (SELECT n, replicate, position, count(*) AS w FROM draws GROUP BY 1, 2, 3),
    bs AS (SELECT rule, n, replicate, sum(w * rows) * 1.0e0 AS r, sum(w * au) * 1.0e0 AS au,
        sum(w * ha) * 1.0e0 AS ha, sum(w * la) * 1.0e0 AS la
      FROM w JOIN cl USING (position) JOIN cs USING (event_cluster_id) GROUP BY 1, 2, 3),
    b AS (SELECT rule, n AS clusters, quantile_cont(au / r, 0.05) AS coverage_lcb95,
        quantile_cont(CASE WHEN au > 0 THEN ha / au END, 0.95) AS far_ucb95,
        quantile_cont(CASE WHEN au > 0 THEN la / au END, 0.95) AS alr_ucb95 FROM bs GROUP BY 1, 2),
    lm AS (SELECT rule, {LAUNDERING_FIELDS} FROM l GROUP BY rule)
    SELECT * FROM lm JOIN b USING (rule)""",
    PL2_FIELDS,
)
def provenance_audit(spark, directory):
    """Laundering metrics and bootstrap bounds per provenance rule."""
    d = provenance_decisions(spark, directory)
    bounds = one_profile_bounds(d, [r.name for r in rules.provenance_rules()])
    return metrics.laundering_metrics(d, ["rule"]).join(
        bounds.select("rule", "clusters", "coverage_lcb95", "far_ucb95", "alr_ucb95"), "rule"
    )


def _rho_sql(source: str, keys: str) -> str:
    """Spearman of x and y over complete rows of `source`, per key."""
    return f"""rk AS (
      SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x)
          + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0e0 AS rx,
        rank() OVER (PARTITION BY {keys} ORDER BY y)
          + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0e0 AS ry
      FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
    rho AS (
      SELECT {keys}, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END
          AS spearman_rho,
        CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN 'defined'
          ELSE 'constant_rank' END AS status
      FROM rk GROUP BY {keys})"""


#: All rows of d, and those under stress, as profiles.
STRESSED_SQL = """dp AS (SELECT *, 'overall' AS profile FROM d
  UNION ALL SELECT *, 'stress' FROM d WHERE stress_tag <> 'ordinary')"""


@query(
    "PL3_public_replay",
    f"""WITH {REPLAY_SQL}, v AS (
      SELECT event_cluster_id, 'edge_proposer' AS source_role, TRUE AS original_source_eligible,
        greatest(prior, 1.0e0 - prior) AS confidence, sigma AS uncertainty, sigma AS volatility_proxy,
        abs(prior - 0.5e0) * 20000.0e0 AS expected_edge_bps, med * 10000.0e0 AS liquidity_cost_bps,
        0.0e0 AS turnover_cost_bps, fee_rate * prior * (1.0e0 - prior) * 10000.0e0 AS fee_bps,
        {UTILITY_SQL} AS full_utility, 0.5e0 * ({UTILITY_SQL}) AS reduced_utility,
        greatest(1, round_even((closed_at - decided) / 3600.0e0, 0)) AS horizon,
        {STRESS_SQL} AS stress_tag
      FROM rp WHERE reason IS NULL),
    {S.outcomes(PUBLIC_SQL, "v")}, {STRESSED_SQL}, {bounds_of_dp()}, {surface_of_bounds()},
    pm AS ({S.profile_metrics(tail=False)})
    SELECT rule, rows, coverage, far, cau, overall, stress, worst_profile_certification_volume
    FROM pm JOIN cert USING (rule) WHERE profile = 'overall'""",
    ("coverage", "far", "cau", "overall", "stress", "worst_profile_certification_volume"),
)
def public_replay(spark, directory):
    """Grid rules over kept market replay rows: metrics, bounds and volumes."""
    registry = rules.grid_rules(PUBLIC_GRID)
    outcome = ("event_cluster_id", "original_source_eligible", "full_utility", "reduced_utility", "stress_tag")
    read = dict.fromkeys([*outcome, *(f for r in registry for f in r.features)])
    kept = materialize(
        replay(spark, directory).filter(F.col("reason").isNull()).withColumns(
            {"source_role": F.lit("edge_proposer"), "original_source_eligible": F.lit(True)}
        ).select(*read)
    )
    d = labels.decision_outcomes(rules.decide(kept, registry))
    m = metrics.profile_metrics(d, labels.stress_profiles(), tail=False)
    sums, layout = metrics.wide_cluster_sums(kept, registry, labels.stress_profiles())
    bounds = resample.wide_bootstrap_bounds(sums, layout, REPLICATES, SEED)
    volume = certify.worst_profile_volume(
        certify.certification_volume(certify.certification_surface(bounds))
    )
    return m.filter(F.col("profile") == "overall").select("rule", "rows", "coverage", "far", "cau").join(
        volume, "rule"
    )


@query(
    "PL4_generator_robustness",
    f"""{WITH_D}, dq AS (SELECT *, symbol AS generator_family FROM d WHERE certification_eligible),
    dp AS (SELECT *, 'overall' AS profile FROM dq
      UNION ALL SELECT *, 'stress' FROM dq WHERE opportunity_slice <> 'ordinary'),
    {bounds_of_dp("generator_family, profile")}, {surface_of_bounds("generator_family")},
    m AS ({S.profile_metrics("dq", "generator_family, rule", tail=False)}),
    ranked AS (
      SELECT generator_family, rule,
        rank() OVER (PARTITION BY generator_family ORDER BY far NULLS LAST) * 1.0e0 AS raw_far_rank,
        rank() OVER (PARTITION BY generator_family
          ORDER BY worst_profile_certification_volume DESC) * 1.0e0 AS certification_rank
      FROM m JOIN cert USING (generator_family, rule)),
    xy AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS metric, rule, max({c}) FILTER (WHERE generator_family = 'F') AS x, "
        f"max({c}) FILTER (WHERE generator_family = 'O') AS y FROM ranked GROUP BY 2"
        for c in ("raw_far_rank", "certification_rank"))}), {_rho_sql("xy", "metric")}
    SELECT * FROM rho""",
    ("spearman_rho",),
)
def generator_robustness(spark, directory):
    """Certification per family and the agreement of the two families' rankings."""
    d = core_decisions(spark, directory).withColumn("generator_family", F.col("symbol"))
    keys = ["generator_family", "rule"]
    m = metrics.profile_metrics(
        d, {"overall": F.col("certification_eligible")}, keys, tail=False
    ).drop("profile")
    profiled = labels.explode_profiles(
        d, {k: v for k, v in labels.certification_profiles().items() if k != "ordinary"}
    )
    strata = ["generator_family", "profile"]
    bounds = resample.cluster_bootstrap_bounds(
        metrics.cluster_sums(profiled, ["rule", *strata]), CORE_NAMES, REPLICATES, SEED, strata
    )
    volumes = certify.certification_volume(
        certify.certification_surface(bounds, [*keys, "profile"]), [*keys, "profile"]
    )
    summary = m.join(certify.worst_profile_volume(volumes, keys), keys)
    ranked = summary.select(
        *keys, rank_min("far", ["generator_family"], missing="bottom").cast("double").alias("raw_far_rank"),
        rank_min("worst_profile_certification_volume", ["generator_family"], descending=True)
        .cast("double").alias("certification_rank"),
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).alias("rank"))
          for c in ("raw_far_rank", "certification_rank")]
    )

    def of(family: str) -> F.Column:
        return F.max(F.when(F.col("generator_family") == family, F.col("rank")))

    wide = ranked.select(*keys, F.inline(cells)).groupBy("metric", "rule").agg(
        of("F").alias("x"), of("O").alias("y")
    )
    return ranks.spearman(wide, ["metric"], "x", "y")


@query(
    "PL5_baseline_governance",
    f"""WITH {DECISION_SQL}, {S.outcomes({**S.ABLATIONS, **S.COMPOSITIONS}, "v")},
    dp AS (SELECT *, 'overall' AS profile FROM d WHERE certification_eligible),
    {bounds_of_dp()}, {surface_of_bounds()}, m AS ({S.profile_metrics(tail=False)})
    SELECT rule, coverage, far, alr, review_rate, cau, certification_volume
    FROM m JOIN vol USING (rule, profile)""",
    ("coverage", "far", "alr", "review_rate", "cau", "certification_volume"),
)
def baseline_governance(spark, directory):
    """Ablations and compositions after the registered checklist was reproduced."""
    v = decision_view(spark, directory)
    registry = [*rules.lifecycle_ablations(), *rules.role_compositions()]
    rebuilt = registry[0].build(rules.EXAMPLE_THRESHOLDS)
    registered = rules.core_rules()[-1].build(rules.EXAMPLE_THRESHOLDS)
    if not v.filter(rebuilt != registered).isEmpty():
        raise ValueError("the rebuilt checklist differs from the registered one")
    d = labels.decision_outcomes(rules.decide(v, registry))
    m = metrics.profile_metrics(d, {"overall": F.col("certification_eligible")}, tail=False)
    bounds = one_profile_bounds(d.filter("certification_eligible"), [r.name for r in registry])
    volume = certify.certification_volume(certify.certification_surface(bounds))
    return m.select("rule", "coverage", "far", "alr", "review_rate", "cau").join(
        volume.drop("profile"), "rule"
    )


SPLIT_METRICS = f"""{WITH_D}, sm AS (
  SELECT rule, split, avg(CAST(authorized AS DOUBLE)) AS coverage,
    avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS far,
    avg(CASE WHEN authorized THEN CAST(selected_laundering AS DOUBLE) END) AS alr,
    coalesce(sum(selected_utility) FILTER (WHERE authorized), 0.0e0) AS cau
  FROM d WHERE certification_eligible GROUP BY 1, 2)"""


@query(
    "PL6_PL22_validation_to_test_stability",
    f"""{SPLIT_METRICS}, xy AS ({" UNION ALL ".join(
        f"SELECT '{m}' AS metric, rule, max({m}) FILTER (WHERE split = 'validation') AS x, "
        f"max({m}) FILTER (WHERE split = 'test') AS y FROM sm GROUP BY 2"
        for m in ("far", "cau", "coverage"))}), {_rho_sql("xy", "metric")}
    SELECT * FROM rho""",
    ("spearman_rho",),
)
def validation_to_test_stability(spark, directory):
    """Rank agreement of harm and utility between the validation and test splits."""
    m = metrics.profile_metrics(
        core_decisions(spark, directory), {"overall": F.col("certification_eligible")},
        ["rule", "split"], tail=False,
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("far", "cau", "coverage")]
    )

    def of(split: str) -> F.Column:
        return F.max(F.when(F.col("split") == split, F.col("v")))

    wide = m.select("rule", "split", F.inline(cells)).groupBy("metric", "rule").agg(
        of("validation").alias("x"), of("test").alias("y")
    )
    return ranks.spearman(wide, ["metric"], "x", "y")


BOUNDS = ("coverage_lcb95", "far_ucb95", "alr_ucb95")


def book_decisions(spark: SparkSession, directory: str) -> DataFrame:
    rows = labels.order_book_outcomes(prior_rows(spark, directory), with_impact=True)
    return materialize(labels.decision_outcomes(rules.decide(rows, rules.core_rules())).select(
        "rule", "decision", "event_cluster_id", "prior_family", "stress_tag", "authorized",
        "selected_harm", "selected_laundering", "selected_utility", "missed_opportunity",
    ))


_ROLES_SQL = " ".join(
    f"WHEN '{family}' THEN '{role}'" for family, (role, _) in labels.PRIOR_ROLES.items()
)
_ELIGIBLE_SQL = ", ".join(f"'{family}'" for family, (_, kept) in labels.PRIOR_ROLES.items() if kept)
BOOK_DECISIONS_SQL = f"""v AS (
  WITH {PRIOR_ROWS_SQL}, g AS (SELECT *, {BOOK_GROSS_SQL} AS gross FROM pr)
  SELECT 'book-' || strftime(day, '%Y-%m-%d') AS event_cluster_id, prior_family,
    CASE prior_family {_ROLES_SQL} END AS source_role,
    prior_family IN ({_ELIGIBLE_SQL}) AS original_source_eligible,
    confidence, uncertainty, vp AS volatility_proxy, expected_edge_bps, liquidity_cost_bps,
    0.0e0 AS turnover_cost_bps, 8.0e0 AS fee_bps, {BOOK_FULL_SQL} AS full_utility,
    {BOOK_REDUCED_SQL} AS reduced_utility, {BOOK_STRESS_SQL} AS stress_tag FROM g),
{S.outcomes(S.CORE, "v")}"""


@query(
    "PL11_order_book_evaluation",
    f"""WITH {BOOK_DECISIONS_SQL}, {STRESSED_SQL}, {bounds_of_dp()},
    pm AS ({S.profile_metrics(tail=False)})
    SELECT rule, profile, pm.rows, coverage, far, alr, cau, coverage_lcb95, far_ucb95, alr_ucb95
    FROM pm JOIN bounds USING (rule, profile)""",
    ("coverage", "far", "alr", "cau", "coverage_lcb95", "far_ucb95", "alr_ucb95"),
)
def order_book_evaluation(spark, directory):
    """Profile metrics of the core rules on order-book rows with cluster bounds."""
    d = book_decisions(spark, directory)
    m = metrics.profile_metrics(d, labels.stress_profiles(), tail=False)
    if d.isEmpty():
        # No day is complete: nothing is rated, and nothing can be drawn.
        bounds = m.select("rule", "profile", *[F.lit(None).cast("double").alias(c) for c in BOUNDS])
    else:
        sums = metrics.cluster_sums(labels.explode_profiles(d, labels.stress_profiles()))
        bounds = resample.cluster_bootstrap_bounds(sums, CORE_NAMES, REPLICATES, SEED)
    return m.join(bounds, ["rule", "profile"]).select(
        "rule", "profile", "rows", "coverage", "far", "alr", "cau", "coverage_lcb95", "far_ucb95",
        "alr_ucb95",
    )


BOOK_PAIR_SQL = (
    PAIR_SQL.replace(WITH_D, f"WITH {BOOK_DECISIONS_SQL}")
    .replace("SELECT event_cluster_id,", "SELECT prior_family, event_cluster_id,", 1)
    .replace("FROM d GROUP BY 1)", "FROM d GROUP BY 1, 2)", 1)
)


@query(
    "PL11_order_book_families",
    f"{pair_tests_sql(BOOK_PAIR_SQL, 'prior_family', 'metric')} SELECT * FROM hm",
    ("mean_difference", "standard_deviation", "raw_p", "holm_threshold", "holm_adjusted_p"),
)
def order_book_families(spark, directory):
    """Paired differences per prior family with Holm-adjusted tests."""
    d = book_decisions(spark, directory)
    wide = metrics.paired_burdens(d, *PAIR, groups=["prior_family"])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in MEASURES])
    tests = ranks.t_test(
        wide.select("prior_family", F.inline(cells)), "v", ["prior_family", "metric"]
    )
    return ranks.holm(tests.withColumn("name", F.concat_ws(":", "prior_family", "metric")))


_CHOSEN = "(SELECT CAST(split_part(selected_parameters, '=', 2) AS DOUBLE) FROM sel WHERE rule = '{}' AND calibration_valid)"


def _recalibrated_rules() -> dict[str, str]:
    """The two-task rules in SQL with chosen thresholds where calibration has found some."""
    own = {
        "Confidence Gate": f"confidence >= coalesce({_CHOSEN.format('Confidence Gate')}, 0.6e0)",
        "Cost-Aware Gate": f"expected_edge_bps > {S.COST} + coalesce({_CHOSEN.format('Cost-Aware Gate')}, 5.0e0)",
        "Uncertainty Gate": f"uncertainty <= coalesce({_CHOSEN.format('Uncertainty Gate')}, 0.4e0)",
    }
    acting = {r: f"CASE WHEN candidate_action = 0 THEN 'abstain' ELSE {S.gate(test)} END" for r, test in own.items()}
    return {**S.TWO_TASK, **acting}


RECALIBRATED_SQL = f"""{FOLD_SQL.replace("td0 AS", "cd0 AS").replace("FROM td0", "FROM cd0").replace(
    "td1 AS", "cd1 AS").replace("FROM td1", "FROM cd1").replace("td AS (", "cd AS (").replace(
    "FROM td GROUP", "FROM cd GROUP")}, {S.task_outcomes(S.TWO_TASK)},
    rd0 AS (SELECT * REPLACE (CASE WHEN rule IN (SELECT rule FROM sel WHERE NOT calibration_valid)
        THEN 'not_evaluated' ELSE decision END AS decision) FROM ({S.ruled(_recalibrated_rules(), "t")})),
    rd1 AS (SELECT *, {S.TASK_SELECTED} FROM rd0), rd AS (SELECT *, {S.TASK_SELECTED_2} FROM rd1)"""


@query(
    "PL12_two_track_evaluation",
    f"""WITH {RECALIBRATED_SQL},
    tp AS (SELECT *, 'overall' AS profile FROM td UNION ALL SELECT *, task_id FROM td),
    rp AS (SELECT *, 'overall' AS profile FROM rd UNION ALL SELECT *, task_id FROM rd),
    zm AS ({S.task_metrics("tp", "rule, profile")}), rm AS ({S.task_metrics("rp", "rule, profile")}),
    rs AS (SELECT rm.*, coalesce(calibration_valid, TRUE) AS ok,
        coalesce(calibration_status, 'FIXED_FORM_NOT_RECALIBRATED') AS st FROM rm LEFT JOIN sel USING (rule))
    SELECT *, TRUE AS calibration_valid, 'ZERO_SHOT' AS calibration_status,
      CAST(NULL AS VARCHAR) AS structural_n_a_reason, 'zero_shot' AS track FROM zm
    UNION ALL BY NAME
    SELECT rule, profile, rows, {", ".join(
        f"CASE WHEN ok THEN {c} END AS {c}" for c in (
            "clusters", *S.TASK_DOUBLES, "authorized_count", "directional_authorized_count",
            "risk_authorized_count", "benign_opportunity_count"))},
      ok AS calibration_valid, st AS calibration_status,
      CASE WHEN NOT ok THEN st END AS structural_n_a_reason, 'recalibrated' AS track FROM rs""",
    S.TASK_DOUBLES,
)
def two_track_evaluation(spark, directory):
    """Zero-shot metrics next to those of decisions taken anew under the calibrated
    thresholds, N/A where calibration failed."""
    profiled = labels.explode_profiles(task_decisions(spark, directory), labels.task_profiles())
    zero = metrics.task_metrics(profiled, ["rule", "profile"])
    status = materialize(selection(spark, directory))
    anew = C.recalibrated_decisions(task_frame(spark, directory), rules.two_task_rules(), status)
    anew = metrics.task_metrics(labels.explode_profiles(anew, labels.task_profiles()), ["rule", "profile"])
    masked = C.mask_uncalibrated(anew, status, ["profile", "rows"])
    extra = {"calibration_valid": F.lit(True), "calibration_status": F.lit("ZERO_SHOT"),
             "structural_n_a_reason": F.lit(None).cast("string")}
    return zero.withColumns(extra).withColumn("track", F.lit("zero_shot")).unionByName(
        masked.withColumn("track", F.lit("recalibrated"))
    )


SUBGROUPS = ("model_id", "symbol", "task_id")


@query(
    "ST21_recalibrated_subgroups",
    f"""WITH {RECALIBRATED_SQL},
    rg AS (SELECT *, 'model_id' AS dimension, model_id AS value FROM rd UNION ALL
      SELECT *, 'symbol', symbol FROM rd UNION ALL SELECT *, 'task_id', task_id FROM rd),
    gm AS (SELECT rule, dimension, value, count(*) AS rows, avg(CAST(authorized AS DOUBLE)) AS coverage,
      count(*) FILTER (WHERE authorized) AS authorized_count,
      count(*) FILTER (WHERE decision = 'not_evaluated') AS skipped FROM rg GROUP BY 1, 2, 3)
    SELECT rule, dimension, value, rows, CASE WHEN coalesce(calibration_valid, TRUE) THEN coverage END AS coverage,
      CASE WHEN coalesce(calibration_valid, TRUE) THEN authorized_count END AS authorized_count,
      CASE WHEN NOT coalesce(calibration_valid, TRUE) THEN skipped ELSE 0 END AS not_evaluated_rows,
      coalesce(calibration_valid, TRUE) AS calibration_valid,
      coalesce(calibration_status, 'FIXED_FORM_NOT_RECALIBRATED') AS calibration_status,
      CASE WHEN NOT calibration_valid THEN calibration_status END AS structural_n_a_reason
    FROM gm LEFT JOIN sel USING (rule)""",
    ("coverage",),
)
def recalibrated_subgroups(spark, directory):
    """Recalibrated decisions by subgroup; the groups of rules without a calibration are N/A."""
    status = materialize(selection(spark, directory))
    ruled = C.recalibrated_decisions(task_frame(spark, directory), rules.two_task_rules(), status)
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in SUBGROUPS])
    grouped = ruled.select("rule", "decision", "authorized", F.inline(cells)).groupBy("rule", "dimension", "value").agg(
        F.count("*").alias("rows"), F.avg(F.col("authorized").cast("double")).alias("coverage"),
        F.count_if("authorized").alias("authorized_count"),
        F.count_if(F.col("decision") == "not_evaluated").alias("not_evaluated_rows"),
    )
    return C.mask_uncalibrated(grouped, status, ["dimension", "value", "rows", "not_evaluated_rows"])


@query(
    "PL13_memory_drift",
    f"""WITH {TEXT_SQL}, b AS (
      SELECT model_id, task_id, min(calendar_quarter) AS first_period, max(calendar_quarter) AS last_period
      FROM ps GROUP BY 1, 2 HAVING min(calendar_quarter) <> max(calendar_quarter)),
    e AS (SELECT *, calendar_quarter = first_period AS f, calendar_quarter = last_period AS l
      FROM ps JOIN b USING (model_id, task_id)),
    a AS (SELECT model_id, task_id, action, count(*) FILTER (WHERE f) AS nf, count(*) FILTER (WHERE l) AS nl
      FROM e WHERE f OR l GROUP BY 1, 2, 3),
    q AS (SELECT *, nf * 1.0e0 / sum(nf) OVER w AS p, nl * 1.0e0 / sum(nl) OVER w AS r FROM a
      WINDOW w AS (PARTITION BY model_id, task_id)),
    js AS (SELECT model_id, task_id, CAST(sum(nf) AS BIGINT) AS first_proposals,
        CAST(sum(nl) AS BIGINT) AS last_proposals,
        0.5e0 * sum(CASE WHEN p > 0 THEN p * log2(p / (0.5e0 * (p + r))) ELSE 0 END)
        + 0.5e0 * sum(CASE WHEN r > 0 THEN r * log2(r / (0.5e0 * (p + r))) ELSE 0 END)
          AS action_distribution_jensen_shannon_bits FROM q GROUP BY 1, 2),
    sh AS (SELECT model_id, task_id, {", ".join(
        f"avg({c}) FILTER (WHERE l) - avg({c}) FILTER (WHERE f) AS {n}_difference_last_minus_first"
        for n, c in (("active", "CAST(active AS DOUBLE)"), ("confidence", "confidence"),
                     ("uncertainty", "uncertainty")))} FROM e GROUP BY 1, 2)
    SELECT * FROM b JOIN js USING (model_id, task_id) JOIN sh USING (model_id, task_id)""",
    ("action_distribution_jensen_shannon_bits", "active_difference_last_minus_first",
     "confidence_difference_last_minus_first", "uncertainty_difference_last_minus_first"),
)
def memory_drift(spark, directory):
    """First against last quarter per model and task."""
    s = signals(spark, directory).withColumn("active", F.col("active_proposal").cast("double"))
    return jensen_shannon_drift(
        s, ["model_id", "task_id"], "calendar_quarter", "action",
        ["active", "confidence", "uncertainty"],
    )


def _load_sql(cte: str, layer: str) -> str:
    return (
        f"SELECT '{layer}' AS layer, rule, avg(CAST(decision = 'review' AS DOUBLE)) AS review_rate, "
        f"count(*) AS n FROM {cte} GROUP BY 2"
    )


PROV_ROUTES = f"SELECT rule, decision FROM ({S.ruled(S.PROVENANCE, 'p')})"


@query(
    "PL16_review_workload_layers",
    f"""WITH {PROVENANCE_SQL}, {S.outcomes(S.CORE, 'v')}, pd AS ({PROV_ROUTES}),
    w AS ({_load_sql("d", "controlled")} UNION ALL {_load_sql("pd", "provenance")}),
    g AS (SELECT unnest([0.05e0, 0.1e0, 0.2e0, 0.4e0]) AS capacity_fraction)
    SELECT layer, rule, review_rate, capacity_fraction,
      greatest(review_rate - capacity_fraction, 0.0e0) AS excess_review_fraction,
      CAST(ceil(greatest(review_rate - capacity_fraction, 0.0e0) * n) AS BIGINT) AS queue_rows
    FROM w, g""",
    ("review_rate", "capacity_fraction", "excess_review_fraction"),
)
def review_workload_layers(spark, directory):
    """Review load of the controlled and the provenance layer."""
    core = metrics.review_workload(core_decisions(spark, directory), ["rule"])
    prov = metrics.review_workload(provenance_decisions(spark, directory), ["rule"])
    both = core.withColumn("layer", F.lit("controlled")).unionByName(
        prov.withColumn("layer", F.lit("provenance"))
    )
    return metrics.capacity_overload(both).select(
        "layer", "rule", "review_rate", "capacity_fraction", "excess_review_fraction", "queue_rows"
    )


@query(
    "PL17_certification_robustness",
    f"""{POLICY_SQL}, hv AS (
      SELECT rule, profile, coalesce(least(greatest(1.0e0 - far_ucb95, 0), 1)
        * least(greatest((0.25e0 - alr_ucb95) / 0.25e0, 0), 1)
        * least(greatest(coverage_lcb95, 0), 1), 0.0e0) AS hv FROM bounds),
    h AS (SELECT rule, max(hv) FILTER (WHERE profile = 'overall') AS overall,
        max(hv) FILTER (WHERE profile = 'stress') AS stress,
        min(hv) FILTER (WHERE profile <> 'ordinary') AS worst_profile_hypervolume FROM hv GROUP BY 1),
    pm AS (SELECT * FROM ({S.profile_metrics(tail=False)}) WHERE profile = 'overall'),
    ef AS (SELECT a.rule, a.far IS NOT NULL AND a.alr IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM pm b WHERE b.rule <> a.rule AND b.coverage >= a.coverage AND b.far <= a.far
          AND b.alr <= a.alr AND b.moc <= a.moc AND (b.coverage > a.coverage OR b.far < a.far
          OR b.alr < a.alr OR b.moc < a.moc)) AS pareto_efficient FROM pm a),
    po AS (SELECT rule, avg(worst_profile_volume) AS mean_volume, min(worst_profile_volume) AS min_volume,
        max(worst_profile_volume) AS max_volume, min(rank) AS min_rank, max(rank) AS max_rank,
        max(rank) - min(rank) AS rank_range FROM pv GROUP BY 1)
    SELECT * FROM po JOIN h USING (rule) JOIN ef USING (rule)""",
    ("mean_volume", "min_volume", "max_volume", "overall", "stress", "worst_profile_hypervolume"),
)
def certification_robustness(spark, directory):
    """Policy volumes, hypervolume and frontier membership per rule."""
    bounds = materialize(core_bounds(spark, directory))
    policies = certify.policy_summary(certify.policy_volumes(bounds))
    m = metrics.profile_metrics(
        core_decisions(spark, directory), {"overall": F.col("certification_eligible")}, tail=False
    )
    frontier = certify.pareto_flags(m, ["rule"]).select("rule", "pareto_efficient")
    return policies.join(certify.hypervolume(bounds), "rule").join(frontier, "rule")


_DELTA = ("coverage", "far", "alr", "cau")


@query(
    "PL19_scale_stability",
    f"""{SPLIT_METRICS}, wm AS (
      SELECT rule, avg(CAST(authorized AS DOUBLE)) AS coverage,
        avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS far,
        avg(CASE WHEN authorized THEN CAST(selected_laundering AS DOUBLE) END) AS alr,
        coalesce(sum(selected_utility) FILTER (WHERE authorized), 0.0e0) AS cau
      FROM d WHERE certification_eligible GROUP BY 1),
    j AS (SELECT a.rule, {", ".join(f"a.{m} AS {m}_left, b.{m} AS {m}_right, b.{m} - a.{m} AS {m}_delta" for m in _DELTA)}
      FROM sm a JOIN wm b ON a.rule = b.rule WHERE a.split = 'train'),
    xy AS (SELECT 1 AS g, far_left AS x, far_right AS y FROM j), {_rho_sql("xy", "g")}
    SELECT j.*, spearman_rho, status FROM j, rho""",
    tuple(f"{m}_{s}" for m in _DELTA for s in ("left", "right", "delta")) + ("spearman_rho",),
)
def scale_stability(spark, directory):
    """Rule metrics of the training part against all rows: deltas and rank agreement."""
    d = core_decisions(spark, directory)
    whole = metrics.profile_metrics(d, {"overall": F.col("certification_eligible")}, tail=False)
    part = metrics.profile_metrics(
        d, {"overall": F.col("certification_eligible") & (F.col("split") == "train")}, tail=False
    )
    deltas = metrics.metric_deltas(part, whole, ["coverage", "far", "alr", "cau"])
    rho = ranks.spearman(deltas, [], "far_left", "far_right")
    return deltas.withColumn("_k", F.lit(1)).join(rho.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(
    "PL20_test_partition",
    f"""WITH {DECISION_SQL}, c AS (SELECT DISTINCT event_cluster_id AS id FROM v WHERE split = 'test'),
    k AS (SELECT *, row_number() OVER (ORDER BY sha256('decision-audit|' || id)) AS rn,
      count(*) OVER () AS n FROM c)
    SELECT CASE WHEN split <> 'test' THEN split WHEN rn <= n // 2 THEN 'paper_test'
        WHEN n % 2 = 1 AND rn = n // 2 + 1 THEN 'unassigned'
        ELSE 'community_hidden' END AS destination, count(*) AS rows,
      count(DISTINCT event_cluster_id) AS clusters
    FROM v LEFT JOIN k ON event_cluster_id = id WHERE split <> 'test' OR id IS NOT NULL GROUP BY 1""",
)
def test_partition(spark, directory):
    """Test clusters of two layers must agree, then they are halved, routed and published."""
    core, prov = decision_view(spark, directory), provenance_view(spark, directory)
    a = core.filter(F.col("split") == "test").select("event_cluster_id")
    b = prov.filter(F.col("split") == "test").select("event_cluster_id")
    agreement = X.key_alignment(a, b, ["event_cluster_id"]).first()
    if not agreement["aligned"]:
        raise ValueError("the layers hold different test clusters")
    halves = X.hash_halves(
        test_clusters(core), "event_cluster_id", "decision-audit", spare="unassigned"
    )
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    publish_partitions(X.route_rows(core, halves, "event_cluster_id"), path, DESTINATIONS)
    return spark.read.parquet(path).groupBy("destination").agg(
        F.count("*").alias("rows"), F.countDistinct("event_cluster_id").alias("clusters")
    )
