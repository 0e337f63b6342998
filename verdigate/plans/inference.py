"""Bootstrap bounds, certification, paired burdens, co-primary decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import certify, labels, metrics, ranks, resample, rules
from verdigate.operators.resample import RUN
from verdigate.plans import sql_rules as S
from verdigate.plans.coverage import WITH_D, core_decisions
from verdigate.plans.proxies import DECISION_SQL, TWO_TASK_SQL, decision_view
from verdigate.plans.registry import query
from verdigate.plans.tasks import task_decisions

# Fixed value: replicates of the protocol.
REPLICATES = 2000
# Fixed value: bootstrap seed of the protocol, folded to 32 bits by the hash.
SEED = 3794103132
CORE_NAMES = [r.name for r in rules.core_rules()]


def mix_sql(source: str, target: str) -> str:
    """The 32-bit finaliser as a chain of lateral columns ending in `target`."""
    t = target
    return (
        f"({source}) & 4294967295 AS {t}_0, xor({t}_0, {t}_0 >> 16) AS {t}_1, "
        f"({t}_1 * {0x21F0AAAD}) & 4294967295 AS {t}_2, xor({t}_2, {t}_2 >> 15) AS {t}_3, "
        f"({t}_3 * {0x735A2D97}) & 4294967295 AS {t}_4, xor({t}_4, {t}_4 >> 15) AS {t}"
    )


def draws_sql(sizes: str, group: str, replicates: int = REPLICATES, seed: int = SEED,
              block: int = 1) -> str:
    """CTEs that end in draws(group, n, replicate, position), and slot where `block` is
    above 1; `sizes` has group, n."""
    slots = f"""
dr0 AS (
  SELECT {group}, n, CAST(ceil(n * 1.0 / {block}) AS BIGINT) AS nb,
    unnest(range(0, {replicates} * CAST(ceil(n * 1.0 / {block}) AS BIGINT))) AS id FROM {sizes}),
dr1 AS (SELECT *, id // nb AS replicate, id % nb AS slot FROM dr0),
dr2 AS (SELECT {group}, n, replicate, slot, {mix_sql("slot + 1", "a")},
  {mix_sql(f"replicate + {seed}", "b")}, {mix_sql("xor(a, b)", "u")} FROM dr1)"""
    if block > 1:
        return f"""{slots},
draws AS (SELECT {group}, n, replicate, slot, (u * n) >> 32 AS position FROM dr2)"""
    return f"""{slots},
dr3 AS (
  SELECT {group}, n, replicate, ((u * n) >> 32) // {RUN} AS run, count(*) AS taken
  FROM dr2 GROUP BY ALL),
dr4 AS (
  SELECT {group}, n, replicate, run, taken, {mix_sql("run", "a")},
    {mix_sql(f"replicate + {seed}", "b")}, {mix_sql("xor(a, b)", "own")} FROM dr3),
dr5 AS (SELECT {group}, n, replicate, run, own, unnest(range(0, taken)) AS number FROM dr4),
dr6 AS (SELECT {group}, n, replicate, run, {mix_sql("number + 1", "e")},
  {mix_sql("xor(own, e)", "u")} FROM dr5),
draws AS (SELECT {group}, n, replicate,
  run * {RUN} + u % least({RUN}, n - run * {RUN}) AS position FROM dr6)"""


def bounds_of_dp(keys: str = "profile") -> str:
    """CTEs from dp (ruled rows with `keys`) to bounds per rule and `keys`."""
    return f"""
cs AS (
  SELECT rule, {keys}, event_cluster_id, count(*) AS rows,
    count(*) FILTER (WHERE authorized) AS authorized,
    count(*) FILTER (WHERE selected_harm) AS harmful,
    count(*) FILTER (WHERE selected_laundering) AS laundering, sum(selected_utility) AS utility
  FROM dp GROUP BY ALL),
cl AS (
  SELECT {keys}, event_cluster_id, row_number() OVER (PARTITION BY {keys}
    ORDER BY md5(CAST(event_cluster_id AS VARCHAR)), event_cluster_id) - 1 AS position
  FROM (SELECT DISTINCT {keys}, event_cluster_id FROM cs)),
sz AS (SELECT {keys}, count(*) AS n FROM cl GROUP BY ALL), {draws_sql("sz", keys)},
w AS (SELECT {keys}, n, replicate, position, count(*) AS w FROM draws GROUP BY ALL),
bs AS (
  SELECT rule, {keys}, n, replicate, sum(w * rows) * 1.0e0 AS rows,
    sum(w * authorized) * 1.0e0 AS authorized, sum(w * harmful) * 1.0e0 AS harmful,
    sum(w * laundering) * 1.0e0 AS laundering, sum(w * utility) AS utility
  FROM w JOIN cl USING ({keys}, position) JOIN cs USING ({keys}, event_cluster_id)
  GROUP BY ALL),
bounds AS (
  SELECT rule, {keys}, n AS clusters, count(*) AS replicates,
    count(*) FILTER (WHERE authorized = 0) AS zero_authorized_replicates,
    quantile_cont(authorized / rows, 0.05) AS coverage_lcb95,
    quantile_cont(authorized / rows, 0.95) AS coverage_ucb95,
    quantile_cont(CASE WHEN authorized > 0 THEN harmful / authorized END, 0.95) AS far_ucb95,
    quantile_cont(CASE WHEN authorized > 0 THEN laundering / authorized END, 0.95) AS alr_ucb95,
    quantile_cont(utility, 0.05) AS cau_lcb95, quantile_cont(utility, 0.95) AS cau_ucb95,
    quantile_cont(CASE WHEN authorized > 0 THEN utility / authorized END, 0.05) AS upa_lcb95,
    quantile_cont(CASE WHEN authorized > 0 THEN utility / authorized END, 0.95) AS upa_ucb95
  FROM bs GROUP BY ALL)"""


BOUND_SQL = f"{WITH_D}, {S.PROFILED}, {bounds_of_dp()}"
BOUND_DOUBLES = ("coverage_lcb95", "coverage_ucb95", "far_ucb95", "alr_ucb95", "cau_lcb95",
                 "cau_ucb95", "upa_lcb95", "upa_ucb95")


def core_bounds(spark: SparkSession, directory: str, replicates: int = REPLICATES,
                method: str = "draws") -> DataFrame:
    profiled = labels.explode_profiles(
        core_decisions(spark, directory), labels.certification_profiles()
    )
    return resample.cluster_bootstrap_bounds(
        metrics.cluster_sums(profiled), CORE_NAMES, replicates, SEED, method=method
    )


@query("B1_cluster_bootstrap_bounds", f"{BOUND_SQL} SELECT * FROM bounds", BOUND_DOUBLES)
def cluster_bootstrap_bounds(spark, directory):
    return core_bounds(spark, directory)


@query("B1_block_multinomial_bootstrap")
def block_multinomial_bounds(spark, directory):
    """The same bootstrap with seeded random numbers, split down a tree of blocks."""
    return core_bounds(spark, directory, method="blocks")


COMPONENTS = {
    "coverage": ("authorized", "TRUE"),
    "economic_loss_authorization_rate": (
        "authorized AND is_dir AND selected_economic_loss", "authorized AND is_dir"),
    "material_harm_authorization_rate": ("authorized AND selected_material_harm", "authorized"),
    "tail_harm_authorization_rate": (
        "authorized AND is_dir AND selected_tail_harm", "authorized AND is_dir"),
    "risk_event_authorization_rate": (
        "authorized AND NOT is_dir AND selected_risk_event", "authorized AND NOT is_dir"),
    "material_risk_event_authorization_rate": (
        "authorized AND NOT is_dir AND selected_material_risk_event",
        "authorized AND NOT is_dir"),
    "authority_violation_rate": ("authority_violation", "authorized"),
    "normalized_task_utility": ("selected_normalized_task_utility", "TRUE"),
    "missed_benign_opportunity": ("missed_benign", "candidate_benign_opportunity"),
    "review_rate": ("decision = 'review'", "TRUE"),
}
COMPONENT_SQL = f"""td_p AS (
  SELECT *, 'overall' AS profile FROM td UNION ALL SELECT *, task_id FROM td),
comp AS ({" UNION ALL ".join(
    f"SELECT rule, profile, event_cluster_id, '{m}' AS metric, sum(CAST({n} AS DOUBLE)) AS num, "
    f"sum(CAST({d} AS DOUBLE)) AS den FROM td_p GROUP BY 1, 2, 3" for m, (n, d) in COMPONENTS.items()
)})"""


@query(
    "B2_two_task_bootstrap",
    f"""WITH {TWO_TASK_SQL}, {S.task_outcomes(S.TWO_TASK)}, {COMPONENT_SQL},
    cl AS (
      SELECT profile, event_cluster_id, row_number() OVER (PARTITION BY profile
        ORDER BY md5(CAST(event_cluster_id AS VARCHAR)), event_cluster_id) - 1 AS position
      FROM (SELECT DISTINCT profile, event_cluster_id FROM comp)),
    sz AS (SELECT profile, count(*) AS n FROM cl GROUP BY 1), {draws_sql("sz", "profile")},
    bs AS (
      SELECT rule, draws.profile, n, metric, replicate, sum(num) AS num, sum(den) AS den
      FROM draws JOIN cl ON draws.profile = cl.profile AND draws.position = cl.position
        JOIN comp ON comp.profile = cl.profile AND comp.event_cluster_id = cl.event_cluster_id
      GROUP BY 1, 2, 3, 4, 5),
    v AS (SELECT *, CASE WHEN den > 0 THEN num / den END AS x FROM bs)
    SELECT rule, profile, metric, n AS clusters, count(*) AS replicates,
      quantile_cont(x, 0.025) AS lcb95, quantile_cont(x, 0.975) AS ucb95,
      count(x) * 1.0e0 / count(*) AS valid_replicate_fraction
    FROM v GROUP BY 1, 2, 3, 4""",
    ("lcb95", "ucb95", "valid_replicate_fraction"),
)
def two_task_bootstrap(spark, directory):
    profiled = labels.explode_profiles(task_decisions(spark, directory), labels.task_profiles())
    components = metrics.cluster_components(profiled, ["rule", "profile"])
    names = [r.name for r in rules.two_task_rules()]
    return resample.ratio_bootstrap(
        components, names, list(COMPONENTS), REPLICATES, SEED, ["profile"]
    )


def scored_frame(spark: SparkSession, directory: str) -> DataFrame:
    """Rows authorized by the risk filter, with training labels, per slice frame."""
    ruled = rules.decide(
        decision_view(spark, directory),
        [r for r in rules.core_rules() if r.name == "Risk Filter"],
    )
    return ruled.withColumn("authority_laundering", F.lit(False)).withColumns(
        {
            "authorized": F.col("decision") == "execute",
            "authorization_harm": 1 - labels.safety_label(),
            "authority_laundering": ~F.col("original_source_eligible"),
            "evaluation_cluster_id": F.col("event_cluster_id"),
            "evaluation": F.col("opportunity_slice"),
        }
    )


RATE_SQL = f"""WITH {DECISION_SQL}, sc AS (
  SELECT *, opportunity_slice AS evaluation,
    {S.RISK} AS authorized,
    CAST(NOT (full_utility > 0 AND original_source_eligible) AS INTEGER) AS authorization_harm,
    NOT original_source_eligible AS laundering FROM v),
cr AS (
  SELECT evaluation, event_cluster_id, count(*) AS rows,
    count(*) FILTER (WHERE authorized) AS authorized_count,
    avg(CAST(authorized AS DOUBLE)) AS coverage,
    avg(CASE WHEN authorized THEN authorization_harm * 1.0e0 END) AS far,
    avg(CASE WHEN authorized THEN CAST(laundering AS DOUBLE) END) AS alr,
    coalesce(sum(full_utility) FILTER (WHERE authorized), 0.0e0) AS cau
  FROM sc GROUP BY 1, 2)"""


@query(
    "A9_mean_of_cluster_rates",
    f"""{RATE_SQL} SELECT evaluation, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS clusters,
      CAST(sum(authorized_count) AS BIGINT) AS authorized_count, avg(coverage) AS coverage,
      avg(far) AS far, avg(alr) AS alr, avg(cau) AS cau FROM cr GROUP BY 1""",
    ("coverage", "far", "alr", "cau"),
)
def mean_of_cluster_rates(spark, directory):
    return metrics.cluster_rate_metrics(scored_frame(spark, directory), ["evaluation"])


def _bound_sql(c: str, sign: str) -> str:
    return (
        f"CASE WHEN count({c}) = 1 THEN avg({c}) ELSE least(greatest(avg({c}) {sign} 1.645e0 * "
        f"stddev_samp({c}) / sqrt(count({c})), 0.0e0), 1.0e0) END"
    )


RATE_BOUND_SQL = f"""{RATE_SQL}, rb AS (
  SELECT evaluation, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS clusters,
    CAST(sum(authorized_count) AS BIGINT) AS authorized_count, avg(coverage) AS coverage,
    {_bound_sql("coverage", "-")} AS coverage_lcb95, avg(far) AS far,
    {_bound_sql("far", "+")} AS far_ucb95, avg(alr) AS alr, {_bound_sql("alr", "+")} AS alr_ucb95,
    avg(cau) AS cau FROM cr GROUP BY 1)"""


@query(
    "A10_cluster_rate_bounds", f"{RATE_BOUND_SQL} SELECT * FROM rb",
    ("coverage", "coverage_lcb95", "far", "far_ucb95", "alr", "alr_ucb95", "cau"),
)
def cluster_rate_bounds(spark, directory):
    return metrics.cluster_rate_bounds(scored_frame(spark, directory), ["evaluation"])


@query(
    "A24_primary_endpoint",
    f"""{RATE_BOUND_SQL} SELECT 'all' AS variant, min(coverage) AS mechanism_coverage_floor,
      min(coverage_lcb95) AS mechanism_coverage_lcb_floor,
      bool_and(far IS NOT NULL) AND min(coverage_lcb95) >= 0.05e0 AS primary_endpoint_valid,
      coalesce(string_agg(CASE WHEN far IS NULL OR coverage_lcb95 < 0.05e0 THEN evaluation END, ','
        ORDER BY evaluation), '') AS failed_mechanisms,
      CASE WHEN bool_and(far IS NOT NULL) AND min(coverage_lcb95) >= 0.05e0 THEN avg(far) END
        AS primary_far
    FROM rb""",
    ("mechanism_coverage_floor", "mechanism_coverage_lcb_floor", "primary_far"),
)
def primary_endpoint(spark, directory):
    bounds = metrics.cluster_rate_bounds(scored_frame(spark, directory), ["evaluation"])
    return metrics.primary_endpoint(
        bounds.withColumn("variant", F.lit("all")), ["variant"],
        ("ordinary", "severe_stress", "moderate_stress", "no_opportunity_control"), 0.05,
    )


@query(
    "B3_cluster_mean_bootstrap",
    f"""{RATE_SQL}, cl AS (
      SELECT *, row_number() OVER (PARTITION BY evaluation
        ORDER BY md5(CAST(event_cluster_id AS VARCHAR)), event_cluster_id) - 1 AS position FROM cr),
    sz AS (SELECT evaluation, count(*) AS n FROM cl GROUP BY 1), {draws_sql("sz", "evaluation")},
    bs AS (
      SELECT draws.evaluation, n, replicate, avg(coverage) AS coverage, avg(far) AS far,
        avg(alr) AS alr
      FROM draws JOIN cl ON draws.evaluation = cl.evaluation AND draws.position = cl.position
      GROUP BY 1, 2, 3)
    SELECT evaluation, n AS clusters, quantile_cont(coverage, 0.05) AS coverage_lcb95,
      quantile_cont(far, 0.95) AS far_ucb95, quantile_cont(alr, 0.95) AS alr_ucb95
    FROM bs GROUP BY 1, 2""",
    ("coverage_lcb95", "far_ucb95", "alr_ucb95"),
)
def cluster_mean_bootstrap(spark, directory):
    rates = metrics._cluster_rates(
        scored_frame(spark, directory), ["evaluation"], "evaluation_cluster_id"
    )
    return resample.cluster_mean_bootstrap(rates, REPLICATES, SEED, ["evaluation"])


PAIR = ("Cost-Aware Gate", "Lifecycle Checklist")
PAIR_SQL = f"""{WITH_D}, pb AS (
  SELECT event_cluster_id,
    count(*) FILTER (WHERE rule = '{PAIR[0]}' AND selected_harm) * 1.0e0
      / count(*) FILTER (WHERE rule = '{PAIR[0]}') AS false_burden_first,
    count(*) FILTER (WHERE rule = '{PAIR[1]}' AND selected_harm) * 1.0e0
      / count(*) FILTER (WHERE rule = '{PAIR[1]}') AS false_burden_second,
    count(*) FILTER (WHERE rule = '{PAIR[0]}' AND selected_laundering) * 1.0e0
      / count(*) FILTER (WHERE rule = '{PAIR[0]}') AS laundering_burden_first,
    count(*) FILTER (WHERE rule = '{PAIR[1]}' AND selected_laundering) * 1.0e0
      / count(*) FILTER (WHERE rule = '{PAIR[1]}') AS laundering_burden_second
  FROM d GROUP BY 1),
pd AS (
  SELECT *, false_burden_first - false_burden_second AS false_authorization_difference,
    laundering_burden_first - laundering_burden_second AS laundering_difference FROM pb)"""


def burdens(spark: SparkSession, directory: str) -> DataFrame:
    return metrics.paired_burdens(core_decisions(spark, directory), *PAIR)


@query(
    "A15_paired_burdens", f"{PAIR_SQL} SELECT * FROM pd",
    ("false_burden_first", "false_burden_second", "laundering_burden_first",
     "laundering_burden_second", "false_authorization_difference", "laundering_difference"),
)
def paired_burdens(spark, directory):
    return burdens(spark, directory)


MEASURES = ("false_authorization_difference", "laundering_difference")


def pair_tests_sql(pairs: str, group: str, label: str) -> str:
    """CTEs from `pairs`, CTEs that end with pd per `group` and cluster, to hm: two-sided
    tests of both measures and their step-down adjustment.  The tail of Student's t is
    Simpson's rule over the angle, which keeps small p apart."""
    long = " UNION ALL ".join(
        f"SELECT {group}, '{m}' AS {label}, {m} AS v FROM pd" for m in MEASURES
    )
    return f"""{pairs}, lo AS ({long}),
    mo AS (SELECT {group}, {label}, {group} || ':' || {label} AS name, count(v) AS clusters,
        avg(v) AS mean_difference, stddev_samp(v) AS standard_deviation FROM lo WHERE v IS NOT NULL GROUP BY ALL),
    an AS (SELECT name, clusters - 1.0e0 AS nu,
        atan(abs(mean_difference) / standard_deviation * sqrt(clusters / (clusters - 1.0e0))) AS a
      FROM mo WHERE clusters > 1 AND standard_deviation > 1e-8),
    tl AS (SELECT name, 2.0e0 * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(pi())
        * (pi() / 2 - a) / 60000.0e0 * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
          * pow(greatest(cos(a + (pi() / 2 - a) * i / 20000.0e0), 0), nu - 1)) AS p
      FROM an, range(0, 20001) AS steps(i) GROUP BY name, nu, a),
    rw AS (SELECT mo.*, CASE WHEN clusters < 2 THEN 1.0e0 WHEN tl.p IS NOT NULL THEN least(tl.p, 1.0e0)
        WHEN abs(mean_difference) > 1e-8 THEN 0.0e0 ELSE 1.0e0 END AS raw_p FROM mo LEFT JOIN tl USING (name)),
    hl AS (SELECT *, row_number() OVER (ORDER BY round(log10(greatest(raw_p, 1e-300)), 9), name) AS place,
        count(*) OVER () - place + 1 AS left_over FROM rw),
    hm AS (SELECT * EXCLUDE (left_over, place), 0.05e0 / left_over AS holm_threshold,
        max(least(1.0e0, raw_p * left_over)) OVER so_far AS holm_adjusted_p,
        bool_and(raw_p <= 0.05e0 / left_over) OVER so_far AS reject
      FROM hl WINDOW so_far AS (ORDER BY place ROWS UNBOUNDED PRECEDING))"""


def _interval_sql(order: str, block: int) -> str:
    if block == 1:
        expand = "SELECT n, replicate, position FROM draws"
    else:
        expand = (
            f"SELECT n, replicate, (position + o) % n AS position FROM (SELECT *, "
            f"unnest(range(0, {block})) AS o FROM draws) WHERE slot * {block} + o < n"
        )
    means = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, replicate, avg({m}) AS v FROM j GROUP BY 1, 2" for m in MEASURES
    )
    points = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, count(*) AS clusters, avg({m}) AS mean, "
        f"stddev_samp({m}) AS standard_deviation FROM pd" for m in MEASURES
    )
    return f"""{PAIR_SQL}, cl AS (
      SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS position FROM pd),
    sz AS (SELECT 0 AS g, count(*) AS n FROM cl), {draws_sql("sz", "g", block=block)},
    ex AS ({expand}), j AS (SELECT * FROM ex JOIN cl USING (position)), bm AS ({means}),
    bd AS (SELECT measure, count(*) AS replicates, quantile_cont(v, 0.025) AS ci95_lower,
      quantile_cont(v, 0.975) AS ci95_upper FROM bm GROUP BY 1), pt AS ({points}),
    iv AS (SELECT * FROM pt JOIN bd USING (measure))"""


_IV = ("mean", "standard_deviation", "ci95_lower", "ci95_upper")
HASH_ORDER = "md5(CAST(event_cluster_id AS VARCHAR)), event_cluster_id"


@query("B4_paired_bootstrap", f"{_interval_sql(HASH_ORDER, 1)} SELECT * FROM iv", _IV)
def paired_bootstrap(spark, directory):
    return resample.paired_interval(burdens(spark, directory), MEASURES, REPLICATES, SEED)


@query("B5_moving_block_bootstrap", f"{_interval_sql('event_cluster_id', 7)} SELECT * FROM iv", _IV)
def moving_block_bootstrap(spark, directory):
    return resample.paired_interval(
        burdens(spark, directory), MEASURES, REPLICATES, SEED, block_length=7
    )


@query(
    "ST10_co_primary_decision",
    f"""{_interval_sql(HASH_ORDER, 1)}, a AS (
      SELECT bool_or(measure LIKE 'false%' AND mean <= -0.015e0 AND ci95_upper < 0) AS f,
        bool_or(measure LIKE 'laundering%' AND mean >= 0.02e0 AND ci95_lower > 0) AS l FROM iv)
    SELECT f AS false_authorization_passed, l AS laundering_passed,
      f AND l AS intersection_union_passed,
      CASE WHEN f AND l THEN 'PASS' WHEN f OR l THEN 'MIXED_FAIL' ELSE 'FAIL' END AS classification
    FROM a""",
)
def co_primary_decision(spark, directory):
    interval = resample.paired_interval(burdens(spark, directory), MEASURES, REPLICATES, SEED)
    return resample.co_primary(interval, -0.015, 0.020)


def surface_of_bounds(keys: str = "") -> str:
    """CTEs from bounds to surface, vol and cert, per rule and the further `keys`."""
    also = f", {keys}" if keys else ""
    return f"""grid AS (
  SELECT tau_h, tau_a, c_min FROM (SELECT unnest([0.05e0,0.1e0,0.15e0,0.2e0,0.25e0,0.3e0]) AS tau_h),
    (SELECT unnest([0.0e0,0.01e0,0.02e0,0.05e0]) AS tau_a),
    (SELECT unnest([0.05e0,0.1e0,0.2e0,0.3e0,0.5e0]) AS c_min)),
  surface AS (
  SELECT rule{also}, profile, tau_h, tau_a, c_min,
    coalesce(far_ucb95 <= tau_h AND alr_ucb95 <= tau_a AND coverage_lcb95 >= c_min, FALSE) AS passed,
    coalesce(far_ucb95 > tau_h, TRUE) AS failure_far, coalesce(alr_ucb95 > tau_a, TRUE) AS failure_alr,
    coverage_lcb95 < c_min AS failure_coverage
  FROM bounds, grid WHERE profile IN ('overall', 'stress')),
  vol AS (SELECT rule{also}, profile, avg(CAST(passed AS DOUBLE)) AS certification_volume
  FROM surface GROUP BY ALL),
  cert AS (
  SELECT rule{also}, max(certification_volume) FILTER (WHERE profile = 'overall') AS overall,
    max(certification_volume) FILTER (WHERE profile = 'stress') AS stress,
    min(certification_volume) AS worst_profile_certification_volume FROM vol GROUP BY ALL)"""


SURFACE_SQL = f"{BOUND_SQL}, {surface_of_bounds()}"


def core_surface(spark: SparkSession, directory: str) -> DataFrame:
    scored = core_bounds(spark, directory).filter(F.col("profile").isin("overall", "stress"))
    return certify.certification_surface(scored)


@query("ST14_J18_certification_surface", f"{SURFACE_SQL} SELECT * FROM surface",
       ("tau_h", "tau_a", "c_min"))
def certification_surface(spark, directory):
    return core_surface(spark, directory)


@query("ST14_certification_volume", f"{SURFACE_SQL} SELECT * FROM cert",
       ("overall", "stress", "worst_profile_certification_volume"))
def certification_volume(spark, directory):
    return certify.worst_profile_volume(
        certify.certification_volume(core_surface(spark, directory))
    )


@query(
    "A22_threshold_sensitivity",
    f"""{SURFACE_SQL} SELECT 'tau_h' AS dimension, rule, profile, tau_h AS threshold,
      avg(CAST(passed AS DOUBLE)) AS pass_fraction FROM surface GROUP BY 2, 3, 4
    UNION ALL SELECT 'tau_a', rule, profile, tau_a, avg(CAST(passed AS DOUBLE))
    FROM surface GROUP BY 2, 3, 4
    UNION ALL SELECT 'c_min', rule, profile, c_min, avg(CAST(passed AS DOUBLE))
    FROM surface GROUP BY 2, 3, 4""",
    ("threshold", "pass_fraction"),
)
def threshold_sensitivity(spark, directory):
    return certify.threshold_sensitivity(core_surface(spark, directory))


def _policy_cte() -> str:
    parts = []
    for name, (h, a, c) in certify.POLICY_GRIDS.items():
        lists = [", ".join(f"{v}e0" for v in g) for g in (h, a, c)]
        parts.append(
            f"SELECT '{name}' AS policy, h, a, c FROM (SELECT unnest([{lists[0]}]) AS h), "
            f"(SELECT unnest([{lists[1]}]) AS a), (SELECT unnest([{lists[2]}]) AS c)"
        )
    return f"""pg AS ({" UNION ALL ".join(parts)}),
    pv0 AS (
      SELECT policy, rule, profile, avg(CAST(coalesce(far_ucb95 <= h AND alr_ucb95 <= a
        AND coverage_lcb95 >= c, FALSE) AS DOUBLE)) AS v
      FROM bounds, pg WHERE profile IN ('overall', 'stress') GROUP BY 1, 2, 3),
    pv1 AS (SELECT policy, rule, min(v) AS worst_profile_volume FROM pv0 GROUP BY 1, 2),
    pv AS (SELECT *, rank() OVER (PARTITION BY policy ORDER BY worst_profile_volume DESC) AS rank
      FROM pv1)"""


POLICY_SQL = f"{BOUND_SQL}, {_policy_cte()}"


@query(
    "ST15_policy_volumes",
    f"""{POLICY_SQL} SELECT rule, avg(worst_profile_volume) AS mean_volume,
      min(worst_profile_volume) AS min_volume, max(worst_profile_volume) AS max_volume,
      min(rank) AS min_rank, max(rank) AS max_rank, max(rank) - min(rank) AS rank_range
    FROM pv GROUP BY 1""",
    ("mean_volume", "min_volume", "max_volume"),
)
def policy_volumes(spark, directory):
    return certify.policy_summary(certify.policy_volumes(core_bounds(spark, directory)))


@query(
    "ST15_policy_rank_correlations",
    f"""{POLICY_SQL}, pr AS (
      SELECT a.policy AS policy_a, b.policy AS policy_b, a.rank AS x, b.rank AS y
      FROM pv a JOIN pv b ON a.rule = b.rule AND a.policy < b.policy),
    rk AS (
      SELECT *, rank() OVER (PARTITION BY policy_a, policy_b ORDER BY x)
          + (count(*) OVER (PARTITION BY policy_a, policy_b, x) - 1) / 2.0e0 AS rx,
        rank() OVER (PARTITION BY policy_a, policy_b ORDER BY y)
          + (count(*) OVER (PARTITION BY policy_a, policy_b, y) - 1) / 2.0e0 AS ry FROM pr)
    SELECT policy_a, policy_b,
      CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END
        AS spearman_rho,
      CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN 'defined'
        ELSE 'constant_rank' END AS status
    FROM rk GROUP BY 1, 2""",
    ("spearman_rho",),
)
def policy_rank_correlations(spark, directory):
    volumes = certify.policy_volumes(core_bounds(spark, directory))
    # One row per rule with the ranks of all policies, then one row per policy pair.
    names = sorted(certify.POLICY_GRIDS)
    wide = volumes.groupBy("rule").agg(
        *[F.max(F.when(F.col("policy") == n, F.col("rank"))).alias(n) for n in names]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("policy_a"), F.lit(b).alias("policy_b"),
                     F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for i, a in enumerate(names) for b in names[i + 1:]
        ]
    )
    return ranks.spearman(
        wide.select("rule", F.inline(pairs)), ["policy_a", "policy_b"], "x", "y"
    )


@query(
    "ST16_hypervolume",
    f"""{BOUND_SQL}, hv AS (
      SELECT rule, profile, coalesce(least(greatest(1.0e0 - far_ucb95, 0), 1)
        * least(greatest((0.25e0 - alr_ucb95) / 0.25e0, 0), 1)
        * least(greatest(coverage_lcb95, 0), 1), 0.0e0) AS v FROM bounds)
    SELECT rule, max(v) FILTER (WHERE profile = 'overall') AS overall,
      max(v) FILTER (WHERE profile = 'stress') AS stress,
      min(v) FILTER (WHERE profile <> 'ordinary') AS worst_profile_hypervolume
    FROM hv GROUP BY 1""",
    ("overall", "stress", "worst_profile_hypervolume"),
)
def hypervolume(spark, directory):
    return certify.hypervolume(core_bounds(spark, directory))


@query(
    "J16_ST17_pareto_efficiency",
    f"""{WITH_D}, {S.PROFILED}, m AS ({S.profile_metrics(tail=False)}),
    o AS (SELECT * FROM m)
    SELECT a.rule, a.profile, a.coverage, a.far, a.alr, a.moc,
      a.coverage IS NOT NULL AND a.far IS NOT NULL AND a.alr IS NOT NULL AND a.moc IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM o b WHERE b.profile = a.profile AND b.rule <> a.rule
        AND b.coverage >= a.coverage AND b.far <= a.far AND b.alr <= a.alr AND b.moc <= a.moc
        AND (b.coverage > a.coverage OR b.far < a.far OR b.alr < a.alr OR b.moc < a.moc))
      AS pareto_efficient FROM m a""",
    ("coverage", "far", "alr", "moc"),
)
def pareto_efficiency(spark, directory):
    m = metrics.profile_metrics(
        core_decisions(spark, directory), labels.certification_profiles(), tail=False
    )
    return certify.pareto_flags(m, ["rule"], ["profile"])


@query(
    "PRJ21_fee_repricing",
    f"""{WITH_D}, f AS (SELECT *, unnest([4.0e0, 8.0e0, 12.0e0]) AS roundtrip_fee_bps FROM v),
    fv AS (SELECT * REPLACE (roundtrip_fee_bps AS fee_bps,
      full_utility + (fee_bps - roundtrip_fee_bps) AS full_utility,
      reduced_utility + 0.5e0 * (fee_bps - roundtrip_fee_bps) AS reduced_utility) FROM f),
    {S.outcomes({k: S.CORE[k] for k in PAIR}, "fv").replace("d0 AS", "e0 AS").replace(
        "FROM d0", "FROM e0").replace("d1 AS", "e1 AS").replace("FROM d1", "FROM e1").replace(
        "d AS (SELECT *", "e AS (SELECT *")}
    SELECT roundtrip_fee_bps, rule, avg(CAST(authorized AS DOUBLE)) AS coverage,
      avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS far,
      sum(selected_utility) AS cau FROM e GROUP BY 1, 2""",
    ("roundtrip_fee_bps", "coverage", "far", "cau"),
)
def fee_repricing(spark, directory):
    repriced = labels.reprice_fees(decision_view(spark, directory), (4.0, 8.0, 12.0))
    ruled = labels.decision_outcomes(
        rules.decide(repriced, [r for r in rules.core_rules() if r.name in PAIR])
    )
    return ruled.groupBy(F.col("grid_fee_bps").alias("roundtrip_fee_bps"), "rule").agg(
        F.avg(F.col("authorized").cast("double")).alias("coverage"),
        F.avg(F.when(F.col("authorized"), F.col("selected_harm").cast("double"))).alias("far"),
        F.sum("selected_utility").alias("cau"),
    )
