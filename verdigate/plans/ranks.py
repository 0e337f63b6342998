"""Rank transfer between rule scores, tests, power, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.operators import certify, labels, metrics, ranks, resample, rules, transfer
from verdigate.operators.distributed import materialize
from verdigate.operators.text import jensen_shannon_drift
from verdigate.plans import sql_rules as S
from verdigate.plans.coverage import GLOBAL_FORBIDDEN, IDENTIFIERS, WITH_D, core_decisions, feature_access_audit
from verdigate.plans.inference import (
    CORE_NAMES, MEASURES, PAIR, PAIR_SQL, REPLICATES, SEED, SURFACE_SQL, burdens, core_bounds,
    COMPONENTS, draws_sql, pair_tests_sql,
)
from verdigate.plans.proxies import DECISION_SQL, TWO_TASK_SQL, decision_view, two_task_lines
from verdigate.plans.registry import ORACLES, query
from verdigate.plans.structure import point_in_time_audit
from verdigate.plans.tasks import REGIME_SQL, task_decisions, task_frame, with_regime

METRIC = "material_harm_authorization_rate"


def controlled_scores(spark: SparkSession, directory: str, lines: DataFrame | None = None) -> DataFrame:
    """Harm rate of each core rule on the decision view: the reference ranking, a row a rule,
    written down, since whatever is ranked against it reads it several times."""
    m = metrics.profile_metrics(
        core_decisions(spark, directory, lines), {"overall": F.col("certification_eligible")}, tail=False
    )
    return materialize(m.select("rule", F.col("far").alias("controlled")))


def directional(spark: SparkSession, directory: str) -> DataFrame:
    return task_decisions(spark, directory).filter(F.col("task_id") == labels.DIRECTIONAL)


def observed_scores(ruled: DataFrame, groups: list[str], metric: str = METRIC) -> DataFrame:
    num, den = metrics.task_components()[metric]
    return ruled.groupBy(*groups, "rule").agg(
        F.try_divide(F.sum(num), F.sum(den)).alias("observed")
    )


CONTROLLED_SQL = """
ctl AS (
  SELECT rule, avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS controlled
  FROM d WHERE certification_eligible GROUP BY 1),
dirr AS (SELECT * FROM td WHERE is_dir)"""
SCORES_SQL = f"{WITH_D}, {TWO_TASK_SQL}, {S.task_outcomes(S.TWO_TASK)}, {CONTROLLED_SQL}"
OBS = "avg(CASE WHEN authorized THEN CAST(selected_material_harm AS DOUBLE) END) AS observed"


def _rank_sql(source: str, groups: str) -> str:
    """CTE text: rho and tau of `source`(groups, rule, controlled, observed)."""
    on = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in groups.split(","))
    return f"""
rkd AS (
  SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY controlled)
      + (count(*) OVER (PARTITION BY {groups}, controlled) - 1) / 2.0e0 AS rx,
    rank() OVER (PARTITION BY {groups} ORDER BY observed)
      + (count(*) OVER (PARTITION BY {groups}, observed) - 1) / 2.0e0 AS ry FROM {source}),
rho AS (
  SELECT {groups}, CAST(count(*) AS INTEGER) AS n_rules, CASE WHEN count(*) < 3 THEN 'fewer_than_three_aligned_rules'
      WHEN count(controlled) < count(*) OR count(observed) < count(*) THEN 'missing_or_na_rule_scores'
      WHEN count(DISTINCT controlled) < 2 THEN 'controlled_ranking_constant_or_fully_tied'
      WHEN count(DISTINCT observed) < 2 THEN 'observed_ranking_constant_or_fully_tied' END AS reason,
    corr(rx, ry) AS raw_rho FROM rkd GROUP BY {groups}),
tau AS (
  SELECT {", ".join("a." + g.strip() for g in groups.split(","))},
    sum(sign(a.controlled - b.controlled) * sign(a.observed - b.observed))
    / sqrt(sum(abs(sign(a.controlled - b.controlled)))
           * sum(abs(sign(a.observed - b.observed)))) AS raw_tau
  FROM {source} a JOIN {source} b ON {on} AND a.rule < b.rule GROUP BY ALL),
stat AS (
  SELECT {groups}, n_rules, reason IS NULL AS valid, reason,
    CASE WHEN reason IS NULL THEN raw_rho END AS spearman_rho,
    CASE WHEN reason IS NULL THEN raw_tau END AS kendall_tau_b
  FROM rho JOIN tau USING ({groups}))"""


@query(
    "ST1_ST2_rank_statistics",
    f"""{SCORES_SQL}, obs AS (SELECT 1 AS g, rule, {OBS} FROM dirr GROUP BY rule),
    sc AS (SELECT g, rule, controlled, observed FROM obs JOIN ctl USING (rule)),
    {_rank_sql("sc", "g")} SELECT * EXCLUDE (g) FROM stat""",
    ("spearman_rho", "kendall_tau_b"),
)
def rank_statistics(spark, directory):
    scores = observed_scores(directional(spark, directory), []).join(
        controlled_scores(spark, directory), "rule"
    )
    return ranks.rank_statistics(scores)


@query(
    "ST5_subgroup_rank_transfer",
    f"""{SCORES_SQL}, obs AS (SELECT model_id, symbol, rule, {OBS} FROM dirr GROUP BY 1, 2, 3),
    sc AS (SELECT model_id, symbol, rule, controlled, observed FROM obs JOIN ctl USING (rule)),
    {_rank_sql("sc", "model_id, symbol")} SELECT * FROM stat""",
    ("spearman_rho", "kendall_tau_b"),
)
def subgroup_rank_transfer(spark, directory):
    scores = observed_scores(directional(spark, directory), ["model_id", "symbol"]).join(
        controlled_scores(spark, directory), "rule"
    )
    return ranks.rank_statistics(scores, ["model_id", "symbol"])


_PERMUTE = """
pm AS (
  SELECT p FROM (
    SELECT [a, b, c, e, f, g, h] AS p FROM (SELECT unnest(range(1, 8)) AS a),
      (SELECT unnest(range(1, 8)) AS b), (SELECT unnest(range(1, 8)) AS c),
      (SELECT unnest(range(1, 8)) AS e), (SELECT unnest(range(1, 8)) AS f),
      (SELECT unnest(range(1, 8)) AS g), (SELECT unnest(range(1, 8)) AS h))
  WHERE len(list_distinct(p)) = 7),
ri AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rule) AS i FROM rkd),
rl AS (SELECT g, list(rx ORDER BY i) AS xs, list(ry ORDER BY i) AS ys FROM ri GROUP BY g),
ps AS (
  SELECT g, list_sum([xs[k] * ys[p[k]] FOR k IN [1, 2, 3, 4, 5, 6, 7]]) AS s,
    list_sum([xs[k] * ys[k] FOR k IN [1, 2, 3, 4, 5, 6, 7]]) AS s0 FROM pm, rl)"""


@query(
    "ST3_exact_permutation",
    f"""{SCORES_SQL}, obs AS (SELECT model_id AS g, rule, {OBS} FROM dirr GROUP BY 1, 2),
    sc AS (SELECT g, rule, controlled, observed FROM obs JOIN ctl USING (rule)),
    {_rank_sql("sc", "g")}, {_PERMUTE}
    SELECT g AS model_id, n_rules, valid, reason, spearman_rho AS observed_spearman_rho,
      count(*) AS permutations, avg(CAST(s <= s0 + 1e-9 AS DOUBLE)) AS exact_p_value
    FROM ps JOIN stat USING (g) GROUP BY 1, 2, 3, 4, 5""",
    ("observed_spearman_rho", "exact_p_value"),
)
def exact_permutation(spark, directory):
    scores = observed_scores(directional(spark, directory), ["model_id"]).join(
        controlled_scores(spark, directory), "rule"
    )
    return ranks.exact_permutation(scores, ["model_id"])


@query(
    "ST4_leave_one_rule_out",
    f"""{SCORES_SQL}, obs AS (SELECT rule, {OBS} FROM dirr GROUP BY rule),
    sc0 AS (SELECT rule, controlled, observed FROM obs JOIN ctl USING (rule)),
    sc AS (SELECT o.rule AS omitted_rule, s.rule, s.controlled, s.observed
      FROM sc0 s JOIN sc0 o ON s.rule <> o.rule),
    {_rank_sql("sc", "omitted_rule")}
    SELECT omitted_rule, n_rules, valid, reason, spearman_rho, kendall_tau_b FROM stat""",
    ("spearman_rho", "kendall_tau_b"),
)
def leave_one_rule_out(spark, directory):
    scores = observed_scores(directional(spark, directory), []).join(
        controlled_scores(spark, directory), "rule"
    )
    return ranks.leave_one_out(scores).drop("exact_permutation_p")


@query(
    "J7_J17_pairwise_reversal",
    f"""{SCORES_SQL}, obs AS (SELECT rule, {OBS} FROM dirr GROUP BY rule),
    sc AS (SELECT rule, controlled, observed FROM obs JOIN ctl USING (rule)),
    pr AS (
      SELECT a.rule AS rule_a, b.rule AS rule_b, a.controlled - b.controlled AS controlled_delta,
        a.observed - b.observed AS observed_delta FROM sc a JOIN sc b ON a.rule < b.rule),
    q AS (
      SELECT *, CASE WHEN controlled_delta IS NULL OR observed_delta IS NULL THEN 'pair_missing_n_a'
        WHEN abs(controlled_delta) <= 1e-8 OR abs(observed_delta) <= 1e-8 THEN 'pair_tied_n_a' END
        AS reason FROM pr)
    SELECT *, CASE WHEN reason IS NULL THEN controlled_delta * observed_delta < 0 END AS reversal,
      reason IS NULL AS valid FROM q""",
    ("controlled_delta", "observed_delta"),
)
def pairwise_reversal(spark, directory):
    scores = observed_scores(directional(spark, directory), []).join(
        controlled_scores(spark, directory), "rule"
    )
    return ranks.pairwise_reversal(scores)


TASK_NAMES = [r.name for r in rules.two_task_rules()]
ST7_METRICS = ("coverage", "economic_loss_authorization_rate", METRIC,
               "tail_harm_authorization_rate", "authority_violation_rate",
               "normalized_task_utility", "missed_benign_opportunity", "review_rate")


def _score_sql() -> str:
    parts = [
        f"SELECT rule, '{m}' AS metric, sum(CAST({COMPONENTS[m][0]} AS DOUBLE)) AS num, "
        f"sum(CAST({COMPONENTS[m][1]} AS DOUBLE)) AS den FROM td GROUP BY 1"
        for m in ST7_METRICS
    ]
    return (
        f"WITH {TWO_TASK_SQL}, {S.task_outcomes(S.TWO_TASK)}, c AS ({' UNION ALL '.join(parts)}) "
        "SELECT rule, metric, CASE WHEN den <> 0 THEN num / den END AS score FROM c"
    )


@query("ST7_rule_scores", _score_sql(), ("score",))
def rule_scores(spark, directory):
    parts = metrics.task_components()
    ruled = task_decisions(spark, directory)
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"s_{m}").alias("score")) for m in ST7_METRICS]
    )
    wide = ruled.groupBy("rule").agg(
        *[F.try_divide(F.sum(parts[m][0]), F.sum(parts[m][1])).alias(f"s_{m}") for m in ST7_METRICS]
    )
    return wide.select("rule", F.inline(cells))


@query(
    "J14_dense_cluster_rule_grid",
    f"""WITH {TWO_TASK_SQL}, {S.task_outcomes(S.TWO_TASK)},
    kept AS (
      SELECT event_cluster_id, rule, sum(CAST(selected_material_harm AS DOUBLE)) AS numerator,
        count(*) * 1.0e0 AS denominator FROM td WHERE authorized GROUP BY 1, 2),
    cl AS (SELECT DISTINCT event_cluster_id FROM td), rl AS (SELECT DISTINCT rule FROM td)
    SELECT event_cluster_id, rule, coalesce(numerator, 0.0e0) AS numerator,
      coalesce(denominator, 0.0e0) AS denominator
    FROM cl CROSS JOIN rl LEFT JOIN kept USING (event_cluster_id, rule)""",
    ("numerator", "denominator"),
)
def dense_cluster_rule_grid(spark, directory):
    """Cluster x rule grid with zeros where a rule authorized nothing.

    The grid is an explode of the rule registry over the clusters, and the fill is
    a by-product of the pivot, so nothing is cross joined.
    """
    ruled = task_decisions(spark, directory)
    cells = ruled.groupBy("event_cluster_id", "rule").agg(
        F.sum((F.col("authorized") & F.col("selected_material_harm")).cast("double")).alias("numerator"),
        F.sum(F.col("authorized").cast("double")).alias("denominator"),
    )
    wide, layout = resample.widen(
        cells, ["event_cluster_id"], {r: F.col("rule") == r for r in TASK_NAMES},
        ("numerator", "denominator"),
    )
    return resample.lengthen(wide, ["event_cluster_id"], layout, "rule")


def rank_bootstrap(spark: SparkSession, directory: str, groups: list[str] | None = None,
                   replicates: int = REPLICATES) -> DataFrame:
    """Date-cluster bootstrap of Spearman's rho against the controlled ranking."""
    groups = groups or []
    components = metrics.cluster_components(
        directional(spark, directory), [*groups, "rule"], metrics=(METRIC,)
    )
    wide, layout = resample.widen(
        components, [*groups, "event_cluster_id"],
        {r: F.col("rule") == r for r in TASK_NAMES}, ("numerator", "denominator"),
    )
    values = [c for columns in layout.values() for c in columns.values()]
    drawn = resample.resampled_sums(wide, "event_cluster_id", values, replicates, SEED, groups)
    observed = resample.lengthen(drawn, [*groups, "replicate"], layout, "rule").select(
        *groups, "replicate", "rule",
        F.when(F.col("denominator") > 0, F.try_divide("numerator", "denominator")).alias("observed"),
    )
    scores = observed.join(controlled_scores(spark, directory), "rule")
    rhos = ranks.replicate_rhos(scores, [*groups, "replicate"])
    return ranks.rho_summary(rhos, groups, replicates)


BOOT_RANK_SQL = f"""{SCORES_SQL},
comp AS (
  SELECT event_cluster_id, rule, sum(CAST(authorized AND selected_material_harm AS DOUBLE)) AS num,
    sum(CAST(authorized AS DOUBLE)) AS den FROM dirr GROUP BY 1, 2),
cl AS (
  SELECT event_cluster_id, row_number() OVER (
    ORDER BY md5(CAST(event_cluster_id AS VARCHAR)), event_cluster_id) - 1 AS position
  FROM (SELECT DISTINCT event_cluster_id FROM comp)),
sz AS (SELECT 0 AS g, count(*) AS n FROM cl), {draws_sql("sz", "g")},
bs AS (
  SELECT replicate, rule, sum(num) / nullif(sum(den), 0) AS observed
  FROM draws JOIN cl USING (position) JOIN comp USING (event_cluster_id) GROUP BY 1, 2),
sc AS (SELECT replicate, rule, controlled, observed FROM bs JOIN ctl USING (rule)),
{_rank_sql("sc", "replicate")},
ok AS (SELECT spearman_rho AS rho FROM stat WHERE valid),
rs AS (
  SELECT count(rho) AS valid_replicates,
    count(rho) / {REPLICATES}.0e0 AS valid_replicate_fraction,
    quantile_cont(rho, 0.5) AS spearman_median, quantile_cont(rho, 0.025) AS spearman_lcb95,
    quantile_cont(rho, 0.975) AS spearman_ucb95, avg(CAST(rho < -1e-12 AS DOUBLE)) AS probability_below_zero
  FROM ok)"""
RS = ("valid_replicate_fraction", "spearman_median", "spearman_lcb95", "spearman_ucb95",
      "probability_below_zero")


@query("B6_date_cluster_rank_bootstrap", f"{BOOT_RANK_SQL} SELECT * FROM rs", RS)
def date_cluster_rank_bootstrap(spark, directory):
    return rank_bootstrap(spark, directory)


@query(
    "ST6_rank_transfer_surface",
    f"""SELECT e.*, r.*, probability_below_zero >= 0.95e0 AND exact_p_value <= 0.05e0 AS primary_support
    FROM ({SCORES_SQL}, obs AS (SELECT 1 AS g, rule, {OBS} FROM dirr GROUP BY rule),
      sc AS (SELECT g, rule, controlled, observed FROM obs JOIN ctl USING (rule)),
      {_rank_sql("sc", "g")}, {_PERMUTE}
      SELECT n_rules, valid, reason, spearman_rho AS observed_spearman_rho, count(*) AS permutations,
        avg(CAST(s <= s0 + 1e-9 AS DOUBLE)) AS exact_p_value
      FROM ps JOIN stat USING (g) GROUP BY 1, 2, 3, 4) e,
      ({BOOT_RANK_SQL} SELECT * FROM rs) r""",
    ("observed_spearman_rho", "exact_p_value", *RS),
)
def rank_transfer_surface(spark, directory):
    """Point, exact p and bootstrap of the overall transfer with the support rule."""
    scores = observed_scores(directional(spark, directory), []).join(
        controlled_scores(spark, directory), "rule"
    )
    key = F.lit(1).alias("_k")
    exact = ranks.exact_permutation(scores).select("*", key)
    boot = rank_bootstrap(spark, directory).select("*", key)
    joined = exact.join(boot, "_k").drop("_k")
    support = (F.col("probability_below_zero") >= 0.95) & (F.col("exact_p_value") <= 0.05)
    return joined.withColumn("primary_support", support)


TRANSFER_METRICS = (METRIC, "economic_loss_authorization_rate", "tail_harm_authorization_rate")
TRANSFER_DIMENSIONS = ("model_id", "symbol", "volatility_regime")


def transfer_scores(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Directional decisions against the controlled ranking, per set and per replicate.

    Regimes, decisions and the controlled ranking read lines that were joined to orders once."""
    lines = two_task_lines(spark, directory, "l_shipdate")
    ruled = labels.apply_task_decision(
        rules.decide(with_regime(task_frame(spark, directory, lines)), rules.two_task_rules())
    ).filter(F.col("task_id") == labels.DIRECTIONAL)
    parts = metrics.task_components()
    return transfer.transfer_scores(
        ruled, controlled_scores(spark, directory, lines), {m: parts[m] for m in TRANSFER_METRICS},
        TRANSFER_DIMENSIONS, TASK_NAMES, REPLICATES, SEED,
    )


def _transfer_sql() -> str:
    """CTEs to s0: scores per metric, set, replicate (-1: all rows) and rule."""
    by_metric = " UNION ALL ".join(
        f"SELECT {', '.join(TRANSFER_DIMENSIONS)}, event_cluster_id, rule, '{m}' AS metric, "
        f"sum(CAST({COMPONENTS[m][0]} AS DOUBLE)) AS num, sum(CAST({COMPONENTS[m][1]} AS DOUBLE)) AS den "
        "FROM dirr GROUP BY ALL"
        for m in TRANSFER_METRICS
    )
    by_set = " UNION ALL ".join(
        f"SELECT '{part}' AS part, {member} AS member, event_cluster_id, rule, metric, "
        "sum(num) AS num, sum(den) AS den FROM md GROUP BY ALL"
        for part, member in (("overall", "''"), *((d, d) for d in TRANSFER_DIMENSIONS))
    )
    return f"""{WITH_D}, {REGIME_SQL}, {S.task_outcomes(S.TWO_TASK, "tr")}, {CONTROLLED_SQL},
    md AS ({by_metric}), sets AS ({by_set}),
    cl AS (
      SELECT part, member, event_cluster_id, row_number() OVER (PARTITION BY part, member
        ORDER BY md5(CAST(event_cluster_id AS VARCHAR)), event_cluster_id) - 1 AS position
      FROM (SELECT DISTINCT part, member, event_cluster_id FROM sets)),
    sz AS (SELECT part, member, count(*) AS n FROM cl GROUP BY ALL), {draws_sql("sz", "part, member")},
    w AS (SELECT part, member, replicate, position, count(*) AS w FROM draws GROUP BY ALL),
    bs AS (
      SELECT metric, part, member, replicate, rule, sum(w * num) / nullif(sum(w * den), 0) AS observed
      FROM w JOIN cl USING (part, member, position) JOIN sets USING (part, member, event_cluster_id)
      GROUP BY ALL),
    pt AS (
      SELECT metric, part, member, -1 AS replicate, rule, sum(num) / nullif(sum(den), 0) AS observed
      FROM sets GROUP BY ALL),
    s0 AS (
      SELECT metric, part, member, replicate, rule, controlled, observed
      FROM (SELECT * FROM bs UNION ALL SELECT * FROM pt) JOIN ctl USING (rule))"""


@query(
    "ST6_transfer_views",
    f"""{_transfer_sql()},
    sc AS (SELECT * FROM s0 UNION ALL
      SELECT metric, 'leave_one_out', o.rule, replicate, s.rule, controlled, observed
      FROM s0 s JOIN (SELECT DISTINCT rule FROM s0) o ON s.rule <> o.rule WHERE part = 'overall'),
    {_rank_sql("sc", "metric, part, member, replicate")}, {_PERMUTE.split("ri AS")[0]}
    rl AS (SELECT metric, part, member, list(rx ORDER BY rule) AS xs, list(ry ORDER BY rule) AS ys
      FROM rkd WHERE replicate = -1 GROUP BY ALL),
    ps AS (
      SELECT metric, part, member, list_sum([xs[k] * ys[k] FOR k IN range(1, len(xs) + 1)]) AS s0,
        list_sum([xs[k] * ys[p[k]] FOR k IN range(1, len(xs) + 1)]) AS s
      FROM rl JOIN pm ON len(xs) = 7 OR (len(xs) = 6 AND p[7] = 7)),
    ex AS (
      SELECT metric, part, member, avg(CAST(s <= s0 + 1e-9 AS DOUBLE)) AS exact_p_value
      FROM ps GROUP BY ALL),
    rs AS (
      SELECT metric, part, member, count(spearman_rho) AS valid_replicates,
        count(spearman_rho) / {REPLICATES}.0e0 AS valid_replicate_fraction,
        quantile_cont(spearman_rho, 0.5) AS spearman_median,
        quantile_cont(spearman_rho, 0.025) AS spearman_lcb95,
        quantile_cont(spearman_rho, 0.975) AS spearman_ucb95,
        avg(CASE WHEN valid THEN CAST(spearman_rho < -1e-12 AS DOUBLE) END) AS probability_below_zero
      FROM stat WHERE replicate >= 0 GROUP BY ALL),
    rn AS (SELECT part, member, n AS clusters FROM sz
      UNION ALL SELECT 'leave_one_out', rule, n FROM sz, (SELECT DISTINCT rule FROM s0) WHERE part = 'overall')
    SELECT metric, part, member, n_rules, valid, reason, spearman_rho, kendall_tau_b,
      CASE WHEN valid THEN exact_p_value END AS exact_p_value, valid_replicates, valid_replicate_fraction,
      spearman_median, spearman_lcb95, spearman_ucb95, probability_below_zero, clusters,
      CASE WHEN part = 'overall' THEN probability_below_zero >= 0.95e0
        AND CASE WHEN valid THEN exact_p_value END <= 0.05e0 END AS primary_support
    FROM stat JOIN ex USING (metric, part, member) JOIN rs USING (metric, part, member)
      JOIN rn USING (part, member) WHERE replicate = -1""",
    ("spearman_rho", "kendall_tau_b", "exact_p_value", *RS),
)
def transfer_views(spark, directory):
    """Three metrics over all rows, with each rule left out, and per model, symbol and
    volatility regime."""
    return transfer.transfer_views(*transfer_scores(spark, directory), TASK_NAMES, REPLICATES)


@query(
    "ST6_transfer_pairs",
    f"""{_transfer_sql()},
    pr AS (
      SELECT metric, replicate, a.rule AS rule_a, b.rule AS rule_b,
        a.controlled - b.controlled AS controlled_delta, a.observed - b.observed AS observed_delta
      FROM (SELECT * FROM s0 WHERE part = 'overall') a JOIN (SELECT * FROM s0 WHERE part = 'overall') b
        USING (metric, replicate) WHERE a.rule < b.rule),
    q AS (
      SELECT *, CASE WHEN controlled_delta IS NULL OR observed_delta IS NULL THEN 'pair_missing_n_a'
        WHEN abs(controlled_delta) <= 1e-8 OR abs(observed_delta) <= 1e-8 THEN 'pair_tied_n_a' END AS reason
      FROM pr),
    z AS (SELECT *, CASE WHEN reason IS NULL THEN controlled_delta * observed_delta < 0 END AS reversal FROM q),
    rs AS (
      SELECT metric, rule_a, rule_b, count(reversal) / {REPLICATES}.0e0 AS valid_replicate_fraction,
        avg(CAST(reversal AS DOUBLE)) AS probability_of_reversal,
        quantile_cont(observed_delta, 0.025) AS observed_delta_lcb95,
        quantile_cont(observed_delta, 0.975) AS observed_delta_ucb95
      FROM z WHERE replicate >= 0 GROUP BY ALL)
    SELECT z.* EXCLUDE (replicate), reason IS NULL AS valid, rs.* EXCLUDE (metric, rule_a, rule_b)
    FROM z JOIN rs USING (metric, rule_a, rule_b) WHERE replicate = -1""",
    ("controlled_delta", "observed_delta", "valid_replicate_fraction", "probability_of_reversal",
     "observed_delta_lcb95", "observed_delta_ucb95"),
)
def transfer_pairs(spark, directory):
    return transfer.transfer_pairs(*transfer_scores(spark, directory), REPLICATES)


SYMBOL_PAIR_SQL = PAIR_SQL.replace(
    "SELECT event_cluster_id,", "SELECT symbol, event_cluster_id,", 1
).replace("FROM d GROUP BY 1)", "FROM d GROUP BY 1, 2)", 1)


@query(
    "ST8_prior_family_tests",
    f"""{SYMBOL_PAIR_SQL},
    long AS (
      SELECT symbol, 'false_authorization_difference' AS measure,
        false_authorization_difference AS v FROM pd
      UNION ALL SELECT symbol, 'laundering_difference', laundering_difference FROM pd)
    SELECT symbol, measure, count(v) AS clusters, avg(v) AS mean_difference,
      stddev_samp(v) AS standard_deviation FROM long GROUP BY 1, 2""",
    ("mean_difference", "standard_deviation"),
)
def prior_family_tests(spark, directory):
    return family_tests(spark, directory).select(
        "symbol", "measure", "clusters", "mean_difference", "standard_deviation"
    )


def family_tests(spark: SparkSession, directory: str) -> DataFrame:
    wide = metrics.paired_burdens(core_decisions(spark, directory), *PAIR, groups=["symbol"])
    cells = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES]
    )
    return ranks.t_test(wide.select("symbol", F.inline(cells)), "v", ["symbol", "measure"])


@query(
    "ST8_W13_family_tests_with_holm",
    f"""{pair_tests_sql(SYMBOL_PAIR_SQL, "symbol", "measure")} SELECT symbol, measure, mean_difference,
      raw_p, holm_adjusted_p, holm_threshold, reject FROM hm""",
    ("mean_difference", "raw_p", "holm_adjusted_p", "holm_threshold"),
)
def family_tests_with_holm(spark, directory):
    tests = family_tests(spark, directory).withColumn(
        "name", F.concat_ws(":", "symbol", "measure")
    )
    return ranks.holm(tests).select(
        "symbol", "measure", "mean_difference", "raw_p", "holm_adjusted_p", "holm_threshold",
        "reject",
    )


@query(
    "W13_holm_step_down",
    f"""{WITH_D}, p AS (
      SELECT rule AS name, avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) / 10
        AS raw_p FROM d GROUP BY 1),
    o AS (
      SELECT *, count(*) OVER () - row_number() OVER (ORDER BY raw_p, name) + 1 AS m
      FROM p WHERE raw_p IS NOT NULL)
    SELECT name, raw_p, 0.05e0 / m AS holm_threshold,
      max(least(1.0e0, raw_p * m)) OVER w AS holm_adjusted_p,
      bool_and(raw_p <= 0.05e0 / m) OVER w AS reject
    FROM o WINDOW w AS (ORDER BY raw_p, name ROWS UNBOUNDED PRECEDING)""",
    ("raw_p", "holm_threshold", "holm_adjusted_p"),
)
def holm_step_down(spark, directory):
    p = core_decisions(spark, directory).groupBy(F.col("rule").alias("name")).agg(
        (F.avg(F.when(F.col("authorized"), F.col("selected_harm").cast("double"))) / 10).alias(
            "raw_p"
        )
    )
    return ranks.holm(p.dropna()).select(
        "name", "raw_p", "holm_threshold", "holm_adjusted_p", "reject"
    )


@query("ST11_design_power")
def design_power(spark, directory):
    """Power and needed clusters from the measured spread of paired differences."""
    effects = {"false_authorization_difference": 0.015, "laundering_difference": 0.020}
    measured = burdens(spark, directory).agg(
        *[F.count(m).alias(f"n_{m}") for m in MEASURES],
        *[F.stddev_samp(m).alias(f"s_{m}") for m in MEASURES],
    ).first()
    rows = [
        (m, measured[f"n_{m}"], measured[f"s_{m}"],
         ranks.two_sided_power(e, measured[f"s_{m}"], measured[f"n_{m}"]),
         ranks.required_clusters(e, measured[f"s_{m}"], 0.8))
        for m, e in effects.items()
    ]
    return spark.createDataFrame(
        rows, "measure STRING, clusters BIGINT, standard_deviation DOUBLE, power DOUBLE, "
        "required_clusters INT"
    )


def rank_signal(bounds: DataFrame, coverage: DataFrame, floor: float = 0.05) -> DataFrame:
    """Active rules, between-rule signal, median standard error and attenuation."""
    active = coverage.filter(F.col("coverage") >= floor).select("rule")
    chosen = bounds.filter(F.col("profile") == "overall").join(active, "rule", "left_semi")
    mid = 0.5 * (F.col("cau_lcb95") + F.col("cau_ucb95"))
    se = (F.col("cau_ucb95") - F.col("cau_lcb95")) / (2.0 * 1.645)
    spread = chosen.agg(
        F.count("*").cast("int").alias("active_rules"),
        F.coalesce(F.stddev_samp(mid), F.lit(0.0)).alias("signal"),
        F.percentile(se, 0.5).alias("noise"),
    )
    s, n = F.col("signal"), F.col("noise")
    return spread.withColumn(
        "attenuation",
        F.when((s > 0) & n.isNotNull(), s / F.sqrt(s * s + n * n)).otherwise(F.lit(0.0)),
    )


#: Draws of the rank-power simulation; the published power 0.164 and bound 0.160 fit 25,000 to 50,000.
POWER_REPLICATES = 50_000


@query("ST12_ST13_power_gate")
def power_gate(spark, directory, target: float = 0.5, replicates: int = POWER_REPLICATES, alpha: float = 0.05):
    """Simulated power to see a rank correlation of `target` under the measured attenuation,
    and the six conditions.  Coverage and bounds come from the validation split; of the
    test split only clusters are counted, each symbol a source."""
    view = decision_view(spark, directory)
    access = rules.feature_access(
        view, rules.core_rules(), "coverage", legal=("candidate_action", "confidence", *rules.CHECKLIST_FEATURES),
        forbidden=GLOBAL_FORBIDDEN, identifiers=IDENTIFIERS,
    )
    validated = core_decisions(spark, directory).filter(F.col("split") == "validation")
    overall = {"overall": F.col("certification_eligible")}
    coverage = metrics.profile_metrics(validated, overall, tail=False).select("rule", "coverage").join(
        access.filter(F.col("classification") == "deployable"), "rule", "left_semi"
    )
    bounds = resample.cluster_bootstrap_bounds(
        metrics.cluster_sums(labels.explode_profiles(validated, overall)), CORE_NAMES, REPLICATES, SEED
    )
    signal = materialize(rank_signal(bounds, coverage))
    power = ranks.rank_power(signal, target, replicates, SEED, alpha)
    tested = materialize(view.filter(F.col("split") == "test").select("symbol", "event_cluster_id").distinct())
    least = tested.groupBy("symbol").count().agg(
        F.coalesce(F.min("count") >= 500, F.lit(False)).alias("test_clusters_per_source")
    )
    clusters = tested.agg(F.countDistinct("event_cluster_id").alias("test_clusters")).crossJoin(least)
    checks = point_in_time_audit(spark, directory).agg(
        F.coalesce(F.every("passed"), F.lit(True)).alias("point_in_time_checks")
    )
    legal = access.agg(F.every(F.col("status") == "VALID").alias("feature_access"))
    gate = power.crossJoin(clusters).crossJoin(checks).crossJoin(legal)
    return ranks.gate_conditions(
        gate, further=("test_clusters_per_source", "point_in_time_checks", "feature_access")
    )


@query(
    "ST13_confirmatory_gate",
    f"""WITH checks AS ({ORACLES["AU1_point_in_time_audit"]}),
    access AS ({ORACLES["R25_feature_access_audit"]}),
    active AS ({WITH_D} SELECT symbol AS source, count(*) AS n FROM (
      SELECT symbol, rule, avg(CAST(authorized AS DOUBLE)) AS coverage FROM d
      WHERE certification_eligible GROUP BY 1, 2) WHERE coverage >= 0.05e0
        AND rule IN (SELECT rule FROM access WHERE status = 'VALID') GROUP BY 1),
    clusters AS (WITH {DECISION_SQL} SELECT symbol AS source, count(DISTINCT event_cluster_id) AS c
      FROM v WHERE split = 'test' GROUP BY 1)
    SELECT *, CASE WHEN point_in_time_checks AND test_clusters_per_source AND test_clusters_combined
        AND active_rule_configurations AND validation_power AND feature_access
      THEN 'confirmatory_eligible' ELSE 'exploratory_only' END AS classification
    FROM (SELECT (SELECT bool_and(passed) FROM checks) AS point_in_time_checks,
      min(c) >= 500 AS test_clusters_per_source, sum(c) >= 500 AS test_clusters_combined,
      min(coalesce(n, 0)) >= 4 AS active_rule_configurations, FALSE AS validation_power,
      (SELECT bool_and(status = 'VALID') FROM access) AS feature_access
      FROM clusters LEFT JOIN active USING (source))""",
)
def confirmatory_gate(spark, directory, power_lcb95: float = 0.160):
    """All six conditions, each symbol a source, for a given bound of the power."""
    access = feature_access_audit(spark, directory).select("rule", "status")
    legal = access.filter(F.col("status") == "VALID").select("rule")
    coverage = core_decisions(spark, directory).filter("certification_eligible").groupBy(
        F.col("symbol").alias("source"), "rule"
    ).agg(F.avg(F.col("authorized").cast("double")).alias("coverage"))
    active = coverage.filter(F.col("coverage") >= 0.05).join(legal, "rule", "left_semi").groupBy("source").agg(
        F.count("*").alias("active_rules")
    )
    sources = decision_view(spark, directory).filter(F.col("split") == "test").groupBy(
        F.col("symbol").alias("source")
    ).agg(F.countDistinct("event_cluster_id").alias("test_clusters")).join(active, "source", "left").select(
        "source", "test_clusters", F.coalesce("active_rules", F.lit(0)).alias("active_rules"),
        F.lit(power_lcb95).alias("power_lcb95"),
    )
    return ranks.confirmatory_gate(sources, point_in_time_audit(spark, directory), access)


FAMILY_SQL = f"""{WITH_D}, m AS (
  SELECT symbol AS generator_family, rule, avg(CAST(authorized AS DOUBLE)) AS coverage,
    avg(CASE WHEN authorized THEN CAST(selected_harm AS DOUBLE) END) AS far,
    avg(CASE WHEN authorized THEN CAST(selected_laundering AS DOUBLE) END) AS alr
  FROM d WHERE certification_eligible GROUP BY 1, 2),
fam AS (
  SELECT generator_family, rule, coverage, far, avg(CAST(coalesce(far <= h AND alr <= a AND coverage >= c,
      FALSE) AS DOUBLE)) AS worst_profile_certification_volume
  FROM m, (SELECT unnest([0.05e0,0.1e0,0.15e0,0.2e0,0.25e0,0.3e0]) AS h),
    (SELECT unnest([0.0e0,0.01e0,0.02e0,0.05e0]) AS a),
    (SELECT unnest([0.05e0,0.1e0,0.2e0,0.3e0,0.5e0]) AS c) GROUP BY 1, 2, 3, 4)"""


def family_summary(spark: SparkSession, directory: str) -> DataFrame:
    """Rule metrics and grid volume per family, with point rates as the bounds."""
    m = metrics.profile_metrics(
        core_decisions(spark, directory).withColumn("generator_family", F.col("symbol")),
        {"overall": F.col("certification_eligible")}, ["generator_family", "rule"], tail=False,
    )
    points = m.select(
        "generator_family", "rule", "coverage", "far",
        F.col("far").alias("far_ucb95"), F.col("alr").alias("alr_ucb95"),
        F.col("coverage").alias("coverage_lcb95"),
    )
    keys = ["generator_family", "rule"]
    volumes = certify.certification_volume(certify.certification_surface(points, keys), keys)
    return points.select(*keys, "coverage", "far").join(
        volumes.withColumnRenamed("certification_volume", "worst_profile_certification_volume"), keys
    )


@query(
    "A20_family_ranges",
    f"""{FAMILY_SQL} SELECT rule, min(coverage) AS min_coverage, max(coverage) AS max_coverage,
      min(far) AS min_far, max(far) AS max_far,
      min(worst_profile_certification_volume) AS min_certification,
      max(worst_profile_certification_volume) AS max_certification,
      max(coverage) - min(coverage) AS coverage_range, max(far) - min(far) AS far_range,
      max(worst_profile_certification_volume) - min(worst_profile_certification_volume)
        AS certification_range FROM fam GROUP BY 1""",
    ("min_coverage", "max_coverage", "min_far", "max_far", "min_certification",
     "max_certification", "coverage_range", "far_range", "certification_range"),
)
def family_ranges(spark, directory):
    return metrics.family_ranges(family_summary(spark, directory))


@query(
    "A21_rank_reversal_families",
    f"""{FAMILY_SQL}, f AS (
      SELECT *, coalesce(far = min(far) OVER w, FALSE) AS low,
        worst_profile_certification_volume = max(worst_profile_certification_volume) OVER w AS high,
        max(worst_profile_certification_volume) OVER w AS best
      FROM fam WINDOW w AS (PARTITION BY generator_family)),
    g AS (SELECT generator_family, NOT bool_or(low AND high) AS reversed, max(best) > 0 AS certified
      FROM f GROUP BY 1)
    SELECT count(*) AS generator_count, count(*) FILTER (WHERE reversed) AS rank_reversal_family_count,
      count(*) FILTER (WHERE certified) AS families_with_certification FROM g""",
)
def rank_reversal_families(spark, directory):
    return metrics.rank_reversal_families(family_summary(spark, directory))


@query(
    "W3_average_ranks",
    f"""{SCORES_SQL}, obs AS (SELECT model_id, rule, {OBS} FROM dirr GROUP BY 1, 2)
    SELECT model_id, rule, observed, rank() OVER (PARTITION BY model_id ORDER BY observed)
      + (count(*) OVER (PARTITION BY model_id, observed) - 1) / 2.0e0 AS average_rank FROM obs
    WHERE observed IS NOT NULL""",
    ("observed", "average_rank"),
)
def average_ranks(spark, directory):
    from verdigate.operators.distributed import average_rank

    scores = observed_scores(directional(spark, directory), ["model_id"]).dropna()
    return scores.withColumn("average_rank", average_rank("observed", ["model_id"]))


@query(
    "ST18_jensen_shannon_drift",
    """WITH e AS (
      SELECT event_type AS action, CAST(user_id % 5 AS VARCHAR) AS model_id,
        week(ts) AS period, value FROM events),
    b AS (SELECT model_id, min(period) AS first_period, max(period) AS last_period
      FROM e GROUP BY 1),
    f AS (SELECT model_id, action, count(*) AS n FROM e JOIN b USING (model_id)
      WHERE period = first_period GROUP BY 1, 2),
    l AS (SELECT model_id, action, count(*) AS n FROM e JOIN b USING (model_id)
      WHERE period = last_period GROUP BY 1, 2),
    j AS (
      SELECT model_id, action, coalesce(f.n, 0) * 1.0e0 / sum(coalesce(f.n, 0)) OVER w AS p,
        coalesce(l.n, 0) * 1.0e0 / sum(coalesce(l.n, 0)) OVER w AS q
      FROM f FULL JOIN l USING (model_id, action) WINDOW w AS (PARTITION BY model_id)),
    s AS (
      SELECT model_id, 0.5e0 * sum(CASE WHEN p > 0 THEN p * log2(p / (0.5e0 * (p + q))) ELSE 0 END)
        + 0.5e0 * sum(CASE WHEN q > 0 THEN q * log2(q / (0.5e0 * (p + q))) ELSE 0 END) AS js
      FROM j GROUP BY 1),
    m AS (
      SELECT model_id, avg(value) FILTER (WHERE period = last_period)
        - avg(value) FILTER (WHERE period = first_period) AS d,
        count(*) FILTER (WHERE period = first_period) AS first_proposals,
        count(*) FILTER (WHERE period = last_period) AS last_proposals
      FROM e JOIN b USING (model_id) GROUP BY 1)
    SELECT model_id, CAST(first_period AS INTEGER) AS first_period,
      CAST(last_period AS INTEGER) AS last_period, first_proposals, last_proposals,
      d AS value_difference_last_minus_first, js AS action_distribution_jensen_shannon_bits
    FROM b JOIN s USING (model_id) JOIN m USING (model_id)""",
    ("value_difference_last_minus_first", "action_distribution_jensen_shannon_bits"),
)
def jensen_shannon(spark, directory):
    from verdigate.sources.ingest import table

    events = table(spark, directory, "events").select(
        F.col("event_type").alias("action"),
        (F.col("user_id") % 5).cast("string").alias("model_id"),
        F.weekofyear("ts").alias("period"), "value",
    )
    return jensen_shannon_drift(events, ["model_id"], "period", "action", ["value"])
