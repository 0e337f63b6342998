"""Grouped metrics.  Additive parts are combined map-side on disjoint cells and
only then spread over overlapping profiles, so the shuffle carries a few rows per
rule whatever the size of the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigate.functions.columns import is_close, is_true, rate, sum_or_zero
from verdigate.operators.distributed import wide_quantiles
from verdigate.operators.labels import DIRECTIONAL, RISK_LIMIT, in_profiles
from verdigate.operators.rules import AUTHORIZED, EXAMPLE_THRESHOLDS, Rule


def _is(route: str) -> Column:
    return F.col("decision") == route


def _profile_sums() -> dict[str, Column]:
    taken = F.col("authorized")
    return {
        "rows": F.count("*"),
        "authorized_count": F.count_if(taken),
        "executes": F.count_if(_is("execute")),
        "reduces": F.count_if(_is("reduce")),
        "reviews": F.count_if(_is("review")),
        "abstains": F.count_if(_is("abstain")),
        "harms": F.count_if(F.col("selected_harm")),
        "launderings": F.count_if(F.col("selected_laundering")),
        "cau": sum_or_zero(F.when(taken, F.col("selected_utility"))),
        "moc": sum_or_zero(F.col("missed_opportunity")),
    }


def profile_metrics(
    ruled: DataFrame,
    memberships: Mapping[str, Column],
    groups: Sequence[str] = ("rule",),
    tail: bool = True,
    direct_rule: str | None = None,
) -> DataFrame:
    """Coverage, routes, harm, laundering, utility and tail per group and profile.

    `ruled` carries decision outcomes.  Rates over authorized rows are NULL when
    nothing was authorized; sums are zero.
    """
    groups = list(groups)
    flags = {f"_in_{name}": is_true(test) for name, test in memberships.items()}
    cells = (
        ruled.withColumns(flags)
        .groupBy(*groups, *flags)
        .agg(*[c.alias(n) for n, c in _profile_sums().items()])
    )
    names = F.filter(
        F.array(*[F.when(F.col(f"_in_{n}"), F.lit(n)) for n in memberships]),
        lambda n: n.isNotNull(),
    )
    sums = (
        cells.select("*", F.explode(names).alias("profile"))
        .groupBy(*groups, "profile")
        .agg(*[F.sum(n).alias(n) for n in _profile_sums()])
    )
    n, taken = F.col("rows"), F.col("authorized_count")
    out = sums.select(
        *groups,
        "profile",
        "rows",
        "authorized_count",
        (taken / n).alias("coverage"),
        (F.col("executes") / n).alias("execute_rate"),
        (F.col("reduces") / n).alias("reduce_rate"),
        (F.col("reviews") / n).alias("review_rate"),
        (F.col("abstains") / n).alias("abstain_rate"),
        F.try_divide(F.col("harms"), taken).alias("far"),
        F.try_divide(F.col("launderings"), taken).alias("alr"),
        "cau",
        F.try_divide(F.col("cau"), taken.cast("double")).alias("upa"),
        "moc",
        (taken == 0).alias("zero_action"),
        (taken == 0).alias("n_a_execution_metric"),
    )
    if not tail:
        return out
    tails = tail_adjustment(ruled, memberships, groups, direct_rule)
    return out.join(tails, [*groups, "profile"])


def tail_adjustment(
    ruled: DataFrame, memberships: Mapping[str, Column], groups: Sequence[str] = ("rule",),
    direct_rule: str | None = None,
) -> DataFrame:
    """Fifth percentile of selected utility minus that of full utility.

    A rule that executes everything selects the full utility, so naming one as
    `direct_rule` saves the second quantile pass.
    """
    groups = list(groups)
    names = F.filter(
        F.array(*[F.when(is_true(t), F.lit(n)) for n, t in memberships.items()]),
        lambda n: n.isNotNull(),
    )
    profiled = ruled.withColumn("profile", F.explode(names))
    keys = [*groups, "profile"]
    selected = wide_quantiles(profiled, keys, "selected_utility", {"selected": 0.05})
    if direct_rule is not None:
        others = Window.partitionBy(*[k for k in keys if k != "rule"])
        base = F.max(F.when(F.col("rule") == direct_rule, F.col("selected"))).over(others)
        return selected.select(*keys, (F.col("selected") - base).alias("tla"))
    full = wide_quantiles(profiled, keys, "full_utility", {"full": 0.05})
    return selected.join(full, keys).select(
        *keys, (F.col("selected") - F.col("full")).alias("tla")
    )


def _laundering_aggregates() -> dict[str, Column]:
    taken = F.col("authorized")
    safe = F.col("positive_safe_delegation")
    leaked = F.col("selected_indirect_leakage")
    return {
        "rows": F.count("*"),
        "authorized_count": F.count_if(taken),
        "coverage": F.avg(taken.cast("double")),
        "far": rate(F.col("selected_harm"), taken),
        "alr": rate(F.col("selected_laundering"), taken),
        "direct_leakage_rate": rate(F.col("selected_direct_leakage"), taken),
        "indirect_leakage_rate": rate(leaked, taken),
        "authority_laundering_count": F.count_if(leaked),
        "laundering_harm_rate": rate(F.col("selected_harm"), leaked),
        "safe_delegation_count": F.count_if(safe),
        "safe_delegation_coverage": rate(taken, safe),
        "false_block_rate": rate(F.col("false_block"), safe),
        "cau": sum_or_zero(F.when(taken, F.col("selected_utility"))),
        "moc": sum_or_zero(F.col("missed_opportunity")),
        "review_rate": F.avg(_is("review").cast("double")),
        "abstain_rate": F.avg(_is("abstain").cast("double")),
        "zero_action": F.count_if(taken) == 0,
    }


def laundering_metrics(ruled: DataFrame, groups: Sequence[str]) -> DataFrame:
    return ruled.groupBy(*groups).agg(
        *[c.alias(n) for n, c in _laundering_aggregates().items()]
    )


def laundering_breakdowns(ruled: DataFrame) -> DataFrame:
    """Five breakdowns in one GROUPING SETS pass, tagged by `breakdown`.

    Noise rates are meant for role-noise rows and hop depth for multi-hop rows.
    Their keys are NULL elsewhere, and those groups are dropped after the
    aggregation, which has then scanned the table once for all five.
    """
    noisy = is_true(F.col("attack_type") == "role_noise")
    hopped = is_true(F.col("attack_type") == "multi_hop")
    keyed = ruled.withColumns(
        {
            "noise_key": F.when(noisy, F.col("role_noise_rate")),
            "hop_key": F.when(hopped, F.col("hop_depth")),
            "is_noise": noisy,
            "is_hop": hopped,
        }
    )
    keys = ["rule", "attack_type", "traceability", "is_noise", "noise_key", "is_hop", "hop_key"]
    sets = {
        "rule": ["rule"],
        "attack": ["rule", "attack_type"],
        "traceability": ["rule", "traceability"],
        "noise": ["rule", "is_noise", "noise_key"],
        "hop": ["rule", "is_hop", "hop_key", "traceability"],
    }
    grouped = keyed.groupingSets(
        [[F.col(c) for c in s] for s in sets.values()], *[F.col(c) for c in keys]
    ).agg(
        F.grouping_id().alias("_gid"),
        *[c.alias(n) for n, c in _laundering_aggregates().items()],
    )
    label = F.lit(None).cast("string")
    for name, s in sets.items():
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        label = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(label)
    tagged = grouped.withColumn("breakdown", label)
    return tagged.filter(
        ((F.col("breakdown") != "noise") | is_true(F.col("is_noise")))
        & ((F.col("breakdown") != "hop") | is_true(F.col("is_hop")))
    ).select(
        "breakdown", "rule", "attack_type", "traceability",
        F.col("noise_key").alias("role_noise_rate"), F.col("hop_key").alias("hop_depth"),
        *_laundering_aggregates(),
    )


def _task_aggregates() -> dict[str, Column]:
    taken = F.col("authorized")
    in_dir = taken & (F.col("task_id") == DIRECTIONAL)
    in_risk = taken & (F.col("task_id") == RISK_LIMIT)
    benign = F.col("candidate_benign_opportunity")
    return {
        "rows": F.count("*"),
        "clusters": F.countDistinct("event_cluster_id"),
        "coverage": F.avg(taken.cast("double")),
        "execute_rate": F.avg(_is("execute").cast("double")),
        "reduce_rate": F.avg(_is("reduce").cast("double")),
        "review_rate": F.avg(_is("review").cast("double")),
        "abstain_rate": F.avg(_is("abstain").cast("double")),
        "economic_loss_authorization_rate": rate(F.col("selected_economic_loss"), in_dir),
        "material_harm_authorization_rate": rate(F.col("selected_material_harm"), taken),
        "tail_harm_authorization_rate": rate(F.col("selected_tail_harm"), in_dir),
        "risk_event_authorization_rate": rate(F.col("selected_risk_event"), in_risk),
        "material_risk_event_authorization_rate": rate(
            F.col("selected_material_risk_event"), in_risk
        ),
        "authority_violation_rate": rate(F.col("authority_violation"), taken),
        "normalized_task_utility": F.avg("selected_normalized_task_utility"),
        "raw_task_utility": sum_or_zero(F.col("selected_task_utility")),
        "missed_benign_opportunity": rate(F.col("missed_benign"), benign),
        "authorized_count": F.count_if(taken),
        "directional_authorized_count": F.count_if(in_dir),
        "risk_authorized_count": F.count_if(in_risk),
        "benign_opportunity_count": F.count_if(benign),
    }


def task_metrics(ruled: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The two-task metric row (20 fields) per group."""
    return ruled.groupBy(*groups).agg(*[c.alias(n) for n, c in _task_aggregates().items()])


def subgroup_metrics(ruled: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Two-task metrics for every value of every dimension, one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
    )
    long = ruled.select("*", F.inline(pairs)).filter(F.col("value").isNotNull())
    return task_metrics(long, ["rule", "dimension", "value"])


CLUSTER_SUMS = ("rows", "authorized", "harmful", "laundering", "utility")


def cluster_sums(
    ruled: DataFrame, groups: Sequence[str] = ("rule", "profile"),
    cluster: str = "event_cluster_id",
) -> DataFrame:
    """Row, authorization, harm, laundering and utility sums per cluster.

    The one shuffle that grows with the number of clusters; rows are combined
    before it, so a cluster holding a third of the table sends one row per task.
    """
    return (
        ruled.filter(F.col(cluster).isNotNull())
        .groupBy(*groups, cluster)
        .agg(
            F.count("*").alias("rows"),
            F.count_if("authorized").alias("authorized"),
            F.count_if("selected_harm").alias("harmful"),
            F.count_if("selected_laundering").alias("laundering"),
            sum_or_zero(F.col("selected_utility")).alias("utility"),
        )
    )


def wide_cluster_sums(
    df: DataFrame, registry: Sequence[Rule], memberships: Mapping[str, Column], cluster: str = "event_cluster_id",
) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """The sums of `cluster_sums` per profile and cluster, all rules in columns, and the
    column of each rule's sums.

    Rules are decided in columns too, so rows times rules are neither made nor shuffled."""
    decided = df.filter(F.col(cluster).isNotNull()).select(
        cluster, "full_utility", "reduced_utility", is_true(F.col("original_source_eligible")).alias("_genuine"),
        in_profiles(memberships).alias("_profiles"),
        *[r.build(EXAMPLE_THRESHOLDS).alias(f"_d{i}") for i, r in enumerate(registry)],
    )
    taken, earned = [], []
    for i in range(len(registry)):
        route = F.col(f"_d{i}")
        taken.append(is_true(route.isin(*AUTHORIZED)).alias(f"_t{i}"))
        earned.append(
            F.when(route == "execute", F.col("full_utility")).when(route == "reduce", F.col("reduced_utility"))
            .otherwise(F.lit(0.0)).alias(f"_u{i}")
        )
    profiled = decided.select(cluster, "_genuine", *taken, *earned, F.explode("_profiles").alias("profile"))
    sums, layout = [F.count("*").cast("double").alias("rows")], {}
    for i, r in enumerate(registry):
        t, u = F.col(f"_t{i}"), F.col(f"_u{i}")
        parts = {
            "authorized": F.count_if(t), "harmful": F.count_if(t & is_true(u < 0)),
            "laundering": F.count_if(t & ~F.col("_genuine")), "utility": sum_or_zero(u),
        }
        layout[r.name] = {"rows": "rows", **{f: f"c{i}_{f}" for f in parts}}
        sums += [c.cast("double").alias(layout[r.name][f]) for f, c in parts.items()]
    return profiled.groupBy("profile", cluster).agg(*sums), layout


def task_components() -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator of each two-task metric, per row."""
    taken = F.col("authorized")
    in_dir = taken & (F.col("task_id") == DIRECTIONAL)
    in_risk = taken & (F.col("task_id") == RISK_LIMIT)
    one = F.lit(True)

    def flag(c: Column) -> Column:
        return c.cast("double")

    return {
        "coverage": (flag(taken), flag(one)),
        "economic_loss_authorization_rate": (
            flag(in_dir & F.col("selected_economic_loss")), flag(in_dir)),
        "material_harm_authorization_rate": (
            flag(taken & F.col("selected_material_harm")), flag(taken)),
        "tail_harm_authorization_rate": (
            flag(in_dir & F.col("selected_tail_harm")), flag(in_dir)),
        "risk_event_authorization_rate": (
            flag(in_risk & F.col("selected_risk_event")), flag(in_risk)),
        "material_risk_event_authorization_rate": (
            flag(in_risk & F.col("selected_material_risk_event")), flag(in_risk)),
        "authority_violation_rate": (flag(F.col("authority_violation")), flag(taken)),
        "normalized_task_utility": (F.col("selected_normalized_task_utility"), flag(one)),
        "missed_benign_opportunity": (
            flag(F.col("missed_benign")), flag(F.col("candidate_benign_opportunity"))),
        "review_rate": (flag(_is("review")), flag(one)),
    }


def cluster_components(
    ruled: DataFrame, groups: Sequence[str], cluster: str = "event_cluster_id",
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Numerator and denominator sums per group, cluster and metric (long form).

    Summed wide first, so the metrics multiply cluster rows, not input rows.
    """
    parts = {k: v for k, v in task_components().items() if metrics is None or k in metrics}
    aggregates = []
    for name, (num, den) in parts.items():
        aggregates += [F.sum(num).alias(f"n_{name}"), F.sum(den).alias(f"d_{name}")]
    wide = ruled.filter(F.col(cluster).isNotNull()).groupBy(*groups, cluster).agg(*aggregates)
    long = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"n_{m}").alias("numerator"),
                F.col(f"d_{m}").alias("denominator"),
            )
            for m in parts
        ]
    )
    return wide.select(*groups, cluster, F.inline(long))


def _cluster_rates(scored: DataFrame, groups: Sequence[str], cluster: str) -> DataFrame:
    taken = F.col("authorized")
    return scored.groupBy(*groups, cluster).agg(
        F.count("*").alias("rows"),
        F.count_if(taken).alias("authorized_count"),
        F.avg(taken.cast("double")).alias("coverage"),
        rate(F.col("authorization_harm") == 1, taken).alias("far"),
        rate(is_true(F.col("authority_laundering")), taken).alias("alr"),
        sum_or_zero(F.when(taken, F.col("full_utility"))).alias("cau"),
    )


def cluster_rate_metrics(
    scored: DataFrame, groups: Sequence[str], cluster: str = "evaluation_cluster_id"
) -> DataFrame:
    """Mean over clusters of cluster rates; clusters without authorization do not
    count towards harm and laundering.  Not the pooled rate."""
    return (
        _cluster_rates(scored, groups, cluster)
        .groupBy(*groups)
        .agg(
            F.sum("rows").alias("rows"),
            F.count("*").alias("clusters"),
            F.sum("authorized_count").alias("authorized_count"),
            F.avg("coverage").alias("coverage"),
            F.avg("far").alias("far"),
            F.avg("alr").alias("alr"),
            F.avg("cau").alias("cau"),
        )
    )


def cluster_rate_bounds(
    scored: DataFrame, groups: Sequence[str], z: float = 1.645,
    cluster: str = "evaluation_cluster_id",
) -> DataFrame:
    """Mean-of-cluster-rate metrics with normal bounds clipped to [0, 1]."""

    def bound(c: str, sign: float) -> Column:
        m, n = F.avg(c), F.count(c)
        se = F.stddev_samp(c) / F.sqrt(n)
        edge = F.least(F.greatest(m + F.lit(sign * z) * se, F.lit(0.0)), F.lit(1.0))
        return F.when(n == 1, m).otherwise(edge)

    return (
        _cluster_rates(scored, groups, cluster)
        .groupBy(*groups)
        .agg(
            F.sum("rows").alias("rows"),
            F.count("*").alias("clusters"),
            F.sum("authorized_count").alias("authorized_count"),
            F.avg("coverage").alias("coverage"),
            bound("coverage", -1.0).alias("coverage_lcb95"),
            F.avg("far").alias("far"),
            bound("far", 1.0).alias("far_ucb95"),
            F.avg("alr").alias("alr"),
            bound("alr", 1.0).alias("alr_ucb95"),
            F.avg("cau").alias("cau"),
        )
    )


def review_workload(ruled: DataFrame, groups: Sequence[str]) -> DataFrame:
    """What sits in the review queue and what it would have done if executed."""
    queued = _is("review")
    harmful = is_true(F.col("full_utility") < 0)
    safe = is_true(F.col("best_safe_utility") > 0) & is_true(F.col("original_source_eligible"))
    return ruled.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        F.count_if(queued).alias("review_count"),
        F.avg(queued.cast("double")).alias("review_rate"),
        F.avg(_is("execute").cast("double")).alias("execute_rate"),
        F.avg(_is("reduce").cast("double")).alias("reduce_rate"),
        F.avg(_is("abstain").cast("double")).alias("abstain_rate"),
        sum_or_zero(F.when(F.col("authorized"), F.col("selected_utility"))).alias(
            "authorized_utility"
        ),
        sum_or_zero(F.col("missed_opportunity")).alias("missed_opportunity"),
        rate(harmful, queued).alias("review_if_executed_harm_rate"),
        rate(safe, queued).alias("review_safe_opportunity_rate"),
        F.count_if(queued & harmful).alias("review_deflected_harm_count"),
        sum_or_zero(F.when(queued, F.col("best_safe_utility"))).alias(
            "reviewed_opportunity_value"
        ),
    )


# Review capacity fractions and review costs.
REVIEW_CAPACITY = (0.05, 0.10, 0.20, 0.40)
REVIEW_COST_BPS = (0.5, 1.0, 2.0, 5.0)


def capacity_overload(workload: DataFrame, capacity: Sequence[float] = REVIEW_CAPACITY) -> DataFrame:
    grid = F.array(*[F.lit(float(c)) for c in capacity])
    excess = F.greatest(F.col("review_rate") - F.col("capacity_fraction"), F.lit(0.0))
    return (
        workload.select("*", F.explode(grid).alias("capacity_fraction"))
        .withColumn("excess_review_fraction", excess)
        .withColumn(
            "queue_rows", F.ceil(F.col("excess_review_fraction") * F.col("rows")).cast("bigint")
        )
    )


def review_cost(workload: DataFrame, costs: Sequence[float] = REVIEW_COST_BPS) -> DataFrame:
    grid = F.array(*[F.lit(float(c)) for c in costs])
    net = F.col("authorized_utility") - F.col("review_count") * F.col("review_cost_bps") / F.lit(
        10000.0
    )
    return workload.select("*", F.explode(grid).alias("review_cost_bps")).withColumn(
        "cost_adjusted_authorized_utility", net
    )


def opportunity_by_slice(
    df: DataFrame, order: Sequence[str], cluster: str = "event_cluster_id"
) -> DataFrame:
    """Opportunity rates over clusters, each represented by its first row."""
    first = F.struct(*[F.col(c) for c in order])
    fields = F.struct(
        "opportunity_slice", "oracle_positive_opportunity", "intended_opportunity",
        "certification_eligible",
    )
    one = df.groupBy(cluster).agg(F.min_by(fields, first).alias("r")).select(cluster, "r.*")
    eligible = F.min_by(F.col("certification_eligible"), F.col(cluster))
    return one.groupBy("opportunity_slice").agg(
        F.count("*").alias("event_clusters"),
        F.avg(F.col("oracle_positive_opportunity").cast("double")).alias("oracle_positive_rate"),
        F.avg(F.col("intended_opportunity").cast("double")).alias("intended_opportunity_rate"),
        eligible.alias("certification_eligible"),
    )


def coverage_collapse(metrics: DataFrame, groups: Sequence[str] = ("rule",)) -> DataFrame:
    """Stress coverage relative to ordinary coverage."""

    def cov(profile: str) -> Column:
        return F.max(F.when(F.col("profile") == profile, F.col("coverage")))

    pivot = metrics.groupBy(*groups).agg(
        cov("ordinary").alias("_o"), cov("stress").alias("_s")
    )
    ratio = F.when(F.abs("_o") > 1e-15, F.try_divide(F.col("_s"), F.col("_o")))
    relation = (
        F.when(F.col("stress_coverage_ratio").isNull(), "UNDEFINED_ZERO_ORDINARY")
        .when(is_close(F.col("stress_coverage_ratio"), F.lit(1.0)), "UNIFORM")
        .when(F.col("stress_coverage_ratio") < 1.0, "COLLAPSE")
        .otherwise("EXPANSION")
    )
    return (
        pivot.withColumn("stress_coverage_ratio", ratio)
        .withColumn("coverage_collapse_index", 1.0 - F.col("stress_coverage_ratio"))
        .withColumn("coverage_relation", relation)
        .drop("_o", "_s")
    )


def paired_burdens(
    ruled: DataFrame, first: str, second: str, cluster: str = "event_cluster_id",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Harm and laundering per row of a cluster under two rules, and the differences.

    A cluster that only one of the two rules covers keeps a NULL difference.
    """

    def burden(rule: str, flag: str) -> Column:
        mine = F.col("rule") == rule
        return F.try_divide(
            F.count_if(mine & F.col(flag)), F.count_if(mine)
        )

    wide = (
        ruled.filter(F.col("rule").isin(first, second) & F.col(cluster).isNotNull())
        .groupBy(*groups, cluster)
        .agg(
            burden(first, "selected_harm").alias("false_burden_first"),
            burden(second, "selected_harm").alias("false_burden_second"),
            burden(first, "selected_laundering").alias("laundering_burden_first"),
            burden(second, "selected_laundering").alias("laundering_burden_second"),
        )
    )
    return wide.withColumns(
        {
            "false_authorization_difference": F.col("false_burden_first")
            - F.col("false_burden_second"),
            "laundering_difference": F.col("laundering_burden_first")
            - F.col("laundering_burden_second"),
        }
    )


def temporal_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("calendar_quarter", "model_id", "task_id").agg(
        F.count("*").alias("proposals"),
        F.countDistinct("event_cluster_id").alias("independent_dates"),
        *[
            F.avg(F.col(source).cast("double")).alias(name)
            for name, source in {
                "active_rate": "active_proposal",
                "review_recommended_rate": "review_recommended",
                "raw_schema_validity": "raw_schema_valid",
                "mean_confidence": "confidence",
                "mean_uncertainty": "uncertainty",
                "mean_absolute_expected_edge_bps": "absolute_expected_edge_bps",
                "explicit_retrospective_signal_rate": "explicit_retrospective_signal",
                "unsupported_external_source_signal_rate": "unsupported_external_source_signal",
            }.items()
        ],
    )


def action_shares(df: DataFrame, groups: Sequence[str] = ("calendar_quarter", "model_id", "task_id")) -> DataFrame:
    counts = df.groupBy(*groups, "action").agg(F.count("*").alias("proposals"))
    total = F.sum("proposals").over(Window.partitionBy(*groups))
    return counts.withColumn("action_rate", F.col("proposals") / total)


def lexical_summary(df: DataFrame) -> DataFrame:
    """Signal counts overall, per model and per task in one GROUPING SETS pass."""
    grouped = df.groupingSets(
        [[], [F.col("model_id")], [F.col("task_id")]], F.col("model_id"), F.col("task_id")
    ).agg(
        F.grouping_id().alias("_gid"),
        F.count("*").alias("proposals"),
        F.countDistinct("event_cluster_id").alias("independent_dates"),
        *[
            a
            for s in ("explicit_retrospective_signal", "unsupported_external_source_signal")
            for a in (
                F.count_if(s).alias(f"{s}_count"),
                F.avg(F.col(s).cast("double")).alias(f"{s}_rate"),
            )
        ],
    )
    scope = (
        F.when(F.col("_gid") == 3, F.lit("overall"))
        .when(F.col("_gid") == 1, F.concat(F.lit("model="), F.col("model_id")))
        .otherwise(F.concat(F.lit("task="), F.col("task_id")))
    )
    return grouped.withColumn("scope", scope).drop("_gid", "model_id", "task_id")


def source_quality(df: DataFrame, high_confidence: float = 0.72) -> DataFrame:
    active = is_true(F.col("candidate_action") != 0)
    sure = active & is_true(F.col("confidence") >= high_confidence)
    material = is_true(F.col("material_harm_full"))
    return df.groupBy("model_id", "task_id").agg(
        F.count("*").alias("rows"),
        F.countDistinct("event_cluster_id").alias("clusters"),
        F.avg(F.col("raw_schema_valid").cast("double")).alias("raw_schema_validity"),
        F.avg(F.col("malformed_placeholder").cast("double")).alias("malformed_placeholder_rate"),
        F.lit(0).alias("repairs_applied"),
        F.avg((~active).cast("double")).alias("proposal_abstain_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("uncertainty").alias("mean_uncertainty"),
        F.avg(F.col("review_recommended").cast("double")).alias("review_recommended_rate"),
        F.avg((~is_true(F.col("original_source_eligible"))).cast("double")).alias(
            "role_ineligible_rate"
        ),
        F.count_if(sure).alias("high_confidence_nonabstain_count"),
        F.count_if(sure & material).alias("material_harm_high_confidence_count"),
        rate(material, sure).alias("material_harm_overconfidence_rate"),
    )


def ambiguity_bound(
    df: DataFrame, signatures: Mapping[str, Sequence[str]], label: str, strata: Sequence[str]
) -> DataFrame:
    """Smallest error any rule can reach that sees only the signature.

    Two-level aggregation: label counts per signature, then sums per stratum.
    NULL signature parts form groups of their own.
    """
    parts = []
    for name, columns in signatures.items():
        counted = df.groupBy(*strata, *columns).agg(
            F.count_if(F.col(label)).cast("double").alias("pos"),
            F.count("*").cast("double").alias("n"),
        )
        parts.append(counted.select(*strata, F.lit(name).alias("signature"), "pos", "n"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    neg = F.col("n") - F.col("pos")
    minority = F.sum(F.least(F.col("pos"), neg))
    total = F.sum("n")
    collided = F.col("n") > 1
    return (
        long.groupBy(*strata, "signature")
        .agg(
            total.cast("bigint").alias("rows"),
            (F.sum("pos") / total).alias("positive_label_rate"),
            F.count("*").alias("signature_count"),
            F.count_if(collided).alias("collision_signature_count"),
            (sum_or_zero(F.when(collided, F.col("n"))) / total).alias("collision_row_fraction"),
            minority.cast("bigint").alias("unavoidable_error_rows"),
            (minority / total).alias("empirical_bayes_error_lower_bound"),
            (F.sum(F.abs(F.col("pos") - neg)) / total).alias("empirical_joint_separation"),
        )
        .withColumn(
            "bayes_overlap_identity_residual",
            F.abs(
                F.col("empirical_bayes_error_lower_bound")
                - (1.0 - F.col("empirical_joint_separation")) / 2.0
            ),
        )
    )


def family_ranges(summary: DataFrame) -> DataFrame:
    measures = {"coverage": "coverage", "far": "far", "certification": "worst_profile_certification_volume"}
    out = summary.groupBy("rule").agg(
        *[
            a
            for name, c in measures.items()
            for a in (F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"))
        ]
    )
    return out.withColumns(
        {f"{n}_range": F.col(f"max_{n}") - F.col(f"min_{n}") for n in measures}
    )


def rank_reversal_families(summary: DataFrame, family: str = "generator_family") -> DataFrame:
    """Families whose lowest-harm rules and best-certified rules do not overlap."""
    w = Window.partitionBy(family)
    low = is_true(F.col("far") == F.min("far").over(w))
    high = is_true(
        F.col("worst_profile_certification_volume")
        == F.max("worst_profile_certification_volume").over(w)
    )
    per = (
        summary.withColumns({"_low": low, "_high": high})
        .groupBy(family)
        .agg(
            (~F.bool_or(F.col("_low") & F.col("_high"))).alias("reversed"),
            (F.max("worst_profile_certification_volume") > 0).alias("certified"),
        )
    )
    return per.agg(
        F.count("*").alias("generator_count"),
        F.count_if("reversed").alias("rank_reversal_family_count"),
        F.count_if("certified").alias("families_with_certification"),
    )


def seed_aggregate(results: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        *[
            a
            for m in measures
            for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))
        ]
    )


def primary_endpoint(
    results: DataFrame, keys: Sequence[str], mechanisms: Sequence[str], coverage_floor: float
) -> DataFrame:
    """A mean harm rate counts only if every mechanism is present, defined and
    covered; the mechanisms that fail are listed."""
    complete = F.count("*") == len(mechanisms)
    floor = F.when(complete, F.min("coverage_lcb95")).otherwise(F.lit(0.0))
    failed = F.col("far").isNull() | is_true(F.col("coverage_lcb95") < coverage_floor)
    grouped = (
        results.filter(F.col("evaluation").isin(*mechanisms))
        .groupBy(*keys)
        .agg(
            F.when(complete, F.min("coverage")).otherwise(F.lit(0.0)).alias(
                "mechanism_coverage_floor"
            ),
            floor.alias("mechanism_coverage_lcb_floor"),
            is_true(
                complete & F.bool_and(F.col("far").isNotNull()) & (floor >= coverage_floor)
            ).alias("primary_endpoint_valid"),
            F.avg("far").alias("_far"),
            F.array_join(
                F.sort_array(F.collect_list(F.when(failed, F.col("evaluation")))), ","
            ).alias("failed_mechanisms"),
        )
    )
    return grouped.withColumn(
        "primary_far", F.when(F.col("primary_endpoint_valid"), F.col("_far"))
    ).drop("_far")


def metric_deltas(
    left: DataFrame, right: DataFrame, metrics: Sequence[str], key: str = "rule"
) -> DataFrame:
    """Per-rule metrics of two runs side by side with right minus left."""
    a = left.select(key, *[F.col(m).alias(f"{m}_left") for m in metrics])
    b = right.select(key, *[F.col(m).alias(f"{m}_right") for m in metrics])
    return a.join(b, key).withColumns(
        {f"{m}_delta": F.col(f"{m}_right") - F.col(f"{m}_left") for m in metrics}
    )


def tables_equal(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
    tolerance: float = 1e-12,
) -> DataFrame:
    """One row per value column: largest difference, N/A mismatches, key mismatches."""
    a = left.select(*keys, F.lit(True).alias("_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = right.select(*keys, F.lit(True).alias("_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    joined = a.join(b, list(keys), "full_outer")
    unmatched = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    stats = joined.agg(
        unmatched.alias("_unmatched"),
        *[
            F.struct(
                F.lit(v).alias("column"),
                F.coalesce(
                    F.max(F.abs(F.col(f"a_{v}").cast("double") - F.col(f"b_{v}").cast("double"))),
                    F.lit(0.0),
                ).alias("max_abs_difference"),
                F.count_if(F.col(f"a_{v}").isNull() != F.col(f"b_{v}").isNull()).alias(
                    "na_mismatches"
                ),
            ).alias(f"s_{v}")
            for v in values
        ],
    )
    return (
        stats.select("_unmatched", F.inline(F.array(*[F.col(f"s_{v}") for v in values])))
        .withColumnRenamed("_unmatched", "unmatched_keys")
        .withColumn(
            "equal",
            (F.col("max_abs_difference") <= tolerance)
            & (F.col("na_mismatches") == 0)
            & (F.col("unmatched_keys") == 0),
        )
    )


def split_leakage(df: DataFrame, raw_records: DataFrame, cluster: str, split: str = "split") -> DataFrame:
    """Derived rows against raw records and clusters, and clusters in two splits."""
    per = df.groupBy(cluster).agg(
        F.count("*").alias("n"),
        (F.min(split) != F.max(split)).alias("crosses"),
    ).agg(
        F.sum("n").alias("derived_rows"),
        F.count(cluster).alias("event_clusters"),
        F.count_if("crosses").alias("clusters_crossing_splits"),
    )
    raw = raw_records.agg(F.count("*").alias("raw_records"))
    return (
        per.withColumn("_k", F.lit(1))
        .join(raw.withColumn("_k", F.lit(1)), "_k")
        .drop("_k")
        .withColumns(
            {
                "derived_rows_per_raw": F.try_divide(F.col("derived_rows"), F.col("raw_records")),
                "derived_rows_per_cluster": F.try_divide(
                    F.col("derived_rows"), F.col("event_clusters")
                ),
            }
        )
    )
