"""Rank transfer seen from every side: all rules, each rule left out, each subgroup and each
pair of rules, for several metrics at once.

Rows shrink to sums per set, cluster and rule in one aggregation.  A set is all rows
(`overall`) or one value of a dimension.  Every set draws its clusters once per replicate,
and that draw serves all metrics, all rules left out and all pairs of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigate.operators import ranks, resample
from verdigate.operators.distributed import materialize

SET = ("part", "member")
#: Member of a dimension that holds the rows without a value.
NO_VALUE = "(null)"
Parts = Mapping[str, tuple[Column, Column]]


def set_sums(
    ruled: DataFrame, parts: Parts, dimensions: Sequence[str], rules: Sequence[str], cluster: str
) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """One row per set and cluster, a numerator and a denominator per rule and metric in
    its columns; a rule without rows counts zero.  Also the place of each column."""
    names = [name for i in range(len(parts)) for name in (f"n{i}", f"d{i}")]
    sums = [F.sum(c).alias(name) for name, c in zip(names, (c for pair in parts.values() for c in pair))]
    cells = ruled.groupBy(*dimensions, cluster, "rule").agg(*sums)

    def one(part: str, member: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), member.alias("member"))

    sets = F.array(
        one("overall", F.lit("")),
        *[one(d, F.coalesce(F.col(d).cast("string"), F.lit(NO_VALUE))) for d in dimensions],
    )
    spread = cells.select(F.explode(sets).alias("_s"), cluster, "rule", *names).select(
        "_s.part", "_s.member", cluster, "rule", *names
    )
    return resample.widen(spread, [*SET, cluster], {r: F.col("rule") == r for r in rules}, names)


def _scores(
    wide: DataFrame, keep: Sequence[str], layout: Mapping[str, Mapping[str, str]],
    metrics: Sequence[str], controlled: DataFrame,
) -> DataFrame:
    """keep, metric, rule, controlled, observed; a rule that `controlled` lacks drops out."""
    rates = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.when(F.col(f"d{i}") > 0, F.try_divide(F.col(f"n{i}"), F.col(f"d{i}"))).alias("observed"),
            )
            for i, m in enumerate(metrics)
        ]
    )
    long = resample.lengthen(wide, keep, layout, "rule").select(*keep, "rule", F.inline(rates))
    return long.join(controlled.select("rule", "controlled"), "rule")


def transfer_scores(
    ruled: DataFrame, controlled: DataFrame, parts: Parts, dimensions: Sequence[str],
    rules: Sequence[str], replicates: int, seed: int, cluster: str = "event_cluster_id",
) -> tuple[DataFrame, DataFrame]:
    """Scores of the rules per set, and the same per replicate: both have part, member,
    metric, rule, controlled, observed, the second replicate and clusters too.

    `controlled` has one row per rule.  Rows without a cluster count in the scores and are
    never drawn."""
    wide, layout = set_sums(ruled, parts, dimensions, rules, cluster)
    wide = materialize(wide)
    values = [c for columns in layout.values() for c in columns.values()]
    whole = wide.groupBy(*SET).agg(*[F.sum(c).alias(c) for c in values])
    drawn = resample.resampled_sums(
        wide.filter(F.col(cluster).isNotNull()), cluster, values, replicates, seed, SET
    )
    metrics = list(parts)
    return (
        _scores(whole, SET, layout, metrics, controlled),
        materialize(_scores(drawn, [*SET, "replicate", "clusters"], layout, metrics, controlled)),
    )


def with_rules_left_out(scores: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Add to the overall set one set per rule, `leave_one_out`, that lacks the rule."""
    own = F.array(F.struct("part", "member"))
    others = F.filter(F.array(*[F.lit(r) for r in rules]), lambda r: r != F.col("rule"))
    left_out = F.transform(
        others, lambda r: F.struct(F.lit("leave_one_out").alias("part"), r.alias("member"))
    )
    sets = F.when(F.col("part") == "overall", F.concat(own, left_out)).otherwise(own)
    rest = [c for c in scores.columns if c not in SET]
    return scores.select(*rest, F.inline(sets))


def transfer_views(point: DataFrame, drawn: DataFrame, rules: Sequence[str], replicates: int) -> DataFrame:
    """Per metric and set: rho, tau, exact p and the interval of the replicates.

    `primary_support`, of the overall set alone, asks for a probability of a negative rho
    of 0.95 and an exact p of 0.05; null where one of them is undefined."""
    keys = ["metric", *SET]
    views = with_rules_left_out(point, rules)
    rhos = ranks.rank_statistics(
        with_rules_left_out(drawn, rules), [*keys, "replicate", "clusters"]
    ).withColumnRenamed("spearman_rho", "rho")
    clusters = rhos.groupBy(*keys).agg(F.max("clusters").alias("clusters"))
    exact = ranks.exact_permutation(views, keys).select(*keys, "exact_p_value")
    support = (F.col("probability_below_zero") >= 0.95) & (F.col("exact_p_value") <= 0.05)
    return (
        ranks.rank_statistics(views, keys)
        .join(exact, keys, "left")
        .join(ranks.rho_summary(rhos, keys, replicates), keys, "left")
        .join(clusters, keys, "left")
        .withColumn("primary_support", F.when(F.col("part") == "overall", support))
    )


def transfer_pairs(point: DataFrame, drawn: DataFrame, replicates: int) -> DataFrame:
    """Per metric and pair of rules, over all rows: is their order reversed, in how many of
    the replicates that order them, and the interval of the observed difference."""
    pair = ["metric", "rule_a", "rule_b"]
    overall = F.col("part") == "overall"
    each = ranks.pairwise_reversal(drawn.filter(overall), ["metric", "replicate"])
    summary = each.groupBy(*pair).agg(
        (F.count("reversal") / F.lit(replicates)).alias("valid_replicate_fraction"),
        F.avg(F.col("reversal").cast("double")).alias("probability_of_reversal"),
        F.percentile("observed_delta", 0.025).alias("observed_delta_lcb95"),
        F.percentile("observed_delta", 0.975).alias("observed_delta_ucb95"),
    )
    return ranks.pairwise_reversal(point.filter(overall), ["metric"]).join(summary, pair, "left")
