"""Authorization rules as Column builders, all evaluated in one pass.

A rule maps a row to execute, reduce, review or abstain.  Predicates are
two-valued: a comparison with a missing feature is false.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigate.functions.columns import is_true, role_list

# Routes, roles and rule names.
ROUTES = ("execute", "reduce", "review", "abstain")
AUTHORIZED = ("execute", "reduce")
ELIGIBLE_ROLES = ("edge_proposer", "learned_prior", "policy_proposer")

Thresholds = Mapping[str, float | Column]

# Example thresholds; callers pass their own.
EXAMPLE_THRESHOLDS: dict[str, float] = {
    "confidence": 0.6,
    "uncertainty": 0.4,
    "risk_cost_bps": 25.0,
    "risk_volatility": 0.8,
    "cost_margin_bps": 5.0,
    "lifecycle_review_uncertainty": 0.75,
    "lifecycle_review_volatility": 1.0,
    "lifecycle_execute_margin_bps": 20.0,
    "shared_confidence": 0.6,
    "soft_penalty": 0.25,
    "soft_threshold": 0.5,
    "epv_uncertainty_max": 0.7,
    "epv_margin_bps": 10.0,
}


@dataclass(frozen=True)
class Rule:
    """A named rule: the features it may read and how it decides on them."""

    name: str
    features: tuple[str, ...]
    build: Callable[[Thresholds], Column]
    classification: str = "deployable"


COST_PARTS = ("liquidity_cost_bps", "turnover_cost_bps", "fee_bps")
MARGIN_PARTS = ("expected_edge_bps", *COST_PARTS)


def total_cost() -> Column:
    return F.col("liquidity_cost_bps") + F.col("turnover_cost_bps") + F.col("fee_bps")


def edge_margin() -> Column:
    return F.col("expected_edge_bps") - total_cost()


def eligible(role: str = "source_role") -> Column:
    return is_true(F.col(role).isin(*ELIGIBLE_ROLES))


def verified_eligible() -> Column:
    return is_true(F.col("current_role_verified")) & eligible("verified_current_role")


def _num(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def gate(allowed: Column, otherwise: str = "abstain") -> Column:
    return F.when(is_true(allowed), F.lit("execute")).otherwise(F.lit(otherwise))


def ladder(
    execute: Column, reduce: Column | None = None, review: Column | None = None
) -> Column:
    """Strongest route that applies; the rest abstain."""
    route = F.when(is_true(execute), F.lit("execute"))
    if reduce is not None:
        route = route.when(is_true(reduce), F.lit("reduce"))
    if review is not None:
        route = route.when(is_true(review), F.lit("review"))
    return route.otherwise(F.lit("abstain"))


def constant(route: str) -> Callable[[Thresholds], Column]:
    return lambda t: F.lit(route)


def at_least(feature: str, key: str) -> Callable[[Thresholds], Column]:
    return lambda t: gate(F.col(feature) >= _num(t[key]))


def at_most(feature: str, key: str) -> Callable[[Thresholds], Column]:
    return lambda t: gate(F.col(feature) <= _num(t[key]))


def _within_risk(t: Thresholds) -> Column:
    return (total_cost() <= _num(t["risk_cost_bps"])) & (
        F.col("volatility_proxy") <= _num(t["risk_volatility"])
    )


def _beats_cost(t: Thresholds) -> Column:
    return F.col("expected_edge_bps") > total_cost() + _num(t["cost_margin_bps"])


def checklist(
    t: Thresholds,
    role_ok: Column | None = None,
    *,
    review_risk: bool = True,
    cost: bool = True,
    reduce: bool = True,
    inclusive: bool = False,
) -> Column:
    """Lifecycle checklist.  `inclusive` lets the execute margin be met exactly."""
    known_role = eligible() if role_ok is None else is_true(role_ok)
    risky = (
        is_true(F.col("uncertainty") >= _num(t["lifecycle_review_uncertainty"]))
        | is_true(F.col("volatility_proxy") >= _num(t["lifecycle_review_volatility"]))
        if review_risk
        else F.lit(False)
    )
    margin = edge_margin() if cost else F.col("expected_edge_bps")
    bar = _num(t["lifecycle_execute_margin_bps"])
    cleared = known_role & ~risky
    beats = margin >= bar if inclusive else margin > bar
    return ladder(
        execute=cleared & is_true(beats),
        reduce=cleared & is_true(margin > 0) if reduce else None,
        review=~known_role | risky,
    )


CHECKLIST_FEATURES = ("source_role", "uncertainty", "volatility_proxy", *MARGIN_PARTS)


def core_rules() -> list[Rule]:
    return [
        Rule("No Action", (), constant("abstain")),
        Rule("Direct Prior", ("candidate_action",), constant("execute")),
        Rule("Confidence Gate", ("confidence",), at_least("confidence", "confidence")),
        Rule("Uncertainty Gate", ("uncertainty",), at_most("uncertainty", "uncertainty")),
        Rule("Risk Filter", (*COST_PARTS, "volatility_proxy"), lambda t: gate(_within_risk(t))),
        Rule("Cost-Aware Gate", MARGIN_PARTS, lambda t: gate(_beats_cost(t))),
        Rule("Hard Role Gate", ("source_role",), lambda t: gate(eligible())),
        Rule("Lifecycle Checklist", CHECKLIST_FEATURES, checklist),
    ]


def lifecycle_ablations() -> list[Rule]:
    def without(*dropped: str) -> tuple[str, ...]:
        return tuple(f for f in CHECKLIST_FEATURES if f not in dropped)

    return [
        Rule("Lifecycle Checklist [registered]", CHECKLIST_FEATURES, checklist,
             "registered_baseline"),
        Rule("Lifecycle without role", without("source_role"),
             lambda t: checklist(t, F.lit(True)), "diagnostic_ablation"),
        Rule("Lifecycle without review risk", without("uncertainty", "volatility_proxy"),
             lambda t: checklist(t, review_risk=False), "diagnostic_ablation"),
        Rule("Lifecycle without cost", without(*COST_PARTS),
             lambda t: checklist(t, cost=False), "diagnostic_ablation"),
        Rule("Lifecycle without reduce route", CHECKLIST_FEATURES,
             lambda t: checklist(t, reduce=False), "diagnostic_ablation"),
    ]


def role_compositions() -> list[Rule]:
    kind = "diagnostic_composition"
    return [
        Rule("Role + Cost Gate", ("source_role", *MARGIN_PARTS),
             lambda t: gate(eligible() & is_true(_beats_cost(t))), kind),
        Rule("Role + Risk Gate", ("source_role", *COST_PARTS, "volatility_proxy"),
             lambda t: gate(eligible() & is_true(_within_risk(t))), kind),
        Rule("Role + Confidence + Cost Gate", ("source_role", "confidence", *MARGIN_PARTS),
             lambda t: gate(
                 eligible()
                 & is_true(F.col("confidence") >= _num(t["confidence"]))
                 & is_true(_beats_cost(t))
             ), kind),
    ]


VERIFIED = ("current_role_verified", "verified_current_role")
# Fixed value: uncertainty cut of the provenance checklist.
PROVENANCE_UNCERTAINTY_CUT = 0.58


def _soft_penalty(t: Thresholds) -> Column:
    trusted = eligible("claimed_role") & is_true(F.col("current_role_verified"))
    penalty = F.when(trusted, F.lit(0.0)).otherwise(_num(t["soft_penalty"]))
    return gate(F.col("confidence") - penalty >= _num(t["soft_threshold"]))


def _lineage_gate(t: Thresholds) -> Column:
    roles = role_list(F.col("lineage_role_chain"))
    clean = (F.size(roles) > 0) & F.forall(roles, lambda r: r.isin(*ELIGIBLE_ROLES))
    return (
        F.when(~verified_eligible(), F.lit("abstain"))
        .when(~is_true(F.col("lineage_attested")), F.lit("review"))
        .when(clean, F.lit("execute"))
        .otherwise(F.lit("abstain"))
    )


def _provenance_checklist(t: Thresholds) -> Column:
    known = verified_eligible()
    calm = known & is_true(F.col("uncertainty") <= PROVENANCE_UNCERTAINTY_CUT)
    return ladder(
        execute=calm & (edge_margin() > _num(t["lifecycle_execute_margin_bps"])),
        reduce=calm & (edge_margin() > 0),
        review=~known | is_true(F.col("uncertainty") > PROVENANCE_UNCERTAINTY_CUT),
    )


def discounted_edge(t: Thresholds, role_ok: Column, discount: float, inclusive: bool) -> Column:
    """Margin less a price per unit of uncertainty, for eligible sources only."""
    margin = edge_margin() - F.lit(discount) * F.col("uncertainty")
    bar = _num(t["epv_margin_bps"])
    open_ = role_ok & (margin > 0) & (F.col("uncertainty") <= _num(t["epv_uncertainty_max"]))
    return ladder(execute=open_ & (margin >= bar if inclusive else margin > bar), reduce=open_)


def provenance_rules(learned: Rule | None = None) -> list[Rule]:
    """Rules over source provenance.  `learned` is the fitted gate, if any."""
    rules = [
        Rule("No Action", (), constant("abstain")),
        Rule("No Role Gate", ("candidate_action",), constant("execute")),
        Rule("Shared Threshold", ("confidence",), at_least("confidence", "shared_confidence")),
        Rule("Soft Penalty", ("confidence", "claimed_role", "current_role_verified"),
             _soft_penalty),
        Rule("Hard Role Gate", VERIFIED, lambda t: gate(verified_eligible(), "review")),
        Rule("Provenance Hard Gate", (*VERIFIED, "lineage_attested", "lineage_role_chain"),
             _lineage_gate),
        Rule("Lifecycle Checklist", (*VERIFIED, "uncertainty", *MARGIN_PARTS),
             _provenance_checklist),
        Rule("EPV Adapter", (*VERIFIED, "uncertainty", *MARGIN_PARTS),
             lambda t: discounted_edge(t, verified_eligible(), 10.0, inclusive=False)),
    ]
    return rules + [learned] if learned else rules


def learned_gate(execute: float, review: float, features: Sequence[str],
                 probability: str = "safe_probability") -> Rule:
    """Two cuts on a probability column that a fitted model has added."""
    return Rule(
        "Provenance Learned Gate", tuple(features),
        lambda t: ladder(
            execute=F.col(probability) >= execute, review=F.col(probability) >= review
        ),
    )


def grid_rules(grid: Mapping[str, Sequence]) -> list[Rule]:
    """Public rule family expanded from a threshold grid."""

    def fixed(name: str, features: Sequence[str], decide: Callable[[], Column],
              kind: str = "deployable") -> Rule:
        return Rule(name, tuple(features), lambda t: decide(), kind)

    rules = [
        fixed("No Action", (), lambda: F.lit("abstain"), "diagnostic"),
        fixed("Direct Prior", ("candidate_action",), lambda: F.lit("execute")),
    ]
    families: list[tuple[str, str, Sequence[str], Callable[[float], Column]]] = [
        ("confidence", "Confidence Gate [{:.2f}]", ("confidence",),
         lambda v: F.col("confidence") >= v),
        ("uncertainty", "Uncertainty Gate [{:.2f}]", ("uncertainty",),
         lambda v: F.col("uncertainty") <= v),
        ("edge_bps", "Edge Gate [{:.0f} bps]", ("expected_edge_bps",),
         lambda v: F.col("expected_edge_bps") >= v),
        ("cost_margin_bps", "Cost-Aware Gate [{:.0f} bps]", MARGIN_PARTS,
         lambda v: edge_margin() >= v),
        ("fee_bps", "Fee Gate [{:.0f} bps]", ("fee_bps",),
         lambda v: F.col("fee_bps") <= v),
    ]
    for key, label, features, test in families:
        for value in grid.get(key, ()):
            v = float(value)
            rules.append(fixed(label.format(v), features, lambda v=v, test=test: gate(test(v))))
    for cost, volatility in grid.get("risk", ()):
        limits = {"risk_cost_bps": float(cost), "risk_volatility": float(volatility)}
        rules.append(
            fixed(f"Risk Filter [cost={cost:.0f}, vol={volatility:.2f}]",
                  (*COST_PARTS, "volatility_proxy"),
                  lambda limits=limits: gate(_within_risk(limits)))
        )
    for hours in grid.get("horizon_hours", ()):
        rules.append(
            fixed(f"Horizon Gate [{int(hours)} h]", ("horizon",),
                  lambda h=int(hours): gate(F.col("horizon") >= h))
        )
    rules.append(fixed("Hard Role Gate", ("source_role",), lambda: gate(eligible())))
    for name, margin, uncertainty, volatility in grid.get("lifecycle", ()):
        limits = {
            "lifecycle_execute_margin_bps": float(margin),
            "lifecycle_review_uncertainty": float(uncertainty),
            "lifecycle_review_volatility": float(volatility),
        }
        rules.append(
            fixed(f"Lifecycle Checklist [{name}]", CHECKLIST_FEATURES,
                  lambda limits=limits: checklist(limits, inclusive=True))
        )
    if "epv" in grid:
        margin, uncertainty = grid["epv"]
        limits = {"epv_margin_bps": float(margin), "epv_uncertainty_max": float(uncertainty)}
        rules.append(
            fixed("EPV Adapter", CHECKLIST_FEATURES,
                  lambda: discounted_edge(limits, eligible(), 1000.0, inclusive=True))
        )
    return rules


def two_task_rules() -> list[Rule]:
    """Rules over agent proposals; a non-action always abstains and the role test
    is the declared eligibility of the source."""
    declared = ("original_source_eligible",)

    def acting(decide: Callable[[Thresholds], Column]) -> Callable[[Thresholds], Column]:
        return lambda t: F.when(
            is_true(F.col("candidate_action") == 0), F.lit("abstain")
        ).otherwise(decide(t))

    plain = {r.name: r for r in core_rules()}
    chosen = [
        plain[name]
        for name in ("Direct Prior", "Confidence Gate", "Uncertainty Gate", "Risk Filter",
                     "Cost-Aware Gate")
    ]
    chosen.append(
        Rule("Hard Role Gate", declared, lambda t: gate(F.col("original_source_eligible")))
    )
    chosen.append(
        Rule("Lifecycle Checklist", (*declared, *CHECKLIST_FEATURES[1:]),
             lambda t: checklist(t, F.col("original_source_eligible")))
    )
    return [
        Rule(r.name, tuple(dict.fromkeys(("candidate_action", *r.features))), acting(r.build))
        for r in chosen
    ]


def decide(
    df: DataFrame,
    rules: Iterable[Rule],
    thresholds: Thresholds = EXAMPLE_THRESHOLDS,
    by_rule: Mapping[str, Thresholds] | None = None,
) -> DataFrame:
    """One output row per (row, rule) with columns `rule` and `decision`.

    The scan happens once; the rules are a generator over it, so Catalyst prunes
    the scan to the features the rules and later steps really use.
    """
    overrides = by_rule or {}
    pairs = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                r.build({**thresholds, **overrides.get(r.name, {})}).alias("decision"),
            )
            for r in rules
        ]
    )
    return df.select("*", F.inline(pairs))


def decide_with(
    df: DataFrame, rules: Iterable[Rule], parameters: DataFrame, thresholds: Thresholds = EXAMPLE_THRESHOLDS
) -> DataFrame:
    """`decide` with thresholds from a relation: `parameters` has one row per rule with
    `rule` and `chosen`, a map of threshold names to values.

    A rule without a row, or a name that its map lacks, takes `thresholds`.  The relation
    is as small as the registry of rules and is broadcast; each row evaluates one rule.
    """
    rules = list(rules)
    names = F.array(*[F.lit(r.name) for r in rules])
    given = parameters.select(F.col("rule"), F.col("chosen").alias("_chosen"))
    spread = df.select("*", F.explode(names).alias("rule")).join(F.broadcast(given), "rule", "left")
    current = {
        name: F.coalesce(F.try_element_at("_chosen", F.lit(name)), _num(value))
        for name, value in thresholds.items()
    }
    decision = None
    for r in rules:
        mine = F.col("rule") == r.name
        decision = F.when(mine, r.build(current)) if decision is None else decision.when(mine, r.build(current))
    return spread.withColumn("decision", decision).select(*df.columns, "rule", "decision")


def invalid_decisions(ruled: DataFrame) -> DataFrame:
    """Rules that produced a missing or unknown route, with counts."""
    bad = ~is_true(F.col("decision").isin(*ROUTES))
    return (
        ruled.groupBy("rule")
        .agg(F.count("*").alias("rows"), F.count_if(bad).alias("invalid_rows"))
        .withColumn("valid", F.col("invalid_rows") == 0)
    )


def features_read(frame: DataFrame, rule: Rule, thresholds: Thresholds = EXAMPLE_THRESHOLDS) -> list[str]:
    """The columns of `frame` that the rule's expression refers to.

    The expression is resolved against a relation without columns; each column the
    analyzer then misses is added, until nothing is missing.  No row is read.
    """
    read: list[str] = []
    reports = logging.getLogger("DataFrameQueryContextLogger")
    before = reports.disabled
    reports.disabled = True  # the errors are the answer here
    try:
        while True:
            try:
                frame.select(*read).select(rule.build(thresholds))
                return sorted(read)
            except AnalysisException as missing:
                found = (missing.getMessageParameters() or {}).get("objectName", "")
                name = found.strip("`").split("`.`")[0]
                if name not in frame.columns or name in read:
                    raise
                read.append(name)
    finally:
        reports.disabled = before


def feature_access(
    frame: DataFrame,
    rules: Iterable[Rule],
    task: str,
    legal: Iterable[str],
    forbidden: Iterable[str],
    identifiers: Iterable[str],
) -> DataFrame:
    """VALID unless a rule reads a forbidden, identifying or unlisted feature, or one that
    it does not declare.  What a rule reads is taken from its expression over `frame`."""
    allowed, banned = set(legal), set(forbidden) | set(identifiers)
    rows = []
    for r in rules:
        used = set(features_read(frame, r))
        illegal = sorted((used & banned) | (used - allowed))
        undeclared = sorted(used - set(r.features))
        rows.append(
            (r.name, task, r.classification, sorted(used), illegal, undeclared,
             "INVALID" if illegal or undeclared else "VALID")
        )
    return frame.sparkSession.createDataFrame(
        rows,
        "rule STRING, task STRING, classification STRING, features_used ARRAY<STRING>, "
        "illegal_features ARRAY<STRING>, undeclared_features ARRAY<STRING>, status STRING",
    )
