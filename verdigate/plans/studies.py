"""Training utility and robustness: all variants, learners, budgets and seeds as keyed jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigate.operators import labels, learn, metrics, ranks, studies
from verdigate.operators.distributed import materialize
from verdigate.operators.structure import curriculum_quotas
from verdigate.plans.inference import _bound_sql, scored_frame
from verdigate.plans.proxies import DECISION_SQL, ROLES, decision_view, provenance_view
from verdigate.plans.registry import query

FEATURES = learn.Features(
    (*learn.NUMERIC, "hop_depth"), ("source_role", "transformation_type", "traceability")
)
#: Mechanisms that no training sample holds.
HELD_OUT = {
    "opportunity_slice": ("severe_stress", "no_opportunity_control"),
    "attack_type": ("paraphrase", "multi_hop"),
}
UNSEEN = (
    "controlled_severe_stress", "controlled_no_opportunity", "provenance_paraphrase", "provenance_multi_hop",
)
VARIANTS = ("D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7")
#: Shares of the provenance and the public layer in D7.
FULL_AUDIT = {"provenance": 0.6, "public": 0.4}
NEUTRAL = "D7_role_neutral"
C_GRID = (0.1, 1.0, 10.0)
SEEDS = (1, 2, 3, 4, 5)
BUDGET = 150
COVERAGE, FLOOR = 0.20, 0.05

CURRICULA = {
    "controlled": {"controlled": 1.0},
    "with_provenance": {"controlled": 0.5, "provenance": 0.5},
    "full": {"controlled": 0.4, "provenance": 0.3, "public": 0.3},
}
BUDGETS = (60, 120, 240, 480)
LEARNERS = ("logistic", "boosting", "perceptron", "selective_logistic")
SELECTIVE_TARGETS = (0.05, 0.10, 0.20)


def layers(spark: SparkSession, directory: str, split: str) -> DataFrame:
    """The controlled, provenance and public layers of a split in the training schema."""
    controlled = decision_view(spark, directory)
    claimed = provenance_view(spark, directory).withColumns(
        {"source_role": F.col("claimed_role"), "original_source_eligible": F.col("original_verified_role").isin(*ROLES[:3])}
    )
    public = controlled.filter(F.col("l_linenumber") == 1)
    none = F.lit(None).cast("string")
    parts = []
    for name, df in (("controlled", controlled), ("provenance", claimed), ("public", public)):
        if "attack_type" not in df.columns:
            df = df.withColumn("attack_type", none)
        ready = labels.training_schema(df.filter(F.col("split") == split), FEATURES.all, name)
        parts.append(ready.select(
            "row_id", "source_layer", "training_cluster_id", "opportunity_slice", "attack_type", "full_utility",
            "original_source_eligible", "authority_laundering", labels.prediction_label().alias("predicted"),
            *[F.col(c).cast("double").alias(c) for c in FEATURES.numeric],
            *[F.col(c).cast("string").alias(c) for c in FEATURES.categorical],
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("safe", labels.safety_label())


def variant_pools(rows: DataFrame) -> DataFrame:
    """Each training row once for every variant whose pool it is in."""
    controlled, provenance, public = (F.col("source_layer") == x for x in ("controlled", "provenance", "public"))
    ordinary = F.col("opportunity_slice") == "ordinary"
    pools = {
        "D0": controlled, "D1": controlled & ordinary, "D2": controlled & ~ordinary, "D3": controlled,
        "D4": provenance, "D5": provenance & F.col("attack_type").isin("role_noise", "delegation"),
        "D6": controlled & F.col("original_source_eligible"), "D7": provenance | public,
    }
    return rows.select("*", F.explode(labels.in_profiles(pools)).alias("variant"))


def variant_quotas(spark: SparkSession, variants: Sequence[str], budget: int) -> DataFrame:
    layer = {v: "controlled" for v in variants} | {"D4": "provenance", "D5": "provenance"}
    rows = [(v, layer[v], budget) for v in variants if v != "D7"]
    if "D7" in variants:
        rows += [("D7", name, quota) for name, quota in curriculum_quotas(budget, FULL_AUDIT).items()]
    return spark.createDataFrame(rows, "variant string, source_layer string, quota int")


def training_corpora(
    spark: SparkSession, directory: str, variants: Sequence[str] = VARIANTS, budget: int = BUDGET,
    seeds: Sequence[int] = SEEDS,
) -> DataFrame:
    """The sampled corpora of all variants and seeds in one tagged table."""
    rows = materialize(labels.exclude_mechanisms(layers(spark, directory, "train"), HELD_OUT))
    pools = variant_pools(rows).filter(F.col("variant").isin(*variants))
    drawn = studies.draw(
        pools, ["variant", "source_layer"], "training_cluster_id", "row_id",
        variant_quotas(spark, variants, budget), seeds,
    )
    predicts = F.col("variant") == "D0"
    return drawn.withColumns({
        "label_semantics": F.when(predicts, "prediction_correct").otherwise("authorization_safe"),
        "training_label": F.when(predicts, F.col("predicted")).otherwise(F.col("safe")),
    })


def _drawn_sql(layer_rows: str) -> str:
    """The sampled corpora in SQL, from rows (row_id, event_cluster_id, source_layer, ...)."""
    number = "CAST('0x' || substr(sha256({}), 1, 13) AS BIGINT)"
    return f"""{layer_rows}, pools AS (
      SELECT *, source_layer || ':' || event_cluster_id AS cluster, unnest(list_filter([
          CASE WHEN source_layer = 'controlled' THEN 'D0' END,
          CASE WHEN source_layer = 'controlled' AND opportunity_slice = 'ordinary' THEN 'D1' END,
          CASE WHEN source_layer = 'controlled' AND opportunity_slice <> 'ordinary' THEN 'D2' END,
          CASE WHEN source_layer = 'controlled' THEN 'D3' END,
          CASE WHEN source_layer = 'controlled' AND original_source_eligible THEN 'D6' END,
          CASE WHEN source_layer = 'provenance' THEN 'D4' END,
          CASE WHEN source_layer = 'provenance' AND attack_type IN ('role_noise', 'delegation') THEN 'D5' END,
          CASE WHEN source_layer IN ('provenance', 'public') THEN 'D7' END], lambda x: x IS NOT NULL)) AS variant
      FROM layer_rows),
    clusters AS (
      SELECT variant, source_layer, cluster, seed,
        row_number() OVER (PARTITION BY variant, source_layer, seed
          ORDER BY {number.format("'cluster|' || variant || '|' || source_layer || '|' || seed || '|' || cluster")}, cluster) AS place
      FROM (SELECT DISTINCT variant, source_layer, cluster FROM pools), (SELECT unnest([1, 2, 3, 4, 5]) AS seed)),
    chosen AS (
      SELECT * FROM clusters WHERE place <= CASE WHEN variant <> 'D7' THEN {BUDGET}
        WHEN source_layer = 'provenance' THEN {round(BUDGET * FULL_AUDIT["provenance"])}
        ELSE {BUDGET - round(BUDGET * FULL_AUDIT["provenance"])} END),
    corpora AS (
      SELECT p.*, seed FROM pools p JOIN chosen USING (variant, source_layer, cluster)
      QUALIFY row_number() OVER (PARTITION BY variant, source_layer, cluster, seed
        ORDER BY {number.format("'row|' || seed || '|' || row_id")}, row_id) = 1)"""


LAYER_SQL = """layer_rows AS (
      SELECT row_id, event_cluster_id, 'controlled' AS source_layer, opportunity_slice, NULL AS attack_type,
        original_source_eligible, full_utility > 0 AND original_source_eligible AS safe,
        candidate_action * realized_return > 0 AS predicted, l_linenumber FROM v
        WHERE split = 'train' AND opportunity_slice NOT IN ('severe_stress', 'no_opportunity_control'))"""


@query(
    "U11_sampled_corpora",
    f"""WITH {DECISION_SQL}, {_drawn_sql(LAYER_SQL)}
    SELECT variant, CAST(seed AS INTEGER) AS seed, count(*) AS rows, count(DISTINCT cluster) AS clusters,
      count(*) FILTER (WHERE CASE WHEN variant = 'D0' THEN predicted ELSE safe END) AS positive,
      CAST(sum(CAST('0x' || substr(md5(row_id), 1, 10) AS BIGINT)) AS BIGINT) AS row_sum
    FROM corpora GROUP BY 1, 2""",
)
def sampled_controlled_corpora(spark, directory):
    """The sampled corpora of the variants over the controlled layer."""
    controlled = ("D0", "D1", "D2", "D3", "D6")
    drawn = training_corpora(spark, directory, controlled)
    number = F.conv(F.substring(F.md5("row_id"), 1, 10), 16, 10).cast("bigint")
    return drawn.groupBy("variant", "seed").agg(
        F.count("*").alias("rows"), F.countDistinct("training_cluster_id").alias("clusters"),
        F.count_if(F.col("training_label") == 1).alias("positive"), F.sum(number).alias("row_sum"),
    )


@query("U11_all_variants")
def sampled_corpora(spark, directory):
    """All eight variants: rows and positive labels by seed and layer."""
    return training_corpora(spark, directory).groupBy("variant", "seed", "source_layer", "label_semantics").agg(
        F.count("*").alias("rows"), F.countDistinct("training_cluster_id").alias("clusters"),
        F.count_if(F.col("training_label") == 1).alias("positive"),
    )


def validation_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Validation rows with a column `in_` each evaluation frame; `seen` rows calibrate."""
    rows = layers(spark, directory, "validation")
    controlled, provenance = (F.col("source_layer") == x for x in ("controlled", "provenance"))
    of = lambda column, value: F.col(column) == value
    severe, quiet = of("opportunity_slice", "severe_stress"), of("opportunity_slice", "no_opportunity_control")
    told, hops = of("attack_type", "paraphrase"), of("attack_type", "multi_hop")
    frames = {
        "unseen": (controlled & (severe | quiet)) | (provenance & (told | hops)),
        "unseen_controlled": controlled & (severe | quiet),
        "unseen_provenance": provenance & (told | hops),
        "controlled_severe_stress": controlled & severe,
        "controlled_no_opportunity": controlled & quiet,
        "provenance_paraphrase": provenance & told,
        "provenance_multi_hop": provenance & hops,
        "public_validation": F.col("source_layer") == "public",
    }
    held = labels.is_true(F.col("opportunity_slice").isin(*HELD_OUT["opportunity_slice"])) | labels.is_true(
        F.col("attack_type").isin(*HELD_OUT["attack_type"])
    )
    return rows.withColumns({
        **{f"in_{name}": labels.is_true(c) for name, c in frames.items()},
        "seen": (controlled | provenance) & ~held,
        "evaluation_cluster_id": F.col("training_cluster_id"),
        "authorization_harm": 1 - F.col("safe"),
    })


#: Evaluation frames of `validation_rows`.
FRAMES = (
    "unseen", "unseen_controlled", "unseen_provenance", "controlled_severe_stress", "controlled_no_opportunity",
    "provenance_paraphrase", "provenance_multi_hop", "public_validation",
)


def _info(spark: SparkSession, rulings: list, names: Sequence[str], schema: str) -> DataFrame:
    """Place in the list and key columns of the few rulings of a study."""
    return spark.createDataFrame([(i, *[m[n] for n in names]) for i, m in enumerate(rulings)], f"ruling int, {schema}")


def _frames() -> dict[str, Column]:
    return {f: F.col(f"in_{f}") for f in FRAMES}


RATES = (
    "rows", "clusters", "authorized_count", "coverage", "coverage_lcb95", "far", "far_ucb95", "alr", "alr_ucb95", "cau",
)


def utility_models(
    spark: SparkSession, directory: str, variants: Sequence[str] = VARIANTS, grid: Sequence[float] = C_GRID,
    budget: int = BUDGET, seeds: Sequence[int] = SEEDS, target: float = COVERAGE,
) -> tuple[list[dict], DataFrame]:
    """The model of each variant and seed whose C does best on the calibration rows, and
    the validation rows.  The role-neutral control of D7 is one variant more."""
    samples = materialize(training_corpora(spark, directory, variants, budget, seeds))
    if "D7" in variants:
        neutral = labels.mask_group(samples.filter(F.col("variant") == "D7"), "role", FEATURES.categorical)
        samples = samples.unionByName(neutral.withColumn("variant", F.lit(NEUTRAL)))
    fitted = studies.fit_all(samples, ["variant", "seed"], [("logistic", c) for c in grid], FEATURES)
    mask = F.when(F.col("variant") == NEUTRAL, "role")
    fitted = [r.asDict() for r in fitted.withColumn("mask", mask).orderBy("variant", "seed", "c").collect()]
    validation = materialize(validation_rows(spark, directory))
    seen = validation.filter("seen")
    cuts = studies.exact_thresholds(seen, fitted, FEATURES, [target], labels.FEATURE_GROUPS)
    rulings = [(i, found[target]) for i, found in enumerate(cuts) if target in found]
    rates = studies.cluster_rates(seen, fitted, rulings, FEATURES, {"seen": F.lit(True)}, labels.FEATURE_GROUPS)
    table = [{**fitted[m], "model": m, "threshold": cut} for m, cut in rulings]
    info = _info(spark, table, ("model", "threshold", "variant", "seed", "c"), "model int, threshold double, variant string, seed int, c double")
    best = studies.best_candidate(rates.join(info, "ruling"), ["variant", "seed"], target).collect()
    return [{**fitted[b["model"]], "threshold": b["threshold"]} for b in sorted(best, key=lambda b: b["model"])], validation


def utility_results(spark: SparkSession, directory: str, ablations: bool = False, **options) -> DataFrame:
    """variant, seed, c, threshold, masked_group, evaluation and cluster rates with bounds.

    With `ablations` the chosen models of D0 to D7 also score the unseen rows with the
    role, cost and belief features blanked.
    """
    chosen, validation = utility_models(spark, directory, **options)
    tried = [{**m, "masked_group": "none"} for m in chosen]
    if ablations:
        tried += [
            {**m, "mask": g, "masked_group": g} for m in chosen if m["variant"] != NEUTRAL for g in ("role", "cost", "belief")
        ]
    rulings = [(i, m["threshold"]) for i, m in enumerate(tried)]
    rates = studies.cluster_rates(validation, tried, rulings, FEATURES, _frames(), labels.FEATURE_GROUPS)
    names = ("variant", "seed", "c", "masked_group", "threshold")
    info = _info(spark, tried, names, "variant string, seed int, c double, masked_group string, threshold double")
    return (
        rates.withColumnRenamed("frame", "evaluation").join(info, "ruling")
        .filter("masked_group = 'none' or evaluation = 'unseen'").select(*names, "evaluation", *RATES)
    )


@query("PL14_training_utility")
def training_utility(spark, directory):
    """Paired harm contrasts of D2 to D7 against D1 with step-down adjustment; a variant
    that lost a seed has p 1.  All variants, seeds and values of C."""
    results = materialize(utility_results(spark, directory).filter(F.col("variant") != NEUTRAL))
    endpoint = metrics.primary_endpoint(results, ["variant", "seed"], UNSEEN, FLOOR)
    valid = materialize(endpoint.filter("primary_endpoint_valid").select("variant", "seed", "primary_far"))
    reference = valid.filter(F.col("variant") == "D1").select("seed", F.col("primary_far").alias("reference"))
    family = [v for v in VARIANTS if v not in ("D0", "D1")]
    runs = results.filter(F.col("variant").isin(*family)).select("variant", "seed").distinct()
    paired = runs.join(valid, ["variant", "seed"], "left").join(reference, "seed", "left").withColumn(
        "difference", F.col("reference") - F.col("primary_far")
    )
    tests = ranks.t_test(paired, "difference", ["variant"], "greater", required_pairs=len(SEEDS))
    missing = runs.select("variant").distinct().join(tests, "variant", "left").withColumns(
        {"raw_p": F.coalesce("raw_p", F.lit(1.0)), "clusters": F.coalesce("clusters", F.lit(0).cast("bigint"))}
    )
    return ranks.holm(missing, name="variant")


@query("PL14_endpoints")
def training_endpoints(spark, directory):
    """Primary endpoint of every variant and seed, and its mean over the seeds."""
    endpoint = metrics.primary_endpoint(
        utility_results(spark, directory), ["variant", "seed"], UNSEEN, FLOOR
    )
    return endpoint.groupBy("variant").agg(
        F.count("*").alias("seeds"), F.count_if("primary_endpoint_valid").alias("valid_seeds"),
        F.avg("primary_far").alias("far_mean"), F.stddev_samp("primary_far").alias("far_std"),
        F.avg("mechanism_coverage_floor").alias("coverage_floor_mean"),
    )


@query("ML4_role_neutral_control")
def role_neutral_control(spark, directory):
    """D7, its role-neutral control, and the unseen rows with feature groups blanked:
    rates over the seeds."""
    results = utility_results(spark, directory, ablations=True, variants=("D7",))
    return metrics.seed_aggregate(results, ["variant", "masked_group", "evaluation"], ["coverage", "far", "alr"])


@query("W5_coefficient_audit")
def coefficient_audit(spark, directory):
    """Mean absolute coefficient over the seeds per variant and feature, ranked within the
    variant."""
    chosen, _ = utility_models(spark, directory)
    fitted = spark.createDataFrame(
        [(m["variant"], m["seed"], m["model"]) for m in chosen], "variant string, seed int, model string"
    )
    found = studies.coefficients(fitted, ["variant", "seed"])
    mean = found.groupBy("variant", "feature").agg(
        F.avg(F.abs("coefficient")).alias("absolute_coefficient"), F.avg("coefficient").alias("coefficient"),
        F.count("*").alias("models"),
    )
    order = Window.partitionBy("variant").orderBy(F.desc("absolute_coefficient"), "feature")
    return mean.withColumn("rank_within_variant", F.row_number().over(order))


def robustness_results(
    spark: SparkSession, directory: str, budgets: Sequence[int] = BUDGETS, seeds: Sequence[int] = (1, 2, 3),
    learners: Sequence[str] = LEARNERS, c: float = 1.0,
) -> DataFrame:
    """curriculum, budget, seed, learner, target, evaluation and cluster rates with bounds.

    Budgets are nested: smaller samples are prefixes of larger ones.  The selective
    learner uses the logistic model under a threshold chosen per layer.
    """
    quotas = [
        (curriculum, budget, source, quota)
        for curriculum, weights in CURRICULA.items() for budget in budgets
        for source, quota in curriculum_quotas(budget, weights).items()
    ]
    table = spark.createDataFrame(quotas, "curriculum string, budget int, source_layer string, part int")
    most = table.groupBy("source_layer").agg(F.max("part").alias("quota"))
    pool = materialize(labels.exclude_mechanisms(layers(spark, directory, "train"), HELD_OUT))
    drawn = materialize(studies.draw(pool, ["source_layer"], "training_cluster_id", "row_id", most, seeds))
    samples = drawn.join(table, "source_layer").filter("draw < part").withColumn("training_label", F.col("safe"))
    fit = [(x, c if x == "logistic" else 0.0) for x in ("logistic", "boosting", "perceptron") if x in learners or x == "logistic"]
    keys = ["curriculum", "budget", "seed"]
    fitted = studies.fit_all(samples, keys, fit, FEATURES)
    fitted = [r.asDict() for r in fitted.orderBy(*keys, "learner").collect()]
    validation = materialize(validation_rows(spark, directory))
    seen = validation.filter("seen")
    cuts = studies.exact_thresholds(seen, fitted, FEATURES, SELECTIVE_TARGETS)
    ruled = [
        {**m, "model": i, "target": COVERAGE, "threshold": cut[COVERAGE]}
        for i, (m, cut) in enumerate(zip(fitted, cuts)) if m["learner"] in learners and cut
    ]
    if "selective_logistic" in learners:
        tried = [
            {"model": i, "target": t, "threshold": c}
            for i, cut in enumerate(cuts) if fitted[i]["learner"] == "logistic" for t, c in cut.items()
        ]
        by_layer = {x: F.col("source_layer") == x for x in ("controlled", "provenance", "public")}
        rates = studies.cluster_rates(seen, fitted, [(r["model"], r["threshold"]) for r in tried], FEATURES, by_layer)
        info = _info(spark, tried, ("model", "target", "threshold"), "model int, target double, threshold double")
        for row in studies.best_selective(rates.join(info, "ruling"), FLOOR).orderBy("model").collect():
            ruled.append({
                **fitted[row["model"]], "learner": "selective_logistic", "model": row["model"],
                "target": row["target"], "threshold": row["threshold"],
            })
    rates = studies.cluster_rates(validation, fitted, [(r["model"], r["threshold"]) for r in ruled], FEATURES, _frames())
    names = (*keys, "learner", "target")
    info = _info(spark, ruled, names, "curriculum string, budget int, seed int, learner string, target double")
    return rates.withColumnRenamed("frame", "evaluation").join(info, "ruling").select(*names, "evaluation", *RATES)


@query("PL15_training_robustness")
def training_robustness(spark, directory):
    """Learning curves: three curricula, four nested budgets, four learners, three seeds."""
    mechanisms = (*UNSEEN, "public_validation")
    results = materialize(robustness_results(spark, directory))
    keys = ["curriculum", "budget", "learner"]
    endpoint = metrics.primary_endpoint(results, [*keys, "seed"], mechanisms, FLOOR)
    valid = labels.is_true((F.col("coverage_lcb95") >= FLOOR) & F.col("far").isNotNull())
    shares = (
        results.filter(F.col("evaluation").isin(*mechanisms)).groupBy(*keys)
        .agg(F.avg(valid.cast("double")).alias("valid_mechanism_share"), F.avg("coverage").alias("coverage_mean"))
    )
    curve = endpoint.groupBy(*keys).agg(
        F.count("*").alias("seeds"), F.count_if("primary_endpoint_valid").alias("valid_seeds"),
        F.avg("primary_far").alias("far_mean"), F.stddev_samp("primary_far").alias("far_std"),
    )
    return curve.join(shares, keys)


def _given_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Two score columns of the given rows in the place of models: 0 and 1."""
    rows = scored_frame(spark, directory).drop("authorized").withColumn("source_layer", F.col("opportunity_slice"))
    scores = F.array(F.col("confidence").cast("double"), (1.0 - F.col("uncertainty")).cast("double"))
    return studies.by_model(rows.withColumn("scores", scores))


THRESHOLD_SQL = f"""WITH {DECISION_SQL}, sc AS (
      SELECT event_cluster_id, opportunity_slice, full_utility, original_source_eligible, 0 AS model, confidence AS score FROM v
      UNION ALL SELECT event_cluster_id, opportunity_slice, full_utility, original_source_eligible, 1, 1.0e0 - uncertainty FROM v),
    th AS (
      SELECT model, target, max(score) FILTER (WHERE i = CAST(ceil((n - 1) * (1.0e0 - target)) AS BIGINT)) AS threshold
      FROM (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) - 1 AS i,
          count(*) OVER (PARTITION BY model) AS n FROM sc),
        (SELECT unnest([0.05e0, 0.1e0, 0.2e0]) AS target) GROUP BY 1, 2),
    au AS (SELECT sc.*, target, threshold, score >= threshold AS authorized FROM sc JOIN th USING (model))"""


def _rates_sql(keys: str) -> str:
    return f"""cr AS (
      SELECT {keys}, event_cluster_id, avg(CAST(authorized AS DOUBLE)) AS coverage,
        avg(CASE WHEN authorized THEN CASE WHEN full_utility > 0 AND original_source_eligible THEN 0.0e0 ELSE 1.0e0 END END) AS far,
        coalesce(sum(full_utility) FILTER (WHERE authorized), 0.0e0) AS cau
      FROM au GROUP BY ALL),
    rb AS (SELECT {keys}, avg(coverage) AS coverage, {_bound_sql("coverage", "-")} AS coverage_lcb95,
        avg(far) AS far, avg(cau) AS cau FROM cr GROUP BY ALL)"""


@query(
    "T3_selective_threshold",
    f"""{THRESHOLD_SQL}, {_rates_sql("model, target, threshold, opportunity_slice")},
    rk AS (SELECT model, target, threshold,
        CASE WHEN count(far) > 0 AND min(coverage_lcb95) >= {FLOOR}e0 THEN 0 ELSE 1 END AS invalid,
        coalesce(max(far), 'inf'::DOUBLE) AS mx, coalesce(avg(far), 'inf'::DOUBLE) AS mn, avg(cau) AS cau FROM rb GROUP BY ALL)
    SELECT CAST(model AS INTEGER) AS model, target, threshold, invalid = 0 AS floor_satisfied FROM rk
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY invalid, mx, mn, cau DESC, target DESC) = 1""",
    ("target", "threshold"),
)
def selective_threshold(spark, directory):
    """The selective threshold of each score: valid first, then worst and mean harm over
    the layers, utility and coverage."""
    long = materialize(_given_scores(spark, directory))
    ruled = studies.authorized(long, materialize(studies.coverage_thresholds(long, SELECTIVE_TARGETS)))
    per_layer = metrics.cluster_rate_bounds(ruled, ["model", "target", "threshold", "source_layer"])
    return studies.best_selective(per_layer, FLOOR)


@query(
    "T2_best_candidate",
    f"""{THRESHOLD_SQL}, {_rates_sql("model, target, threshold")}
    SELECT target, CAST(model AS INTEGER) AS model, threshold, coverage, far FROM rb
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY far NULLS LAST, abs(coverage - {COVERAGE}e0), cau DESC, model) = 1""",
    ("target", "threshold", "coverage", "far"),
)
def best_candidate(spark, directory):
    """Of the scores at each target the one with least harm, then nearest coverage, then utility."""
    long = materialize(_given_scores(spark, directory))
    ruled = studies.authorized(long, materialize(studies.coverage_thresholds(long, SELECTIVE_TARGETS)))
    rates = metrics.cluster_rate_metrics(ruled, ["target", "model", "threshold"]).withColumn("c", F.col("model").cast("double"))
    return studies.best_candidate(rates, ["target"], COVERAGE).select("target", "model", "threshold", "coverage", "far")
