"""Authorization models with pyspark.ml: fit, score, choose thresholds, audit.

Features are standardised and one-hot encoded, classes are balanced by weight.
Solvers differ from other libraries, so agreement with them is statistical."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigate.operators.distributed import grouped_quantiles, materialize
from verdigate.operators.labels import coerce_features
from verdigate.operators.metrics import cluster_rate_bounds

NUMERIC = ("confidence", "uncertainty", "expected_edge_bps", "liquidity_cost_bps",
           "turnover_cost_bps", "fee_bps", "volatility_proxy")
CATEGORICAL = ("source_role",)
LABEL = "training_label"


@dataclass(frozen=True)
class Features:
    numeric: Sequence[str] = NUMERIC
    categorical: Sequence[str] = CATEGORICAL

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def balanced(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, int]:
    """Class weights n / (2 n_c); a single class is an error."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        raise ValueError("training data has one class")
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    return df.withColumn("class_weight", weight), n


def fit(
    train: DataFrame, features: Features, learner: str = "logistic", c: float = 1.0, seed: int = 7,
    label: str = LABEL, iterations: int = 50,
) -> PipelineModel:
    """Preprocessing and classifier as one fitted pipeline.

    The features are written once: every stage of the pipeline reads them, and the plan
    of `train` is neither run again nor carried by the fitted model.
    """
    ready = materialize(
        coerce_features(train, features.numeric, features.categorical)
        .select(*features.all, F.col(label).cast("double").alias(label))
    )
    weighted, n = balanced(ready, label)
    indexed = [f"{f}_index" for f in features.categorical]
    hot = [f"{f}_hot" for f in features.categorical]
    stages = [
        StringIndexer(inputCols=list(features.categorical), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep", dropLast=False),
        VectorAssembler(inputCols=list(features.numeric), outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
    ]
    common = {"labelCol": label, "featuresCol": "features"}
    if learner in ("logistic", "selective_logistic"):
        # The summed weights are n, so this equals an L2 penalty of 1/C on summed loss.
        model = LogisticRegression(
            weightCol="class_weight", regParam=1.0 / (c * n), standardization=False,
            maxIter=iterations, **common,
        )
    elif learner == "boosting":
        model = GBTClassifier(weightCol="class_weight", maxIter=10, maxDepth=4, seed=seed, **common)
    elif learner == "perceptron":
        # Width of the encoded vector: one slot per level and one for unseen levels.
        width = len(features.numeric)
        encoded = Pipeline(stages=stages[:2]).fit(weighted)
        for size in encoded.stages[1].categorySizes:
            width += size + 1
        model = MultilayerPerceptronClassifier(
            layers=[width, 16, 2], maxIter=iterations, seed=seed, **common
        )
    else:
        raise KeyError(f"unknown learner: {learner}")
    return Pipeline(stages=[*stages, model]).fit(weighted)


def score(model: PipelineModel, df: DataFrame, features: Features, name: str = "score") -> DataFrame:
    """The frame with the positive-class probability; encoded columns are dropped."""
    ready = coerce_features(df, features.numeric, features.categorical)
    kept = [F.col(c) for c in df.columns]
    return model.transform(ready).select(
        *kept, vector_to_array("probability")[1].alias(name)
    )


def coverage_threshold(scored: DataFrame, target: float, name: str = "score") -> float:
    """Score at the 1 - target quantile, taking the higher neighbour."""
    row = grouped_quantiles(scored, [], name, {"t": 1.0 - target}, method="higher").first()
    return row["value"]


def authorize(scored: DataFrame, threshold: float, name: str = "score") -> DataFrame:
    return scored.withColumn("authorized", F.col(name) >= threshold)


def selective_threshold(
    scored: DataFrame, layer: str, targets: Sequence[float], coverage_floor: float,
    z: float = 1.645, name: str = "score",
) -> tuple[float, float, bool]:
    """Threshold among target coverages: valid first, then the smallest worst harm,
    mean harm, highest utility, largest coverage."""
    thresholds = {
        row["quantile"]: row["value"]
        for row in grouped_quantiles(
            scored, [], name, {str(t): 1.0 - t for t in targets}, method="higher"
        ).collect()
    }
    cuts = F.array(
        *[
            F.struct(F.lit(float(t)).alias("target"), F.lit(thresholds[str(t)]).alias("threshold"))
            for t in targets
        ]
    )
    long = scored.select("*", F.inline(cuts)).withColumn(
        "authorized", F.col(name) >= F.col("threshold")
    )
    per_layer = cluster_rate_bounds(long, ["target", "threshold", layer], z)
    floor = F.min("coverage_lcb95")
    valid = (F.count("far") > 0) & (floor >= coverage_floor)
    ranked = per_layer.groupBy("target", "threshold").agg(
        F.when(valid, 0).otherwise(1).alias("invalid"),
        F.coalesce(F.max("far"), F.lit(float("inf"))).alias("max_far"),
        F.coalesce(F.avg("far"), F.lit(float("inf"))).alias("mean_far"),
        F.avg("cau").alias("mean_cau"),
    )
    best = ranked.orderBy(
        "invalid", "max_far", "mean_far", F.desc("mean_cau"), F.desc("target")
    ).first()
    return best["threshold"], best["target"], best["invalid"] == 0


def coefficients(model: PipelineModel, features: Features) -> list[tuple[str, float]]:
    """Absolute coefficients by encoded feature name."""
    encoder, classifier = model.stages[1], model.stages[-1]
    names = list(features.numeric)
    for f, size, labels in zip(
        features.categorical, encoder.categorySizes, model.stages[0].labelsArray
    ):
        levels = [*labels, "unseen"][:size]
        names += [f"{f}={v}" for v in levels] + [f"{f}=invalid"] * (size + 1 - len(levels))
    values = classifier.coefficients.toArray()
    return [(n, abs(float(v))) for n, v in zip(names, values)]
