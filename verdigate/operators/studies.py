"""Training studies as keyed jobs: all samples drawn at once, all models fitted as groups
of one job, all candidates scored in one pass over the validation rows.

A sample has at most as many rows as its budget, so one task fits a model.  Models are
few (variants or curricula x budgets x seeds x candidates of the study) and small, and
travel to the scoring tasks with the code.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.operators import models, perceptron
from verdigate.operators.distributed import grouped_quantiles, materialize
from verdigate.operators.labels import coerce_features
from verdigate.operators.learn import Features

# Executors need not have this package.
cloudpickle.register_pickle_by_value(models)
cloudpickle.register_pickle_by_value(perceptron)


#: Numbers of `draw_number` lie below this.
NUMBERS = float(1 << 52)


def draw_number(*parts: Column) -> Column:
    """52 bits of a hash as a whole number, which a double holds exactly."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def draw(
    pool: DataFrame, groups: Sequence[str], cluster: str, row_id: str, quotas: DataFrame, seeds: Sequence[int]
) -> DataFrame:
    """For each group and seed the first `quota` clusters of a seeded order, one row each.

    `quotas` has the groups and `quota`.  Adds `seed` and `draw`, the place in the order
    from 0, so that smaller quotas are prefixes.  Clusters are counted; those in the part of
    the hash's range that holds somewhat more than the quota are sorted, and a larger part
    is taken if one group got too few.  Clusters beyond it are hashed, never moved.  A pool
    with too few clusters is an error.
    """
    groups = list(groups)
    clusters = materialize(pool.select(*groups, cluster).distinct())
    sizes = materialize(clusters.groupBy(*groups).agg(F.count("*").alias("n")).join(F.broadcast(quotas), groups))
    short = sizes.filter("n < quota").first()
    if short:
        raise ValueError(f"pool {[short[g] for g in groups]} has {short['n']} clusters; requested {short['quota']}")
    wide = [F.struct(F.lit(s).alias("seed"), draw_number(F.lit("cluster"), *map(F.col, groups), F.lit(s), F.col(cluster)).alias("_order")) for s in seeds]
    of = Window.partitionBy(*groups, "seed").orderBy("_order", cluster)
    margin = 1.0
    while True:
        # The hash is even, so somewhat more than the quota lie below this part of its range.
        part = (F.col("quota") + 8 * F.sqrt("quota") + 16) * margin / F.col("n")
        cuts = sizes.select(*groups, "quota", (part * NUMBERS).alias("_cut"))
        below = materialize(
            clusters.join(cuts, groups).select(*groups, cluster, "quota", "_cut", F.inline(F.array(*wide))).filter("_order <= _cut")
        )
        found = below.groupBy(*groups, "seed", "quota").agg(F.count("*").alias("found")).agg(
            F.count("*").alias("groups"), F.count_if(F.col("found") < F.col("quota")).alias("lacking")
        ).first()
        if found["lacking"] == 0 and found["groups"] == cuts.filter("quota > 0").count() * len(seeds):
            break
        margin *= 4
    chosen = below.withColumn("draw", F.row_number().over(of) - 1).filter("draw < quota").select(
        *groups, cluster, "seed", "draw"
    )
    rows = pool.join(materialize(chosen), [*groups, cluster])
    order = F.struct(draw_number(F.lit("row"), F.col("seed"), F.col(row_id)), F.col(row_id))
    kept = [c for c in pool.columns if c not in (*groups, cluster)]
    return (
        rows.groupBy(*groups, "seed", cluster, "draw")
        .agg(F.min_by(F.struct(*kept), order).alias("_r"))
        .select(*groups, "seed", "draw", cluster, *[F.col(f"_r.{c}").alias(c) for c in kept])
    )


def fit_all(
    samples: DataFrame, keys: Sequence[str], candidates: Sequence[tuple[str, float]], features: Features,
    label: str = "training_label", row_id: str = "row_id",
) -> DataFrame:
    """One row per model: keys, learner, c, model (JSON), steps (of the perceptron).  A task
    fits a model, whatever the learner.

    `samples` has one bounded group per value of `keys` (with `seed` among them);
    `candidates` are pairs of learner and C.  A sample with one class is an error.
    """
    keys = list(keys)
    held = F.pmod(F.xxhash64("_id", "seed"), F.lit(10)) == 0
    ready = coerce_features(samples, features.numeric, features.categorical).select(
        *keys, F.col(label).cast("double").alias("_label"), F.col(row_id).cast("string").alias("_id"), *features.all
    ).withColumn("_held", held)
    tried = F.array(*[F.struct(F.lit(a).alias("learner"), F.lit(float(c)).alias("c")) for a, c in candidates])
    numeric, categorical = list(features.numeric), list(features.categorical)
    schema = T.StructType([
        *[ready.schema[k] for k in keys], T.StructField("learner", T.StringType()), T.StructField("c", T.DoubleType()),
        T.StructField("model", T.StringType()), T.StructField("steps", T.IntegerType()),
    ])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id")
        first, steps = group.iloc[0], 0
        if first["learner"] == "perceptron":
            how = models.encoder(group, numeric, categorical)
            y = group["_label"].to_numpy(float)
            layers, steps = perceptron.fit_sample(
                models.encode(how, group), y, models.balanced_weights(y), group["_held"].to_numpy(bool)
            )
            made = json.dumps({"how": how, "layers": [(w.tolist(), b.tolist()) for w, b in layers]})
        else:
            made = models.fit(
                group, "_label", numeric, categorical, first["learner"], first["c"], int(first["seed"])
            )
        return group.iloc[:1][[*keys, "learner", "c"]].assign(model=made, steps=steps)

    of = [*keys, "learner", "c"]
    # Samples are small, so a number of tasks is asked for: fits take time, not bytes.
    tasks = int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    crossed = ready.select("*", F.inline(tried)).repartition(tasks, *of)
    return materialize(crossed.groupBy(*of).applyInPandas(one, schema))


#: What a masked feature becomes.
MASKED = {"text": "masked", "number": 0.0}


def score_all(rows: DataFrame, fitted: Sequence, features: Features, kept: Sequence[str],
              masks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """`kept` columns of each row and `scores`, one per model of the list `fitted`, written down.

    A model whose `mask` names a group of `masks` sees those features blanked.
    """
    stack = _stack(fitted, features, masks)
    ready = coerce_features(rows.select(*kept, *[c for c in features.all if c not in kept]), features.numeric, features.categorical)
    schema = T.StructType([*[ready.schema[c] for c in kept], T.StructField("scores", T.ArrayType(T.DoubleType()))])
    kept = list(kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[kept].assign(scores=list(stack.scores(batch)))

    return materialize(ready.mapInPandas(run, schema))


def _stack(fitted: Sequence, features: Features, masks: Mapping[str, Sequence[str]] | None) -> models.Stack:
    parsed = [(json.loads(m["model"]), list((masks or {}).get(_mask_of(m), ()))) for m in fitted]
    return models.Stack(parsed, features.numeric, features.categorical, MASKED["text"], MASKED["number"])


def _mask_of(model) -> str | None:
    return model["mask"] if "mask" in model else None


def by_model(scored: DataFrame) -> DataFrame:
    """One row per row and model: `model` (place in the list) and `score`."""
    return scored.select(*[c for c in scored.columns if c != "scores"], F.posexplode("scores").alias("model", "score"))


def coverage_thresholds(long: DataFrame, targets: Sequence[float]) -> DataFrame:
    """model, target, threshold: the score at the 1 - target quantile of each model, the
    higher neighbour."""
    probs = {str(t): 1.0 - t for t in targets}
    found = grouped_quantiles(long, ["model"], "score", probs, method="higher")
    return found.select("model", F.col("quantile").cast("double").alias("target"), F.col("value").alias("threshold"))


def authorized(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows of the models that have a threshold, with `authorized`; the table of
    thresholds has some rows per model."""
    return long.join(thresholds, "model").withColumn("authorized", F.col("score") >= F.col("threshold"))


#: Cells that a round of `exact_thresholds` cuts an interval into, rows of an interval whose
#: scores may be handed on, and rounds: after two an interval is a millionth wide, and what
#: is left in it are mostly equal scores, which are handed on as one row a task.  A round
#: scores all rows again and costs more than handing on 20,000 scores of each interval.
CELLS, HANDED_ON, ROUNDS = 1024, 20_000, 2
#: Bits of a score, read as a whole number, order like the scores; NaN comes last.
LAST = 0x7FF8_0000_0000_0000


def exact_thresholds(
    rows: DataFrame, fitted: Sequence, features: Features, targets: Sequence[float],
    masks: Mapping[str, Sequence[str]] | None = None, cells: int = CELLS, handed_on: int = HANDED_ON,
) -> list[dict[float, float]]:
    """For every model of the list `fitted` the score at the 1 - target quantile of the
    rows, the higher neighbour, by target.

    Scores are neither written nor shuffled.  A pass scores the rows again and counts them
    in cells of the interval that holds a wanted rank, until few rows are left in it; the
    last pass hands on these scores with their counts.
    """
    ready = coerce_features(rows.select(*features.all), features.numeric, features.categorical)
    n = ready.count()
    if not n:
        return [{} for _ in fitted]
    wanted = {(m, t): math.ceil((n - 1) * (1.0 - t)) for m in range(len(fitted)) for t in targets}
    # By model and target: first and last whole number of the interval, rows before, rows inside.
    state = {k: (0, LAST, 0, n) for k in wanted}
    for _ in range(ROUNDS):
        asked = sorted({(m, *s[:2]) for (m, _), s in state.items() if s[3] > handed_on and s[0] < s[1]})
        if not asked:
            break
        counted = _cell_counts(ready, *_only(asked, fitted, features, masks), cells)
        for (m, t), (first, last, before, _) in state.items():
            if (m, first, last) not in counted:
                continue
            edges, counts = counted[m, first, last]
            ends = before + np.cumsum(counts)
            cell = int(np.searchsorted(ends, wanted[m, t], side="right"))
            state[m, t] = (int(edges[cell]), int(edges[cell + 1]) - 1, int(ends[cell] - counts[cell]), int(counts[cell]))
    stack = _stack(fitted, features, masks)
    parts = sorted({(m, *s[:2]) for (m, _), s in state.items()})
    ranks = [(parts.index((m, *s[:2])), m, t, wanted[m, t] - s[2]) for (m, t), s in state.items()]
    ranks = ready.sparkSession.createDataFrame(ranks, "asked int, model int, target double, rank long")
    upto = Window.partitionBy("asked").orderBy("score")
    ended = _inside_scores(ready, stack, parts).withColumn("end", F.sum("rows").over(upto))
    at = ended.join(F.broadcast(ranks), "asked").filter("rank < end and rank >= end - rows")
    found = [{} for _ in fitted]
    for row in at.select("model", "target", "score").collect():
        found[row["model"]][row["target"]] = row["score"]
    return found


def _only(asked: list[tuple[int, int, int]], fitted: Sequence, features: Features, masks) -> tuple[models.Stack, list[int], list]:
    """The models that are asked for, the column of each interval among them, and the intervals."""
    used = sorted({m for m, _, _ in asked})
    return _stack([fitted[m] for m in used], features, masks), [used.index(m) for m, _, _ in asked], asked


def _edges(first: int, last: int, cells: int) -> np.ndarray:
    """Where cells begin, and the end.  The first interval is cut evenly in scores from 0 to 1."""
    if (first, last) == (0, LAST):
        steps = (np.arange(cells) / cells).view(np.int64).tolist()
        one = int(np.array([1.0]).view(np.int64)[0])
        return np.array([*steps, one, one + 1, LAST + 1], np.int64)
    width = -(-(last + 1 - first) // cells)
    return np.array([*range(first, last + 1, width), last + 1], np.int64)


def _cell_counts(
    ready: DataFrame, stack: models.Stack, columns: list[int], asked: list[tuple[int, int, int]], cells: int,
) -> dict:
    """Rows in each cell of the intervals asked for."""
    edges = [_edges(first, last, cells) for _, first, last in asked]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(len(e) - 1, np.int64) for e in edges]
        for batch in batches:
            bits = np.ascontiguousarray(stack.scores(batch).T).view(np.int64)
            for k, (m, (_, first, last)) in enumerate(zip(columns, asked)):
                if (first, last) == (0, LAST):
                    # Cells are even: a power of two times the score is exact.
                    x = bits[m].view(np.float64)
                    at = np.where(np.isnan(x), cells + 1, x * cells).astype(np.int64)
                else:
                    inside = bits[m][(bits[m] >= first) & (bits[m] <= last)]
                    at = (inside - first) // (edges[k][1] - edges[k][0])
                total[k] += np.bincount(at, minlength=len(total[k]))
        yield pd.DataFrame({"asked": range(len(asked)), "counts": [t.tolist() for t in total]})

    counts = [np.zeros(len(e) - 1, np.int64) for e in edges]
    cell = ready.mapInPandas(run, "asked int, counts array<long>").select("asked", F.posexplode("counts").alias("cell", "rows"))
    for row in cell.filter("rows > 0").groupBy("asked", "cell").agg(F.sum("rows").alias("rows")).toLocalIterator():
        counts[row["asked"]][row["cell"]] = row["rows"]
    return {a: (e, c) for a, e, c in zip(asked, edges, counts)}


def _inside_scores(ready: DataFrame, stack: models.Stack, asked: list[tuple[int, int, int]]) -> DataFrame:
    """Scores in the intervals asked for and how many rows have each: asked, score, rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.ascontiguousarray(stack.scores(batch).T).view(np.int64)
            parts = []
            for k, (m, first, last) in enumerate(asked):
                inside, counts = np.unique(bits[m][(bits[m] >= first) & (bits[m] <= last)], return_counts=True)
                parts.append((np.full(len(inside), k), inside.view(np.float64), counts))
            of, scores, counts = (np.concatenate(p) for p in zip(*parts))
            yield pd.DataFrame({"asked": of, "score": scores, "rows": counts})

    found = ready.mapInPandas(run, "asked int, score double, rows long")
    return found.groupBy("asked", "score").agg(F.sum("rows").alias("rows"))


def cluster_rates(
    rows: DataFrame, fitted: Sequence, rulings: Sequence[tuple[int, float]], features: Features,
    frames: Mapping[str, Column], masks: Mapping[str, Sequence[str]] | None = None, z: float = 1.645,
    cluster: str = "evaluation_cluster_id",
) -> DataFrame:
    """`metrics.cluster_rate_bounds` of every ruling (place in `fitted`, threshold) and frame:
    ruling, frame and the rates.

    Rows are shuffled once, by cluster, whatever the number of models.  A task scores its
    rows, sums them by cluster and hands on sums of cluster rates, one row per ruling and frame.
    """
    used = sorted({m for m, _ in rulings})
    stack = _stack([fitted[m] for m in used], features, masks)
    column = np.array([used.index(m) for m, _ in rulings], np.intp)
    cuts = np.array([c for _, c in rulings], float)
    names = list(frames)
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(frames.values())), F.lit(0))
    ready = coerce_features(rows, features.numeric, features.categorical).select(
        F.col(cluster).alias("_cluster"), bits.alias("_frames"), (F.coalesce(F.col("authorization_harm") == 1, F.lit(False))).alias("_harm"),
        F.coalesce(F.col("authority_laundering").cast("boolean"), F.lit(False)).alias("_tainted"),
        F.coalesce(F.col("full_utility").cast("double"), F.lit(0.0)).alias("_utility"), *features.all,
    ).filter("_frames > 0")
    dealt = ready.repartition("_cluster").sortWithinPartitions("_cluster")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # By frame: rows, clusters, then per ruling taken rows, count, sum and sum of squares of each measure, utility.
        total = np.zeros((len(names), 11, len(cuts)))
        open_: dict[int, tuple] = {}

        def add(frame: int, rows_: np.ndarray, sums: np.ndarray) -> None:
            taken, harmed, tainted, utility = sums
            out = total[frame]
            out[0] += rows_.sum()
            out[1] += len(rows_)
            out[2] += taken.sum(axis=0)
            some, of = taken > 0, np.maximum(taken, 1.0)
            for k, rate in enumerate((taken / rows_[:, None], harmed / of, tainted / of)):
                out[3 + 2 * k] += rate.sum(axis=0)
                out[4 + 2 * k] += (rate * rate).sum(axis=0)
            out[9] += some.sum(axis=0)
            out[10] += utility.sum(axis=0)

        for batch in batches:
            names_ = batch["_cluster"].to_numpy()
            taken = (stack.scores(batch)[:, column] >= cuts).astype(float)
            member, harm = batch["_frames"].to_numpy(), batch["_harm"].to_numpy(float)
            tainted, utility = batch["_tainted"].to_numpy(float), batch["_utility"].to_numpy(float)
            for f in range(len(names)):
                at = np.nonzero(member & (1 << f))[0]
                if not len(at):
                    continue
                own = names_[at]
                begins = np.r_[0, np.nonzero(own[1:] != own[:-1])[0] + 1]
                some = taken[at]
                sums = np.stack([
                    np.add.reduceat(some * w[at][:, None] if w is not None else some, begins, axis=0)
                    for w in (None, harm, tainted, utility)
                ])
                rows_ = np.diff(np.r_[begins, len(at)]).astype(float)
                last = own[begins]
                if f in open_:
                    name, before, parts = open_.pop(f)
                    if name == last[0]:
                        rows_[0] += before
                        sums[:, 0] += parts
                    else:
                        add(f, np.array([before]), parts[:, None])
                # The last cluster may go on in the next batch.
                add(f, rows_[:-1], sums[:, :-1])
                open_[f] = (last[-1], rows_[-1], sums[:, -1])
        for f, (_, before, parts) in open_.items():
            add(f, np.array([before]), parts[:, None])
        for f, sums in enumerate(total):
            if sums[0, 0]:
                yield pd.DataFrame({
                    "ruling": range(len(cuts)), "frame": names[f], "sums": sums.T.tolist(),
                })

    parts = dealt.mapInPandas(run, "ruling int, frame string, sums array<double>")
    kept = ("_rows", "_clusters", "_taken", "_coverage", "_coverage2", "_far", "_far2", "_alr", "_alr2", "_some", "_cau")
    summed = parts.groupBy("ruling", "frame").agg(*[F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(kept)])

    def mean(c: str) -> Column:
        n = F.col("_clusters" if c == "coverage" else "_some")
        return F.when(n > 0, F.col(f"_{c}") / n)

    def bound(c: str, sign: float) -> Column:
        n = F.col("_clusters" if c == "coverage" else "_some")
        spread = F.greatest(F.col(f"_{c}2") - F.col(f"_{c}") * F.col(f"_{c}") / n, F.lit(0.0))
        se = F.when(n > 1, F.sqrt(spread / (n - 1)) / F.sqrt(n))
        edge = F.least(F.greatest(mean(c) + F.lit(sign * z) * se, F.lit(0.0)), F.lit(1.0))
        return F.when(n == 1, mean(c)).otherwise(edge)

    return summed.select(
        "ruling", "frame", F.col("_rows").cast("bigint").alias("rows"), F.col("_clusters").cast("bigint").alias("clusters"),
        F.col("_taken").cast("bigint").alias("authorized_count"),
        mean("coverage").alias("coverage"), bound("coverage", -1.0).alias("coverage_lcb95"),
        mean("far").alias("far"), bound("far", 1.0).alias("far_ucb95"),
        mean("alr").alias("alr"), bound("alr", 1.0).alias("alr_ucb95"),
        (F.col("_cau") / F.col("_clusters")).alias("cau"),
    )


def best_candidate(metrics: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """Per key the candidate with the least harm rate, then nearest to the target
    coverage, then of highest utility, then of smallest C."""
    order = F.struct(
        F.coalesce("far", F.lit(float("inf"))), F.abs(F.col("coverage") - target), -F.col("cau"), F.col("c")
    )
    columns = [c for c in metrics.columns if c not in keys]
    return metrics.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_b")).select(
        *keys, *[F.col(f"_b.{c}").alias(c) for c in columns]
    )


def best_selective(per_layer: DataFrame, floor: float) -> DataFrame:
    """Of metrics per model, target, threshold and layer: the valid target with the
    smallest worst harm, mean harm, highest utility and largest coverage."""
    lowest = F.min("coverage_lcb95")
    ranked = per_layer.groupBy("model", "target", "threshold").agg(
        F.when((F.count("far") > 0) & (lowest >= floor), 0).otherwise(1).alias("invalid"),
        F.coalesce(F.max("far"), F.lit(float("inf"))).alias("max_far"),
        F.coalesce(F.avg("far"), F.lit(float("inf"))).alias("mean_far"),
        F.avg("cau").alias("mean_cau"),
    )
    order = F.struct("invalid", "max_far", "mean_far", -F.col("mean_cau"), -F.col("target"))
    return ranked.groupBy("model").agg(
        F.min_by(F.struct("target", "threshold", "invalid"), order).alias("_b")
    ).select("model", "_b.target", "_b.threshold", (F.col("_b.invalid") == 0).alias("floor_satisfied"))


def coefficients(fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, feature, coefficient of every logistic model."""
    schema = T.StructType([
        *[fitted.schema[k] for k in keys], T.StructField("feature", T.StringType()),
        T.StructField("coefficient", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                model = json.loads(row["model"])
                named = models.names(model["how"])
                yield pd.DataFrame({**{k: row[k] for k in keys}, "feature": named, "coefficient": model["coefficients"][:-1]})

    return fitted.select(*keys, "model").mapInPandas(run, schema)
