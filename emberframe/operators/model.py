"""Logistic baseline: training, many-model scoring and evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.probability import sigmoid
from emberframe.operators import metrics
from emberframe.session import cut_lineage

ALPHA = 1e-4


def fit_scaler(matrix: DataFrame, features: str = "features") -> DataFrame:
    """Mean and population deviation per feature, ``(i, mean, std)``, from one vector aggregate.

    One buffer holds all features, so hundreds of them neither widen the plan nor the exchange.
    """
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(features))
    row = matrix.agg(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"),
        F.col("s.count").alias("n"),
    )
    each = row.select("n", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "m"))
    population = F.when(F.col("n") > 1, F.col("m.variance") * (F.col("n") - 1) / F.col("n")).otherwise(F.lit(0.0))
    return each.select("i", F.col("m.mean").alias("mean"), F.sqrt(population).alias("std"))


def standardise(matrix: DataFrame, scaler: DataFrame, features: str = "features") -> DataFrame:
    """(x - mean) / std per feature; a constant feature is only centred."""
    entry = F.struct("i", "mean", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("std"))
    packed = scaler.agg(F.array_sort(F.collect_list(entry)).alias("s")).scalar()
    scaled = F.zip_with(features, F.col("_s"), lambda x, s: (x - s["mean"]) / s["std"])
    return matrix.withColumn("_s", packed).withColumn(features, scaled).drop("_s")


def weighted(matrix: DataFrame, w: float, label: str = "label") -> DataFrame:
    """Row weights n/n_c, no-fire multiplied by ``w``."""
    weights = metrics.class_weights(matrix, w, label).select(F.struct("no_fire_weight", "fire_weight").alias("w")).scalar()
    pick = F.when(F.col(label) == 0, F.col("_w.no_fire_weight")).otherwise(F.col("_w.fire_weight"))
    return matrix.withColumn("_w", weights).withColumn("weight", pick).drop("_w")


def train_logistic(matrix: DataFrame, w: float, alpha: float = ALPHA, max_iter: int = 30) -> LogisticRegressionModel:
    """L2-regularised logistic regression with class weights (full-batch solver)."""
    rows = weighted(matrix, w).select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "weight"
    )
    solver = LogisticRegression(
        weightCol="weight", regParam=alpha, elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )
    return solver.fit(rows)


def _curves(points: np.ndarray, class_weights: np.ndarray):
    """Partial sums of a partition at one point per model, as rows (model, row, sums).

    Row ``i`` of a model holds row ``i`` of its weighted second-moment matrix (intercept last), then entry ``i`` of its gradient and its loss.
    """
    models, size = points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((models, size, size + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.column_stack([values.reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            z = x @ points.T
            p = np.exp(-np.logaddexp(0, -z))
            for k in range(models):
                weight = class_weights[k][(y != 0).astype(int)]
                sums[k, :, :size] += (x * (weight * p[:, k] * (1 - p[:, k]))[:, None]).T @ x
                sums[k, :, size] += (weight * (p[:, k] - y)) @ x
                sums[k, :, size + 1] += (weight * (np.logaddexp(0, z[:, k]) - y * z[:, k])).sum()
        flat = pa.array(sums.ravel())
        offsets = pa.array(np.arange(models * size + 1) * (size + 2), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(models), size), pa.int32()), pa.array(np.tile(np.arange(size), models), pa.int32()),
             pa.ListArray.from_arrays(offsets, flat)],
            names=["model", "row", "sums"],
        )

    return run


def train_sweep(
    matrix: DataFrame, w_values: list[float], alpha: float = ALPHA, max_iter: int = 30, tolerance: float = 1e-9
) -> dict[float, tuple[list[float], float]]:
    """One model per no-fire weight, all fitted together: ``{w: (coefficients, intercept)}``.

    Each iteration is one scan that sums the gradient and curvature of every open model (Newton's method); a model
    whose loss grows goes back half a step. The sums of a partition are added row by row of each model's
    matrix, so neither a task nor the driver holds more than the models do. Ends when every gradient is below
    ``tolerance`` or after ``max_iter`` scans. The loss is that of ``train_logistic``; the rows must be complete
    (no null feature or label). With one class alone the intercept is infinite and all else zero.
    """
    rows = cut_lineage(matrix.select("features", F.col("label").cast("double").alias("label")), "matrix")
    count = rows.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"), F.max(F.size("features")).alias("d")).first()
    if not count["n0"] + count["n1"]:
        raise ValueError("no rows to train on")
    if not count["n0"] or not count["n1"]:
        return {float(w): ([0.0] * count["d"], math.inf if count["n1"] else -math.inf) for w in w_values}
    n, size = count["n0"] + count["n1"], count["d"] + 1
    weights = np.array([[float(w) * n / count["n0"], n / count["n1"]] for w in w_values])
    total = weights @ [count["n0"], count["n1"]]
    ridge = np.append(np.full(size - 1, alpha), 0.0)
    at, best, step = np.zeros((len(w_values), size)), np.full(len(w_values), np.inf), np.zeros((len(w_values), size))
    open_ = np.arange(len(w_values))
    for _ in range(max_iter):
        part = rows.mapInArrow(_curves((at + step)[open_], weights[open_]), "model int, row int, sums array<double>")
        folded = part.groupBy("model", "row").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
        sums = np.zeros((len(open_), size, size + 2))
        for entry in folded:
            sums[entry["model"], entry["row"]] = entry["sums"]
        left = []
        for k, m in enumerate(open_):
            here = at[m] + step[m]
            loss = sums[k, 0, size + 1] / total[m] + 0.5 * ridge @ here**2
            if not loss <= best[m] + 1e-12 * abs(loss):
                step[m] /= 2
                left.append(m)
                continue
            at[m], best[m] = here, loss
            slope = sums[k, :, size] / total[m] + ridge * here
            curve = sums[k, :, :size] / total[m] + np.diag(ridge)
            step[m] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            if np.abs(slope).max() > tolerance:
                left.append(m)
            else:
                step[m] = 0
        open_ = np.array(left, dtype=int)
        if not len(open_):
            break
    return {float(w): (at[m, :-1].tolist(), float(at[m, -1])) for m, w in enumerate(w_values)}


def loss_gradient(
    matrix: DataFrame, w: float, coefficients: list[float], intercept: float, alpha: float = ALPHA, label: str = "label"
) -> DataFrame:
    """One row: the gradient of the weighted, regularised loss at a model; zeros where the solver has converged."""
    rows = weighted(matrix, w, label).withColumn(
        "_e", F.col("weight") * (sigmoid(linear_score(F.col("features"), coefficients, intercept)) - F.col(label))
    )
    total = F.sum("weight")
    slopes = [F.sum(F.col("_e") * F.element_at("features", i + 1)) / total + F.lit(alpha * c) for i, c in enumerate(coefficients)]
    return rows.agg(F.array(*slopes).alias("slopes"), (F.sum("_e") / total).alias("intercept"))


def linear_score(features: Column, coefficients: list[float], intercept: float) -> Column:
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    products = F.zip_with(features, weights, lambda x, c: x * c)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v) + F.lit(float(intercept))


def score_models(matrix: DataFrame, models: dict[float, tuple[list[float], float]], features: str = "features") -> DataFrame:
    """One probability column per model in a single pass over the pixels."""
    return matrix.withColumns(
        {f"p_{i}": sigmoid(linear_score(F.col(features), c, b)) for i, (c, b) in enumerate(models.values())}
    )


def evaluate(scored: DataFrame, w_values: list[float], threshold: float = 0.5, label: str = "label") -> DataFrame:
    """Threshold and curve metrics per model over every pixel of a split.

    The model columns become rows and fold into distinct scores; counts at the threshold and curves both come
    from that table, so the scored pixels are read once.
    """
    entries = [
        F.struct(F.lit(i).alias("ord"), F.lit(float(w)).alias("w"), F.col(f"p_{i}").alias("score"))
        for i, w in enumerate(w_values)
    ]
    long = scored.select(F.explode(F.array(*entries)).alias("m"), label).select("m.*", label)
    keys = ("ord", "w")
    grouped = cut_lineage(metrics.score_counts(long, "score", label, keys), "score-counts")
    hit = F.col("threshold") >= threshold
    count = lambda of, on: F.coalesce(F.sum(F.when(on, F.col(of))), F.lit(0))
    counts = grouped.groupBy(*keys).agg(
        count("pos", hit).alias("tp"), count("neg", hit).alias("fp"), count("pos", ~hit).alias("fn"), count("neg", ~hit).alias("tn")
    )
    return metrics.with_rates(counts).join(metrics.summary_of(grouped, keys), list(keys))


def select_best(sweep: DataFrame, metric: str = "auc_pr") -> DataFrame:
    return metrics.best_of(sweep, metric, "ord", ["w"])
