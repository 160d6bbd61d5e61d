"""Pixel metrics, precision-recall curves, losses and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.probability import decide, safe_divide, sigmoid, softplus
from emberframe.operators import stencil
from emberframe.operators.ranking import running_sums

BINNED_THRESHOLDS = 200
CLASS_WEIGHTS = (1.0, 10.0, 50.0)


def _ratio(a, b) -> Column:
    return safe_divide(a.cast("double"), b.cast("double"))


def confusion(scored: DataFrame, predicted: Column, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    truth = F.col(label) == 1
    return scored.groupBy(*keys).agg(
        F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "iou": _ratio(tp, tp + fp + fn), "dice": _ratio(2 * tp, 2 * tp + fp + fn),
            "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def binary_metrics(
    scored: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5,
    inclusive: bool = True, keys: tuple[str, ...] = (),
) -> DataFrame:
    return with_rates(confusion(scored, decide(F.col(score), threshold, inclusive), label, keys))


def class_metrics(pairs: DataFrame, classes: int, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per-class IoU and Dice from global counts; -1 where a class never occurs."""
    cells = pairs.groupBy(truth, predicted).agg(F.count("*").alias("n"))  # at most classes**2 rows
    each = cells.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    t, p = F.col(truth) == F.col("class"), F.col(predicted) == F.col("class")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    counts = each.groupBy("class").agg(
        part(t & p).alias("tp"), part(~t & p).alias("fp"), part(t & ~p).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    absent = tp + fp + fn == 0
    return counts.withColumns(
        {
            "iou": F.when(absent, F.lit(-1.0)).otherwise(_ratio(tp, tp + fp + fn)),
            "dice": F.when(absent, F.lit(-1.0)).otherwise(_ratio(2 * tp, 2 * tp + fp + fn)),
        }
    )


def macro_metrics(per_class: DataFrame) -> DataFrame:
    valid = lambda c: F.coalesce(F.avg(F.when(F.col(c) != -1.0, F.col(c))), F.lit(0.0))
    return per_class.agg(valid("iou").alias("macro_iou"), valid("dice").alias("macro_dice"))


def pr_curve(scored: DataFrame, score: str = "score", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact curve: one point per distinct score, counted from the highest score down.

    Rows fold into distinct scores first; the running sums are two-level, so no task sees the
    whole curve.  ``keys`` (a model id, say) gives one curve each in the same pass.
    """
    return curve_of(score_counts(scored, score, label, keys), keys)


def score_counts(scored: DataFrame, score: str = "score", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both classes per distinct score."""
    return scored.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def curve_of(grouped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    curve = running_sums(grouped, "threshold", {"pos": "tp", "neg": "fp"}, descending=True, group=list(keys))
    return curve.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def pr_summary(scored: DataFrame, score: str = "score", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoid area and average precision of the exact curve; 0 when only one class occurs.

    The point before each one is the running sum without its own rows; the curve starts at
    recall 0, precision 1.
    """
    return summary_of(score_counts(scored, score, label, keys), keys)


def summary_of(grouped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    curve = curve_of(grouped, keys)
    before_tp, before_n = F.col("tp") - F.col("pos"), F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")
    before_precision = F.when(before_n == 0, F.lit(1.0)).otherwise(F.try_divide(before_tp.cast("double"), before_n))
    summed = curve.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("precision") + before_precision) / 2).alias("_area"),
        F.sum(F.col("pos") * F.col("precision")).alias("_steps"),
        F.sum("pos").alias("positive_rows"), F.sum("neg").alias("negative_rows"),
    )
    both = (F.col("positive_rows") > 0) & (F.col("negative_rows") > 0)
    share = lambda c: F.when(both, F.col(c) / F.col("positive_rows")).otherwise(F.lit(0.0))
    return summed.select(
        *keys, share("_area").alias("auc_pr"), share("_steps").alias("average_precision"),
        "positive_rows", "negative_rows",
    )


def binned_pr_curve(scored: DataFrame, score: str = "score", label: str = "label", thresholds: int = BINNED_THRESHOLDS) -> DataFrame:
    """Curve at evenly spaced thresholds from a histogram; an undefined precision counts as 1.

    The histogram has ``thresholds`` rows, so the reverse running sum over it is bounded.
    """
    top = thresholds - 1
    # score >= bin / top decides, as the thresholds are doubles; the product alone may fall on the wrong side.
    near = F.floor(F.col(score) * top)
    near = near + (F.col(score) >= (near + 1) / F.lit(float(top))).cast("int") - (F.col(score) < near / F.lit(float(top))).cast("int")
    bin_of = F.least(F.greatest(near, F.lit(0)), F.lit(top)).cast("int")
    hist = scored.groupBy(bin_of.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    axis = scored.sparkSession.range(thresholds).select(F.col("id").cast("int").alias("bin"))
    filled = axis.join(F.broadcast(hist), "bin", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    curve = filled.withColumns(
        {"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "positives": F.sum("pos").over(every)}
    )
    n = F.col("tp") + F.col("fp")
    return curve.select(
        "bin", "tp", "fp",
        F.when(n == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("tp").cast("double"), n)).alias("precision"),
        _ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )


def binned_pr_summary(scored: DataFrame, score: str = "score", label: str = "label", thresholds: int = BINNED_THRESHOLDS) -> DataFrame:
    curve = binned_pr_curve(scored, score, label, thresholds)
    by_bin = Window.orderBy("bin")
    nxt = lambda c, end: F.coalesce(F.lead(c).over(by_bin), F.lit(end))
    steps = curve.withColumns({"_r": nxt("recall", 0.0), "_p": nxt("precision", 1.0)})
    width = F.col("recall") - F.col("_r")
    return steps.agg(
        F.sum(width * F.col("precision")).alias("average_precision"),
        F.sum(width * (F.col("precision") + F.col("_p")) / 2).alias("auc_pr"),
    )


def bce(logit: Column, label: Column) -> Column:
    return softplus(logit) - logit * label


def focal(logit: Column, label: Column, alpha: float = 0.85, gamma: float = 2.0) -> Column:
    loss = bce(logit, label)
    weight = F.when(label == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return weight * F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss


def loss_metrics(
    scored: DataFrame, logit: str = "logit", label: str = "label", alpha: float = 0.85, gamma: float = 2.0,
    smooth: float = 1e-6, focal_weight: float = 0.5, dice_weight: float = 0.5,
) -> DataFrame:
    """BCE, focal, soft Dice and the weighted combination over a table, in one aggregate."""
    z, y = F.col(logit), F.col(label).cast("double")
    p = sigmoid(z)
    sums = scored.agg(
        F.avg(bce(z, y)).alias("bce"), F.avg(focal(z, y, alpha, gamma)).alias("focal"),
        F.sum(p * y).alias("_i"), F.sum(p).alias("_p"), F.sum(y).alias("_y"),
    )
    dice = 1 - (2 * F.col("_i") + smooth) / (F.col("_p") + F.col("_y") + smooth)
    return sums.withColumn("dice_loss", dice).select(
        "bce", "focal", "dice_loss",
        (focal_weight * F.col("focal") + dice_weight * F.col("dice_loss")).alias("combined"),
    )


def weighted_cross_entropy(scored: DataFrame, logits: list[str], label: str = "label", weights: tuple[float, ...] = CLASS_WEIGHTS) -> DataFrame:
    """Class-weighted cross entropy, normalised by the weights of the rows."""
    cols = [F.col(c) for c in logits]
    top = F.greatest(*cols)
    total = sum((F.exp(c - top) for c in cols[1:]), F.exp(cols[0] - top))
    pick = lambda items: F.element_at(F.array(*items), F.col(label).cast("int") + 1)
    nll = F.log(total) + top - pick(cols)
    weight = pick([F.lit(w) for w in weights])
    return scored.agg((F.sum(weight * nll) / F.sum(weight)).alias("cross_entropy"))


def class_weights(labels: DataFrame, w: float, label: str = "label") -> DataFrame:
    """Balanced weights n/n_c, the no-fire one multiplied by ``w``."""
    n = F.count("*").cast("double")
    return labels.agg(
        (F.try_divide(n, F.count_if(F.col(label) == 0)) * F.lit(float(w))).alias("no_fire_weight"),
        F.try_divide(n, F.count_if(F.col(label) == 1)).alias("fire_weight"),
    )


def coarse_metrics(truth: DataFrame, predicted: DataFrame, keys: tuple[str, ...], grid: int, factor: int = 2) -> DataFrame:
    """Metrics on closed and max-pooled sparse masks; cells in neither mask are true negatives."""
    cells = [*keys, "pixel_y", "pixel_x"]

    def coarse(mask: DataFrame, name: str) -> DataFrame:
        closed = stencil.close_mask(mask, keys, grid)
        return stencil.pool(closed, factor, keys, {name: F.max(F.lit(True))})

    both = coarse(truth, "t").join(coarse(predicted, "p"), cells, "full")
    hit = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.agg(
        F.count_if(hit("t") & hit("p")).alias("tp"), F.count_if(~hit("t") & hit("p")).alias("fp"),
        F.count_if(hit("t") & ~hit("p")).alias("fn"),
    )


def coarse_evaluation(
    cells: DataFrame, keys: tuple[str, ...], grid: int, score: str = "score", label: str = "label", threshold: float = 0.5, factor: int = 2,
) -> DataFrame:
    """All counts, rates and the exact precision-recall summary on closed, max-pooled scores and labels of dense tiles."""
    closed = stencil.close_dense(cells.withColumns({score: F.col(score).cast("double"), label: F.col(label).cast("double")}), score, keys)
    closed = stencil.close_dense(closed, label, keys)
    pooled = stencil.pool(closed, factor, keys, {score: F.max(score), label: F.max(label).cast("int")}, grid)
    rates = with_rates(confusion(pooled, F.col(score) > threshold, label))
    return rates.crossJoin(pr_summary(pooled, score, label).drop("positive_rows", "negative_rows"))  # one row each


def results_by_run(metrics: DataFrame, value: str, runs: list[int]) -> DataFrame:
    """Architecture x run table."""
    return metrics.groupBy("architecture").agg(
        *[F.max(F.when(F.col("run") == n, F.col(value))).alias(f"run_{n}") for n in runs]
    )


def best_of(metrics: DataFrame, metric: str, order: str, keep: list[str], group: tuple[str, ...] = ()) -> DataFrame:
    """Row with the largest metric; the first in order wins ties."""
    rank = F.struct(F.col(metric), -F.col(order))
    picked = metrics.groupBy(*group).agg(F.max_by(F.struct(*keep, metric), rank).alias("_b"))
    return picked.select(*group, "_b.*")
