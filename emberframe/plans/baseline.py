"""Logistic baseline: patches, balanced training pixels, weight sweep, full-grid evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators import model, sampling, stencil
from emberframe.operators.tiles import PIXEL
from emberframe.session import cut_lineage


@dataclass
class BaselineConfig:
    channels: list[str]
    keys: tuple[str, ...]
    grid: int
    patch: int = 3
    max_positive: int = 500_000
    negative_ratio: float = 1.0
    w_values: list[float] = field(default_factory=lambda: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])
    threshold: float = 0.5
    seed: int = 42
    alpha: float = model.ALPHA
    max_iter: int = 30


def pixel_matrix(cells: DataFrame, config: BaselineConfig) -> DataFrame:
    """``(keys, split, pixel, label, features)``: labels with one-pixel holes filled, patch features."""
    burned = cells.where(F.col("label") > 0)
    filled = stencil.fill_holes(burned, config.keys, 1, config.grid).withColumn("_f", F.lit(1))
    patches = stencil.extract_patches(
        cells.select(*config.keys, "split", *PIXEL, *config.channels), config.channels, config.patch, config.keys
    )
    labelled = patches.join(filled, [*config.keys, *PIXEL], "left")
    return labelled.select(
        *config.keys, "split", *PIXEL, F.coalesce("_f", F.lit(0)).alias("label"), "features"
    )


def run(cells: DataFrame, config: BaselineConfig) -> tuple[DataFrame, DataFrame]:
    """``(sweep on validation, test metrics of the selected model)``.

    Training rows are bounded by the quotas and written once; validation and test pixels are
    scored by all models in one pass each.
    """
    rows = pixel_matrix(cells, config)
    keys = [*config.keys, *PIXEL]
    train = cut_lineage(
        sampling.balanced_sample(
            rows.where("split = 'train'"), keys, config.max_positive, config.negative_ratio, config.seed
        )
    )
    scaler = cut_lineage(model.fit_scaler(train))
    models = model.train_sweep(model.standardise(train, scaler), config.w_values, config.alpha, config.max_iter)

    def evaluate(split: str, chosen: dict) -> DataFrame:
        scaled = model.standardise(rows.where(F.col("split") == split), scaler)
        return model.evaluate(model.score_models(scaled, chosen), list(chosen), config.threshold)

    sweep = cut_lineage(evaluate("val", models))
    best = model.select_best(sweep).first()["w"]
    return sweep, evaluate("test", {best: models[best]})
