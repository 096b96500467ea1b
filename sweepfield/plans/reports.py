"""Scoring reports built from the metric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import (accuracy, balanced_confusion, class_iou, class_metrics, comparison_report, confusion,
                                 threshold_counts)


def validation_report(rows: DataFrame, proportions: DataFrame, labels: list[int], ignored: list[int], by: list[str]) -> dict[str, DataFrame]:
    """Confusion, balanced IoU and accuracy per group without the ignored labels."""
    kept = [l for l in labels if l not in ignored]
    conf = confusion(rows, kept, by=by)
    return {"confusion": conf, "metrics": class_metrics(conf, by), "accuracy": accuracy(conf, by),
            "balanced_iou": class_iou(balanced_confusion(conf, proportions, by), by)}


def comparison(cells: DataFrame, run: list[str], t_idx: str = "t_idx", truth: str = "truth", prob: str = "prob",
               n_thresh: int = 50, at: tuple[int, int] = (10, 20)) -> DataFrame:
    """AP, mAP and MSE of prediction runs straight from their cells."""
    counts = threshold_counts(cells, [*run, t_idx], truth, prob, n_thresh)
    gap = F.col(prob) - F.col(truth).cast("double")
    errors = cells.select(*run, (gap * gap).alias("sq_error"))
    return comparison_report(counts, errors, run, t_idx, at)
