"""Detections against ground truth: best overlap, one-to-one flags, candidate rows.

Every detection only ever tries its best ground-truth box, so it is a true positive at
a threshold exactly when it is the highest scored detection among those whose best box
is the same and whose overlap reaches the threshold. No loop is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import Box, iou

COCO_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def _gridded(df: DataFrame, cell: float) -> DataFrame:
    """One row per grid cell that a box touches; empty and flipped boxes overlap nothing."""

    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    return (
        df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
        .withColumn("_cx", F.explode(span("x1", "x2")))
        .withColumn("_cy", F.explode(span("y1", "y2")))
    )


def overlapping_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = 256.0
) -> DataFrame:
    """Pairs of boxes of the same ``keys`` that overlap, with their ``iou``.

    Equi-join on (keys, grid cell): a crowded image is spread over its cells and boxes
    far apart never meet. A pair that shares several cells is kept only in the cell of
    its intersection's corner. Columns other than keys and corners must differ by name.
    """
    keys = list(keys)
    corners = ("x1", "y1", "x2", "y2")
    a = _gridded(left, cell)
    b = _gridded(right, cell)
    b = b.select(
        *keys, "_cx", "_cy", *[F.col(c).alias(f"_b_{c}") for c in corners],
        *[c for c in right.columns if c not in keys and c not in corners],
    )
    box_a, box_b = Box.of(), Box.of("_b_")
    here = (F.floor(F.greatest("x1", "_b_x1") / cell) == F.col("_cx")) & (
        F.floor(F.greatest("y1", "_b_y1") / cell) == F.col("_cy")
    )
    touching = (
        (F.col("x1") < F.col("_b_x2")) & (F.col("_b_x1") < F.col("x2"))
        & (F.col("y1") < F.col("_b_y2")) & (F.col("_b_y1") < F.col("y2"))
    )
    return (
        a.join(b, [*keys, "_cx", "_cy"])
        .where(touching & here)
        .withColumn("iou", iou(box_a, box_b))
        .drop("_cx", "_cy", *[f"_b_{c}" for c in corners])
    )


def _overlaps_with_truth(
    detections: DataFrame, boxes: DataFrame, keys: Sequence[str], cell: float
) -> DataFrame:
    """Overlapping (detection, box) pairs. Identical boxes collapse to their lowest
    ``gt_id`` before the join, as the other copies can never win."""
    corners = ["x1", "y1", "x2", "y2"]
    distinct_boxes = boxes.groupBy(*keys, *corners).agg(F.min("gt_id").alias("gt_id"))
    return overlapping_pairs(detections, distinct_boxes, keys, cell)


def _better() -> Column:
    """Orders boxes for one detection: larger overlap first, then the lower ``gt_id``."""
    return F.struct(F.col("iou"), (-F.col("gt_id")).alias("g"))


def best_overlap(
    detections: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("image_id",), cell: float = 256.0
) -> DataFrame:
    """Every detection with ``iou`` and ``gt_id`` of its best box (0 and NULL without one).

    ``detections`` needs a unique ``det_id`` per keys, ``boxes`` a ``gt_id``. Detections
    without a partner ride along as rows with overlap 0, so one aggregation is enough.
    """
    keys = list(keys)
    extra = [c for c in detections.columns if c not in keys and c != "det_id"]
    pairs = _overlaps_with_truth(detections, boxes, keys, cell)
    none = detections.select(
        "*", F.lit(None).cast(boxes.schema["gt_id"].dataType).alias("gt_id"), F.lit(0.0).alias("iou")
    )
    return (
        pairs.unionByName(none)
        .groupBy(*keys, "det_id")
        .agg(F.max(_better()).alias("_best"), *[F.first(c).alias(c) for c in extra])
        .select(
            *keys, "det_id", *extra, (-F.col("_best.g")).alias("gt_id"), F.col("_best.iou").alias("iou")
        )
    )


def true_positives(
    detections: DataFrame,
    boxes: DataFrame,
    thresholds: Sequence[float] = (0.5,),
    keys: Sequence[str] = ("image_id",),
    carry: Sequence[str] = (),
    cell: float = 256.0,
) -> DataFrame:
    """One row per true positive: (keys, iou_threshold, gt_id, det_id, score, iou, carry).

    Greedy, score ranked and one to one; ties in score go to the lower ``det_id``.
    Everything else in ``detections`` is a false positive. Both steps are aggregations,
    so many detections on one box, or many boxes in one image, never meet in one task.
    """
    keys, carry = list(keys), list(carry)
    narrow = detections.select(*keys, "det_id", "score", *carry, "x1", "y1", "x2", "y2")
    chosen = (
        _overlaps_with_truth(narrow, boxes, keys, cell)
        .groupBy(*keys, "det_id")
        .agg(F.max(_better()).alias("b"), F.first("score").alias("score"), *[F.first(c).alias(c) for c in carry])
        .where(F.col("b.iou") >= min(thresholds))
        .select(*keys, "det_id", "score", *carry, (-F.col("b.g")).alias("gt_id"), F.col("b.iou").alias("iou"))
    )
    first = F.struct((-F.col("score")).alias("s"), F.col("det_id"), F.col("score"), F.col("iou"), *carry)
    winners = chosen.groupBy(*keys, "gt_id").agg(
        *[F.min(F.when(F.col("iou") >= t, first)).alias(f"w{i}") for i, t in enumerate(thresholds)]
    )
    per_level = F.array(
        *[
            F.struct(F.lit(float(t)).alias("iou_threshold"), F.col(f"w{i}").alias("w"))
            for i, t in enumerate(thresholds)
        ]
    )
    return (
        winners.select(*keys, "gt_id", F.inline(per_level))
        .where("w IS NOT NULL")
        .select(*keys, "iou_threshold", "gt_id", "w.det_id", "w.score", "w.iou", *[f"w.{c}" for c in carry])
    )


def flag_matches(
    detections: DataFrame, boxes: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Every detection with ``tp`` 0/1 and the ``iou`` of the match (0 for false positives)."""
    hits = true_positives(detections, boxes, (threshold,), keys).select(*keys, "det_id", "iou", F.lit(1).alias("tp"))
    return detections.join(hits, [*keys, "det_id"], "left").withColumns(
        {"tp": F.coalesce("tp", F.lit(0)), "iou": F.coalesce("iou", F.lit(0.0))}
    )


def label_candidates(best: DataFrame, positive_iou: float = 0.5) -> DataFrame:
    """Detections as candidates: label 1 from the positive overlap on, whoever else matched."""
    return best.withColumn("label", (F.col("iou") >= positive_iou).cast("int")).withColumn("origin", F.lit("det"))


def with_truth_positives(candidates: DataFrame, boxes: DataFrame, logit: str = "det_logit") -> DataFrame:
    """Candidates plus every ground-truth box as a positive with no detector logit."""
    truth = boxes.select(
        *[c for c in boxes.columns if c in candidates.columns and c not in ("label", "iou", "origin", logit)],
        F.lit(1).alias("label"),
        F.lit(1.0).alias("iou"),
        F.lit("gt").alias("origin"),
        F.lit(None).cast("double").alias(logit),
    )
    return candidates.unionByName(truth, allowMissingColumns=True)
