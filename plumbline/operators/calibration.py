"""Calibration error and its relatives, from one small table of bin sums per key.

Every metric here is a function of mergeable sums, so rows are aggregated once per
(keys, bin) on the map side and all pooled figures come from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scores import edge_bin, log_loss, squared_error, width_bin
from plumbline.operators.ranking import exact_quantiles
from plumbline.session import materialize

POOLED = "pooled"
_SUMS = ("n", "conf", "hits", "loc", "sq", "ll")


def bin_sums(
    df: DataFrame,
    keys: Sequence[str],
    conf: str,
    label: str = "label",
    iou: str | None = None,
    bins: int = 15,
    bin_column: Column | None = None,
) -> DataFrame:
    """(keys, bin) with n, sums of confidence, label, label*iou, squared error, log loss.

    Rows without a bin keep ``bin`` NULL: they count in n only.
    """
    c, y = F.col(conf).cast("double"), F.col(label).cast("double")
    loc = y * F.col(iou) if iou else F.lit(None).cast("double")
    return (
        df.withColumn("bin", width_bin(c, bins) if bin_column is None else bin_column)
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(c).alias("conf"),
            F.sum(y).alias("hits"),
            F.sum(loc).alias("loc"),
            F.sum(squared_error(c, y)).alias("sq"),
            F.sum(log_loss(c, y)).alias("ll"),
        )
    )


def with_pooled(sums: DataFrame, keys: Sequence[str], group: str, rest: Sequence[str] = ("bin",)) -> DataFrame:
    """Bin sums plus the same sums over all groups, under the group name ``pooled``."""
    both = sums.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit(POOLED))))
    return both.groupBy(*keys, group, *rest).agg(*[F.sum(c).alias(c) for c in _SUMS])


def metrics(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: n, ece, laece (NULL without overlaps), brier, nll."""
    inside = F.col("bin").isNotNull()
    total = F.sum("n")
    return sums.groupBy(*keys).agg(
        total.alias("n"),
        (F.sum(F.when(inside, F.abs(F.col("hits") - F.col("conf"))).otherwise(0.0)) / total).alias("ece"),
        F.when(
            F.count("loc") > 0, F.sum(F.when(inside, F.abs(F.col("conf") - F.col("loc"))).otherwise(0.0)) / total
        ).alias("laece"),
        (F.sum("sq") / total).alias("brier"),
        (F.sum("ll") / total).alias("nll"),
    )


def reliability_curve(sums: DataFrame, keys: Sequence[str], bins: int = 15) -> DataFrame:
    """All bins of every key; an empty bin sits at its centre with accuracy 0."""
    grid = sums.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    step = 1.0 / bins
    centre = ((F.col("bin") - 1) * F.lit(step) + F.col("bin") * F.lit(step)) / 2.0
    return grid.join(sums, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        F.coalesce(F.col("conf") / F.col("n"), centre).alias("confidence"),
        F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("accuracy"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def equal_mass_edges(df: DataFrame, keys: Sequence[str], conf: str, bins: int) -> DataFrame:
    """Quantile edges per key as a sorted array; ends forced to 0 and 1, repeats dropped."""
    inner = [i / bins for i in range(1, bins)]
    quantiles = exact_quantiles(df, keys, conf, inner)
    edges = F.array_distinct(
        F.concat(F.array(F.lit(0.0)), F.array_sort(F.collect_list("quantile")), F.array(F.lit(1.0)))
    )
    return quantiles.groupBy(*keys).agg(F.array_sort(edges).alias("edges"))


def equal_mass_ece(df: DataFrame, keys: Sequence[str], conf: str, label: str = "label", bins: int = 10) -> DataFrame:
    # written, so that its size is known and the rows are not dealt by their few keys
    edges = materialize(equal_mass_edges(df, keys, conf, bins))
    tagged = df.join(edges, list(keys))
    sums = bin_sums(tagged, keys, conf, label, bin_column=edge_bin(F.col(conf), F.col("edges")))
    return metrics(sums, keys).select(*keys, "ece")


def binning_robustness(
    df: DataFrame, keys: Sequence[str], group: str, conf: str, label: str = "label", widths: Sequence[int] = (10, 15, 20)
) -> DataFrame:
    """ECE under several equal-width binnings and one equal-mass binning, per group and pooled.

    The equal-width variants share one pass: rows are summed per combination of bins.
    """
    keys = list(keys)
    c, y = F.col(conf).cast("double"), F.col(label).cast("double")
    combined = (
        df.select(*keys, group, c.alias("c"), y.alias("y"), *[width_bin(c, w).alias(f"b{w}") for w in widths])
        .groupBy(*keys, group, *[f"b{w}" for w in widths])
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("conf"), F.sum("y").alias("hits"))
    )
    per_width = (
        combined.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit(POOLED))))
        .select(
            *keys,
            group,
            "n",
            "conf",
            "hits",
            F.inline(F.array(*[F.struct(F.lit(f"width {w}").alias("binning"), F.col(f"b{w}").alias("bin")) for w in widths])),
        )
        .groupBy(*keys, group, "binning", "bin")
        .agg(F.sum("n").alias("n"), F.sum("conf").alias("conf"), F.sum("hits").alias("hits"))
    )
    inside = F.when(F.col("bin").isNotNull(), F.abs(F.col("hits") - F.col("conf"))).otherwise(0.0)
    equal_width = per_width.groupBy(*keys, group, "binning").agg((F.sum(inside) / F.sum("n")).alias("ece"))
    both = df.select(*keys, conf, label, F.explode(F.array(F.col(group).cast("string"), F.lit(POOLED))).alias(group))
    equal_mass = equal_mass_ece(both, [*keys, group], conf, label, 10).withColumn("binning", F.lit("mass 10"))
    return equal_width.unionByName(equal_mass)


def stage_decomposition(df: DataFrame, keys: Sequence[str], group: str, scores: Sequence[str], label: str = "label") -> DataFrame:
    """ECE of several score columns per group and pooled: (keys, group, stage, ece).

    Each score is summed per bin in its own narrow projection, unpivoted before the
    aggregation so that one shuffle of partial sums serves all of them.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        group,
        F.col(label).alias("label"),
        F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("value")) for s in scores])),
    )
    sums = bin_sums(long, [*keys, group, "stage"], "value")
    pooled = with_pooled(sums, [*keys, "stage"], group)
    return metrics(pooled, [*keys, "stage", group]).select(*keys, group, "stage", "ece")


def calibration_report(
    df: DataFrame, keys: Sequence[str], group: str, conf: str = "fused", label: str = "label", iou: str | None = "iou", bins: int = 15, at_least: int = 5
) -> DataFrame:
    """Pooled metrics per key, ECE per group with enough rows (map) and the worst of them."""
    keys = list(keys)
    sums = with_pooled(bin_sums(df, [*keys, group], conf, label, iou, bins), keys, group)
    m = metrics(sums, [*keys, group])
    is_pool = F.col(group) == POOLED
    counted = ~is_pool & (F.col("n") >= at_least)
    return m.groupBy(*keys).agg(
        *[F.max(F.when(is_pool, F.col(c))).alias(c) for c in ("n", "ece", "brier", "nll", "laece")],
        F.count(F.when(counted, 1)).alias("groups_counted"),
        F.max(F.when(counted, F.col("ece"))).alias("worst_group_ece"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(counted, F.struct(F.col(group), F.col("ece")))))
        ).alias("per_group_ece"),
    )


def candidate_counts(df: DataFrame, keys: Sequence[str], conf: str, label: str = "label", image: str = "image_id", bins: int = 15) -> DataFrame:
    """n, distinct images, positives, positive rate and ECE per key.

    Rows collapse to (keys, image) and (keys, bin) sums; no key is gathered in one task.
    """
    keys = list(keys)
    ece = metrics(bin_sums(df, keys, conf, label, bins=bins), keys).select(*keys, "ece")
    per_image = df.groupBy(*keys, image).agg(F.count(F.lit(1)).alias("c"), F.sum(label).alias("p"))
    counts = per_image.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("images"), F.sum("p").alias("positives")
    )
    return counts.join(ece, keys).withColumn("positive_rate", F.col("positives") / F.col("n"))


def bin_occupancy(df: DataFrame, keys: Sequence[str], conf: str, bins: int = 15) -> DataFrame:
    """Counts per bin (array), occupied bins, bins with one row, median of the occupied."""
    sums = bin_sums(df.withColumn("_y", F.lit(0)), keys, conf, "_y", bins=bins)
    curve = reliability_curve(sums, keys, bins)
    some = F.when(F.col("n") > 0, F.col("n"))
    return curve.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"]
        ).alias("counts"),
        F.count(some).alias("occupied_bins"),
        F.count(F.when(F.col("n") == 1, 1)).alias("bins_with_one"),
        F.floor(F.coalesce(F.percentile(some, 0.5), F.lit(0.0))).alias("median_occupied"),
    )


def false_positive_effect(df: DataFrame, keys: Sequence[str], before: str, after: str, label: str = "label", cut: float = 0.5) -> DataFrame:
    """False positives of two scores at a cut, the reduction and the share of negatives rejected."""
    negative = F.col(label) == 0
    fp_before = F.count(F.when(negative & (F.col(before) >= cut), 1))
    fp_after = F.count(F.when(negative & (F.col(after) >= cut), 1))
    n_neg = F.count(F.when(negative, 1))
    one = F.lit(1)
    return df.groupBy(*keys).agg(
        n_neg.alias("negatives"),
        fp_before.alias("fp_before"),
        fp_after.alias("fp_after"),
        ((fp_before - fp_after) / F.greatest(one, fp_before)).alias("fp_reduction"),
        (F.count(F.when(negative & (F.col(after) < cut), 1)) / F.greatest(one, n_neg)).alias("negatives_rejected"),
    )
