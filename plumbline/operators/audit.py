"""Corpus audit: exact copies, leaks between splits, composition and box statistics.

Copies are counted and labelled through their content hash by aggregation, so a hash
that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.ranking import exact_quantiles, running_totals

SPLIT_ORDER = ("train", "val", "test")
Z_ALPHA, Z_POWER = 1.959963985, 0.8416212336  # fixed values: two-sided 5 %, power 80 %


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def split_rank(split: Column, order: Sequence[str] = SPLIT_ORDER) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), split)


def exact_copies(df: DataFrame, row_id: str = "image_id", digest: str = "digest") -> DataFrame:
    """Every row that has copies: (id, digest, first_id, copies).

    A star around the smallest id instead of a list per group: linear in the rows.
    """
    groups = (
        df.groupBy(digest)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_id"))
        .where("copies > 1")
    )
    return df.select(row_id, digest).join(groups, digest)


def cross_split_leaks(df: DataFrame, digest: str = "digest", split: str = "split") -> DataFrame:
    """Digests present in more than one split, with the rows per split."""
    per_split = df.groupBy(digest, split).agg(F.count(F.lit(1)).alias("c"))
    return (
        per_split.groupBy(digest)
        .agg(
            F.count(F.lit(1)).alias("splits"),
            F.sum("c").alias("rows"),
            *[F.sum(F.when(F.col(split) == s, F.col("c")).otherwise(0)).alias(f"in_{s}") for s in SPLIT_ORDER],
        )
        .where("splits > 1")
    )


def leaked_ids(df: DataFrame, row_id: str = "image_id", digest: str = "digest", into: str = "test", source: str = "train") -> DataFrame:
    """Ids of one split whose content also occurs in another."""
    seen = df.where(F.col("split") == source).select(digest).distinct()
    return df.where(F.col("split") == into).join(seen, digest, "left_semi").select(row_id)


def first_occurrences(df: DataFrame, row_id: str = "image_id", digest: str = "digest", order: Sequence[str] = SPLIT_ORDER) -> DataFrame:
    """The row kept of every content: earlier split first, then the smaller id.

    Copies inside one split are dropped as well.
    """
    ranked = F.struct(split_rank(F.col("split"), order).alias("r"), F.col(row_id).alias("id"), F.col("split"))
    return df.groupBy(digest).agg(F.min(ranked).alias("k")).select(F.col("k.id").alias(row_id), "k.split", digest)


def removal_counts(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows before, kept and removed per split."""
    both = df.select("split", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        kept.select("split", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return both.groupBy("split").agg(
        F.sum("a").alias("before"), F.sum("b").alias("kept"), (F.sum("a") - F.sum("b")).alias("removed")
    )


def boxes_of(kept: DataFrame, boxes: DataFrame, image: str = "image_id") -> DataFrame:
    return boxes.join(kept.select(image), image, "left_semi")


def group_distribution(images: DataFrame) -> DataFrame:
    return images.groupBy(F.concat_ws("/", "camera", "background").alias("grp")).agg(F.count(F.lit(1)).alias("images"))


def group_shares(images: DataFrame, keys: Sequence[str] = ("split",), group: str = "background") -> DataFrame:
    """Group sizes per key and their share in percent, one decimal."""
    sizes = images.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("images"))
    total = F.sum("images").over(W.partitionBy(*keys))
    return sizes.withColumn("pct", F.round(F.col("images") * 100.0 / total, 1))


def zero_filled_counts(groups: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Count per group of the dimension table, 0 where a group has no rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def group_index(images: DataFrame) -> DataFrame:
    """Dimension table (camera, background, group_id): camera number * backgrounds + background number.

    Numbers follow the alphabetical order of the names seen, which are ranked by ranges.
    """
    def numbered(col: str) -> DataFrame:
        names = running_totals(images.select(col).where(F.col(col).isNotNull()).distinct(), [], [F.col(col)], {})
        return names.select(col, (F.col("rank") - 1).alias(f"{col}_no"), F.col("n").alias(f"{col}_all"))

    pairs = images.select("camera", "background").distinct()
    return (
        pairs.join(numbered("camera"), "camera")
        .join(numbered("background"), "background")
        .select(
            "camera",
            "background",
            (F.col("camera_no") * F.col("background_all") + F.col("background_no")).cast("int").alias("group_id"),
            F.col("background_all").cast("int").alias("backgrounds"),
        )
    )


def boxes_per_image(images: DataFrame, boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """Images with their number of boxes, 0 included; boxes are counted before the join."""
    counts = boxes.groupBy(image).agg(F.count(F.lit(1)).alias("boxes"))
    return images.join(counts, image, "left").withColumn("boxes", F.coalesce("boxes", F.lit(0)))


def box_statistics(boxes: DataFrame, group: str, images: DataFrame | None = None) -> DataFrame:
    """n, mean, population deviation, min, p50, p95, max of w, h, area, aspect ratio.

    One row per measure and group, plus group ``pooled``; with ``images`` also the boxes
    per image. Boxes without extent are left out. Quantiles are exact.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sized = boxes.where((w > 0) & (h > 0)).select(
        "image_id",
        F.col(group).cast("string").alias("grp"),
        F.inline(
            F.array(
                F.struct(F.lit("width").alias("measure"), w.alias("value")),
                F.struct(F.lit("height").alias("measure"), (h).alias("value")),
                F.struct(F.lit("area").alias("measure"), (w * h).alias("value")),
                F.struct(
                    F.lit("aspect_ratio").alias("measure"),
                    (F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-6))).alias("value"),
                ),
            )
        ),
    )
    # (measure, group, distinct value) carries everything below
    counted = sized.groupBy("measure", "grp", "value").agg(F.count(F.lit(1)).alias("c"))
    counted = counted.withColumn("grp", F.explode(F.array("grp", F.lit("pooled"))))
    if images is not None:
        per_image = boxes_per_image(images.select("image_id"), boxes.where((w > 0) & (h > 0)))
        counted = counted.unionByName(
            per_image.groupBy(F.col("boxes").cast("double").alias("value"))
            .agg(F.count(F.lit(1)).alias("c"))
            .select(F.lit("boxes_per_image").alias("measure"), F.lit("pooled").alias("grp"), "value", "c")
        )
    counted = counted.groupBy("measure", "grp", "value").agg(F.sum("c").alias("c"))
    keys = ["measure", "grp"]
    v, c = F.col("value"), F.col("c")
    moments = counted.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        (F.sum(c * v) / F.sum("c")).alias("mean"),
        F.sqrt(F.greatest(F.sum(c * v * v) / F.sum("c") - F.pow(F.sum(c * v) / F.sum("c"), F.lit(2)), F.lit(0.0))).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(counted, keys, "value", [0.5, 0.95], weight="c")
    wide = q.groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95"),
    )
    return moments.join(wide, keys)


def finer_level_advice(stats: DataFrame, stride: int = 8, group: str = "pooled") -> DataFrame:
    """Recommend a finer feature level when the median width or height is below the stride."""
    median = {m: F.max(F.when(F.col("measure") == m, F.col("p50"))) for m in ("width", "height")}
    return stats.where(F.col("grp") == group).agg(
        median["width"].alias("median_w"),
        median["height"].alias("median_h"),
        F.lit(stride).alias("stride"),
        F.coalesce((median["width"] < stride) | (median["height"] < stride), F.lit(False)).alias("finer_level"),
    )


def split_composition(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images, boxes and boxes per image for every split, with its share of all images."""
    counted = boxes_per_image(images.select("image_id", "split"), boxes)
    base = counted.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"),
        F.sum("boxes").alias("boxes"),
        F.avg("boxes").alias("mean_boxes"),
        F.min("boxes").alias("min_boxes"),
        F.max("boxes").alias("max_boxes"),
        F.count(F.when(F.col("boxes") == 0, 1)).alias("empty_images"),
    )
    median = exact_quantiles(counted.select("split", "boxes"), ["split"], "boxes", [0.5])
    share = F.round(F.col("images") * 100.0 / F.sum("images").over(W.partitionBy(F.lit(1))), 1)
    return base.join(median.select("split", F.col("quantile").alias("median_boxes")), "split").withColumn("pct", share)


def group_boxes(images: DataFrame, boxes: DataFrame, group: str = "background") -> DataFrame:
    """Images and boxes per split and group, and of all splits together (split ``all``)."""
    counted = boxes_per_image(images.select("image_id", "split", group), boxes)
    return (
        counted.groupBy("split", group)
        .agg(F.count(F.lit(1)).alias("images"), F.sum("boxes").alias("boxes"))
        .withColumn("split", F.explode(F.array("split", F.lit("all"))))
        .groupBy("split", group)
        .agg(F.sum("images").alias("images"), F.sum("boxes").alias("boxes"))
    )


def share_drift(shares: DataFrame, group: str = "background", splits: Sequence[str] = SPLIT_ORDER) -> DataFrame:
    """Per group: its share in every split (0 where absent) and the largest difference."""
    wide = shares.groupBy(group).pivot("split", list(splits)).agg(F.first("pct")).na.fill(0.0)
    cols = [F.col(s) for s in splits]
    return wide.withColumn("drift", F.round(F.greatest(*cols) - F.least(*cols), 1))


def metadata_crosstab(
    images: DataFrame, metadata: DataFrame, file_name: str = "file_name", column: str = "background", order: str | None = None
) -> DataFrame:
    """Metadata values per split by base name of the file; NULL counts the misses.

    Of several metadata rows for a name the last by ``order`` counts; without ``order`` the one
    of the greatest value.
    """
    last = F.struct(F.col(order or column), F.col(column).alias("v"))
    metadata = metadata.groupBy(file_name).agg(F.max(last)["v"].alias(column))
    base = F.substring_index(F.col(file_name), "/", -1)
    return (
        images.withColumn("_base", base)
        .join(metadata.select(F.col(file_name).alias("_base"), F.col(column).alias("value")), "_base", "left")
        .groupBy("split", "value")
        .agg(F.count(F.lit(1)).alias("images"))
    )


def detectable_gap(n_a: Column, n_b: Column, rate: float = 0.5) -> Column:
    """Smallest difference of two rates that samples of these sizes can show."""
    one = F.lit(1)
    spread = F.sqrt(rate * (1.0 - rate) * (1.0 / F.greatest(n_a, one) + 1.0 / F.greatest(n_b, one)))
    return (Z_ALPHA + Z_POWER) * spread


def minority_detail(images: DataFrame, candidates: DataFrame, keys: Sequence[str], image: str = "image_id") -> DataFrame:
    """Nominal images, images with and without candidates and candidates of a group, per run.

    ``images`` are the images of the group; ``candidates`` its rows in every run.
    """
    per_image = candidates.groupBy(*keys, image).agg(F.count(F.lit(1)).alias("c"))
    nominal = images.agg(F.countDistinct(image)).scalar()
    return per_image.groupBy(*keys).agg(
        F.sum("c").alias("candidates"),
        F.count(F.lit(1)).alias("contributing_images"),
        F.max("c").alias("most_per_image"),
    ).withColumn("nominal_images", nominal).withColumn(
        "empty_images", F.col("nominal_images") - F.col("contributing_images")
    )


def candidates_per_image(candidates: DataFrame, keys: Sequence[str], image: str = "image_id") -> DataFrame:
    return candidates.groupBy(*keys, image).agg(F.count(F.lit(1)).alias("candidates"))


def images_without_candidates(
    images: DataFrame, candidates: DataFrame, keys: Sequence[str] = (), image: str = "image_id"
) -> DataFrame:
    """Images that no candidate names; with ``keys`` once per run that has none of the image.

    Runs are few; an image carries the runs that name it, and gives a row for each of the others.
    """
    if not keys:
        return images.select(image).join(candidates.select(image).distinct(), image, "left_anti")
    run = F.struct(*keys)
    named = candidates.groupBy(image).agg(F.collect_set(run).alias("_in"))
    runs = candidates.select(*keys).distinct().agg(F.collect_list(run)).scalar()
    listed = images.select(image).distinct().join(named, image, "left").withColumn("_all", runs)
    missing = F.when(F.col("_in").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_in"))
    return listed.select(image, F.explode(missing).alias("_run")).select("_run.*", image)
