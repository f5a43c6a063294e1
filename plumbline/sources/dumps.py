"""Stored scores of finished runs and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_candidates(df: DataFrame, path: str, keys: Sequence[str] = ("method", "seed"), force: bool = False) -> None:
    """Score tables in one folder per run. ``force`` replaces only the runs being written."""
    writer = df.write.partitionBy(*keys)
    if force:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def read_candidates(spark: SparkSession, path: str, method: str | None = None, seed: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if method is not None:
        df = df.where(F.col("method") == method)
    return df if seed is None else df.where(F.col("seed") == seed)


def available_runs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Stored runs whose tag ``<method>_seed<seed>`` starts with the prefix."""
    tag = F.concat(F.col("method"), F.lit("_seed"), F.col("seed").cast("string"))
    return spark.read.parquet(path).select("method", "seed").distinct().withColumn("tag", tag).where(F.col("tag").startswith(prefix))


def per_image(images: DataFrame, detections: DataFrame, boxes: DataFrame, group: str = "grp") -> DataFrame:
    """One row per image: its group, predictions (best score first, ties by id) and true boxes (by id).

    An image without detections or boxes has empty arrays. A task holds the boxes of an image at a time.
    """
    corners = ("x1", "y1", "x2", "y2")

    def listed(df: DataFrame, order: Sequence[Column], fields: Sequence[str], name: str) -> DataFrame:
        keyed = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*fields).alias("v"))
        return df.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["v"]).alias(name))

    preds = listed(detections, [-F.col("score"), F.col("det_id")], ("det_id", "score", *corners), "preds")
    gts = listed(boxes, [F.col("gt_id")], ("gt_id", *corners), "gts")
    return (
        images.select("image_id", group)
        .join(preds, "image_id", "left")
        .join(gts, "image_id", "left")
        .withColumns({name: F.coalesce(F.col(name), F.array().cast(dict(df.dtypes)[name])) for name, df in (("preds", preds), ("gts", gts))})
    )


def pending_runs(requested: DataFrame, finished: DataFrame, keys: Sequence[str] = ("method", "seed"), force: bool = False) -> DataFrame:
    """Requested runs that still have to be done; all of them under ``force``."""
    if force:
        return requested
    return requested.join(finished.select(*keys).distinct(), list(keys), "left_anti")


REPORT_NAME = r"^report_(.+)_seed(\d+)\.json$"


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Report files as (method, seed, report text); files with other names drop out."""
    name = F.col("_metadata.file_name")
    return (
        spark.read.text(glob, wholetext=True)
        .select(
            F.regexp_extract(name, REPORT_NAME, 1).alias("method"),
            F.regexp_extract(name, REPORT_NAME, 2).alias("seed"),
            F.col("value").alias("report"),
        )
        .where("seed <> ''")
        .withColumn("seed", F.col("seed").cast("int"))
    )


def report_figures(reports: DataFrame) -> DataFrame:
    """Headline figures of read reports; undefined values and missing flags are NULL or false."""
    clean = F.regexp_replace("report", r"(:\s*)NaN\b", "$1null")
    body = F.from_json(
        clean,
        "detection struct<worst_group_AP50: double, mean_AP50: double, per_group_AP50: map<string,double>>, "
        "calibration struct<`D-ECE`: double>, collapsed boolean, reason string, n_candidates long",
    )
    return reports.withColumn("r", body).select(
        "method", "seed",
        F.col("r.detection.worst_group_AP50").alias("worst_group_ap50"),
        F.col("r.detection.mean_AP50").alias("mean_ap50"),
        F.col("r.detection.per_group_AP50").alias("per_group_ap50"),
        F.col("r.calibration.`D-ECE`").alias("ece"),
        F.coalesce("r.collapsed", F.lit(False)).alias("collapsed"),
        F.col("r.reason").alias("reason"),
        F.col("r.n_candidates").alias("n_candidates"),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object per run report."""
    reports.write.mode("overwrite").json(path)
