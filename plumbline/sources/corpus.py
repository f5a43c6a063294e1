"""Reading and writing annotated corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ranking import running_totals
from plumbline.sources import images

IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")  # fixed values: order of preference
DEFAULT_CAMERA, DEFAULT_BACKGROUND = "unknown", "b0"  # fixed values: group without metadata

ANNOTATION_SCHEMA = """
    images array<struct<id: long, file_name: string, width: int, height: int, camera: string, background: string>>,
    annotations array<struct<id: long, image_id: long, bbox: array<double>, category_id: int, iscrowd: int, area: double>>,
    categories array<struct<id: int, name: string>>,
    _corrupt string
"""


def read_annotations(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per split document; ``split`` is the file name without its extension."""
    return (
        spark.read.schema(ANNOTATION_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(paths)
        .withColumn("split", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    )


def images_of(documents: DataFrame) -> DataFrame:
    return documents.select("split", F.inline("images")).withColumnRenamed("id", "image_id")


def boxes_of(documents: DataFrame) -> DataFrame:
    """Boxes with an extent, in corner form."""
    a = documents.select("split", F.inline("annotations")).where("bbox[2] > 0 AND bbox[3] > 0")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    return a.select(
        "split", "image_id", F.col("id").alias("gt_id"), "category_id",
        x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
    )


def read_label_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of ``labels/<split>/<stem>.txt``: (split, stem, line_no, line)."""
    files = spark.read.text(f"{root}/labels/*/*.txt", wholetext=True)
    path = F.col("_metadata.file_path")
    named = files.select(
        F.element_at(F.split(path, "/"), -2).alias("split"),
        F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("stem"),
        F.col("value"),
    )
    return named.select("split", "stem", F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("line_no", "line"))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(split, stem, ext, path, width, height, problem) of ``images/<split>/*``, unreadable files included."""
    return images.image_files(spark, f"{root}/images/*/*")


def preferred_image(files: DataFrame, keys: Sequence[str] = ("split", "stem")) -> DataFrame:
    """One file per stem: the first extension in the order of preference."""
    rank = F.array_position(F.array(*[F.lit(e) for e in IMAGE_EXTENSIONS]), F.col("ext"))
    rest = [c for c in files.columns if c not in keys]
    return (
        files.where(F.col("ext").isin(*IMAGE_EXTENSIONS))
        .groupBy(*keys)
        .agg(F.min(F.struct(rank.alias("r"), *rest)).alias("f"))
        .select(*keys, *[f"f.{c}" for c in rest])
    )


def metadata_lookup(rows: DataFrame, order: str, file_name: str = "file_name", camera: str = "camera", background: str = "background") -> DataFrame:
    """(file_name, camera, background); of several rows for a file the last one counts."""
    return (
        rows.groupBy(F.col(file_name).alias("file_name"))
        .agg(F.max(F.struct(F.col(order), F.col(camera).alias("c"), F.col(background).alias("b"))).alias("m"))
        .select("file_name", F.col("m.c").alias("camera"), F.col("m.b").alias("background"))
    )


def read_metadata(spark: SparkSession, path: str, file_name: str = "file_name", camera: str = "camera", background: str = "background") -> DataFrame:
    """Metadata CSV with a header; column names differ between corpora, hence arguments."""
    # the order of lines: by file name, by block of the file, by place in the block
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    rows = spark.read.option("header", True).csv(path).withColumn("_line", place)
    return metadata_lookup(rows, "_line", file_name, camera, background)


def with_groups(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Camera and background by base name of the file, with defaults for the misses."""
    base = F.substring_index(F.col("file_name"), "/", -1)
    renamed = metadata.select(F.col("file_name").alias("_base"), "camera", "background")
    return (
        images.drop("camera", "background")
        .withColumn("_base", base)
        .join(renamed, "_base", "left")
        .withColumns(
            {
                "camera": F.coalesce("camera", F.lit(DEFAULT_CAMERA)),
                "background": F.coalesce("background", F.lit(DEFAULT_BACKGROUND)),
            }
        )
        .drop("_base")
    )


def labels_to_boxes(lines: DataFrame, files: DataFrame, single_class: bool = True) -> tuple[DataFrame, DataFrame]:
    """Images and boxes from normalised ``class cx cy w h`` lines.

    Image ids number the label files of a split in name order, also those without an
    readable image, which then drop out. Lines with other than five fields are skipped.
    """
    stems = running_totals(lines.select("split", "stem").distinct(), ["split"], [F.col("stem")], {}).select(
        "split", "stem", (F.col("rank") - 1).alias("image_id")
    )
    readable = files.where("problem IS NULL") if "problem" in files.columns else files
    images = stems.join(preferred_image(readable), ["split", "stem"])
    field = F.split(F.trim("line"), r"\s+")
    good = lines.withColumn("f", field).where(F.size("f") == 5)
    cls, cx, cy, bw, bh = (F.col("f")[i].cast("double") for i in range(5))
    w, h = F.col("width"), F.col("height")
    placed = good.join(images, ["split", "stem"]).select(
        "split", "stem", "image_id", "line_no",
        (F.lit(1) if single_class else cls.cast("int") + 1).alias("category_id"),
        ((cx - bw / 2) * w).alias("x"), ((cy - bh / 2) * h).alias("y"), (bw * w).alias("w"), (bh * h).alias("h"),
    )
    numbered = running_totals(placed, ["split"], [F.col("stem"), F.col("line_no")], {})
    boxes = numbered.select(
        "split", "image_id", (F.col("rank") - 1).alias("gt_id"), "category_id",
        F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"),
    )
    return images, boxes


def content_digests(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of every file: (path, digest)."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", F.sha2("content", 256).alias("digest"))


ANNOTATED_CATEGORIES = ("Mannual", "Mannual_Seg")  # fixed values: folder names as published


def microscope_of(path: Column) -> Column:
    number = F.regexp_extract(path, r"Microscope-(\d)", 1)
    return F.when(number != "", F.concat(F.lit("micro"), number)).otherwise("unknown")


def category_of(path: Column) -> Column:
    """Parent folder name up to the microscope part."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    parts = F.filter(F.split(parent, r"_Microscope-\d"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), parent)


def describe_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """camera, category, background and whether annotations can be expected; thumbnails drop out."""
    p = F.col(path)
    name = F.substring_index(p, "/", -1)
    return files.where(~name.contains("Thumbs")).select(
        "*",
        microscope_of(p).alias("camera"),
        category_of(p).alias("category"),
        F.when(category_of(p) == "Without_bacilli", "zn_empty").otherwise("zn").alias("background"),
        category_of(p).isin(*ANNOTATED_CATEGORIES).alias("annotated"),
    )


def kept_images(images: DataFrame, boxes: DataFrame, include_backgrounds: bool, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Images with a positive box; all of them when backgrounds are wanted."""
    if include_backgrounds:
        return images
    return images.join(boxes.select(*keys).distinct(), list(keys), "left_semi")


def write_splits(images: DataFrame, boxes: DataFrame, path: str, artifacts: DataFrame | None = None) -> None:
    """Images, boxes (numbered anew across the splits) and artifact boxes, partitioned by split."""
    rank = F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("split"))
    placed = boxes.join(images.select("image_id", "split"), "image_id").withColumn("_s", rank)
    numbered = running_totals(placed, [], [F.col("_s"), F.col("image_id"), F.col("gt_id")], {})
    renumbered = numbered.withColumn("gt_id", F.col("rank") - 1).drop("rank", "n", "_s")
    images.write.mode("overwrite").partitionBy("split").parquet(f"{path}/images")
    renumbered.write.mode("overwrite").partitionBy("split").parquet(f"{path}/boxes")
    if artifacts is not None:
        artifacts.write.mode("overwrite").parquet(f"{path}/artifacts")
