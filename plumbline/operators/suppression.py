"""Non-maximum suppression, tiles, and per-image top lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.geometry import Box, clip, decode_point, shift, tile_offsets
from plumbline.functions.scores import quality
from plumbline.operators.matching import overlapping_pairs
from plumbline.operators.neardup import components
from plumbline.session import materialize, release

_CORNERS = ("x1", "y1", "x2", "y2")


#: Overlapping pairs that one task may fold in rank order. Keys with more are taken apart.
PAIRS_TOGETHER = 2_000_000


def suppress(
    df: DataFrame, keys: Sequence[str], threshold: float = 0.5, cell: float = 256.0, together: int = PAIRS_TOGETHER
) -> DataFrame:
    """Rows that survive: best score first, a row falls if a kept one overlaps it by more
    than ``threshold``; ties go to the lower ``det_id``. Add a class to ``keys`` for
    suppression within classes only.

    The overlapping pairs of a key stream through one task in rank order, which only remembers who
    has fallen. A key with more than ``together`` pairs is first cut into the connected pieces of its
    overlaps; a piece that is still larger is settled in rounds, spread over all tasks.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in _CORNERS and c not in ("det_id", "score")]
    rank = F.struct((-F.col("score")).alias("s"), F.col("det_id").alias("d"))
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    # of identical boxes only the best ranked can stay; boxes without area overlap nothing, each stays.
    # written once, so that the search for overlaps and the survivors do not work the input out again
    flat = F.when(~solid, F.monotonically_increasing_id()).alias("_flat")
    firsts = materialize(
        df.where(solid.isNotNull()).groupBy(*keys, *_CORNERS, flat)
        .agg(F.min_by(F.struct("det_id", "score", *rest), rank).alias("r"))
        .select(*keys, *_CORNERS, F.col("_flat").isNull().alias("_solid"), "r.*")
    )
    narrow = firsts.where("_solid").select(*keys, *_CORNERS, "det_id", (-F.col("score")).alias("s"))
    other = narrow.withColumnsRenamed({"det_id": "det_b", "s": "s_b"})
    before = F.struct(F.col("s"), F.col("det_id").alias("d")) < F.struct(F.col("s_b").alias("s"), F.col("det_b").alias("d"))
    edges = materialize(
        overlapping_pairs(narrow, other, keys, cell)
        .where((F.col("iou") > threshold) & before)
        .select(*keys, "s", F.col("det_id").alias("high"), F.col("det_b").alias("low"))
    )
    crowded = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > together).select(*keys)
    if crowded.take(1):
        apart = edges.join(crowded, keys, "left_semi")
        fallen = _folded(edges.join(crowded, keys, "left_anti"), keys, keys).unionByName(_by_pieces(apart, keys, together))
    else:
        fallen = _folded(edges, keys, keys)
    stay = firsts.where("_solid").join(fallen.withColumnRenamed("low", "det_id"), [*keys, "det_id"], "left_anti")
    return stay.unionByName(firsts.where("NOT _solid")).select(*df.columns)


def _folded(edges: DataFrame, keys: list[str], pieces: list[str]) -> DataFrame:
    """(keys, low) of rows that fall, where no overlap leaves a piece: pairs pass in rank order."""
    names = [*keys, "low"]
    ordered = edges.repartition(*pieces).sortWithinPartitions("s", "high").select(*keys, "high", "low")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fallen: set = set()
        for f in frames:
            of = [f[k].tolist() for k in keys]
            out = []
            for i, (high, low) in enumerate(zip(zip(*of, f["high"]), zip(*of, f["low"]))):
                if low not in fallen and high not in fallen:
                    fallen.add(low)
                    out.append(i)
            yield f[names].iloc[out]

    return ordered.mapInPandas(fold, StructType([edges.schema[c] for c in names]))


def _by_pieces(edges: DataFrame, keys: list[str], together: int) -> DataFrame:
    """(keys, low) of rows that fall among the pairs of crowded keys."""
    node = lambda c: F.xxhash64(*keys, c)  # noqa: E731  (equal hashes would only join two pieces)
    labels = components(edges.select(node("high").alias("a"), node("low").alias("b")), "a", "b")
    labelled = materialize(edges.withColumn("node", node("high")).join(labels, "node").drop("node"))
    large = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > together).select("component")
    fallen = _folded(labelled.join(large, "component", "left_anti"), keys, ["component"])
    if not large.take(1):
        return fallen
    return fallen.unionByName(_in_rounds(labelled.join(large, "component", "left_semi").drop("component"), keys))


def _in_rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low) of rows that fall: rows that nothing above overlaps any more fell those below them."""
    left = materialize(edges.select(*keys, "high", "low"))
    fallen = left.select(*keys, "low").limit(0)
    while left.take(1):
        blocked = left.select(*keys, F.col("low").alias("high")).distinct()
        winners = left.select(*keys, "high").distinct().join(blocked, [*keys, "high"], "left_anti")
        losers = materialize(left.join(winners, [*keys, "high"], "left_semi").select(*keys, "low").distinct())
        now = materialize(
            left.join(losers, [*keys, "low"], "left_anti")
            .join(losers.withColumnRenamed("low", "high"), [*keys, "high"], "left_anti")
        )
        total = materialize(fallen.unionByName(losers))
        release(left, losers, fallen)
        left, fallen = now, total
    release(left)
    return fallen


def top_per_key(df: DataFrame, keys: Sequence[str], k: int, tie: str = "det_id") -> DataFrame:
    """The ``k`` best scored rows per key (the limit prunes on the map side)."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(tie))
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def decode_detections(
    points: DataFrame, keys: Sequence[str] = ("image_id",), score_cut: float = 0.05, threshold: float = 0.5,
    max_det: int | None = None, before: int = 4,
) -> DataFrame:
    """Boxes from raw grid points: score cut, suppression; with ``max_det`` the best so many of each key.

    With ``max_det`` only the best ``before * max_det`` boxes of a key go into suppression.
    ``points`` holds det_id, px, py, stride, left, top, right, bottom, class_logit,
    centre_logit.
    """
    box = decode_point(*(F.col(c) for c in ("px", "py", "stride", "left", "top", "right", "bottom")))
    scored = points.withColumn("score", quality(F.col("class_logit"), F.col("centre_logit"))).where(F.col("score") >= score_cut)
    boxes = scored.select(*keys, "det_id", "score", F.col("class_logit").alias("det_logit"), *box.columns())
    if max_det is None:
        return suppress(boxes, keys, threshold)
    kept = suppress(top_per_key(boxes, keys, before * max_det), keys, threshold)
    return top_per_key(kept, keys, max_det)


def tile_grid(images: DataFrame, tile: int, overlap: float, image: str = "image_id") -> DataFrame:
    """Tiles row by row: (image, tile_id, x0, y0, x1, y1); needs width and height."""
    xs, ys = tile_offsets(F.col("width"), tile, overlap), tile_offsets(F.col("height"), tile, overlap)
    return (
        images.select(image, "width", "height", xs.alias("xs"), ys.alias("ys"))
        .select("*", F.posexplode("ys").alias("yi", "y0"))
        .select("*", F.posexplode("xs").alias("xi", "x0"))
        .select(
            image,
            (F.col("yi") * F.size("xs") + F.col("xi")).alias("tile_id"),
            "x0",
            "y0",
            F.least(F.col("x0") + tile, F.col("width").cast("long")).alias("x1"),
            F.least(F.col("y0") + tile, F.col("height").cast("long")).alias("y1"),
        )
    )


def to_image_coordinates(
    detections: DataFrame, grid: DataFrame | tuple[int, float], images: DataFrame, image: str = "image_id"
) -> DataFrame:
    """Tile detections moved into their image and clipped to it.

    ``grid`` is a table of tiles, or (tile, overlap) of the regular grid that ``tile_grid`` makes: then the
    origin is worked out from the size of the image and no tile without a detection is made.
    """
    if isinstance(grid, DataFrame):
        origin = grid.join(images.select(image, "width", "height"), image).select(
            image, "tile_id", F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), "width", "height"
        )
        joined = detections.join(origin, [image, "tile_id"])
    else:
        xs, ys = (tile_offsets(F.col(side), *grid) for side in ("width", "height"))
        at = F.col("tile_id").cast("long")
        joined = (
            detections.join(images.select(image, "width", "height"), image)
            .withColumns({"_xs": xs, "_ys": ys})
            .where((at >= 0) & (at < F.size("_xs") * F.size("_ys")))
            .withColumns({"_x0": F.get("_xs", F.pmod(at, F.size("_xs")).cast("int")), "_y0": F.get("_ys", F.floor(at / F.size("_xs")).cast("int"))})
        )
    moved = clip(shift(Box.of(), F.col("_x0"), F.col("_y0")), F.col("width"), F.col("height"))
    rest = [c for c in detections.columns if c not in _CORNERS]
    return joined.select(*rest, *moved.columns())


def fuse_tiles(
    detections: DataFrame, grid: DataFrame | tuple[int, float], images: DataFrame, threshold: float, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Detections of all tiles in image coordinates, suppressed across tiles."""
    return suppress(to_image_coordinates(detections, grid, images), keys, threshold)


def failure_images(
    detections: DataFrame, boxes: DataFrame, hits: DataFrame, n: int, prefer: str = "fp", image: str = "image_id",
    images: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` images with most false positives (or misses), ties by the higher image id.

    Images without a failure fill the list where fewer than ``n`` have one. ``detections`` and
    ``hits`` should already be cut at the score of interest; ``images`` adds images that have
    neither detections nor boxes.
    """
    if prefer not in ("fp", "fn"):
        raise ValueError(f"unknown preference: {prefer}")
    zero, one = F.lit(0), F.lit(1)
    parts = (
        detections.select(image, one.alias("d"), zero.alias("b"), zero.alias("t"))
        .unionByName(boxes.select(image, zero.alias("d"), one.alias("b"), zero.alias("t")))
        .unionByName(hits.select(image, zero.alias("d"), zero.alias("b"), one.alias("t")))
    )
    if images is not None:
        parts = parts.unionByName(images.select(image, zero.alias("d"), zero.alias("b"), zero.alias("t")))
    per_image = parts.groupBy(image).agg(
        (F.sum("d") - F.sum("t")).alias("fp"), (F.sum("b") - F.sum("t")).alias("fn")
    )
    return per_image.orderBy(F.col(prefer).desc(), F.col(image).desc()).limit(n)
