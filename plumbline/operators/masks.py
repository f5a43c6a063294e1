"""Masks as runs of foreground pixels, and features of decoded images.

A run is a row (sample, y, x0, x1): the pixels x0 to x1 - 1 of line y. With a column ``lines`` it
stands for as many equal lines, from y on (a band). Bands of one sample are cut at the same lines in
all tables that are put together (``bands_of_boxes``). Runs may overlap until ``overlay`` makes them
disjoint; the other functions take disjoint runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import materialize


def runs_of_pixels(pixels: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Single pixels (keys, x, y) as runs."""
    return overlay(pixels.select(*keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")), keys)


def runs_of_boxes(boxes: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Boxes filled, line by line, one run per box and line; what lies left of or above 0 is cut off."""
    line = {c: F.greatest(F.ceil(c).cast("long"), F.lit(0)) for c in ("x1", "y1", "x2", "y2")}
    cut = boxes.select(*keys, *[e.alias(c) for c, e in line.items()]).where("x2 > x1 AND y2 > y1")
    return cut.select(*keys, F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def bands_of_boxes(*tables: tuple[DataFrame, Sequence[str]]) -> list[DataFrame]:
    """Filled boxes of several (table, keys) as bands, one row per box and band instead of per line.

    ``keys`` begin with the sample. The lines at which any box of a sample begins or ends cut the boxes
    of all tables, so rows of a sample in one band have the same lines. A sample has at most as many
    cuts as its picture has lines.
    """
    cut, sample = [], tables[0][1][0]
    for boxes, keys in tables:
        line = {c: F.greatest(F.ceil(c).cast("long"), F.lit(0)) for c in ("x1", "y1", "x2", "y2")}
        cut.append(boxes.select(*keys, *[e.alias(c) for c, e in line.items()]).where("x2 > x1 AND y2 > y1"))
    every = W.partitionBy(sample)
    cuts = F.array_sort(F.array_union(F.collect_set("y1").over(every), F.collect_set("y2").over(every)))
    low, high = F.array_position("_cuts", F.col("y1")), F.array_position("_cuts", F.col("y2"))
    out = []
    for i, (_, keys) in enumerate(tables):
        # boxes travel once, by their sample, and stay there for all that follows
        rows = cut[i].withColumn("_own", F.lit(True))
        for other in (*cut[:i], *cut[i + 1 :]):
            rows = rows.unionByName(other.select(sample, "y1", "y2", F.lit(False).alias("_own")), allowMissingColumns=True)
        here = rows.where(F.col(sample).isNotNull()).repartition(sample).withColumn("_cuts", cuts).where("_own")
        place = F.posexplode(F.slice("_cuts", low.cast("int"), (high - low).cast("int"))).alias("_i", "y")
        bands = here.select(*keys, "x1", "x2", "_cuts", low.alias("_low"), place)
        after = F.element_at("_cuts", (F.col("_low") + F.col("_i") + 1).cast("int"))
        out.append(bands.select(*keys, "y", (after - F.col("y")).alias("lines"), F.col("x1").alias("x0"), F.col("x2").alias("x1")))
    return out


def _lines(runs: DataFrame) -> list[str]:
    return ["lines"] if "lines" in runs.columns else []


def _banded(runs: DataFrame) -> DataFrame:
    return runs if _lines(runs) else runs.withColumn("lines", F.lit(1).cast("long"))


def overlay(runs: DataFrame, keys: Sequence[str] = ("sample",), at_least: int | Column = 1) -> DataFrame:
    """Disjoint longest runs of the pixels that ``at_least`` of the given runs hold, per keys and line.

    Runs become steps up and down; a running sum along the line tells how many cover a place. If one
    is enough, a run begins where all runs before have ended. ``at_least`` may be a column of ``keys``.
    """
    keys = [*keys, *_lines(runs)]
    if isinstance(at_least, int) and at_least == 1:
        line = W.partitionBy(*keys, "y").orderBy("x0")
        before = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
        whole = F.max("x1").over(W.partitionBy(*keys, "y").orderBy("x0").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        reached = runs.select(*keys, "y", "x0", before.alias("_before"), whole.alias("_end"))
        starts = reached.where("_before IS NULL OR x0 > _before")
        return starts.select(*keys, "y", "x0", F.coalesce(F.lead("_before").over(line), F.col("_end")).alias("x1"))
    steps = (
        runs.select(*keys, "y", F.explode(F.array(
            F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d"))
        )).alias("s"))
        .groupBy(*keys, "y", F.col("s.x").alias("x")).agg(F.sum("s.d").alias("d"))
    )
    line = W.partitionBy(*keys, "y").orderBy("x")
    wanted = F.lit(at_least) if isinstance(at_least, int) else at_least
    inside = steps.withColumn("_in", F.sum("d").over(line) >= wanted)
    turns = inside.withColumn("_was", F.coalesce(F.lag("_in").over(line), F.lit(False))).where("_in <> _was")
    return turns.withColumn("x1", F.lead("x").over(line)).where("_in").select(*keys, "y", F.col("x").alias("x0"), "x1")


def mask_components(runs: DataFrame) -> DataFrame:
    """Number of 8-connected pieces per sample: runs of neighbouring lines that touch, corners included.

    The runs of a mask pass in line order; only the pieces that reach the line before are remembered.
    """
    ordered = _banded(runs).select("sample", "y", "lines", "x0", "x1").repartition("sample").sortWithinPartitions("sample", "y", "x0")
    kind = runs.schema["sample"].dataType.simpleString()
    return ordered.mapInPandas(_count_pieces, f"sample {kind}, components long")


def _count_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    started, sample, line, below, pieces, nearest, fresh = False, None, None, None, 0, 0, 0
    above: list = []  # (x0, x1, piece) of the band that ends just before line ``below``
    here: list = []
    parent: dict[int, int] = {}

    def root(p: int) -> int:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    for f in frames:
        done = []
        for s, y, lines, x0, x1 in zip(*(f[c].tolist() for c in ("sample", "y", "lines", "x0", "x1"))):
            if not started or s != sample:
                if started:
                    done.append((sample, pieces))
                started, sample, line, pieces, here = True, s, None, 0, []
            if y != line:
                above = [(u, v, root(p)) for u, v, p in here] if line is not None and y == below else []
                parent = {p: p for _, _, p in above}
                here, line, below, nearest = [], y, y + lines, 0
            fresh += 1
            piece = fresh
            parent[piece] = piece
            pieces += 1
            while nearest < len(above) and above[nearest][1] < x0:
                nearest += 1
            k = nearest
            while k < len(above) and above[k][0] <= x1:
                p, q = root(above[k][2]), root(piece)
                if p != q:
                    parent[q] = p
                    pieces -= 1
                k += 1
            here.append((x0, x1, piece))
        if done:
            yield pd.DataFrame(done, columns=["sample", "components"])
    if started:
        yield pd.DataFrame([(sample, pieces)], columns=["sample", "components"])


def mask_morphology(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """containment, elongation, components, orientation, foreground ratio per sample.

    ``boxes`` has one box per sample. Axes come from the pixel covariance, summed in closed form over
    the runs; a mask of fewer than two pixels has none. Samples without pixels score 0.
    """
    edge = {c: F.bround(F.col(c)).cast("long") for c in ("x1", "y1", "x2", "y2")}
    whole = boxes.select(
        "sample", F.col("x1").alias("b_x1"), F.col("y1").alias("b_y1"), F.col("x2").alias("b_x2"), F.col("y2").alias("b_y2"),
        *[e.alias(f"r_{c}") for c, e in edge.items()],
    )
    zero, one = F.lit(0), F.lit(1)
    y, end = F.col("y"), F.col("y") + F.col("lines")
    within = F.greatest(F.least(end, F.greatest(one, F.col("r_y2"))) - F.greatest(y, F.greatest(zero, F.col("r_y1"))), zero)
    common = F.least("x1", F.greatest(one, F.col("r_x2"))) - F.greatest("x0", F.greatest(zero, F.col("r_x1")))
    # whole numbers throughout: 2 x and 6 x x summed over a run, so that even masks have no slant
    n, x0, x1, lines = F.col("x1") - F.col("x0"), F.col("x0"), F.col("x1"), F.col("lines")
    along = n * (x0 + x1 - 1)
    squares = lambda e: (e - 1) * e * (2 * e - 1)  # noqa: E731  (of the places before e, six times)
    down, down_squares = F.expr("lines * (2 * y + lines - 1) div 2"), F.expr("((y + lines - 1) * (y + lines) * (2 * (y + lines) - 1) - (y - 1) * y * (2 * y - 1)) div 6")
    sums = (
        _banded(runs).join(whole.select("sample", "r_x1", "r_y1", "r_x2", "r_y2"), "sample")
        .groupBy("sample")
        .agg(
            F.sum(n * lines).alias("area"), F.sum(within * F.greatest(common, zero)).alias("inside"),
            F.sum(along * lines).alias("sx"), F.sum(n * down).alias("sy"), F.sum((squares(x1) - squares(x0)) * lines).alias("sxx"),
            F.sum(n * down_squares).alias("syy"), F.sum(along * down).alias("sxy"),
        )
    )
    big = lambda c: F.col(c).cast("decimal(18,0)")
    area = F.col("area").cast("double")
    stats = sums.select(
        "sample", "area", "inside",
        ((4 * big("area") * big("sxx") - 6 * big("sx") * big("sx")).cast("double") / (24.0 * area * area)).alias("xx"),
        ((big("area") * big("syy") - big("sy") * big("sy")).cast("double") / (area * area)).alias("yy"),
        ((big("area") * big("sxy") - big("sx") * big("sy")).cast("double") / (2.0 * area * area)).alias("xy"),
    )
    half, diff = (F.col("xx") + F.col("yy")) / 2.0, (F.col("xx") - F.col("yy")) / 2.0
    root = F.sqrt(diff * diff + F.col("xy") * F.col("xy"))
    floor = F.lit(1e-9)
    major, minor = F.sqrt(F.greatest(half + root, floor)), F.sqrt(F.greatest(half - root, floor))
    angle = F.atan2(2.0 * F.col("xy"), F.col("xx") - F.col("yy")) / 2.0
    lies = F.when(F.col("r_x2") - F.col("r_x1") >= F.col("r_y2") - F.col("r_y1"), F.lit(0.0)).otherwise(F.lit(float(np.pi / 2)))
    has_axes = F.col("area") >= 2
    box_area = F.greatest(F.lit(1.0), (F.col("b_x2") - F.col("b_x1")) * (F.col("b_y2") - F.col("b_y1")))
    joined = whole.join(stats, "sample", "left").join(mask_components(runs), "sample", "left")
    return joined.select(
        "sample",
        (F.coalesce("inside", zero) / F.greatest(F.coalesce("area", zero), one)).alias("containment"),
        F.when(has_axes, major / F.greatest(minor, F.lit(1e-6))).otherwise(F.lit(0.0)).alias("elongation"),
        F.coalesce("components", zero).alias("components"),
        F.abs(F.cos(F.when(has_axes, angle).otherwise(F.lit(0.0)) - lies)).alias("orientation"),
        (F.coalesce("area", zero) / box_area).alias("foreground_ratio"),
    )


def is_plausible_mask(containment: float = 0.7, elongation: float = 2.0, band: tuple[float, float] = (0.05, 0.9), max_components: int = 2) -> Column:
    """Predicate over the columns of ``mask_morphology``."""
    return (
        (F.col("containment") >= containment)
        & (F.col("elongation") >= elongation)
        & F.col("foreground_ratio").between(*band)
        & F.col("components").between(1, max_components)
    )


def dice(masks: DataFrame, truth: DataFrame, samples: DataFrame) -> DataFrame:
    """Dice overlap with the truth per (sample, backend); 1 where both are empty.

    ``masks`` are disjoint runs per (sample, backend), ``truth`` per sample. ``samples`` lists every
    (sample, backend); empty masks have no runs.
    """
    masks, truth = _banded(masks), _banded(truth)
    place = ["lines", "y", "x0", "x1"]
    # rows travel once, by their sample: listed names, masks and truth meet there
    rows = (
        samples.select("sample", "backend", F.lit(0).alias("kind"))
        .unionByName(masks.where("sample IS NOT NULL AND backend IS NOT NULL").select("sample", "backend", *place, F.lit(1).alias("kind")), allowMissingColumns=True)
        .unionByName(truth.where("sample IS NOT NULL").select("sample", *place, F.lit(2).alias("kind")), allowMissingColumns=True)
        .repartition("sample")
    )
    every = W.partitionBy("sample")
    size = (F.col("x1") - F.col("x0")) * F.col("lines")
    beside = rows.select(
        "*", F.collect_set(F.when(F.col("kind") == 0, F.col("backend"))).over(every).alias("_listed"),
        F.sum(F.when(F.col("kind") == 2, size)).over(every).alias("_truth"),
    )
    own = F.when(F.col("kind") == 1, size)
    step = lambda x, d, own: F.struct(F.col(x).alias("x"), F.lit(d).alias("d"), own.alias("own"))
    named = beside.withColumn("backend", F.explode(F.when(F.col("kind") == 2, F.col("_listed")).otherwise(F.array("backend"))))
    steps = named.select("sample", "backend", "kind", "_truth", "lines", "y", F.inline(F.array(
        step("x0", 1, own), step("x1", -1, F.lit(None).cast("long"))
    )))
    line = W.partitionBy("sample", "backend", "lines", "y").orderBy("x")
    # rows at one place have the same sum, and all but the last of them no length
    common = F.when(F.col("_in") >= 2, (F.col("_next") - F.col("x")) * F.col("lines"))
    zero = F.lit(0)
    sums = (
        steps.select("*", F.sum("d").over(line).alias("_in"), F.lead("x").over(line).alias("_next"))
        .groupBy("sample", "backend")
        .agg(
            F.min("kind").alias("kind"), F.coalesce(F.sum("own"), zero).alias("own"), F.coalesce(F.sum(common), zero).alias("common"),
            F.coalesce(F.max("_truth"), zero).alias("truth"),
        )
        .where("kind = 0")
    )
    total = F.col("own") + F.col("truth")
    return sums.select("sample", "backend", F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.col("common") / total).alias("dice"))


def consensus(masks: DataFrame, samples: DataFrame) -> DataFrame:
    """Runs of the pixels that at least half of the backends of a sample set."""
    rows = samples.select("sample", "backend", F.lit(True).alias("_lists")).unionByName(
        masks.select("sample", *_lines(masks), "y", "x0", "x1", F.lit(False).alias("_lists")), allowMissingColumns=True
    )
    every = W.partitionBy("sample")
    counted = rows.where("sample IS NOT NULL").repartition("sample").select(
        "*", F.size(F.collect_set("backend").over(every)).alias("backends"), F.max("_lists").over(every).alias("_known")
    ).where("_known AND NOT _lists")
    return overlay(counted.drop("backend", "_known", "_lists"), ["sample", "backends"], F.col("backends") / 2.0).drop("backends")


def pilot_summary(masks: DataFrame, truth: DataFrame, samples: DataFrame, boxes: DataFrame, dice_min: float = 0.7) -> DataFrame:
    """One row: mean Dice per backend, Dice of the consensus, share of plausible masks, pass."""
    agreed = materialize(consensus(masks, samples))
    alone = dice(masks, truth, samples).groupBy("backend").agg(F.avg("dice").alias("d"))
    listed = samples.select("sample").distinct()
    together = dice(agreed.withColumn("backend", F.lit("consensus")), truth, listed.withColumn("backend", F.lit("consensus")))
    kept = mask_morphology(agreed, boxes).agg(
        (F.count(F.when(is_plausible_mask(), 1)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("k")
    )
    return (
        together.agg(F.avg("dice").alias("consensus_dice"))
        .withColumn("mean_dice", alone.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("backend", "d"))))).scalar())
        .withColumn("kept_fraction", kept.scalar())
        .withColumn("passed", F.col("consensus_dice") >= dice_min)
    )


STYLE_FEATURES = ("mean_r", "mean_g", "mean_b", "mean_luma", "std_luma", "colourfulness", "sharpness")
_LUMA = np.array([0.299, 0.587, 0.114])  # fixed values: luma weights


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) RGB in 0..1 from the byte layout of Spark's image source (BGR)."""
    arr = np.frombuffer(data, dtype=np.uint8)[: height * width * channels].reshape(height, width, channels) / 255.0
    return np.repeat(arr, 3, axis=2) if channels == 1 else arr[:, :, 2::-1]


def _shrunk(arr: np.ndarray, side: int) -> np.ndarray:
    """Area means on at most side x side cells."""
    for axis in (0, 1):
        n = arr.shape[axis]
        if n > side:
            starts = (np.arange(side) * n) // side
            counts = np.diff(np.append(starts, n))
            shape = [1] * arr.ndim
            shape[axis] = side
            arr = np.add.reduceat(arr, starts, axis=axis) / counts.reshape(shape)
    return arr


def style_features(images: DataFrame, row_id: str, side: int = 128) -> DataFrame:
    """Colour, brightness and focus figures per image: (id, seven doubles).

    ``images`` carries height, width, nChannels and data as Spark's image source gives
    them. Images are reduced by area means, not by a filtered resize.
    """

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for data, h, w, c in zip(f["data"], f["height"], f["width"], f["nChannels"]):
                rgb = _shrunk(_pixels(data, h, w, c), side)
                luma = rgb @ _LUMA
                rg, yb = rgb[..., 0] - rgb[..., 1], (rgb[..., 0] + rgb[..., 1]) / 2 - rgb[..., 2]
                colour = np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())
                inner = luma[1:-1, 1:-1]
                around = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] if inner.size else inner
                edges = float((around - 4 * inner).var()) if inner.size else 0.0
                rows.append([*rgb.mean(axis=(0, 1)), luma.mean(), luma.std(), colour, edges])
            out = pd.DataFrame(rows, columns=list(STYLE_FEATURES), dtype="float64")
            out.insert(0, row_id, f[row_id].to_numpy())
            yield out

    id_type = images.schema[row_id].dataType.simpleString()
    schema = f"{row_id} {id_type}, " + ", ".join(f"{c} double" for c in STYLE_FEATURES)
    return images.select(row_id, "height", "width", "nChannels", "data").mapInPandas(features, schema)


def image_fingerprint(images: DataFrame, row_id: str) -> DataFrame:
    """64-bit perceptual hash: low 8x8 frequencies of a 32x32 grey image against their median."""
    n, low = 32, 8
    basis = np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            prints = []
            for data, h, w, c in zip(f["data"], f["height"], f["width"], f["nChannels"]):
                grey = _pixels(data, h, w, c) @ _LUMA
                grey = grey[(np.arange(max(n, h)) * h) // max(n, h)][:, (np.arange(max(n, w)) * w) // max(n, w)]
                freq = basis @ _shrunk(grey, n) @ basis.T
                bits = (freq > np.median(freq)).ravel()
                prints.append(np.packbits(bits).view(">i8")[0])
            yield pd.DataFrame({row_id: f[row_id].to_numpy(), "fingerprint": np.array(prints, dtype=np.int64)})

    id_type = images.schema[row_id].dataType.simpleString()
    return images.select(row_id, "height", "width", "nChannels", "data").mapInPandas(hashed, f"{row_id} {id_type}, fingerprint long")
