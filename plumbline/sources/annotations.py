"""Annotation documents of any size: one JSON document is cut into byte ranges and read by many tasks.

The text reader splits a file at closing braces. A first pass sums up every range for both cases,
that it begins inside a string and that it does not: quotes modulo two, change of depth, least
depth, and the keys of the arrays it opens. Sums over the ranges of a file then tell every range
the state it begins in, and a second pass emits the objects of the top-level arrays. Objects that
cross the end of a range are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import materialize

SECTIONS = ("images", "annotations", "categories")  # fixed values: arrays of a document, in order
IMAGE = "id long, file_name string, width int, height int, camera string, background string"
BOX = "id long, image_id long, bbox array<double>, category_id int, iscrowd int, area double"
#: One row of states per range of a file travels to all tasks.
MAX_RANGES = 1_000_000

_OPEN, _CLOSE, _BRACE = (123, 91), (125, 93), 123
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def _brackets(text: bytes, in_string: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and kinds of brackets outside strings, depth after each relative to the start, quotes modulo 2."""
    buf = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(buf == 34)
    if (buf == 92).any():
        index = np.arange(len(buf))
        plain = np.maximum.accumulate(np.where(buf == 92, -1, index))  # last byte that is no backslash
        before = np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    at = np.flatnonzero(np.isin(buf, (*_OPEN, *_CLOSE)))
    at = at[(np.searchsorted(quotes, at) + in_string) % 2 == 0]
    depth = np.cumsum(np.where(np.isin(buf[at], _OPEN), 1, -1))
    return at, buf[at], depth, len(quotes) % 2


def _name(text: bytes, at: int, kind: int) -> str:
    """Key of the array that opens at ``at``; empty for anything else."""
    if kind == _BRACE:
        return ""
    found = _KEY.search(text, max(0, at - 1000), at)
    return found.group(1).decode() if found else ""


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], bytes | None]]:
    """(file, range) and its text, portion by portion; None once a range is through."""
    now = None
    for f in frames:
        files, blocks, values = f["file"].to_numpy(), f["block"].to_numpy(), f["value"].tolist()
        new = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *new], [*new, len(f)], strict=True):
            key = files[a], int(blocks[a])
            if now is not None and key != now:
                yield now, None
            now = key
            yield key, ("}".join(values[a:b]) + "}").encode()
    if now is not None:
        yield now, None


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state: list = []
    for (file, block), text in _ranges(frames):
        if not state:
            state = [{"s": h, "d": 0, "least": 0, "keys": {}} for h in (0, 1)]
        if text is None:
            row = {"file": [file], "block": [block], "odd": [state[0]["s"]]}
            for h, st in enumerate(state):
                row |= {f"delta{h}": [st["d"]], f"least{h}": [st["least"]], f"keys{h}": [list(st["keys"].items())]}
            yield pd.DataFrame(row)
            state = []
            continue
        for st in state:
            at, kind, depth, odd = _brackets(text, st["s"])
            depth = depth + st["d"]
            opens = np.flatnonzero(np.isin(kind, _OPEN))[::-1]
            for level, i in zip(*np.unique(depth[opens], return_index=True), strict=True):
                st["keys"][int(level)] = _name(text, int(at[opens[i]]), int(kind[opens[i]]))
            if len(depth):
                st["least"], st["d"] = min(st["least"], int(depth.min())), int(depth[-1])
            st["s"] ^= odd


def _states(fragments: DataFrame) -> DataFrame:
    """State at the start of every range of sound documents: (file, block, in_string, depth, section, opened).

    ``section`` is the array that the range begins in, ``opened`` the range where an object open at the
    start began. A document that ends inside a string or with open brackets has no rows.
    """
    halves = ", ".join(f"delta{h} int, least{h} int, keys{h} array<struct<level: int, name: string>>" for h in (0, 1))
    sums = materialize(fragments.mapInPandas(_summed, f"file string, block long, odd int, {halves}"))
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")

    def case(name: str) -> Column:
        return F.when(F.col("in_string") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    named = F.filter("keys", lambda k: k["level"] == 2 - F.col("depth"))
    return (
        sums.withColumn("in_string", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)).cast("int"))
        .withColumns({"delta": case("delta"), "least": case("least"), "keys": case("keys")})
        .withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)).cast("int"))
        .withColumn("named", F.when(F.size(named) > 0, named[0]["name"]))
        .withColumn("section", F.last("named", ignorenulls=True).over(before))
        .withColumn("opened", F.last(F.when(F.col("depth") + F.col("least") <= 2, F.col("block")), ignorenulls=True).over(before))
        # after the last brace of a file the reader's separator is counted once more at most
        .withColumn("left", F.sum("delta").over(whole))
        .withColumn("odd_end", F.sum("odd").over(whole) % 2)
        .where("left IN (0, -1) AND odd_end = 0")
        .select("file", "block", "in_string", "depth", "section", "opened")
    )


def read_objects(spark: SparkSession, paths: str | list[str], range_bytes: int | None = None) -> DataFrame:
    """Objects of the top-level arrays of annotation documents: (file, split, section, object).

    ``object`` is JSON text. ``split`` is the file name without its extension, or the value of a
    folder ``split=...``. Each task reads at most ``range_bytes`` (the reader's setting by default) of a
    document. Documents that do not close what they open give no rows.
    """
    setting = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    if range_bytes:
        spark.conf.set(setting, str(range_bytes))
    try:
        fragments = (
            spark.read.text(paths, lineSep="}", recursiveFileLookup=True)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        )
        states = _states(fragments).collect()  # one short row per range
        if len(states) > MAX_RANGES:
            raise ValueError(f"{len(states)} ranges: read fewer documents at a time or larger ranges")
        known = {(r.file, r.block): (r.in_string, r.depth, r.section, r.opened) for r in states}
        shared = spark.sparkContext.broadcast(known)
        objects = materialize(fragments.mapInPandas(
            lambda frames: _cut(frames, shared.value), "file string, section string, object string, opened long, block long"
        ))
    finally:
        spark.conf.set(setting, usual)
    piece = F.array_sort(F.collect_list(F.struct("block", "object")))
    joined = objects.where("opened IS NOT NULL").groupBy("file", "opened").agg(
        F.max("section").alias("section"), F.array_join(F.transform(piece, lambda p: p["object"]), "").alias("object")
    )  # an object crosses few ranges
    both = objects.where("opened IS NULL").select("file", "section", "object").unionByName(joined.select("file", "section", "object"))
    folder, name = F.regexp_extract("file", r"/split=([^/]+)/", 1), F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    return both.select("file", F.when(folder != "", folder).otherwise(name).alias("split"), "section", "object")


def _cut(frames: Iterator[pd.DataFrame], known: dict) -> Iterator[pd.DataFrame]:
    """Whole objects of a range, and pieces of those that cross its ends with the range they began in."""
    state = None
    for (file, block), text in _ranges(frames):
        if (file, block) not in known:
            continue
        if state is None:
            in_string, depth, section, opened = known[file, block]
            state = {"s": in_string, "d": depth, "section": section or "", "open": b"" if depth >= 3 else None, "from": opened}
        out: list[tuple] = []
        if text is None:
            if state["open"] is not None:
                began = block if state["from"] is None else state["from"]
                out.append((file, state["section"], state["open"].decode(), began, block))
            state = None
        else:
            at, kind, depth, odd = _brackets(text, state["s"])
            depth = depth + state["d"]
            marks = (np.isin(kind, _OPEN) & (depth == 2)) | ((kind == _BRACE) & (depth == 3)) | ((kind == 125) & (depth == 2))
            start = 0
            for p, k, d in zip(at[marks].tolist(), kind[marks].tolist(), depth[marks].tolist(), strict=True):
                if d == 3:
                    state["open"], state["from"], start = b"", None, p
                elif k == 125:
                    if state["open"] is not None:
                        whole = (state["open"] + text[start : p + 1]).decode()
                        crossing = state["from"] is not None
                        out.append((file, state["section"], whole, state["from"], block if crossing else None))
                        state["open"], state["from"] = None, None
                else:
                    state["section"] = _name(text, p, k)
            if state["open"] is not None:
                state["open"] += text[start:]
            state["s"] ^= odd
            state["d"] = int(depth[-1]) if len(depth) else state["d"]
        if out:
            f = pd.DataFrame(out, columns=["file", "section", "object", "opened", "block"])
            yield f.astype({"opened": "Int64", "block": "Int64"})


def images_in(objects: DataFrame) -> DataFrame:
    return (
        objects.where("section = 'images'").select("split", F.from_json("object", IMAGE).alias("o"))
        .select("split", "o.*").withColumnRenamed("id", "image_id")
    )


def boxes_in(objects: DataFrame) -> DataFrame:
    """Boxes with an extent, in corner form."""
    a = objects.where("section = 'annotations'").select("split", F.from_json("object", BOX).alias("o")).select("split", "o.*")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    return a.where("bbox[2] > 0 AND bbox[3] > 0").select(
        "split", "image_id", F.col("id").alias("gt_id"), "category_id",
        x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
    )


def write_documents(images: DataFrame, boxes: DataFrame, path: str, category: str = "object") -> None:
    """One annotation document per split, in a folder ``split=...``.

    ``images`` needs split and image_id, ``boxes`` split, image_id, gt_id and corners. A document is one
    file, so one task writes it, row by row.
    """
    fields = [c for c in ("file_name", "width", "height", "camera", "background") if c in images.columns]
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    box = F.array(*[c.cast("double") for c in (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))])
    rows = (
        images.select("split", F.lit(0).alias("section"), F.col("image_id").alias("no"),
                      F.to_json(F.struct(F.col("image_id").alias("id"), *fields)).alias("object"))
        .unionByName(boxes.select("split", F.lit(1).alias("section"), F.col("gt_id").alias("no"), F.to_json(F.struct(
            F.col("gt_id").alias("id"), "image_id", box.alias("bbox"), F.lit(1).alias("category_id"),
            F.lit(0).alias("iscrowd"), area.cast("double").alias("area"))).alias("object")))
        .unionByName(images.select("split").distinct().select(
            "split", F.lit(2).alias("section"), F.lit(0).cast("long").alias("no"),
            F.to_json(F.struct(F.lit(1).alias("id"), F.lit(category).alias("name"))).alias("object")))
    )

    def heads(a: int, b: int) -> str:
        return "".join(("{" if k == 0 else "],") + f'"{SECTIONS[k]}":[' for k in range(a, b))

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, section, first = None, 0, True
        for f in frames:
            out: list[tuple[str, str]] = []
            for s, k, text in zip(f["split"], f["section"], f["object"], strict=True):
                if s != split:
                    if split is not None:
                        out.append((split, heads(section, 3) + "]}"))
                    split, section = s, 0
                if k >= section:
                    out.append((s, heads(section, k + 1)))
                    section, first = k + 1, True
                out.append((s, text if first else "," + text))
                first = False
            yield pd.DataFrame(out, columns=["split", "value"])
        if split is not None:
            yield pd.DataFrame([(split, heads(section, 3) + "]}")], columns=["split", "value"])

    ordered = rows.repartition("split").sortWithinPartitions("split", "section", "no").select("split", "section", "object")
    ordered.mapInPandas(lines, "split string, value string").write.partitionBy("split").text(path)
