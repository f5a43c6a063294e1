"""Shared pieces: batched access to whole texts, words, and stable hashes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so batches hold few of them.
BATCH_ROWS = 256

#: Rows of text that one task takes, at least; smaller inputs are spread thinner.
Batches = Iterator[pa.RecordBatch]


def batched(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Limit Arrow batches, so that a worker holds a few hundred texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def map_texts(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``work`` gets the columns of a batch as Python lists and returns columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = work(batch.to_pydict())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    batched(df.sparkSession)
    return df.mapInArrow(run, schema)


def drawn_first(df: DataFrame, number: Column, wanted: int, rows: int) -> DataFrame:
    """The rows among which the ``wanted`` smallest of a hash ``number`` surely are, of ``rows`` different ones.

    Cuts by the value before anything is ordered, so that no partition sends ``wanted`` rows of
    its own: twice as many as wanted pass, and some more.
    """
    if rows <= 2 * wanted + 1000:
        return df
    share = (2 * wanted + 1000) / rows
    return df.where(F.pmod(number, F.lit(1 << 30)) < int(share * (1 << 30)))


def fold(doc_id: Column | str, parts: int = 5) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(doc_id: int | None, parts: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def bit_filter(keys: DataFrame, position: Column, bits: int) -> "np.ndarray":
    """Bitmap of ``2 ** bits`` bits with the positions of all keys set, as bytes (bit i of byte i // 8).

    A lossless pre-filter of fixed size: a row whose bit is unset has no partner. Its size does
    not grow with the keys; with many keys it only lets more rows pass.
    """
    import numpy as np

    at = keys.select((position + 1).alias("_p")).where("_p is not null")  # bit 1 is the first of bucket 1
    parts = (
        at.groupBy(F.expr("bitmap_bucket_number(_p)").alias("_b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_m"))
    )
    out = np.zeros(max(1, 2**bits // 8), np.uint8)
    for number, chunk in parts.collect():  # at most 2 ** bits / 32768 rows of 4 KB
        start = (number - 1) * 4096
        piece = np.frombuffer(bytes(chunk), np.uint8)[: len(out) - start]
        out[start : start + len(piece)] = piece
    return out


def has_bit(bitmap: "np.ndarray", positions: "np.ndarray") -> "np.ndarray":
    import numpy as np

    return (bitmap[positions >> 3] >> (positions & 7).astype(np.uint8) & 1).astype(bool)


def marked(df: DataFrame, key: str, listed: DataFrame, name: str = "_marked", bits: int = 24) -> DataFrame:
    """``df`` with a flag: false only if ``key`` is surely not among the ``key`` values of ``listed``.

    Lets the many rows without a partner stay where they are; only marked rows need a join.
    """
    import pandas as pd

    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    shared = df.sparkSession.sparkContext.broadcast(bit_filter(listed.select(key), place, bits))

    def look(column: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, column.to_numpy()))

    look.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return df.withColumn(name, F.pandas_udf(look, "boolean")(place))


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id on an edge (``a``, ``b``).

    Large-star and small-star steps in turn until every edge points at its smallest id. Each
    round is an aggregation and a join; its table is written and the one before is dropped.
    """
    from plumbline.session import materialize, release

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(both: DataFrame, nearer: Column) -> DataFrame:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_m"))
        return both.join(least, "a").where(nearer).select(F.col("b").alias("a"), F.col("_m").alias("b"))

    now = materialize(edges.where("a <> b").select("a", "b").distinct())
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, F.col("b") > F.col("a")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b")
            .unionByName(least.select("a", F.col("_m").alias("b")))
            .distinct()
        )
        after = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        found = state(after)
        release(now)
        now = after
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    ).groupBy("id").agg(F.min("component").alias("component"))
