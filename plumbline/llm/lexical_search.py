"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

A task turns its documents into shards: a row with the documents in id order, and for every term
of the queries a list of postings in compressed blocks. Beside each block stand its last document
and its competitive pairs (term count, document length) that no other posting of the block beats
in both, so the block's largest score can be had once corpus figures are known. Texts are read once.

A query walks a shard in windows of documents. Lists are ordered by their largest score; those whose
sum cannot pass the tenth best score so far are not essential. Essential lists are read and
give candidates; for the other lists, best first, a candidate goes when its sum and the list
maxima left cannot pass, then when the maximum of the one block that may hold it cannot, and only
blocks with a candidate left are decompressed. The ten best of each shard are merged by a ranking
over shards.

Cases: a null text has no terms; a document without terms is in no shard and does not count; a
query without terms has no rows. Every row is a document of its own, also of a repeated or null
id; null ids rank last among equal scores. Each row of the queries is answered, repeated ones alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import batched, bit_filter, has_bit
from plumbline.session import materialize

#: A shard ends with the document that brings it to so many terms or documents.
SHARD_TERMS, SHARD_DOCUMENTS = 2_000_000, 16_384
BLOCK = 128
#: Documents of one window.
WINDOW = 2048
#: Bits of the filter that passes the terms of queries; other terms that pass only take room.
FILTER_BITS = 24
#: Terms of all queries that are answered in one pass over the shards.
QUERY_TERMS = 1 << 18
#: Score of a posting: w * (SCALE * tf div (1000 * tf + 8 * m)), m = 25 + 75 * n * N div L.
SCALE = 1_000_000_000

_SEPARATORS = [c for c in range(128) if not chr(c).isalnum()]
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + bytes(_SEPARATORS), bytes(range(97, 123)) + b" " * len(_SEPARATORS)
)
SHARD = (
    "doc_ids array<bigint>, lengths array<bigint>, n_terms bigint, terms array<binary>, sizes array<bigint>, "
    "block_first array<int>, block_last array<int>, block_size array<int>, block_wide array<int>, "
    "pair_sizes array<int>, pair_counts array<int>, pair_lengths array<int>, body binary"
)


def terms(text: str | None) -> list[bytes]:
    """ASCII letters (lower-cased), digits and everything beyond ASCII make terms; the rest parts them."""
    return (text or "").encode().translate(_TABLE).split()


class _Numbers(dict):
    """Numbers of the terms that the filter passes; -1 for others."""

    def __init__(self, bitmap: np.ndarray) -> None:
        self.bitmap, self.passed = bitmap, []

    def __missing__(self, term: bytes) -> int:
        at = zlib.crc32(term) & ((1 << FILTER_BITS) - 1)
        number = -1
        if has_bit(self.bitmap, np.array([at]))[0]:
            number = len(self.passed)
            self.passed.append(term)
        self[term] = number
        return number


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes that the largest value of each block needs: 1, 2 or 4."""
    top = np.maximum.reduceat(values, starts) if len(starts) else np.zeros(0, np.int64)
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def _place(body: np.ndarray, offset: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Write little-endian numbers of their block's width."""
    for k in range(4):
        wide = width > k
        body[offset[wide] + k] = values[wide] >> 8 * k & 255


def _repeat_index(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Shard:
    """Documents collected for one row of the index."""

    def __init__(self, bitmap: np.ndarray) -> None:
        self.number = _Numbers(bitmap)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.words: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        number = self.number
        got = np.array([number[w] for w in words], np.int64)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.words.append(got[got >= 0])
        self.total += len(words)

    def full(self) -> bool:
        return self.total >= SHARD_TERMS or len(self.ids) >= SHARD_DOCUMENTS

    def row(self) -> dict:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        lengths = np.array([self.lengths[k] for k in order], np.int64)
        words = [self.words[k] for k in order]
        ordinal = np.repeat(np.arange(len(words)), [len(w) for w in words])
        key, count = np.unique(np.concatenate([np.zeros(0, np.int64), *words]) << 32 | ordinal, return_counts=True)
        term, at = key >> 32, key & 0xFFFFFFFF
        present, list_size = np.unique(term, return_counts=True)
        per_list = -(-list_size // BLOCK)
        block_size = np.full(per_list.sum(), BLOCK, np.int64)
        block_size[np.cumsum(per_list) - 1] = list_size - BLOCK * (per_list - 1)
        starts = np.cumsum(block_size) - block_size
        block = np.repeat(np.arange(len(block_size)), block_size)
        first = at[starts]
        gap, less = at - first[block], count - 1
        wide, high = _widths(gap, starts), _widths(less, starts)
        block_at = np.cumsum(block_size * (wide + high)) - block_size * (wide + high)
        body = np.zeros(int((block_size * (wide + high)).sum()), np.uint8)
        inside = _repeat_index(block_size)
        _place(body, block_at[block] + inside * wide[block], gap, wide[block])
        _place(body, (block_at + block_size * wide)[block] + inside * high[block], less, high[block])
        # competitive pairs: by falling count, those shorter than all before them in the block
        n = lengths[at]
        by = np.lexsort((n, -count, block))
        step = int(n.max(initial=0)) + 1
        level = n[by] - block[by] * step
        best = np.minimum.accumulate(level)
        keep = by[np.concatenate(([True], level[1:] < best[:-1]))[: len(by)]]
        return {
            "doc_ids": [self.ids[k] for k in order], "lengths": lengths, "n_terms": self.total,
            "terms": [self.number.passed[t] for t in present.tolist()], "sizes": list_size,
            "block_first": first, "block_last": at[starts + block_size - 1], "block_size": block_size,
            "block_wide": wide << 4 | high,
            "pair_sizes": np.bincount(block[keep], minlength=len(block_size)),
            "pair_counts": count[keep], "pair_lengths": n[keep], "body": body.tobytes(),
        }


def build(docs: DataFrame, queries_terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of the index over all ``docs`` for the distinct terms (column ``term``) of queries."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    place = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << FILTER_BITS))
    shared = spark.sparkContext.broadcast(bit_filter(queries_terms.select("term"), place, FILTER_BITS))
    schema = to_arrow_schema(StructType.fromDDL(SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(shard: _Shard) -> pa.RecordBatch:
            row = shard.row()
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in schema], schema=schema)

        shard = _Shard(shared.value)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(t)
                if words:
                    shard.add(i, words)
                if shard.full():
                    yield finished(shard)
                    shard = _Shard(shared.value)
        if shard.ids:
            yield finished(shard)

    batched(spark)
    return docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, SHARD)


class Searcher:
    """One shard, its corpus figures known, open to queries."""

    def __init__(self, row: dict, n: int, total: int) -> None:
        self.ids = row["doc_ids"]
        self.m8 = 8 * (25 + 75 * np.asarray(row["lengths"], np.int64) * n // total)
        self.list_of = {t: k for k, t in enumerate(row["terms"])}
        per_list = -(-np.asarray(row["sizes"], np.int64) // BLOCK)
        self.from_block = np.concatenate(([0], np.cumsum(per_list)))
        self.first, self.last, self.size = (np.asarray(row[f"block_{k}"], np.int64) for k in ("first", "last", "size"))
        packed = np.asarray(row["block_wide"], np.int64)
        self.wide, self.high = packed >> 4, packed & 15
        room = self.size * (self.wide + self.high)
        self.at = np.cumsum(room) - room
        self.body = row["body"]
        pairs = np.asarray(row["pair_sizes"], np.int64)
        tf = np.asarray(row["pair_counts"], np.int64)
        m8 = 8 * (25 + 75 * np.asarray(row["pair_lengths"], np.int64) * n // total)
        self.block_top = np.maximum.reduceat(SCALE * tf // (1000 * tf + m8), np.cumsum(pairs) - pairs) if len(pairs) else pairs
        self.list_top = np.maximum.reduceat(self.block_top, self.from_block[:-1]) if len(self.list_of) else pairs
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and unweighted scores of a block, decompressed at its first use."""
        found = self.open.get(b)
        if found is None:
            self.read += 1
            size, wide, high, at = int(self.size[b]), int(self.wide[b]), int(self.high[b]), int(self.at[b])
            docs = np.frombuffer(self.body, f"<u{wide}", size, at).astype(np.int64) + self.first[b]
            tf = np.frombuffer(self.body, f"<u{high}", size, at + size * wide).astype(np.int64) + 1
            found = self.open[b] = docs, SCALE * tf // (1000 * tf + self.m8[docs])
        return found

    def _add(self, k: int, weight: int, low: int, high: int, sums: np.ndarray) -> None:
        """Add list ``k`` to the sums of documents low..high - 1."""
        a, e = self.from_block[k], self.from_block[k + 1]
        a = a + np.searchsorted(self.last[a:e], low)
        e = a + np.searchsorted(self.first[a:e], high)
        for b in range(int(a), int(e)):
            docs, score = self.block(b)
            if docs[0] < low or docs[-1] >= high:
                x, y = np.searchsorted(docs, (low, high))
                docs, score = docs[x:y], score[x:y]
            sums[docs - low] += weight * score

    def _probe(
        self, k: int, weight: int, candidates: np.ndarray, sums: np.ndarray, others: int, limit: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that can pass ``limit`` with list ``k`` and ``others``, and their new sums."""
        a, e = self.from_block[k], self.from_block[k + 1]
        b = a + np.searchsorted(self.last[a:e], candidates)
        hit = b < e
        hit[hit] = self.first[b[hit]] <= candidates[hit]
        top = np.zeros(len(candidates), np.int64)
        top[hit] = weight * self.block_top[b[hit]]
        keep = sums + top + others > limit
        candidates, sums, b, hit = candidates[keep], sums[keep], b[keep], hit[keep]
        for number in np.unique(b[hit]).tolist():
            docs, score = self.block(number)
            mine = np.flatnonzero(hit & (b == number))
            at = np.searchsorted(docs, candidates[mine])
            same = docs[np.minimum(at, len(docs) - 1)] == candidates[mine]
            sums[mine[same]] += weight * score[at[same]]
        return candidates, sums

    def search(self, query: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard and scores of the ``k`` best documents, best first, equal ones in order."""
        lists = [(self.list_of[t], w) for t, w in query if w > 0 and t in self.list_of]
        lists.sort(key=lambda x: x[1] * int(self.list_top[x[0]]))
        reach = np.cumsum([0, *[w * int(self.list_top[t]) for t, w in lists]])  # of the lists before each
        best, score, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for low in range(0, len(self.ids), WINDOW):
            essential = int(np.searchsorted(reach, limit, "right")) - 1  # the lists before cannot pass together
            if essential >= len(lists):
                break
            high = min(low + WINDOW, len(self.ids))
            window = np.zeros(high - low, np.int64)
            for t, w in lists[essential:]:
                self._add(t, w, low, high, window)
            candidates = np.flatnonzero(window)
            sums = window[candidates]
            candidates = candidates + low
            for j in range(essential - 1, -1, -1):
                keep = sums + reach[j + 1] > limit
                candidates, sums = candidates[keep], sums[keep]
                if not len(candidates):
                    break
                candidates, sums = self._probe(*lists[j], candidates, sums, int(reach[j]), limit)
            keep = sums > limit
            best, score = np.concatenate((best, candidates[keep])), np.concatenate((score, sums[keep]))
            order = np.lexsort((best, -score))[:k]
            best, score = best[order], score[order]
            if len(score) == k:
                limit = int(score[-1])
        return best, score


def _answers(shards: DataFrame, queries: list[tuple[str, list[tuple[bytes, int]]]], k: int, n: int, total: int) -> DataFrame:
    """The ``k`` best of every shard for each query."""
    shared = shards.sparkSession.sparkContext.broadcast(queries)
    schema = "bag string, doc_id bigint, score bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(j)[at] for j, name in enumerate(batch.schema.names)}
                row = {
                    name: v.as_py() if name in ("doc_ids", "terms", "body") else v.values.to_numpy(zero_copy_only=False)
                    for name, v in row.items()
                }
                searcher = Searcher(row, n, total)
                bags, docs, scores = [], [], []
                for bag, query in shared.value:
                    best, score = searcher.search(query, k)
                    bags += [bag] * len(best)
                    docs += [searcher.ids[d] for d in best.tolist()]
                    scores += score.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bags, pa.string()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())],
                    names=["bag", "doc_id", "score"],
                )

    columns = [c for c in shards.columns if c != "n_terms"]
    return shards.select(*columns).mapInArrow(run, schema)


def _bags(queries: DataFrame, text: str) -> DataFrame:
    """Queries with the digest of their sorted terms (``bag``) and the terms with their counts (``bag_terms``)."""
    schema = StructType(list(queries.schema.fields))
    schema = schema.add("bag", "string")
    for field in StructType.fromDDL("bag_terms array<struct<term: binary, times: bigint>>"):
        schema = schema.add(field)
    where = queries.columns.index(text)
    kind = pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(Counter(terms(t)).items()) for t in batch.column(where).to_pylist()]
            digests = [hashlib.sha256(b" ".join(b"%s %d" % x for x in f)).hexdigest() for f in found]
            made = [[{"term": t, "times": c} for t, c in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests), pa.array(made, type=kind)],
                names=[*batch.schema.names, "bag", "bag_terms"],
            )

    batched(queries.sparkSession)
    return queries.mapInArrow(run, schema)


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text",
) -> DataFrame:
    """The ``k`` best documents for every row of ``queries``: ``item_id, rank, doc_id, score``.

    The index is built for the terms of all queries in one pass over the texts. Queries are
    answered in blocks of about ``QUERY_TERMS`` terms, each block by one pass over the shards.
    """
    spark = docs.sparkSession
    items = materialize(_bags(queries.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{query}`").alias("text")), "text").drop("text"))
    wanted = materialize(
        items.dropDuplicates(["bag"]).select("bag", F.explode("bag_terms").alias("t"))
        .select("bag", F.col("t.term").alias("term"), F.col("t.times").alias("times"))
    )
    shards = materialize(build(docs, wanted.select("term").distinct(), doc_id, text))
    n, total = shards.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = (
        shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
        .groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df"))
    )
    weighed = materialize(
        wanted.join(found, "term").withColumn("w", weight(F.lit(n), F.col("df")) * F.col("times"))
    )
    rows = weighed.count()
    blocks = max(1, -(-rows // QUERY_TERMS))
    batched(spark, 1)  # a shard is a large row
    parts = []
    for number in range(blocks if n else 0):
        mine = weighed.where(F.pmod(F.xxhash64("bag"), F.lit(blocks)) == number)
        of: dict[str, list[tuple[bytes, int]]] = {}
        for r in mine.select("bag", "term", "w").toLocalIterator():  # about QUERY_TERMS rows
            of.setdefault(r["bag"], []).append((bytes(r["term"]), r["w"]))
        parts.append(materialize(_answers(shards, sorted(of.items()), k, n, total)))
    batched(spark)
    if not parts:
        parts = [spark.createDataFrame([], "bag string, doc_id bigint, score bigint")]
    answers = parts[0]
    for part in parts[1:]:
        answers = answers.unionByName(part)
    order = Window.partitionBy("bag").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return items.select("item_id", "bag").join(top, "bag").select("item_id", "rank", "doc_id", "score")


def weight(n: Column, df: Column) -> Column:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return F.floor(1000 * F.log((2 * n + 2) / (2 * df + 1))).cast("bigint")
