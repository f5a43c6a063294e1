"""Repeated substrings across documents, removed by external induced sorting.

Suffixes of all texts are compared as far as ``length`` bytes, without a suffix array of the
whole corpus. As in induced sorting only sampled suffixes are sorted, and all others follow:

1. *Sample.* The text itself says which positions are sampled: the least hash of a short block
   in every window of ``length`` bytes. Equal strings of that length sample the same place.
2. *Sort the sample.* Map tasks write sorted runs of tuples (block, name of the stretch that the
   sample stands for, smallest and largest document) to the shuffle, the disk-backed queue that
   merges them by ranges of blocks. Blocks that meet one document only leave here: their common
   prefix with every other document's suffixes is shorter than a block.
3. *Recurse.* The stretch around a sample (all strings it stands for) is the longer name of the
   next level. Stretches named alike agree in all their strings at once.
4. *Induce.* Where a block has several stretches, its suffixes are sorted by what follows, with
   common-prefix values between neighbours, and the strings that begin before the sample are
   induced one byte to the left at a time: two agree if the bytes put in front agree and the
   common prefix behind covers the rest.

Tuples travel in compressed columns, keyed by ranges of block hashes; more data makes more
ranges of the same size. A block that many documents share is merged per run before it is
sent, and occurrences of crowded ranges are spread over several tasks, each with the short list
of first documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, batched, bit_filter
from plumbline.session import materialize, release

#: Bytes of a string that counts as repeated, and of the block that a sample is known by.
LENGTH = 50
BLOCK = 24
#: Bytes of text that a task works on at a time; longer texts are cut with overlap.
PIECE = 1 << 18
CHUNK = 1 << 19
#: Bytes of text per range of blocks; ranges are a power of two, at least LEAST_RANGES.
RANGE_BYTES = 4 << 20
LEAST_RANGES = 64
#: Bits of the filters that tell map tasks which blocks matter.
FILTER_BITS = 27
#: Occurrences of a range that one task takes.
CROWD = 4_000_000
_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_NULL_ID = 2**63 - 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2 ** 64."""
    size = CHUNK + PIECE + 2 * LENGTH + 2
    both = []
    for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, factor, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def _stir(h: np.ndarray, factor: int) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(factor)
    h ^= h >> np.uint64(29)
    return h


class Chunk:
    """Pieces of texts behind each other, and the samples found in them."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]], length: int, block: int) -> None:
        raw = b"".join(p[3] for p in pieces)
        sizes = np.array([len(p[3]) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        n, width = len(raw), length - block + 1
        self.bytes = np.frombuffer(raw, np.uint8)
        self.at = np.zeros(0, np.int64)
        if n < length:
            return
        power, inverse = _powers()
        ahead = np.zeros(n + 1, np.uint64)
        ahead[1:] = self.bytes
        ahead[1:] += np.uint64(1)
        ahead[1:] *= power[:n]
        np.cumsum(ahead, out=ahead)
        blocks = ahead[block:] - ahead[:-block]
        blocks *= inverse[: n - block + 1]
        blocks = _stir(blocks, 0xC2B2AE3D27D4EB4F)
        # the position in the low bits: of equal hashes the first counts, wherever the text stands
        low = blocks & ~_POSITION
        low |= np.arange(len(blocks), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        begin = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
        if not len(begin):
            return
        sample = (low[begin] & _POSITION).astype(np.int64)
        who = owner[begin]
        first = np.flatnonzero((np.diff(sample, prepend=-1) != 0) | (np.diff(who, prepend=-1) != 0))
        self.at = sample[first]
        self.lo = begin[first]  # first and last start of the strings that the sample stands for
        self.hi = np.append(begin[first[1:] - 1], begin[-1]) + 1
        self.key = blocks[self.at]
        stretch = (ahead[self.hi + length - 1] - ahead[self.lo]) * inverse[self.lo]
        self.name = _stir(stretch ^ _stir(self.key + (self.hi - self.lo).astype(np.uint64), _BASE), 0x9FB21C651E98DF25)
        piece = who[first]
        self.doc = np.array([p[0] for p in pieces], np.int64)[piece]
        self.mark = np.array([p[1] for p in pieces], np.int64)[piece]
        self.base = (np.array([p[2] for p in pieces], np.int64) - starts)[piece]  # chunk to text position


def _chunks(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[Chunk]:
    """Texts cut to pieces that share ``length - 1`` bytes, gathered to chunks."""
    pieces: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for doc, raw in zip(batch.column("_id").to_pylist(), batch.column("_raw").to_pylist(), strict=True):
            mark = xxhash.xxh3_64_intdigest(raw) & 0xFFFFFFFF if len(raw) >= length else 0
            for start in range(0, max(0, len(raw) - length + 1), PIECE):
                part = raw[start : start + PIECE + length - 1]
                pieces.append((doc, mark, start, part))
                size += len(part)
                if size >= CHUNK:
                    yield Chunk(pieces, length, block)
                    pieces, size = [], 0
    if pieces:
        yield Chunk(pieces, length, block)


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of whole numbers, each with the low bytes that are kept, by byte planes."""
    planes = []
    for column, width in columns:
        raw = np.ascontiguousarray(column).astype("<u8" if column.dtype.kind == "u" else "<i8").view(np.uint8)
        planes += [raw.reshape(-1, 8)[:, k].tobytes() for k in range(width)]
    rows = len(columns[0][0])
    return rows.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, widths: list[int]) -> list[np.ndarray]:
    """What ``pack`` was given, without the bytes left out; numbers of 8 bytes come back as signed."""
    rows = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8).reshape(-1, rows)
    out, at = [], 0
    for width in widths:
        column = np.zeros((rows, 8), np.uint8)
        column[:, :width] = planes[at : at + width].T
        out.append(column.view(np.int64).ravel())
        at += width
    return out


def _unpack_all(blobs: pd.Series, widths: list[int]) -> list[np.ndarray]:
    parts = [unpack(b, widths) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(widths))]


_RUN = [6, 7, 8, 8, 4]  # block, name, smallest document, how much larger the largest is, occurrences
_FIRSTS = [7, 8, 1]  # name, first document, has the block other stretches
_SEEN = [7, 8, 4, 8, 1]  # name, document, mark, start, number of strings
_SPOT = [8, 7, 8, 4, 8, 1, 1]  # block, name, document, mark, start, bytes before the sample, number of strings
_CUT = [8, 4, 8, 1]  # document, mark, start, number of strings


def _per_range(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range, rows) of a chunk, rows in the given order."""
    if not len(order):
        return
    sorted_buckets = bucket[order]
    edges = np.flatnonzero(np.diff(sorted_buckets, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(sorted_buckets[a]), order[a:b]


def _runs(texts: DataFrame, ranges: int, length: int, block: int) -> DataFrame:
    """Sorted runs of (block, name, documents), one row per chunk and range."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, length, block):
            if not len(chunk.at):
                continue
            order = np.lexsort((chunk.name, chunk.key))
            key, name, doc = chunk.key[order], chunk.name[order], chunk.doc[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1]))))
            least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            times = np.diff(first, append=len(key))
            key, name = key[first], name[first]
            rows: dict[str, list] = {"bucket": [], "blob": []}
            for bucket, at in _per_range(np.arange(len(key)), (key >> shift).astype(np.int64)):
                rows["bucket"].append(bucket)
                # the range gives the top bits of the block, so its low six bytes are dropped
                rows["blob"].append(pack([(key[at] >> np.uint64(16), 6), (name[at], 7), (least[at], 8), (most[at] - least[at], 8), (times[at], 4)]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int32()), "blob": pa.array(rows["blob"], pa.binary())})

    return texts.mapInArrow(run, "bucket int, blob binary")


def _merge(part: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """Merged runs of a range: first documents of the stretches whose block several documents share."""
    bucket = int(part["bucket"].iloc[0])
    key, name, least, more, times = _unpack_all(part["blob"], _RUN)
    most = least + more
    order = np.lexsort((name, key))
    key, name, least, most, times = key[order], name[order], least[order], most[order], times[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new_key | np.concatenate(([True], name[1:] != name[:-1])))
    key, name = key[first], name[first]
    least, most, times = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.add.reduceat(times, first)
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(heads, append=len(key))
    shared = np.minimum.reduceat(least, heads) < np.maximum.reduceat(most, heads)
    keep, several = np.repeat(shared, sizes), np.repeat(shared & (sizes > 1), sizes)
    # the filters' bits of this range: the top FILTER_BITS bits of the 48 that are kept of a block
    per = (1 << FILTER_BITS) // ranges
    bits = []
    for chosen in (keep, several):
        flags = np.zeros(per, np.uint8)
        flags[(key[chosen] >> (48 - FILTER_BITS)) & (per - 1)] = 1
        bits.append(np.packbits(flags, bitorder="little").tobytes())
    firsts = pack([(name[keep], 7), (least[keep], 8), (several[keep].astype(np.int64), 1)])
    tasks = 1 + int(times[keep].sum()) // CROWD
    return pd.DataFrame({"bucket": np.int32([bucket]), "tasks": np.int32([tasks]), "firsts": [firsts], "shared": [bits[0]], "several": [bits[1]]})


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _seen(texts: DataFrame, shared: object, spread: object, ranges: int, length: int, block: int) -> DataFrame:
    """Occurrences of shared blocks, by range and by one of the tasks of a crowded range."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, length, block):
            if not len(chunk.at):
                continue
            at = np.flatnonzero(_has(shared.value, chunk.key))
            bucket = (chunk.key[at] >> shift).astype(np.int64)
            rows: dict[str, list] = {"bucket": [], "salt": [], "blob": []}
            for b, own in _per_range(np.argsort(bucket, kind="stable"), bucket):
                i = at[own]
                rows["bucket"].append(b)
                rows["salt"].append(int(chunk.doc[i[0]] + chunk.at[i[0]]) % int(spread.value[b]))
                rows["blob"].append(pack([(chunk.name[i], 7), (chunk.doc[i], 8), (chunk.mark[i], 4), (chunk.lo[i] + chunk.base[i], 8), (chunk.hi[i] - chunk.lo[i], 1)]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int32()), "salt": pa.array(rows["salt"], pa.int32()), "blob": pa.array(rows["blob"], pa.binary())})

    return texts.mapInArrow(run, "bucket int, salt int, blob binary")


def _cuts(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray, homes: int) -> pd.DataFrame:
    """Strings to remove, by the place where their documents meet their texts."""
    out: dict[str, list] = {"home": [], "blob": [], "docs": []}
    home = doc % homes
    for h, at in _per_range(np.lexsort((start, doc, home)), home):
        out["home"].append(h)
        out["blob"].append(pack([(doc[at], 8), (mark[at], 4), (start[at], 8), (count[at], 1)]))
        out["docs"].append(np.unique(doc[at]))
    return pd.DataFrame({
        "home": np.array(out["home"], np.int64),
        "blob": pd.Series(out["blob"], dtype=object),
        "docs": pd.Series(out["docs"], dtype=object),
    })


_CUT_SCHEMA = "home long, blob binary, docs array<long>"


def _match(seen: pd.DataFrame, firsts: pd.DataFrame, homes: int) -> pd.DataFrame:
    """Occurrences of a stretch behind its first document: all their strings are removed."""
    if not len(seen) or not len(firsts):
        return _cuts(*[np.zeros(0, np.int64)] * 4, homes)
    name, doc, mark, start, count = _unpack_all(seen["blob"], _SEEN)
    known, first, _ = unpack(firsts["firsts"].iloc[0], _FIRSTS)
    order = np.argsort(known)
    known, first = known[order], first[order]
    if not len(known):
        return _cuts(*[np.zeros(0, np.int64)] * 4, homes)
    at = np.minimum(np.searchsorted(known, name), len(known) - 1)
    gone = (known[at] == name) & (first[at] < doc)
    return _cuts(doc[gone], mark[gone], start[gone], count[gone], homes)


def _spots(texts: DataFrame, several: object, ranges: int, length: int, block: int) -> DataFrame:
    """For blocks with several stretches: where a stretch stands in its chunk's first document, and its bytes."""
    shift = np.uint64(64 - ranges.bit_length() + 1)
    before = length - block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, length, block):
            if not len(chunk.at):
                continue
            at = np.flatnonzero(_has(several.value, chunk.key))
            order = at[np.lexsort((chunk.doc[at], chunk.name[at], chunk.key[at]))]
            key, name, doc = chunk.key[order], chunk.name[order], chunk.doc[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])))) if len(order) else order
            least = np.repeat(doc[first], np.diff(first, append=len(order)))
            i = order[doc == least]
            if not len(i):
                continue
            grid = np.zeros((len(i), before + length), np.uint8)  # bytes before the sample backwards, then from it on
            pad = np.concatenate((chunk.bytes, np.zeros(length, np.uint8)))
            for k in range(before):
                ok = chunk.at[i] - k - 1 >= chunk.lo[i]
                grid[ok, k] = chunk.bytes[chunk.at[i[ok]] - k - 1] + 1
            for k in range(length):
                ok = chunk.at[i] + k < chunk.hi[i] + length - 1
                grid[ok, before + k] = pad[chunk.at[i[ok]] + k] + 1
            rows: dict[str, list] = {"bucket": [], "blob": [], "bytes": []}
            bucket = (chunk.key[i] >> shift).astype(np.int64)
            squeeze = zstandard.ZstdCompressor(level=1).compress
            for b, own in _per_range(np.argsort(bucket, kind="stable"), bucket):
                j = i[own]
                rows["bucket"].append(b)
                rows["blob"].append(pack([
                    (chunk.key[j], 8), (chunk.name[j], 7), (chunk.doc[j], 8), (chunk.mark[j], 4),
                    (chunk.lo[j] + chunk.base[j], 8), (chunk.at[j] - chunk.lo[j], 1), (chunk.hi[j] - chunk.lo[j], 1),
                ]))
                rows["bytes"].append(squeeze(grid[own].tobytes()))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int32()), "blob": pa.array(rows["blob"], pa.binary()), "bytes": pa.array(rows["bytes"], pa.binary())})

    return texts.mapInArrow(run, "bucket int, blob binary, bytes binary")


def _induce(spots: pd.DataFrame, firsts: pd.DataFrame, homes: int, length: int, block: int) -> pd.DataFrame:
    """Strings of first documents that an even smaller document holds in another stretch."""
    nothing = _cuts(*[np.zeros(0, np.int64)] * 4, homes)
    if not len(spots) or not len(firsts):
        return nothing
    before = length - block
    key, name, doc, mark, start, left, count = _unpack_all(spots["blob"], _SPOT)
    grid = np.concatenate([
        np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(-1, before + length) for b in spots["bytes"]
    ])
    known, first, several = unpack(firsts["firsts"].iloc[0], _FIRSTS)
    order = np.argsort(known)
    known, first, several = known[order], first[order], several[order]
    if not len(known):
        return nothing
    at = np.minimum(np.searchsorted(known, name), len(known) - 1)
    own = np.flatnonzero((known[at] == name) & (first[at] == doc) & (several[at] == 1))
    if not len(own):
        return nothing
    key, doc, mark, start, left, count, grid = (x[own] for x in (key, doc, mark, start, left, count, grid))
    # suffixes in order of block and of what follows; common prefixes between neighbours
    tail = grid[:, before:]
    words = np.pad(tail, ((0, 0), (0, -length % 8))).reshape(len(tail), -1, 8)[:, :, ::-1]
    words = np.ascontiguousarray(words).view(np.uint64)[:, :, 0]
    order = np.lexsort((*[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], key))
    key, doc, mark, start, left, count = (x[order] for x in (key, doc, mark, start, left, count))
    heads, tail = grid[order, :before], tail[order]
    same = tail[1:] == tail[:-1]
    prefix = np.where(same.all(1), length, np.argmin(same, axis=1)) if len(tail) > 1 else np.zeros(0, np.int64)
    prefix = np.where(key[1:] == key[:-1], prefix, -1)
    ahead = np.zeros(len(key), np.int64)  # class of the bytes put in front so far
    out = []
    for d in range(before + 1):
        if d:
            _, ahead = np.unique(ahead << 8 | heads[:, d - 1], return_inverse=True)
        # strings that begin d bytes before the sample
        live = np.flatnonzero((left >= d) & (left - count < d))
        if len(live) < 2:
            continue
        behind = np.concatenate(([0], np.cumsum(prefix < length - d)))
        pair = behind[live] * (int(ahead.max()) + 1) + ahead[live]
        by = np.lexsort((doc[live], pair))
        runs = np.flatnonzero(np.diff(pair[by], prepend=-1))
        least = np.empty(len(live), np.int64)
        least[by] = np.repeat(doc[live][by][runs], np.diff(runs, append=len(by)))
        gone = live[least < doc[live]]
        out.append((doc[gone], mark[gone], start[gone] + left[gone] - d, np.ones(len(gone), np.int64)))
    if not out:
        return nothing
    return _cuts(*[np.concatenate(x) for x in zip(*out, strict=True)], homes)


def _apply(texts: pd.DataFrame, cuts: pd.DataFrame, length: int) -> pd.DataFrame:
    """Remaining bytes of each text of a home, with the removed runs."""
    doc, mark, start, count = _unpack_all(cuts["blob"], _CUT) if len(cuts) else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((start, mark, doc))
    doc, mark, start, count = doc[order], mark[order], start[order], count[order]
    rows = []
    for key, raw in zip(texts["_id"].tolist(), texts["_raw"], strict=True):
        lo, hi = np.searchsorted(doc, key, side="left"), np.searchsorted(doc, key, side="right")
        own = slice(lo, hi)
        own = np.flatnonzero(mark[own] == (xxhash.xxh3_64_intdigest(raw) & 0xFFFFFFFF)) + lo
        rows.append((None if key == _NULL_ID else key, *_without(raw, start[own], start[own] + count[own] - 1 + length)))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return out.assign(doc_id=pd.array(out["doc_id"], "Int64"))


def _without(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple:
    """n_bytes, n_removed, n_spans, digest of what is left, and the removed runs."""
    if not len(begins):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], begins[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    spans = np.stack((begins[at], np.append(reach[at[1:] - 1], reach[-1])), axis=1)
    left, pos = hashlib.sha256(), 0
    for a, b in spans.tolist():
        left.update(raw[pos:a])
        pos = b
    left.update(raw[pos:])
    return len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), left.hexdigest(), spans.tolist()


def find(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end of removed runs).

    A byte is removed if a string of ``length`` bytes around it also begins in a document of
    smaller id; texts are judged as they came. A null text is empty. Rows of one id do not take
    from each other, and a null id is larger than any other. Equal rows get equal answers.
    """
    spark = docs.sparkSession
    batched(spark)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_id"), as_bytes(text).alias("_raw"))
    total = texts.agg(F.sum(F.length("_raw"))).first()[0] or 0
    ranges = max(LEAST_RANGES, 1 << max(0, int(total) // RANGE_BYTES - 1).bit_length())
    ranges = min(ranges, 1 << (FILTER_BITS - 3))
    homes = max(31, int(total) // RANGE_BYTES) | 1
    merged = materialize(
        _runs(texts.select("_id", "_raw"), ranges, length, block).groupBy("bucket").applyInPandas(
            lambda p: _merge(p, ranges), "bucket int, tasks int, firsts binary, shared binary, several binary"
        )
    )
    filters = {c: np.zeros((1 << FILTER_BITS) // 8, np.uint8) for c in ("shared", "several")}
    per = (1 << FILTER_BITS) // ranges // 8
    for row in merged.select("bucket", "shared", "several").toLocalIterator():  # 2 * 2 ** FILTER_BITS bits
        for c, out in filters.items():
            out[row["bucket"] * per : (row["bucket"] + 1) * per] = np.frombuffer(bytes(row[c]), np.uint8)
    shared, several = (spark.sparkContext.broadcast(x) for x in filters.values())
    firsts = merged.select("bucket", "firsts")
    tasks = np.ones(ranges, np.int64)
    for row in merged.select("bucket", "tasks").collect():
        tasks[row["bucket"]] = row["tasks"]
    seen = _seen(texts.select("_id", "_raw"), shared, spark.sparkContext.broadcast(tasks), ranges, length, block)
    salted = merged.select("bucket", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), "firsts")
    whole = (
        seen.groupBy("bucket", "salt").cogroup(salted.groupBy("bucket", "salt"))
        .applyInPandas(lambda a, b: _match(a, b, homes), _CUT_SCHEMA)
    )
    spots = _spots(texts.select("_id", "_raw"), several, ranges, length, block)
    part = (
        spots.groupBy("bucket").cogroup(firsts.groupBy("bucket"))
        .applyInPandas(lambda a, b: _induce(a, b, homes, length, block), _CUT_SCHEMA)
    )
    cuts = materialize(whole.unionByName(part))
    # only texts that lose something meet their cuts; the others are answered where they are read
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 26))
    touched = spark.sparkContext.broadcast(bit_filter(cuts.select(F.explode("docs").alias("_id")), place("_id"), 26))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"

    def sort_out(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_numpy()
            meets = (touched.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            rows = batch.filter(pa.array(meets == hit))
            if hit:
                yield rows.select(["doc_id", "_id", "_raw"])
            else:
                done = [_without(r, np.zeros(0), np.zeros(0)) for r in rows.column("_raw").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array([d[k] for d in done], t) for k, t in enumerate(
                        (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))))]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    placed = texts.withColumn("_at", place("_id"))
    clean = placed.mapInArrow(lambda b: sort_out(b, False), schema)
    met = placed.mapInArrow(lambda b: sort_out(b, True), f"doc_id {kind}, _id long, _raw binary")
    mended = (
        met.withColumn("home", F.pmod("_id", F.lit(homes))).groupBy("home")
        .cogroup(cuts.select("home", "blob").groupBy("home"))
        .applyInPandas(lambda a, b: _apply(a, b, length), schema)
    )
    return clean.unionByName(mended)
