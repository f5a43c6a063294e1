"""Documents linked by the Jaccard similarity of their word n-grams, by a grouped prefix join.

Sets that are equal collapse first. All n-grams have one order: rare before common by counters
over the whole corpus, then by hash. Two sets that reach the
threshold share an n-gram among their first ``n - ceil(t * n) + 1``, the prefix. Sets of equal
prefix and size form a group; groups meet under the n-grams of their prefixes (of the smaller
one a shorter prefix is enough), pairs of groups are filtered by size, and what is left is expanded
to members, bounded by bitmaps and verified on the whole sets.

Only components are asked for, so pairs that are connected already need no check. First each
group is verified against the few partners that share most of its prefix among the ends of each
n-gram's list, which joins large families of copies by stars. Groups that stayed apart then meet
everybody outside their own component: around one centre by what they differ from it (two sets
that are not both near the centre can only be alike if they share a difference), else under
their prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, batched, bit_filter, components, has_bit, marked
from plumbline.llm.repeats import _per_range, pack, unpack
from plumbline.session import materialize, release

#: Words of an n-gram, and the percentage of the union that the intersection must reach.
WORDS = 4
PERCENT = 85
#: Counters of n-grams (a power of two). A task adds up in two bytes each, the order of n-grams
#: knows them up to 255. More counters tell rare n-grams apart in a larger corpus.
COUNTERS = 1 << 24
#: N-grams of prefixes that one range of hashes holds, about.
RANGE_TOKENS = 500_000
#: Bits of the filter of n-grams that several prefixes hold.
TOKEN_BITS = 26
#: Bits of the filter that says which sets are needed for verification.
FILTER_BITS = 24
_CHUNK = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """n-gram hashes of texts; remembers the hashes of words."""

    def __init__(self, width: int = WORDS) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams; of the whole text if it has fewer words."""
        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 50_000:
            self.known.clear()
        known = self.known
        codes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            codes.append(h)
        x = np.array(codes, np.uint64)
        width = min(self.width, len(x))
        h = np.full(len(x) - width + 1, width, np.uint64)
        for k in range(width):
            h = (h ^ x[k : len(x) - width + 1 + k]) * _A
            h ^= h >> np.uint64(32)
        h *= _B
        h ^= h >> np.uint64(29)
        return np.unique(h)


def _squeeze(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _unsqueeze(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint16)


def _count(docs: DataFrame, width: int) -> np.ndarray:
    """Counters of all n-grams of the corpus; each document counts its n-grams once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counters, any_row = Shingler(width), np.zeros(COUNTERS, np.uint16), False
        for batch in batches:
            sets = [shingler(r) for r in batch.column("_raw").to_pylist()]
            any_row = True
            at, times = np.unique(np.concatenate(sets) & np.uint64(COUNTERS - 1), return_counts=True)
            counters[at] = np.minimum(counters[at] + times, 65_535)
        if any_row:
            for k in range(0, COUNTERS, _CHUNK):
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([k // _CHUNK], pa.int32()), "counts": [_squeeze(counters[k : k + _CHUNK])]}
                )

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unsqueeze(x).astype(np.int64) for x in part["counts"])
        total = np.minimum(total, 65_535).astype(np.uint16)
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "counts": [_squeeze(total)]})

    schema = "chunk int, counts binary"
    parts = docs.select(as_bytes().alias("_raw")).mapInArrow(count, schema)
    parts = parts.withColumn("_salt", F.spark_partition_id() % 16)
    some = parts.groupBy("chunk", "_salt").applyInPandas(lambda p: add(p[["chunk", "counts"]]), schema)
    out = np.zeros(COUNTERS, np.uint8)
    for chunk, counts in some.groupBy("chunk").applyInPandas(add, schema).collect():
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.minimum(_unsqueeze(bytes(counts)), 255)
    return out


def _signatures(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, size, 64-bit hash of the set, prefix and bitmap of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, names, prefixes, maps = [], [], [], []
            for raw in batch.column("_raw").to_pylist():
                s = shingler(raw)
                n = len(s)
                take = n - (percent * n + 99) // 100 + 1 if n else 0
                if take:
                    late = shared.value[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                    order = np.argsort((s >> np.uint64(32)) | (late << np.uint64(32)), kind="stable")
                    prefixes.append(s[order[:take]].view(np.int64))
                else:
                    prefixes.append(np.zeros(0, np.int64))
                sizes.append(n)
                names.append(_name(s))
                maps.append(_parity(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                names=["doc_id", "n", "s", "prefix", "map"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", as_bytes().alias("_raw")).mapInArrow(
        run, f"doc_id {kind}, n long, s long, prefix array<long>, map binary"
    )


def _parity(hashes: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of hashes falls on i; 2 to 4 bits per hash."""
    if not len(hashes):
        return b""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """No two sets with these bitmaps and sizes share more: each differing bit is a hash of one only."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return (n + m - int(np.bitwise_count(p ^ q).sum())) // 2


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_x", "_y", "_n", "_m")]
            good = []
            for x, y, n, m in zip(*columns, strict=True):
                most = _most_shared(x, y, n, m)
                good.append(100 * most >= percent * (n + m - most))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    nodes = marked(nodes.select("s", "n", "map"), "s", ends).where("_marked")
    return (
        pairs.select("a", "b")
        .join(nodes.select(F.col("s").alias("a"), F.col("map").alias("_x"), F.col("n").alias("_n")), "a")
        .join(nodes.select(F.col("s").alias("b"), F.col("map").alias("_y"), F.col("n").alias("_m")), "b")
        .select("a", "b", "_x", "_y", "_n", "_m").mapInArrow(run, "a long, b long")
    )


def _name(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def _position(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Whole sets (sorted hashes as bytes) for the sets ``s``, each read from document ``doc_id``."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, _position("doc_id"), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            at = batch.column("_at").to_numpy()
            keep = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(keep):
                part = batch.take(pa.array(keep))
                found = [shingler(r) for r in part.column("_raw").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([_name(x) for x in found], pa.int64()),
                     pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["doc_id", "s", "_set"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", _position("doc_id").alias("_at"), as_bytes().alias("_raw"))
    found = found.mapInArrow(run, f"doc_id {kind}, s long, _set binary").alias("f")
    same = (F.col("f.s") == F.col("w.s")) & F.col("f.doc_id").eqNullSafe(F.col("w.doc_id"))
    return found.join(wanted.alias("w"), same, "left_semi").select("s", "_set")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("s").alias("a"), F.col("_set").alias("_x")), "a")
        .join(sets.select(F.col("s").alias("b"), F.col("_set").alias("_y")), "b")
        .select("a", "b", "_x", "_y")
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def _met_twice(heads: DataFrame) -> np.ndarray:
    """Bitmap over the top bits of n-gram hashes: those that two prefixes or more hold.

    Sorted runs of hashes go to ranges of hashes, more of them for more prefixes; a run holds an
    n-gram twice at most.
    """
    total = heads.agg(F.sum(F.size("prefix"))).first()[0] or 0
    ranges = min(max(64, 1 << (int(total) // RANGE_TOKENS).bit_length()), 1 << (TOKEN_BITS - 3))
    shift, per = np.uint64(65 - ranges.bit_length()), (1 << TOKEN_BITS) // ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.sort(batch.column("prefix").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            if len(tokens) > 2:
                tokens = tokens[np.concatenate(([True, True], tokens[2:] != tokens[:-2]))]
            bucket = (tokens >> shift).astype(np.int64)
            rows: dict[str, list] = {"bucket": [], "blob": []}
            for b, at in _per_range(np.arange(len(tokens)), bucket):
                rows["bucket"].append(b)
                rows["blob"].append(pack([(tokens[at] >> np.uint64(16), 6)]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int32()), "blob": pa.array(rows["blob"], pa.binary())})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        tokens = np.sort(np.concatenate([unpack(b, [6])[0] for b in part["blob"]]))
        twice = tokens[1:][tokens[1:] == tokens[:-1]]
        flags = np.zeros(per, np.uint8)
        flags[(twice >> (48 - TOKEN_BITS)) & (per - 1)] = 1
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros((ranges, per // 8), np.uint8)
    merged = heads.mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInPandas(merge, "bucket int, bits binary")
    for bucket, bits in merged.toLocalIterator():
        out[bucket] = np.frombuffer(bytes(bits), np.uint8)
    return out.ravel()


def _explode_if(heads: DataFrame, often: np.ndarray) -> DataFrame:
    """g, n, p (place in the prefix) and token of the n-grams that others may hold, too."""
    shared = heads.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("prefix")
            tokens = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(column.offsets.to_numpy())
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(has_bit(shared.value, (tokens.view(np.uint64) >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)))
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes)[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("g").take(row), batch.column("n").take(row), pa.array(place[at].astype(np.int32)), pa.array(tokens[at])],
                names=["g", "n", "p", "token"],
            )

    return heads.mapInArrow(run, "g long, n long, p int, token long")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and the hashes that only one of the two whole sets has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)
                for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.list_(pa.int64()))], names=["a", "b", "_only"]
            )

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long, _only array<long>")


def link(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Words are lower-cased (A-Z) runs of other than space and \\t to \\r. A text with fewer than
    ``width`` words is one n-gram; one without words has none and is linked with nothing, so its
    component is itself. Two documents link when 100 * intersection >= percent * union; the
    component is the smallest doc_id reachable. Rows that repeat an id are one document with all
    their texts; a row of null id is linked by its text, and its component is null where nothing
    linked has an id. Nodes are sets, known by a 64-bit hash.
    """
    spark = docs.sparkSession
    batched(spark)
    docs = docs.select("doc_id", F.col(text).alias("text"))
    signed = materialize(_signatures(docs, _count(docs, width), width, percent))
    # equal sets: only rows of a set that occurs again are shuffled
    worded = signed.where("n > 0")
    again = worded.groupBy("s").agg(F.count("*").alias("_k")).where("_k > 1").select("s")
    told = marked(worded, "s", again)
    single = told.where("not _marked").select("s", "n", "doc_id", "prefix", "map")
    copied = told.where("_marked").groupBy("s", "n").agg(
        F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"), F.first("map").alias("map")
    )
    prefixes = materialize(single.unionByName(copied).withColumn("_g", F.xxhash64("prefix", "n")))
    # groups: equal prefix and size; the smallest member stands for the others until verification
    members = materialize(
        prefixes.join(prefixes.groupBy("_g", "n").agg(F.min("s").alias("g")), ["_g", "n"]).select("s", "g", "n", "doc_id")
    )
    followers = members.where("s <> g").select("s")
    told = marked(prefixes.select("s", "n", "prefix"), "s", followers)
    heads = told.where("not _marked").drop("_marked").unionByName(
        told.where("_marked").drop("_marked").join(followers, "s", "left_anti")
    )
    heads = heads.select(F.col("s").alias("g"), "n", "prefix")
    often = _met_twice(heads)
    rows = _explode_if(heads, often).repartition("token")
    several = rows.groupBy("token").agg(F.count("*").alias("_df")).where("_df > 1").select("token")
    met = materialize(rows.join(several, "token").select("token", "g", "n", "p"))

    def touched(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
        return members.join(nodes, "s", "left_semi").select("s", "doc_id")

    def near(a: str, b: str) -> Column:
        return (100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n"))

    def short(x: str) -> Column:
        """Is the n-gram in the prefix that is enough for the smaller set of a pair?"""
        return F.col(f"{x}.p") < F.col(f"{x}.n") - F.ceil(2 * percent * F.col(f"{x}.n") / F.lit(100 + percent)) + 1

    # a star around the head settles a group; where it fails, every member is a group of its own
    stars = members.where("s <> g").select(F.col("g").alias("a"), F.col("s").alias("b"))
    alike = signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    twins = signed.where("n > 0").select("doc_id", F.col("s").alias("b")).join(
        alike.where("a <> b").select("doc_id", "a"), "doc_id"
    ).where("a <> b").select("a", "b")
    # the ends of each n-gram's list: smallest and largest set, and the first by hash
    end = lambda *first: F.struct(*first, F.col("g").alias("e"), F.col("n").alias("en"))
    ends = met.groupBy("token").agg(
        F.array(F.min(end("n", "g")), F.max(end("n", "g"))).alias("by_size"), F.min(end(F.xxhash64("g"))).alias("by_hash")
    )
    ends = ends.select("token", F.posexplode(F.concat(
        F.transform("by_size", lambda x: F.struct(x["e"], x["en"])), F.array(F.struct("by_hash.e", "by_hash.en"))
    )).alias("turn", "end"))
    partners = (
        met.join(ends, "token")
        .where((F.col("g") != F.col("end.e")) & (100 * F.least("n", F.col("end.en")) >= percent * F.greatest("n", F.col("end.en"))))
        .groupBy(F.col("g").alias("a"), F.col("end.e").alias("b"), "turn").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        # only a choice of partners: what is left out here comes up again below
        .where("60 * c >= n")
        .groupBy("a", "turn").agg(F.max(F.struct("c", "b")).alias("m"))
        .select("a", "turn", F.col("m.b").alias("b"))
    )
    partners = materialize(partners)
    near_ends = partners.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near_ends = materialize(_possible(near_ends, prefixes, percent))
    # the first by hash is the centre of its star, for all members of a group
    centres = materialize(
        partners.where("turn = 2").select(F.col("a").alias("g"), "b").join(members.select("g", "s"), "g")
        .where("s <> b").select(F.col("s").alias("a"), "b")
    )
    sets = materialize(_sets(docs, touched(near_ends.unionByName(stars).unionByName(centres)), width))
    checked = materialize(_verified(stars, sets, percent))
    loose = materialize(stars.join(checked, ["a", "b"], "left_anti").select(F.col("a").alias("g")).distinct())
    split = members.join(loose, "g").where("s <> g").select("g", "s")
    more = prefixes.join(split, "s").select(F.col("s").alias("g"), "n", F.posexplode("prefix").alias("p", "token")).select("token", "g", "n", "p")
    met, first = materialize(met.unionByName(more)), met
    own = materialize(
        members.join(loose, "g", "left_anti").select("g", "s").unionByName(split.select(F.col("s").alias("g"), "s"))
        .unionByName(loose.select("g", F.col("g").alias("s")))
    )
    edges = materialize(checked.unionByName(twins).unionByName(_verified(near_ends, sets, percent)))
    apart = materialize(_differences(centres, sets))
    release(sets, partners, near_ends)

    def expand(pairs: DataFrame) -> DataFrame:
        """Pairs of groups as pairs of members."""
        left, right = (own.select(F.col("g").alias(g), F.col("s").alias(x)) for g, x in (("a", "x"), ("b", "y")))
        wide = pairs.select("a", "b").join(left, "a").join(right, "b")
        return wide.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()

    def labelled(rows: DataFrame) -> DataFrame:
        now = components(edges).select(F.col("id").alias("g"), F.col("component").alias("c"))
        return rows.join(now, "g", "left").withColumn("c", F.coalesce("c", "g"))

    def mixed_up(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows of keys that several components share, with the key's largest; those outside it."""
        size = rows.groupBy(*keys, "c").agg(F.count("*").alias("_k"))
        most = size.groupBy(*keys).agg(F.max(F.struct("_k", "c")).alias("m"), F.count("*").alias("_cs"))
        mixed = rows.join(most.where("_cs > 1").select(*keys, F.col("m.c").alias("_main")), keys)
        return mixed.where("c <> _main").alias("r"), mixed.alias("o")

    # once each: others against the largest component, and others among themselves
    across = (F.col("r.c") != F.col("o.c")) & ((F.col("o.c") == F.col("o._main")) | (F.col("r.g") < F.col("o.g")))
    # inside a star, by what the sets differ from a centre that is moved to what most of them hold
    sizes = prefixes.select(F.col("s").alias("g"), "n")
    from_centre = (
        apart.select(F.col("a").alias("g"), F.col("b").alias("star"), "_only").join(sizes, "g")
        .join(sizes.select(F.col("g").alias("star"), F.col("n").alias("_m")), "star")
        .where(4 * F.size("_only") <= F.col("n") + F.col("_m"))
        .select("g", "star", "n", "_only")
    )
    from_centre = materialize(from_centre)
    those = materialize(from_centre.select("g", "star", F.explode("_only").alias("token")))
    people = from_centre.groupBy("star").agg(F.count("*").alias("_k"))
    usual = (
        those.groupBy("star", "token").agg(F.count("*").alias("_c")).join(people, "star").where("2 * _c > _k").select("star", "token")
    )
    moved = materialize(
        those.join(usual, ["star", "token"], "left_anti").select("g", "star", "token").unionByName(
            from_centre.select("g", "star").join(usual, "star").join(those, ["g", "star", "token"], "left_anti")
        )
    )
    # f(x) + f(y) <= 0 links x and y whatever they share; all of these link with the least f
    far = from_centre.select("g", "star", "n").join(moved.groupBy("g").agg(F.count("*").alias("d")), "g", "left").withColumn(
        "d", F.coalesce("d", F.lit(0))
    )
    far = materialize(far.withColumn("f", (100 + percent) * F.col("d") - (100 - percent) * F.col("n")))
    nearest = far.groupBy("star").agg(F.min(F.struct("f", "g")).alias("_y"))
    close = far.join(nearest, "star").where((F.col("f") + F.col("_y.f") <= 0) & (F.col("g") != F.col("_y.g")))
    edges = materialize(edges.unionByName(close.select(F.col("g").alias("a"), F.col("_y.g").alias("b"))))
    # all others must share differences, f(x) + f(y) counted by 2 (100 + percent) to each: with the rare ones
    # first, what the lists still hold from a shared difference on must be enough, at the first shared one
    seldom = moved.groupBy("star", "token").agg(F.count("*").alias("_c"))
    place = F.row_number().over(W.partitionBy("g", "star").orderBy("_c", "token")) - 1
    ordered = moved.join(seldom, ["star", "token"]).select("g", "star", "token", place.alias("i"))
    there = materialize(labelled(ordered.join(far.select("g", "d", "f"), "g")).withColumn("left", F.col("d") - F.col("i")))
    rest, mixed = mixed_up(there, ["star", "token"])
    enough = 2 * (100 + percent) * F.least("r.left", "o.left") >= F.col("r.f") + F.col("o.f")
    may = materialize(
        rest.join(mixed, (F.col("r.star") == F.col("o.star")) & (F.col("r.token") == F.col("o.token")) & across & enough)
        .select(F.least("r.g", "o.g").alias("a"), F.greatest("r.g", "o.g").alias("b"), (F.col("r.f") + F.col("o.f")).alias("f"))
        .distinct()
    )
    hold = lambda g: moved.select(F.col("g").alias(g), "star", "token")
    differ = (
        may.join(hold("a"), "a").join(hold("b"), ["b", "star", "token"])
        .groupBy("a", "b").agg(F.count("*").alias("k"), F.first("f").alias("f"))
        .where(F.col("f") <= 2 * (100 + percent) * F.col("k"))
    )
    edges = materialize(edges.unionByName(differ.select("a", "b")))
    release(may)
    release(there, those, moved)
    # a group is of a star if all its members are: then they have met all others of that star
    star = (
        own.join(from_centre.select(F.col("g").alias("s"), "star"), "s", "left").groupBy("g")
        .agg(F.count("*").alias("_k"), F.count("star").alias("_in"), F.min("star").alias("star"), F.max("star").alias("_last"))
        .where("_k = _in and star = _last").select("g", "star")
    )
    here = materialize(labelled(met.join(star, "g", "left")).select("token", "g", "n", "p", "c", "star"))
    rest, mixed = mixed_up(here, ["token"])
    smaller = F.struct("r.n", "r.g") < F.struct("o.n", "o.g")
    pairs = (
        rest.join(mixed, (F.col("r.token") == F.col("o.token")) & across & near("r", "o")
                  & ~F.coalesce(F.col("r.star") == F.col("o.star"), F.lit(False))
                  & F.when(smaller, short("r")).otherwise(short("o")))
        .select(F.least("r.g", "o.g").alias("a"), F.greatest("r.g", "o.g").alias("b")).distinct()
    )
    pairs = materialize(_possible(expand(pairs), prefixes, percent))
    release(here, met, first)
    sets = materialize(_sets(docs, touched(pairs), width))
    labels = components(edges.unionByName(_verified(pairs, sets, percent)))
    nodes = materialize(
        signed.select("doc_id", "n", "s").join(labels, F.col("s") == F.col("id"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "s")).alias("_c"))
    )
    release(signed, prefixes, members, sets, pairs, edges, checked, loose, own, apart, centres)
    least = nodes.where("_c is not null").groupBy("_c").agg(F.min("doc_id").alias("_least"))
    return nodes.join(least, "_c", "left").select(
        "doc_id", "n_shingles", F.when(F.col("_c").isNotNull(), F.col("_least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per component, that of the smallest id; all columns stay.

    A row without id goes by its text, after all rows with ids. Only rows that a bit filter
    suspects (those to go, and repeated ids) are shuffled; all others stay where they are.
    """
    own = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), own).alias("_id"), "text")
    linked = materialize(link(keyed.select(F.col("_id").alias("doc_id"), "text"), width, percent))
    go = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    again = linked.groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1").select(F.col("doc_id").alias("_id"))
    told = marked(keyed, "_id", go.unionByName(again))
    looked_at = told.where("_marked").join(go, "_id", "left_anti").dropDuplicates(["_id"])
    return told.where("not _marked").select("row.*").unionByName(looked_at.select("row.*"))
