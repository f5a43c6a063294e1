"""Nearest neighbours by largest inner product from a forest of random-projection trees.

Vectors get one more component that lifts them all to the same norm, so that the largest
inner product is the smallest angle. Each tree halves the space by random directions at the
median of a bounded sample; every row falls into one leaf per tree. A query walks all trees
through one priority queue ordered by the squared margins it has crossed, and takes the leaves
that come first. Queries meet the vectors of their leaves in blocks of bounded size; each pair
is scored exactly on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import drawn_first
from plumbline.session import materialize

#: Trees, halvings of each tree, and leaves that a query visits in all trees together.
TREES = 8
DEPTH = 7
LEAVES = 176
#: Rows that the visited leaves hold at least, counted once per tree; few rows are all visited.
CANDIDATES = 16_000
#: Vectors that the splits are fitted on, at most: those of the smallest hash of their id.
SAMPLE = 16_384
#: Vectors and queries of one block.
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024
_TIE = 1e-9


@dataclass
class Forest:
    planes: np.ndarray  # tree, node in level order, component
    offsets: np.ndarray  # tree, node
    norm: float  # largest norm of the indexed vectors

    @property
    def depth(self) -> int:
        return (self.offsets.shape[1] + 1).bit_length() - 1

    def lift(self, rows: np.ndarray) -> np.ndarray:
        x = rows / self.norm
        return np.hstack((x, np.sqrt(np.maximum(0.0, 1 - (x**2).sum(1)))[:, None]))

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        x = self.lift(rows)
        out = np.zeros((len(rows), len(self.planes)), np.int32)
        for t, (planes, offsets) in enumerate(zip(self.planes, self.offsets, strict=True)):
            side = x @ planes.T > offsets
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(rows)), node]
            out[:, t] = node - len(offsets)
        return out

    def visit(self, query: np.ndarray, leaves: int, held: list[list[int]]) -> list[tuple[int, int]]:
        """The (tree, leaf) that one queue over all trees yields first.

        ``leaves`` of them, and more until they hold ``CANDIDATES`` rows; ``held`` has the rows of
        each leaf, and empty leaves do not count.
        """
        unit = query / np.sqrt((query**2).sum())
        margins = (self.planes[:, :, :-1] @ unit - self.offsets).tolist()
        inner = self.offsets.shape[1]
        queue = [(0.0, t, 0) for t in range(len(margins))]
        found: list[tuple[int, int]] = []
        rows = 0
        while queue and (len(found) < leaves or rows < CANDIDATES):
            cost, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < inner:
                margin = own[node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (cost + margin * margin, t, 4 * node + 3 - near))
                node = near
            if held[t][node - inner]:
                rows += held[t][node - inner]
                found.append((t, node - inner))
        return found


def grow(sample: np.ndarray, norm: float, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Trees over a sample: random unit directions, split at the median of what reaches a node."""
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    planes = rng.normal(size=(trees, inner, sample.shape[1] + 1))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    forest = Forest(planes, np.zeros((trees, inner)), norm)
    x = forest.lift(sample)
    for t in range(trees):
        along = x @ planes[t].T
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                if len(own := along[node == k, k]):
                    forest.offsets[t, k] = np.median(own)
            node = 2 * node + 1 + (along[np.arange(len(x)), node] > forest.offsets[t, node])
    return forest


def _nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, kind: str) -> pd.DataFrame:
    """The k best vectors of the block for each query, exactly; ties to the smaller id."""
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    # equal vectors are scored once; of each, only the k + 1 smallest ids can be among the k best
    vectors = vectors.drop_duplicates().sort_values("vec_id")
    number, distinct = pd.factorize(vectors["_v"])
    by = np.argsort(number, kind="stable")
    ids = [g[: k + 1] for g in np.split(vectors["vec_id"].to_numpy()[by], np.cumsum(np.bincount(number))[:-1])]
    different = np.frombuffer(b"".join(distinct), kind).reshape(len(distinct), -1).astype(float)
    asked = np.frombuffer(b"".join(queries["_v"]), kind).reshape(len(queries), -1).astype(float)
    rough = asked @ different.T
    most = min(k + 1, rough.shape[1])
    least = -np.partition(-rough, most - 1, axis=1)[:, most - 1] - _TIE
    out_q, out_v, out_s = [], [], []
    for i, query in enumerate(queries["vec_id"].to_numpy()):
        at = np.flatnonzero(rough[i] >= least[i])
        exact = np.einsum("ij,j->i", different[at], asked[i])
        who = np.concatenate([ids[j] for j in at])
        score = np.repeat(exact, [len(ids[j]) for j in at])
        own = who != query
        who, score = who[own], score[own]
        top = np.lexsort((who, -score))[:k]
        out_q.append(np.full(len(top), query))
        out_v.append(who[top])
        out_s.append(score[top])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def search(
    rows: DataFrame,
    queries: Column,
    k: int = 20,
    vector: str = "embedding",
    trees: int = TREES,
    depth: int = DEPTH,
    leaves: int = LEAVES,
    sample: int = SAMPLE,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found per query row.

    ``rows`` has ``vec_id`` and ``vector``; ``queries`` tells its query rows. Unusable vectors,
    null ids and vectors whose length differs from the sample's take no part. Rows that agree in id
    and vector count once; a row is never its own neighbour, equal vectors of other ids are.
    The trees depend on the vectors of at most ``sample`` ids, the index holds all. With few rows a query
    visits all leaves; larger ``leaves`` raise recall, larger ``depth`` makes leaves finer.
    """
    spark = rows.sparkSession
    kind = "f4" if "float" in dict(rows.dtypes)[vector] else "f8"
    empty = "query_id long, rank int, vec_id long, score double"
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col(vector))).select(
        F.col("vec_id").cast("long"), F.col(vector).alias("_v"), queries.alias("_asks")
    )
    number = F.xxhash64("vec_id", F.lit(seed))
    place = F.pmod(number, F.lit(1 << 30))
    # ids are drawn, so that repeated rows neither fill the sample nor empty it
    ids = good.select("vec_id").distinct()
    chosen = drawn_first(ids, number, sample, ids.count()).orderBy(place, "vec_id").limit(sample)
    few = good.join(F.broadcast(chosen), "vec_id").groupBy("vec_id").agg(F.min("_v").alias("_v"))
    drawn = [r[2] for r in sorted(few.select(place, "vec_id", "_v").collect())]  # at most ``sample`` rows
    if not drawn:
        return spark.createDataFrame([], empty)
    size = len(drawn[0])
    good = good.where(F.size("_v") == size)
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    norm = good.agg(F.max(length)).first()[0]
    forest = spark.sparkContext.broadcast(
        grow(np.array([v for v in drawn if len(v) == size], float), float(norm), trees, depth, seed)
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.ascontiguousarray(batch.column("_v").flatten().to_numpy(zero_copy_only=False), kind)
            grid = flat.reshape(batch.num_rows, size)
            leaf = forest.value.leaves(grid.astype(float))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([r.tobytes() for r in grid], pa.binary()),
                    batch.column("_asks"),
                    pa.array(list(leaf), pa.list_(pa.int32())),
                ],
                names=["vec_id", "_v", "_asks", "_leaves"],
            )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("vec_id").to_pylist(), batch.column("_v").to_pylist()
            for i, raw in zip(ids, texts, strict=True):
                found = forest.value.visit(np.frombuffer(raw, kind).astype(float), leaves, held.value)
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": [i] * len(found), "_v": [raw] * len(found),
                     "_tree": pa.array([t for t, _ in found], pa.int32()),
                     "_leaf": pa.array([x for _, x in found], pa.int32())}
                )

    placed = materialize(good.mapInArrow(place, "vec_id long, _v binary, _asks boolean, _leaves array<int>"))
    indexed = placed.select("vec_id", "_v", F.posexplode("_leaves").alias("_tree", "_leaf"))
    filled = np.zeros((trees, 2**depth), np.int64)
    for tree, leaf, n in indexed.groupBy("_tree", "_leaf").count().collect():  # trees * 2 ** depth rows at most
        filled[tree, leaf] = n
    held = spark.sparkContext.broadcast(filled.tolist())
    asked = materialize(
        placed.where("_asks").select("vec_id", "_v").dropDuplicates()
        .mapInArrow(walk, "vec_id long, _v binary, _tree int, _leaf int")
    )
    # at most trees * 2 ** depth rows: how many blocks the two sides of a leaf are cut into
    sides = [df.groupBy("_tree", "_leaf").count() for df in (indexed, asked)]
    cut = (
        sides[0].select("_tree", "_leaf", F.ceil(F.col("count") / VECTOR_BLOCK).cast("int").alias("_nv"))
        .join(sides[1].select("_tree", "_leaf", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("_nq")), ["_tree", "_leaf"])
    )
    cut = F.broadcast(materialize(cut))
    key = ["_tree", "_leaf", "_vb", "_qb"]
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cut, ["_tree", "_leaf"]).withColumn("_qb", block("_nq")).withColumn("_vb", all_of("_nv"))
    right = indexed.join(cut, ["_tree", "_leaf"]).withColumn("_vb", block("_nv")).withColumn("_qb", all_of("_nq"))
    pairs = (
        left.select(*key, "vec_id", "_v").groupBy(*key)
        .cogroup(right.select(*key, "vec_id", "_v").groupBy(*key))
        .applyInPandas(
            lambda q, v: _nearest(q[["vec_id", "_v"]], v[["vec_id", "_v"]], k, kind),
            "query_id long, vec_id long, score double",
        )
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
