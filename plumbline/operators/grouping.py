"""Groups found by clustering, their agreement with metadata, and nearest-reference scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from plumbline.functions.draws import draw
from plumbline.operators.ranking import running_totals
from plumbline.session import materialize, release


#: Rows of a sample that first centres are drawn from.
SEED_ROWS = 4096


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the sample, each new one drawn by its squared distance to those before."""
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = near.sum()
        pick = int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else int(rng.integers(len(sample)))
        chosen.append(min(pick, len(sample) - 1))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row (ties to the lower) and its squared distance."""
    far = (x**2).sum(axis=1)[:, None] - 2.0 * x @ centres.T + (centres**2).sum(axis=1)
    best = far.argmin(axis=1)
    return best, np.maximum(far[np.arange(len(x)), best], 0.0)


#: Rows of a block, and rows that one file of blocks holds at most.
BLOCK_ROWS, FILE_ROWS = 2048, 65_536


def _blocks(rows: DataFrame, vec: str, weights: Sequence[str]) -> DataFrame:
    """Rows as written blocks of doubles: ``x`` holds their vectors one after another, ``w`` a line per weight.

    Every round of a fit reads the rows again; a block needs no conversion, and the files are as many
    as keep all cores busy.
    """
    spark = rows.sparkSession
    rows = rows.select(vec, *weights)
    n = rows.count()
    files = max(min(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)), -(-n // FILE_ROWS), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks()
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column(0).chunks]).astype("<f8")
            w = b"".join(t.column(name).to_numpy().astype("<f8").tobytes() for name in weights)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([w], pa.binary())], names=["x", "w"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                kept.append(batch.slice(at, BLOCK_ROWS))
                if sum(b.num_rows for b in kept) >= BLOCK_ROWS:
                    yield block()
        if kept:
            yield block()

    return materialize(rows.repartition(files).mapInArrow(pack, "x binary, w binary"))


def fit_together(
    rows: DataFrame, vec: str, models: Sequence[tuple[int, int, str | None]], rounds: int = 300, tolerance: float = 1e-4
) -> list[tuple[np.ndarray, float]]:
    """Centres and inertia of several k-means models, all fitted in the same passes over the rows.

    A model is (k, seed, weight): ``weight`` names a column of row weights, None counts every row once.
    In a round every block of rows is multiplied once with the centres of all models still moving, and only
    sums per centre are added up over the blocks. A model stands still when the squared moves of its centres add up to
    less than ``tolerance`` times the mean variance of the rows; a model that still moves after
    ``rounds`` raises. First centres come from ``SEED_ROWS`` rows, the smallest of a hash.
    """
    weights = [w for w in dict.fromkeys(m[2] for m in models) if w]
    few = rows.select(vec).orderBy(F.xxhash64(vec), vec).limit(SEED_ROWS).collect()
    sample = np.array([r[0] for r in few], dtype=np.float64)
    if not len(sample):
        raise ValueError("no rows to cluster")
    scale = float(sample.var(axis=0).mean())
    centres = [_first_centres(sample, k, np.random.default_rng([seed, k])) for k, seed, _ in models]
    inertia = [math.inf] * len(models)
    moving = list(range(len(models)))
    width = len(sample[0]) + 1
    blocks = _blocks(rows, vec, weights)
    for _ in range(rounds + 1):
        now = [(i, len(centres[i]), models[i][2]) for i in moving]
        points = np.concatenate([centres[i] for i in moving])
        lengths = (points**2).sum(axis=1)

        def sums(frames: Iterator[pd.DataFrame], now: list = now, points: np.ndarray = points, lengths: np.ndarray = lengths) -> Iterator[pd.DataFrame]:
            total, cost = np.zeros((len(points), points.shape[1] + 1)), dict.fromkeys((i for i, _, _ in now), 0.0)
            for raw, lines in ((r, w) for f in frames for r, w in zip(f["x"], f["w"], strict=True)):
                x = np.frombuffer(raw, "<f8").reshape(-1, points.shape[1])
                weight = dict(zip(weights, np.frombuffer(lines, "<f8").reshape(len(weights), len(x)), strict=True))
                # one product with the centres of all models, and one for all sums
                far = (x**2).sum(axis=1)[:, None] - 2.0 * x @ points.T + lengths
                hot, at, start = np.zeros(far.shape), np.arange(len(x)), 0
                for i, k, w in now:
                    best = far[:, start : start + k].argmin(axis=1) + start
                    gap = np.maximum(far[at, best], 0.0)
                    hot[at, best] = weight[w] if w else 1.0
                    cost[i] += float(gap @ weight[w] if w else gap.sum())
                    start += k
                total[:, :-1] += hot.T @ x
                total[:, -1] += hot.sum(axis=0)
            out, start = [], 0
            for i, k, _ in now:
                out.append((i, cost[i], total[start : start + k].tobytes()))
                start += k
            yield pd.DataFrame(out, columns=["model", "cost", "sums"])

        def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole: dict[int, tuple[float, np.ndarray]] = {}
            for f in frames:
                for i, c, raw in zip(f["model"], f["cost"], f["sums"], strict=True):
                    before = whole.get(i, (0.0, 0.0))
                    whole[i] = before[0] + c, before[1] + np.frombuffer(raw)
            yield pd.DataFrame([(i, c, s.tobytes()) for i, (c, s) in whole.items()], columns=["model", "cost", "sums"])

        parts = "model int, cost double, sums binary"
        found = blocks.mapInPandas(sums, parts).repartition("model").mapInPandas(added, parts).collect()  # one row per model
        still = []
        for i, cost, raw in found:
            lines = np.frombuffer(raw).reshape(len(centres[i]), width)
            some = lines[:, -1] > 0  # an empty centre stays where it is
            new = centres[i].copy()
            new[some] = lines[some, :-1] / lines[some, -1:]
            inertia[i] = cost
            if ((new - centres[i]) ** 2).sum() > tolerance * scale:
                centres[i] = new
                still.append(i)
        moving = sorted(still)
        if not moving:
            release(blocks)
            return [(c, v) for c, v in zip(centres, inertia, strict=True)]
    raise RuntimeError(f"{len(moving)} models still move after {rounds} rounds")


def _with_clusters(df: DataFrame, vec: str, labels: dict[str, np.ndarray]) -> DataFrame:
    """Number of the nearest centre of each named model, as one column per name."""
    names = list(labels)

    @F.pandas_udf(StructType([StructField(n, IntegerType()) for n in names]))
    def assign(v: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({n: pd.Series([], dtype="int32") for n in names})
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.DataFrame({n: _nearest(x, labels[n])[0].astype("int32") for n in names})

    return df.withColumn("_m", assign(F.col(vec))).select(*df.columns, *[F.col(f"_m.{n}").alias(n) for n in names])


def assigned(df: DataFrame, vec: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Rows with ``centre``, the number of the nearest of the given centres, and its squared ``distance``."""
    points = np.array(centres, dtype=np.float64)

    @F.pandas_udf("centre int, distance double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({"centre": pd.Series([], dtype="int32"), "distance": pd.Series([], dtype="float64")})
        best, gap = _nearest(np.stack(v.to_numpy()).astype(np.float64), points)
        return pd.DataFrame({"centre": best.astype("int32"), "distance": gap})

    return df.withColumn("_n", nearest(F.col(vec))).select(*df.columns, "_n.centre", "_n.distance")


class Scaling:
    """Zero mean and unit spread of each feature; a constant feature becomes 0."""

    def __init__(self, features: Sequence[str]) -> None:
        self.features = list(features)

    def fit(self, rows: DataFrame) -> "Scaling":
        figures = rows.agg(*[f(F.col(c).cast("double")) for c in self.features for f in (F.avg, F.stddev_samp)]).first()
        self.mean = [figures[2 * i] or 0.0 for i in range(len(self.features))]
        self.spread = [figures[2 * i + 1] or 0.0 for i in range(len(self.features))]
        return self

    def column(self) -> Column:
        return F.array(*[
            (F.col(c).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
            for c, m, s in zip(self.features, self.mean, self.spread, strict=True)
        ])


class StyleGroups:
    """Standardise on the training rows, cluster them, and label any rows ``style<c>``."""

    def __init__(self, features: Sequence[str], k: int = 4, seed: int = 0, restarts: int = 10):
        self.features, self.k, self.seed, self.restarts = list(features), k, seed, restarts

    def fit(self, train: DataFrame) -> "StyleGroups":
        self.scaling = Scaling(self.features).fit(train)
        rows = materialize(train.select(self.scaling.column().alias("v")))
        fits = fit_together(rows, "v", [(self.k, self.seed + i, None) for i in range(self.restarts)])
        self.centres, self.inertia = min(fits, key=lambda f: f[1])
        release(rows)
        return self

    def label(self, df: DataFrame, out: str = "background") -> DataFrame:
        named = _with_clusters(df.withColumn("_v", self.scaling.column()), "_v", {"_c": self.centres})
        return named.withColumn(out, F.concat(F.lit("style"), F.col("_c").cast("string"))).drop("_v", "_c")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))


def cluster_purity(table: DataFrame) -> DataFrame:
    """Per cluster ``a``: rows, dominant ``b`` (ties to the smaller name) and its share."""
    return table.groupBy("a").agg(
        F.sum("c").alias("n"),
        F.min(F.struct((-F.col("c")).alias("c"), F.col("b"))).alias("top"),
    ).select(F.col("a").alias("cluster"), "n", F.col("top.b").alias("dominant"), (-F.col("top.c") / F.col("n")).alias("purity"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """Adjusted Rand index of the two labellings behind a contingency table (one row)."""

    def pairs(c: str):
        return F.col(c).cast("double") * (F.col(c) - 1) / 2.0

    sums = (
        table.select(F.lit("ab").alias("side"), "c")
        .unionByName(table.groupBy("a").agg(F.sum("c").alias("c")).select(F.lit("a").alias("side"), "c"))
        .unionByName(table.groupBy("b").agg(F.sum("c").alias("c")).select(F.lit("b").alias("side"), "c"))
        .agg(
            *[F.sum(F.when(F.col("side") == s, pairs("c"))).alias(s) for s in ("ab", "a", "b")],
            F.sum(F.when(F.col("side") == "ab", F.col("c"))).alias("n"),
        )
    )
    expected = F.col("a") * F.col("b") / F.nullif(pairs("n"), F.lit(0.0))
    spread = (F.col("a") + F.col("b")) / 2.0 - expected
    return sums.select(F.when(spread == 0, F.lit(1.0)).otherwise((F.col("ab") - expected) / spread).alias("ari"))


def cluster_count_sweep(
    df: DataFrame, features: Sequence[str], ks: Sequence[int], row_id: str, resamples: int = 5, seed: int = 0, restarts: int = 3, smallest: int = 10
) -> DataFrame:
    """One row per k: inertia, silhouette, CH, DB, smallest cluster, bootstrap ARI, chosen.

    The chosen k is the largest whose mean ARI is at least 0.9 and whose smallest cluster
    has at least ``smallest`` rows. All restarts and resamples of all k are fitted together. The driver
    only holds centres and figures per k. The silhouette is the squared-distance form.
    """
    spark = df.sparkSession
    scaling = Scaling(features).fit(df)
    rows = materialize(df.select(row_id, scaling.column().alias("v")))
    weights = {f"w{r}": seed + 100 + r for r in range(resamples)}
    weighed = materialize(_resampled(rows, row_id, weights))
    models = [(k, seed + i, None) for k in ks for i in range(restarts)] + [(k, seed + r, f"w{r}") for k in ks for r in range(resamples)]
    fits = fit_together(weighed, "v", models)
    best, again = {}, {}
    for (k, s, w), (centres, cost) in zip(models, fits, strict=True):
        if w is None:
            best[k] = min(best.get(k, (None, math.inf)), (centres, cost), key=lambda f: f[1])
        else:
            again[k, int(w[1:])] = centres
    names = {f"k{k}": best[k][0] for k in ks} | {f"k{k}w{r}": c for (k, r), c in again.items()}
    labelled = materialize(_with_clusters(rows, "v", names))
    figures = []
    for k in ks:
        centres, cost = best[k]
        sizes, silhouette, ch, db = _spread_scores(labelled.select("v", F.col(f"k{k}").alias("prediction")), centres)
        aris = [adjusted_rand(contingency(labelled, f"k{k}", f"k{k}w{r}")).first()[0] for r in range(resamples)]
        mean, sd = (float(np.mean(aris)), float(np.std(aris))) if aris else (None, None)
        figures.append((int(k), float(cost), silhouette, ch, db, min(sizes), mean, sd))
    release(rows, weighed, labelled)
    table = spark.createDataFrame(
        figures, "k int, inertia double, silhouette double, ch double, db double, smallest int, ari_mean double, ari_sd double"
    )
    fit = (F.col("ari_mean") >= 0.9) & (F.col("smallest") >= smallest)
    top = table.where(fit).agg(F.max("k")).scalar()
    return table.withColumn("chosen", F.coalesce(F.col("k") == top, F.lit(False)))


def _resampled(rows: DataFrame, row_id: str, seeds: dict[str, int]) -> DataFrame:
    """Bootstrap weights as columns: how often a row is hit when as many ids are drawn as there are rows."""
    numbered = materialize(running_totals(rows, [], [F.col(row_id)], {}).withColumn("slot", F.col("rank") - 1).drop("rank"))
    if not seeds:
        return numbered.drop("slot", "n")
    hits = numbered.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (draw(s, F.col(row_id)) % F.col("n")).alias("slot")) for name, s in seeds.items()
    ])).alias("h")).select("h.*")
    counted = hits.groupBy("slot").agg(*[F.count(F.when(F.col("name") == name, 1)).cast("double").alias(name) for name in seeds])
    return numbered.drop("n").join(counted, "slot", "left").drop("slot").fillna(0.0, list(seeds))


def _spread_scores(labelled: DataFrame, centres: np.ndarray) -> tuple[list[int], float | None, float | None, float | None]:
    """Sizes, squared-distance silhouette, Calinski-Harabasz and Davies-Bouldin from sums per cluster."""
    k, width = centres.shape

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, width + 4))
        for f in frames:
            if f.empty:
                continue
            x, own = np.stack(f["v"].to_numpy()).astype(np.float64), f["prediction"].to_numpy()
            gap = ((x - centres[own]) ** 2).sum(axis=1)
            np.add.at(total, own, np.column_stack([x, np.ones(len(x)), (x**2).sum(axis=1), gap, np.sqrt(gap)]))
        yield pd.DataFrame({"prediction": np.arange(k), "sums": [[float(v) for v in t] for t in total]})

    rows = labelled.select("v", "prediction")
    added = rows.mapInPandas(sums, "prediction int, sums array<double>").groupBy("prediction").agg(
        F.array(*[F.sum(F.col("sums")[j]) for j in range(width + 4)]).alias("sums")
    )
    table = np.zeros((k, width + 4))
    for r in added.collect():  # one row per cluster
        table[r["prediction"]] = r["sums"]
    size, squares, within, radius = table[:, width], table[:, width + 1], table[:, width + 2], table[:, width + 3]
    total = size.sum()
    if k < 2 or total <= k or (size == 0).any():
        return [int(s) for s in size], None, None, None
    mean = table[:, :width] / size[:, None]

    def silhouettes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            x, own = np.stack(f["v"].to_numpy()).astype(np.float64), f["prediction"].to_numpy()
            # mean squared distance to all members of every cluster
            far = (x**2).sum(axis=1)[:, None] - 2.0 * x @ mean.T + squares / size
            at = np.arange(len(x))
            inside = far[at, own] * size[own] / np.maximum(size[own] - 1, 1)
            far[at, own] = np.inf
            outside = far.min(axis=1)
            value = np.where(size[own] == 1, 0.0, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300))
            yield pd.DataFrame({"s": [float(value.sum())]})

    silhouette = rows.mapInPandas(silhouettes, "s double").agg(F.sum("s")).first()[0] / total
    middle = (centres * size[:, None]).sum(axis=0) / total
    between = float((size * ((centres - middle) ** 2).sum(axis=1)).sum())
    ch = between / (k - 1) / (within.sum() / (total - k)) if within.sum() else None
    apart = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    r = radius / size
    db = float(((r[:, None] + r[None, :]) / apart).max(axis=1).mean())
    return [int(s) for s in size], float(silhouette), float(ch) if ch is not None else None, db


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


def _margin_score(df: DataFrame, vec: str, positive: np.ndarray, negative: np.ndarray, scale: float, bias: float, out: str) -> DataFrame:
    """scale * (best cosine to a positive - best cosine to a negative) + bias."""

    @F.pandas_udf(DoubleType())
    def score(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype="float64")
        unit = _unit(np.stack(v.to_numpy()))
        near = (unit @ positive.T).max(axis=1)
        far = (unit @ negative.T).max(axis=1) if len(negative) else 0.0
        return pd.Series(scale * (near - far) + bias)

    if not len(positive):
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, score(F.col(vec)))


BANK_ROWS, BANK_PER_CLASS = 1024, 512  # fixed values: size limits of the bank


HANDED_ROWS = 16_384


def _handed(few: DataFrame) -> list:
    """Rows of a table of checked size."""
    rows = few.limit(HANDED_ROWS + 1).collect()
    if len(rows) > HANDED_ROWS:
        raise ValueError(f"more than {HANDED_ROWS} references; draw a sample with memory_bank or class_prototypes")
    return rows


def memory_bank(labelled: DataFrame, row_id: str, vec: str, label: str = "positive", seed: int = 0, rows: int = BANK_ROWS, per_class: int = BANK_PER_CLASS) -> DataFrame:
    """References: the first ``rows`` labelled vectors, at most ``per_class`` of each class at random."""
    first = labelled.orderBy(row_id).limit(rows)
    order = W.partitionBy(label).orderBy(draw(seed, F.col(row_id)), F.col(row_id))
    return first.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_class).select(row_id, vec, label)


def memory_bank_score(df: DataFrame, bank: DataFrame, vec: str, label: str = "positive", out: str = "ver_logit") -> DataFrame:
    """5 * (nearest positive - nearest negative) by cosine; 0 with no positive reference.

    The bank is handed to every task, so it may have ``HANDED_ROWS`` rows at most.
    """
    rows = _handed(bank.select(vec, label))
    positive = [r[0] for r in rows if r[1] == 1]
    negative = [r[0] for r in rows if r[1] == 0]
    return _margin_score(
        df, vec, _unit(positive) if positive else np.empty((0, 1)), _unit(negative) if negative else np.empty((0, 1)), 5.0, 0.0, out
    )


def class_prototypes(labelled: DataFrame, row_id: str, vec: str, label: str = "positive", k: int = 8, seed: int = 0, per_class: int = 128) -> DataFrame:
    """k centres per class from labelled vectors: (label, vec).

    Fitted on ``per_class`` vectors of each class at most, drawn by a hash of their ids. A class
    with no more than k vectors keeps its own vectors, repeated up to k.
    """
    drawn = [
        labelled.where(F.col(label) == c).orderBy(draw(seed, F.col(row_id)), row_id).limit(per_class).select(label, vec)
        for c in (0, 1)
    ]
    first = materialize(drawn[0].unionByName(drawn[1]))
    out = []
    for c in (0, 1):
        rows = first.where(F.col(label) == c)
        n = rows.count()
        if n == 0:
            continue
        if n <= k:
            own = [list(r[0]) for r in rows.select(vec).collect()]
            out += [(c, own[i % n]) for i in range(k)]
        else:
            model = KMeans(k=k, seed=seed, featuresCol="f", maxIter=25).fit(rows.select(array_to_vector(vec).alias("f")))
            out += [(c, [float(x) for x in centre]) for centre in model.clusterCenters()]
    return labelled.sparkSession.createDataFrame(out, f"{label} int, {vec} array<double>")


def prototype_score(df: DataFrame, prototypes: DataFrame, vec: str, label: str = "positive", scale: float = 10.0, bias: float = 0.0, out: str = "ver_logit") -> DataFrame:
    rows = _handed(prototypes.select(vec, label))
    positive, negative = [r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0]
    return _margin_score(df, vec, _unit(positive) if positive else np.empty((0, 1)), _unit(negative) if negative else np.empty((0, 1)), scale, bias, out)
