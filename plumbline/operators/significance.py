"""Paired comparison of runs and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from plumbline.functions.draws import LINE, PRIMES, RANGE, DrawLines, draw_array, half_array
from plumbline.operators.calibration import POOLED
from plumbline.operators.ranking import running_totals
from plumbline.session import materialize, release


def paired_differences(reports: DataFrame, variant: str, baseline: str, on: Sequence[str], value: str) -> DataFrame:
    """Every other variant against the baseline, paired by seed: (variant, on, value, base, diff).

    Seeds that only one side has, and undefined values, drop out.
    """
    base = reports.where(F.col(variant) == baseline).select(*on, F.col(value).alias("base"))
    other = reports.where(F.col(variant) != baseline).select(variant, *on, value)
    both = other.join(base, list(on)).where(F.col(value).isNotNull() & F.col("base").isNotNull())
    return both.withColumn("diff", F.col(value) - F.col("base"))


#: Terms of the continued fraction. It needs about the square root of n; beyond TAIL_EXACT tosses
#: the normal tail with its fourth-cumulant term is closer than rounding leaves the fraction.
TAIL_TERMS = 200
TAIL_EXACT = 10_000


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), na_action="ignore")


@F.pandas_udf(DoubleType())
def _log_gamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.lgamma(v) if v > 0 else math.inf, na_action="ignore")


def _upper_tail(n: Column, k: Column) -> Column:
    """P(X >= k) of a fair binomial: the regularised incomplete beta I(1/2; k, n - k + 1).

    A continued fraction of a fixed number of terms; for very many tosses the normal tail, corrected
    for continuity and for the fourth cumulant.
    """
    full = n
    z = (k - 0.5 - n / 2.0) / (F.sqrt(n) / 2.0)
    bell = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
    many = _normal_tail(z) - bell * (z * z * z - 3.0 * z) / (12.0 * n)
    n, k = F.least(n, F.lit(TAIL_EXACT)), F.when(n <= TAIL_EXACT, k).otherwise(F.lit(1))
    return F.when(full > TAIL_EXACT, many).otherwise(_exact_tail(n, k))


def _exact_tail(n: Column, k: Column) -> Column:
    a, b = k.cast("double"), (n - k + 1).cast("double")
    log_front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) - (a + b) * F.lit(math.log(2.0))

    def fraction(a: Column, b: Column) -> Column:
        tiny = F.lit(1e-300)
        near = lambda v: F.when(F.abs(v) < 1e-300, tiny).otherwise(v)
        d = 1.0 / near(1.0 - (a + b) * 0.5 / (a + 1.0))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

        def step(s: Column, m: Column) -> Column:
            m = m.cast("double")
            even = m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))

            def advance(s: Column, t: Column) -> Column:
                d, c = 1.0 / near(1.0 + t * s["d"]), near(1.0 + t / s["c"])
                return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

            first = advance(s, even)
            return F.aggregate(F.array(F.lit(0)), first, lambda x, _: advance(x, odd))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TAIL_TERMS)), start, step, lambda s: s["h"])

    front = F.exp(log_front)
    # the fraction converges fast left of the mean of its beta; else the other tail is taken
    direct = front * fraction(a, b) / a
    other = 1.0 - front * fraction(b, a) / b
    inside = F.when((a + 1) / (a + b + 2) > 0.5, direct).otherwise(other)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(inside)


def sign_test(diffs: DataFrame, keys: Sequence[str], diff: str = "diff") -> DataFrame:
    """One-sided exact sign test; ties stay in n but are no wins: (keys, n, wins, p_sign)."""
    counted = diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(diff) > 0, 1)).alias("wins"),
        F.avg(diff).alias("mean_diff"),
    )
    return counted.withColumn("p_sign", _upper_tail(F.col("n"), F.col("wins")))


@F.pandas_udf(DoubleType())
def _signed_rank_tail(ranks: pd.Series, w: pd.Series) -> pd.Series:
    """P(W >= w) under the null, given the doubled mid-ranks of the pairs: every sign is a fair toss.

    The law of the sum is built pair by pair: half of it stays, half moves up by the pair's rank.
    """

    def tail(own: np.ndarray, reached: float) -> float:
        law = np.zeros(int(own.sum()) + 1)
        law[0] = 1.0
        for r in own.astype(np.int64):
            moved = np.zeros_like(law)
            moved[r:] = law[: len(law) - r]
            law = (law + moved) / 2.0
        return float(law[max(0, math.ceil(2.0 * reached - 1e-9)) :].sum())

    return pd.Series([None if r is None else tail(np.asarray(r), v) for r, v in zip(ranks, w, strict=True)], dtype="float64")


def wilcoxon(
    diffs: DataFrame, keys: Sequence[str], diff: str = "diff", at_least: int = 5, method: str = "auto", exact_up_to: int = 50
) -> DataFrame:
    """One-sided signed-rank test: (keys, n_used, w_plus, p_wilcoxon).

    Zero differences drop out; NULL for fewer than ``at_least`` pairs. ``exact`` takes the law of the
    rank sum over all signs, ties sharing their mid-rank; its work grows with the cube of the pairs.
    ``normal`` approximates with tie correction; ``auto`` is exact without ties and zeros for up to
    ``exact_up_to`` pairs (the usual convention) and normal elsewhere.
    """
    if method not in ("exact", "normal", "auto"):
        raise ValueError(f"unknown method: {method}")
    keys = list(keys)
    levels = diffs.groupBy(*keys, F.abs(diff).alias("size")).agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(F.col(diff) > 0, 1)).alias("p")
    )
    zeros = levels.groupBy(*keys).agg(
        F.sum("c").alias("n_all"), F.sum(F.when(F.col("size") == 0, F.col("c")).otherwise(0)).alias("zeros")
    )
    cum = running_totals(levels.where("size > 0"), keys, [F.col("size")], {"upto": F.col("c")})
    mid_rank = F.col("upto") - (F.col("c") - 1) / 2.0
    listed = {"exact": F.lit(True), "normal": F.lit(False), "auto": F.col("upto_all") <= exact_up_to}[method]
    stats = cum.groupBy(*keys).agg(
        F.sum("c").alias("n_used"),
        F.sum(F.col("p") * mid_rank).alias("w_plus"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"),
        F.flatten(F.collect_list(F.when(listed, F.array_repeat(2 * F.col("upto") - F.col("c") + 1, F.col("c").cast("int"))))).alias("_ranks"),
    )
    out = zeros.join(stats, keys, "left") if keys else zeros.join(stats, F.lit(True), "left")
    n, w = F.col("n_used"), F.col("w_plus")
    plain = (F.col("zeros") == 0) & (F.col("ties") == 0) & (n <= exact_up_to)
    exact = {"exact": n.isNotNull(), "normal": F.lit(False), "auto": plain}[method]
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = (w - n * (n + 1) / 4.0) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    tested = out.withColumn("_normal", _normal_tail(z)).withColumn("_exact", _signed_rank_tail(F.when(exact, F.col("_ranks")), w))
    p = F.when(exact, F.col("_exact"))
    if method != "exact":
        p = p.otherwise(F.col("_normal"))
    return tested.withColumn("p_wilcoxon", F.when(F.col("n_all") >= at_least, p)).select(*keys, "n_used", "w_plus", "p_wilcoxon")


def mean_difference_interval(
    diffs: DataFrame, keys: Sequence[str], order: str, diff: str = "diff", draws: int = 10000, seed: int = 0
) -> DataFrame:
    """Percentile interval of the mean difference: resample the pairs of every key.

    Pairs are numbered in ``order``, which is unique per key. Blocks of pairs draw their own counts
    (see ``_resample_sums``), so no row per draw and pair exists.
    """
    keys = list(keys)
    cells = diffs.select(*keys, order, F.lit(0).alias("bin"), F.lit(1.0).alias("n"), F.col(diff).cast("double").alias("sum"))
    partial = _resample_sums(cells, keys, order, ["n", "sum"], draws, seed)
    means = partial.groupBy(*keys, "b").agg((F.sum("sum") / F.sum("n")).alias("m"))
    return _interval(means, keys, "m")


def _interval(replicates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    # one number per replicate, so at most ``draws`` values per key
    return replicates.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high")
    )


def _poisson_cuts() -> list[int]:
    """Upper ends, in [0, RANGE), of the draws that give weight 0, 1, 2, ... under Poisson(1).

    As many as the resolution of a draw can tell apart.
    """
    cuts, term, below, k = [], 1.0, 0.0, 0
    while True:
        below += term * math.exp(-1.0)
        cut = int(below * RANGE)
        if cut >= RANGE or (cuts and cut == cuts[-1]):
            return cuts
        cuts.append(cut)
        k += 1
        term /= k


def poisson_weight_sql(u: str) -> str:
    return " + ".join(f"({u} >= {cut})::int" for cut in _poisson_cuts())


#: Weights that nearly all draws have; larger ones are looked up one by one.
_COMMON = 5
#: Clusters whose weights are drawn together.
WEIGHED = 64


def poisson_weights(seed: int, draws: int, ids: np.ndarray) -> np.ndarray:
    """Poisson(1) weight of every cluster in every replicate: [cluster, replicate].

    The first half of a draw settles its weight unless it equals that of a cut.
    """
    cuts = _poisson_cuts()
    upper = np.array([c // PRIMES[1] for c in cuts])
    replicates = np.arange(draws)
    first = half_array(0, seed, replicates[None, :], ids[:, None])
    weights, open_ = np.zeros(first.shape, np.int8), np.zeros(first.shape, bool)
    for cut in upper[:_COMMON]:
        weights += (first > cut).view(np.int8)
        open_ |= first == cut
    open_ |= weights == _COMMON
    row, b = np.nonzero(open_)
    weights[row, b] = np.searchsorted(np.array(cuts), draw_array(seed, b, ids[row]), side="right")
    return weights.astype(np.float64)


def _poisson_sums(cells: DataFrame, keys: list[str], cluster: str, draws: int, seed: int) -> DataFrame:
    """Weighted bin sums of every replicate: (keys, bin, b, n, hits, conf), partial per task.

    All rows of a cluster come to one task, so its weights are drawn once. The weights of a batch of
    clusters are one matrix, so a task multiplies instead of writing one row per cluster and replicate.
    """
    values = ["n", "hits", "conf"]

    def spread(done: dict) -> pd.DataFrame:
        parts = []
        for key, sums in done.items():
            part = pd.DataFrame(sums, columns=values)
            part.insert(0, "b", np.arange(draws, dtype=np.int32))
            for name, k in zip([*keys, "bin"], key):
                part[name] = k
            parts.append(part)
        out = pd.concat(parts)[[*keys, "bin", "b", *values]]
        out["bin"] = out["bin"].astype("Int32")
        return out

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict = {}
        for f in frames:
            ids, where = np.unique(f[cluster].to_numpy(dtype=np.int64), return_inverse=True)
            filled = f.assign(bin=f["bin"].fillna(-1).astype(int))
            code = filled.groupby([*keys, "bin"], sort=False, dropna=False).ngroup().to_numpy()
            named = filled[[*keys, "bin"]].iloc[np.unique(code, return_index=True)[1]]
            order = np.lexsort((code, where // WEIGHED))
            part, code, where = f[values].to_numpy(np.float64)[order], code[order], where[order]
            ends = np.flatnonzero(np.diff(code, append=-1) | np.diff(where // WEIGHED, append=-1)) + 1
            sums: dict = {}
            start, block, weights = 0, -1, None
            for end in ends.tolist():
                if where[start] // WEIGHED != block:
                    block = where[start] // WEIGHED
                    weights = poisson_weights(seed, draws, ids[block * WEIGHED : (block + 1) * WEIGHED])
                more = weights[where[start:end] % WEIGHED].T @ part[start:end]
                group = int(code[start])
                sums[group] = sums[group] + more if group in sums else more
                start = end
            for group, key in enumerate(named.itertuples(index=False, name=None)):
                key = tuple(None if pd.isna(k) or (i == len(keys) and k == -1) else k for i, k in enumerate(key))
                done[key] = done[key] + sums[group] if key in done else sums[group]
            if len(done) * draws > 2_000_000:
                yield spread(done)
                done = {}
        if done:
            yield spread(done)

    schema = StructType()
    for k in keys:
        schema = schema.add(k, cells.schema[k].dataType)
    schema = schema.add("bin", IntegerType()).add("b", IntegerType())
    for v in values:
        schema = schema.add(v, DoubleType())
    narrow = cells.select(*keys, F.col("bin").cast("int").alias("bin"), cluster, *[F.col(v).cast("double").alias(v) for v in values])
    return narrow.repartition(cluster).sortWithinPartitions(cluster).mapInPandas(weigh, schema)


#: Clusters of one block, replicates drawn together, and random words handled at a time.
PICK_BLOCK = 1024
REPLICATES = 64
_WORDS = 1 << 20
#: Random bits taken from one draw; the lowest of its 62 are as good as even.
WORD = 60
#: Words from which on a line of draws is cheaper than single draws, and draws that stay in the cache.
_LINE_WORDS, _LINE_DRAWS = 8, 1 << 14


def _ones(r: np.ndarray, seed: int, b: np.ndarray, node: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Number of ones among ``r`` random bits of every (replicate, node) at its step ``t``."""
    out, long = np.zeros(len(r), np.int64), r > _LINE_WORDS * WORD
    for at, count in ((np.flatnonzero(long), _ones_in_lines), (np.flatnonzero(~long), _ones_one_by_one)):
        if len(at):
            out[at] = count(r[at], seed, b[at], node[at], t[at])
    return out


def _ones_one_by_one(r: np.ndarray, seed: int, b: np.ndarray, node: np.ndarray, t: np.ndarray) -> np.ndarray:
    words = -(-r // WORD)
    ends = np.cumsum(words)
    out = np.zeros(len(r), np.int64)
    total = int(ends[-1]) if len(ends) else 0
    for start in range(0, total, _WORDS):
        at = np.arange(start, min(start + _WORDS, total))
        owner = np.searchsorted(ends, at, "right")
        j = at - (ends - words)[owner]
        width = np.minimum(WORD, r[owner] - j * WORD)
        bits = draw_array(seed, b[owner], node[owner], t[owner], j) & ((np.int64(1) << width) - 1)
        low = int(owner[0])
        counts = np.bincount(owner - low, weights=np.bitwise_count(bits))
        out[low : low + len(counts)] += counts.astype(np.int64)
    return out


def _ones_in_lines(r: np.ndarray, seed: int, b: np.ndarray, node: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The same from lines of up to ``LINE`` words."""
    lines = -(-r // (WORD * LINE))
    ends = np.cumsum(lines)
    out = np.zeros(len(r), np.int64)
    total, whole = int(ends[-1]), np.int64((1 << WORD) - 1)
    for start in range(0, total, _WORDS // LINE * 16):
        at = np.arange(start, min(start + _WORDS // LINE * 16, total))
        owner = np.searchsorted(ends, at, "right")
        first = (at - (ends - lines)[owner]) * LINE
        left = np.minimum(r[owner] - first * WORD, LINE * WORD)
        order = np.argsort(-left, kind="stable")
        owner, first, left = owner[order], first[order], left[order]
        words = -(-left // WORD)
        draws = DrawLines(seed, b[owner], node[owner], t[owner], first=first)
        low = 0
        while low < len(owner):
            length = int(words[low])
            rows = slice(low, low + max(1, _LINE_DRAWS // length))
            bits = draws.whole(rows, length) & whole
            last = words[rows] - 1
            bits[np.arange(len(last)), last] &= (np.int64(1) << (left[rows] - last * WORD)) - 1
            if last[-1] < length - 1:
                bits[np.arange(length) > last[:, None]] = 0
            np.add.at(out, owner[rows], np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
            low = rows.stop
    return out


def _binomial(m: np.ndarray, share: np.ndarray, whole: np.ndarray, seed: int, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """How many of ``m`` picks fall left where ``share`` of ``whole`` clusters lie left.

    Every pick is a uniform number that is compared with share / whole bit by bit; of the picks not
    yet decided each bit decides those that differ from it, counted as ones of random bits. Integers
    only, so the law is exact and any engine gets the same counts.
    """
    left, undecided, rest, t = np.zeros_like(m), m.copy(), share.copy(), np.zeros_like(m)
    while True:
        live = np.flatnonzero((undecided > 0) & (rest > 0))
        if not len(live):
            return left
        ones = _ones(undecided[live], seed, b[live], node[live], t[live])
        bit = 2 * rest[live] >= whole[live]
        rest[live] = 2 * rest[live] - np.where(bit, whole[live], 0)
        left[live] += np.where(bit, undecided[live] - ones, 0)
        undecided[live] = np.where(bit, ones, undecided[live] - ones)
        t[live] += 1


def block_counts(total: int, replicates: np.ndarray, seed: int, size: int = PICK_BLOCK) -> np.ndarray:
    """Picks that fall on each block of ``size`` clusters: [replicate, block].

    ``total`` picks among ``total`` clusters are split down a binary tree of blocks; a node draws how
    many go left from (seed, replicate, node) alone.
    """
    n = len(replicates)
    counts = np.full((n, 1), total, np.int64)
    low, high, node = np.zeros(1, np.int64), np.full(1, -(-total // size), np.int64), np.ones(1, np.int64)
    while (wide := high - low > 1).any():
        at = np.flatnonzero(wide)
        mid = (low[at] + high[at]) // 2
        share, whole = (mid - low[at]) * size, np.minimum(high[at] * size, total) - low[at] * size
        left = _binomial(
            counts[:, at].ravel(), np.tile(share, n), np.tile(whole, n), 2 * seed + 1,
            np.repeat(replicates, len(at)), np.tile(node[at], n),
        ).reshape(n, len(at))
        parts = 1 + wide.astype(np.int64)
        first = (np.cumsum(parts) - parts)[at]
        right = counts[:, at] - left
        counts, low, high, node = (np.repeat(x, parts, axis=-1) for x in (counts, low, high, node))
        counts[:, first], counts[:, first + 1] = left, right
        high[first], low[first + 1] = mid, mid
        node[first], node[first + 1] = 2 * node[first], 2 * node[first + 1] + 1
    return counts


#: Blocks and keys that a task weighs together at most, and lines of picks that stay in the cache.
BLOCKS_AT_ONCE, KEYS_AT_ONCE = 32, 8
_LINES_AT_ONCE = 32
#: Tasks that the splitting of picks is dealt to at most.
MOST_TASKS = 2048


def picked(block: int, size: int, replicates: np.ndarray, counts: np.ndarray, seed: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """How often each cluster of a block is picked: some replicates at a time, a matrix [replicate, cluster] per key.

    ``counts`` are the picks that fall on the block: [key, replicate]. A pick depends on its replicate, block
    and number only, so the picks that all keys have are drawn and counted once.
    """
    least, most = counts.min(axis=0), counts.max(axis=0)
    if size != PICK_BLOCK or size & (size - 1):
        for i, b in enumerate(replicates):
            drawn = draw_array(2 * seed, np.array([b]), np.array([block]), np.arange(most[i])) % size
            yield slice(i, i + 1), [np.bincount(drawn[:n], minlength=size)[None].astype(np.float64) for n in counts[:, i]]
        return
    lines = DrawLines(2 * seed, replicates, np.full(len(replicates), block))
    for start in range(0, len(replicates), _LINES_AT_ONCE):
        rows = slice(start, min(start + _LINES_AT_ONCE, len(replicates)))
        shared, length = int(least[rows].min()), int(most[rows].max())
        n = rows.stop - start
        pick = lines.low_bits(rows, length, size.bit_length() - 1)
        pick += np.arange(n)[:, None] * size
        common = np.bincount(pick[:, :shared].ravel(), minlength=n * size)
        rest, number = pick[:, shared:], np.arange(shared, length)
        yield rows, [
            np.add(common, np.bincount(rest[number < own[rows, None]], minlength=n * size), dtype=np.float64).reshape(n, size)
            for own in counts
        ]


def _resample_sums(
    cells: DataFrame, keys: list[str], cluster: str, values: Sequence[str], draws: int, seed: int
) -> DataFrame:
    """Weighted sums of ``values`` in every replicate: (keys, bin, b, values), partial per span of blocks.

    As many picks as clusters, with replacement. How many picks a block of clusters gets is drawn
    down a tree of blocks; the block then places its picks among its own clusters. Only one number
    per replicate and block travels, and the work is clusters times draws. A task weighs some blocks
    of some keys and returns their sums.
    """
    values = list(values)
    # written once: the clusters are numbered and then found again
    cells = materialize(cells.select(*keys, cluster, "bin", *values))
    clusters = running_totals(cells.select(*keys, cluster).distinct(), keys, [F.col(cluster)], {}).select(
        *keys, cluster, F.col("n").alias("total"), (F.col("rank") - 1).alias("idx")
    )
    located = materialize(
        cells.join(clusters, [*keys, cluster]).select(
            *keys, "total", F.floor(F.col("idx") / PICK_BLOCK).alias("block"), "idx", F.col("bin").cast("int").alias("bin"),
            *[F.col(v).cast("double").alias(v) for v in values],
        )
    )
    release(cells)
    totals = materialize(located.groupBy(*keys).agg(F.max("total").alias("total")))
    known, most = totals.agg(F.count(F.lit(1)), F.max("total")).first()
    blocks, cores = -(-(most or 1) // PICK_BLOCK), cells.sparkSession.sparkContext.defaultParallelism
    # numbers of partitions are given: by their bytes these few rows would all go to one task
    span = max(1, min(BLOCKS_AT_ONCE, blocks // (4 * cores)))
    buckets = max(1, known // KEYS_AT_ONCE)
    tasks = min(MOST_TASKS, -(-blocks // span) * buckets)
    rows = max(1, known * -(-draws // REPLICATES))
    parts = totals.select(
        *keys, "total", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(REPLICATES))).alias("first")
    ).repartition(min(MOST_TASKS, rows), *keys, "first")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                replicates = np.arange(row["first"], min(row["first"] + REPLICATES, draws), dtype=np.int64)
                counts = block_counts(row["total"], replicates, seed)
                out = pd.DataFrame({"block": np.arange(counts.shape[1]), "first": row["first"]})
                out["counts"] = [c.astype("<i8").tobytes() for c in counts.T]
                for k in keys:
                    out[k] = row[k]
                yield out[[*keys, "block", "first", "counts"]]

    def weigh(drawn: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        place = [*keys, "block"]
        own = {key: f for key, f in part.groupby(place, sort=False)}
        alike: dict = {}  # keys whose block has the same number of clusters
        for key, f in drawn.groupby(place, sort=False):
            size = min(PICK_BLOCK, int(own[key]["total"].iloc[0]) - key[-1] * PICK_BLOCK)
            alike.setdefault((key[-1], size), []).append((key[:-1], f.sort_values("first")))
        code, bins = pd.factorize(part["bin"].fillna(-1).astype("int64"))
        codes = pd.Series(code, index=part.index)
        done: dict = {}
        known: dict = {}
        for (block, size), members in alike.items():
            spreads = []
            for key, _ in members:
                rows = own[*key, block]
                spread = np.zeros((size, len(bins), len(values)))
                at, c = (rows["idx"] % PICK_BLOCK).to_numpy(np.int64), codes[rows.index].to_numpy()
                for k, v in enumerate(values):
                    np.add.at(spread[:, :, k], (at, c), rows[v].to_numpy(np.float64))
                spread = spread.reshape(size, -1)
                # an undefined sum counts as none for its block, bin and value
                undefined = np.isnan(spread).any(axis=0)
                spreads.append(np.where(undefined, 0.0, spread))
                if key not in done:
                    done[key], known[key] = np.zeros((draws, len(undefined))), np.zeros(len(undefined), bool)
                known[key] |= np.repeat(np.isin(np.arange(len(bins)), c), len(values)) & ~undefined
            counts = np.stack([np.concatenate([np.frombuffer(x, "<i8") for x in f["counts"]]) for _, f in members])
            for b, weights in picked(block, size, np.arange(draws, dtype=np.int64), counts, seed):
                for (key, _), spread, w in zip(members, spreads, weights, strict=True):
                    done[key][b] += w @ spread
        sums = [
            (key, b, [np.ascontiguousarray(total[:, at]) if known[key][at] else None for at in range(i * len(values), (i + 1) * len(values))])
            for key, total in done.items() for i, b in enumerate(bins) if known[key][i * len(values) : (i + 1) * len(values)].any()
        ]
        out = pd.DataFrame({k: [key[i] for key, _, _ in sums] for i, k in enumerate(keys)}, index=range(len(sums)))
        out["bin"] = pd.Series([b for _, b, _ in sums], dtype="Int32").replace(-1, pd.NA)
        for i, v in enumerate(values):
            out[v] = pd.Series([s[i] for _, _, s in sums], dtype=object)
        return out

    key_fields = [cells.schema[k] for k in keys]
    drawn = parts.mapInPandas(
        split, StructType([*key_fields, *StructType.fromDDL("block long, first int, counts binary").fields])
    )
    schema = StructType([*key_fields, *StructType.fromDDL("bin int").fields])
    for v in values:
        schema = schema.add(v, ArrayType(DoubleType()))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0).cast("long")

    def dealt(df: DataFrame) -> GroupedData:
        placed = df.withColumns({"_span": F.floor(F.col("block") / span), "_bucket": bucket})
        return placed.repartition(tasks, "_span", "_bucket").groupBy("_span", "_bucket")

    sums = dealt(drawn).cogroup(dealt(located)).applyInPandas(weigh, schema)
    none = F.array_repeat(F.lit(None).cast("double"), draws)
    filled = F.arrays_zip(*[F.coalesce(v, none).alias(v) for v in values])
    return sums.select(*keys, "bin", F.posexplode(filled).alias("b", "_v")).select(*keys, "bin", "b", "_v.*")


def cluster_bootstrap(
    sums: DataFrame, keys: Sequence[str], group: str, cluster: str, draws: int = 2000, seed: int = 0, scheme: str = "resample"
) -> DataFrame:
    """Percentile interval of the ECE, resampling whole clusters (images), per group and pooled.

    ``sums`` are ``bin_sums`` keyed by (keys, group, cluster): all that the error depends
    on. ``resample`` draws as many clusters as there are, with replacement: block by block, each
    from its own share of the picks. For very many clusters ``poisson`` gives each cluster (an integer id) an independent
    Poisson(1) weight instead, needs no shuffle before the final sums, and differs by terms of
    the order 1/sqrt(clusters).
    """
    if scheme not in ("resample", "poisson"):
        raise ValueError(f"unknown scheme: {scheme}")
    keys, values = [*keys, group], ("n", "hits", "conf")
    both = F.explode(F.array(F.col(group).cast("string"), F.lit(POOLED)))
    if scheme == "poisson":
        # a cluster weighs the same in its groups and in all of them, so pooled sums are sums of sums
        own = _poisson_sums(sums, keys, cluster, draws, seed).groupBy(*keys, "b", "bin").agg(*[F.sum(c).alias(c) for c in values])
        partial = own.withColumn(group, both)
    else:
        cells = (
            sums.withColumn(group, both)
            .groupBy(*keys, cluster, "bin")
            .agg(*[F.sum(c).alias(c) for c in values])
        )
        partial = _resample_sums(cells, keys, cluster, values, draws, seed)
    per_bin = partial.groupBy(*keys, "b", "bin").agg(*[F.sum(c).alias(c) for c in values])
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("hits") - F.col("conf"))).otherwise(0.0)
    errors = per_bin.groupBy(*keys, "b").agg((F.sum(gap) / F.sum("n")).alias("ece"))
    return _interval(errors, keys, "ece")

