"""Mix sources to target weights: whole documents whose lengths sum up to each target.

Every source gets its weight's share of the budget, at most ``most`` times its size. Whole
passes over the source come first. What is left of the target is a subset-sum over the
histogram of document lengths: the same share of every length is taken, and a bounded-knapsack
dynamic program over the lengths still free fills the last few thousand words exactly where that
is possible. Which documents of a length are taken follows a seeded hash of their ids.

The plan works on one row per (source, length); only ids and lengths of documents are moved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, map_texts
from plumbline.operators.ranking import running_totals
from plumbline.session import materialize

#: Documents of one length and source that are ranked together, and rows of one id that are written together.
RANKED = 1000
#: Words that the dynamic program fills, at least; it is widened to the longest document.
WINDOW = 16_384


def fill(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length come closest to ``budget`` from below, by dynamic programming.

    At most ``free[i]`` documents of ``lengths[i]``; counts are split into powers of two. A sum
    remembers the item that reached it first, so memory is one number per word of the budget.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    first = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i, length in enumerate(lengths):
        left, part = min(int(free[i]), budget // int(length)), 1
        while left > 0 and not reached[budget]:
            part = min(part, left)
            weight = part * int(length)
            fresh = ~reached
            fresh[:weight] = False
            fresh[weight:] &= reached[: budget + 1 - weight]
            first[fresh] = len(items)
            reached |= fresh
            items.append((i, part))
            left, part = left - part, part * 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, part = items[first[at]]
        taken[i] += part
        at -= part * int(lengths[i])
    return taken


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length so that their words come near ``budget``."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = (counts.astype(object) * budget // total).astype(np.int64) if total else np.zeros_like(counts)
    rest = budget - int((lengths * share).sum())
    window = max(WINDOW, 2 * int(lengths.max(initial=0)))
    # one more of the lengths that lost most by rounding down, until the window can fill the rest
    lost = (counts.astype(object) * budget % total).astype(float) / total if total else np.zeros(len(counts))
    for i in np.lexsort((lengths, -lost)):
        if rest <= window:
            break
        if share[i] < counts[i] and lengths[i] <= rest:
            share[i] += 1
            rest -= int(lengths[i])
    order = np.argsort(-lengths, kind="stable")
    share[order] += fill(lengths[order], (counts - share)[order], rest)
    return share


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source and size: the number of words of the whole text (null: 0)."""

    def work(cols: dict) -> dict:
        return {
            "doc_id": cols["doc_id"], "source": cols["source"], "size": [len(x.split()) for x in cols["_raw"]],
        }

    kinds = dict(docs.dtypes)
    return map_texts(
        docs.select("doc_id", "source", as_bytes(text).alias("_raw")), work,
        f"doc_id {kinds['doc_id']}, source {kinds['source']}, size bigint",
    )


def targets(
    sized: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, source_size and target, one row per source.

    Sources in order of code points, null last, get ``weights`` in turn. They share ``budget``
    times all words; a target stops at ``most`` times its source, and the excess goes to the
    others by weight. One level fits all: target = min(most * size, level * weight).
    """
    last = F.col("source").asc_nulls_last()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = (
        running_totals(by_source, [], [last], {})
        .select("source", "source_size", weight.alias("_w"), (most * F.col("source_size")).alias("_cap"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    rising = materialize(
        running_totals(
            capped, [], [F.col("_ratio"), last],
            {"_caps": F.col("_cap"), "_weights": F.col("_w"), "_sizes": F.col("source_size")},
        )
    )
    # the level if this source and all of higher ratio stay below their caps
    level = (budget * F.col("_sizes_all") - (F.col("_caps") - F.col("_cap"))) / (F.col("_weights_all") - F.col("_weights") + F.col("_w"))
    fits = rising.select("_ratio", level.alias("_level")).where("_level <= _ratio")
    fitting = fits.agg(F.min(F.struct("_ratio", "_level"))["_level"].alias("_level"))
    return rising.withColumn("_level", fitting.scalar()).select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size").reset_index(drop=True)
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = int(target // total) if total else 0
    extra = np.zeros_like(counts)
    some = lengths > 0
    if total:
        extra[some] = choose(lengths[some], counts[some], round(target - passes * total))
    return group.assign(passes=np.int64(passes), extra=extra)


def _seeded(seed: int) -> Column:
    """A number in [0, 1) from the id."""
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _picks(sized: DataFrame, seed: int, shares: dict) -> DataFrame:
    """One row per (doc_id, source, size): how many ``rows`` it stands for, the whole ``passes``
    over them, and how many of them are taken once ``more``."""
    ids = materialize(sized.groupBy("source", "size", "doc_id").agg(F.count("*").alias("rows")))
    counted = ids.groupBy("source", "size").agg(F.sum("rows").alias("n"))
    goal = targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), **shares)
    plan = materialize(
        counted.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .groupBy("source")
        .applyInPandas(
            _plan,
            f"source {dict(sized.dtypes)['source']}, size bigint, n bigint, source_size bigint, target double,"
            " passes bigint, extra bigint",
        )
    )
    p = plan.select(*[F.col(c).alias(f"_{c}") for c in ("source", "size")], "n", "source_size", "target", "passes", "extra")
    drawn = (
        ids.join(p, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
        .drop("_source", "_size")
        .withColumn("_u", _seeded(seed))
        .withColumn("_part", F.floor(F.col("_u") * F.ceil(F.col("n") / RANKED)).cast("bigint"))
    )
    parts = drawn.groupBy("source", "size", "_part").agg(F.sum("rows").alias("_n"), F.first("extra").alias("_extra"))
    lower = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_extra") - F.coalesce(F.sum("_n").over(lower), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in ("source", "size")], F.col("_part").alias("_p"), left.alias("_left"))
    inside = Window.partitionBy("source", "size", "_part").orderBy("_u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(inside), F.lit(0))
    return drawn.join(
        parts,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_part") == F.col("_p")),
    ).select(
        "doc_id", "source", "size", "source_size", "target", "rows", "passes",
        F.greatest(F.lit(0), F.least(F.col("rows"), F.col("_left") - before)).cast("bigint").alias("more"),
    )


def mix(sized: DataFrame, seed: int = 17, **shares: object) -> DataFrame:
    """Per row of ``sized`` (doc_id, source, size): source_size, target, copies and taken words.

    ``taken`` is copies times size. Every run gives the same rows: ids of one source and length
    are ordered by a hash of the id, and of rows that agree in all three columns as many are
    taken once more as the target has room for. An empty document is taken in whole passes only.
    Lengths per source, the rows that one task of the plan sees, are no more than the longest
    document has words; an id of many rows is written out in pieces by many tasks.
    """
    picks = materialize(_picks(sized, seed, shares))

    def listed(df: DataFrame, first: Column) -> DataFrame:
        place = F.explode(F.sequence(first + 1, F.least(F.col("rows"), first + RANKED))).alias("_at")
        copies = F.col("passes") + (F.col("_at") <= F.col("more")).cast("bigint")
        return (
            df.select("*", place)
            .withColumn("copies", copies)
            .withColumn("taken", copies * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
        )

    few, many = picks.where(F.col("rows") <= RANKED), picks.where(F.col("rows") > RANKED)
    pieces = many.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(rows - 1) div {RANKED}"))).alias("_piece"))
    spread = pieces.repartition("doc_id", "source", "size", "_piece")
    return listed(few, F.lit(0).cast("bigint")).unionByName(listed(spread, F.col("_piece") * RANKED))


def apply(docs: DataFrame, seed: int = 17, **shares: object) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it; columns stay.

    Of rows that agree in id, source and size, those with the smallest hash of the text are taken
    once more if not all are. Texts are shuffled once, by id, so that no source or length is met
    by one task; rows that agree are ordered by ranges of that hash.
    """
    sized = materialize(sizes(docs))
    picks = materialize(_picks(sized, seed, shares).where("passes > 0 or more > 0").select("doc_id", "source", "size", "rows", "passes", "more"))
    words = F.size(F.array_remove(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), ""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, "doc_id", "source", words.alias("size")).alias("d")
    c = F.col
    same = c("d.doc_id").eqNullSafe(c("c.doc_id")) & c("d.source").eqNullSafe(c("c.source")) & (c("d.size") == c("c.size"))
    # a hash table of the narrow side, so that no text is sorted
    evenly = d.join(picks.where("more = 0 or more = rows").alias("c").hint("shuffle_hash"), same).select(
        "d.row", (c("passes") + F.least(c("more"), F.lit(1))).alias("copies")
    )
    tied = picks.where("more > 0 and more < rows")
    if not tied.isEmpty():
        found = d.join(tied.alias("c").hint("shuffle_hash"), same).select("d.row", "d.doc_id", "d.source", "d.size", "passes", "more")
        ranked = running_totals(found, ["doc_id", "source", "size"], [F.xxhash64(c("row.text"))], {})
        evenly = evenly.unionByName(ranked.select("row", (c("passes") + (c("rank") <= c("more")).cast("bigint")).alias("copies")))
    repeated = F.explode(F.sequence(F.lit(1), c("copies").cast("int"))).alias("again")
    return evenly.where("copies > 0").select("row", repeated).select("row.*")
