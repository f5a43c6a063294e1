"""Repeatable samples and orders: every draw is an integer hash of ids, so results do not
depend on partitioning. Positions inside a group come from range-partitioned ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.draws import draw
from plumbline.operators.ranking import running_totals


def shuffled_rank(df: DataFrame, keys: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """Add ``rank`` and ``n``: position in a random order within ``keys``."""
    return running_totals(
        df.withColumn("_d", draw(seed, F.col(row_id))), keys, [F.col("_d"), F.col(row_id)], {}
    ).drop("_d")


def stratified_fraction(df: DataFrame, strata: Sequence[str], row_id: str, fraction: float, seed: int = 0) -> DataFrame:
    """Keep a share of every stratum, rounded half to even but at least one row."""
    if fraction >= 1.0:
        return df
    keep = F.greatest(F.lit(1).cast("long"), F.bround(F.col("n") * F.lit(float(fraction))).cast("long"))
    return shuffled_rank(df, strata, row_id, seed).where(F.col("rank") <= keep).select(*df.columns)


def random_split(df: DataFrame, row_id: str, train: float = 0.6, val: float = 0.2, seed: int = 0) -> DataFrame:
    """Add ``split`` from one random permutation; cut points are rounded down."""
    n = F.col("n")
    n_train, n_val = F.floor(n * F.lit(train)), F.floor(n * F.lit(val))
    return shuffled_rank(df, [], row_id, seed).select(
        *df.columns,
        F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test").alias("split"),
    )


def numbered_groups(df: DataFrame, group: str) -> DataFrame:
    """(group, group_no, groups, size), numbered in the order of the group names."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    ranked = running_totals(sizes, [], [F.col(group)], {})
    return ranked.select(
        group, (F.col("rank") - 1).cast("int").alias("group_no"), F.col("n").cast("int").alias("groups"), "size"
    )


def group_balanced_sample(df: DataFrame, group: str, row_id: str, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` rows with replacement: a group at random, then one of its rows at random."""
    spark = df.sparkSession
    groups = numbered_groups(df, group)
    n_groups = groups.agg(F.max("groups")).scalar()
    slots = spark.range(draws).select(
        F.col("id").alias("slot"), (draw(seed, F.col("id")) % n_groups).cast("int").alias("group_no")
    )
    picks = slots.join(groups, "group_no").select(
        "slot", group, (draw(seed + 1, F.col("slot")) % F.col("size") + 1).alias("rank")
    )
    ranked = running_totals(df.select(group, row_id), [group], [F.col(row_id)], {}).select(group, row_id, "rank")
    return picks.join(ranked, [group, "rank"]).select("slot", group, row_id)


def group_cycle_order(df: DataFrame, group: str, row_id: str, seed: int = 0) -> DataFrame:
    """As many positions as rows, going round the groups in turn.

    Each group deals its rows in random order and reshuffles when they run out:
    (position, group, row id). A position follows from cycle and rank, so nothing is
    looked up.
    """
    groups = numbered_groups(df, group)
    total = F.sum("size").over(W.partitionBy(F.lit(1)))
    planned = groups.withColumn("total", total).withColumn(
        "turns", F.ceil((F.col("total") - F.col("group_no")) / F.col("groups"))
    )
    n_cycles = F.ceil(F.col("turns") / F.col("size"))
    # cycles of a group, spread over tasks before its rows join them
    cycles = planned.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n_cycles - 1) / 1024))).alias("chunk")
    )
    cycles = cycles.repartition("chunk", group).select(
        "*",
        F.explode(
            F.sequence(F.col("chunk") * 1024, F.least(F.col("chunk") * 1024 + 1023, n_cycles - 1))
        ).alias("cycle"),
    )
    dealt = cycles.join(df.select(group, row_id), group).withColumn("_d", draw(seed, F.col("cycle"), F.col(row_id)))
    ranked = running_totals(dealt, [group, "cycle"], [F.col("_d"), F.col(row_id)], {})
    turn = F.col("cycle") * F.col("size") + F.col("rank") - 1
    return (
        ranked.withColumn("position", turn * F.col("groups") + F.col("group_no"))
        .where(F.col("position") < F.col("total"))
        .select("position", group, row_id)
    )


def group_coverage(order: DataFrame, group: str, window: int, groups: int, max_windows: int | None = None) -> DataFrame:
    """Share of the full windows of an order that contain every group; of the first ``max_windows`` if given."""
    full = order.agg(F.floor(F.count(F.lit(1)) / window).alias("w")).scalar()
    per_window = (
        order.withColumn("w", F.floor(F.col("position") / window))
        .where((F.col("w") < full) if max_windows is None else (F.col("w") < full) & (F.col("w") < max_windows))
        .groupBy("w")
        .agg(F.countDistinct(group).alias("seen"))
    )
    return per_window.agg(
        F.count(F.lit(1)).alias("windows"),
        (F.count(F.when(F.col("seen") == groups, 1)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("coverage"),
    )
