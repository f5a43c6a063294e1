"""Loss reductions over a log of (batch, example, group, loss)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.ranking import running_totals

BLOCK = 256
METHODS = ("erm", "group_balanced", "group_dro", "last_layer_retrain")  # fixed values: accepted names


def group_means(log: DataFrame) -> DataFrame:
    return log.groupBy("batch", "grp").agg(F.avg("loss").alias("mean"), F.count(F.lit(1)).alias("n"))


def reduce_losses(log: DataFrame, method: str, step: float = 0.01, momentum: float = 0.9) -> DataFrame:
    """(batch, loss) under the named reduction; an unknown name raises."""
    if method not in METHODS:
        raise ValueError(f"unknown robust method: {method}")
    if method == "erm":
        return log.groupBy("batch").agg(F.avg("loss").alias("loss"))
    if method == "group_dro":
        return worst_group_loss(group_weights(log, step, momentum))
    # every group present in the batch counts the same
    return group_means(log).groupBy("batch").agg(F.avg("mean").alias("loss"))


def running_group_loss(log: DataFrame, momentum: float = 0.9) -> DataFrame:
    """(batch, grp, mean, ema): moving average of a group's loss over the batches it is in.

    The recurrence is cut into blocks of bounded length. A block is folded on its own and
    receives the average before it from the preceding blocks, as many as can still matter
    at double precision, so no group is walked through by a single task.
    """
    ranked = running_totals(group_means(log).drop("n"), ["grp"], [F.col("batch")], {}).withColumn(
        "block", F.floor((F.col("rank") - 1) / BLOCK)
    )
    m, rest = F.lit(float(momentum)), F.lit(1.0 - momentum)
    rows = ranked.groupBy("grp", "block").agg(
        F.array_sort(F.collect_list(F.struct("rank", "batch", "mean"))).alias("rows")
    )

    def share(r: Column) -> Column:
        return F.when(r["rank"] == 1, r["mean"]).otherwise(r["mean"] * rest)

    local = rows.withColumn("own", F.aggregate("rows", F.lit(0.0), lambda s, r: s * m + share(r)))
    reach = max(1, math.ceil(math.log(1e-18) / (BLOCK * math.log(momentum)))) if 0 < momentum < 1 else 1
    earlier = W.partitionBy("grp").orderBy("block").rowsBetween(-reach, -1)
    carried = local.withColumn(
        "before",
        F.aggregate(F.collect_list("own").over(earlier), F.lit(0.0), lambda s, o: s * F.lit(float(momentum) ** BLOCK) + o),
    )
    start = F.struct(F.col("before").alias("e"), F.slice(F.array(F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("ema"))), 1, 0).alias("out"))

    def walk(s: Column, r: Column) -> Column:
        e = s["e"] * m + share(r)
        return F.struct(e.alias("e"), F.concat(s["out"], F.array(F.struct(r["batch"].alias("batch"), r["mean"].alias("mean"), e.alias("ema")))).alias("out"))

    return carried.select("grp", F.inline(F.aggregate("rows", start, walk, lambda s: s["out"])))


def group_weights(log: DataFrame, step: float = 0.01, momentum: float = 0.9) -> DataFrame:
    """(batch, grp, mean, ema, weight): softmax of step * moving average over the groups seen
    so far. ``mean`` is NULL where the group is not in the batch."""
    ema = running_group_loss(log, momentum)
    names = log.agg(F.array_sort(F.collect_set("grp")).alias("names")).scalar()
    grid = log.select("batch").distinct().withColumn("grp", F.explode(names))
    span = 1024
    known = grid.join(ema, ["batch", "grp"], "left").withColumn("block", F.floor(F.col("batch") / span))
    # last known average: within a block of batches, else from the blocks before it
    inside = W.partitionBy("grp", "block").orderBy("batch")
    blocks = known.groupBy("grp", "block").agg(F.max_by("ema", F.when(F.col("ema").isNotNull(), F.col("batch"))).alias("last"))
    earlier = W.partitionBy("grp").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumn("carry", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    filled = (
        known.withColumn("here", F.last("ema", ignorenulls=True).over(inside))
        .join(carried, ["grp", "block"])
        .select("batch", "grp", "mean", F.coalesce("here", "carry").alias("ema"))
    )
    per_batch = W.partitionBy("batch")  # one row per group
    e = F.exp(F.lit(step) * (F.col("ema") - F.max("ema").over(per_batch)))
    return filled.where("ema IS NOT NULL").withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(per_batch)).drop("e")


def worst_group_loss(weights: DataFrame) -> DataFrame:
    return weights.groupBy("batch").agg(F.sum(F.col("weight") * F.col("mean")).alias("loss"))
