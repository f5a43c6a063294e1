"""Running totals and order statistics without a single-task sort.

A window without a bounded partition would pull a whole group into one task. Here the
rows are range partitioned on (keys, order), written once with the number of the range
they fell into, summed inside each range, and shifted by the totals of the ranges
before it. Hot keys and long ties are cut by the range boundaries like anything else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import materialize, release

_PART = "_range"
#: Rows that one range is meant to hold.
RANGE_ROWS = 500_000


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], rows_per_range: int = RANGE_ROWS,
    written: bool = False, part: str | None = None,
) -> DataFrame:
    """Add ``rank`` (1-based), ``n`` (rows of the key) and one running total per entry of
    ``sums`` (plus its final value as ``<name>_all``), all within ``keys`` in ``order``.

    ``order`` must be total; add a unique column as the last tie breaker. ``df`` must not
    have columns named ``rank`` or ``n``. There are as many ranges as hold ``rows_per_range``
    rows each, so a task's share does not grow with the table.

    ``written`` says that ``df`` is cheap to read three times, so that it is not written again. ``part``
    names a column for the number of the range; all rows of a key and range are then in one partition.
    """
    keys = list(keys)
    names = list(sums)
    valued = df.select("*", *[expr.alias(f"_v_{name}") for name, expr in sums.items()])
    # written once, so that sampling for the ranges does not work the input out again
    narrow = valued if written else materialize(valued)
    ranges = max(1, -(-narrow.count() // rows_per_range))
    ranged = materialize(
        narrow.repartitionByRange(ranges, *[F.col(k) for k in keys], *order).withColumn(_PART, F.spark_partition_id())
    )
    if not written:
        release(narrow)
    # one row per (key, range): at most #keys + #ranges rows
    parts = ranged.groupBy(*keys, _PART).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{c}").alias(f"_s_{c}") for c in names]
    )
    before = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    zero = F.lit(0)
    offsets = parts.select(
        *keys,
        _PART,
        F.coalesce(F.sum("_n").over(before), zero).alias("_o_n"),
        F.sum("_n").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), zero).alias(f"_o_{c}") for c in names],
        *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_all") for c in names],
    )
    if part:
        offsets = materialize(offsets)  # its size is known, so the rows are not dealt out for the join
    inside = W.partitionBy(*keys, _PART).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    # as many partitions as ranges: the session's number would let a task's share grow with the table
    local = ranged.repartition(ranges, *keys, _PART).select(
        "*",
        F.row_number().over(inside).alias("_rank"),
        *[F.sum(f"_v_{c}").over(upto).alias(f"_r_{c}") for c in names],
    )
    on = F.col(f"l.{_PART}") == F.col(f"o.{_PART}")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    return (
        local.alias("l")
        .join(offsets.alias("o"), on)
        .select(
            *[F.col(f"l.{c}") for c in df.columns],
            (F.col("_rank") + F.col("_o_n")).alias("rank"),
            F.col("o.n"),
            *[(F.col(f"_r_{c}") + F.col(f"_o_{c}")).alias(c) for c in names],
            *[F.col(f"{c}_all") for c in names],
            *([F.col(f"l.{_PART}").alias(part)] if part else []),
        )
    )


#: Parts into which the values of a key are cut to find a position.
BUCKETS = 4096


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition on ``keys`` of two aliased frames; nulls are equal, no keys join everything."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def around_positions(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column],
    points: Callable[[Column], Column], descending: bool = False,
) -> DataFrame:
    """The few rows among which wanted positions lie, with the totals of all rows before them.

    The values of a key are cut into ``BUCKETS`` parts of equal width, which only takes sums per part;
    rows of parts without a wanted position are left out. ``points`` makes an array of structs
    with a 1-based long ``_at`` from the number of rows. ``sums`` must have ``rows``, the rows that a row stands for.
    Adds the part ``_b``, ``_n`` (rows of the key), ``_points`` (those in the part) and
    ``_before_<name>``. Parts come in the order of the value, nulls and NaN where Spark sorts
    them. ``df`` is read three times.
    """
    keys, x = list(keys), F.col(value).cast("double")
    finite = F.abs(x) < float("inf")  # false for NaN
    ends = materialize(df.groupBy(*keys).agg(
        (F.min(F.when(finite, x)) / 2).alias("_low"), (F.max(F.when(finite, x)) / 2).alias("_high")
    ))
    share = (x / 2 - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    part = (
        F.when(x.isNull(), -2).when(F.isnan(x), BUCKETS + 2)
        .when(x == float("inf"), BUCKETS + 1).when(x == float("-inf"), -1)
        .otherwise(F.coalesce(F.floor(share * BUCKETS), F.lit(0))).cast("int")
    )
    numbered = df.alias("d").join(ends.alias("e"), same_keys("d", "e", keys)).select("d.*", part.alias("_b"))
    parts = materialize(numbered.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()]))
    order = F.col("_b").desc() if descending else F.col("_b").asc()
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = parts.select(
        *keys, "_b", "_s_rows", F.sum("_s_rows").over(W.partitionBy(*keys)).alias("_n"),
        *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )
    here = F.filter(points(F.col("_n")), lambda p: (p["_at"] > F.col("_before_rows")) & (p["_at"] <= F.col("_before_rows") + F.col("_s_rows")))
    wanted = materialize(placed.withColumn("_points", here).where(F.size("_points") > 0).drop("_s_rows"))
    given = ["_n", "_points", *[f"_before_{name}" for name in sums]]
    return numbered.alias("l").join(wanted.alias("r"), same_keys("l", "r", [*keys, "_b"])).select("l.*", *[f"r.{c}" for c in given])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key and ``prob``.

    Only rows near a wanted position are reduced to (key, value, count) and ranked. Column
    ``quantile`` holds the result; keys without a value give no row. With ``weight`` the
    rows already are (key, value, count).
    """
    keys = list(keys)
    rows = F.col(weight) if weight else F.lit(1).cast("long")
    # written once, so that the input is not worked out again for every pass
    narrow = materialize(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), rows.alias("_c")))

    def both_sides(n: Column) -> Column:
        """0-based positions below and above each quantile, as 1-based rows."""
        at = [(p, F.lit(float(p)) * (n - 1)) for p in probs]
        return F.array(*[
            F.struct(F.lit(float(p)).alias("prob"), pos.alias("pos"), F.lit(high).alias("high"),
                     ((F.ceil(pos) if high else F.floor(pos)) + 1).cast("long").alias("_at"))
            for p, pos in at for high in (False, True)
        ])

    near = around_positions(narrow, keys, "_v", {"rows": F.col("_c")}, both_sides)
    counted = near.groupBy(*keys, "_b", "_v").agg(
        F.sum("_c").alias("_c"), F.first("_points").alias("_points"), F.first("_before_rows").alias("_before")
    )
    cum = running_totals(counted, [*keys, "_b"], [F.col("_v")], {"_cum": F.col("_c")})
    upto = F.col("_before") + F.col("_cum")
    wanted = cum.select(
        *keys, F.col("_v").cast("double").alias("_x"), upto.alias("_to"), (upto - F.col("_c")).alias("_from"), F.inline("_points")
    ).where((F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_to")))
    picked = wanted.groupBy(*keys, "prob").agg(
        F.max("pos").alias("_pos"),
        F.max(F.when(~F.col("high"), F.col("_x"))).alias("_lo"),
        F.max(F.when(F.col("high"), F.col("_x"))).alias("_hi"),
    )
    share = F.col("_pos") - F.floor("_pos")
    return picked.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("quantile"))
