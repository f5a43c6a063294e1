"""Run reports: flattening, seeds, variants, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

NUMERIC = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")


def flatten_json(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, metric, value): every number of a nested JSON object under its dotted path, however deep.

    Booleans, strings, lists and nulls drop out, and so do the bare NaN and Infinity that some
    writers emit. A row that is no JSON gives nothing; ``broken_json`` finds such rows. Levels
    are followed until no object is left; each is a smaller table than the one before.
    """
    spark = df.sparkSession
    keys = list(keys)
    listed = "".join(f"t.{k}, " for k in keys)
    level = df.select(*keys, F.lit("").alias("path"), _parsed(column).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        fields = spark.sql(
            f"SELECT {listed} concat(t.path, e.key) AS metric, e.value AS v, schema_of_variant(e.value) AS kind "
            "FROM {level} t, LATERAL variant_explode(t.v) e WHERE e.key IS NOT NULL",
            level=level,
        )
        kind = F.regexp_extract("kind", "^[A-Z]+", 0)
        numbers = fields.where(kind.isin(*NUMERIC)).select(
            *keys, "metric", F.variant_get("v", "$", "double").alias("value")
        )
        found = numbers if found is None else found.unionByName(numbers)
        level = materialize(
            fields.where(kind == "OBJECT").select(
                *keys, F.concat("metric", F.lit(".")).alias("path"), F.to_json("v").alias("v")
            )
        ).withColumn("v", F.parse_json("v"))
        if level.isEmpty():
            return found


def _parsed(column: str) -> Column:
    clean = F.regexp_replace(F.col(column), r"([:\[,]\s*)(?:NaN|[+-]?Infinity)(?=\s*[,\]}])", "$1null")
    return F.try_parse_json(clean)


def broken_json(df: DataFrame, column: str) -> DataFrame:
    """Rows with a text in ``column`` that is no JSON."""
    return df.where(F.col(column).isNotNull() & _parsed(column).isNull())


def aggregate_seeds(flat: DataFrame, keys: Sequence[str] = (), metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean, population deviation and number of runs per metric; undefined values are skipped."""
    good = flat.where(F.col(value).isNotNull() & ~F.isnan(value))
    return good.groupBy(*keys, metric).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n")
    )


def variant_table(rows: DataFrame, variant: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, deviation and n of every metric column per variant over repeated runs."""
    long = rows.select(
        variant,
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])),
    )
    return aggregate_seeds(long, [variant])


def metric_by_fraction(rows: DataFrame, variant: str, fraction: str, value: str, fractions: Sequence[float]) -> DataFrame:
    """One row per variant, one column per fraction."""
    return rows.groupBy(variant).pivot(fraction, list(fractions)).agg(F.avg(value))


def reducer_table(reports: DataFrame, method: str, seed: str, value: str, collapsed: str) -> DataFrame:
    """Per method: runs, mean and population deviation, collapses, values in seed order.

    A missing value counts as 0 and a missing flag as not collapsed.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    c = F.coalesce(F.col(collapsed), F.lit(False))
    return reports.groupBy(method).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.count(F.when(c, 1)).alias("collapsed_runs"),
        F.array_sort(F.collect_list(F.struct(F.col(seed).alias("seed"), v.alias("value"), c.alias("collapsed")))).alias("per_seed"),
    )


def fold_summary(folds: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, worst and largest gap over folds; undefined folds are skipped."""
    return folds.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("worst"), (F.max(value) - F.min(value)).alias("max_gap"), F.count(value).alias("folds")
    )


def cross_fold_pairs(folds: DataFrame, fold: str, value: str) -> DataFrame:
    """Every ordered pair of folds with both values and their difference.

    The folds (cameras, backgrounds) are a short list that travels as one array.
    """
    listed = folds.agg(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), F.col(value).alias("v")))).alias("a"))
    pairs = listed.select(F.explode("a").alias("s"), "a").select("s", F.explode("a").alias("t")).where("s.f <> t.f")
    return pairs.select(
        F.col("s.f").alias("source"), F.col("t.f").alias("target"),
        F.col("s.v").alias("source_value"), F.col("t.v").alias("target_value"),
        (F.col("s.v") - F.col("t.v")).alias("gap"),
    )


def mean_over_runs(rows: DataFrame, group: str, counts: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over runs per group; counts are cut to whole numbers."""
    return rows.groupBy(group).agg(
        *[F.floor(F.avg(c)).alias(c) for c in counts], *[F.avg(v).alias(v) for v in values]
    )
