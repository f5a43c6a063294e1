"""Session settings and tables written between two passes over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on.

    Joins whose probe side has a hot key are split by the adaptive skew join, also
    where that costs one more shuffle afterwards.
    """
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor sees.

    The cluster's checkpoint folder (setting or ``setCheckpointDir``), else a folder in
    the warehouse. Relative and scheme-less names are left to Hadoop's default file system.
    """
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/.scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """New path in the shared folder that goes away with the application."""
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives lost executors, and freezes values that would change
    if the plan ran twice (partition ids).
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the tables behind ``materialize`` once their last reader is done.

    Only folders made by ``scratch_path`` are touched; other frames are left alone.
    """
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/plumbline-" in folder:
                target = jvm.org.apache.hadoop.fs.Path(folder)
                target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
