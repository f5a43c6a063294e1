"""Detection, candidate and report tables derived from the given parquet files.

Every table is built twice from the same integer arithmetic: as a DataFrame and as SQL
text for ``WITH`` clauses. ``%`` is only applied to non-negative values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import matching


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read(spark, sf_dir, "lineitem")
    return lineitem.selectExpr(
        "l_orderkey AS image_id",
        "l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber AS rid",
        "l_returnflag AS grp",
        "l_linestatus AS st",
        "l_suppkey AS sk",
        "l_linenumber AS ln",
        "(l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 10007 AS u",
        "(l_partkey * 37) % 400 AS bx1",
        "(l_partkey * 53) % 400 AS by1",
        "(l_partkey * 37) % 400 + 20 + CAST(l_quantity AS BIGINT) AS bx2",
        "(l_partkey * 53) % 400 + 20 + l_partkey % 30 AS by2",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _rows(spark, sf_dir)
        .where("st = 'F'")
        .selectExpr(
            "image_id", "rid AS gt_id", "grp",
            "double(bx1) AS x1", "double(by1) AS y1", "double(bx2) AS x2", "double(by2) AS y2",
        )
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    first = rows.where("sk % 10 <> 0").selectExpr(
        "image_id", "rid AS det_id", "grp",
        "(7 * u + CASE WHEN st = 'F' THEN 30021 ELSE 0 END) / 100070D AS score",
        "double(bx1 + sk % 13 - 6) AS x1", "double(by1 + sk % 11 - 5) AS y1",
        "double(bx2 + sk % 13 - 6) AS x2", "double(by2 + sk % 11 - 5) AS y2",
    )
    second = rows.where("ln <= 2").selectExpr(
        "image_id", "rid + 100000000000000 AS det_id", "grp",
        "(6 * u + CASE WHEN st = 'F' THEN 20014 ELSE 0 END) / 100070D AS score",
        "double(bx1 + 4) AS x1", "double(by1 + 3) AS y1", "double(bx2 + 4) AS x2", "double(by2 + 3) AS y2",
    )
    return first.unionByName(second)


def all_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("image_id"))
        .agg(F.min("l_returnflag").alias("grp"))
    )


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_overlap(detections(spark, sf_dir), boxes(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score row per detection; ``run`` splits the images into three runs."""
    return (
        matching.label_candidates(best(spark, sf_dir))
        .withColumn("p_det", F.col("score"))
        .withColumn("p_ver", F.expr("((det_id % 10007) * 31 + 17) % 10007 / 10007D"))
        .withColumn("fused", (F.col("p_det") + F.col("p_ver")) / 2)
        .withColumn("run", F.expr("concat('r', image_id % 3)"))
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text corpus in the role of the image corpus."""
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS image_id",
        "source AS camera",
        "lang AS background",
        "text AS content",
        "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split",
    )


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id DIV 8 AS batch", "event_id AS example", "event_type AS grp", "value AS loss"
    )


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report row per (variant, seed) with two metrics."""
    events = read(spark, sf_dir, "events")
    return events.groupBy(
        F.col("event_type").alias("variant"), (F.col("user_id") % 7).alias("seed")
    ).agg(F.round(F.avg("value"), 8).alias("score"), F.count(F.lit(1)).alias("n_rows"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "transform(embedding, x -> double(x)) AS vec", "label",
        "CASE WHEN label < 5 THEN 1 ELSE 0 END AS positive",
    )


_SRC = """
    SELECT l_orderkey AS image_id,
           l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber AS rid,
           l_returnflag AS grp, l_linestatus AS st, l_suppkey AS sk, l_linenumber AS ln,
           (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 10007 AS u,
           (l_partkey * 37) % 400 AS bx1, (l_partkey * 53) % 400 AS by1,
           (l_partkey * 37) % 400 + 20 + CAST(l_quantity AS BIGINT) AS bx2,
           (l_partkey * 53) % 400 + 20 + l_partkey % 30 AS by2
    FROM lineitem"""

_IOU = """
    greatest(least(d.x2, b.x2) - greatest(d.x1, b.x1), 0) * greatest(least(d.y2, b.y2) - greatest(d.y1, b.y1), 0)"""

# name -> (tables it needs, text)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "src": ((), _SRC),
    "boxes": (
        ("src",),
        """
    SELECT image_id, rid AS gt_id, grp, bx1::double AS x1, by1::double AS y1,
           bx2::double AS x2, by2::double AS y2
    FROM src WHERE st = 'F'""",
    ),
    "dets": (
        ("src",),
        """
    SELECT image_id, rid AS det_id, grp,
           (7 * u + CASE WHEN st = 'F' THEN 30021 ELSE 0 END) / 100070.0::double AS score,
           (bx1 + sk % 13 - 6)::double AS x1, (by1 + sk % 11 - 5)::double AS y1,
           (bx2 + sk % 13 - 6)::double AS x2, (by2 + sk % 11 - 5)::double AS y2
    FROM src WHERE sk % 10 <> 0
    UNION ALL
    SELECT image_id, rid + 100000000000000, grp,
           (6 * u + CASE WHEN st = 'F' THEN 20014 ELSE 0 END) / 100070.0::double,
           (bx1 + 4)::double, (by1 + 3)::double, (bx2 + 4)::double, (by2 + 3)::double
    FROM src WHERE ln <= 2""",
    ),
    "pairs": (
        ("boxes", "dets"),
        f"""
    SELECT image_id, det_id, gt_id,
           inter / greatest(da + ba - inter, 1e-9) AS iou
    FROM (SELECT d.image_id, d.det_id, b.gt_id, {_IOU} AS inter,
                 (d.x2 - d.x1) * (d.y2 - d.y1) AS da, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba
          FROM dets d JOIN boxes b ON d.image_id = b.image_id) q
    WHERE inter > 0""",
    ),
    "best": (
        ("pairs", "dets"),
        """
    SELECT d.*, p.gt_id, coalesce(p.iou, 0.0)::double AS iou
    FROM dets d LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, gt_id) AS k FROM pairs
    ) p ON p.image_id = d.image_id AND p.det_id = d.det_id AND p.k = 1""",
    ),
    "flags": (
        ("best",),
        """
    SELECT *, CASE WHEN iou >= 0.5 AND row_number() OVER (
        PARTITION BY image_id, gt_id, iou >= 0.5 ORDER BY score DESC, det_id) = 1
      THEN 1 ELSE 0 END AS tp
    FROM best""",
    ),
    "cands": (
        ("best",),
        """
    SELECT *, (p_det + p_ver) / 2 AS fused FROM (
      SELECT image_id, det_id, grp, score, x1, y1, x2, y2, gt_id, iou,
             CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END AS label, score AS p_det,
             (((det_id % 10007) * 31 + 17) % 10007) / 10007.0::double AS p_ver,
             'r' || (image_id % 3) AS run
      FROM best)""",
    ),
    "all_images": ((), "\n    SELECT l_orderkey AS image_id, min(l_returnflag) AS grp FROM lineitem GROUP BY 1"),
    "images": (
        (),
        """
    SELECT doc_id AS image_id, source AS camera, lang AS background, text AS content,
           CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split
    FROM documents""",
    ),
    "losses": (
        (),
        "\n    SELECT event_id // 8 AS batch, event_id AS example, event_type AS grp, value AS loss FROM events",
    ),
    "reports": (
        (),
        """
    SELECT event_type AS variant, user_id % 7 AS seed, round(avg(value), 8) AS score, count(*) AS n_rows
    FROM events GROUP BY 1, 2""",
    ),
    "vecs": (
        (),
        """
    SELECT vec_id, embedding::double[] AS vec, label, CASE WHEN label < 5 THEN 1 ELSE 0 END AS positive
    FROM embeddings""",
    ),
}


def with_tables(*names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """SQL text: the named tables (and what they need) as CTEs in front of ``body``."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in _CTES[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS MATERIALIZED ({_CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra.strip().rstrip(","))
    word = "WITH RECURSIVE " if recursive else "WITH "
    return word + ",\n".join(parts) + "\n" + body.strip()
