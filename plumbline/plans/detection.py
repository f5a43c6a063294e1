"""Queries on detections: average precision, matching counts, counting error."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import detection as D
from plumbline.operators import matching as M
from plumbline.plans import tables as T
from plumbline.plans.registry import query, r6
from plumbline.plans.tables import with_tables

_AP_STEPS = """
ranked AS (
  SELECT {keys}, tp,
         sum(tp) OVER (PARTITION BY {keys} ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING) AS c,
         row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, image_id, det_id) AS k
  FROM {flags}),
npos AS (SELECT {box_keys}, count(*) AS n FROM {boxes} GROUP BY ALL),
curve AS (SELECT r.{key1} AS key1, {key2} AS key2, c / n::double AS recall, c / k::double AS prec
          FROM ranked r JOIN npos ON r.{key1} = npos.{key1} WHERE tp = 1),
levels AS (SELECT i * 0.01::double AS t FROM range(101) x(i)),
ap AS (SELECT key1, key2, sum(p) / 101 AS ap FROM (
    SELECT key1, key2, t, max(prec) AS p FROM curve JOIN levels ON recall >= t GROUP BY ALL) GROUP BY ALL)
"""


def ap_sql(keys: str, flags: str = "flags", key1: str = "grp", key2: str = "0", boxes: str = "boxes") -> str:
    return _AP_STEPS.format(keys=keys, flags=flags, key1=key1, key2=key2, box_keys=key1, boxes=boxes)


def positives(boxes, keys):
    return boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("npos"))


def hits_at(spark, sf_dir, thresholds=(0.5,)):
    return M.true_positives(T.detections(spark, sf_dir), T.boxes(spark, sf_dir), thresholds, carry=["grp"])


def ap50_by_group(spark, sf_dir):
    gt = T.boxes(spark, sf_dir)
    return D.average_precision(
        T.detections(spark, sf_dir), hits_at(spark, sf_dir), positives(gt, ["grp"]), ["grp"]
    )


@query(
    "ap50_by_group",
    with_tables("flags", extra=ap_sql("grp"), body="SELECT key1 AS grp, round(ap, 6) AS ap FROM ap"),
)
def _ap50(spark, sf_dir):
    return ap50_by_group(spark, sf_dir).select("grp", r6("ap").alias("ap"))


@query(
    "worst_group_ap50",
    with_tables(
        "flags",
        extra=ap_sql("grp"),
        body="""SELECT round(min(ap), 6) AS worst_ap50, round(avg(ap), 6) AS mean_ap50,
                       round(avg(ap) - min(ap), 6) AS gap_ap50, count(ap) AS n_groups FROM ap""",
    ),
)
def _worst(spark, sf_dir):
    """Flagship: worst group, mean and gap of average precision at IoU 0.5."""
    s = D.group_summary(ap50_by_group(spark, sf_dir))
    return s.select(
        r6("worst").alias("worst_ap50"), r6("mean").alias("mean_ap50"), r6("gap").alias("gap_ap50"),
        F.col("groups").alias("n_groups"),
    )


_FLAG_LEVELS = """
lv AS (SELECT t FROM (VALUES (0.5),(0.55),(0.6),(0.65),(0.7),(0.75),(0.8),(0.85),(0.9),(0.95)) v(t)),
flags10 AS (
  SELECT 1 AS one, t::double AS t, image_id, det_id, score,
         CASE WHEN iou >= t::double AND row_number() OVER (
           PARTITION BY t, image_id, gt_id, iou >= t::double ORDER BY score DESC, det_id) = 1 THEN 1 ELSE 0 END AS tp
  FROM best CROSS JOIN lv),
boxes1 AS (SELECT 1 AS one FROM boxes),
"""


@query(
    "ap_by_iou",
    with_tables(
        "best", "boxes",
        extra=_FLAG_LEVELS + ap_sql("one, t", "flags10", "one", "t", "boxes1"),
        body="SELECT round(key2, 2) AS iou_threshold, round(ap, 6) AS ap FROM ap",
    ),
)
def _ap_by_iou(spark, sf_dir):
    return ap_levels(spark, sf_dir).select(
        F.round("iou_threshold", 2).alias("iou_threshold"), r6("ap").alias("ap")
    )


def ap_levels(spark, sf_dir):
    levels = M.COCO_THRESHOLDS
    return D.average_precision(
        T.detections(spark, sf_dir).withColumn("pool", F.lit("all")),
        hits_at(spark, sf_dir, levels).withColumn("pool", F.lit("all")),
        positives(T.boxes(spark, sf_dir).withColumn("pool", F.lit("all")), ["pool"]),
        ["pool"],
        levels,
    )


@query(
    "ap_range_mean",
    with_tables(
        "best", "boxes",
        extra=_FLAG_LEVELS + ap_sql("one, t", "flags10", "one", "t", "boxes1"),
        body="SELECT round(avg(ap), 6) AS ap_range FROM ap",
    ),
)
def _ap_range(spark, sf_dir):
    return D.threshold_mean_ap(ap_levels(spark, sf_dir), []).select(r6("ap_range").alias("ap_range"))


@query(
    "match_summary",
    with_tables(
        "flags", "boxes",
        body="""
SELECT f.grp, count(*) AS n_det, sum(tp)::bigint AS tp, sum(1 - tp)::bigint AS fp,
       (any_value(n) - sum(tp))::bigint AS fn, round(sum(tp * iou), 6) AS iou_sum
FROM flags f JOIN (SELECT grp, count(*) AS n FROM boxes GROUP BY 1) b ON f.grp = b.grp GROUP BY f.grp""",
    ),
)
def _match_summary(spark, sf_dir):
    return group_counts(spark, sf_dir).select("grp", "n_det", "tp", "fp", "fn", r6("iou_sum").alias("iou_sum"))


def group_counts(spark, sf_dir):
    return D.match_counts(
        T.detections(spark, sf_dir), hits_at(spark, sf_dir), T.boxes(spark, sf_dir), ["grp"]
    )


@query(
    "detection_matches",
    with_tables(
        "flags",
        body="SELECT image_id, det_id, tp, round(CASE WHEN tp = 1 THEN iou ELSE 0 END, 6)::double AS iou FROM flags",
    ),
)
def _matches(spark, sf_dir):
    flagged = M.flag_matches(T.detections(spark, sf_dir), T.boxes(spark, sf_dir))
    return flagged.select("image_id", "det_id", "tp", r6("iou").alias("iou"))


@query(
    "lrp_by_group",
    with_tables(
        "flags", "boxes",
        body="""
SELECT grp, tp, fp, n - tp AS fn, round((loss / 0.5 + fp + n - tp) / (tp + fp + n - tp), 6) AS lrp
FROM (SELECT grp, sum(tp)::bigint AS tp, sum(1 - tp)::bigint AS fp,
             sum(CASE WHEN tp = 1 THEN 1.0 - iou ELSE 0 END)::double AS loss FROM flags GROUP BY 1)
JOIN (SELECT grp, count(*) AS n FROM boxes GROUP BY 1) USING (grp)""",
    ),
)
def _lrp(spark, sf_dir):
    return D.lrp_error(group_counts(spark, sf_dir)).select("grp", "tp", "fp", "fn", r6("lrp").alias("lrp"))


@query(
    "small_object_recall",
    with_tables(
        "pairs", "boxes",
        body="""
SELECT grp, count(*) AS small_boxes, count(best)::bigint AS found,
       round(count(best) / count(*)::double, 6) AS recall_small
FROM boxes b LEFT JOIN (
  SELECT image_id, gt_id, max(iou) AS best FROM pairs WHERE iou >= 0.5 GROUP BY ALL
) p ON p.image_id = b.image_id AND p.gt_id = b.gt_id
WHERE (x2 - x1) * (y2 - y1) < 1024 GROUP BY grp""",
    ),
)
def _small(spark, sf_dir):
    out = D.small_object_recall(T.detections(spark, sf_dir), T.boxes(spark, sf_dir), ["grp"])
    return out.withColumn("recall_small", r6("recall_small"))


@query(
    "count_error",
    with_tables(
        "all_images", "dets", "boxes",
        body="""
SELECT grp, count(*) AS images, round(avg(abs(p - g)), 6) AS count_mae, round(corr(p, g), 6) AS count_corr
FROM (SELECT a.grp, coalesce(p, 0)::double AS p, coalesce(g, 0)::double AS g
      FROM all_images a
      LEFT JOIN (SELECT image_id, count(*) AS p FROM dets WHERE score >= 0.3 GROUP BY 1) USING (image_id)
      LEFT JOIN (SELECT image_id, count(*) AS g FROM boxes GROUP BY 1) USING (image_id))
GROUP BY grp""",
    ),
)
def _count_error(spark, sf_dir):
    out = D.count_error(
        T.all_images(spark, sf_dir), T.detections(spark, sf_dir), T.boxes(spark, sf_dir), ["grp"]
    )
    return out.select("grp", "images", r6("count_mae").alias("count_mae"), r6("count_corr").alias("count_corr"))
