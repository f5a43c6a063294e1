"""Queries on boxes and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import scores as S
from plumbline.operators import matching as M
from plumbline.operators import suppression as P
from plumbline.plans import tables as T
from plumbline.plans.registry import query, r6
from plumbline.plans.tables import with_tables

_SIZED = "sized AS (SELECT image_id, (300 + (image_id % 4) * 50)::int AS width, (280 + (image_id % 3) * 100)::int AS height FROM all_images)"


def sized_images(spark, sf_dir):
    return T.all_images(spark, sf_dir).selectExpr(
        "image_id", "int(300 + (image_id % 4) * 50) AS width", "int(280 + (image_id % 3) * 100) AS height"
    )


@query(
    "box_geometry",
    with_tables("dets", extra="""
f AS (SELECT det_id, grp, x1, y1, x2, CASE WHEN det_id % 11 = 0 THEN y1 - 5 ELSE y2 END AS y2 FROM dets),
e AS (SELECT *, greatest(x2, x1 + 1) AS ex, greatest(y2, y1 + 1) AS ey FROM f),
x AS (SELECT *, (x1 + ex) / 2 AS cx, (y1 + ey) / 2 AS cy, (ex - x1) * 0.75 AS hw, (ey - y1) * 0.75 AS hh FROM e),
b AS (SELECT det_id, grp, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS area,
             least(greatest(cx - hw, 0), 400) AS p1, least(greatest(cy - hh, 0), 380) AS q1,
             least(greatest(cx + hw, 0), 400) AS p2, least(greatest(cy + hh, 0), 380) AS q2 FROM x),
w AS (SELECT *, least(greatest(round_even(p1, 0)::bigint, 0), 399) AS a1, least(greatest(round_even(q1, 0)::bigint, 0), 379) AS b1 FROM b)""",
    body="""
SELECT grp, count(*) AS n, round(sum(area), 4) AS area, round(sum(p1 + q1), 4) AS low, round(sum(p2 + q2), 4) AS high,
       sum(least(greatest(round_even(p2, 0)::bigint, a1 + 1), 400) - a1)::bigint AS crop_w,
       sum(least(greatest(round_even(q2, 0)::bigint, b1 + 1), 380) - b1)::bigint AS crop_h
FROM w GROUP BY grp"""),
)
def _geometry(spark, sf_dir):
    """Area, expansion about the centre with clipping, and whole-pixel crop windows; every
    eleventh box is flipped on purpose."""
    dets = T.detections(spark, sf_dir).withColumn("y2", F.expr("CASE WHEN det_id % 11 = 0 THEN y1 - 5 ELSE y2 END"))
    w, h = F.lit(400), F.lit(380)
    box = G.Box.of()
    grown = G.expand(box, 1.5, w, h)
    crop = G.crop_window(grown, w, h)
    flat = dets.select("grp", G.area(box).alias("area"), *grown.columns("g_"), *crop.columns("c_"))
    return flat.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("area"), 4).alias("area"),
        F.round(F.sum(F.col("g_x1") + F.col("g_y1")), 4).alias("low"),
        F.round(F.sum(F.col("g_x2") + F.col("g_y2")), 4).alias("high"),
        F.sum(F.col("c_x2") - F.col("c_x1")).alias("crop_w"),
        F.sum(F.col("c_y2") - F.col("c_y1")).alias("crop_h"),
    )


@query(
    "scaled_boxes",
    with_tables("boxes", extra="""
s AS (SELECT grp, image_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, (900 + image_id % 700)::int AS iw, 800 AS ih FROM boxes),
k AS (SELECT *, CASE WHEN greatest(iw, ih) > 1000 THEN 1000.0::double / greatest(iw, ih) ELSE 1.0 END AS f FROM s)""",
    body="""
SELECT grp, count(*) AS n, round(sum(x1 * f), 4) AS sx1, round(sum(y1 * f), 4) AS sy1,
       round(sum((x1 + w) * f), 4) AS sx2, round(sum((y1 + h) * f), 4) AS sy2 FROM k WHERE w > 0 AND h > 0 GROUP BY grp"""),
)
def _scaled(spark, sf_dir):
    """Corner form from x, y, w, h with the long side of the image held at 1000."""
    src = T.boxes(spark, sf_dir).select(
        "grp", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"),
        F.expr("900 + image_id % 700").alias("iw"),
    ).where("w > 0 AND h > 0")
    scale = G.long_side_scale(F.col("iw"), F.lit(800), 1000)
    box = G.from_xywh(F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), scale)
    return src.select("grp", *box.columns("s")).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(f"s{c}"), 4).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")]
    )


_GRID = _SIZED + """,
axes AS (SELECT image_id, width, height,
           CASE WHEN width <= 200 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, width - 200 + 1, 150), [width - 200]))) END AS xs,
           CASE WHEN height <= 200 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, height - 200 + 1, 150), [height - 200]))) END AS ys
         FROM sized),
grid AS (SELECT image_id, width, height, ((yi - 1) * len(xs) + xi - 1)::int AS tile_id, xs[xi] AS x0, ys[yi] AS y0,
                least(xs[xi] + 200, width) AS x1, least(ys[yi] + 200, height) AS y1, len(xs) * len(ys) AS tiles
         FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS xi FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS yi FROM axes)))
"""


@query(
    "tile_grid",
    with_tables("all_images", extra=_GRID, body="SELECT image_id, tile_id, x0::bigint AS x0, y0::bigint AS y0, x1::bigint AS x1, y1::bigint AS y1 FROM grid"),
)
def _grid(spark, sf_dir):
    return P.tile_grid(sized_images(spark, sf_dir), 200, 0.25)


_TILED = _GRID + """,
moved AS (SELECT d.image_id, d.det_id, d.score,
   least(greatest(d.x1 + x0, 0), width) AS x1, least(greatest(d.y1 + y0, 0), height) AS y1,
   least(greatest(d.x2 + x0, 0), width) AS x2, least(greatest(d.y2 + y0, 0), height) AS y2
  FROM (SELECT * REPLACE (x1 * 0.5 AS x1, y1 * 0.5 AS y1, x2 * 0.5 AS x2, y2 * 0.5 AS y2) FROM dets) d
  JOIN grid g ON g.image_id = d.image_id AND g.tile_id = d.det_id % 4)
"""


def tiled_detections(spark, sf_dir):
    """Detections read as if each lay in one of the first four tiles of its image."""
    half = {c: F.col(c) * 0.5 for c in ("x1", "y1", "x2", "y2")}
    return T.detections(spark, sf_dir).withColumns({**half, "tile_id": F.expr("int(det_id % 4)")}).drop("grp")


@query(
    "tile_shift",
    with_tables("all_images", "dets", extra=_TILED, body="""
SELECT image_id, det_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM moved"""),
)
def _shift(spark, sf_dir):
    images = sized_images(spark, sf_dir)
    moved = P.to_image_coordinates(tiled_detections(spark, sf_dir), (200, 0.25), images)
    return moved.select("image_id", "det_id", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


def nms_sql(source: str, key: str = "image_id", threshold: float = 0.5) -> str:
    return f"""
ordered AS (SELECT {key} AS k, det_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, det_id) AS r FROM {source}),
fold AS (
  SELECT k, r, [{{'d': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.k, o.r, CASE WHEN len(list_filter(f.kept, lambda b:
      greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0)
      / greatest(greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) + greatest(o.x2 - o.x1, 0) * greatest(o.y2 - o.y1, 0)
        - greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0), 1e-9) > {threshold})) > 0
    THEN f.kept ELSE list_append(f.kept, {{'d': o.det_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END
  FROM fold f JOIN ordered o ON o.k = f.k AND o.r = f.r + 1),
survivors AS (SELECT k, unnest(kept).d AS det_id FROM (SELECT k, arg_max(kept, r) AS kept FROM fold GROUP BY k))
"""


@query(
    "nms_per_image",
    with_tables("dets", extra=nms_sql("dets"), recursive=True, body="SELECT k AS image_id, det_id FROM survivors"),
)
def _nms(spark, sf_dir):
    dets = T.detections(spark, sf_dir).drop("grp")
    return P.suppress(dets, ["image_id"], 0.5).select("image_id", "det_id")


@query(
    "nms_per_class",
    with_tables(
        "dets",
        extra="classed AS (SELECT *, image_id || '/' || grp AS ik FROM dets)," + nms_sql("classed", "ik", 0.3),
        recursive=True,
        body="SELECT k AS image_class, det_id FROM survivors",
    ),
)
def _nms_class(spark, sf_dir):
    """Suppression only among detections of the same class of an image."""
    kept = P.suppress(T.detections(spark, sf_dir), ["image_id", "grp"], 0.3)
    return kept.select(F.concat_ws("/", F.col("image_id").cast("string"), "grp").alias("image_class"), "det_id")


@query(
    "nms_across_tiles",
    with_tables("all_images", "dets", extra=_TILED + "," + nms_sql("moved"), recursive=True,
                body="SELECT k AS image_id, det_id FROM survivors"),
)
def _nms_tiles(spark, sf_dir):
    images = sized_images(spark, sf_dir)
    kept = P.fuse_tiles(tiled_detections(spark, sf_dir), (200, 0.25), images, 0.5)
    return kept.select("image_id", "det_id")


_POINTS = """
pts AS (SELECT image_id, det_id, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, (x2 - x1) / 16 AS rx, (y2 - y1) / 16 AS ry,
               score * 8 - 4 AS cls, (det_id % 13) * 0.5 - 1 AS ctr FROM dets),
scored AS (SELECT image_id, det_id, 1 / (1 + exp(-cls)) * (1 / (1 + exp(-ctr))) AS score,
                  px - rx * 8 AS x1, py - ry * 8 AS y1, px + rx * 8 AS x2, py + ry * 8 AS y2 FROM pts),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS pk
                       FROM scored WHERE score >= 0.05) WHERE pk <= 12)
"""


@query(
    "decode_points",
    with_tables("dets", extra=_POINTS + "," + nms_sql("pre"), recursive=True, body="""
SELECT image_id, det_id, round(score, 6) AS score, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM (
  SELECT p.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, p.det_id) AS fk
  FROM pre p JOIN survivors s ON s.k = p.image_id AND s.det_id = p.det_id) WHERE fk <= 3"""),
)
def _decode(spark, sf_dir):
    """Raw points to boxes: quality cut, top 12, suppression, top 3 per image."""
    points = T.detections(spark, sf_dir).selectExpr(
        "image_id", "det_id", "(x1 + x2) / 2 AS px", "(y1 + y2) / 2 AS py", "8D AS stride",
        "(x2 - x1) / 16 AS left", "(y2 - y1) / 16 AS top", "(x2 - x1) / 16 AS right", "(y2 - y1) / 16 AS bottom",
        "score * 8 - 4 AS class_logit", "(det_id % 13) * 0.5D - 1 AS centre_logit",
    )
    out = P.decode_detections(points, max_det=3)
    return out.select("image_id", "det_id", r6("score").alias("score"), r6("x1").alias("x1"), r6("y2").alias("y2"))


@query(
    "failure_images",
    with_tables("best", "boxes", extra="""
cut AS (SELECT *, CASE WHEN iou >= 0.5 AND row_number() OVER (PARTITION BY image_id, gt_id, iou >= 0.5 ORDER BY score DESC, det_id) = 1
        THEN 1 ELSE 0 END AS tp FROM best WHERE score >= 0.3)""", body="""
SELECT image_id, coalesce(d, 0) - coalesce(t, 0) AS fp, coalesce(b, 0) - coalesce(t, 0) AS fn FROM
(SELECT image_id, count(*) AS d, sum(tp)::bigint AS t FROM cut GROUP BY 1)
FULL JOIN (SELECT image_id, count(*) AS b FROM boxes GROUP BY 1) USING (image_id)
ORDER BY fp DESC, image_id DESC LIMIT 20"""),
)
def _failures(spark, sf_dir):
    dets, gt = T.detections(spark, sf_dir).where("score >= 0.3"), T.boxes(spark, sf_dir)
    return P.failure_images(dets, gt, M.true_positives(dets, gt), 20)


@query(
    "failure_images_filled",
    with_tables("best", "boxes", "images", extra="""
cut AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY image_id, gt_id ORDER BY score DESC, det_id) = 1 THEN 1 ELSE 0 END AS tp
        FROM best WHERE score >= 0.5 AND iou >= 0.5)""", body="""
SELECT image_id, (SELECT count(*) FROM best d WHERE d.image_id = i.image_id AND d.score >= 0.5) - coalesce(t, 0) AS fp, coalesce(b, 0) - coalesce(t, 0) AS fn
FROM (SELECT image_id FROM images UNION SELECT image_id FROM boxes UNION SELECT image_id FROM best WHERE score >= 0.5) i
LEFT JOIN (SELECT image_id, sum(tp)::bigint AS t FROM cut GROUP BY 1) USING (image_id)
LEFT JOIN (SELECT image_id, count(*) AS b FROM boxes GROUP BY 1) USING (image_id)
ORDER BY fn DESC, image_id DESC LIMIT 100000"""),
)
def _failures_filled(spark, sf_dir):
    """A list longer than there are failing images: it is filled with the others."""
    dets, gt, images = T.detections(spark, sf_dir).where("score >= 0.5"), T.boxes(spark, sf_dir), T.images(spark, sf_dir)
    return P.failure_images(dets, gt, M.true_positives(dets, gt), 100_000, "fn", images=images)


@query(
    "densest_cap",
    with_tables("dets", body="""
SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS k
                              FROM dets WHERE score >= 0.3) WHERE k <= 5"""),
)
def _cap(spark, sf_dir):
    """At most five boxes per image for an overlay, best scores first."""
    return P.top_per_key(T.detections(spark, sf_dir).where("score >= 0.3"), ["image_id"], 5).select("image_id", "det_id")


@query(
    "logit_hygiene",
    with_tables("dets", body="""
SELECT kind, count(*) AS n, round(sum(z), 4) AS z_sum, round(sum(1 / (1 + exp(-z))), 4) AS p_sum FROM (
  SELECT kind, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN -50 ELSE least(greatest((score - 0.5) * 150, -50), 50) END AS z
  FROM (SELECT score, (det_id % 7)::int AS kind FROM dets)) GROUP BY kind"""),
)
def _hygiene(spark, sf_dir):
    """NaN, both infinities and out-of-range logits brought into range, then to probabilities."""
    raw = F.expr(
        "CASE det_id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') "
        "ELSE (score - 0.5D) * 150 END"
    )
    z = T.detections(spark, sf_dir).select(F.expr("int(det_id % 7)").alias("kind"), S.finite_logit(raw).alias("z"))
    return z.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z_sum"), F.round(F.sum(S.sigmoid(F.col("z"))), 4).alias("p_sum")
    )


@query(
    "first_images",
    with_tables("all_images", body="SELECT image_id, grp FROM all_images ORDER BY image_id LIMIT 100"),
)
def _first(spark, sf_dir):
    return T.all_images(spark, sf_dir).orderBy("image_id").limit(100)


@query(
    "group_filter",
    with_tables("images", body="""
SELECT camera, background, count(*) AS n FROM images WHERE camera IN ('src1', 'src2', 'src3') AND background IN ('en', 'fr') GROUP BY ALL"""),
)
def _filter(spark, sf_dir):
    images = T.images(spark, sf_dir)
    chosen = images.where(F.col("camera").isin("src1", "src2", "src3") & F.col("background").isin("en", "fr"))
    return chosen.groupBy("camera", "background").agg(F.count(F.lit(1)).alias("n"))
