"""Whole reports and stored tables as queries."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.plans import composite as K
from plumbline.plans import tables as T
from plumbline.plans.audit import _FINGERPRINTS, _HASHED
from plumbline.plans.calibration import _JS, bins_sql, cands, ece_sql, stored_cands
from plumbline.plans.comparison import diffs
from plumbline.plans.detection import _FLAG_LEVELS, ap_sql
from plumbline.plans.registry import ORACLES, query, r6
from plumbline.plans.tables import with_tables
from plumbline.session import materialize, scratch_path
from plumbline.sources import annotations as N
from plumbline.sources import corpus as P
from plumbline.sources import dumps as U

_AP_RENAMED = (
    ap_sql("one, t", "flags10", "one", "t", "boxes1")
    .replace("ranked", "ranked10").replace("npos", "npos10").replace("curve", "curve10").replace("levels", "levels10").replace("ap AS", "ap10 AS")
)


@query(
    "detection_report",
    with_tables("flags", "boxes", "all_images", "pairs", extra=_FLAG_LEVELS + _AP_RENAMED + "," + ap_sql("grp") + "," + bins_sql(), body=f"""
SELECT (SELECT round(ap, 6) FROM ap10 WHERE round(key2, 2) = 0.5) AS ap50, (SELECT round(ap, 6) FROM ap10 WHERE round(key2, 2) = 0.75) AS ap75,
       (SELECT round(avg(ap), 6) FROM ap10) AS ap_range,
       (SELECT round(count(m) / count(*)::double, 6) FROM boxes b LEFT JOIN
          (SELECT image_id, gt_id, max(iou) AS m FROM pairs WHERE iou >= 0.5 GROUP BY ALL) p ON p.image_id = b.image_id AND p.gt_id = b.gt_id
        WHERE (x2 - x1) * (y2 - y1) < 1024) AS recall_small,
       (SELECT round((l / 0.5 + f + n - t) / (t + f + n - t), 6) FROM (SELECT sum(tp) AS t, sum(1 - tp) AS f, sum(tp * (1 - iou)) AS l FROM flags),
          (SELECT count(*) AS n FROM boxes)) AS lrp50,
       (SELECT round(laece, 6) FROM ({ece_sql("1 AS one", conf="score", source="(SELECT score, tp AS label, iou FROM flags)").replace("SELECT 1 AS one, sum(abs", "SELECT one, sum(abs")})) AS laece,
       (SELECT round(avg(abs(p - g)), 6) FROM cnt) AS count_mae, (SELECT round(corr(p, g), 6) FROM cnt) AS count_corr,
       (SELECT round(min(ap), 6) FROM ap) AS worst_group_ap50, (SELECT round(avg(ap), 6) FROM ap) AS mean_ap50
FROM (SELECT 1)""".replace("FROM (SELECT 1)", "FROM (SELECT 1) z")).replace("SELECT (SELECT round(ap, 6) FROM ap10", """, cnt AS (
  SELECT coalesce(p, 0)::double AS p, coalesce(g, 0)::double AS g FROM all_images
  LEFT JOIN (SELECT image_id, count(*) AS p FROM dets WHERE score >= 0.3 GROUP BY 1) USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS g FROM boxes GROUP BY 1) USING (image_id))
SELECT (SELECT round(ap, 6) FROM ap10""", 1),
)
def _detection(spark, sf_dir):
    out = K.detection_report(T.all_images(spark, sf_dir), T.detections(spark, sf_dir), T.boxes(spark, sf_dir))
    return out.select(
        *[r6(c).alias(c) for c in (
            "ap50", "ap75", "ap_range", "recall_small", "lrp50", "laece", "count_mae", "count_corr", "worst_group_ap50", "mean_ap50",
        )]
    )


_SELECTIVE = _JS.replace("(SELECT max(dis) FROM js)", "max(dis) OVER (PARTITION BY run)") + """,
ranked AS (SELECT run, correct, sum(1 - correct) OVER w AS errors, row_number() OVER w AS k, count(*) OVER (PARTITION BY run) AS n
           FROM conf WINDOW w AS (PARTITION BY run ORDER BY confidence DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT run, confidence AS c, sum(1 - correct)::double AS bad, sum(correct)::double AS good FROM conf GROUP BY ALL),
cu AS (SELECT *, sum(bad) OVER w AS b, sum(good) OVER w AS g, sum(bad) OVER (PARTITION BY run) AS ba,
              sum(good) OVER (PARTITION BY run) AS ga FROM lv WINDOW w AS (PARTITION BY run ORDER BY c)),
sel AS (SELECT * FROM (SELECT run, count(*) AS rows, round(avg(correct), 6) AS accuracy, round(avg(errors / k), 6) AS aurc,
                              round(max(errors / k) FILTER (k = greatest(1, round_even(n * 0.9::double, 0)::bigint)), 6) AS risk_90 FROM ranked GROUP BY run)
        JOIN (SELECT run, round(sum(bad * (ga - g + good / 2)) / any_value(ba * ga), 6) AS auroc,
                     round(sum(bad * b / (b + g)) / any_value(ba), 6) AS auprc FROM cu GROUP BY run) USING (run))
"""


def with_disagreement(spark, sf_dir):
    return stored_cands(spark, sf_dir).withColumn("disagreement", S.js_divergence(F.col("p_det"), F.col("p_ver")))


@query("selective_report", with_tables("cands", extra=_SELECTIVE, body="SELECT * FROM sel"))
def _selective(spark, sf_dir):
    out = K.selective_report(with_disagreement(spark, sf_dir), ["run"])
    return out.select(
        "run", "rows", *[r6(c).alias(c) for c in ("accuracy", "aurc", "auroc", "auprc")], r6(F.element_at("risk", F.lit(0.9))).alias("risk_90")
    )


@query(
    "clean_vs_shifted",
    with_tables("cands", extra=_SELECTIVE + "," + bins_sql(), body=f"""
SELECT run AS variant, rows AS n, round(ece, 6) AS ece, accuracy, aurc, auroc FROM sel JOIN ({ece_sql("run", source="cands")}) USING (run)"""),
)
def _variants(spark, sf_dir):
    """Calibration and selective figures per variant of the same score table."""
    df = with_disagreement(spark, sf_dir).withColumnRenamed("run", "variant")
    out = K.clean_and_shifted(df, "variant", "grp")
    return out.select("variant", "n", *[r6(c).alias(c) for c in ("ece", "accuracy", "aurc", "auroc")])


_SHIFTED = """
noisy AS (SELECT * REPLACE ('noise' AS run, least(greatest(p_det + ((det_id % 101) - 50) / 250.0::double, 0.0), 1.0)::double AS p_det) FROM cands),
blurred AS (SELECT * REPLACE ('blur' AS run, p_det * 0.5::double + 0.25::double AS p_det) FROM cands),
variants AS (SELECT image_id, det_id, grp, iou, label, run, p_det, p_ver, (p_det + p_ver) / 2 AS fused FROM (
  SELECT * REPLACE ('clean' AS run) FROM cands UNION ALL SELECT * FROM noisy UNION ALL SELECT * FROM blurred)),
"""


@query(
    "under_shift",
    with_tables("cands", extra=_SHIFTED + _SELECTIVE.replace("FROM cands", "FROM variants") + "," + bins_sql(), body=f"""
SELECT run AS variant, rows AS n, round(ece, 6) AS ece, accuracy, aurc, auroc FROM sel JOIN ({ece_sql("run", source="variants")}) USING (run)"""),
)
def _under_shift(spark, sf_dir):
    """Calibration and selective figures of the same candidates, clean and under two shifts of the detector's score."""
    noisy = F.least(F.greatest(F.col("p_det") + (F.col("det_id") % 101 - 50) / F.lit(250.0), F.lit(0.0)), F.lit(1.0))
    blurred = F.col("p_det") * 0.5 + 0.25
    shifts = {name: {"p_det": p, "fused": (p + F.col("p_ver")) / 2} for name, p in (("noise", noisy), ("blur", blurred))}
    # clean first, so that the disagreement is the one of the shifted scores
    df = K.under_shift(cands(spark, sf_dir).drop("x1", "y1", "x2", "y2", "gt_id"), shifts)
    df = materialize(df.withColumn("disagreement", S.js_divergence(F.col("p_det"), F.col("p_ver"))))
    out = K.clean_and_shifted(df, "variant", "grp")
    return out.select("variant", "n", *[r6(c).alias(c) for c in ("ece", "accuracy", "aurc", "auroc")])


@query(
    "corpus_audit",
    with_tables("images", "boxes", extra=_HASHED + "," + _FINGERPRINTS.format(k=6) + """,
inside AS (SELECT b.* FROM boxes b JOIN images USING (image_id))""", body="""
SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM inside) AS boxes,
       (SELECT count(DISTINCT camera || '/' || background) FROM images) AS groups,
       (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY digest) AS c FROM hashed) WHERE c > 1) AS exact_copies,
       (SELECT count(*) FROM near) AS near_pairs,
       (SELECT quantile_cont(x2 - x1, 0.5) FROM inside) AS median_w, (SELECT quantile_cont(y2 - y1, 0.5) FROM inside) AS median_h,
       (SELECT quantile_cont(x2 - x1, 0.5) < 8 OR quantile_cont(y2 - y1, 0.5) < 8 FROM inside) AS finer_level"""),
)
def _audit(spark, sf_dir):
    parts = K.corpus_audit(T.images(spark, sf_dir), T.boxes(spark, sf_dir))
    one = F.count(F.lit(1))
    stats = parts["box_statistics"].where("measure = 'width' AND grp = 'pooled'").select("n")
    return parts["advice"].select(
        parts["group_distribution"].agg(F.sum("images")).scalar().alias("images"),
        stats.scalar().alias("boxes"),
        parts["group_distribution"].agg(one).scalar().alias("groups"),
        parts["exact_copies"].agg(one).scalar().alias("exact_copies"),
        parts["near_copies"].agg(one).scalar().alias("near_pairs"),
        "median_w", "median_h", "finer_level",
    )


def word_buckets(texts: pd.Series) -> np.ndarray:
    """An embedding that needs no model: signed counts of words in 64 buckets of their hash."""
    out = np.zeros((len(texts), 64))
    for row, text in zip(out, texts, strict=True):
        for word, count in Counter((text or "").split(" ")).items():
            if word:
                h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                row[h % 64] += count if h >> 6 & 1 else -count
    return out


@query(
    "audit_by_embedding",
    with_tables("images", extra="""
words AS (SELECT image_id, ('0x' || substr(md5(w), 1, 8))::bigint AS h
          FROM (SELECT image_id, unnest(string_split(content, ' ')) AS w FROM images) WHERE w <> ''),
buckets AS (SELECT image_id, h % 64 AS b, sum(CASE WHEN (h >> 6) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM words GROUP BY ALL),
filled AS (SELECT image_id, list(coalesce(v, 0)::double ORDER BY b) AS vec
           FROM (SELECT image_id, i::bigint AS b FROM images CROSS JOIN range(64) x(i)) LEFT JOIN buckets USING (image_id, b) GROUP BY 1),
reps AS (SELECT vec, min(image_id) AS id, count(*) AS n FROM filled GROUP BY 1),
unit AS (SELECT id, n, list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-9)) AS v FROM reps)""", body="""
SELECT a.id AS id_a, b.id AS id_b, round(list_inner_product(a.v, b.v), 6) AS cosine, a.n AS n_a, b.n AS n_b, a.n * b.n AS id_pairs
FROM unit a JOIN unit b ON a.id < b.id WHERE list_inner_product(a.v, b.v) >= 0.98
UNION ALL SELECT id, id, 1.0::double, n, n, n * (n - 1) // 2 FROM reps WHERE n > 1 AND list_inner_product(vec, vec) > 0"""),
)
def _audit_by_embedding(spark, sf_dir):
    """Near copies that the audit finds with an embedding given by the caller."""
    parts = K.corpus_audit(T.images(spark, sf_dir), T.boxes(spark, sf_dir), embed=word_buckets)
    return parts["embedding_copies"].withColumn("cosine", r6("cosine"))


@query(
    "significance_report",
    f"""SELECT variant, n, wins, mean_diff, p_sign, w_plus, p_wilcoxon, ci_low, ci_high FROM ({ORACLES["sign_test"]})
    JOIN ({ORACLES["wilcoxon"]}) USING (variant) JOIN ({ORACLES["paired_bootstrap"]}) USING (variant)""",
)
def _significance(spark, sf_dir):
    """Sign test, signed-rank test and interval in one row per comparison."""
    out = K.significance_report(diffs(spark, sf_dir), ["variant"], "seed")
    return out.select(
        "variant", "n", "wins", "w_plus",
        *[F.round(c, 7).alias(c) for c in ("p_sign", "p_wilcoxon")], *[r6(c).alias(c) for c in ("mean_diff", "ci_low", "ci_high")],
    )


@query(
    "power_note",
    with_tables("images", "cands", extra="""
shown AS (SELECT count(*) FILTER (background = 'en') AS a, count(*) FILTER (background = 'es') AS b FROM cands JOIN images USING (image_id))""", body="""
SELECT count(*) FILTER (split = 'train') AS train_images, count(*) FILTER (split = 'val') AS val_images,
       count(*) FILTER (split = 'test') AS test_images, count(*) FILTER (split = 'test' AND background = 'es') AS minority_test_images,
       count(*) FILTER (split = 'val' AND background = 'es') AS minority_val_images,
       (SELECT round((1.959963985 + 0.8416212336) * sqrt(0.25 * (1.0 / greatest(a, 1) + 1.0 / greatest(b, 1))), 3)::double FROM shown) AS detectable_gap
FROM images"""),
)
def _power(spark, sf_dir):
    """Split sizes, and the gap that the candidates of the two groups' images can show."""
    images = T.images(spark, sf_dir)
    shown = cands(spark, sf_dir).select("image_id").join(images.select("image_id", "background"), "image_id")
    return K.power_note(images, shown, "background", "en", "es")


# stored tables


@query(
    "candidate_dump",
    with_tables("cands", body="""
SELECT run AS method, (image_id % 2)::int AS seed, count(*) AS n, round(avg(fused), 6) AS mean_fused FROM cands
WHERE run <> 'r2' GROUP BY ALL"""),
)
def _dump(spark, sf_dir):
    """Score tables written per run and read back with partition pruning."""
    path = scratch_path(spark, "candidates")
    rows = cands(spark, sf_dir).select(
        F.col("run").alias("method"), F.expr("int(image_id % 2)").alias("seed"), "image_id", "det_id", "grp", "label", "p_det", "p_ver", "fused", "iou"
    )
    U.write_candidates(rows, path, force=True)
    stored = U.read_candidates(spark, path).where(F.col("method") != "r2")
    return stored.groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fused")).alias("mean_fused"))


@query(
    "pending_runs",
    """
SELECT v.variant AS method, s.seed FROM (SELECT DISTINCT event_type AS variant FROM events) v
CROSS JOIN (SELECT DISTINCT user_id % 7 AS seed FROM events) s
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = v.variant AND e.user_id % 7 = s.seed AND e.value > 350)""",
)
def _pending(spark, sf_dir):
    """Runs without a stored report; a run counts as stored once a value above 350 was logged."""
    events = T.read(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 7).alias("seed"), "value")
    seeds = events.agg(F.collect_set("seed").alias("s"))
    wanted = events.select("method").distinct().withColumn("seed", F.explode(seeds.scalar()))
    return U.pending_runs(wanted, events.where("value > 350"))


@query(
    "available_runs",
    "SELECT event_type AS method, user_id % 7 AS seed, event_type || '_seed' || (user_id % 7) AS tag FROM events WHERE event_type LIKE 'c%' GROUP BY ALL",
)
def _available(spark, sf_dir):
    path = scratch_path(spark, "runs")
    runs = T.run_reports(spark, sf_dir).select(F.col("variant").alias("method"), "seed", "score")
    U.write_candidates(runs, path, force=True)
    return U.available_runs(spark, path, "c").withColumn("seed", F.col("seed").cast("long"))


@query(
    "label_lines",
    with_tables("boxes", extra="""
l AS (SELECT image_id, gt_id, x1, y1, (x2 - x1) AS w, (y2 - y1) AS h FROM boxes WHERE gt_id % 17 <> 0)""", body="""
SELECT split, count(*) AS boxes, round(sum(x1), 2) AS sx, round(sum(y1), 2) AS sy, round(sum(w), 2) AS sw, round(sum(h), 2) AS sh FROM (
  SELECT *, CASE WHEN image_id % 10 < 6 THEN 'train' WHEN image_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM l) GROUP BY split"""),
)
def _labels(spark, sf_dir):
    """Normalised label lines (some malformed) turned back into boxes."""
    split = F.expr("CASE WHEN image_id % 10 < 6 THEN 'train' WHEN image_id % 10 < 8 THEN 'val' ELSE 'test' END")
    gt = T.boxes(spark, sf_dir).select("*", split.alias("split"), F.lpad(F.col("image_id").cast("string"), 12, "0").alias("stem"))
    size = 512.0
    line = F.concat_ws(
        " ",
        F.lit("0"),
        *[(e / size).cast("string") for e in (
            (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))],
    )
    broken = F.when(F.col("gt_id") % 17 == 0, F.concat(line, F.lit(" extra"))).otherwise(line)
    lines = gt.select("split", "stem", F.col("gt_id").alias("line_no"), broken.alias("line"))
    files = gt.select("split", "stem").distinct().select(
        "split", "stem", F.explode(F.array(F.lit(".jpg"), F.lit(".png"))).alias("ext"), F.lit(512).alias("width"), F.lit(512).alias("height")
    )
    _, boxes = P.labels_to_boxes(lines, files)
    return boxes.groupBy("split").agg(
        F.count(F.lit(1)).alias("boxes"),
        F.round(F.sum("x1"), 2).alias("sx"), F.round(F.sum("y1"), 2).alias("sy"),
        F.round(F.sum(F.col("x2") - F.col("x1")), 2).alias("sw"), F.round(F.sum(F.col("y2") - F.col("y1")), 2).alias("sh"),
    )


@query(
    "preferred_image",
    """
SELECT stem, arg_min(ext, r) AS ext FROM (
  SELECT l_orderkey AS stem, ext, list_position(['.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp'], ext) AS r
  FROM (SELECT l_orderkey, (['.bmp', '.tiff', '.gif', '.jpg', '.tif', '.jpeg', '.png'])[l_linenumber] AS ext FROM lineitem))
WHERE r IS NOT NULL GROUP BY stem""",
)
def _preferred(spark, sf_dir):
    exts = F.expr("array('.bmp', '.tiff', '.gif', '.jpg', '.tif', '.jpeg', '.png')")
    files = T.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stem"), F.try_element_at(exts, F.col("l_linenumber")).alias("ext")
    )
    return P.preferred_image(files, ["stem"])


@query(
    "metadata_lookup",
    """
SELECT coalesce(m.c, 'unknown') AS camera, coalesce(m.b, 'b0') AS background, count(*) AS images
FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) i
LEFT JOIN (SELECT user_id AS id, arg_max(event_type, event_id) AS c, 'b' || (max(event_id) % 3) AS b FROM events GROUP BY 1) m ON m.id = i.id
GROUP BY ALL""",
)
def _metadata(spark, sf_dir):
    """Groups by file name with defaults; of repeated metadata rows the last one counts."""
    rows = T.read(spark, sf_dir, "events").select(
        "event_id", F.expr("concat(user_id, '.png')").alias("file_name"), F.col("event_type").alias("camera"),
        F.expr("concat('b', event_id % 3)").alias("background"),
    )
    images = T.read(spark, sf_dir, "lineitem").select(F.expr("concat('images/', l_orderkey, '.png')").alias("file_name")).distinct()
    grouped = P.with_groups(images, P.metadata_lookup(rows, "event_id"))
    return grouped.groupBy("camera", "background").agg(F.count(F.lit(1)).alias("images"))


_PATHS = """
p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Mannual' WHEN 1 THEN 'Mannual_Seg' WHEN 2 THEN 'Without_bacilli' ELSE 'Autofocus' END AS cat,
             page_id % 5 AS m, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, page_id % 9 = 0 AS thumb FROM pages)
"""


@query(
    "path_groups",
    f"""WITH {_PATHS}
SELECT CASE WHEN m = 0 THEN 'unknown' ELSE 'micro' || m END AS camera, CASE WHEN m = 0 THEN cat || '_set' ELSE cat END AS category,
       CASE WHEN cat = 'Without_bacilli' AND m > 0 THEN 'zn_empty' ELSE 'zn' END AS background, m > 0 AND cat IN ('Mannual', 'Mannual_Seg') AS annotated,
       count(*) AS images, count(DISTINCT host) AS hosts FROM p WHERE NOT thumb GROUP BY ALL""",
)
def _paths(spark, sf_dir):
    """Camera, category and background read off file paths; thumbnails drop out."""
    folder = F.expr(
        "concat(CASE page_id % 4 WHEN 0 THEN 'Mannual' WHEN 1 THEN 'Mannual_Seg' WHEN 2 THEN 'Without_bacilli' ELSE 'Autofocus' END, "
        "CASE WHEN page_id % 5 = 0 THEN '_set' ELSE concat('_Microscope-', page_id % 5, '_set1') END)"
    )
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    name = F.expr("CASE WHEN page_id % 9 = 0 THEN 'Thumbs.jpg' ELSE concat(page_id, '.jpg') END")
    files = T.read(spark, sf_dir, "pages").select(F.concat_ws("/", host, folder, name).alias("path"), host.alias("host"))
    return P.describe_paths(files).groupBy("camera", "category", "background", "annotated").agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct("host").alias("hosts")
    )


@query(
    "url_path_groups",
    """
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS section,
       count(*) AS pages FROM pages GROUP BY ALL""",
)
def _urls(spark, sf_dir):
    pages = T.read(spark, sf_dir, "pages")
    return pages.groupBy(
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("section")
    ).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "kept_with_boxes",
    with_tables("all_images", "boxes", body="""
SELECT grp, count(*) AS all_images, count(*) FILTER (image_id IN (SELECT image_id FROM boxes)) AS with_boxes FROM all_images GROUP BY grp"""),
)
def _kept(spark, sf_dir):
    """Images that stay without and with empty backgrounds."""
    images, gt = T.all_images(spark, sf_dir), T.boxes(spark, sf_dir)
    counted = [
        P.kept_images(images, gt, flag).groupBy("grp").agg(F.count(F.lit(1)).alias(name))
        for flag, name in ((True, "all_images"), (False, "with_boxes"))
    ]
    return counted[0].join(counted[1], "grp", "left").na.fill(0)


@query(
    "stored_reports",
    with_tables("reports", body="SELECT variant, seed, round(score, 6) AS score, n_rows FROM reports"),
)
def _stored_reports(spark, sf_dir):
    """Run reports written as JSON objects and read back."""
    path = scratch_path(spark, "reports")
    U.write_reports(T.run_reports(spark, sf_dir), path)
    stored = spark.read.schema("variant string, seed long, score double, n_rows long").json(path)
    return stored.withColumn("score", r6("score"))


@query(
    "split_files",
    with_tables("images", "boxes", extra="""
numbered AS (SELECT i.split, row_number() OVER (ORDER BY list_position(['train', 'val', 'test'], i.split), b.image_id, b.gt_id) - 1 AS no
             FROM boxes b JOIN images i USING (image_id))""", body="""
SELECT split, images, boxes, no_sum FROM (SELECT split, count(*) AS images FROM images GROUP BY 1)
LEFT JOIN (SELECT split, count(*) AS boxes, sum(no)::bigint AS no_sum FROM numbered GROUP BY 1) USING (split)"""),
)
def _split_files(spark, sf_dir):
    """Splits written to files, boxes numbered anew across them, and read back."""
    path = scratch_path(spark, "splits")
    P.write_splits(T.images(spark, sf_dir), T.boxes(spark, sf_dir), path)
    images = spark.read.parquet(f"{path}/images").groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    boxes = spark.read.parquet(f"{path}/boxes").groupBy("split").agg(
        F.count(F.lit(1)).alias("boxes"), F.sum("gt_id").alias("no_sum")
    )
    return images.join(boxes, "split", "left")


@query(
    "detection_dump",
    with_tables("best", body="""
SELECT 'det' AS method, (image_id % 3)::int AS seed, count(*) AS n, round(avg(score), 6) AS mean_score FROM best GROUP BY ALL"""),
)
def _detection_dump(spark, sf_dir):
    """Detections written per run and read back whole."""
    path = scratch_path(spark, "detections")
    rows = T.detections(spark, sf_dir).select(F.lit("det").alias("method"), F.expr("int(image_id % 3)").alias("seed"), "*")
    U.write_candidates(rows, path, force=True)
    stored = U.read_candidates(spark, path, method="det")
    return stored.groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean_score"))


@query(
    "predictions_per_image",
    with_tables("all_images", "dets", "boxes", body="""
SELECT image_id, grp, coalesce(n_preds, 0) AS n_preds, best_det, round(scores, 6) AS scores, coalesce(n_gts, 0) AS n_gts,
       first_gt, round(area, 3) AS area FROM all_images
LEFT JOIN (SELECT image_id, count(*)::int AS n_preds, first(det_id ORDER BY score DESC, det_id) AS best_det, sum(score) AS scores
           FROM dets GROUP BY 1) USING (image_id)
LEFT JOIN (SELECT image_id, count(*)::int AS n_gts, min(gt_id) AS first_gt, sum((x2 - x1) * (y2 - y1))::double AS area
           FROM boxes GROUP BY 1) USING (image_id)"""),
)
def _predictions_per_image(spark, sf_dir):
    """Detections and true boxes as one row per image, and what a scorer reads from it."""
    rows = U.per_image(T.all_images(spark, sf_dir), T.detections(spark, sf_dir), T.boxes(spark, sf_dir))

    def total(name, value):
        return F.when(F.size(name) > 0, F.aggregate(F.transform(name, value), F.lit(0.0), lambda a, x: a + x))

    return rows.select(
        "image_id", "grp", F.size("preds").alias("n_preds"), F.get("preds", F.lit(0))["det_id"].alias("best_det"),
        r6(total("preds", lambda x: x["score"])).alias("scores"), F.size("gts").alias("n_gts"),
        F.get("gts", F.lit(0))["gt_id"].alias("first_gt"),
        F.round(total("gts", lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])), 3).alias("area"),
    )


@query(
    "annotation_documents",
    with_tables("images", "boxes", body="""
SELECT split, images, cameras, coalesce(boxes, 0) AS boxes, round(coalesce(area, 0), 3) AS area, coalesce(ids, 0) AS ids FROM
(SELECT split, count(*) AS images, count(DISTINCT camera) AS cameras FROM images GROUP BY split) LEFT JOIN
(SELECT split, count(*) AS boxes, sum((x2 - x1) * (y2 - y1))::double AS area, sum(gt_id % 1000003)::bigint AS ids
 FROM boxes JOIN images USING (image_id) GROUP BY split) USING (split)"""),
)
def _annotation_documents(spark, sf_dir):
    """One annotation document per split, written, and read again in ranges of 64 KB."""
    path = scratch_path(spark, "documents")
    images = T.images(spark, sf_dir).select("split", "image_id", "camera", "background")
    N.write_documents(images, T.boxes(spark, sf_dir).join(images.select("image_id", "split"), "image_id"), path)
    objects = N.read_objects(spark, path, 1 << 16)
    per_image = N.images_in(objects).groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct("camera").alias("cameras")
    )
    per_box = N.boxes_in(objects).groupBy("split").agg(
        F.count(F.lit(1)).alias("boxes"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"),
        F.sum(F.col("gt_id") % 1000003).alias("ids"),
    )
    zero = F.lit(0)
    return per_image.join(per_box, "split", "left").select(
        "split", "images", "cameras", F.coalesce("boxes", zero).alias("boxes"),
        F.round(F.coalesce("area", zero.cast("double")), 3).alias("area"), F.coalesce("ids", zero).alias("ids"),
    )


_STUDY = {  # part: (the query whose SQL gives it, its detail, its figures)
    "counts": ("candidate_counts", "''", ("n", "images", "positives", "positive_rate", "ece")),
    "occupancy": ("bin_occupancy", "''", ("occupied_bins", "bins_with_one", "median_occupied")),
    "intervals": ("cluster_bootstrap_ci", "''", ("ci_low", "ci_high")),
    "binning": ("binning_robustness", "binning", ("ece",)),
    "stages": ("stage_decomposition", "stage", ("ece",)),
    "equal_recall": ("fp_matched_recall", "''", ("target_tp", "fp_reference", "fp_alternative", "delta_fp", "relative")),
    "metrics": ("subgroup_metrics", "''", ("n", "ece", "laece", "brier", "nll")),
}


def _study_sql() -> str:
    """The figures of seven queries over the same candidates, as one list; all runs count as one."""
    one_run = "FROM (SELECT * REPLACE ('all' AS run) FROM cands)"
    parts = []
    for part, (name, detail, figures) in _STUDY.items():
        sql = ORACLES[name].replace("FROM cands", one_run)
        if part == "occupancy":
            held = "(({c} > lo OR (bin = 1 AND {c} >= lo)) AND {c} <= hi)"
            sql = sql.replace(held.format(c="p_ver"), held.format(c="fused"))
        rows = " UNION ALL ".join(
            f"SELECT grp::varchar AS grp, '{part}' AS part, {detail} AS detail, '{f}' AS name, round({f}::double, 6) AS value FROM q" for f in figures
        )
        parts.append(f"SELECT * FROM (WITH q AS MATERIALIZED ({sql}) {rows})")
    return "SELECT grp, part, detail, name, value FROM (" + " UNION ALL ".join(parts) + ")"


@query("subgroup_study", _study_sql())
def _study(spark, sf_dir):
    """Seven tables on the candidates of all runs together, from one written copy of the scores."""
    df = cands(spark, sf_dir).withColumn("run", F.lit("all"))
    rows = K.study_rows(K.subgroup_study(df, ["run"], "grp"), ["run"], "grp")
    return rows.select("grp", "part", "detail", "name", r6("value").alias("value"))


_WHOLE = {  # part: (the query whose SQL gives it, its figures)
    "detection": ("detection_report", ("ap50", "ap75", "ap_range", "recall_small", "lrp50", "laece", "count_mae", "count_corr", "worst_group_ap50", "mean_ap50")),
    "calibration": ("calibration_report", ("n", "ece", "brier", "laece", "groups_counted", "worst_group_ece")),
    "selective": ("selective_report", ("rows", "accuracy", "aurc", "auroc", "auprc", "risk_90")),
}


def _whole_sql() -> str:
    """The figures of three reports on all candidates as one list."""
    parts = []
    for part, (name, figures) in _WHOLE.items():
        sql = ORACLES[name].replace("FROM cands", "FROM (SELECT * REPLACE ('all' AS run) FROM cands)")
        rows = " UNION ALL ".join(f"SELECT '{part}' AS part, '{f}' AS name, round({f}::double, 6) AS value FROM q" for f in figures)
        parts.append(f"SELECT * FROM (WITH q AS MATERIALIZED ({sql}) {rows})")
    return " UNION ALL ".join(parts)


@query("full_report", _whole_sql())
def _whole(spark, sf_dir):
    """Detection, calibration and selective figures of one run, a row per figure."""
    scores = with_disagreement(spark, sf_dir)
    parts = K.full_report(T.all_images(spark, sf_dir), T.detections(spark, sf_dir), T.boxes(spark, sf_dir), scores)
    parts["selective"] = parts["selective"].withColumn("risk_90", F.element_at("risk", F.lit(0.9)))
    listed = {part: parts[part].select(F.lit("all").alias("grp"), *figures) for part, (_, figures) in _WHOLE.items()}
    return K.study_rows(listed, [], "grp").select("part", "name", r6("value").alias("value"))
