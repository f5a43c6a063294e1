"""Queries on the corpus: copies, leaks, near copies, composition, box statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import neardup as N
from plumbline.plans import tables as T
from plumbline.plans.registry import query, r6
from plumbline.plans.tables import with_tables
from plumbline.session import materialize

_HASHED = "hashed AS (SELECT *, sha256(content) AS digest FROM images)"


def hashed(spark, sf_dir):
    return T.images(spark, sf_dir).select(
        "image_id", "camera", "background", "split", A.content_hash(F.col("content")).alias("digest")
    )


def stored_hashes(spark, sf_dir):
    """Hashes as a written table, so that contents are read once."""
    return materialize(hashed(spark, sf_dir))


@query(
    "exact_duplicates",
    with_tables("images", extra=_HASHED, body="""
SELECT image_id, digest, first_id, copies FROM (
  SELECT image_id, digest, min(image_id) OVER (PARTITION BY digest) AS first_id,
         count(*) OVER (PARTITION BY digest) AS copies FROM hashed) WHERE copies > 1"""),
)
def _dups(spark, sf_dir):
    return A.exact_copies(stored_hashes(spark, sf_dir)).select("image_id", "digest", "first_id", "copies")


@query(
    "cross_split_leaks",
    with_tables("images", extra=_HASHED, body="""
SELECT digest, count(DISTINCT split) AS splits, count(*) AS rows, count(*) FILTER (split = 'train') AS in_train,
       count(*) FILTER (split = 'val') AS in_val, count(*) FILTER (split = 'test') AS in_test
FROM hashed GROUP BY digest HAVING count(DISTINCT split) > 1"""),
)
def _leaks(spark, sf_dir):
    return A.cross_split_leaks(hashed(spark, sf_dir))


@query(
    "leaked_test_ids",
    with_tables("images", extra=_HASHED, body="""
SELECT image_id FROM hashed WHERE split = 'test' AND digest IN (SELECT digest FROM hashed WHERE split = 'train')"""),
)
def _leaked(spark, sf_dir):
    return A.leaked_ids(stored_hashes(spark, sf_dir))


_KEPT = _HASHED + """,
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY
  CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, image_id) AS k FROM hashed) WHERE k = 1)"""


@query(
    "remove_leaks",
    with_tables("images", extra=_KEPT, body="""
SELECT split, h.n AS before, coalesce(k.n, 0) AS kept, h.n - coalesce(k.n, 0) AS removed
FROM (SELECT split, count(*) AS n FROM hashed GROUP BY 1) h
LEFT JOIN (SELECT split, count(*) AS n FROM kept GROUP BY 1) k USING (split)"""),
)
def _remove(spark, sf_dir):
    df = stored_hashes(spark, sf_dir)
    return A.removal_counts(df, A.first_occurrences(df))


@query(
    "kept_images",
    with_tables("images", extra=_KEPT, body="SELECT image_id, split FROM kept"),
)
def _kept(spark, sf_dir):
    return A.first_occurrences(hashed(spark, sf_dir)).select("image_id", "split")


@query(
    "boxes_of_kept_images",
    with_tables("images", "boxes", extra=_KEPT, body="""
SELECT grp, count(*) AS boxes, count(DISTINCT image_id) AS images FROM boxes
WHERE image_id IN (SELECT image_id FROM kept) GROUP BY grp"""),
)
def _kept_boxes(spark, sf_dir):
    kept = A.first_occurrences(hashed(spark, sf_dir))
    left = A.boxes_of(kept, T.boxes(spark, sf_dir))
    return left.groupBy("grp").agg(F.count(F.lit(1)).alias("boxes"), F.countDistinct("image_id").alias("images"))


_FINGERPRINTS = """
votes AS (
  SELECT image_id, b, sum(CASE WHEN w = '' THEN 0 WHEN ((CASE WHEN b < 32 THEN h0 ELSE h1 END) >> (b % 32)) & 1 = 1 THEN 1 ELSE -1 END) AS v
  FROM (SELECT image_id, w, ('0x' || substr(md5(w), 1, 8))::bigint AS h0, ('0x' || substr(md5(w), 9, 8))::bigint AS h1
        FROM (SELECT image_id, unnest(string_split(content, ' ')) AS w FROM images)) CROSS JOIN (SELECT i::int AS b FROM range(64) x(i))
  GROUP BY ALL),
fps AS (SELECT image_id, (CASE WHEN s >= 9223372036854775808::hugeint THEN s - 18446744073709551616::hugeint ELSE s END)::bigint AS fingerprint
        FROM (SELECT image_id, sum(CASE WHEN v > 0 THEN (1::hugeint << b) ELSE 0 END) AS s FROM votes GROUP BY 1)),
dist AS (SELECT DISTINCT fingerprint AS fp FROM fps),
near AS (SELECT a.fp AS fp_a, b.fp AS fp_b, bit_count(xor(a.fp, b.fp))::int AS distance
         FROM dist a JOIN dist b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= {k})
"""


def fingerprints(spark, sf_dir):
    return N.text_fingerprint(T.images(spark, sf_dir), "image_id", "content")


@query(
    "fingerprints",
    with_tables("images", extra=_FINGERPRINTS.format(k=6), body="SELECT image_id, fingerprint FROM fps"),
)
def _fingerprints(spark, sf_dir):
    return fingerprints(spark, sf_dir)


@query(
    "near_dup_hamming",
    with_tables("images", extra=_FINGERPRINTS.format(k=6) + """,
reps AS (SELECT fingerprint, min(image_id) AS id, count(*) AS n FROM fps GROUP BY 1)""", body="""
SELECT fp_a, fp_b, distance, a.id AS id_a, a.n AS n_a, b.id AS id_b, b.n AS n_b, a.n * b.n AS id_pairs
FROM near JOIN reps a ON a.fingerprint = fp_a JOIN reps b ON b.fingerprint = fp_b"""),
)
def _near(spark, sf_dir):
    """Near copies within 6 bits, as pairs of distinct fingerprints."""
    return N.near_copies(fingerprints(spark, sf_dir), 6)


@query(
    "leakage_report",
    with_tables("images", extra=_HASHED + "," + _FINGERPRINTS.format(k=4) + """,
held AS (SELECT fingerprint, split, count(*) AS n FROM fps JOIN images USING (image_id) GROUP BY ALL),
allnear AS (SELECT fp_a, fp_b FROM near UNION ALL SELECT fp, fp FROM dist),
nearleaks AS (SELECT sum(a.n * b.n)::bigint AS n FROM allnear
  JOIN held a ON a.fingerprint = fp_a JOIN held b ON b.fingerprint = fp_b
  WHERE CASE WHEN fp_a = fp_b THEN a.split < b.split ELSE a.split <> b.split END)""", body="""
SELECT e AS exact_leaks, n AS near_leaks, e = 0 AND n = 0 AS clean FROM
(SELECT count(*) AS e FROM (SELECT digest FROM hashed GROUP BY digest HAVING count(DISTINCT split) > 1)) x,
(SELECT coalesce(max(n), 0) AS n FROM nearleaks) y"""),
)
def _leakage(spark, sf_dir):
    """Exact and near leaks between splits (4 bits) and whether the corpus is clean."""
    from plumbline.plans.composite import leakage_report

    return leakage_report(T.images(spark, sf_dir))


_COMPONENTS = """,
both_ways AS (SELECT fp_a AS u, fp_b AS v FROM near UNION ALL SELECT fp_b, fp_a FROM near),
reach AS (SELECT u, u AS v FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON e.u = r.v),
comp AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY u)
"""


@query(
    "near_dup_components",
    with_tables("images", extra=_FINGERPRINTS.format(k=6) + _COMPONENTS, recursive=True,
                body="SELECT node, component FROM comp"),
)
def _components(spark, sf_dir):
    return N.components(N.hamming_links(fingerprints(spark, sf_dir), 6))


@query(
    "remove_near_copies",
    with_tables("images", extra=_FINGERPRINTS.format(k=6) + _COMPONENTS, recursive=True, body="""
SELECT arg_min(image_id, (r, image_id)) AS image_id, component, count(*) AS members FROM (
  SELECT image_id, coalesce(component, fingerprint) AS component,
         CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS r
  FROM fps JOIN images USING (image_id) LEFT JOIN comp ON node = fingerprint)
GROUP BY component"""),
)
def _component_removal(spark, sf_dir):
    """One image kept per group of near copies, by split priority."""
    images = T.images(spark, sf_dir)
    fps = materialize(images.select("image_id", "split", N.fingerprint_of(F.col("content")).alias("fingerprint")))
    labels = N.components(N.hamming_links(fps, 6))
    return N.keep_one_per_component(fps, labels, A.split_rank(F.col("split")))


_NEAR_VECTORS = """
plus AS (SELECT vec_id AS id, vec FROM vecs UNION ALL
         SELECT vec_id + 1000000, list_transform(list_zip(vec, range(64)),
                lambda p: CASE WHEN p[2] = vec_id % 64 THEN p[1] + 0.1::double ELSE p[1] END) FROM vecs),
unit AS (SELECT id, list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-9)) AS v FROM plus)
"""


@query(
    "near_dup_cosine",
    with_tables("vecs", extra=_NEAR_VECTORS, body="""
SELECT a.id AS id_a, b.id AS id_b, round(list_inner_product(a.v, b.v), 6) AS cosine
FROM unit a JOIN unit b ON a.id < b.id WHERE list_inner_product(a.v, b.v) >= 0.98"""),
)
def _cosine(spark, sf_dir):
    """Vectors within cosine 0.98; every vector has a slightly turned twin in the input."""
    vecs = T.vectors(spark, sf_dir).select("vec_id", "vec")
    twin = vecs.select(
        (F.col("vec_id") + 1000000).alias("vec_id"),
        F.expr("transform(vec, (x, i) -> CASE WHEN i = vec_id % 64 THEN x + 0.1D ELSE x END)").alias("vec"),
    )
    out = N.cosine_pairs(vecs.unionByName(twin), "vec_id", "vec", 0.98)
    return out.withColumn("cosine", r6("cosine"))


@query(
    "group_distribution",
    with_tables("images", body="SELECT camera || '/' || background AS grp, count(*) AS images FROM images GROUP BY 1"),
)
def _groups(spark, sf_dir):
    return A.group_distribution(T.images(spark, sf_dir))


_SHARES = """
shares AS (SELECT split, background, count(*) AS images,
                  round(count(*) * 100.0::double / sum(count(*)) OVER (PARTITION BY split), 1) AS pct
           FROM images GROUP BY split, background)
"""


@query("group_shares", with_tables("images", extra=_SHARES, body="SELECT * FROM shares"))
def _shares(spark, sf_dir):
    return A.group_shares(T.images(spark, sf_dir))


@query(
    "share_drift",
    with_tables("images", extra=_SHARES, body="""
SELECT background, train, val, test, round(greatest(train, val, test) - least(train, val, test), 1) AS drift FROM (
  SELECT background, coalesce(max(pct) FILTER (split = 'train'), 0)::double AS train,
         coalesce(max(pct) FILTER (split = 'val'), 0)::double AS val,
         coalesce(max(pct) FILTER (split = 'test'), 0)::double AS test FROM shares GROUP BY 1)"""),
)
def _drift(spark, sf_dir):
    return A.share_drift(A.group_shares(T.images(spark, sf_dir)))


@query(
    "group_index",
    with_tables("images", body="""
SELECT camera, background, group_id, cn AS camera_no, bn AS background_no FROM (
  SELECT DISTINCT camera, background, cn, bn, nb, (cn * nb + bn)::int AS group_id
  FROM images JOIN (SELECT camera, row_number() OVER (ORDER BY camera) - 1 AS cn FROM (SELECT DISTINCT camera FROM images)) USING (camera)
  JOIN (SELECT background, row_number() OVER (ORDER BY background) - 1 AS bn, count(*) OVER () AS nb
        FROM (SELECT DISTINCT background FROM images)) USING (background))"""),
)
def _index(spark, sf_dir):
    idx = A.group_index(T.images(spark, sf_dir))
    return idx.select(
        "camera", "background", "group_id",
        F.floor(F.col("group_id") / F.col("backgrounds")).alias("camera_no"),
        (F.col("group_id") % F.col("backgrounds")).alias("background_no"),
    )


@query(
    "zero_filled_counts",
    with_tables("images", body="""
SELECT camera, background, coalesce(n, 0) AS n
FROM (SELECT * FROM (SELECT DISTINCT camera FROM images) CROSS JOIN (SELECT DISTINCT background FROM images)) g
LEFT JOIN (SELECT camera, background, count(*) AS n FROM images WHERE split = 'test' GROUP BY ALL) USING (camera, background)"""),
)
def _zero(spark, sf_dir):
    """Test images per group; every camera and background combination is listed."""
    images = T.images(spark, sf_dir)
    names = images.agg(F.collect_set("camera").alias("cs"), F.collect_set("background").alias("bs"))
    groups = names.select(F.explode("cs").alias("camera"), "bs").select("camera", F.explode("bs").alias("background"))
    both = F.struct("camera", "background").alias("g")
    filled = A.zero_filled_counts(groups.select(both), images.where("split = 'test'").select(both), "g")
    return filled.select("g.camera", "g.background", "n")


_BOX_MEASURES = """
m AS (SELECT image_id, grp, unnest([
        {'measure': 'width', 'value': x2 - x1}, {'measure': 'height', 'value': y2 - y1},
        {'measure': 'area', 'value': (x2 - x1) * (y2 - y1)},
        {'measure': 'aspect_ratio', 'value': greatest(x2 - x1, y2 - y1) / greatest(least(x2 - x1, y2 - y1), 1e-6)}], recursive := true)
      FROM boxes WHERE x2 > x1 AND y2 > y1),
mm AS (SELECT measure, grp, value FROM m UNION ALL SELECT measure, 'pooled', value FROM m UNION ALL
       SELECT 'boxes_per_image', 'pooled', coalesce(n, 0)::double FROM all_images
       LEFT JOIN (SELECT image_id, count(*) AS n FROM boxes GROUP BY 1) USING (image_id))
"""


@query(
    "box_statistics",
    with_tables("boxes", "all_images", extra=_BOX_MEASURES, body="""
SELECT measure, grp, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS min,
       max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM mm GROUP BY ALL"""),
)
def _boxes(spark, sf_dir):
    out = A.box_statistics(T.boxes(spark, sf_dir), "grp", T.all_images(spark, sf_dir))
    return out.select(
        "measure", "grp", "n", r6("mean").alias("mean"), F.round("std", 5).alias("std"), "min", "max",
        r6("p50").alias("p50"), r6("p95").alias("p95"),
    )


@query(
    "finer_level_advice",
    with_tables("boxes", "all_images", extra=_BOX_MEASURES, body="""
SELECT *, median_w < stride OR median_h < stride AS finer_level FROM (
  SELECT quantile_cont(value, 0.5) FILTER (measure = 'width') AS median_w,
         quantile_cont(value, 0.5) FILTER (measure = 'height') AS median_h, 40 AS stride FROM mm WHERE grp = 'pooled')"""),
)
def _advice(spark, sf_dir):
    return A.finer_level_advice(A.box_statistics(T.boxes(spark, sf_dir), "grp"), stride=40)


_COUNTED = "counted AS (SELECT i.*, coalesce(n, 0) AS boxes FROM images i LEFT JOIN (SELECT image_id, count(*) AS n FROM boxes GROUP BY 1) USING (image_id))"


@query(
    "split_composition",
    with_tables("images", "boxes", extra=_COUNTED, body="""
SELECT split, count(*) AS images, sum(boxes)::bigint AS boxes, round(avg(boxes), 6) AS mean_boxes, min(boxes) AS min_boxes,
       max(boxes) AS max_boxes, count(*) FILTER (boxes = 0) AS empty_images, median(boxes)::double AS median_boxes,
       round(count(*) * 100.0::double / sum(count(*)) OVER (), 1) AS pct
FROM counted GROUP BY split"""),
)
def _composition(spark, sf_dir):
    out = A.split_composition(T.images(spark, sf_dir), T.boxes(spark, sf_dir))
    return out.withColumn("mean_boxes", r6("mean_boxes"))


@query(
    "split_group_boxes",
    with_tables("images", "boxes", extra=_COUNTED, body="""
SELECT coalesce(split, 'all') AS split, background, count(*) AS images, sum(boxes)::bigint AS boxes
FROM counted GROUP BY GROUPING SETS ((split, background), (background))"""),
)
def _group_boxes(spark, sf_dir):
    return A.group_boxes(T.images(spark, sf_dir), T.boxes(spark, sf_dir))


@query(
    "metadata_crosstab",
    with_tables("images", body="""
SELECT split, m.source AS value, count(*) AS images
FROM images i LEFT JOIN (SELECT d.doc_id, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id) m ON m.doc_id = i.image_id
GROUP BY ALL"""),
)
def _crosstab(spark, sf_dir):
    """Metadata of the labelled documents by base name; the others are misses. Of two rows for a name the later counts."""
    images = T.images(spark, sf_dir).select("split", F.expr("concat('set/', split, '/', image_id, '.png')").alias("file_name"))
    labelled = T.read(spark, sf_dir, "labels").select("doc_id")
    meta = (
        T.read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labelled, "doc_id", "left_semi")
        .select(
            F.expr("concat(doc_id, '.png')").alias("file_name"),
            F.posexplode(F.array("lang", "source")).alias("line", "background"),
        )
    )
    return A.metadata_crosstab(images, meta, order="line")


@query(
    "min_detectable_gap",
    with_tables("images", body="""
SELECT a.background AS group_a, b.background AS group_b,
       round((1.959963985 + 0.8416212336) * sqrt(0.25 * (1.0 / a.n + 1.0 / b.n)), 6)::double AS gap
FROM (SELECT background, count(*)::double AS n FROM images WHERE split = 'test' GROUP BY 1) a
JOIN (SELECT background, count(*)::double AS n FROM images WHERE split = 'test' GROUP BY 1) b ON a.background < b.background"""),
)
def _gap(spark, sf_dir):
    sizes = T.images(spark, sf_dir).where("split = 'test'").groupBy("background").agg(F.count(F.lit(1)).alias("n"))
    # every other group against each: a handful of group names, not rows
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("background", "n"))).alias("g"))
    pairs = listed.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a.background < b.background")
    return pairs.select(
        F.col("a.background").alias("group_a"), F.col("b.background").alias("group_b"),
        r6(A.detectable_gap(F.col("a.n"), F.col("b.n"))).alias("gap"),
    )


@query(
    "minority_detail",
    with_tables("cands", "all_images", body="""
SELECT run, sum(c)::bigint AS candidates, count(*) AS contributing_images, max(c) AS most_per_image,
       (SELECT count(*) FROM all_images WHERE grp = 'R') AS nominal_images, (SELECT count(*) FROM all_images WHERE grp = 'R') - count(*) AS empty_images
FROM (SELECT run, image_id, count(*) AS c FROM cands WHERE grp = 'R' GROUP BY ALL) GROUP BY run"""),
)
def _minority(spark, sf_dir):
    images = T.all_images(spark, sf_dir).where("grp = 'R'")
    return A.minority_detail(images, T.candidates(spark, sf_dir).where("grp = 'R'"), ["run"])


@query(
    "candidates_per_image",
    with_tables("cands", body="SELECT run, image_id, count(*) AS candidates FROM cands WHERE grp = 'R' GROUP BY ALL"),
)
def _per_image(spark, sf_dir):
    """Candidates of the minority group in every image that has any."""
    return A.candidates_per_image(T.candidates(spark, sf_dir).where("grp = 'R'"), ["run"])


@query(
    "images_without_candidates",
    with_tables("dets", "all_images", body="""
SELECT image_id FROM all_images WHERE grp = 'R' AND image_id NOT IN (SELECT image_id FROM dets WHERE score >= 0.3)"""),
)
def _without(spark, sf_dir):
    images = T.all_images(spark, sf_dir).where("grp = 'R'")
    return A.images_without_candidates(images, T.detections(spark, sf_dir).where("score >= 0.3"))


@query(
    "images_without_candidates_per_run",
    with_tables("cands", "all_images", body="""
SELECT run, image_id FROM (SELECT DISTINCT run FROM cands) CROSS JOIN (SELECT image_id FROM all_images WHERE grp = 'R')
WHERE (run, image_id) NOT IN (SELECT (run, image_id) FROM cands WHERE grp = 'R')"""),
)
def _without_per_run(spark, sf_dir):
    """Images of the smallest group of which a run has no candidate at all."""
    images = T.all_images(spark, sf_dir).where("grp = 'R'")
    runs = T.candidates(spark, sf_dir)
    return A.images_without_candidates(images, runs.where("grp = 'R'"), ["run"])
