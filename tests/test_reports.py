import loops
import pytest
from test_detection import frames, scene

from plumbline.functions import scores as S
from plumbline.operators import matching as M
from plumbline.plans import composite as K
from plumbline.session import scratch_path, shared_dir
from plumbline.sources import dumps as U
from pyspark.sql import functions as F


def run(spark, seed=7):
    dets, boxes = scene(seed, images=30)
    d, g = frames(spark, dets, boxes)
    grp = F.concat(F.lit("g"), (F.col("image_id") % 3).cast("string")).alias("grp")
    d, g = d.select("*", grp), g.select("*", grp)
    images = spark.range(30).select(F.col("id").alias("image_id")).select("*", grp)
    scores = (
        M.label_candidates(M.best_overlap(d, g))
        .withColumn("p_det", F.col("score"))
        .withColumn("p_ver", F.expr("((det_id * 7 + image_id * 3) % 11) / 11D"))
        .withColumn("fused", (F.col("p_det") + F.col("p_ver")) / 2)
        .withColumn("disagreement", S.js_divergence(F.col("p_det"), F.col("p_ver")))
    )
    return dets, boxes, images, d, g, scores


def test_full_report_agrees_with_loops(spark):
    dets, boxes, images, d, g, scores = run(spark)
    report = {k: v.first() for k, v in K.full_report(images, d, g, scores).items()}
    npos = sum(map(len, boxes.values()))
    det = report["detection"]
    aps = []
    for t in M.COCO_THRESHOLDS:
        aps.append(loops.average_precision(dets, loops.match(dets, boxes, t), npos))
    assert det.ap50 == pytest.approx(aps[0]) and det.ap75 == pytest.approx(aps[5])
    assert det.ap_range == pytest.approx(sum(aps) / len(aps))
    hits = loops.match(dets, boxes, 0.5)
    tp, loss = len(hits), sum(1 - v for v in hits.values())
    fp, fn = len(dets) - tp, npos - tp
    assert det.lrp50 == pytest.approx((loss / 0.5 + fp + fn) / (tp + fp + fn))
    assert det.worst_group_ap50 == pytest.approx(min(det.per_group_ap50.values())) and len(det.per_group_ap50) == 3
    assert 0 <= det.laece <= 1 and 0 <= det.recall_small <= 1
    assert det.worst_group_ap50 <= det.mean_ap50
    cal, sel = report["calibration"], report["selective"]
    assert cal.n == sel.rows == len(dets) and 0 <= cal.ece <= 1
    assert set(sel.risk) == {1.0, 0.95, 0.9, 0.8} and sel.risk[1.0] == pytest.approx(1 - sel.accuracy)


def test_subgroup_study_covers_all_parts(spark):
    *_, scores = run(spark)
    parts = K.subgroup_study(scores.withColumn("run", F.lit("r")), ["run"], "grp", draws=50)
    names = {g for g in ("g0", "g1", "g2")}
    assert {r.grp for r in parts["counts"].collect()} == names
    assert {r.grp for r in parts["intervals"].collect()} == names | {"pooled"}
    assert {r.grp for r in parts["metrics"].collect()} == names | {"pooled"}
    assert parts["binning"].count() == 16 and parts["stages"].count() == 12
    assert "all" in {r.grp for r in parts["equal_recall"].collect()}
    assert all(len(r.counts) == 15 for r in parts["occupancy"].collect())


def test_a_crowded_image_is_matched_whole(spark):
    """Half of all detections are copies on one box of one image."""
    boxes = [(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 300.0, 300.0, 520.0, 520.0)]
    g = spark.createDataFrame(boxes, "image_id long, gt_id long, x1 double, y1 double, x2 double, y2 double")
    d = spark.range(4000).selectExpr(
        "id % 2 AS image_id", "id AS det_id", "(id % 97) / 97D AS score",
        "CASE WHEN id % 2 = 0 THEN 0D ELSE 305D END AS x1", "CASE WHEN id % 2 = 0 THEN 0D ELSE 305D END AS y1",
        "CASE WHEN id % 2 = 0 THEN 10D ELSE 525D END AS x2", "CASE WHEN id % 2 = 0 THEN 9D ELSE 525D END AS y2",
    )
    hits = {r.image_id: (r.gt_id, r.det_id) for r in M.true_positives(d, g, cell=64.0).collect()}
    assert hits == {0: (0, 96), 1: (0, 193)}
    best = {r.image_id: (r["count"], r.low) for r in M.best_overlap(d, g, cell=64.0).groupBy("image_id").agg(F.count("*").alias("count"), F.min("iou").alias("low")).collect()}
    assert best[0] == (2000, pytest.approx(0.9)) and best[1] == (2000, pytest.approx(215**2 / (2 * 220**2 - 215**2)))


def test_intermediate_tables_live_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/plumbline-x-")


def test_flatten_follows_any_depth_and_skips_torn_rows(spark):
    from plumbline.operators.summaries import broken_json, flatten_json

    rows = [(1, '{"a":{"b":{"c":{"d":{"e":5}}}},"x":1,"top":Infinity,"l":[-Infinity,NaN]}'), (2, '{"a": '), (3, None)]
    df = spark.createDataFrame(rows, "id int, body string")
    got = sorted(tuple(r) for r in flatten_json(df, ["id"], "body").collect())
    assert got == [(1, "a.b.c.d.e", 5.0), (1, "x", 1.0)]
    assert [r["id"] for r in broken_json(df, "body").collect()] == [2]


def test_failure_list_is_filled_with_other_images(spark):
    from plumbline.operators.suppression import failure_images

    detections = spark.createDataFrame([(1,), (2,)], "image_id long")
    boxes = spark.createDataFrame([(2,), (3,)], "image_id long")
    hits = spark.createDataFrame([(2,)], "image_id long")
    images = spark.createDataFrame([(1,), (2,), (3,), (9,)], "image_id long")
    got = [tuple(r) for r in failure_images(detections, boxes, hits, 3, images=images).collect()]
    assert got == [(1, 1, 0), (9, 0, 0), (3, 0, 1)]


def test_last_metadata_row_of_a_name_counts(spark, tmp_path):
    from plumbline.operators.audit import metadata_crosstab
    from plumbline.sources.corpus import read_metadata

    images = spark.createDataFrame([("train", "set/a.png")], "split string, file_name string")
    meta = spark.createDataFrame([("a.png", "old", 1), ("a.png", "new", 2)], "file_name string, background string, line int")
    assert [tuple(r) for r in metadata_crosstab(images, meta, order="line").collect()] == [("train", "new", 1)]
    big = "".join(f"f{k}.png,c,old\n" for k in range(2000))
    (tmp_path / "a.csv").write_text("file_name,camera,background\n" + big)
    (tmp_path / "b.csv").write_text("file_name,camera,background\nf7.png,c,new\n")
    got = {r["file_name"]: r["background"] for r in read_metadata(spark, str(tmp_path)).collect()}
    assert got["f7.png"] == "new" and got["f8.png"] == "old" and len(got) == 2000


def test_predictions_and_boxes_per_image(spark):
    images = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "image_id long, grp string")
    box = "x1 double, y1 double, x2 double, y2 double"
    at = (0.0, 0.0, 2.0, 3.0)
    dets = spark.createDataFrame([(1, 9, 0.5, *at), (1, 4, 0.5, *at), (1, 7, 0.9, *at), (3, 1, 0.1, *at)], "image_id long, det_id long, score double, " + box)
    true = spark.createDataFrame([(2, 8, *at), (2, 3, *at), (9, 5, *at)], "image_id long, gt_id long, " + box)
    got = {r.image_id: r for r in U.per_image(images, dets, true).collect()}
    assert [p.det_id for p in got[1].preds] == [7, 4, 9] and got[1].gts == [] and got[1].grp == "a"
    assert [g.gt_id for g in got[2].gts] == [3, 8] and got[2].preds == []
    assert len(got) == 3 and got[3].grp is None and got[3].preds[0].x2 == 2.0
    assert U.per_image(images.limit(0), dets, true).collect() == []


def test_shifted_scores_keep_the_candidates(spark):
    df = spark.createDataFrame([(1, 0.2, 0.4, 1), (2, None, 0.6, 0)], "det_id long, p_det double, fused double, label int")
    half = F.col("p_det") / 2
    got = K.under_shift(df, {"half": {"p_det": half, "fused": half + 0.1}, "same": {}})
    rows = {(r.det_id, r.variant): (r.p_det, r.fused, r.label) for r in got.collect()}
    assert rows[1, "clean"] == rows[1, "same"] == (0.2, 0.4, 1) and rows[1, "half"] == (0.1, 0.2, 1)
    assert rows[2, "half"] == (None, None, 0) and len(rows) == 6
