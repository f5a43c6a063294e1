import numpy as np
import pytest

import loops
from plumbline.functions.geometry import Box, crop_window, expand, iou, tile_offsets
from plumbline.operators import detection as D
from plumbline.operators import matching as M
from plumbline.operators import suppression as P
from pyspark.sql import functions as F

DET = "image_id long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"
GT = "image_id long, gt_id long, x1 double, y1 double, x2 double, y2 double"


def scene(seed, images=12, span=60):
    rng = np.random.default_rng(seed)
    dets, boxes = [], {}
    for image in range(images):
        boxes[image] = [tuple(map(float, (x, y, x + 12, y + 9))) for x, y in rng.integers(0, span, (rng.integers(0, 5), 2))]
        if boxes[image] and image % 4 == 0:
            boxes[image].append(boxes[image][0])  # a copy that can never win
        for j in range(rng.integers(0, 9)):
            if boxes[image] and rng.random() < 0.7:
                b = boxes[image][rng.integers(len(boxes[image]))]
                dx, dy = rng.integers(-4, 5, 2)
                box = (b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy)
            else:
                x, y = rng.integers(0, span, 2)
                box = (float(x), float(y), float(x + 10), float(y + 10))
            dets.append((image, j, float(rng.integers(0, 8)) / 8, tuple(map(float, box))))  # ties on purpose
    return dets, boxes


def frames(spark, dets, boxes):
    d = spark.createDataFrame([(i, j, s, *b) for i, j, s, b in dets], DET)
    g = spark.createDataFrame([(i, k, *b) for i, bs in boxes.items() for k, b in enumerate(bs)], GT)
    return d, g


@pytest.mark.parametrize("seed,cell", [(0, 256.0), (1, 7.0)])
def test_matching_equals_greedy_loop(spark, seed, cell):
    dets, boxes = scene(seed)
    d, g = frames(spark, dets, boxes)
    levels = (0.5, 0.75)
    got = {t: {} for t in levels}
    for r in M.true_positives(d, g, levels, cell=cell).collect():
        got[r.iou_threshold][r.image_id, r.det_id] = r.iou
    for t in levels:
        want = loops.match(dets, boxes, t)
        assert got[t].keys() == want.keys()
        assert all(abs(got[t][k] - want[k]) < 1e-12 for k in want)
    best = {(r.image_id, r.det_id): r.iou for r in M.best_overlap(d, g, cell=cell).collect()}
    assert len(best) == len(dets)
    for i, j, _, b in dets:
        assert abs(best[i, j] - max([loops.iou(b, x) for x in boxes[i]], default=0.0)) < 1e-12


def test_average_precision_equals_loop(spark):
    dets, boxes = scene(3, images=25)
    d, g = frames(spark, dets, boxes)
    hits = M.true_positives(d, g)
    groups = (F.col("image_id") % 3).alias("grp")
    npos = g.groupBy(groups).agg(F.count(F.lit(1)).alias("npos"))
    out = D.average_precision(d.select("*", groups), hits.select("*", groups), npos, ["grp"])
    for r in out.collect():
        part = [x for x in dets if x[0] % 3 == r.grp]
        want = loops.average_precision(part, loops.match(part, boxes, 0.5), r.npos)
        assert abs(r.ap - want) < 1e-12


def test_average_precision_edges(spark):
    npos = spark.createDataFrame([("perfect", 2), ("none", 3), ("nobox", 0)], "grp string, npos long")
    d = spark.createDataFrame([("perfect", 1, 0, 0.9), ("perfect", 1, 1, 0.8), ("nobox", 2, 0, 0.5)], "grp string, image_id long, det_id long, score double")
    hits = d.where("grp = 'perfect'").withColumn("iou_threshold", F.lit(0.5))
    out = {r.grp: r.ap for r in D.average_precision(d, hits, npos, ["grp"]).collect()}
    assert out["perfect"] == pytest.approx(1.0)
    assert out["none"] == 0.0
    assert out["nobox"] is None


def test_group_summary_skips_undefined(spark):
    s = D.group_summary(spark.createDataFrame([("a", 0.2), ("b", 0.6), ("c", None)], "grp string, ap double")).first()
    assert (s.worst, s.groups) == (0.2, 2)
    assert s["mean"] == pytest.approx(0.4) and s.gap == pytest.approx(0.2)


def test_count_error(spark):
    images = spark.createDataFrame([(0,), (1,), (2,)], "image_id long")
    d = spark.createDataFrame([(0, 0.9), (0, 0.1), (1, 0.3), (1, 0.8)], "image_id long, score double")
    g = spark.createDataFrame([(0,), (1,)], "image_id long")
    r = D.count_error(images, d, g).first()
    assert r.images == 3 and r.count_mae == pytest.approx(1 / 3)
    assert r.count_corr == pytest.approx(np.corrcoef([1, 2, 0], [1, 1, 0])[0, 1])
    assert D.count_error(images, d.where("false"), g).first().count_corr is None


@pytest.mark.parametrize("together", [10**6, 12, 0])
def test_suppression_equals_loop(spark, together):
    """All pairs of an image at once, connected pieces of crowded images, and pieces in rounds."""
    rng = np.random.default_rng(5)
    dets = []
    for image in range(6):
        for j in range(int(rng.integers(1, 30))):
            x, y = rng.integers(0, 25, 2)
            w, h = (0, 5) if j % 9 == 8 else (10, 10)
            dets.append((image, j, float(rng.integers(0, 6)) / 6, (float(x), float(y), float(x + w), float(y + h))))
    d, _ = frames(spark, dets, {0: [(0.0, 0.0, 1.0, 1.0)]})
    kept = P.suppress(d, ["image_id"], 0.4, cell=16.0, together=together).collect()
    for image in range(6):
        assert {r.det_id for r in kept if r.image_id == image} == loops.suppress([x for x in dets if x[0] == image], 0.4)


def test_overlap_at_the_threshold_is_kept(spark):
    d = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, 2.0, 1.0), (0, 1, 0.8, 1.0, 0.0, 2.0, 1.0)], DET)
    assert P.suppress(d, ["image_id"], 0.5).count() == 2


def test_boxes(spark):
    one = spark.range(1)
    b = lambda *v: Box(*(F.lit(float(x)) for x in v))
    flipped = expand(b(10, 10, 5, 10), 2.0, F.lit(100), F.lit(100))
    r = one.select(*flipped.columns(), iou(b(0, 0, 2, 2), b(0, 0, 2, 2)).alias("same"), iou(b(0, 0, 1, 1), b(5, 5, 6, 6)).alias("apart")).first()
    assert (r.x1, r.y1, r.x2, r.y2) == (9.5, 9.5, 11.5, 11.5)
    assert (r.same, r.apart) == (1.0, 0.0)
    c = one.select(*crop_window(b(-5, 2.5, -1, 2.5), F.lit(10), F.lit(10)).columns()).first()
    assert (c.x1, c.y1, c.x2, c.y2) == (0, 2, 1, 3)
    offsets = lambda n: one.select(tile_offsets(F.lit(n), 64, 0.25)).first()[0]
    assert offsets(64) == [0] and offsets(50) == [0]
    assert offsets(150) == [0, 48, 86]
    assert offsets(160) == [0, 48, 96]


def test_seam_boxes_meet_across_tiles(spark):
    images = spark.createDataFrame([(0, 100, 60)], "image_id long, width int, height int")
    grid = P.tile_grid(images, 60, 0.25)
    assert grid.count() == 2 and grid.agg(F.max("x1")).first()[0] == 100
    dets = spark.createDataFrame(
        [(0, 0, 0, 0.9, 42.0, 10.0, 58.0, 20.0), (0, 1, 1, 0.8, 2.0, 10.0, 18.0, 20.0)],
        "image_id long, tile_id int, det_id long, score double, x1 double, y1 double, x2 double, y2 double",
    )
    kept = P.fuse_tiles(dets, grid, images, 0.5).collect()
    assert [(r.det_id, r.x1) for r in kept] == [(0, 42.0)]


def test_failure_images_fall_back_to_all(spark):
    d, g = frames(spark, [(0, 0, 0.9, (0.0, 0.0, 9.0, 9.0))], {0: [(0.0, 0.0, 9.0, 9.0)]})
    out = P.failure_images(d, g, M.true_positives(d, g), 3)
    assert [(r.image_id, r.fp, r.fn) for r in out.collect()] == [(0, 0, 0)]
    with pytest.raises(ValueError):
        P.failure_images(d, g, d, 1, prefer="x")


def test_precision_ranks_a_detection_once(spark, monkeypatch):
    """Ten thresholds take one row per detection in the ranking, not one more per hit."""
    ranked = []

    def spy(rows, *args, **kw):
        ranked.append(rows.count())
        return whole(rows, *args, **kw)

    whole = D.running_totals
    monkeypatch.setattr(D, "running_totals", spy)
    box = (0.0, 0.0, 10.0, 10.0)
    dets = spark.createDataFrame([(i, 1, "a", 1.0 - i / 10, *box) for i in range(4)] + [(0, 2, "a", 0.95, *box)],
                                 "image_id long, det_id long, grp string, score double, x1 double, y1 double, x2 double, y2 double")
    boxes = spark.createDataFrame([(i, i, "a", *box) for i in range(5)],
                                  "image_id long, gt_id long, grp string, x1 double, y1 double, x2 double, y2 double")
    levels = M.COCO_THRESHOLDS
    hits = M.true_positives(dets, boxes, levels, carry=["grp"])
    npos = boxes.groupBy("grp").agg(F.count("gt_id").alias("npos"))
    out = {r.iou_threshold: r.ap for r in D.average_precision(dets, hits, npos, ["grp"], levels).collect()}
    # hits at places 1, 3, 4 and 5 of five boxes: precision 1 up to recall 0.2, then 0.8
    assert ranked == [5] and set(out) == set(levels)
    assert all(abs(ap - (21 * 1.0 + 60 * 0.8) / 101) < 1e-9 for ap in out.values())
