"""What steps move, beside their results: bytes shuffled and written, and the largest read of a task."""

import numpy as np
import pytest

from plumbline.operators import calibration as C
from plumbline.operators import selective as R
from plumbline.operators import suppression as P
from plumbline.operators.ranking import exact_quantiles, running_totals
from plumbline.session import materialize
from pyspark.sql import functions as F


class Moved:
    """Bytes that the stages inside a ``with`` block shuffled and wrote, and the most that one task read."""

    def __init__(self, spark):
        self.spark = spark
        self.store = spark.sparkContext._jsc.sc().statusStore()

    def stages(self):
        no_quantiles = self.spark.sparkContext._gateway.new_array(self.spark._jvm.double, 0)
        found = self.store.stageList(None, False, False, no_quantiles, None).iterator()
        while found.hasNext():
            yield found.next()

    def __enter__(self):
        self.before = max((s.stageId() for s in self.stages()), default=-1)
        return self

    def __exit__(self, *_):
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.bytes = self.task_read = 0
        for s in self.stages():
            if s.stageId() <= self.before:
                continue
            self.bytes += s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes()
            tasks = self.store.taskList(s.stageId(), s.attemptId(), 10_000).iterator()
            while tasks.hasNext():
                m = tasks.next().taskMetrics()
                if m.isDefined():
                    read = m.get().shuffleReadMetrics()
                    self.task_read = max(self.task_read, read.remoteBytesRead() + read.localBytesRead())


def scored(spark, n=200_000):
    """Stored rows of three groups with scores that hardly repeat."""
    return materialize(spark.range(n).selectExpr(
        "id % 3 AS grp", "id AS image_id", "id % 7 AS det_id", "rand(1) AS p", "rand(2) AS q",
        "int(rand(3) < 0.3) AS label", "rand(4) AS confidence", "int(rand(5) < 0.8) AS correct",
    ))


def odd_scores(spark, n=3000):
    rng = np.random.default_rng(8)
    levels = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -3.5, 1e308, -1e308, 1e-300, *np.round(rng.random(40), 3).tolist()]
    pick = lambda: levels[int(rng.integers(len(levels)))]
    rows = [(int(rng.integers(4)) or None, i, int(rng.integers(3)), pick(), pick(), int(rng.random() < 0.05), int(rng.random() < 0.7)) for i in range(n)]
    return spark.createDataFrame(rows, "grp int, image_id long, det_id long, p double, q double, label int, correct int")


def test_quantiles_on_odd_values(spark):
    df = odd_scores(spark).where("p IS NULL OR NOT isnan(p) AND abs(p) < 1e308")
    got = {(r.grp, r.prob): r.quantile for r in exact_quantiles(df, ["grp"], "p", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    rows = [r for r in df.collect() if r.p is not None]
    assert len(got) == 20
    for (grp, prob), value in got.items():
        assert value == pytest.approx(np.quantile([r.p for r in rows if r.grp == grp], prob))


def test_equal_mass_reads_are_shared_out(spark):
    """No task reads all rows of one group: edges go to the rows, and only rows near an edge are ranked."""
    df = scored(spark)
    with Moved(spark) as moved:
        assert C.binning_robustness(df, [], "grp", "p").count() == 16
    assert moved.task_read < 2_000_000  # the rows of the pool take more; sums per part take 1.3 MB


def test_equal_recall_on_odd_scores(spark):
    """The counts above the last hit are those of the whole ranking, also for scores that are no numbers."""
    df = odd_scores(spark)
    got = {r.grp: (r.target_tp, r.fp_reference, r.fp_alternative) for r in R.matched_recall(df, ["grp"], "p", "q").collect()}
    want = {}
    for i, c in enumerate("pq"):
        ranked = running_totals(df, ["grp"], [F.col(c).desc(), F.col("image_id"), F.col("det_id")], {"tp": F.col("label")})
        for r in ranked.where("label = 1 AND tp = tp_all").collect():
            want.setdefault(r.grp, [r.tp, None, None])[i + 1] = r["rank"] - r.tp
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == 4


def test_equal_recall_moves_few_bytes(spark):
    df = scored(spark)
    with Moved(spark) as moved:
        rows = R.matched_recall_table(df, [], "grp", reference="p", alternative="q").collect()
    assert {r.grp for r in rows} == {"0", "1", "2", "all"}
    assert moved.bytes < 400_000  # the rows alone take more than 4 MB


def test_risk_by_coverage_on_odd_scores(spark):
    df = odd_scores(spark)
    keep = (1.0, 0.95, 0.5, 0.0001)
    tie = ["image_id", "det_id"]
    want = R.risk_at_coverage(R.error_ranking(df, ["grp"], "p", "correct", tie), ["grp"], keep).collect()
    got = R.risk_by_coverage(df, ["grp"], "p", "correct", tie, keep).collect()
    key = lambda rows: sorted((str(r.grp), r.coverage, r.risk) for r in rows)
    assert key(got) == key(want) and len(got) == 16
    same = df.withColumn("p", F.lit(0.25))  # all rows in one part
    assert key(R.risk_by_coverage(same, ["grp"], "p", "correct", tie, keep).collect()) == key(
        R.risk_at_coverage(R.error_ranking(same, ["grp"], "p", "correct", tie), ["grp"], keep).collect()
    )


def test_risk_by_coverage_moves_few_bytes(spark):
    df = scored(spark)
    with Moved(spark) as moved:
        got = R.risk_by_coverage(df, ["grp"], "confidence", "correct", ["image_id", "det_id"]).collect()
    assert len(got) == 12
    assert moved.bytes < 2_000_000  # all rows written and shuffled take more than 8 MB


def test_tiles_from_the_size_alone(spark):
    """The regular grid needs no table of tiles, and the input of a suppression is worked out once."""
    images = spark.range(60).selectExpr("id AS image_id", "int(50 + id * 7) AS width", "int(90 + id % 5 * 40) AS height")
    dets = spark.range(4000).selectExpr(
        "id % 60 AS image_id", "id AS det_id", "int(id % 13 - 1) AS tile_id", "double(id * 7919 % 1009) AS score",
        "double(id * 31 % 50) AS x1", "double(id * 17 % 50) AS y1", "double(id * 31 % 50 + id % 9 * 4) AS x2", "double(id * 17 % 50 + 20) AS y2",
    )
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    watched = dets.mapInPandas(counted, dets.schema)
    key = lambda df: sorted(map(tuple, df.collect()))
    got = key(P.fuse_tiles(watched, (60, 0.25), images, 0.5))
    assert seen.value == 4000
    assert got == key(P.fuse_tiles(dets, P.tile_grid(images, 60, 0.25), images, 0.5)) and 500 < len(got) < 4000
    assert sum(r[-2] == r[-4] for r in got) > 50  # boxes without area stay


def test_models_are_fitted_on_blocks(spark):
    """A round reads few whole blocks on all cores, and sends one row per model to be added up."""
    from plumbline.operators import grouping as G

    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (2500, 6)) for c in (-3.0, 0.0, 3.0)])
    rows = spark.createDataFrame([(p.tolist(), float(i % 3)) for i, p in enumerate(points)], "v array<double>, w double").coalesce(1)
    blocks = G._blocks(rows, "v", ["w"])
    packed = blocks.collect()
    x = np.concatenate([np.frombuffer(b.x, "<f8").reshape(-1, 6) for b in packed])
    w = np.concatenate([np.frombuffer(b.w, "<f8") for b in packed])
    assert sorted(map(tuple, np.column_stack([x, w]))) == sorted((*p, float(i % 3)) for i, p in enumerate(points))
    assert 4 <= len(packed) <= 8 and len(blocks.inputFiles()) == 4
    (plain, cost), (weighed, _) = G.fit_together(rows, "v", [(3, 0, None), (3, 1, "w")])
    gaps = ((points[:, None, :] - plain[None]) ** 2).sum(axis=2)
    own = gaps.argmin(axis=1)
    assert cost == pytest.approx(gaps.min(axis=1).sum())
    assert np.allclose(plain, [points[own == j].mean(axis=0) for j in range(3)], atol=1e-2)
    near = ((points[:, None, :] - weighed[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(weighed, [np.average(points[near == j], axis=0, weights=(np.arange(7500) % 3)[near == j]) for j in range(3)], atol=1e-2)


def test_archived_images_are_those_of_loose_files(spark, tmp_path):
    """Many small images lie in few files, with the same sizes, problems and pixels as loose files."""
    from plumbline.sources import images as I

    rng = np.random.default_rng(5)
    made = []
    for i in range(40):
        raw = I.bitmap(rng.integers(0, 256, (1 + i % 5, 1 + i % 7, 3), dtype=np.uint8))
        made.append((f"s{i % 3}/{i}.bmp", raw[: 20 if i % 9 == 0 else len(raw) - 1 if i % 9 == 1 else len(raw)]))
    rows = spark.createDataFrame(made, "name string, content binary").repartition(2)
    loose, packed = str(tmp_path / "loose"), str(tmp_path / "packed")
    I.write_files(rows, loose)
    assert I.write_archives(rows, packed, members=12).count() == 4
    told = lambda df: sorted((r.split, r.stem, r.ext, r.width, r.height, r.problem) for r in df.collect())
    files = I.archived(spark, packed)
    got = told(I.described(files))
    assert len(got) == 40 and [str(g) for g in got] == [str(g) for g in told(I.image_files(spark, f"{loose}/*/*"))]
    whole = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in files.collect() if len(r.content) > 20}
    seen = spark.read.format("image").option("dropInvalid", True).load(f"{loose}/*/*").select("image.*")
    pixels = lambda df: {r.origin.rsplit("/", 1)[1]: (r.height, r.width, bytes(r.data)) for r in df.collect()}
    mine, theirs = pixels(I.decoded(files)), pixels(seen)
    assert mine == {k: v for k, v in theirs.items() if k in mine} and len(mine) >= 30 and set(mine) <= set(whole)


def test_lines_of_draws_are_single_draws():
    from plumbline.functions.draws import DrawLines, draw_array

    rng = np.random.default_rng(4)
    b, node, first = (rng.integers(0, 1 << n, 70) for n in (12, 40, 33))
    lines = DrawLines(5, b, node, first=first)
    for length in (1, 100, 300, 1500):
        single = draw_array(5, b[:, None], node[:, None], first[:, None] + np.arange(length))
        assert (lines.whole(slice(0, 70), length) == single).all()
        assert (lines.low_bits(slice(9, 70), length, 10) == single[9:] % 1024).all()


def test_picks_of_a_block_are_single_draws():
    """Keys share their picks, and each has as many of them as fall on its block."""
    from plumbline.functions.draws import draw_array
    from plumbline.operators import significance as X

    replicates = np.arange(70)
    for block, size in ((3, X.PICK_BLOCK), (9, 700)):
        counts = np.random.default_rng(block).integers(0, 90, (3, 70)) + np.array([[0], [900], [1000]])
        for rows, weights in X.picked(block, size, replicates, counts, 6):
            for key, w in enumerate(weights):
                for b, got in zip(replicates[rows], w, strict=True):
                    single = draw_array(12, np.array([b]), np.array([block]), np.arange(counts[key, b])) % size
                    assert (got == np.bincount(single, minlength=size)).all()


def test_bootstrap_reads_once_and_is_dealt_out(spark):
    """The sums are worked out once, and no task splits the picks of all replicates or weighs all blocks."""
    from plumbline.operators import significance as X

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    sums = spark.range(40_000).selectExpr("string(id % 2) AS grp", "id AS image_id", "int(id % 15 + 1) AS bin", "1L AS n", "double(id % 3 % 2) AS hits", "0.3D AS conf")
    with Moved(spark) as moved:
        got = X.cluster_bootstrap(sums.mapInPandas(counted, sums.schema), [], "grp", "image_id", 200).collect()
        tasks = [s.numTasks() for s in moved.stages() if s.stageId() > moved.before]
    assert {r.grp for r in got} == {"0", "1", "pooled"} and seen.value == 40_000
    assert sum(n >= 12 for n in tasks) >= 2  # 3 keys of 4 batches of replicates; 40 blocks


def test_masks_travel_by_their_sample(spark):
    """Boxes, masks and truth go to their sample once; bands of lines and steps along them stay there."""
    from plumbline.operators import masks as K

    boxes = materialize(spark.range(60_000).selectExpr(
        "id % 6000 AS sample", "concat('b', id div 6000 % 2) AS backend", "double(id * 7919 % 401) AS x1", "double(id * 104729 % 397) AS y1",
        "double(id * 7919 % 401 + 20 + id % 31) AS x2", "double(id * 104729 % 397 + 20 + id % 29) AS y2",
    ))
    samples, keys = boxes.select("sample", "backend").distinct(), ["sample", "backend"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of size are not sent whole
    with Moved(spark) as moved:
        drawn, covered = K.bands_of_boxes((boxes, keys), (boxes.where("x1 < 200").drop("backend"), ["sample"]))
        masks = materialize(K.overlay(drawn, keys))
        assert 0 < K.dice(masks, K.overlay(covered), samples).agg(F.avg("dice")).first()[0] < 1
        assert K.consensus(masks, samples).agg(F.sum("x1")).first()[0] > 60_000
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved.bytes < 17_000_000  # three times as many where bands and steps are dealt out anew


def test_odd_names_of_masks(spark):
    """Samples and backends without a name, listed twice or without any mask keep their rows."""
    from plumbline.operators import masks as K

    masks = spark.createDataFrame([(1, "a", 0, 0, 4), (1, None, 0, 0, 9), (None, "a", 0, 0, 9), (2, "a", 0, 0, 4), (4, "a", 0, 0, 2)], "sample int, backend string, y long, x0 long, x1 long")
    truth = spark.createDataFrame([(1, 0, 2, 6), (None, 0, 0, 9), (3, 0, 0, 5)], "sample int, y long, x0 long, x1 long")
    samples = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (None, "a"), (3, "a"), (5, "a")], "sample int, backend string")
    got = {(r["sample"], r.backend): r.dice for r in K.dice(masks, truth, samples).collect()}
    assert got == {(1, "a"): 0.5, (1, None): 0.0, (2, "b"): 1.0, (None, "a"): 1.0, (3, "a"): 0.0, (5, "a"): 1.0}
    agreed = K.consensus(masks, samples)
    assert sorted((r["sample"], r.x0, r.x1) for r in agreed.collect()) == [(1, 0, 9), (2, 0, 4)]


def test_figures_of_one_ranking(spark, monkeypatch):
    """One ranking gives the figures of the three, also where levels are cut by many ranges and values are odd."""
    from plumbline.operators import ranking

    monkeypatch.setattr(ranking.running_totals, "__defaults__", (37, False, None))
    tie, keep = ["image_id", "det_id"], (1.0, 0.95, 0.5, 0.0001)
    odd = odd_scores(spark).where("grp IS NOT NULL")
    for df in (odd, odd.withColumn("p", F.lit(0.25)), odd.withColumn("correct", F.lit(1)), odd.withColumn("p", F.round("q", 1))):
        df = materialize(df)
        got = {r.grp: r for r in R.ranking_figures(df, ["grp"], "p", "correct", tie, keep).collect()}
        ranked = R.error_ranking(df, ["grp"], "p", "correct", tie)
        areas = {r.grp: (r.auroc, r.auprc) for r in R.failure_ranking(df, ["grp"], "p", "correct").collect()}
        aurc = {r.grp: r.aurc for r in R.aurc(ranked, ["grp"]).collect()}
        risk = {(r.grp, r.coverage): r.risk for r in R.risk_at_coverage(ranked, ["grp"], keep).collect()}
        assert len(got) == 3
        for grp, r in got.items():
            assert [r.auroc, r.auprc] == [None if x is None else pytest.approx(x, rel=1e-9) for x in areas[grp]]
            assert r.aurc == pytest.approx(aurc[grp]) and r.risk == {c: risk[grp, c] for c in keep}


def test_selective_report_moves_rows_twice(spark):
    """Rows are ranked once for all figures and never dealt by their few keys."""
    from plumbline.plans import composite as K

    df = scored(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    with Moved(spark) as moved:
        rows = K.selective_report(df.withColumn("disagreement", F.col("q") / 2), ["grp"], fused="p").collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 3 and all(len(r.risk) == 4 for r in rows)
    assert moved.bytes < 18_000_000  # twice as many where three rankings are made


def test_undefined_sums_are_left_out_of_their_block(spark):
    """A sum that is null counts as none for its block, bin and value; the other values of the row stay."""
    from plumbline.operators import significance as X

    rows = [("g", i, i % 3 + 1 if i % 5 else None, 1.0, None if i % 5 == 0 else 0.5) for i in range(300)]
    cells = spark.createDataFrame(rows, "grp string, image_id long, bin int, n double, conf double")
    got = X._resample_sums(cells, ["grp"], "image_id", ["n", "conf"], 4, 0).collect()
    assert sorted((r.bin or 0, r.b) for r in got) == [(k, b) for k in range(4) for b in range(4)]
    assert all((r.conf is None) == (r.bin is None) and r.n > 0 for r in got)
    assert all(sum(r.n for r in got if r.b == b) == 300 for b in range(4))
