import numpy as np
import pytest

import loops
from plumbline.functions import scores as S
from plumbline.operators import calibration as C
from plumbline.operators import selective as R
from plumbline.operators.ranking import exact_quantiles, running_totals
from pyspark.sql import functions as F


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    conf = rng.integers(0, 61, n) / 60.0  # sits on the edges of 10, 15 and 20 bins
    y = (rng.random(n) < conf).astype(int)
    rows = [(i, int(i % 3), float(c), int(v)) for i, (c, v) in enumerate(zip(conf, y))]
    return rows, spark.createDataFrame(rows, "image_id long, grp int, fused double, label int")


@pytest.mark.parametrize("bins", [10, 15, 20])
def test_ece_on_bin_edges(spark, bins):
    rows, df = table(spark)
    got = C.metrics(C.bin_sums(df, [], "fused", bins=bins), []).first()
    conf, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    assert got.ece == pytest.approx(loops.ece(conf, y, np.linspace(0, 1, bins + 1)), abs=1e-12)
    assert got.brier == pytest.approx(np.mean((conf - y) ** 2))
    assert got.laece is None


def test_rows_without_a_bin_still_count(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, 1), (float("nan"), 0), (-0.1, 0)], "fused double, label int")
    got = C.metrics(C.bin_sums(df, [], "fused"), []).first()
    assert got.n == 4 and got.ece == pytest.approx(0.5 / 4)


def test_special_bins(spark):
    r = spark.range(1).select(*[S.width_bin(F.lit(v), 15).alias(f"c{i}") for i, v in enumerate((0.0, 1.0, 0.2, 1e-12))]).first()
    assert tuple(r) == (1, 15, 3, 1)


def test_binning_variants(spark):
    rows, df = table(spark, seed=2)
    out = {(r.grp, r.binning): r.ece for r in C.binning_robustness(df, [], "grp", "fused").collect()}
    for g in ("0", "1", "2", "pooled"):
        part = [r for r in rows if g == "pooled" or r[1] == int(g)]
        conf, y = np.array([r[2] for r in part]), np.array([r[3] for r in part], float)
        q = np.quantile(conf, np.linspace(0, 1, 11))
        q[0], q[-1] = 0.0, 1.0
        assert out[g, "mass 10"] == pytest.approx(loops.ece(conf, y, np.unique(q)), abs=1e-9)
        for w in (10, 15, 20):
            assert out[g, f"width {w}"] == pytest.approx(loops.ece(conf, y, np.linspace(0, 1, w + 1)), abs=1e-12)


def test_small_groups_do_not_decide_the_worst(spark):
    df = spark.createDataFrame([("a", 0.9, 0)] * 4 + [("b", 0.9, 1)] * 6, "grp string, fused double, label int").withColumn("run", F.lit(1)).withColumn("iou", F.lit(0.7))
    r = C.calibration_report(df, ["run"], "grp").first()
    assert r.groups_counted == 1 and set(r.per_group_ece) == {"b"}
    assert r.worst_group_ece == pytest.approx(0.1)


def test_reliability_lists_empty_bins(spark):
    df = spark.createDataFrame([(0.95, 1)], "fused double, label int").withColumn("k", F.lit(1))
    rows = C.reliability_curve(C.bin_sums(df, ["k"], "fused", bins=10), ["k"], 10).orderBy("bin").collect()
    assert [r.n for r in rows] == [0] * 9 + [1]
    assert rows[0].confidence == pytest.approx(0.05) and rows[0].accuracy == 0.0


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 9, 3000)), rng.integers(0, 40, 3000)))]
    df = spark.createDataFrame(rows, "k int, v double, i long")
    got = running_totals(df, ["k"], [F.col("v").desc(), F.col("i")], {"s": F.col("v")}).collect()
    for key in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r.k == key), key=lambda r: r["rank"])
        assert [r.i for r in mine] == [r[2] for r in part]
        assert [r.s for r in mine] == list(np.cumsum([r[1] for r in part]))
        assert {r.n for r in mine} == {len(part)}
    q = {(r.k, r.prob): r.quantile for r in exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    for (k, p), v in q.items():
        assert v == pytest.approx(np.quantile([r[1] for r in rows if r[0] == k], p))


def test_selective_figures(spark):
    rng = np.random.default_rng(4)
    n = 101
    conf, correct = rng.integers(0, 30, n) / 30.0, (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(1, i, float(c), int(k)) for i, (c, k) in enumerate(zip(conf, correct))], "run int, i long, confidence double, correct int")
    order = sorted(range(n), key=lambda i: (-conf[i], i))
    err = 1 - correct[order]
    ranked = R.error_ranking(df, ["run"], "confidence", "correct", ["i"])
    assert R.aurc(ranked, ["run"]).first().aurc == pytest.approx(np.mean(np.cumsum(err) / np.arange(1, n + 1)))
    risk = {r.coverage: r.risk for r in R.risk_at_coverage(ranked, ["run"], (1.0, 0.5, 0.001)).collect()}
    assert risk[0.5] == pytest.approx(err[: round(0.5 * n)].mean()) and risk[0.001] == err[0]
    f = R.failure_ranking(df, ["run"], "confidence", "correct").first()
    bad, good = conf[correct == 0], conf[correct == 1]
    wins = (bad[:, None] < good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert f.auroc == pytest.approx(wins)
    total, prev = 0.0, 0.0
    for c in np.unique(conf):
        recall, precision = (bad <= c).mean(), (bad <= c).sum() / (conf <= c).sum()
        total, prev = total + (recall - prev) * precision, recall
    assert f.auprc == pytest.approx(total)
    only = R.failure_ranking(df.withColumn("correct", F.lit(1)), ["run"], "confidence", "correct").first()
    assert only.auroc is None and only.auprc is None


def test_equal_recall(spark):
    rows = [(0, 0, 0.9, 0.2, 1), (0, 1, 0.8, 0.9, 0), (0, 2, 0.7, 0.8, 1), (0, 3, 0.6, 0.1, 0)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, p double, q double, label int")
    r = R.matched_recall(df.withColumn("k", F.lit(1)), ["k"], "p", "q").first()
    assert (r.target_tp, r.fp_reference, r.fp_alternative, r.delta_fp) == (2, 1, 1, 0)
    one = R.matched_recall(df.withColumn("k", F.lit(1)), ["k"], "p", "q", target=1).first()
    assert (one.fp_reference, one.fp_alternative) == (0, 1)
    assert R.matched_recall(df.withColumn("label", F.lit(0)).withColumn("k", F.lit(1)), ["k"], "p", "q").count() == 0


def test_logit_hygiene(spark):
    vals = [float("inf"), float("-inf"), float("nan"), 1e6, -1e6, 0.3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "z double").select(S.finite_logit(F.col("z"))).collect()]
    assert got == [50.0, -50.0, 0.0, 50.0, -50.0, 0.3]


def test_divergence_and_bands(spark):
    r = spark.range(1).select(
        S.js_divergence(F.lit(0.3), F.lit(0.3)).alias("same"), S.js_divergence(F.lit(0.0), F.lit(1.0)).alias("far"),
        S.in_mid_band(F.lit(0.2)).alias("edge"), S.decision_confidence(F.lit(0.25)).alias("c"),
    ).first()
    assert r.same == pytest.approx(0.0) and r.far == pytest.approx(np.log(2), abs=1e-6)
    assert r.edge is False and r.c == 0.5


def test_running_totals_over_many_ranges(spark):
    """One key of a million rows in 64 ranges."""
    from pyspark.sql import functions as F

    from plumbline.operators.ranking import running_totals

    rows = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id"))
    got = running_totals(rows, ["key"], [F.col("id")], {"total": F.col("id")}, rows_per_range=15_625)
    bad = got.where((F.col("rank") != F.col("id") + 1) | (F.col("n") != 1_000_000) | (F.col("total") != F.col("id") * (F.col("id") + 1) / 2))
    assert got.count() == 1_000_000 and bad.count() == 0


def test_draws_span_62_bits(spark):
    import numpy as np

    from plumbline.functions.draws import PRIMES, draw, draw_array

    ids = np.array([5, 5 + PRIMES[0], 5 + PRIMES[1]], np.int64)
    drawn = draw_array(1, ids)
    assert len(set(drawn.tolist())) == 3
    df = spark.createDataFrame([(int(i),) for i in ids], "i long")
    assert [r[0] for r in df.select(draw(1, df["i"])).collect()] == drawn.tolist()
    assert (draw_array(2, np.arange(1000)) % 4_000_000_000 > 2**31).mean() > 0.4


def test_sign_test_of_any_size(spark):
    import math

    from plumbline.operators.significance import _upper_tail
    from pyspark.sql import functions as F

    cases = [(n, k) for n in (1, 2, 7, 60) for k in range(n + 2)]
    df = spark.createDataFrame(cases + [(3_000_000_000, 1_500_000_000)], "n long, k long")
    got = {(r[0], r[1]): r[2] for r in df.select("n", "k", _upper_tail(F.col("n"), F.col("k"))).collect()}
    for n, k in cases:
        assert abs(got[n, k] - sum(math.comb(n, j) for j in range(k, n + 1)) / 2**n) < 1e-10, (n, k)
    assert abs(got[3_000_000_000, 1_500_000_000] - 0.5) < 1e-3


def test_as_many_tasks_as_ranges(spark):
    """A range has its own task also where the session shuffles into fewer partitions."""
    from plumbline.operators.ranking import running_totals

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        df = spark.range(4000).selectExpr("id % 2 AS k", "id AS v")
        out = running_totals(df, ["k"], [F.col("v").desc()], {"s": F.col("v")}, rows_per_range=250)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.k, r["rank"], r.n, r.v, r.s) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "_range#" in plan and ", 16), REPARTITION_BY_NUM" in plan
    want = []
    for k in (0, 1):
        total = 0
        for i, v in enumerate(range(3998 + k, -1, -2)):
            total += v
            want.append((k, i + 1, 2000, v, total))
    assert rows == want
