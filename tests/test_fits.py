import itertools
import math

import numpy as np
import pytest

from plumbline.functions.draws import draw, draw_array
from plumbline.operators import calibration as C
from plumbline.operators import fusion as Fu
from plumbline.operators import grouping as G
from plumbline.operators import reductions as L
from plumbline.operators import sampling as P
from plumbline.operators import significance as X
from plumbline.operators import summaries as R
from pyspark.sql import functions as F


def test_draws_agree_and_spread(spark):
    got = [r[0] for r in spark.range(2000).select(draw(3, F.col("id"), F.col("id") * 7)).collect()]
    i = np.arange(2000)
    assert got == list(draw_array(3, i, i * 7))
    counts = np.bincount(np.array(got) % 10, minlength=10)
    assert counts.min() > 140 and counts.max() < 260


def test_sign_and_signed_rank(spark):
    df = spark.createDataFrame([("win", i, 0.1 * (i + 1)) for i in range(7)] + [("mixed", i, d) for i, d in enumerate((0.5, -0.1, 0.3, 0.0, -0.4, 0.2))], "k string, seed int, diff double")
    s = {r.k: r for r in X.sign_test(df, ["k"]).collect()}
    assert (s["win"].n, s["win"].wins) == (7, 7) and s["win"].p_sign == pytest.approx(0.0078125)
    assert s["mixed"].p_sign == pytest.approx(sum(math.comb(6, j) for j in range(3, 7)) / 64)
    w = {r.k: r for r in X.wilcoxon(df, ["k"]).collect()}
    assert w["win"].p_wilcoxon == pytest.approx(0.0078125)
    assert (w["mixed"].n_used, w["mixed"].w_plus) == (5, 10.0)  # a zero drops out, so the normal form
    assert w["mixed"].p_wilcoxon == pytest.approx(0.5 * math.erfc((10 - 7.5) / math.sqrt(5 * 6 * 11 / 24) / math.sqrt(2)))
    few = X.wilcoxon(df.where("seed < 4"), ["k"]).collect()
    assert all(r.p_wilcoxon is None for r in few)


def test_signed_rank_is_exact(spark):
    d = [0.3, -0.1, 0.7, 0.2, -0.5, 0.9, 1.1, -0.05]
    df = spark.createDataFrame([(1, float(x)) for x in d], "k int, diff double")
    r = X.wilcoxon(df, ["k"]).first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = ranks[np.array(d) > 0].sum()
    sums = [sum(c) for c in itertools.product(*[(0, i) for i in range(1, 9)])]
    assert r.w_plus == w and r.p_wilcoxon == pytest.approx(np.mean(np.array(sums) >= w))


def test_signed_rank_with_ties(spark):
    """The exact law over all signs of the mid-ranks; zeros drop out."""
    d = [0.5, -0.5, 0.5, 1.0, -2.0, 2.0, 3.0, 0.0, 4.0]
    df = spark.createDataFrame([(1, float(x)) for x in d] + [(2, 1.0)] * 3, "k int, diff double")
    out = {r.k: r for r in X.wilcoxon(df, ["k"], method="exact", at_least=3).collect()}
    ranks = [2, 2, 2, 4, 5.5, 5.5, 7, 8]
    w = 2 + 2 + 4 + 5.5 + 7 + 8
    sums = [sum(c) for c in itertools.product(*[(0, r) for r in ranks])]
    assert out[1].w_plus == w and out[1].n_used == 8
    assert out[1].p_wilcoxon == pytest.approx(np.mean(np.array(sums) >= w))
    assert out[2].p_wilcoxon == pytest.approx(1 / 8)
    usual = X.wilcoxon(df, ["k"]).where("k = 1").first().p_wilcoxon
    assert usual != pytest.approx(out[1].p_wilcoxon) and usual == pytest.approx(out[1].p_wilcoxon, abs=0.03)


def test_long_series_of_pairs(spark):
    df = spark.range(400).select(F.lit(1).alias("k"), (F.pmod(F.col("id") * 37, F.lit(101)) - 45.5).alias("diff"))
    s = X.sign_test(df, ["k"]).first()
    exact = sum(math.comb(400, j) for j in range(s.wins, 401)) / 2**400
    assert s.p_sign == pytest.approx(exact, rel=1e-9)
    low = X.sign_test(df.withColumn("diff", -F.col("diff")), ["k"]).first()
    assert low.p_sign == pytest.approx(sum(math.comb(400, j) for j in range(low.wins, 401)) / 2**400, rel=1e-9)


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i // 4), "a", float(c), int(rng.random() < c)) for i, c in enumerate(rng.random(800))]
    df = spark.createDataFrame(rows, "image_id long, grp string, fused double, label int")
    sums = C.bin_sums(df, ["grp", "image_id"], "fused")
    point = C.metrics(C.bin_sums(df, [], "fused"), []).first().ece
    ci = {s: {r.grp: r for r in X.cluster_bootstrap(sums, [], "grp", "image_id", 200, scheme=s).collect()} for s in ("resample", "poisson")}
    for s in ci:
        assert set(ci[s]) == {"a", "pooled"} and ci[s]["a"].ci_low == pytest.approx(ci[s]["pooled"].ci_low)
        assert 0 <= ci[s]["a"].ci_low < ci[s]["a"].ci_high < 4 * point
    assert ci["resample"]["a"].ci_low == pytest.approx(ci["poisson"]["a"].ci_low, abs=0.02)
    assert ci["resample"]["a"].ci_high == pytest.approx(ci["poisson"]["a"].ci_high, abs=0.02)
    with pytest.raises(ValueError):
        X.cluster_bootstrap(sums, [], "grp", "image_id", scheme="x")


def test_block_counts_are_multinomial():
    """Counts add up, have the mean and spread of fair picks, and depend on the replicate alone."""
    total, size = 1000, 64
    counts = X.block_counts(total, np.arange(4000), 3, size)
    widths = np.array([64] * 15 + [40])
    assert counts.shape == (4000, 16) and (counts.sum(axis=1) == total).all() and (counts >= 0).all()
    share = widths / total
    assert np.abs(counts.mean(axis=0) - widths).max() < 5 * np.sqrt(widths.max() / 4000)
    assert counts.var(axis=0) == pytest.approx(total * share * (1 - share), rel=0.12)
    together = np.corrcoef(counts[:, 0], counts[:, 9])[0, 1]
    assert together == pytest.approx(-share[0] / (1 - share[0]), abs=0.06)
    assert (X.block_counts(total, np.array([7, 3999]), 3, size) == counts[[7, 3999]]).all()
    assert (X.block_counts(total, np.arange(50), 4, size) != counts[:50]).any()
    assert (X.block_counts(40, np.arange(3), 3, size) == 40).all()


def test_binomial_against_its_law():
    n = 60_000
    m, share, whole = np.full(n, 9), np.full(n, 3), np.full(n, 7)
    got = np.bincount(X._binomial(m, share, whole, 5, np.arange(n), np.ones(n, np.int64)), minlength=10) / n
    want = [math.comb(9, k) * (3 / 7) ** k * (4 / 7) ** (9 - k) for k in range(10)]
    assert got == pytest.approx(want, abs=0.01)
    many = X._binomial(np.full(300, 100_000), np.full(300, 1), np.full(300, 2), 5, np.arange(300), np.ones(300, np.int64))
    assert many.mean() == pytest.approx(50_000, abs=60) and many.std() == pytest.approx(158, rel=0.2)


def test_resampling_over_several_blocks(spark):
    """Five thousand pairs: the interval is that of the normal law, whatever the partitions."""
    rng = np.random.default_rng(1)
    d = rng.normal(0.3, 1.0, 5000)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(d)], "k long, seed long, diff double")
    r = X.mean_difference_interval(df, ["k"], "seed", draws=1000).first()
    half = 1.96 * d.std() / np.sqrt(5000)
    assert r.ci_low == pytest.approx(d.mean() - half, abs=0.004) and r.ci_high == pytest.approx(d.mean() + half, abs=0.004)
    again = X.mean_difference_interval(df.repartition(5), ["k"], "seed", draws=1000).first()
    assert again.ci_low == pytest.approx(r.ci_low) and again.ci_high == pytest.approx(r.ci_high)


def test_cycle_order(spark):
    df = spark.createDataFrame([(i, "abc"[0 if i < 13 else 1 if i < 15 else 2]) for i in range(16)], "id long, g string")
    out = P.group_cycle_order(df, "g", "id", seed=1).orderBy("position").collect()
    assert [r.position for r in out] == list(range(16))
    assert [r.g for r in out] == ["abc"[i % 3] for i in range(16)]
    by = {g: [r.id for r in out if r.g == g] for g in "abc"}
    assert set(by["b"][:2]) == {13, 14} and set(by["b"][2:4]) == {13, 14} and set(by["c"]) == {15}
    assert len(set(by["a"])) == len(by["a"])
    cover = P.group_coverage(spark.createDataFrame(out), "g", 3, 3).first()
    assert (cover.windows, cover.coverage) == (5, 1.0)


def test_fractions_and_splits(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 2 + F.when(F.col("id") > 100, 5).otherwise(0)).alias("g"))
    out = P.stratified_fraction(df, ["g"], "id", 0.25, seed=1)
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    kept = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert kept == {g: max(1, round(n * 0.25)) for g, n in sizes.items()}
    split = {r.split: r["count"] for r in P.random_split(df, "id").groupBy("split").count().collect()}
    assert split == {"train": 61, "val": 20, "test": 22}
    picks = P.group_balanced_sample(df, "g", "id", 4000, seed=2)
    assert picks.count() == 4000
    shares = [r["count"] / 4000 for r in picks.groupBy("g").count().collect()]
    assert len(shares) == len(sizes) and all(abs(s - 1 / len(sizes)) < 0.05 for s in shares)


def test_moving_average_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = np.random.default_rng(0)
    rows = [(int(b), int(b * 2 + j), "abc"[int(rng.choice(3, p=[0.7, 0.25, 0.05]))], float(rng.random())) for b in range(150) for j in range(2)]
    df = spark.createDataFrame(rows, "batch long, example long, grp string, loss double")
    got = {(r.batch, r.grp): r for r in L.group_weights(df, 0.5, 0.9).collect()}
    losses = {r.batch: r.loss for r in L.reduce_losses(df, "group_dro", 0.5, 0.9).collect()}
    ema = {}
    for b in range(150):
        means = {g: np.mean([r[3] for r in rows if r[0] == b and r[2] == g]) for g in {r[2] for r in rows if r[0] == b}}
        for g, m in means.items():
            ema[g] = 0.9 * ema[g] + 0.1 * m if g in ema else m
        w = {g: math.exp(0.5 * e) for g, e in ema.items()}
        total = sum(w.values())
        assert {g for bb, g in got if bb == b} == set(ema)
        for g in ema:
            assert got[b, g].ema == pytest.approx(ema[g], abs=1e-12) and got[b, g].weight == pytest.approx(w[g] / total)
        assert losses[b] == pytest.approx(sum(w[g] / total * m for g, m in means.items()))
    with pytest.raises(ValueError):
        L.reduce_losses(df, "nope")
    assert L.reduce_losses(df, "last_layer_retrain").count() == 150


def logits(spark, n=600):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    z = (2 * y - 1) * 1.5 + rng.normal(size=n) * 2
    v = (2 * y - 1) * 0.8 + rng.normal(size=n)
    rows = [(float(a * 3), float(b), int(c), int(i % 3)) for i, (a, b, c) in enumerate(zip(z, v, y))]
    return rows, spark.createDataFrame(rows, "det_logit double, ver_logit double, label int, group_id int")


def test_temperature_minimises_the_loss(spark):
    rows, df = logits(spark)
    t = Fu.Temperature.fit(df, "det_logit", "label").temperature
    z, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    loss = lambda s: np.mean(np.logaddexp(0, z / s) - y * z / s)
    assert t > 0 and loss(t) <= min(loss(t * 1.001), loss(t / 1.001))


def test_isotonic_is_monotone_and_clips(spark):
    rows, df = logits(spark)
    cal = Fu.Isotonic.fit(df, "det_logit", "label")
    probe = spark.createDataFrame([(float("-inf"), 0), (-1.0, 0), (0.5, 0), (99.0, 0), (float("nan"), 0)], "det_logit double, label int")
    p = [r.p for r in cal.apply(probe, "det_logit", "p").collect()]
    assert all(0 <= x <= 1 for x in p) and p[0] <= p[1] <= p[2] <= p[3]
    x, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float)
    order = np.argsort(x)
    blocks = []
    for v in y[order]:
        blocks.append([v, 1.0])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    want = np.concatenate([[m] * int(w) for m, w in blocks])
    got = cal.apply(df, "det_logit", "p").orderBy("det_logit").select("p").collect()
    assert np.allclose([r.p for r in got], want, atol=1e-9)


def test_logistic_fusion_equals_newton(spark):
    rows, df = logits(spark)
    fusion = Fu.Fusion.fit(df, "temperature", "logistic", groups=3)
    out = fusion.apply(df).select("p_det", "p_ver", "disagreement", "group_id", "label", "fused").collect()
    x = np.array([[r.p_det, r.p_ver, r.disagreement, *(float(r.group_id == g) for g in range(3)), 1.0] for r in out])
    y = np.array([r.label for r in out], float)
    w, penalty = np.zeros(7), np.diag([1.0] * 6 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    assert np.allclose([r.fused for r in out], 1 / (1 + np.exp(-x @ w)), atol=1e-4)
    with pytest.raises(ValueError):
        Fu.fit_calibrator("x", df, "det_logit", "label")
    with pytest.raises(ValueError):
        Fu.Fusion.fit(df, model="x")


def test_non_finite_inputs_stay_finite(spark):
    rows, df = logits(spark, 200)
    bad = df.withColumn("det_logit", F.when(F.col("group_id") == 0, F.lit(float("inf"))).when(F.col("group_id") == 1, F.lit(float("nan"))).otherwise(F.col("det_logit")))
    out = Fu.Fusion.fit(bad.withColumn("s", F.lit(float("nan"))), "isotonic", groups=3, shape=["s"]).apply(bad.withColumn("s", F.lit(float("nan"))))
    lo, hi = out.agg(F.min("fused"), F.max("fused")).first()
    assert 0 <= lo <= hi <= 1


def test_collapse_guard(spark):
    runs = spark.createDataFrame([("ok",), ("one",), ("none",)], "run string")
    bank = spark.createDataFrame([("ok", 0), ("ok", 1), ("one", 0)], "run string, label int")
    out = {r.run: r for r in Fu.collapse_guard(runs, bank, ["run"]).collect()}
    assert (out["ok"].collapsed, out["one"].collapsed, out["none"].collapsed) == (False, True, True)
    assert out["none"].n_candidates == 0 and out["ok"].reason is None


def test_adjusted_rand(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    same = np.equal.outer(a, a)[np.triu_indices(60, 1)], np.equal.outer(b, b)[np.triu_indices(60, 1)]
    ab, pa, pb, n = (same[0] & same[1]).sum(), same[0].sum(), same[1].sum(), len(same[0])
    want = (ab - pa * pb / n) / ((pa + pb) / 2 - pa * pb / n)
    assert G.adjusted_rand(G.contingency(df, "a", "b")).first().ari == pytest.approx(want)
    assert G.adjusted_rand(G.contingency(df, "a", "a")).first().ari == pytest.approx(1.0)


def test_reference_scores(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(45, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r], int(i % 2)) for i, r in enumerate(v)], "vec_id long, vec array<double>, positive int")
    bank = G.memory_bank(df.where("vec_id < 40"), "vec_id", "vec")
    out = {r.vec_id: r.ver_logit for r in G.memory_bank_score(df, bank, "vec").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u[:40].T
    for i in range(45):
        assert out[i] == pytest.approx(5 * (sim[i, 1::2].max() - sim[i, 0::2].max()), abs=1e-6)
    assert G.memory_bank(df, "vec_id", "vec", rows=20, per_class=3).count() == 6
    empty = G.memory_bank_score(df, bank.where("positive = 0"), "vec").agg(F.max(F.abs("ver_logit"))).first()[0]
    assert empty == 0.0
    few = G.class_prototypes(df.where("vec_id < 6 OR positive = 0"), "vec_id", "vec", k=8)
    assert {r.positive: r["count"] for r in few.groupBy("positive").count().collect()} == {0: 8, 1: 8}
    assert G.prototype_score(df, few, "vec").where("ver_logit IS NULL").count() == 0


def test_style_groups_and_sweep(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=2) * 0.2 + 5 * np.array([i % 3, (i % 3) ** 2]))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = G.StyleGroups(["a", "b"], k=3, restarts=3).fit(df.where("id < 60")).label(df)
    assert G.adjusted_rand(G.contingency(out.withColumn("t", F.col("id") % 3), "background", "t")).first().ari == pytest.approx(1.0)
    sweep = {r.k: r for r in G.cluster_count_sweep(df, ["a", "b"], [2, 3], "id", resamples=2, restarts=2).collect()}
    assert sweep[3].chosen and sweep[3].smallest == 30 and sweep[3].ari_mean == pytest.approx(1.0)
    assert sweep[3].inertia < sweep[2].inertia and sweep[3].ch > sweep[2].ch and sweep[3].db < sweep[2].db
    # figures against plain NumPy for three clear groups
    x = np.array([r[1:] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    own = np.arange(90) % 3
    mean = np.stack([z[own == c].mean(axis=0) for c in range(3)])
    assert sweep[3].inertia == pytest.approx(((z - mean[own]) ** 2).sum())
    far = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)
    apart = np.stack([far[:, own == c].sum(axis=1) / ((own == c).sum() - (own == c)) for c in range(3)], axis=1)
    inside = apart[np.arange(90), own]
    apart[np.arange(90), own] = np.inf
    outside = apart.min(axis=1)
    assert sweep[3].silhouette == pytest.approx(((outside - inside) / np.maximum(outside, inside)).mean())


def test_models_fitted_together_are_those_fitted_alone(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(200, 5))
    df = spark.createDataFrame([([float(v) for v in x], float(i % 3)) for i, x in enumerate(data)], "v array<double>, w0 double")
    models = [(3, 1, None), (4, 2, None), (3, 1, "w0")]
    together = G.fit_together(df, "v", models)
    for model, (centres, cost) in zip(models, together):
        ((alone, own),) = G.fit_together(df.repartition(3), "v", [model])
        assert np.allclose(centres, alone) and cost == pytest.approx(own)
        best, _ = G._nearest(data, centres)
        weight = np.arange(200) % 3 if model[2] else np.ones(200)
        means = np.stack([(data[best == c] * weight[best == c, None]).sum(axis=0) / weight[best == c].sum() for c in range(model[0])])
        assert np.abs(means - centres).max() < 0.02
    with pytest.raises(RuntimeError):
        G.fit_together(df, "v", [(4, 2, None)], rounds=1, tolerance=0.0)


def test_flatten_and_aggregate(spark):
    df = spark.createDataFrame([(0, '{"a": {"b": 1, "c": {"d": 0.5}}, "ok": true, "s": "t", "n": NaN}'), (1, '{"a": {"b": 2}}')], "seed int, report string")
    flat = R.flatten_json(df, ["seed"], "report")
    assert {(r.seed, r.metric, r.value) for r in flat.collect()} == {(0, "a.b", 1.0), (0, "a.c.d", 0.5), (1, "a.b", 2.0)}
    agg = {r.metric: r for r in R.aggregate_seeds(flat).collect()}
    assert (agg["a.b"]["mean"], agg["a.b"]["std"], agg["a.b"].n) == (1.5, 0.5, 2) and agg["a.c.d"].n == 1


def test_draws_without_division():
    """Arrays get the integers of the plain arithmetic, at the ends of the ranges, too."""
    from plumbline.functions import draws as D

    def plain(seed, *parts):
        halves = []
        for k in (0, 1):
            p = D.PRIMES[k]
            v = (D._start(seed, k) + sum(x % p * w for x, w in zip(parts, D.WEIGHTS[k]))) % p
            halves.append(pow(pow(v, 3, p) + D.SHIFTS[k], 3, p))
        return halves[0] * D.PRIMES[1] + halves[1]

    ends = [0, 1, D.PRIMES[1] - 1, D.PRIMES[0] - 1, D.PRIMES[0], (1 << 31) - 1, 1 << 31, (1 << 62) - 1]
    a, b = np.array(ends)[:, None], np.array(ends)[None, :]
    got = D.draw_array(5, a, b, a, b)
    assert [[int(v) for v in row] for row in got] == [[plain(5, x, y, x, y) for y in ends] for x in ends]
    assert int(D.draw_array(0, np.array(7))) == plain(0, 7)


def test_poisson_weights_are_drawn_once_for_a_cluster(spark, monkeypatch):
    """Weights agree with the cuts, and pooled sums do not draw them again."""
    from plumbline.functions.draws import RANGE, draw_array

    ids = np.array([0, 3, 1 << 40])
    u = draw_array(4, np.arange(300)[None, :], ids[:, None])
    assert (X.poisson_weights(4, 300, ids) == np.searchsorted(np.array(X._poisson_cuts()), u, side="right")).all()
    rows = [(i, g, b, 1 + i % 2, float(i % 3 == 0), 0.1) for i in range(200) for g in ("a", None) for b in (None, 1, 7)]
    sums = spark.createDataFrame(rows, "image_id long, grp string, bin int, n long, hits double, conf double")
    plan = X._poisson_sums(sums, ["grp"], "image_id", 50, 1)
    got = {(r.grp, r.bin, r.b): (r.n, r.hits) for r in plan.groupBy("grp", "bin", "b").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()}
    w = X.poisson_weights(1, 50, np.arange(200))
    assert len(got) == 300
    for (g, b, k), (n, hits) in got.items():
        assert n == pytest.approx(sum(w[i, k] * (1 + i % 2) for i in range(200)))
        assert hits == pytest.approx(sum(w[i, k] * (i % 3 == 0) for i in range(200)))
    per_task = plan.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) <= 6 * 50 * len(per_task)
    assert RANGE > u.max()


@pytest.mark.parametrize("name", ["isotonic_calibration", "isotonic_scores", "calibrate_then_fuse"])
def test_detections_are_matched_once(spark, monkeypatch, name):
    """Fits and what comes after them read written candidates: no plan but the one written matches boxes."""
    from plumbline.plans import QUERIES, models

    seen = []
    written = models.materialize
    monkeypatch.setattr(models, "materialize", lambda df: seen.append(df) or written(df))
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "lineitem" in " ".join(seen[0].inputFiles())
    assert not any("lineitem" in f for f in out.inputFiles())
