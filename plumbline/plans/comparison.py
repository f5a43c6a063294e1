"""Queries that compare runs, resample, order and summarise."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.draws import draw_sql
from plumbline.operators import calibration as C
from plumbline.operators import detection as D
from plumbline.operators import matching as M
from plumbline.operators import reductions as L
from plumbline.operators import sampling as P
from plumbline.operators import significance as X
from plumbline.operators import summaries as R
from plumbline.plans import tables as T
from plumbline.plans.calibration import bins_sql, cands, ece_sql, stored_cands
from plumbline.plans.detection import ap_sql
from plumbline.plans.registry import query, r6
from plumbline.plans.tables import with_tables

_DIFFS = """
diffs AS (SELECT a.variant, a.seed, a.score, b.score AS base, a.score - b.score AS diff
          FROM reports a JOIN reports b ON a.seed = b.seed AND b.variant = 'click' WHERE a.variant <> 'click')
"""


def diffs(spark, sf_dir):
    """Score of every variant less that of the baseline, per seed."""
    return X.paired_differences(T.run_reports(spark, sf_dir), "variant", "click", ["seed"], "score")


@query("run_pairs", with_tables("reports", extra=_DIFFS, body="SELECT variant, seed, round(diff, 6) AS diff FROM diffs"))
def _pairs(spark, sf_dir):
    return diffs(spark, sf_dir).select("variant", "seed", r6("diff").alias("diff"))


@query(
    "sign_test",
    with_tables("reports", extra=_DIFFS, body="""
SELECT variant, n, wins, round(mean_diff, 6) AS mean_diff, round(p, 7) AS p_sign FROM (
  SELECT variant, count(*) AS n, count(*) FILTER (diff > 0) AS wins, avg(diff) AS mean_diff FROM diffs GROUP BY 1)
CROSS JOIN LATERAL (SELECT sum(factorial(n::int)::double / factorial(k::int)::double / factorial((n - k)::int)::double) / 2.0::double ** n AS p
                    FROM range(0, 50) r(k) WHERE k >= wins AND k <= n)"""),
)
def _sign(spark, sf_dir):
    out = X.sign_test(diffs(spark, sf_dir), ["variant"])
    return out.select("variant", "n", "wins", r6("mean_diff").alias("mean_diff"), F.round("p_sign", 7).alias("p_sign"))


@query(
    "wilcoxon",
    with_tables("reports", extra=_DIFFS + """,
ranked AS (SELECT variant, diff, row_number() OVER (PARTITION BY variant ORDER BY abs(diff)) AS r, count(*) OVER (PARTITION BY variant) AS n FROM diffs),
w AS (SELECT variant, any_value(n) AS n_used, coalesce(sum(r) FILTER (diff > 0), 0)::double AS w_plus FROM ranked GROUP BY 1)""",
    body="""
SELECT variant, n_used, w_plus, round(p, 7) AS p_wilcoxon FROM w CROSS JOIN LATERAL (
  SELECT avg((s >= w_plus)::int) AS p FROM (
    SELECT m, list_sum([CASE WHEN (m >> (i - 1)) & 1 = 1 THEN i ELSE 0 END FOR i IN range(1, 8)]) AS s FROM range(128) x(m)))"""),
)
def _wilcoxon(spark, sf_dir):
    out = X.wilcoxon(diffs(spark, sf_dir), ["variant"])
    return out.select("variant", "n_used", "w_plus", F.round("p_wilcoxon", 7).alias("p_wilcoxon"))


_BY_USER = """
WITH tops AS (SELECT event_type AS variant, user_id, floor(max(value) / 10)::bigint AS score FROM events GROUP BY ALL),
pairs AS (SELECT a.variant, a.user_id, a.score - b.score AS diff FROM tops a JOIN tops b ON b.user_id = a.user_id AND b.variant = 'click' WHERE a.variant <> 'click'),
sized AS (SELECT variant, abs(diff) AS size, count(*) AS c, count(*) FILTER (diff > 0) AS p FROM pairs WHERE diff <> 0 GROUP BY ALL),
mids AS (SELECT *, sum(c) OVER (PARTITION BY variant ORDER BY size) - (c - 1) / 2.0::double AS mid FROM sized),
w AS (SELECT variant, sum(c)::bigint AS n_used, sum(p * mid) AS w_plus, sum(c * c * c - c)::double AS ties FROM mids GROUP BY 1)
"""


def user_pairs(spark, sf_dir):
    """Best value of a user per kind of event in steps of ten, against that of clicks: many ties and zeros."""
    tops = T.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant"), "user_id").agg(
        F.floor(F.max("value") / 10).alias("score")
    )
    return X.paired_differences(tops, "variant", "click", ["user_id"], "score")


@query(
    "wilcoxon_normal",
    _BY_USER + """
SELECT variant, n_used, w_plus, round(0.5 - (z / 3000) * list_sum(list_transform(range(0, 3001),
         lambda i: (CASE WHEN i IN (0, 3000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5::double * ((z * i / 3000) ** 2)))) / 3 / sqrt(2 * pi()), 6) AS p_wilcoxon
FROM (SELECT *, (w_plus - n_used * (n_used + 1) / 4.0::double) / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24.0::double - ties / 48) AS z FROM w)""",
)
def _wilcoxon_normal(spark, sf_dir):
    out = X.wilcoxon(user_pairs(spark, sf_dir), ["variant"], method="normal")
    return out.select("variant", "n_used", "w_plus", r6("p_wilcoxon").alias("p_wilcoxon"))


@query(
    "wilcoxon_exact",
    with_tables("reports", extra=_DIFFS + """,
steps AS (SELECT variant, seed, (CASE WHEN diff < 0 THEN -1 ELSE 1 END) * ceil(abs(diff) / 2)::bigint AS d FROM diffs),
mids AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY abs(d)) + (count(*) OVER (PARTITION BY variant, abs(d)) - 1) / 2.0::double AS mid FROM steps WHERE d <> 0),
w AS (SELECT variant, count(*) AS n_used, coalesce(sum(mid) FILTER (d > 0), 0) AS w_plus, list(mid) AS mids FROM mids GROUP BY 1)""", body="""
SELECT variant, n_used, w_plus, round(avg((s >= w_plus)::int), 7) AS p_wilcoxon FROM (
  SELECT variant, n_used, w_plus, list_sum(list_transform(mids, lambda x, i: CASE WHEN (m >> (i - 1)::int) & 1 = 1 THEN x ELSE 0 END)) AS s
  FROM w CROSS JOIN (SELECT range AS m FROM range(128)) WHERE m < 1 << n_used::int) GROUP BY ALL"""),
)
def _wilcoxon_exact(spark, sf_dir):
    """Differences in steps of two, so that some tie: the law over all signs of the mid-ranks."""
    step = F.when(F.col("diff") < 0, -1).otherwise(1) * F.ceil(F.abs("diff") / 2)
    out = X.wilcoxon(diffs(spark, sf_dir).withColumn("diff", step), ["variant"], method="exact")
    return out.select("variant", "n_used", "w_plus", F.round("p_wilcoxon", 7).alias("p_wilcoxon"))


def picks_sql(clusters: str, draws: int, seed: int = 0) -> str:
    """Recursive SQL for the counts of blocks and the picks inside them: ``picked`` (grp, b, idx, w).

    ``clusters`` selects (grp, total), one row per key.
    """
    size, word = X.PICK_BLOCK, X.WORD
    bits = draw_sql(2 * seed + 1, "b", "node", "t", "j")
    ones = (
        f"list_sum(list_transform(range(0, (undecided + {word - 1}) // {word}), "
        f"lambda j: bit_count(({bits}) & ((1::bigint << least({word}, undecided - j * {word})::int) - 1))))"
    )
    return f"""
splits AS (
  SELECT grp, b, total::bigint AS total, 0::bigint AS low, ((total + {size - 1}) // {size})::bigint AS high, 1::bigint AS node,
         total::bigint AS m, 0::bigint AS lefts, total::bigint AS undecided,
         ((((total + {size - 1}) // {size}) // 2) * {size})::bigint AS rest, 0::bigint AS t
  FROM ({clusters}) CROSS JOIN (SELECT range AS b FROM range({draws}))
  UNION ALL
  SELECT grp, b, total,
    CASE WHEN NOT live AND side = 1 THEN mid ELSE low END, CASE WHEN NOT live AND side = 0 THEN mid ELSE high END,
    CASE WHEN live THEN node ELSE 2 * node + side END,
    CASE WHEN live THEN m ELSE part END,
    CASE WHEN NOT live THEN 0 WHEN up THEN lefts + undecided - ones ELSE lefts END,
    CASE WHEN NOT live THEN part WHEN up THEN ones ELSE undecided - ones END,
    CASE WHEN live THEN 2 * rest - up::bigint * whole WHEN side = 0 THEN ((mid - low) // 2) * {size} ELSE ((high - mid) // 2) * {size} END,
    CASE WHEN live THEN t + 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN side = 0 THEN lefts ELSE m - lefts END AS part, 2 * rest >= whole AS up,
               CASE WHEN live THEN {ones}::bigint ELSE 0 END AS ones
        FROM (SELECT *, (low + high) // 2 AS mid, least(high * {size}, total) - low * {size} AS whole,
                     undecided > 0 AND rest > 0 AS live FROM splits WHERE high - low > 1)
        CROSS JOIN (SELECT unnest([0, 1]) AS side) WHERE side = 0 OR NOT live)
),
picked AS (
  SELECT grp, b, low * {size} + ({draw_sql(2 * seed, "b", "low", "j")}) % least({size}, total - low * {size}) AS idx, count(*) AS w
  FROM (SELECT grp, b, total, low, unnest(range(0, m)) AS j FROM splits WHERE high - low = 1) GROUP BY ALL
)"""


@query(
    "paired_bootstrap",
    with_tables("reports", extra=_DIFFS + f""",
ix AS (SELECT variant AS grp, diff, row_number() OVER (PARTITION BY variant ORDER BY seed) - 1 AS idx FROM diffs),
{picks_sql("SELECT grp, count(*) AS total FROM ix GROUP BY grp", 10000)}""", recursive=True,
    body="""
SELECT variant, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM (
  SELECT grp AS variant, b, sum(diff * w) / sum(w) AS m FROM picked JOIN ix USING (grp, idx) GROUP BY ALL) GROUP BY variant"""),
)
def _paired_bootstrap(spark, sf_dir):
    out = X.mean_difference_interval(diffs(spark, sf_dir), ["variant"], "seed")
    return out.select("variant", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


_CELLS = bins_sql() + """,
cells AS (SELECT g AS grp, image_id, bin, count(*) AS n, sum(label) AS hits, sum(fused) AS conf
          FROM (SELECT *, unnest([grp, 'pooled']) AS g FROM cands)
          JOIN bins ON ((fused > lo OR (bin = 1 AND fused >= lo)) AND fused <= hi) GROUP BY ALL)
"""
_CI = """
SELECT grp, round(quantile_cont(ece, 0.025), 6) AS ci_low, round(quantile_cont(ece, 0.975), 6) AS ci_high FROM (
  SELECT grp, b, sum(abs(h - c)) / sum(n) AS ece FROM (
    SELECT grp, b, bin, sum(w * n) AS n, sum(w * hits) AS h, sum(w * conf) AS c FROM weighted GROUP BY ALL) GROUP BY ALL) GROUP BY grp
"""
BOOTSTRAP_DRAWS = 2000


@query(
    "cluster_bootstrap_ci",
    with_tables("cands", extra=_CELLS + f""",
cl AS (SELECT grp, image_id, row_number() OVER (PARTITION BY grp ORDER BY image_id) - 1 AS idx
       FROM (SELECT DISTINCT grp, image_id FROM cells)),
{picks_sql("SELECT grp, count(*) AS total FROM cl GROUP BY grp", BOOTSTRAP_DRAWS)},
weighted AS (SELECT p.grp, b, bin, w, n, hits, conf FROM picked p JOIN cl USING (grp, idx)
             JOIN cells ON cells.grp = cl.grp AND cells.image_id = cl.image_id)""", recursive=True, body=_CI),
)
def _bootstrap(spark, sf_dir):
    """Interval of the calibration error, resampling images, per group and pooled."""
    sums = C.bin_sums(cands(spark, sf_dir), ["grp", "image_id"], "fused")
    out = X.cluster_bootstrap(sums, [], "grp", "image_id", draws=BOOTSTRAP_DRAWS)
    return out.select("grp", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query(
    "cluster_bootstrap_poisson",
    with_tables("cands", extra=_CELLS + f""",
u AS (SELECT image_id, b, {draw_sql(0, "b", "image_id")} AS u FROM (SELECT DISTINCT image_id FROM cells) CROSS JOIN (SELECT range AS b FROM range({BOOTSTRAP_DRAWS}))),
w AS (SELECT image_id, b, {X.poisson_weight_sql("u")} AS w FROM u),
weighted AS (SELECT grp, b, bin, w, n, hits, conf FROM cells JOIN w USING (image_id) WHERE w > 0)""", body=_CI),
)
def _bootstrap_poisson(spark, sf_dir):
    sums = C.bin_sums(cands(spark, sf_dir), ["grp", "image_id"], "fused")
    out = X.cluster_bootstrap(sums, [], "grp", "image_id", draws=BOOTSTRAP_DRAWS, scheme="poisson")
    return out.select("grp", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query(
    "stratified_fraction",
    with_tables("images", body=f"""
SELECT image_id, camera, background FROM (
  SELECT *, row_number() OVER (PARTITION BY camera, background ORDER BY {draw_sql(3, "image_id")}, image_id) AS k,
         count(*) OVER (PARTITION BY camera, background) AS n FROM images)
WHERE k <= greatest(1, round_even(n * 0.25::double, 0)::bigint)"""),
)
def _stratified(spark, sf_dir):
    images = T.images(spark, sf_dir).select("image_id", "camera", "background")
    return P.stratified_fraction(images, ["camera", "background"], "image_id", 0.25, seed=3)


@query(
    "random_split",
    with_tables("images", body=f"""
SELECT image_id, CASE WHEN k <= floor(n * 0.6::double) THEN 'train' WHEN k <= floor(n * 0.6::double) + floor(n * 0.2::double) THEN 'val' ELSE 'test' END AS split
FROM (SELECT image_id, row_number() OVER (ORDER BY {draw_sql(5, "image_id")}, image_id) AS k, count(*) OVER () AS n FROM images)"""),
)
def _split(spark, sf_dir):
    return P.random_split(T.images(spark, sf_dir).select("image_id"), "image_id", seed=5)


_GROUPS = """
gs AS (SELECT background, size, row_number() OVER (ORDER BY background) - 1 AS no, count(*) OVER () AS g, sum(size) OVER ()::bigint AS total
       FROM (SELECT background, count(*) AS size FROM images GROUP BY 1))
"""


@query(
    "group_balanced_sample",
    with_tables("images", extra=_GROUPS + f""",
slots AS (SELECT i AS slot, ({draw_sql(7, "i")}) % (SELECT max(g) FROM gs) AS no, {draw_sql(8, "i")} AS d FROM range((SELECT count(*) FROM images)) x(i)),
ranked AS (SELECT background, image_id, row_number() OVER (PARTITION BY background ORDER BY image_id) AS k FROM images)""",
    body="""
SELECT slot, s.background, image_id FROM (SELECT slot, background, d % size + 1 AS k FROM slots JOIN gs USING (no)) s
JOIN ranked r ON r.background = s.background AND r.k = s.k"""),
)
def _balanced(spark, sf_dir):
    images = T.images(spark, sf_dir).select("image_id", "background")
    return P.group_balanced_sample(images, "background", "image_id", images.count(), seed=7)


_CYCLE = _GROUPS + f""",
cyc AS (SELECT *, unnest(range(0, ceil(ceil((total - no) / g) / size)::bigint)) AS cycle FROM gs),
dealt AS (SELECT c.*, image_id, row_number() OVER (PARTITION BY c.background, cycle ORDER BY {draw_sql(9, "cycle", "image_id")}, image_id) AS k
          FROM cyc c JOIN images i ON i.background = c.background),
ordered AS (SELECT * FROM (SELECT ((cycle * size + k - 1) * g + no)::bigint AS position, background, image_id, total FROM dealt) WHERE position < total)
"""


@query("group_cycle_order", with_tables("images", extra=_CYCLE, body="SELECT position, background, image_id FROM ordered"))
def _cycle(spark, sf_dir):
    images = T.images(spark, sf_dir).select("image_id", "background")
    return P.group_cycle_order(images, "background", "image_id", seed=9)


@query(
    "group_coverage",
    with_tables("images", "losses", extra=_CYCLE + """,
plain AS (SELECT 'as logged' AS name, example AS position, grp FROM losses UNION ALL SELECT 'cycled', position, background FROM ordered),
win AS (SELECT name, position // 8 AS w, count(DISTINCT grp) AS seen, any_value(gn) AS gn FROM plain
        JOIN (SELECT name, count(*) // 8 AS fw, count(DISTINCT grp) AS gn FROM plain GROUP BY 1) USING (name)
        WHERE position // 8 < fw GROUP BY ALL)""",
    body="SELECT name, count(*) AS windows, round(avg((seen = gn)::int), 6) AS coverage FROM win GROUP BY name"),
)
def _coverage(spark, sf_dir):
    """Share of sampling windows that see every group: file order and cycled order."""
    logged = T.loss_log(spark, sf_dir).select(F.col("example").alias("position"), "grp")
    images = T.images(spark, sf_dir).select("image_id", "background")
    cycled = P.group_cycle_order(images, "background", "image_id", seed=9)
    out = [
        P.group_coverage(order, group, 8, order.select(group).distinct().count()).withColumn("name", F.lit(name))
        for name, order, group in (("as logged", logged, "grp"), ("cycled", cycled, "background"))
    ]
    return out[0].unionByName(out[1]).select("name", "windows", r6("coverage").alias("coverage"))


@query(
    "loss_reduction",
    with_tables("losses", body="""
SELECT batch, round(any_value(plain), 6) AS plain, round(avg(m), 6) AS equalised FROM (
  SELECT l.batch, grp, avg(loss) AS m FROM losses l GROUP BY ALL)
JOIN (SELECT batch, avg(loss) AS plain FROM losses GROUP BY 1) USING (batch) GROUP BY batch"""),
)
def _losses(spark, sf_dir):
    log = T.loss_log(spark, sf_dir)
    plain = L.reduce_losses(log, "erm").withColumnRenamed("loss", "plain")
    equal = L.reduce_losses(log, "group_balanced").withColumnRenamed("loss", "equalised")
    return plain.join(equal, "batch").select("batch", r6("plain").alias("plain"), r6("equalised").alias("equalised"))


_DRO = """
gm AS (SELECT batch, grp, avg(loss) AS m FROM losses GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY batch) AS r FROM gm),
ema AS (SELECT grp, r, batch, m, m AS e FROM rk WHERE r = 1
        UNION ALL SELECT k.grp, k.r, k.batch, k.m, 0.9::double * p.e + (1 - 0.9::double) * k.m FROM ema p JOIN rk k ON k.grp = p.grp AND k.r = p.r + 1),
grid AS (SELECT b.batch, g.grp, e.m, last_value(e.e IGNORE NULLS) OVER (PARTITION BY g.grp ORDER BY b.batch) AS e
         FROM (SELECT DISTINCT batch FROM losses) b CROSS JOIN (SELECT DISTINCT grp FROM losses) g
         LEFT JOIN ema e ON e.batch = b.batch AND e.grp = g.grp),
wt AS (SELECT *, exp(0.01::double * e) / sum(exp(0.01::double * e)) OVER (PARTITION BY batch) AS w FROM grid WHERE e IS NOT NULL)
"""


@query(
    "dro_weights",
    with_tables("losses", extra=_DRO, recursive=True, body="SELECT batch, grp, round(e, 6) AS ema, round(w, 6) AS weight FROM wt"),
)
def _dro(spark, sf_dir):
    """Running group losses and the softmax weights they give, at every batch."""
    w = L.group_weights(T.loss_log(spark, sf_dir))
    return w.select("batch", "grp", r6("ema").alias("ema"), r6("weight").alias("weight"))


@query(
    "dro_loss",
    with_tables("losses", extra=_DRO, recursive=True, body="SELECT batch, round(sum(w * m), 6) AS loss FROM wt GROUP BY batch"),
)
def _dro_loss(spark, sf_dir):
    return L.reduce_losses(T.loss_log(spark, sf_dir), "group_dro").withColumn("loss", r6("loss"))


def nested_reports(spark, sf_dir):
    """Run reports as JSON texts, nested, with parts that are no numbers, and with torn ones between them."""
    whole = T.run_reports(spark, sf_dir).select(
        "variant",
        "seed",
        F.format_string(
            '{"detection": {"score": %s, "undefined": NaN, "per_group": {"a": %s, "b": %s}}, '
            '"p": {"q": {"r": {"s": {"t": {"u": %s}}}}}, "limits": [-Infinity, 1], "top": Infinity, "collapsed": false, "note": "x", "sizes": [1, 2], "n_rows": %s}',
            F.col("score").cast("string"), F.col("seed").cast("string"), (F.col("seed") * 2).cast("string"),
            (F.col("seed") * 3).cast("string"), F.col("n_rows").cast("string"),
        ).alias("report"),
    )
    torn = whole.withColumn("report", F.expr("substr(report, 1, length(report) - 1)"))
    return whole.unionByName(torn)


_FLAT = """
flat AS (SELECT variant, seed, unnest([
  {'metric': 'detection.score', 'value': score}, {'metric': 'detection.per_group.a', 'value': seed::double},
  {'metric': 'detection.per_group.b', 'value': seed * 2::double}, {'metric': 'p.q.r.s.t.u', 'value': seed * 3::double}, {'metric': 'n_rows', 'value': n_rows::double}], recursive := true) FROM reports)
"""


@query("flatten_reports", with_tables("reports", extra=_FLAT, body="SELECT variant, seed, metric, round(value, 6) AS value FROM flat"))
def _flatten(spark, sf_dir):
    flat = R.flatten_json(nested_reports(spark, sf_dir), ["variant", "seed"], "report")
    return flat.withColumn("value", r6("value"))


@query(
    "aggregate_seeds",
    with_tables("reports", extra=_FLAT, body="""
SELECT variant, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM flat GROUP BY ALL"""),
)
def _seeds(spark, sf_dir):
    flat = R.flatten_json(nested_reports(spark, sf_dir), ["variant", "seed"], "report")
    return R.aggregate_seeds(flat, ["variant"]).withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "report_keys",
    """
SELECT DISTINCT 'k' AS metric, event_type AS variant FROM events WHERE props LIKE '%"k"%'""",
)
def _keys(spark, sf_dir):
    """Metric names seen in the JSON properties of the events."""
    events = T.read(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), "props")
    return R.flatten_json(events, ["variant"], "props").select("metric", "variant").distinct()


@query(
    "variant_table",
    with_tables("reports", body="""
SELECT variant, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM (
  SELECT variant, 'score' AS metric, score AS value FROM reports UNION ALL SELECT variant, 'n_rows', n_rows::double FROM reports) GROUP BY ALL"""),
)
def _variants(spark, sf_dir):
    out = R.variant_table(T.run_reports(spark, sf_dir), "variant", ["score", "n_rows"])
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "metric_by_fraction",
    """SELECT event_type AS variant, round(avg(value) FILTER (user_id % 4 = 0), 6) AS "0.1", round(avg(value) FILTER (user_id % 4 = 1), 6) AS "0.25",
       round(avg(value) FILTER (user_id % 4 = 2), 6) AS "0.5", round(avg(value) FILTER (user_id % 4 = 3), 6) AS "1.0" FROM events GROUP BY 1""",
)
def _fractions(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("variant"), F.element_at(F.expr("array(0.1D, 0.25D, 0.5D, 1.0D)"), F.expr("int(user_id % 4) + 1")).alias("fraction"), "value"
    )
    wide = R.metric_by_fraction(rows, "variant", "fraction", "value", [0.1, 0.25, 0.5, 1.0])
    return wide.select("variant", *[r6(F.col(f"`{c}`")).alias(c) for c in ("0.1", "0.25", "0.5", "1.0")])


@query(
    "reducer_table",
    with_tables("reports", body="""
SELECT variant, count(*) AS runs, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
       count(*) FILTER (n_rows % 5 = 0) AS collapsed_runs,
       string_agg(seed || ':' || (n_rows % 5 = 0)::int, ',' ORDER BY seed) AS per_seed FROM reports GROUP BY variant"""),
)
def _reducers(spark, sf_dir):
    rows = T.run_reports(spark, sf_dir).withColumn("collapsed", F.col("n_rows") % 5 == 0)
    out = R.reducer_table(rows, "variant", "seed", "score", "collapsed")
    return out.select(
        "variant", "runs", r6("mean").alias("mean"), r6("std").alias("std"), "collapsed_runs",
        F.array_join(
            F.transform("per_seed", lambda s: F.concat(s["seed"].cast("string"), F.lit(":"), s["collapsed"].cast("int").cast("string"))), ","
        ).alias("per_seed"),
    )


_FOLDS = "folds AS (SELECT lang AS fold, avg((n_chars % 100) / 100.0::double) AS ap FROM documents GROUP BY 1)"


def folds(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    return docs.groupBy(F.col("lang").alias("fold")).agg(F.avg(F.expr("(n_chars % 100) / 100D")).alias("ap"))


@query(
    "fold_summary",
    f"WITH {_FOLDS} SELECT round(avg(ap), 6) AS mean, round(min(ap), 6) AS worst, round(max(ap) - min(ap), 6) AS max_gap, count(*) AS folds FROM folds",
)
def _fold_summary(spark, sf_dir):
    out = R.fold_summary(folds(spark, sf_dir), "ap")
    return out.withColumns({c: r6(c) for c in ("mean", "worst", "max_gap")})


@query(
    "cross_fold_pairs",
    f"""WITH {_FOLDS} SELECT a.fold AS source, b.fold AS target, round(a.ap, 6) AS source_value, round(b.ap, 6) AS target_value,
        round(a.ap - b.ap, 6) AS gap FROM folds a JOIN folds b ON a.fold <> b.fold""",
)
def _fold_pairs(spark, sf_dir):
    out = R.cross_fold_pairs(folds(spark, sf_dir), "fold", "ap")
    return out.withColumns({c: r6(c) for c in ("source_value", "target_value", "gap")})


@query(
    "subgroup_summary",
    with_tables("cands", extra=bins_sql(), body=f"""
SELECT grp, floor(avg(images))::bigint AS images, floor(avg(n))::bigint AS n, round(avg(ece), 6) AS ece FROM (
  SELECT run, grp, count(*) AS n, count(DISTINCT image_id) AS images FROM cands GROUP BY ALL)
JOIN ({ece_sql("run, grp", source="cands")}) USING (run, grp) GROUP BY grp"""),
)
def _subgroup_summary(spark, sf_dir):
    counts = C.candidate_counts(stored_cands(spark, sf_dir), ["run", "grp"], "fused")
    return R.mean_over_runs(counts, "grp", ["images", "n"], ["ece"]).withColumn("ece", r6("ece"))


_AXES = """
ax AS (SELECT o_orderkey AS image_id, unnest(['status:' || o_orderstatus, 'priority:' || o_orderpriority]) AS grp FROM orders),
aflags AS (SELECT f.* EXCLUDE (grp), ax.grp FROM flags f JOIN ax USING (image_id)),
aboxes AS (SELECT b.image_id, ax.grp FROM boxes b JOIN ax USING (image_id)),
acands AS (SELECT c.* EXCLUDE (grp), ax.grp FROM cands c JOIN ax USING (image_id)),
"""


@query(
    "replication_by_axis",
    with_tables("flags", "cands", extra=_AXES + ap_sql("grp", "aflags", boxes="aboxes") + "," + bins_sql(), body=f"""
SELECT key1 AS grp, round(ap, 6) AS ap, round(ece, 6) AS ece FROM ap JOIN ({ece_sql("grp", source="acands")}) e ON e.grp = key1"""),
)
def _axes(spark, sf_dir):
    """Average precision and calibration error along two metadata axes of the images."""
    orders = T.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.explode(F.array(F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("priority:"), "o_orderpriority"))).alias("grp"),
    )
    dets, gt = T.detections(spark, sf_dir).drop("grp"), T.boxes(spark, sf_dir).drop("grp")
    hits = M.true_positives(dets, gt).join(orders, "image_id")
    by_axis = gt.select("image_id").join(orders, "image_id").groupBy("grp").agg(F.count(F.lit(1)).alias("npos"))
    ap = D.average_precision(dets.join(orders, "image_id"), hits, by_axis, ["grp"])
    scored = cands(spark, sf_dir).drop("grp").join(orders, "image_id")
    ece = C.metrics(C.bin_sums(scored, ["grp"], "fused"), ["grp"])
    return ap.join(ece, "grp").select("grp", r6("ap").alias("ap"), r6("ece").alias("ece"))
