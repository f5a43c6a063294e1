"""Queries on candidate scores: calibration, selective prediction, equal recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.operators import calibration as C
from plumbline.operators import matching as M
from plumbline.operators import selective as R
from plumbline.plans import tables as T
from plumbline.plans.registry import query, r6
from plumbline.plans.tables import with_tables
from plumbline.session import materialize

_BINS = """
bins AS (SELECT i + 1 AS bin, i * (1.0::double / {n}) AS lo,
                CASE WHEN i = {n} - 1 THEN 1.0::double ELSE (i + 1) * (1.0::double / {n}) END AS hi FROM range({n}) x(i))
"""
# candidates once per group and once under the name 'pooled'
_POOL = """
pool AS (SELECT * FROM cands UNION ALL SELECT * REPLACE ('pooled' AS grp) FROM cands)
"""
_IN_BIN = "(({c} > lo OR (bin = 1 AND {c} >= lo)) AND {c} <= hi)"


def bins_sql(n: int = 15, name: str = "bins") -> str:
    return _BINS.format(n=n).replace("bins AS", f"{name} AS", 1)


def ece_sql(keys: str, conf: str = "fused", source: str = "pool", bins: str = "bins") -> str:
    return f"""
SELECT {keys}, sum(abs(sy - sc)) / sum(n) AS ece, sum(abs(sc - sl)) / sum(n) AS laece FROM (
  SELECT {keys}, bin, count(*) AS n, sum({conf}) AS sc, sum(label) AS sy, sum(label * iou) AS sl
  FROM {source} JOIN {bins} ON {_IN_BIN.format(c=conf)} GROUP BY ALL) GROUP BY ALL"""


def cands(spark, sf_dir):
    return T.candidates(spark, sf_dir)


def stored_cands(spark, sf_dir):
    """Candidates as a written table, for reports that read them more than once."""
    return materialize(cands(spark, sf_dir).drop("x1", "y1", "x2", "y2", "gt_id"))


@query(
    "candidate_bank",
    with_tables(
        "cands", "boxes",
        body="""
SELECT origin, grp, label, count(*) AS n, round(sum(iou), 6) AS iou_sum, count(det_logit) AS with_logit,
       round(sum(det_logit), 4) AS logit_sum
FROM (SELECT 'det' AS origin, grp, label, iou,
             CASE WHEN score <= 0 THEN -20 WHEN score >= 1 THEN 20
                  ELSE least(greatest(ln(score / (1 - score)), -20), 20) END AS det_logit FROM cands
      UNION ALL SELECT 'gt', grp, 1, 1.0, NULL FROM boxes)
GROUP BY ALL""",
    ),
)
def _bank(spark, sf_dir):
    """Detections labelled by best overlap, plus every ground-truth box as a positive."""
    det = M.label_candidates(T.best(spark, sf_dir)).withColumn("det_logit", S.logit(F.col("score")))
    bank = M.with_truth_positives(det, T.boxes(spark, sf_dir))
    return bank.groupBy("origin", "grp", "label").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.sum("iou")).alias("iou_sum"),
        F.count("det_logit").alias("with_logit"),
        F.round(F.sum("det_logit"), 4).alias("logit_sum"),
    )


@query(
    "subgroup_metrics",
    with_tables(
        "cands",
        extra=_POOL + "," + bins_sql(),
        body=f"""
SELECT run, grp, n, round(ece, 6) AS ece, round(laece, 6) AS laece, round(brier, 6) AS brier, round(nll, 6) AS nll
FROM (SELECT run, grp, count(*) AS n, avg((fused - label) ** 2) AS brier,
             -avg(label * ln(least(greatest(fused, 1e-9), 1 - 1e-9))
                  + (1 - label) * ln(1 - least(greatest(fused, 1e-9), 1 - 1e-9))) AS nll
      FROM pool GROUP BY ALL)
JOIN ({ece_sql("run, grp")}) USING (run, grp)""",
    ),
)
def _subgroup(spark, sf_dir):
    sums = C.bin_sums(cands(spark, sf_dir), ["run", "grp"], "fused", iou="iou")
    m = C.metrics(C.with_pooled(sums, ["run"], "grp"), ["run", "grp"])
    return m.select("run", "grp", "n", *[r6(c).alias(c) for c in ("ece", "laece", "brier", "nll")])


@query(
    "ece_by_group",
    with_tables("cands", extra=bins_sql(), body=f"SELECT grp, round(ece, 6) AS ece FROM ({ece_sql('grp', source='cands')})"),
)
def _ece(spark, sf_dir):
    m = C.metrics(C.bin_sums(cands(spark, sf_dir), ["grp"], "fused"), ["grp"])
    return m.select("grp", r6("ece").alias("ece"))


@query(
    "laece_matched",
    with_tables(
        "flags",
        extra=bins_sql(),
        body=f"""
SELECT grp, round(laece, 6) AS laece FROM (
  {ece_sql("grp", conf="score", source="(SELECT grp, score, tp AS label, iou FROM flags)")})""",
    ),
)
def _laece_matched(spark, sf_dir):
    """Localisation-aware error with one-to-one labels, as in the detection report."""
    flagged = M.flag_matches(T.detections(spark, sf_dir), T.boxes(spark, sf_dir))
    m = C.metrics(C.bin_sums(flagged, ["grp"], "score", "tp", "iou"), ["grp"])
    return m.select("grp", r6("laece").alias("laece"))


@query(
    "reliability_curve",
    with_tables(
        "cands",
        extra=bins_sql(),
        body=f"""
SELECT g.grp, b.bin, round(coalesce(c, (lo + hi) / 2), 6) AS confidence, round(coalesce(a, 0), 6)::double AS accuracy,
       coalesce(n, 0) AS n
FROM (SELECT DISTINCT grp FROM cands) g CROSS JOIN bins b
LEFT JOIN (SELECT grp, bin, avg(fused) AS c, avg(label) AS a, count(*) AS n
           FROM cands JOIN bins ON {_IN_BIN.format(c="fused")} GROUP BY ALL) q
  ON q.grp = g.grp AND q.bin = b.bin""",
    ),
)
def _reliability(spark, sf_dir):
    sums = C.bin_sums(cands(spark, sf_dir), ["grp"], "fused")
    return C.reliability_curve(sums, ["grp"]).select(
        "grp", "bin", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"), "n"
    )


@query(
    "stage_decomposition",
    with_tables(
        "cands",
        extra=_POOL + "," + bins_sql(),
        body=" UNION ALL ".join(
            f"SELECT run, grp, '{c}' AS stage, round(ece, 6) AS ece FROM ({ece_sql('run, grp', conf=c)})"
            for c in ("p_det", "p_ver", "fused")
        ),
    ),
)
def _stages(spark, sf_dir):
    out = C.stage_decomposition(cands(spark, sf_dir), ["run"], "grp", ["p_det", "p_ver", "fused"])
    return out.withColumn("ece", r6("ece"))


@query(
    "binning_robustness",
    with_tables(
        "cands",
        extra=_POOL + "," + ",".join(bins_sql(n, f"bins{n}") for n in (10, 15, 20)) + """,
quant AS (SELECT grp, unnest(quantile_cont(fused, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM pool GROUP BY grp),
ends AS (SELECT grp, e FROM quant UNION SELECT DISTINCT grp, 0.0::double FROM pool UNION SELECT DISTINCT grp, 1.0::double FROM pool),
mass AS (SELECT grp AS g, e AS lo, lead(e) OVER (PARTITION BY grp ORDER BY e) AS hi,
                row_number() OVER (PARTITION BY grp ORDER BY e) AS bin FROM ends)""",
        body=" UNION ALL ".join(
            f"SELECT grp, 'width {n}' AS binning, round(ece, 6) AS ece FROM ({ece_sql('grp', bins=f'bins{n}')})"
            for n in (10, 15, 20)
        )
        + f" UNION ALL SELECT grp, 'mass 10', round(ece, 6) FROM ({ece_sql('grp', bins='mass').replace('ON ((', 'ON g = grp AND ((')})",
    ),
)
def _robust(spark, sf_dir):
    out = C.binning_robustness(stored_cands(spark, sf_dir), [], "grp", "fused")
    return out.select("grp", "binning", r6("ece").alias("ece"))


@query(
    "calibration_report",
    with_tables(
        "cands",
        extra=_POOL + "," + bins_sql(),
        body=f"""
SELECT run, any_value(n) FILTER (grp = 'pooled') AS n,
       round(any_value(ece) FILTER (grp = 'pooled'), 6) AS ece, round(any_value(brier) FILTER (grp = 'pooled'), 6) AS brier,
       round(any_value(laece) FILTER (grp = 'pooled'), 6) AS laece,
       count(*) FILTER (grp <> 'pooled' AND n >= 5) AS groups_counted,
       round(max(ece) FILTER (grp <> 'pooled' AND n >= 5), 6) AS worst_group_ece
FROM (SELECT run, grp, count(*) AS n, avg((fused - label) ** 2) AS brier FROM pool GROUP BY ALL)
JOIN ({ece_sql("run, grp")}) USING (run, grp) GROUP BY run""",
    ),
)
def _report(spark, sf_dir):
    out = C.calibration_report(cands(spark, sf_dir), ["run"], "grp")
    return out.select("run", "n", *[r6(c).alias(c) for c in ("ece", "brier", "laece", "worst_group_ece")], "groups_counted")


@query(
    "candidate_counts",
    with_tables(
        "cands",
        extra=bins_sql(),
        body=f"""
SELECT run, grp, n, images, positives, round(positives / n, 6) AS positive_rate, round(ece, 6) AS ece
FROM (SELECT run, grp, count(*) AS n, count(DISTINCT image_id) AS images, sum(label)::bigint AS positives FROM cands GROUP BY ALL)
JOIN ({ece_sql("run, grp", source="cands")}) USING (run, grp)""",
    ),
)
def _counts(spark, sf_dir):
    out = C.candidate_counts(stored_cands(spark, sf_dir), ["run", "grp"], "fused")
    return out.select(
        "run", "grp", "n", "images", "positives", r6("positive_rate").alias("positive_rate"), r6("ece").alias("ece")
    )


@query(
    "bin_occupancy",
    with_tables(
        "cands",
        extra=bins_sql(),
        body=f"""
SELECT run, grp, count(*) FILTER (n > 0) AS occupied_bins, count(*) FILTER (n = 1) AS bins_with_one,
       coalesce(floor(median(n) FILTER (n > 0)), 0)::bigint AS median_occupied,
       string_agg(n::varchar, ',' ORDER BY bin) AS counts
FROM (SELECT g.run, g.grp, b.bin, coalesce(q.n, 0) AS n
      FROM (SELECT DISTINCT run, grp FROM cands) g CROSS JOIN bins b
      LEFT JOIN (SELECT run, grp, bin, count(*) AS n FROM cands JOIN bins ON {_IN_BIN.format(c="p_ver")} GROUP BY ALL) q
        ON q.run = g.run AND q.grp = g.grp AND q.bin = b.bin)
GROUP BY run, grp""",
    ),
)
def _occupancy(spark, sf_dir):
    return C.bin_occupancy(cands(spark, sf_dir), ["run", "grp"], "p_ver").withColumn(
        "counts", F.array_join(F.col("counts").cast("array<string>"), ",")
    )


@query(
    "fp_at_threshold",
    with_tables(
        "cands",
        body="""
SELECT run, negatives, fp_before, fp_after, round((fp_before - fp_after) / greatest(1, fp_before), 6) AS fp_reduction,
       round(rejected / greatest(1, negatives), 6) AS negatives_rejected
FROM (SELECT run, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 0 AND p_det >= 0.5) AS fp_before,
             count(*) FILTER (label = 0 AND fused >= 0.5) AS fp_after,
             count(*) FILTER (label = 0 AND fused < 0.5) AS rejected FROM cands GROUP BY run)""",
    ),
)
def _fp(spark, sf_dir):
    out = C.false_positive_effect(cands(spark, sf_dir), ["run"], "p_det", "fused")
    return out.withColumns({c: r6(c) for c in ("fp_reduction", "negatives_rejected")})


_JS = """
js AS (
  SELECT *, CASE WHEN (fused >= 0.5) = (label = 1) THEN 1 ELSE 0 END AS correct,
         (p * ln(p / m) + (1 - p) * ln((1 - p) / (1 - m)) + q * ln(q / m) + (1 - q) * ln((1 - q) / (1 - m))) / 2 AS dis
  FROM (SELECT *, (p + q) / 2 AS m FROM (
    SELECT *, least(greatest(p_det, 1e-9), 1 - 1e-9) AS p, least(greatest(p_ver, 1e-9), 1 - 1e-9) AS q FROM cands))),
conf AS (SELECT *, abs(fused - 0.5) * 2 - dis / ((SELECT max(dis) FROM js) + 1e-9) AS confidence FROM js)
"""


def referred(spark, sf_dir):
    """Candidates with disagreement, decision correctness and referral confidence."""
    df = stored_cands(spark, sf_dir).select(
        "run", "grp", "image_id", "det_id", "label", "fused",
        S.js_divergence(F.col("p_det"), F.col("p_ver")).alias("dis"),
        S.is_correct(F.col("fused"), F.col("label")).alias("correct"),
    )
    return R.referral_score(df, "fused", "dis")


@query(
    "referral_summary",
    with_tables(
        "cands", extra=_JS,
        body="""
SELECT grp, round(avg(dis), 6) AS mean_dis, round(min(confidence), 6) AS min_conf, round(avg(confidence), 6) AS mean_conf,
       count(*) FILTER (p_det > 0.2 AND p_det < 0.8) AS mid_band, round(avg(correct), 6) AS accuracy
FROM conf GROUP BY grp""",
    ),
)
def _referral(spark, sf_dir):
    df = R.referral_score(
        stored_cands(spark, sf_dir).withColumn("dis", S.js_divergence(F.col("p_det"), F.col("p_ver"))), "fused", "dis"
    )
    return df.groupBy("grp").agg(
        r6(F.avg("dis")).alias("mean_dis"),
        r6(F.min("confidence")).alias("min_conf"),
        r6(F.avg("confidence")).alias("mean_conf"),
        F.count(F.when(S.in_mid_band(F.col("p_det")), 1)).alias("mid_band"),
        r6(F.avg(S.is_correct(F.col("fused"), F.col("label")))).alias("accuracy"),
    )


_RANKED = _JS + """,
ranked AS (SELECT grp, sum(1 - correct) OVER w AS errors, row_number() OVER w AS k, count(*) OVER (PARTITION BY grp) AS n
           FROM conf WINDOW w AS (PARTITION BY grp ORDER BY confidence DESC, image_id, det_id ROWS UNBOUNDED PRECEDING))
"""


@query(
    "risk_coverage",
    with_tables(
        "cands", extra=_RANKED,
        body="""
SELECT grp, c::double AS coverage, round(errors / k, 6) AS risk
FROM ranked JOIN (VALUES (1.0), (0.95), (0.9), (0.8)) v(c) ON k = greatest(1, round_even(n * c::double, 0)::bigint)""",
    ),
)
def _risk(spark, sf_dir):
    risk = R.risk_by_coverage(referred(spark, sf_dir), ["grp"], "confidence", "correct", ["image_id", "det_id"])
    return risk.withColumn("risk", r6("risk"))


@query(
    "aurc",
    with_tables("cands", extra=_RANKED, body="SELECT grp, round(avg(errors / k), 6) AS aurc FROM ranked GROUP BY grp"),
)
def _aurc(spark, sf_dir):
    ranked = R.error_ranking(referred(spark, sf_dir), ["grp"], "confidence", "correct", ["image_id", "det_id"])
    return R.aurc(ranked, ["grp"]).withColumn("aurc", r6("aurc"))


@query(
    "failure_auroc",
    with_tables(
        "cands", extra=_JS + """,
lv AS (SELECT grp, confidence AS c, sum(1 - correct)::double AS bad, sum(correct)::double AS good FROM conf GROUP BY ALL),
cu AS (SELECT *, sum(bad) OVER w AS b, sum(good) OVER w AS g, sum(bad) OVER (PARTITION BY grp) AS ba,
              sum(good) OVER (PARTITION BY grp) AS ga FROM lv WINDOW w AS (PARTITION BY grp ORDER BY c))""",
        body="""
SELECT grp, round(sum(bad * (ga - g + good / 2)) / any_value(ba * ga), 6) AS auroc,
       round(sum(bad * b / (b + g)) / any_value(ba), 6) AS auprc FROM cu GROUP BY grp""",
    ),
)
def _failure(spark, sf_dir):
    out = R.failure_ranking(referred(spark, sf_dir), ["grp"], "confidence", "correct")
    return out.select("grp", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query(
    "fp_matched_recall",
    with_tables(
        "cands",
        extra="""
pool AS (SELECT * FROM cands UNION ALL SELECT * REPLACE ('all' AS grp) FROM cands),
long AS (SELECT grp, 0 AS curve, p_det AS s, label, image_id, det_id FROM pool
         UNION ALL SELECT grp, 1, fused, label, image_id, det_id FROM pool),
cum AS (SELECT grp, curve, label, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp,
               sum(label) OVER (PARTITION BY grp, curve) AS tot, count(*) OVER (PARTITION BY grp, curve) AS n FROM long
        WINDOW w AS (PARTITION BY grp, curve ORDER BY s DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT grp, tot::bigint AS target_tp, min(fp) FILTER (curve = 0)::bigint AS fp_reference,
               min(fp) FILTER (curve = 1)::bigint AS fp_alternative
        FROM cum WHERE tp = tot AND tot > 0 AND n >= 5 GROUP BY grp, tot)""",
        body="""
SELECT grp, target_tp, fp_reference, fp_alternative, fp_alternative - fp_reference AS delta_fp,
       round((fp_alternative - fp_reference) / greatest(1, fp_reference), 6) AS relative FROM pts""",
    ),
)
def _matched(spark, sf_dir):
    out = R.matched_recall_table(stored_cands(spark, sf_dir), [], "grp", reference="p_det", alternative="fused")
    return out.withColumn("relative", r6("relative"))
