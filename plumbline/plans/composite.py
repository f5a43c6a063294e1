"""Reports a user asks for in one call, each made of several operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.operators import audit as A
from plumbline.operators import calibration as C
from plumbline.operators import detection as D
from plumbline.operators import matching as M
from plumbline.operators import neardup as N
from plumbline.operators import selective as R
from plumbline.operators import significance as X
from plumbline.session import materialize


def leakage_report(images: DataFrame, max_distance: int = 4) -> DataFrame:
    """One row: exact leaks (contents in several splits), near leaks (id pairs), clean flag.

    ``images`` needs image_id, split, content.
    """
    # contents are read once, for both kinds of hash
    prints = materialize(
        images.select(
            "image_id", "split",
            A.content_hash(F.col("content")).alias("digest"), N.fingerprint_of(F.col("content")).alias("fingerprint"),
        )
    )
    exact = A.cross_split_leaks(prints).agg(F.count(F.lit(1)).alias("exact_leaks"))
    near = N.near_leaks(prints, max_distance)
    return exact.withColumn("near_leaks", near.scalar()).withColumn(
        "clean", (F.col("exact_leaks") == 0) & (F.col("near_leaks") == 0)
    )


def corpus_audit(
    images: DataFrame, boxes: DataFrame, max_distance: int = 6, stride: int = 8,
    embed: Callable | None = None, cosine_min: float = 0.98,
) -> dict[str, DataFrame]:
    """Group sizes, exact and near copies, box statistics and the resolution advice.

    With ``embed`` (contents of a batch to a matrix of vectors) also the near copies by cosine.
    """
    hashes = [A.content_hash(F.col("content")).alias("digest"), N.fingerprint_of(F.col("content")).alias("fingerprint")]
    # contents are read once, for both kinds of hash and the vectors
    read = images.select("image_id", "content") if embed is None else N.embedded(images.select("image_id", "content"), embed)
    prints = materialize(read.select("image_id", *hashes, *([] if embed is None else ["vec"])))
    grouped = boxes.join(images.select("image_id", F.concat_ws("/", "camera", "background").alias("grp")), "image_id")
    stats = materialize(A.box_statistics(grouped.drop(boxes["grp"]) if "grp" in boxes.columns else grouped, "grp", images))
    parts = {
        "group_distribution": A.group_distribution(images),
        "exact_copies": A.exact_copies(prints),
        "near_copies": N.near_copies(prints, max_distance),
        "box_statistics": stats,
        "advice": A.finer_level_advice(stats, stride),
    }
    if embed is not None:
        parts["embedding_copies"] = N.embedding_copies(prints, cosine_min=cosine_min)
    return parts


def matched_laece(detections: DataFrame, hits: DataFrame, keys: Sequence[str] = (), bins: int = 15) -> DataFrame:
    """Localisation-aware calibration error with one-to-one matches: (keys, laece)."""
    zero = F.lit(0.0)
    parts = detections.select(*keys, "score", F.lit(1).alias("n"), F.col("score").alias("conf"), zero.alias("loc")).unionByName(
        hits.select(*keys, "score", F.lit(0).alias("n"), zero.alias("conf"), F.col("iou").alias("loc"))
    )
    sums = parts.groupBy(*keys, S.width_bin(F.col("score"), bins).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("conf").alias("conf"), F.sum("loc").alias("loc")
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("loc"))).otherwise(0.0)
    return sums.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("laece"))


def detection_report(images: DataFrame, detections: DataFrame, boxes: DataFrame, group: str = "grp", score_cut: float = 0.3) -> DataFrame:
    """One row with every detection figure, pooled and per group.

    The overlap join runs once, for all thresholds; its true positives are written and
    shared by the figures.
    """
    levels = M.COCO_THRESHOLDS
    pool = F.lit("all").alias("pool")
    hits = materialize(M.true_positives(detections, boxes, levels, carry=[group]))
    at50 = hits.where(F.col("iou_threshold") == 0.5)
    npos = boxes.groupBy(pool).agg(F.count(F.lit(1)).alias("npos"))
    pooled = D.average_precision(detections.select("*", pool), hits.select("*", pool), npos, ["pool"], levels)
    by_group = D.average_precision(detections, at50, boxes.groupBy(group).agg(F.count(F.lit(1)).alias("npos")), [group])
    groups = by_group.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(group, "ap")))).alias("per_group_ap50"),
        F.min("ap").alias("worst_group_ap50"),
        F.avg("ap").alias("mean_ap50"),
        (F.avg("ap") - F.min("ap")).alias("group_gap_ap50"),
    )
    counts = D.lrp_error(
        D.match_counts(detections.select("*", pool), at50.select("*", pool), boxes.select("*", pool), ["pool"])
    )
    errors = D.count_error(images, detections, boxes, score_cut=score_cut)
    at = {t: F.max(F.when(F.col("iou_threshold") == t, F.col("ap"))) for t in (0.5, 0.75)}
    base = pooled.agg(at[0.5].alias("ap50"), at[0.75].alias("ap75"), F.avg("ap").alias("ap_range"))
    # one-row tables side by side
    extra = {
        "recall_small": D.small_object_recall(detections, boxes, []).select("recall_small"),
        "lrp50": counts.select("lrp"),
        "laece": matched_laece(detections, at50),
        "count": errors.select(F.struct("count_mae", "count_corr")),
        "groups": groups.select(F.struct("*")),
    }
    for name, one in extra.items():
        base = base.withColumn(name, one.scalar())
    return base.select("ap50", "ap75", "ap_range", "recall_small", "lrp50", "laece", "count.*", "groups.*")


def selective_report(
    df: DataFrame, keys: Sequence[str] = (), fused: str = "fused", label: str = "label", disagreement: str | None = "disagreement",
    tie: Sequence[str] = ("image_id", "det_id"), coverages: Sequence[float] = (1.0, 0.95, 0.9, 0.8),
) -> DataFrame:
    """Per key: failure AUROC and AP, risk at each coverage (map), AURC, accuracy."""
    keys = list(keys)
    pool = [*keys, "_pool"]
    judged = df.select(
        *keys, *tie, fused, *([disagreement] if disagreement else []),
        S.is_correct(F.col(fused), F.col(label)).alias("correct"), F.lit(1).alias("_pool"),
    )
    referred = R.referral_score(judged, fused, disagreement, keys=pool)
    accuracy = judged.groupBy(*pool).agg(F.count(F.lit(1)).alias("rows"), F.avg("correct").alias("accuracy"))
    return accuracy.join(R.ranking_figures(referred, pool, "confidence", "correct", tie, coverages), pool).drop("_pool")


def clean_and_shifted(df: DataFrame, variant: str, group: str, **columns) -> DataFrame:
    """Calibration and selective figures of every variant of a score table side by side."""
    calibration = C.calibration_report(df, [variant], group)
    return calibration.drop("per_group_ece").join(selective_report(df, [variant], **columns), variant)


def under_shift(df: DataFrame, shifts: Mapping[str, Mapping[str, Column]], variant: str = "variant") -> DataFrame:
    """Every candidate once as ``clean`` and once per shift, in one pass over the table.

    A shift gives the score columns it changes as expressions of the clean row.
    """
    changed = sorted({c for columns in shifts.values() for c in columns})
    rows = [
        F.struct(F.lit(name).alias(variant), *[columns.get(c, F.col(c)).cast("double").alias(c) for c in changed])
        for name, columns in {"clean": {}, **shifts}.items()
    ]
    kept = [c for c in df.columns if c not in (variant, *changed)]
    return df.select(*kept, F.inline(F.array(*rows)))


def full_report(images: DataFrame, detections: DataFrame, boxes: DataFrame, scores: DataFrame, group: str = "grp") -> dict[str, DataFrame]:
    """Detection, calibration and selective reports of one run."""
    one = scores.withColumn("run", F.lit("run"))
    return {
        "detection": detection_report(images, detections, boxes, group),
        "calibration": C.calibration_report(one, ["run"], group).drop("run"),
        "selective": selective_report(scores),
    }


def subgroup_study(df: DataFrame, keys: Sequence[str], group: str, draws: int = 2000) -> dict[str, DataFrame]:
    """Counts, occupancy, intervals, binning, stages, equal recall and metrics per run and group.

    The scores are written once and all tables read that copy. Sums per (group, image, bin) are made in
    one pass over it; the bootstrap and, added up over images, the metrics come from them.
    """
    df = materialize(df.select(*keys, group, "image_id", "det_id", "label", "iou", "p_det", "p_ver", "fused"))
    per_image = materialize(C.bin_sums(df, [*keys, group, "image_id"], "fused", iou="iou"))
    totals = [c for c in per_image.columns if c not in (*keys, group, "image_id", "bin")]
    sums = per_image.groupBy(*keys, group, "bin").agg(*[F.sum(c).alias(c) for c in totals])
    return {
        "counts": C.candidate_counts(df, [*keys, group], "fused"),
        "occupancy": C.bin_occupancy(df, [*keys, group], "fused"),
        "intervals": X.cluster_bootstrap(per_image, keys, group, "image_id", draws),
        "binning": C.binning_robustness(df, keys, group, "fused"),
        "stages": C.stage_decomposition(df, keys, group, ["p_det", "p_ver", "fused"]),
        "equal_recall": R.matched_recall_table(df, keys, group, reference="p_det", alternative="fused"),
        "metrics": C.metrics(C.with_pooled(sums, keys, group), [*keys, group]),
    }


def study_rows(parts: dict[str, DataFrame], keys: Sequence[str], group: str, details: Sequence[str] = ("binning", "stage")) -> DataFrame:
    """All tables of a study as one: (keys, group, part, detail, name, value), a row per figure.

    ``detail`` is the binning or the stage of a figure; lists of counts are left out.
    """
    tables = []
    for part, table in parts.items():
        told = [c for c in details if c in table.columns]
        kinds = dict(table.dtypes)
        figures = [c for c in table.columns if c not in (*keys, group, *told) and not kinds[c].startswith("array")]
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in figures])
        detail = F.col(told[0]) if told else F.lit("")
        tables.append(table.select(*keys, F.col(group).cast("string").alias(group), F.lit(part).alias("part"), detail.alias("detail"), F.inline(pairs)))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def significance_report(diffs: DataFrame, keys: Sequence[str], order: str, draws: int = 10000) -> DataFrame:
    """Sign test, signed-rank test and bootstrap interval of the mean difference per comparison."""
    keys = list(keys)
    return (
        X.sign_test(diffs, keys)
        .join(X.wilcoxon(diffs, keys), keys)
        .join(X.mean_difference_interval(diffs, keys, order, draws=draws), keys)
    )


def power_note(images: DataFrame, candidates: DataFrame, group: str, majority: str, minority: str) -> DataFrame:
    """Images per split, minority images per split, and the gap the candidate counts can show."""
    split = {s: F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_images") for s in A.SPLIT_ORDER}
    small = {
        s: F.count(F.when((F.col("split") == s) & (F.col("background") == minority), 1)).alias(f"minority_{s}_images")
        for s in ("test", "val")
    }
    sizes = candidates.agg(
        F.count(F.when(F.col(group) == majority, 1)).alias("a"), F.count(F.when(F.col(group) == minority, 1)).alias("b")
    )
    gap = sizes.select(F.round(A.detectable_gap(F.col("a"), F.col("b")), 3))
    return images.agg(*split.values(), *small.values()).withColumn("detectable_gap", gap.scalar())
