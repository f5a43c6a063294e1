"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe, class_lm, credentials, html_text, lexical_search, merge_replay, mixing, neighbours, periodic_runs, quality,
    repeats, shingle_join, toxicity,
)
from plumbline.llm.common import fold, read
from plumbline.session import configure, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return build(spark, sf_dir)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, ids=False, decoded=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and the verdict of the weighed rules."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs)


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each text: base patterns and what the compressor finds new."""
    found = credentials.find(read(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"] != "novel")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "novel")],
        F.sha2(credentials.listed(base), 256).alias("base_sha256"),
        credentials.listed(F.col("findings")).alias("spans"),
    )


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken so that sources come to their target shares."""
    sized = materialize(mixing.sizes(read(spark, sf_dir, "documents")))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each text by its nearest labelled examples."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles overlap by 85 % of their union."""
    return shingle_join.link(read(spark, sf_dir, "documents"))


@query
def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each text by a class-based bigram model, and by single words."""
    return class_lm.train_and_score(read(spark, sf_dir, "documents"), fold("doc_id") == 1)


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that a smaller document holds."""
    return repeats.find(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Terms as the search sees them: the separators are ASCII other than letters and digits.
_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op11_lexical_search"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents
), held AS (SELECT r, doc_id, words, len(words)::BIGINT AS n FROM docs WHERE len(words) > 0
), corpus AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM held
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM held) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, corpus GROUP BY term, nn
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, r, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN held USING (r), corpus
  GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words, the longest of them, and digests of all runs and of the texts without them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find(docs, tail_of="doc_id").withColumn("best", periodic_runs.longest())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.listed().cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids by replayed merges and the bytes decoded from them, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return merge_replay.encode(docs, ids=False, decoded=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )
