"""Toxicity by the nearest labelled examples under TF-IDF cosine.

The terms that tell of the toxic label span the vector space; they are counted over all labelled
rows of the training folds, their document frequency over all documents. Examples, a bounded
sample of the labelled rows, stand in blocks; the inverted index holds, per term and block, the
postings and their largest weight. A query sums those maxima into a bound per block, visits
blocks from the highest bound on, and stops once no other block can hold a nearer example, so
the neighbours are exact. Their votes count by nearness and by how many labelled rows an
example stands for, and a curve fitted on held-back votes turns the share of toxic votes into a
probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import _gather
from plumbline.llm.common import as_bytes, batched, drawn_first, fold, map_texts, marked
from plumbline.session import materialize

#: Labelled rows of each class that the classifier is fitted on, at most: a seeded sample.
EXAMPLES = 4096
#: Terms that span the space, at most.
TERMS = 2048
#: Standard errors by which the log odds of a term are lowered, and what they must then reach: the
#: term makes the toxic label about seven times as likely, at any number of rows.
DOUBTED = 2.0
TOLD = 2.0
#: Terms that a task counts before it passes the counts on.
REMEMBERED = 200_000
#: Examples of one block of the index, and neighbours that vote.
BLOCK = 64
NEIGHBOURS = 15
#: Weight of the share of toxic labels, in examples of nearness about 0.6.
DOUBT = 0.5

_FOLD = bytes(
    32 if b < 128 and not chr(b).isalnum() else (b + 32 if 65 <= b <= 90 else b) for b in range(256)
)


def terms(raw: bytes) -> list[bytes]:
    """Words in lower case (A-Z), cut at every ASCII character that is no letter or digit."""
    return raw.translate(_FOLD).split()


@dataclass
class Model:
    number: dict[bytes, int]
    idf: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray
    ids: list
    term_at: np.ndarray  # entries (term, block) of term t: term_at[t] to term_at[t + 1]
    entry_block: np.ndarray
    entry_most: np.ndarray
    entry_at: np.ndarray  # postings of entry e: entry_at[e] to entry_at[e + 1]
    post_example: np.ndarray
    post_weight: np.ndarray
    share: float = 0.5  # of toxic labels
    usual: float = 1.0  # rows that an example stands for on average
    nothing: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit TF-IDF weights of a text."""
        number = self.number
        counts = Counter([number[w] for w in terms(raw) if w in number])
        at = np.array(sorted(counts), np.int64)
        weight = (1 + np.log([counts[i] for i in at])) * self.idf[at] if len(at) else np.zeros(0)
        norm = np.sqrt((weight**2).sum())
        return at, weight / norm if norm else weight

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, nearest first, ties to the lower number."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        lo, hi = self.term_at[at], self.term_at[at + 1]
        entries, own = _gather(lo, hi - lo), np.repeat(weight, hi - lo)
        blocks = self.entry_block[entries]
        bound = np.bincount(blocks, own * self.entry_most[entries])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score = np.zeros(0, np.int64), np.zeros(0)
        seen, step = 0, 2
        while seen < len(order):
            if len(best) >= k and bound[order[seen]] < score[k - 1] - 1e-12:
                break
            visit = np.zeros(len(bound), bool)
            visit[order[seen : seen + step]] = True
            seen, step = seen + step, step * 2
            e, w = entries[visit[blocks]], own[visit[blocks]]
            sizes = self.entry_at[e + 1] - self.entry_at[e]
            posts = _gather(self.entry_at[e], sizes)
            who, inverse = np.unique(self.post_example[posts], return_inverse=True)
            value = np.bincount(inverse, np.repeat(w, sizes) * self.post_weight[posts])
            if skip >= 0:
                who, value = who[who != skip], value[who != skip]
            best, score = np.concatenate((best, who)), np.concatenate((score, value))
            top = np.lexsort((best, -score))[:k]
            best, score = best[top], score[top]
        return best, score

    def vote(self, who: np.ndarray, score: np.ndarray) -> float:
        """Share of toxic votes among neighbours, each by its nearness and by what it stands for.

        Faint neighbours say little: the share among all labelled rows votes along with the
        weight of ``DOUBT`` examples.
        """
        w = self.stands_for[who] * np.minimum(score, 1.0) ** 2 / (1.02 - np.minimum(score, 1.0))
        doubt = DOUBT * self.usual
        return float(((w * self.labels[who]).sum() + doubt * self.share) / (w.sum() + doubt))

    def score(self, raw: bytes) -> tuple[float, list, list[float]]:
        who, near = self.nearest(*self.vector(raw), NEIGHBOURS)
        if not len(who):
            return self.nothing, [], []
        a, b = self.curve
        x = a * _logit(self.vote(who, near)) + b
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40)))), [self.ids[i] for i in who[:3]], [float(x) for x in near[:3]]


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 0.001, 0.999)
    return np.log(p / (1 - p))


def build(vocabulary: list[bytes], df: np.ndarray, n: int, rows: list[tuple], totals: tuple[float, float]) -> Model:
    """``rows``: (id, label, raw text) of the examples; ``totals``: labelled rows per class."""
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model({w: i for i, w in enumerate(vocabulary)}, idf, *[None] * 9)
    vectors = [(*model.vector(raw), label, key) for key, label, raw in rows]
    order = sorted(range(len(rows)), key=lambda i: (vectors[i][0][:3].tolist() or [len(vocabulary)], str(rows[i][0])))
    vectors = [vectors[i] for i in order]
    model.labels = np.array([v[2] for v in vectors], float)
    share = [max(1, (model.labels == c).sum()) for c in (0, 1)]
    model.stands_for = np.where(model.labels == 1, totals[1] / share[1], totals[0] / share[0])
    model.share = float(totals[1] / max(1.0, sum(totals)))
    model.usual = float(model.stands_for.mean()) if len(vectors) else 1.0
    model.ids = [v[3] for v in vectors]
    example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
    weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
    by = np.lexsort((example, term))
    example, term, weight = example[by], term[by], weight[by]
    block = example // BLOCK
    key = term * (len(vectors) // BLOCK + 1) + block
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    model.entry_at = np.append(starts, len(key))
    model.entry_block = block[starts]
    model.entry_most = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0)
    model.post_example, model.post_weight = example, weight
    model.term_at = np.searchsorted(term[starts], np.arange(len(vocabulary) + 1))
    empty = np.array([not len(v[0]) for v in vectors], bool)
    w = model.stands_for
    model.nothing = float((w * model.labels)[empty].sum() + 0.5 * totals[1] / max(1.0, sum(totals))) / float(w[empty].sum() + 1)
    votes, labels, weights = [], [], []
    for i, v in enumerate(vectors):  # every example is judged by the others
        who, near = model.nearest(v[0], v[1], NEIGHBOURS, skip=i)
        if len(who):
            votes.append(model.vote(who, near))
            labels.append(model.labels[i])
            weights.append(w[i])
    model.curve = _platt(_logit(np.array(votes)), np.array(labels), np.array(weights)) if votes else (1.0, 0.0)
    return model


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on weighted rows with a weak prior at (1, 0).

    A step is halved until the penalised likelihood grows, since votes often part the labels
    almost completely, where plain Newton steps overshoot.
    """
    w = w / w.mean()
    prior = np.array([1.0, 0.0])
    design = np.stack((x, np.ones_like(x)), axis=1)

    def value(theta: np.ndarray) -> float:
        z = design @ theta
        return float((w * (y * z - np.logaddexp(0, z))).sum() - ((theta - prior) ** 2).sum() / 2)

    theta, now = prior.copy(), value(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - (theta - prior)
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while (after := value(theta + step)) < now and np.abs(step).max() > 1e-9:
            step /= 2
        if after < now or np.abs(step).max() < 1e-9:
            break
        theta, now = theta + step, after
    return float(theta[0]), float(theta[1])


def count_terms(docs: DataFrame, known: DataFrame) -> DataFrame:
    """term, a and b: rows of ``docs`` with a term that ``known`` calls toxic and clean.

    Texts without a label stay where they are; the others always meet their label in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for toxic, own in enumerate(counts):
                n, none = pa.array(own.values(), pa.int64()), pa.array(np.zeros(len(own), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.keys(), pa.binary()), n if toxic else none, none if toxic else n], names=["term", "a", "b"]
                )
                own.clear()

        for batch in batches:
            for raw, toxic in zip(batch.column("_raw").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                counts[toxic].update(set(terms(raw)))
            if sum(map(len, counts)) > REMEMBERED:
                yield from flush()
        yield from flush()

    batched(docs.sparkSession)
    told = marked(docs.select("doc_id", as_bytes().alias("_raw")), "doc_id", known).where("_marked")
    rows = told.join(known.hint("shuffle_hash"), "doc_id").select("_raw", "_toxic")
    parts = rows.mapInArrow(run, "term binary, a long, b long")
    return parts.groupBy("term").agg(*[F.sum(c).cast("double").alias(c) for c in ("a", "b")])


def count_documents(docs: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """Rows of ``docs`` that hold each term of the vocabulary."""
    wanted = set(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for raw in batch.column("_raw").to_pylist():
                own.update(wanted.intersection(terms(raw)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], names=["term", "n"]
        )

    batched(docs.sparkSession)
    met = docs.select(as_bytes().alias("_raw")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n"))
    df = {bytes(term): n for term, n in met.collect()}
    return np.array([df.get(w, 0) for w in vocabulary], float)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, most_terms: int = TERMS) -> Model:
    """Fit on labelled rows of ``docs`` outside the held-out fold (crc32 of the id modulo 5 is 0).

    Terms are counted over all of these rows. Those whose log odds, less their doubt, reach ``TOLD`` are
    ranked by them; the odds of a term do not grow with the rows, only the doubt shrinks. At most ``examples`` rows of each class, by a hash of the id, and
    ``most_terms`` terms are used; that bounds what the driver gathers. A document labelled twice
    counts as toxic if either label says so; null labels are left out.
    """
    known = (
        labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
        .where(fold("doc_id") != 0)
    )
    # ids are drawn first: only the drawn rows' texts are read, and none is shuffled
    rows = docs.select("doc_id").join(known, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    # rows of a class, and ids among them: only ids are drawn, so that repeated rows do not empty the sample
    per_id = rows.groupBy("_toxic", "doc_id").agg(F.count("*").alias("_rows"))
    counted = per_id.groupBy("_toxic").agg(F.sum("_rows"), F.count("*")).collect()
    totals, different = {r[0]: r[1] for r in counted}, {r[0]: r[2] for r in counted}
    parts = [
        drawn_first(rows.where(F.col("_toxic") == c).dropDuplicates(["doc_id"]), F.col("_h"), examples, different.get(c, 0))
        .orderBy(F.pmod("_h", F.lit(1 << 30)), "doc_id").limit(examples)
        for c in (0, 1)
    ]
    drawn = materialize(parts[0].unionByName(parts[1]).drop("_h"))
    chosen = docs.select("doc_id", as_bytes().alias("_raw")).join(F.broadcast(drawn), "doc_id")
    n0, n1 = float(totals.get(0, 0)), float(totals.get(1, 0))
    a, b = F.col("a"), F.col("b")
    cells = [a + 0.5, n0 - b + 0.5, n1 - a + 0.5, b + 0.5]
    odds = F.log(cells[0]) + F.log(cells[1]) - F.log(cells[2]) - F.log(cells[3])
    doubt = F.sqrt(sum((1 / c for c in cells), F.lit(0.0)))
    told = (
        count_terms(docs, known)
        .withColumn("told", odds - DOUBTED * doubt)
        .where(F.col("told") >= TOLD)
        .orderBy(F.desc("told"), "term")
        .limit(most_terms)
        .collect()
    )
    vocabulary = [bytes(r["term"]) for r in told]
    wanted = set(vocabulary)

    def thin(cols: dict) -> dict:
        return {
            "doc_id": cols["doc_id"], "_toxic": cols["_toxic"],
            "_raw": [b" ".join(w for w in terms(raw) if w in wanted) for raw in cols["_raw"]],
        }

    kind = dict(docs.dtypes)["doc_id"]
    few = map_texts(chosen, thin, f"doc_id {kind}, _toxic int, _raw binary").collect()
    examples_found = [(r[0], r[1], bytes(r[2])) for r in few]
    return build(vocabulary, count_documents(docs, vocabulary), docs.count(), examples_found, (n0, n1))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples) and nearness, row by row.

    A null or empty text, or one without any telling term, gets the share of toxic rows among
    examples of that kind. Without labels of both classes every score is a constant.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(cols: dict) -> dict:
        m = shared.value
        found = [m.score(raw) for raw in cols["_raw"]]
        return {
            "doc_id": cols["doc_id"], "held_out": cols["held_out"],
            "score": [f[0] for f in found], "evidence": [f[1] for f in found], "nearness": [f[2] for f in found],
        }

    kind = dict(docs.dtypes)["doc_id"]
    scored = map_texts(
        docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), as_bytes(text).alias("_raw")), work,
        f"doc_id {kind}, held_out boolean, score double, evidence array<{kind}>, nearness array<double>",
    )
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "nearness"
    )


def keep_clean(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda raw: shared.value.score(bytes(raw))[0]).astype("float64")

    toxic = F.pandas_udf(run, "double")
    return docs.where(toxic(as_bytes(text)) < cut)
