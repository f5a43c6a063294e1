"""A class-based bigram model (Brown et al.) over a whole corpus, and texts scored by it.

Every word belongs to a type: a frequent word is its own type, any other word shares the type
of its ending. Exchange clustering moves types between classes while that raises the likelihood
of the class bigrams. A text's probability is the product, over its words and a final end token,
of the transition from the class before and the emission of the word by its class.

Counts come from all training texts. The frequent words, the bigram counts of types and the
counts that travel with the tasks have fixed bounds; counts of all other words meet the texts
in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, batched
from plumbline.session import materialize

#: Most frequent words that are types of their own.
FREQUENT = 2048
#: Types shared by the other words, by their last bytes.
ENDINGS = 1021
ENDING_BYTES = 3
#: Classes besides that of the end token.
CLASSES = 96
#: Exchange passes over all types, at most; it stops earlier when nothing moves.
PASSES = 12
#: Most frequent words whose counts travel with the tasks, at most; words of about equal count go together.
CARRIED = 131_072
#: Pseudo-counts of a transition that follow the class frequencies.
PRIOR = 4.0
#: Words that a task remembers between texts.
REMEMBERED = 200_000
_END = b"\n"
_TYPES = FREQUENT + ENDINGS + 1  # the last is the end token
_ROWS = 64  # rows of the type bigram matrix in one piece


class Lexicon:
    """Numbers for the words that a task meets, with their hashes and endings."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {_END: 0}
        self.hash = np.array([END_HASH], np.int64)
        self.ending = np.array([ENDINGS], np.int32)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, each closed by the end token, and their lengths."""
        number = self.number
        put = number.setdefault
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, raw in enumerate(texts):
            words = raw.lower().split()
            flat += [put(w, len(number)) for w in words]
            flat.append(0)
            sizes[i] = len(words) + 1
        if len(number) > len(self.hash):
            fresh = list(number)[len(self.hash) :]
            self.hash = np.concatenate((self.hash, _hashes(fresh)))
            ends = np.array([xxhash.xxh3_64_intdigest(w[-ENDING_BYTES:]) % ENDINGS for w in fresh], np.int32)
            self.ending = np.concatenate((self.ending, ends))
        return np.array(flat, np.int64), sizes


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


END_HASH = int(_hashes([_END])[0])


def count_words(texts: DataFrame) -> DataFrame:
    """h, ending and c: occurrences of every word and of the end token in ``_raw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = Lexicon(), np.zeros(1, np.int64)

        def flush() -> pa.RecordBatch:
            at = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(lexicon.hash[at]), pa.array(lexicon.ending[at]), pa.array(counts[at])],
                names=["h", "ending", "c"],
            )

        for batch in batches:
            flat, _ = lexicon.read(batch.column("_raw").to_pylist())
            seen = np.bincount(flat, minlength=len(lexicon.hash))
            seen[: len(counts)] += counts
            counts = seen
            if len(counts) > REMEMBERED:
                yield flush()
                lexicon.clear()
                counts = np.zeros(1, np.int64)
        yield flush()

    parts = texts.mapInArrow(run, "h long, ending int, c long")
    return parts.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


@dataclass
class Types:
    """Which type a word has: the frequent ones by hash, all others by their ending."""

    hashes: np.ndarray  # of the frequent words, sorted
    numbers: np.ndarray

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = FREQUENT + endings.astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.numbers[at[hit]]
        return out


def count_bigrams(texts: DataFrame, types: Types) -> np.ndarray:
    """Occurrences of type after type in all texts; a text begins after an end token.

    Tasks send their sums as compressed blocks of rows, which are added up in two steps.
    """
    shared = texts.sparkSession.sparkContext.broadcast(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, sums = Lexicon(), np.zeros(_TYPES * _TYPES, np.int32)
        for batch in batches:
            flat, _ = lexicon.read(batch.column("_raw").to_pylist())
            own = shared.value.of(lexicon.hash, lexicon.ending)[flat]
            before = np.concatenate(([_TYPES - 1], own[:-1]))
            pairs, times = np.unique(before * _TYPES + own, return_counts=True)
            sums[pairs] += times.astype(np.int32)
            if len(lexicon.hash) > REMEMBERED:
                lexicon.clear()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        step = _ROWS * _TYPES
        for k in range(0, len(sums), step):
            part = sums[k : k + step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // step], pa.int32()), "sums": [squeeze(part.tobytes())]})

    def total(parts: pd.Series) -> np.ndarray:
        return sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int32).astype(np.int64) for x in parts)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        capped = np.minimum(total(part["sums"]), 2**31 - 1).astype(np.int32)
        return pd.DataFrame({"block": part["block"].iloc[:1], "sums": [zstandard.ZstdCompressor(level=1).compress(capped.tobytes())]})

    schema = "block int, sums binary"
    parts = texts.mapInArrow(run, schema).withColumn("_salt", F.spark_partition_id() % 16)
    some = parts.groupBy("block", "_salt").applyInPandas(lambda p: add(p[["block", "sums"]]), schema)
    out = np.zeros(_TYPES * _TYPES, np.int64)
    step = _ROWS * _TYPES
    for block, sums in some.groupBy("block").applyInPandas(add, schema).toLocalIterator():
        out[block * step : block * step + step] = total([bytes(sums)])
    return out.reshape(_TYPES, _TYPES)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of every type; the end token (the last type) has class ``classes`` for itself.

    Starts with types dealt by falling frequency, and moves one type at a time to the class that
    raises the likelihood of the class bigrams most.
    """
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = np.arange(n - 1) % classes
    of[-1] = classes
    c = classes + 1
    hot = np.zeros((n, c))
    hot[np.arange(n), of] = 1
    after = bigrams @ hot  # type, class that follows
    before = bigrams.T @ hot  # type, class ahead
    table = hot.T @ after
    for _ in range(passes):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, own = of[w], float(bigrams[w, w])
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            # the table without w, then w added to each class in turn
            bare = table.copy()
            bare[a, :] -= right
            bare[:, a] -= left
            bare[a, a] -= own
            rows, columns = bare.sum(1), bare.sum(0)
            total_right, total_left = right.sum() + own, left.sum() + own
            gain_rows = (_xlogx(bare + right[None, :]) - _xlogx(bare)).sum(1)
            gain_columns = (_xlogx(bare + left[:, None]) - _xlogx(bare)).sum(0)
            d = np.diag(bare)
            corner = _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            cost = _xlogx(rows + total_right) - _xlogx(rows) + _xlogx(columns + total_left) - _xlogx(columns)
            gain = gain_rows + gain_columns + corner - cost
            gain[-1] = -np.inf
            b = int(np.argmax(gain))
            if b == a or gain[b] <= gain[a] + 1e-9:
                continue
            table = bare
            table[b, :] += right
            table[:, b] += left
            table[b, b] += own
            of[w] = b
            moved += 1
            after[:, a] -= bigrams[:, w]
            after[:, b] += bigrams[:, w]
            before[:, a] -= bigrams[w]
            before[:, b] += bigrams[w]
        if not moved:
            break
    return of


@dataclass
class Model:
    types: Types
    class_of: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    floor: np.ndarray  # per class: N + 0.5 * (V + 1)
    tokens: int
    distinct: int
    carried: np.ndarray  # hashes of the words whose counts travel along, sorted
    carried_counts: np.ndarray

    @property
    def base_floor(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def fit(training: DataFrame, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of the texts in ``_raw``, and the table of all word counts (h, ending, c)."""
    counts = materialize(count_words(training))
    tokens, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("h") != END_HASH)
    # words by steps of their count; as many whole steps as the bound holds come to the driver
    step = F.floor(F.log2("c") * 64).alias("step")
    steps = sorted(words.groupBy(step).count().collect(), reverse=True)
    held = np.cumsum([r["count"] for r in steps])
    inside = [r["step"] for r, n in zip(steps, held, strict=True) if n <= CARRIED]
    top = words.where(step >= (min(inside) if inside else 1 << 30)).toPandas()
    top = top.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    frequent = top.head(FREQUENT)
    by = np.argsort(frequent["h"].to_numpy(np.int64), kind="stable")
    types = Types(frequent["h"].to_numpy(np.int64)[by], by.astype(np.int64))
    bigrams = count_bigrams(training, types)
    of = exchange(bigrams, classes)
    c = classes + 1
    hot = np.zeros((_TYPES, c))
    hot[np.arange(_TYPES), of] = 1
    table = hot.T @ (bigrams @ hot)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * c)
    transition = np.log10((table + PRIOR * share[None, :]) / (table.sum(1, keepdims=True) + PRIOR))
    # words and occurrences per ending, less those that are types of their own
    per = np.zeros((2, ENDINGS))
    for ending, n, total in words.groupBy("ending").agg(F.count("*"), F.sum("c")).collect():
        per[:, ending] = n, total
    np.subtract.at(per[0], frequent["ending"].to_numpy(np.int64), 1)
    np.subtract.at(per[1], frequent["ending"].to_numpy(np.int64), frequent["c"].to_numpy(float))
    kinds, uses = np.zeros(_TYPES), np.zeros(_TYPES)
    kinds[: len(frequent)], uses[: len(frequent)] = 1, frequent["c"]
    kinds[FREQUENT:-1], uses[FREQUENT:-1] = per
    ends = counts.where(F.col("h") == END_HASH).agg(F.sum("c")).first()[0] or 0
    kinds[-1], uses[-1] = 1, ends
    floor = np.bincount(of, uses, c) + 0.5 * (np.bincount(of, kinds, c) + 1)
    extra = pd.DataFrame({"h": [END_HASH], "c": [ends]})
    carried = pd.concat([top[["h", "c"]], extra] if ends else [top[["h", "c"]]]).sort_values("h")
    return Model(
        types, of, transition, floor, int(tokens), int(distinct),
        carried["h"].to_numpy(np.int64), carried["c"].to_numpy(np.int64),
    ), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``score`` is the log10 probability of the words and the end token, ``perplexity`` 10 to the
    minus score per token. Words that training never saw count half an occurrence in the class
    of their ending. A null or empty text is its end token. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = Lexicon()
        done, known, emit, cls, seen = 0, None, None, None, None

        def learn() -> None:
            nonlocal done, known, emit, cls, seen
            h = lexicon.hash
            cls = m.class_of[m.types.of(h, lexicon.ending)]
            seen = np.zeros(len(h), np.int64)
            if len(m.carried):
                at = np.minimum(np.searchsorted(m.carried, h), len(m.carried) - 1)
                hit = m.carried[at] == h
                seen[hit] = m.carried_counts[at[hit]]
            done = len(h)

        for batch in batches:
            flat, sizes = lexicon.read(batch.column("_raw").to_pylist())
            if done != len(lexicon.hash):
                learn()
            own = cls[flat]
            before = np.concatenate(([len(m.floor) - 1], own[:-1]))
            n = seen[flat]
            sure = n > 0
            moved = m.transition[before, own]
            base = np.where(sure, np.log10((n + 0.5) / m.base_floor), 0.0)
            emitted = np.where(sure, np.log10((n + 0.5) / m.floor[own]), 0.0)
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts)
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes),
                 pa.array(add(sure.astype(np.int64))), pa.array(add(base)), pa.array(add(moved + emitted)),
                 pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32())],
                names=names,
            )
            if not sure.all():
                at = np.flatnonzero(~sure)
                text_of = np.repeat(np.arange(rows), sizes)[at]
                pairs, times = np.unique(text_of * len(seen) + flat[at], return_counts=True)
                word, k = pairs % len(seen), len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").take(pa.array(pairs // len(seen))), pa.nulls(k, batch.column("doc_id").type),
                     pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()),
                     pa.nulls(k, pa.float64()), pa.array(lexicon.hash[word]), pa.array(times),
                     pa.array(cls[word].astype(np.int32))],
                    names=names,
                )
            if len(lexicon.hash) > REMEMBERED:
                lexicon.clear()
                done = 0

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "h", "times", "class"]
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", held_out.alias("held_out"), as_bytes(text).alias("_raw")
    ).mapInArrow(
        run,
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double,"
        " h long, times long, class int",
    )
    rows = materialize(rows)  # row numbers are given once
    floors = F.array(*[F.lit(float(x)) for x in model.floor])
    n, times = F.coalesce("c", F.lit(0)) + 0.5, F.col("times")
    rare = rows.where("h is not null").select("row", "h", "times", "class").join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("_known"),
        F.sum(times * F.log10(n / F.lit(model.base_floor))).alias("_base"),
        F.sum(times * F.log10(n / F.get(floors, F.col("class")))).alias("_model"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        rows.where("h is null").join(rare, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("_known")).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + zero("_base")).alias("base_score"), (F.col("model") + zero("_model")).alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )


def train_and_score(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """Fit on the rows that are not ``held_out`` and score all rows."""
    batched(docs.sparkSession)
    model, counts = fit(docs.where(~held_out).select(as_bytes(text).alias("_raw")))
    return score(docs, model, counts, held_out, text)
