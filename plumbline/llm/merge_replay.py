"""Byte-level BPE by replaying merges over all distinct words of a stretch of the corpus.

The distinct words stand behind each other as linked symbols, and every symbol knows the token that
it and its neighbour merge into. Merges are applied in rank order over all words at once, in
stretches of ranks: an inverted index from the tokens of the stretch to the positions of their
pairs is read off once, each position is merged, from the left, and only the two touched
neighbours of a merge are looked up again and, if their pair belongs to the stretch, enter the
index. A position whose pair has changed since is skipped when its turn comes. Should a merge make
a pair of a lower rank than its own, which the order of the replay has passed, its word leaves the
replay and is encoded alone by the plain rule, so any rank file gives the library's ids.

A task replays the distinct words of some 16 million characters of text at a time (always whole
texts) and forgets them. Cases: null and empty texts have no tokens; repeated rows are encoded row
by row; texts are never cut, and one word of a megabyte costs what as many short ones do.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import batched

#: Characters of text whose words are replayed together, at least one text.
TOGETHER = 16_000_000
#: Ranks of one stretch.
STRETCH = 1024
_BORDER, _GONE = -1, -2


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Replay:
    """Ranks of one file, and the merges of words by them."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.rank = rank = {base64.b64decode(token): int(number) for token, number in lines}
        size = 1 + max(rank.values())
        self.piece = [b""] * size
        for token, number in rank.items():
            self.piece[number] = token
        self.decimal = [b"%d" % i for i in range(size)]
        # White space as Unicode defines it; Python's \s also takes four control characters.
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {  # every way to make a token of two
            rank[token[:k]] << 32 | rank[token[k:]]: number
            for token, number in rank.items()
            for k in range(1, len(token))
            if token[:k] in rank and token[k:] in rank
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def tokens_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that neighbours merge into, -1 for none; negative symbols have none."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, until no pair is a token."""
        ids = [int(self.single[b]) for b in word]
        while True:
            ranks = [self.pairs.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
            least = min((r for r in ranks if r >= 0), default=-1)
            if least < 0:
                return ids
            at = ranks.index(least)
            ids = [*ids[:at], least, *ids[at + 2 :]]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word by the merges alone."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(raw)) + word + 1  # a border before every word and one at the end
        total = len(raw) + len(words) + 1
        symbol = np.full(total, _BORDER, np.int64)
        symbol[place] = self.single[raw]
        pair = np.full(total, -1, np.int64)
        pair[:-1] = self.tokens_of(symbol[:-1], symbol[1:])
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        starts = np.cumsum(np.concatenate(([1], sizes + 1)))
        apart: set[int] = set()  # words that leave the replay
        for low in range(0, len(self.piece), STRETCH):
            self._stretch(low, symbol, pair, after, before, starts, apart)
        alive = np.flatnonzero(symbol >= 0)
        ids = symbol[alive].tolist()
        ends = np.searchsorted(alive, starts).tolist()
        out = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in apart:
            out[k] = self.alone(words[k])
        return out

    def _stretch(
        self, low: int, symbol: np.ndarray, pair: np.ndarray, after: np.ndarray, before: np.ndarray,
        starts: np.ndarray, apart: set[int],
    ) -> None:
        """Apply the merges of ranks from ``low`` on, as far as one index reaches."""
        high = low + STRETCH
        at = np.flatnonzero((pair >= low) & (pair < high))
        if not len(at):
            return
        at = at[np.argsort(pair[at], kind="stable")]
        ranks, cuts = np.unique(pair[at], return_index=True)
        waiting = ranks.tolist()  # sorted, so a heap
        index = {r: [x] for r, x in zip(waiting, np.split(at, cuts[1:]), strict=True)}
        while waiting:
            rank = heappop(waiting)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping pairs the left one
                begins = np.concatenate(([True], after[at[:-1]] != at[1:]))
                if not begins.all():
                    order = np.arange(len(at))
                    at = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            between = self.tokens_of(np.full(len(at), rank), symbol[follow])  # before the next one is merged
            symbol[at], symbol[gone], pair[gone] = rank, _GONE, -1
            after[at], before[follow] = follow, at
            ahead = before[at]
            pair[at] = right = self.tokens_of(symbol[at], symbol[follow])
            pair[ahead] = left = self.tokens_of(symbol[ahead], symbol[at])
            touched, made = np.concatenate((at, ahead)), np.concatenate((right, left))
            passed = (made >= 0) & (made < rank)
            passed[: len(at)] |= (between >= 0) & (between < rank)
            if passed.any():
                for k in np.unique(np.searchsorted(starts, touched[passed], "right") - 1).tolist():
                    apart.add(k)
                    pair[starts[k] : starts[k + 1]] = -1
            soon = (made > rank) & (made < high)
            if soon.any():
                touched, made = touched[soon], made[soon]
                order = np.argsort(made, kind="stable")
                fresh, cuts = np.unique(made[order], return_index=True)
                for r, x in zip(fresh.tolist(), np.split(touched[order], cuts[1:]), strict=True):
                    if r in index:
                        index[r].append(x)
                    else:
                        index[r] = [np.sort(x)]
                        heappush(waiting, r)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of every word; a word that is a token is that token."""
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[self.rank[w]] if w in self.rank else [] for w in raw]
        rest = [k for k, ids in enumerate(out) if not ids]
        for k, ids in zip(rest, self.merge([raw[k] for k in rest]) if rest else [], strict=True):
            out[k] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        piece = self.piece
        return b"".join([piece[i] for i in ids])

    def written(self, ids: list[int]) -> bytes:
        """Decimal ids joined by one space."""
        decimal = self.decimal
        return b" ".join([decimal[i] for i in ids])


class Corpus:
    """Texts as numbers of their distinct words."""

    def __init__(self, replay: Replay) -> None:
        self.replay = replay
        self.number: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        put, number = self.number.setdefault, self.number
        words = self.replay.words.findall(text)
        self.texts.append(np.array([put(w, len(number)) for w in words], np.int32))
        self.size += len(text)

    def encode(self) -> list[list[int]]:
        """Ids of every distinct word."""
        return self.replay.encode_words(list(self.number))


@lru_cache(maxsize=2)
def _replay(path: str, pattern: str) -> Replay:
    return Replay(path, pattern)


def encode(
    docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text",
    ids: bool = True, decoded: bool = True,
) -> DataFrame:
    """Token ids of every text, the bytes decoded from them, and digests of both.

    Keeps the other columns and adds ``n_tokens``, ``ids`` (array of int), ``decoded`` (binary),
    ``ids_sha256`` (of decimal ids joined by a space) and ``decoded_sha256``; a column of such a
    name is replaced. ``ids`` and ``decoded`` can be left out. ``ranks`` is a file of base64 tokens
    and ranks that every node can read at the same place.
    """
    path, cut = ranks or default_ranks(), pattern or default_pattern()
    new = ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    own = [c for c in docs.columns if c not in new and c != text]
    kept = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`"))
    extra = [("n_tokens", "bigint")]
    extra += [("ids", "array<int>")] * ids + [("decoded", "binary")] * decoded
    extra += [("ids_sha256", "string"), ("decoded_sha256", "string")]
    schema = StructType(list(kept.schema.fields))
    for name, kind in extra:
        schema = schema.add(StructType.fromDDL(f"{name} {kind}").fields[0])

    def finish(corpus: Corpus, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = corpus.replay
        words = corpus.encode()
        sizes = np.array([len(w) for w in words], np.int64)
        written, back = [replay.written(w) for w in words], [replay.decode(w) for w in words]
        rest = iter(corpus.texts)
        for batch in held:
            made: dict[str, list] = {name: [] for name, _ in extra}
            for numbers in (next(rest) for _ in range(batch.num_rows)):
                made["n_tokens"].append(int(sizes[numbers].sum()))
                order = numbers.tolist()
                made["ids_sha256"].append(hashlib.sha256(b" ".join([written[k] for k in order])).hexdigest())
                whole = b"".join([back[k] for k in order])
                made["decoded_sha256"].append(hashlib.sha256(whole).hexdigest())
                if ids:
                    made["ids"].append(list(chain.from_iterable([words[k] for k in order])))
                if decoded:
                    made["decoded"].append(whole)
            columns = [pa.array(made[name], type=kind) for (name, _), kind in zip(extra, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *[n for n, _ in extra]]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, held = Corpus(_replay(path, cut)), []
        for batch in batches:
            for t in batch.column(batch.num_columns - 1).to_pylist():
                corpus.add(t or "")
            held.append(batch)
            if corpus.size >= TOGETHER:
                yield from finish(corpus, held)
                corpus, held = Corpus(corpus.replay), []
        yield from finish(corpus, held)

    types = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "string": pa.string()}
    kinds = [types[kind] for _, kind in extra]
    batched(docs.sparkSession)
    return kept.mapInArrow(run, schema)
