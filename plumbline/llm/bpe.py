"""Byte-level BPE in batched merge rounds.

The words of a batch lie behind each other in one array of symbols. A round looks all
neighbouring pairs up by binary search in the sorted pair keys, takes the lowest rank of
each word and merges its occurrences from the left. Words without a known pair leave.
A merge can only make pairs that were learned later, so merging all occurrences of the
lowest pair at once gives what merging them one by one gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched

#: Fixed value: white space as the tokenizer's pattern understands it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the published pattern of byte-level pre-tokens, with \s spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Words that a worker remembers; beyond, it starts anew.
REMEMBERED = 100_000
_NONE = np.iinfo(np.int32).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Merge table of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain}
        shown |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.first = np.array([vocab[c] for c, _ in sorted(shown.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks = pairs[order], order.astype(np.int32)
        self.results = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        self.text_len = np.array([len(p) for p in pieces], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_words = [], []
        while len(flat):
            rank = np.full(len(flat), _NONE, np.int32)
            key = flat[:-1] << 32 | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(starts, append=len(flat))
            own = np.repeat(lowest, lengths)
            if (over := own == _NONE).any():
                done_ids.append(flat[over])
                done_words.append(word[over])
                flat, word, rank, own = (x[~over] for x in (flat, word, rank, own))
                at = np.append(at, 0)[~over]
                if not len(flat):
                    break
            else:
                at = np.append(at, 0)
            pick = rank == own
            begins = pick & ~np.concatenate(([False], pick[:-1]))
            index = np.arange(len(flat))
            since = index - np.maximum.accumulate(np.where(begins, index, 0))
            pick &= since % 2 == 0  # of overlapping occurrences the left one
            flat = np.where(pick, self.results[at], flat)
            keep = ~np.concatenate(([False], pick[:-1]))
            flat, word = flat[keep], word[keep]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def split(self, text: str) -> list[str]:
        """Pre-tokens; an added token stands for itself, marked by a leading NUL pair."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += ["\0\0" + part] if part in self.special else self.words.findall(part)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        raw = self.text[_gather(self.text_at[ids], self.text_len[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


class Memory:
    """Ids of the words that a worker has met, in one growing array."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self.clear()
        number, known = self.number, len(self.number)
        index: list[int] = []
        sizes = []
        put = number.setdefault
        for text in texts:
            words = self.encoder.split(text)
            sizes.append(len(words))
            index += [put(w, len(number)) for w in words]
        fresh = list(number)[known:] if len(number) > known else []
        if fresh:
            special = self.encoder.special
            marked = [i for i, w in enumerate(fresh) if w.startswith("\0\0") and w[2:] in special]
            ids, lengths = self.encoder.merge([b"" if i in set(marked) else w.encode() for i, w in enumerate(fresh)])
            if marked:
                at = np.cumsum(lengths) - lengths
                ids = np.insert(ids, at[marked], [special[fresh[i][2:]] for i in marked])
                lengths[marked] = 1
            self.ids = np.concatenate((self.ids, ids))
            self.lengths = np.concatenate((self.lengths, lengths))
        starts = np.cumsum(self.lengths) - self.lengths
        chosen = np.array(index, np.int64)
        lengths = self.lengths[chosen]
        ids = self.ids[_gather(starts[chosen], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *sizes])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(
    docs: DataFrame, vocabulary: str | None = None, text: str = "text", ids: bool = True, decoded: bool = True
) -> DataFrame:
    """Token ids of every text, the text decoded from them, and digests of both.

    Keeps the other columns and adds ``n_tokens``, ``ids`` (array of int), ``decoded``,
    ``ids_sha256`` and ``decoded_sha256``; a column of such a name is replaced. ``ids`` and
    ``decoded`` can be left out. A null or empty text has no tokens. ``vocabulary`` is a file
    that every node can read at the same place.
    """
    path = vocabulary or default_vocabulary()
    new = ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    own = [c for c in docs.columns if c not in new and c != text]
    kept = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`"))
    extra = [("n_tokens", "bigint")]
    extra += [("ids", "array<int>")] * ids + [("decoded", "string")] * decoded
    extra += [("ids_sha256", "string"), ("decoded_sha256", "string")]
    from pyspark.sql.types import StructType

    schema = StructType(list(kept.schema.fields))
    for name, kind in extra:
        schema = schema.add(StructType.fromDDL(f"{name} {kind}").fields[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        memory = Memory(encoder)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            coded = memory.encode(texts)
            back = [encoder.decode(x) for x in coded]
            made = [pa.array([len(x) for x in coded], pa.int64())]
            if ids:
                flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
                made.append(pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, coded)]), pa.int32()), pa.array(flat)))
            if decoded:
                made.append(pa.array([x.decode() for x in back], pa.string()))
            made.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]))
            made.append(pa.array([hashlib.sha256(x).hexdigest() for x in back]))
            names = [*batch.schema.names, *[n for n, _ in extra]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    batched(docs.sparkSession)
    return kept.mapInArrow(run, schema)
