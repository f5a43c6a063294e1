"""Maximal periodic runs of words, found by exact block convolution.

A run with smallest period q repeats each of its words q places later, over a zone of at least
q words (12 - q, if that is more). So for 2B - 1 <= q < 4B - 1 the zone holds a whole block of B
words that starts at a multiple of B, and that block stands again, without a mismatch, q places
later. At each dyadic B the sum of squared differences between a block and every place of the
window behind it is one cyclic convolution. It is done in integers, by number-theoretic
transforms modulo as many primes as the largest possible sum needs, so a zero is a true match.
The distances of the matches seed extensions to both sides, which give the runs.

Blocks that cannot match are left out before the transform: a block holding a word that does not
recur inside the window, and a block that lies, window included, in a run already found whose
period is at most B (every match there is a multiple of that period, the same run again).

Cases: a null or empty text has no words and no runs; its two digests are those of the empty
string. A null id counts as the empty string in crc32. Repeated rows are judged row by row.
Matches never leave a text, however long; a batch of texts is convolved together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import batched

#: Primes of the transforms and a generator of each; 2^26 divides p - 1, so texts may have 2^26 words.
PRIMES = ((2013265921, 31), (469762049, 3))
#: Elements of one matrix of transforms.
CELLS = 1 << 20
SHORTEST = 12


def _roots(p: int, g: int, size: int) -> list[np.ndarray]:
    """Powers of the root of unity for each stage of a transform of ``size``."""
    out = []
    half = size // 2
    while half:
        w = pow(g, (p - 1) // (2 * half), p)
        powers = np.ones(1, np.uint64)
        step = w
        while len(powers) < half:
            powers = np.concatenate((powers, powers * np.uint64(step) % np.uint64(p)))
            step = step * step % p
        out.append(powers[:half])
        half //= 2
    return out


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    return x - x // np.uint64(p) * np.uint64(p)


def _forward(rows: np.ndarray, p: int, roots: list[np.ndarray]) -> np.ndarray:
    """Transform of each row, in bit-reversed order."""
    count, size = rows.shape
    x = rows
    for powers in roots:
        half = len(powers)
        x = x.reshape(-1, 2, half)
        low, high = x[:, 0], x[:, 1]
        total = low + high
        total = np.where(total >= p, total - np.uint64(p), total)
        gap = _mod((low + np.uint64(p) - high) * powers, p)
        x = np.stack((total, gap), axis=1)
    return x.reshape(count, size)


def _inverse(rows: np.ndarray, p: int, roots: list[np.ndarray]) -> np.ndarray:
    """Rows back from bit-reversed transforms; roots are those of the inverse."""
    count, size = rows.shape
    x = rows
    for powers in reversed(roots):
        half = len(powers)
        x = x.reshape(-1, 2, half)
        low, high = x[:, 0], _mod(x[:, 1] * powers, p)
        total = low + high
        total = np.where(total >= p, total - np.uint64(p), total)
        gap = low + np.uint64(p) - high
        gap = np.where(gap >= p, gap - np.uint64(p), gap)
        x = np.stack((total, gap), axis=1)
    return _mod(x.reshape(count, size) * np.uint64(pow(size, -1, p)), p)


class Transforms:
    """Cross-correlations modulo one prime, with the roots of every size met."""

    def __init__(self, p: int, g: int) -> None:
        self.p, self.g = p, g
        self.tables: dict[int, tuple] = {}

    def correlate(self, block: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Sum over t of block[t] * window[l + t] for every l, row by row (cyclic)."""
        size = window.shape[1]
        if size not in self.tables:
            self.tables[size] = _roots(self.p, self.g, size), _roots(self.p, pow(self.g, -1, self.p), size)
        ahead, back = self.tables[size]
        turned = np.zeros_like(window)
        turned[:, 0] = block[:, 0]
        turned[:, size - block.shape[1] + 1 :] = block[:, :0:-1]  # index -t holds block[t]
        product = _mod(_forward(turned, self.p, ahead) * _forward(window, self.p, ahead), self.p)
        return _inverse(product, self.p, back)


_TRANSFORMS = [Transforms(p, g) for p, g in PRIMES]


def block_matches(block: np.ndarray, window: np.ndarray, lags: int, largest: int) -> np.ndarray:
    """Flags [row, lag]: the block stands in the window at that lag without a mismatch.

    Values are below ``largest``; rows of ``window`` hold at least lags + block - 1 values.
    """
    width = block.shape[1]
    needed = width * (largest - 1) ** 2
    zero = np.ones((len(block), lags), bool)
    size = 1 << (window.shape[1] - 1).bit_length()
    covered = 1
    for t in _TRANSFORMS:
        p = np.uint64(t.p)
        b, w = block.astype(np.uint64), np.zeros((len(window), size), np.uint64)
        w[:, : window.shape[1]] = window
        cross = t.correlate(b, w)[:, :lags]
        own = _mod(_mod(b * b, t.p).sum(axis=1, dtype=np.uint64), t.p)
        squares = np.zeros((len(w), size + 1), np.uint64)
        np.cumsum(_mod(w * w, t.p), axis=1, out=squares[:, 1:])
        moving = _mod(squares[:, width : width + lags] - squares[:, :lags], t.p)
        zero &= _mod(own[:, None] + moving + np.uint64(2) * (p - cross), t.p) == 0
        covered *= t.p
        if covered > needed:
            return zero
    raise ValueError(f"sums of squares up to {needed} exceed the product of the primes")


def _codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Words of all texts in a row as numbers (dense within a text), text borders, the distance to
    the next occurrence of the same word, and the largest number plus one."""
    number: dict[bytes, int] = {}
    put = number.setdefault
    flat = np.array([put(w, len(number)) for words in texts for w in words], np.int64)
    ends = np.cumsum([0, *map(len, texts)])
    n = len(flat)
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    key = text * max(1, len(number)) + flat
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    rank = np.cumsum(new) - 1
    first_rank = np.full(len(texts) + 1, 0, np.int64)
    if n:
        leads = order[new]
        first_rank = np.searchsorted(text[leads], np.arange(len(texts)))
    code = np.empty(n, np.int64)
    code[order] = rank - first_rank[text[order]] if n else rank
    ahead = np.full(n, n + 1, np.int64)
    if n:
        same = np.flatnonzero(~new)
        ahead[order[same - 1]] = order[same] - order[same - 1]
    return code, ends, ahead, int(code.max()) + 1 if n else 0


def _reach(code: np.ndarray, at: np.ndarray, gap: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (step 1) or before it (step -1) equal those ``gap`` later, up to ``limit``."""
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(limit > 0)
    width = 8
    while len(live):
        for part in np.array_split(live, max(1, len(live) * width // CELLS)):
            offset = np.arange(width)
            left = limit[part] - out[part]
            place = at[part, None] + step * (out[part, None] + offset)
            inside = offset < left[:, None]
            place = np.where(inside, place, 0)
            same = inside & (code[place] == code[np.where(inside, place + gap[part, None], 0)])
            out[part] += np.where(same.all(axis=1), width, same.argmin(axis=1))
            limit[part] = np.where(same.all(axis=1), limit[part], out[part])
        live = live[out[live] < limit[live]]
        width = min(2 * width, CELLS)
    return out


def find_runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and smallest period of every run, by text, start and period.

    A run has at least two periods and ``shortest`` words (5 or more, so that the smallest blocks fit)."""
    if shortest < 5:
        raise ValueError("runs of fewer than 5 words are not looked for")
    code, ends, ahead, largest = _codes(texts)
    sizes = np.diff(ends)
    found = [np.zeros((0, 4), np.int64)]  # text, start and end in the row of all words, period
    last = int(sizes.max(initial=0))
    width, low = 2, 1
    while low <= last // 2:
        high = 4 * width - 2
        able = np.flatnonzero(sizes >= max(2 * low, shortest))
        blocks = (sizes[able] - low) // width
        text = np.repeat(able, blocks)
        start = ends[text] + width * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        lost = np.concatenate(([0], np.cumsum(ahead > high)))
        keep = lost[start + width] == lost[start]
        text, start = text[keep], start[keep]
        runs = np.concatenate(found)
        if len(start) and len(runs):
            keep = ~_covered(runs[runs[:, 3] <= width], start, np.minimum(ends[text + 1], start + width + high))
            text, start = text[keep], start[keep]
        if len(start):
            found.append(_scale(code, ends, largest, text, start, width, low, high, runs, shortest))
        low, width = high + 1, 2 * width
    runs = np.concatenate(found)
    order = np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))
    runs = runs[order]  # a stretch found with several periods keeps the smallest
    same = (np.diff(runs[:, 1], prepend=-1) == 0) & (np.diff(runs[:, 2], prepend=-1) == 0)
    runs = runs[~same]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1]))]
    return runs[:, 0], runs[:, 1] - ends[runs[:, 0]], runs[:, 2] - runs[:, 1], runs[:, 3]


def _covered(runs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether one of the runs spans [start, end)."""
    if not len(runs):
        return np.zeros(len(start), bool)
    order = np.argsort(runs[:, 1], kind="stable")
    begins, furthest = runs[order, 1], np.maximum.accumulate(runs[order, 2])
    at = np.searchsorted(begins, start, "right") - 1
    return (at >= 0) & (furthest[at] >= end)


def _scale(
    code: np.ndarray, ends: np.ndarray, largest: int, text: np.ndarray, start: np.ndarray,
    width: int, low: int, high: int, runs: np.ndarray, shortest: int,
) -> np.ndarray:
    """Runs with periods low..high seeded by the blocks of ``width`` words at ``start``."""
    lags = high - low + 1
    span = lags + width - 1
    texts, places, gaps = [], [], []
    n = len(code)
    rows = max(1, CELLS // (4 * width))
    for a in range(0, len(start), rows):
        s, t = start[a : a + rows], text[a : a + rows]
        block = code[s[:, None] + np.arange(width)]
        at = s[:, None] + low + np.arange(span)
        window = np.where(at < ends[t + 1][:, None], code[np.minimum(at, n - 1)], largest)  # no word has this number
        hit, lag = np.nonzero(block_matches(block, window, lags, largest + 1))
        texts.append(t[hit])
        places.append(s[hit])
        gaps.append(lag + low)
    t, s, q = (np.concatenate(x) for x in (texts, places, gaps))
    order = np.lexsort((s, q, t))
    t, s, q = t[order], s[order], q[order]
    lead = np.ones(len(s), bool)  # neighbouring blocks with one distance lie in one zone
    lead[1:] = (t[1:] != t[:-1]) | (q[1:] != q[:-1]) | (s[1:] != s[:-1] + width)
    tail = np.append(lead[1:], True)[: len(s)]
    first, last, t, q = s[lead], s[tail] + width, t[lead], q[lead]
    old = runs[runs[:, 3] < low]
    if len(first) and len(old):  # a multiple of the period of a run that holds block and copy is that run
        known = np.zeros(len(first), bool)
        for p in np.unique(old[:, 3]):
            multiple = np.flatnonzero(q % p == 0)
            known[multiple] |= _covered(old[old[:, 3] == p], first[multiple], last[multiple] + q[multiple])
        first, last, t, q = first[~known], last[~known], t[~known], q[~known]
    begin = first - _reach(code, first - 1, q, first - ends[t], -1)
    stop = last + _reach(code, last, q, ends[t + 1] - last - q, 1)
    good = stop - begin >= np.maximum(q, shortest - q)
    return np.stack((t[good], begin[good], stop[good] + q[good], q[good]), axis=1)


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Of one document in ten, the words from a place on become a stretch that repeats."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[: n - a]


def find(docs: DataFrame, text: str = "text", tail_of: str | None = None) -> DataFrame:
    """Runs of each text, and the text with every run cut back to its first period.

    Keeps the other columns; adds ``runs`` (array of start, length, period by start and period),
    ``n_words`` and ``collapsed`` (the words that stay, joined by one space), replacing columns of
    these names. ``tail_of`` names an id column by which ``repeated_tail`` changes texts first.
    """
    new = ["runs", "n_words", "collapsed"]
    own = [c for c in docs.columns if c not in new and c != text]
    hidden = "_tail_of"
    while hidden in docs.columns:
        hidden += "_"
    kept = docs.select(
        *[F.col(f"`{c}`") for c in own], F.col(f"`{text}`"),
        (F.col(f"`{tail_of}`") if tail_of else F.lit(None)).cast("bigint").alias(hidden),
    )
    schema = StructType(list(kept.schema.fields)[:-1])
    for field in StructType.fromDDL(
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, n_words bigint, collapsed string"
    ):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column(batch.num_columns - 2).to_pylist()]
            if tail_of:
                ids = batch.column(batch.num_columns - 1).to_pylist()
                texts = [repeated_tail(w, i) for w, i in zip(texts, ids, strict=True)]
            number, start, length, period = find_runs(texts)
            border = np.searchsorted(number, np.arange(len(texts) + 1))
            collapsed = []
            for k, words in enumerate(texts):
                a, b = border[k], border[k + 1]
                if a < b:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start[a:b] + period[a:b], 1)
                    np.add.at(edge, start[a:b] + length[a:b], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                collapsed.append(b" ".join(words).decode())
            rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            made = [
                pa.ListArray.from_arrays(pa.array(border, pa.int32()), rows),
                pa.array([len(w) for w in texts], pa.int64()),
                pa.array(collapsed, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *new])

    batched(docs.sparkSession)
    return kept.mapInArrow(run, schema)


def listed(runs: str = "runs") -> Column:
    """``start,length,period`` and a line feed for every run, joined."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def longest(runs: str = "runs") -> Column:
    """The run of greatest length; of equal ones the first start, then the smallest period. Null if none."""
    ranked = F.transform(
        runs, lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    )
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))
