"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

A rule says good (+1), bad (-1) or abstains (0). Documents are counted by their pattern of
votes; the number of patterns is bounded by 3 to the number of rules whatever the number of
documents. Expectation-maximisation on these counts estimates the share of good documents and
each rule's accuracy, and a document's verdict is its posterior probability of being good.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, map_texts

#: Names of the rules, in the order of the votes.
RULES = ("length", "repeats", "dup_lines", "symbols", "word_length", "alphabet", "line_ends", "stop_words", "symbol_share")
#: A rule's accuracy is assumed to be at least this, so that good and bad cannot swap.
LEAST_ACCURACY = 0.55
#: Where two estimates differ by less, the fit has converged.
TOLERANCE = 1e-8
_WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = _WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.array([put(w, len(number)) for w in words], np.uint64)
    if len(number) == n:
        return 0
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ (ids[k : n - width + 1 + k] + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measures(raw: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules look at."""
    words = raw.split()
    n = len(words)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    ascii_only = raw.isascii()
    points = len(raw) if ascii_only else len(raw.decode("utf-8", "replace"))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = len(raw.translate(None, _NOT_LETTERS))
    stops = sum(map(raw.count, (b" the ", b" of ", b" de ", b" la ", b" der ", b" die ", b" que ", b" and ")))
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b'"', b":")) for x in lines)
    return (n, points - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words),
            len(lines), letters, len(raw) - spaces, stops, ended)


_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def votes(m: tuple) -> list[int]:
    """One vote per rule, in the order of RULES."""
    n, chars, symbols, dup, repeat, lines, letters, solid, stops, ended = m
    if n == 0:
        return [-1] + [0] * (len(RULES) - 1)
    mean = chars / n
    return [
        -1 if n < 20 else 1 if n >= 50 else 0,
        -1 if 100 * repeat > 30 * n else 1 if 100 * repeat <= 10 * n else 0,
        (-1 if 10 * dup > 3 * lines else 1 if 10 * dup <= lines else 0) if lines > 1 else 0,
        -1 if 10 * symbols > n else 1 if 50 * symbols <= n else 0,
        -1 if mean < 2 or mean > 14 else 1 if 3 <= mean <= 10 else 0,
        -1 if 10 * letters < 6 * solid else 1 if 10 * letters >= 8 * solid else 0,
        (1 if 2 * ended >= lines else -1 if 10 * ended < lines else 0) if lines else 0,
        1 if n >= 30 and 50 * stops >= n else -1 if n >= 100 and stops == 0 else 0,
        -1 if 5 * symbols > n else 1 if 20 * symbols <= n else 0,
    ]


def fit(patterns: np.ndarray, counts: np.ndarray, tolerance: float = TOLERANCE, rounds: int = 5000) -> dict:
    """Share of good documents, and per rule P(vote | good) and P(vote | bad).

    Starts from the majority of votes and repeats until the share and all accuracies stand
    still (after ``rounds`` at the latest). Votes are independent given the class; every probability is smoothed by one
    document, and a rule stays on its side: among votes cast, good ones are at least
    ``LEAST_ACCURACY`` for its own class.
    """
    total = counts.sum()
    m = patterns.shape[1]
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = 1 / (1 + np.exp(-2.0 * patterns.sum(1)))
    share, before = 0.8, None
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        for c, weight in ((0, (1 - good) * counts), (1, good * counts)):
            t = np.einsum("p,pmv->mv", weight, one_hot) + 1 / 3
            cast = t[:, 0] + t[:, 2]
            own = np.clip(t[:, 2 * c] / cast, LEAST_ACCURACY, 1)
            t[:, 2 * c], t[:, 2 - 2 * c] = own * cast, (1 - own) * cast + 1e-9
            table[c] = t / t.sum(1, keepdims=True)
        share = float(np.clip((good @ counts + 1) / (total + 2), 0.01, 0.99))
        state = np.append(table.ravel(), share)
        if before is not None and np.abs(state - before).max() < tolerance:
            break
        before = state
        log = np.einsum("pmv,cmv->cp", one_hot, np.log(table)) + np.log([[1 - share], [share]])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return {"share": share, "table": table, "good": good}


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", cut: float = 0.5) -> DataFrame:
    """Measures, votes and the posterior quality of every document.

    Returns ``key``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``votes`` (one small integer per rule),
    ``quality`` (posterior probability of good) and ``kept``. A null text counts as empty;
    it fails the base rule. Documents that fail it are never kept; the posterior decides on
    the rest. Rows with the same key are judged one by one.
    """
    spark = docs.sparkSession

    def work(cols: dict) -> dict:
        rows = [measures(x) for x in cols["_raw"]]
        cast = [votes(m) for m in rows]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {name: [m[i] for m in rows] for i, name in enumerate(names)}
        out["pattern"] = [sum((v + 1) * 3**i for i, v in enumerate(x)) for x in cast]
        return {key: cols[key]} | out

    kind = dict(docs.dtypes)[key]
    measured = map_texts(
        docs.select(F.col(key), as_bytes(text).alias("_raw")),
        work,
        f"`{key}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, pattern int",
    )
    from plumbline.session import materialize

    measured = materialize(measured)
    seen = measured.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** rules rows
    codes = np.array([r[0] for r in seen], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1 if len(codes) else np.zeros((0, len(RULES)), int)
    good = fit(patterns, np.array([r[1] for r in seen], float))["good"] if len(codes) else []
    learned = spark.createDataFrame(
        pd.DataFrame({"pattern": codes.astype(np.int32), "quality": np.asarray(good, float)}),
        "pattern int, quality double",
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.join(F.broadcast(learned), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= cut))
        .withColumn("votes", F.array(*[
            (F.floor(F.col("pattern") / 3**i) % 3 - 1).cast("tinyint") for i in range(len(RULES))]))
        .select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept", "quality", "votes")
    )
