"""Lexical search, periodic runs and merge replay against plain versions and the tokenizer library."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import fixtures as fx
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import lexical_search, merge_replay, periodic_runs
from plumbline.llm.common import bit_filter

CLASH = ["runs", "n_words", "collapsed", "_tail_of", "ids", "decoded", "n_tokens", "bag", "term", "score"]


# --- lexical search


def plain_terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(rows, items, k=10):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scored = []
        for i, c, length in docs:
            m = 100 - 75 + ((75 * length * n) // total)
            s = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items() if t in c
            )
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [
            (item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)
        ]
    return out


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [
    (1, "alpha1 beta2 gamma3, alpha1 ALPHA1"), (2, "Ünï 中文 cödé"), (3, ""), (4, None), (5, "nowhere else"),
    (6, fx.prose(2, 40)), (7, "one two three"), (8, "a line is here"), (None, "one"), (6, fx.prose(2, 40)), (9, "\x00!~"),
]


def test_search_like_a_scan(spark):
    rows = [*fx.texts(), *[(100 + k, fx.prose(500 + k, 30)) for k in range(300)], (61, "one"), (61, "one"), (62, "one")]
    docs = fx.documents(spark, rows, CLASH).repartition(3)
    got = found(lexical_search.search(docs, items(spark, ITEMS)))
    assert got == sorted(plain_search(rows, ITEMS), key=str)


def test_search_over_many_shards_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_DOCUMENTS", 70), ("BLOCK", 8), ("WINDOW", 16), ("QUERY_TERMS", 20)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(7)
    rows = [(k // 2, " ".join(rng.choice(fx.WORDS) for _ in range(rng.randrange(60)))) for k in range(400)]
    rows += [(900 + k, "alpha alpha beta") for k in range(40)]
    asked = [(k, " ".join(rng.choice(fx.WORDS) for _ in range(rng.randrange(1, 9)))) for k in range(25)]
    got = found(lexical_search.search(fx.documents(spark, rows), items(spark, asked)))
    assert got == sorted(plain_search(rows, asked), key=str)


def test_search_of_empty_tables(spark):
    assert found(lexical_search.search(fx.documents(spark, []), items(spark, ITEMS))) == []
    assert found(lexical_search.search(fx.documents(spark, [(1, None), (2, " ,. ")]), items(spark, ITEMS))) == []
    assert found(lexical_search.search(fx.documents(spark), items(spark, []))) == []


def test_blocks_are_rejected_unread(spark):
    """A rare word leads; most blocks of the frequent one are never decompressed."""
    bitmap = bit_filter(
        spark.createDataFrame([("common",), ("rare",)], "term string"),
        F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << lexical_search.FILTER_BITS)), lexical_search.FILTER_BITS,
    )
    shard = lexical_search._Shard(bitmap)
    for k in range(12_000):
        shard.add(k, [b"common"] * (1 + k % 3) + [b"rare"] * (k % 400 == 7) + [b"other"] * 5)
    row = shard.row()
    row = {k: v if k in ("doc_ids", "terms", "body") else np.asarray(v) for k, v in row.items()}
    searcher = lexical_search.Searcher(row, 12_000, shard.total)
    at, score = searcher.search([(b"common", 2), (b"rare", 6000)], 10)
    assert all(k % 400 == 7 for k in at.tolist()) and len(at) == 10
    blocks = len(searcher.size)
    assert searcher.read < blocks / 2
    whole = lexical_search.Searcher(row, 12_000, shard.total)
    sums = np.zeros(12_000, np.int64)
    for t, w in ((b"common", 2), (b"rare", 6000)):
        whole._add(whole.list_of[t], w, 0, 12_000, sums)
    order = np.lexsort((np.arange(12_000), -sums))[:10]
    assert order.tolist() == at.tolist() and sums[order].tolist() == score.tolist()
    assert whole.read == blocks


# --- periodic runs


def plain_runs(words, shortest=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(shortest, 2 * q):
                out.setdefault((start, i + q - start), q)
    return sorted((s, q, length) for (s, length), q in out.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return [c.encode() for c in b[:n]]


def runs_of(texts, shortest=12):
    out = [[] for _ in texts]
    for t, s, length, q in zip(*periodic_runs.find_runs(texts, shortest), strict=True):
        out[t].append((int(s), int(q), int(length)))
    return out


def test_runs_like_a_scan():
    rng = random.Random(1)
    texts = [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a"] * 400, fibonacci(300), ([b"a"] * 60 + [b"b"]) * 6]
    for _ in range(300):
        w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 40])) for _ in range(rng.randrange(150))]
        if w and rng.random() < 0.6:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randrange(2, 9)
            w = w[:a] + (w[a : a + p] * len(w))[: len(w) - a]
        texts.append(w)
    for shortest in (12, 5):
        assert runs_of(texts, shortest) == [plain_runs(w, shortest) for w in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), max_size=4))
def test_runs_of_few_words(texts):
    assert runs_of(texts) == [plain_runs(w) for w in texts]


def test_runs_of_long_texts():
    """Half a million equal words, and a stretch of 50,000 words that stands four times."""
    assert runs_of([[b"a"] * 500_000]) == [[(0, 1, 500_000)]]
    rng = random.Random(2)
    stretch = [b"%d" % rng.randrange(10**6) for _ in range(50_000)]
    assert runs_of([stretch * 4, [b"x"]]) == [[(0, 50_000, 200_000)], []]


def test_squares_of_differences_are_exact():
    """Matches of blocks against a plain comparison, where one prime is too small for the sums."""
    rng = np.random.default_rng(0)
    for top in (3, 200_000):
        window = rng.integers(0, top, (20, 95))
        block = np.stack([w[k : k + 32] for k, w in enumerate(window)])
        want = np.array([[bool((w[lag : lag + 32] == b).all()) for lag in range(64)] for b, w in zip(block, window, strict=True)])
        assert (periodic_runs.block_matches(block, window, 64, top) == want).all()
        assert want.sum() >= 20
    with pytest.raises(ValueError):
        periodic_runs.block_matches(block, window, 64, 1 << 32)


def plain_document(doc_id, text):
    words = fx.words(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    return (
        doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, q, length in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def runs_query(docs):
    found = periodic_runs.find(docs, tail_of="doc_id").withColumn("best", periodic_runs.longest())
    return found.select(
        "doc_id", F.size("runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")),
        F.sha2(periodic_runs.listed().cast("binary"), 256), F.sha2(F.col("collapsed").cast("binary"), 256),
    )


def test_runs_of_documents(spark):
    rows = [(i, t) for i, t in fx.texts() if t is None or len(t) < 20_000]
    rows += [(200 + k, fx.prose(k, 40 + 5 * k)) for k in range(60)]
    rows += [(300, "to be or not " * 30), (301, "ha " * 400 + "end"), (300, "to be or not " * 30)]
    got = [tuple(r) for r in runs_query(fx.documents(spark, rows, CLASH)).collect()]
    assert sorted(got, key=str) == sorted((plain_document(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 8


def test_runs_keep_other_columns(spark):
    got = periodic_runs.find(fx.documents(spark, [(1, "a b " * 20)], ["size"])).first()
    assert got["size"] == "clash" and got["n_words"] == 40 and got["collapsed"] == "a b"
    assert [tuple(r) for r in got["runs"]] == [(0, 40, 2)]
    assert runs_query(fx.documents(spark, [])).collect() == []


# --- merge replay


def library(path, ranks=None):
    if ranks is None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def replayed(replay, texts):
    corpus = merge_replay.Corpus(replay)
    for t in texts:
        corpus.add(t)
    words = corpus.encode()
    return [[i for k in numbers for i in words[k]] for numbers in corpus.texts]


@pytest.fixture(scope="module")
def own():
    path = merge_replay.default_ranks()
    return library(path)[0], merge_replay.Replay(path, merge_replay.default_pattern())


def odd_texts():
    rng = random.Random(3)
    sets = ["abcdefgh inst", "aeiou\n\t ", "中文字符测试🙂", "'sdretvm l0123", "\x1c\x85　 x", "aaab"]
    return ["".join(rng.choice(rng.choice(sets)) for _ in range(rng.randrange(120))) for _ in range(400)]


def test_replay_like_the_library(spark, own):
    encoding, _ = own
    rows = [*fx.texts(), *[(1000 + k, t) for k, t in enumerate(odd_texts())], (70, "a" * 5000), (71, "xyz" * 9000)]
    got = merge_replay.encode(fx.documents(spark, rows, CLASH)).collect()
    want = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        back = encoding.decode_bytes(ids)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(back).hexdigest(), ids, back))
        assert back == (t or "").encode()
    have = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"], bytes(r["decoded"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r["lang"] == "en" and r["runs"] == "clash" for r in got)
    assert merge_replay.encode(fx.documents(spark, [])).collect() == []


def test_replay_in_small_portions(spark, own, monkeypatch):
    monkeypatch.setattr(merge_replay, "TOGETHER", 300)
    monkeypatch.setattr(merge_replay, "STRETCH", 7)
    replay = own[1]
    texts = odd_texts()[:40]
    assert replayed(replay, texts) == [own[0].encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_replay_of_any_text(texts):
    path = merge_replay.default_ranks()
    replay = merge_replay._replay(path, merge_replay.default_pattern())
    for t, ids in zip(texts, replayed(replay, texts), strict=True):
        assert b"".join(replay.piece[i] for i in ids) == t.encode()
        assert ids == library_of(path).encode_ordinary(t)


def library_of(path, known={}):  # noqa: B006
    if path not in known:
        known[path] = library(path)[0]
    return known[path]


def test_ranks_that_part_merges_from_their_order(tmp_path, own):
    """Shuffled ranks let a merge make pairs of lower rank: those words are encoded alone."""
    _, ranks = library(merge_replay.default_ranks())
    rng = random.Random(5)
    few = [t for t in ranks if 1 < len(t) < 5][:3000]
    numbers = [ranks[t] for t in few]
    rng.shuffle(numbers)
    mixed = {t: r for t, r in ranks.items() if len(t) == 1} | dict(zip(few, numbers, strict=True))
    path = tmp_path / "mixed.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in mixed.items()))
    encoding, _ = library(None, mixed)
    replay = merge_replay.Replay(str(path), public_tokenizers.PATTERN)
    alone, kept = [], replay.alone
    replay.alone = lambda w: alone.append(w) or kept(w)
    texts = [*odd_texts(), *[fx.prose(k, 80) for k in range(10)], "the entire sentence in words " * 5]
    assert replayed(replay, texts) == [encoding.encode_ordinary(t) for t in texts]
    assert alone


def test_replay_is_linear_in_a_word(own):
    """A word of 300,000 letters keeps its bytes and has no pair left to merge."""
    rng = random.Random(6)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(300_000))
    replay = own[1]
    (ids,) = replay.encode_words([word])
    assert replay.decode(ids) == word.encode()
    pairs = replay.tokens_of(np.array(ids[:-1]), np.array(ids[1:]))
    assert (pairs == -1).all()
