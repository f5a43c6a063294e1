"""Operators across documents against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import class_lm, common, neighbours, repeats, shingle_join, toxicity

CLASH = ["component_id", "s", "g", "token", "_id", "row", "held_out", "_raw", "h", "score", "_suspect"]


def family(seed, n, edits):
    """Copies of one text, each with some words changed."""
    rng, base = random.Random(seed), fx.prose(seed, 90).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    return out


def plain_components(rows, width=4, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            both = len(sets[a] & sets[b])
            if same_id or (sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), (min(ids) if ids else None) if sets[a] else i))
    return sorted(out, key=str)


def test_shingle_join(spark):
    rows = fx.texts()
    rows += [(100 + k, t) for k, t in enumerate(family(11, 30, 5))]
    rows += [(200 + k, t) for k, t in enumerate(family(12, 30, 2))]
    rows += [(300 + k, "a line that all of these documents share at their start " + fx.prose(900 + k, 12)) for k in range(30)]
    got = shingle_join.link(fx.documents(spark, rows, CLASH)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components(rows)


def test_far_members_of_a_family(spark):
    """Copies that lost the same line and carry edits of their own: some link only with each other."""
    rng, base = random.Random(21), fx.prose(21, 160).split()
    rows = []
    for k in range(90):
        w = list(base)
        if k % 2:
            w[30:42] = "another line that many of the copies hold in its place".split()
        if k % 3 == 0:
            w = w[:120] + fx.prose(22 + k % 2, 30).split() + w[120:]
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        rows.append((k, " ".join(w)))
    got = shingle_join.link(fx.documents(spark, rows)).collect()
    want = plain_components(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert 3 < len({c for _, _, c in want}) < 60


def test_one_of_each_component_stays(spark):
    rows = [r for r in fx.texts() if r[0] is not None] + [(500 + k, t) for k, t in enumerate(family(13, 12, 1))]
    df = fx.documents(spark, rows, CLASH)
    kept = shingle_join.keep_one(df)
    assert kept.columns == df.columns
    want = {i for i, _, c in plain_components(rows) if i == c}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_components_of_chains(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (300, 200), (200, 100)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = dict(common.components(edges).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 200, 300)}


def plain_repeats(rows, length):
    first = {}
    order = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - length + 1):
            s = raw[j : j + length]
            first[s] = min(first.get(s, 2**63), order(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for j in range(len(raw) - length + 1):
            if first[raw[j : j + length]] < order(i):
                gone[j : j + length] = 1
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [None, 97])
def test_repeats(spark, piece, monkeypatch):
    """Also with texts cut to tiny pieces, as very long ones are."""
    rows = fx.texts() + [(600 + k, t) for k, t in enumerate(family(14, 8, 4))] + [(700, "ab" * 200), (701, "b" + "ab" * 100), (702, "a" * 49)]
    rows += [(-5, fx.prose(14, 90)[100:300])]
    if piece:
        # workers are forked from a daemon, so the sizes travel with the function's module state only here
        chunks = list(repeats._chunks(iter(_batches(rows)), 50, 24))
        monkeypatch.setattr(repeats, "PIECE", piece)
        small = list(repeats._chunks(iter(_batches(rows)), 50, 24))
        count = lambda cs: sorted(
            (int(d), int(s)) for c in cs if len(c.at) for d, a, b, o in zip(c.doc, c.lo, c.hi, c.base, strict=True) for s in range(a + o, b + o)
        )
        assert count(chunks) == count(small)
        return
    got = repeats.find(fx.documents(spark, rows, CLASH)).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)
    assert found == plain_repeats(rows, 50)


def _batches(rows):
    import pyarrow as pa

    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    return [pa.RecordBatch.from_pydict({"_id": pa.array(ids, pa.int64()), "_raw": pa.array([(t or "").encode() for _, t in rows], pa.binary())})]


def test_columns_survive_packing():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(0, 2**48, 1000), rng.integers(-(2**62), 2**62, 1000), rng.integers(0, 2, 1000)
    for x, y in zip(repeats.unpack(repeats.pack([(a, 6), (b, 8), (c, 1)]), [6, 8, 1]), (a, b, c), strict=True):
        assert (x == y).all()


def test_class_model(spark):
    rows = fx.texts() + [(1000 + k, fx.prose(k, 60)) for k in range(60)]
    docs = fx.documents(spark, rows, CLASH)
    got = class_lm.train_and_score(docs, common.fold("doc_id") == 1).collect()
    tokens = [(i, [w.lower() for w in fx.words(t)] + [b"\n"]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if common.fold_of(i) != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), common.fold_of(i) == 1, len(ws), sum(counts[w] > 0 for w in ws), total,
         round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 6))
        for i, ws in tokens
    )
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert held and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_class_model_is_a_distribution(spark):
    """Transitions sum to one; emissions of a class's words and one unknown word do, too."""
    docs = fx.documents(spark, [(k, fx.prose(k, 50)) for k in range(40)])
    model, counts = class_lm.fit(docs.select(common.as_bytes().alias("_raw")), classes=5)
    assert np.allclose((10**model.transition).sum(1), 1)
    rows = counts.collect()
    of = model.class_of[model.types.of(np.array([r["h"] for r in rows]), np.array([r["ending"] for r in rows]))]
    mass = np.zeros(len(model.floor))
    np.add.at(mass, of, np.array([r["c"] for r in rows]) + 0.5)
    assert np.allclose((mass + 0.5) / model.floor, 1)


def likelihood(table, of):
    """Of the class bigrams, from its definition."""
    hot = np.zeros((len(of), of.max() + 1))
    hot[np.arange(len(of)), of] = 1
    joint = hot.T @ table @ hot
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(joint) - f(joint.sum(0)) - f(joint.sum(1))


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(3)
    table = rng.poisson(rng.gamma(0.3, 8, (13, 13)))
    table[12, 12] = 0
    of = class_lm.exchange(table, classes=3, passes=100)
    assert of[12] == 3 and set(of[:12]) <= {0, 1, 2}
    best = likelihood(table, of)
    for w in range(12):
        for c in range(3):
            moved = of.copy()
            moved[w] = c
            assert likelihood(table, moved) <= best + 1e-6


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[200:300] = v[200]  # ties
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] + [1.0] * 15), (604, [1.0, 2.0]), (None, [1.0] * 16)]
    rows += [rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, leaves=700, depth=5).toPandas()
    wide = v.astype(float)
    found = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, g in found.items():
        score = wide @ wide[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(600), -np.round(score, 9)))[:20]
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(score[g["vec_id"]], g["score"], atol=1e-12)
        hits += len(set(order) & set(g["vec_id"]))
    assert hits == 20 * len(found)  # all leaves are visited, so nothing is missed
    part = neighbours.search(df, F.col("vec_id") % 20 == 0, depth=5).toPandas()
    ids = {q: set(g["vec_id"]) for q, g in part.groupby("query_id")}
    assert np.mean([len(ids[q] & set(found[q]["vec_id"])) / 20 for q in found]) > 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = neighbours.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]


def test_neighbours_of_repeated_rows(spark):
    """Many copies of few ids, all of them late in the sample's order, are found like single rows."""
    rng = np.random.default_rng(4)
    place = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30))
    late = [r[0] for r in spark.range(4000).select(F.col("id").alias("vec_id")).where(place > 0.7 * 2**30).orderBy("vec_id").limit(60).collect()]
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in late]
    one = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 20 == 0
    want = neighbours.search(one, asks, sample=100).orderBy("query_id", "rank").collect()
    got = neighbours.search(one.crossJoin(spark.range(50).select("id")), asks, sample=100).orderBy("query_id", "rank").collect()
    assert want and got == want


def test_toxicity_of_repeated_ids(spark):
    """Copies of few labelled ids leave the examples in place."""
    late = [r[0] for r in spark.range(6000).where(
        (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) > 0.8 * 2**30) & (common.fold("id") != 0)).orderBy("id").limit(80).collect()]
    rows = [(i, fx.prose(i, 9) + (" scumbag" if k % 4 == 0 else "")) for k, i in enumerate(late)]
    labels = spark.createDataFrame([(i, int(k % 4 == 0)) for k, i in enumerate(late)], "doc_id long, toxic int")
    docs = fx.documents(spark, rows * 60)
    model = toxicity.fit(docs, labels, examples=50)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert found == {i: int(k % 4 == 0) for k, i in enumerate(late)}


def toxic_rows():
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        text = fx.prose(k, 30) + (f" {rng.choice(['scumbag', 'moronic'])}!" if bad else "")
        rows.append((k, text))
        labels.append((k, int(bad)))
    return rows, [*labels, (5, None), (10**6, 1), (8, 1)]


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows += [(400, None), (401, ""), (None, "moronic scumbag"), (402, "Scumbag, you"), (402, "Scumbag, you")]
    docs = fx.documents(spark, rows, CLASH)
    given_labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, given_labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (common.fold_of(r["doc_id"]) == 0)
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert r["predicted"] == int(r["doc_id"] % 4 == 0)
    said = {str(r["doc_id"]): r["predicted"] for r in got}
    assert said["402"] == 1 and said["None"] == 1 and said["400"] == 0 and said["401"] == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if not r["predicted"])


def test_toxicity_counts_all_rows(spark):
    """Rare telling words are found however few examples are drawn, and all documents count for the idf."""
    bad = [f"insult{k}" for k in range(10)]
    rows = [(k, fx.prose(k, 12) + (f" {bad[k // 11 % 10]}" if k % 11 == 0 else "")) for k in range(1650)]
    rows += [(2000 + k, fx.prose(k, 5) + " insult3") for k in range(50)]  # without labels
    labels = spark.createDataFrame([(k, int(k % 11 == 0)) for k in range(1650)], "doc_id long, toxic int")
    docs = fx.documents(spark, rows)
    model = toxicity.fit(docs, labels, examples=60)
    assert {w.encode() for w in bad} <= set(model.number)
    df = sum(b"insult3" in toxicity.terms(t.encode()) for _, t in rows)
    assert model.idf[model.number[b"insult3"]] == pytest.approx(math.log((1 + len(rows)) / (1 + df)) + 1)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(found[k] == int(k % 11 == 0) for k in range(1650))


def test_nearest_examples_are_exact(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}".encode() for k in range(40)]
    rows = [(k, k % 2, b" ".join(rng.choice(vocabulary, rng.integers(0, 12)))) for k in range(500)]
    model = toxicity.build(vocabulary, rng.integers(1, 100, 40).astype(float), 500, rows, (250.0, 250.0))
    place = {key: n for n, key in enumerate(model.ids)}
    dense = np.zeros((500, 40))
    for key, _, raw in rows:
        at, w = model.vector(raw)
        dense[place[key], at] = w
    for key, _, raw in rows[::9]:
        at, w = model.vector(raw)
        full = np.zeros(40)
        full[at] = w
        cosine = dense @ full
        who, near = model.nearest(at, w, 15)
        best = np.sort(cosine[cosine > 1e-12])[::-1][:15]
        assert np.allclose(near, best) and np.allclose(cosine[who], near)


def test_no_labels_or_rows(spark):
    rows, labels = toxic_rows()
    labels_of = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    for docs, given_labels in ((fx.documents(spark, rows), labels_of([])), (fx.documents(spark, []), labels_of(labels))):
        got = toxicity.score(docs, toxicity.fit(docs, given_labels)).collect()
        assert len({r["score"] for r in got}) <= 1


def test_no_documents(spark):
    empty = fx.documents(spark, [])
    assert shingle_join.link(empty).collect() == []
    assert repeats.find(empty).collect() == []
    assert class_lm.train_and_score(empty, common.fold("doc_id") == 1).collect() == []
    nothing = fx.documents(spark, [(1, None), (2, ""), (3, " ")])
    assert {r["component_id"] for r in shingle_join.link(nothing).collect()} == {1, 2, 3}
    assert {r["n_removed"] for r in repeats.find(nothing).collect()} == {0}
    assert {r["n_tokens"] for r in class_lm.train_and_score(nothing, F.lit(False)).collect()} == {1}


@pytest.mark.parametrize("rows", [40, 4000])
def test_curve_on_nearly_parted_votes(rows):
    """The curve rises, also where a few labels are noise and the rest is parted completely."""
    rng = np.random.default_rng(6)
    y = (rng.random(rows) < 0.3).astype(float)
    x = np.where(y == 1, 6.9, -6.9) + rng.normal(0, 0.01, rows)
    y[: rows // 20] = 1 - y[: rows // 20]
    slope, offset = toxicity._platt(x, y, np.where(y == 1, 1.0, 4.0))
    assert slope > 0 and slope * 6.9 + offset > 0 > slope * -6.9 + offset
