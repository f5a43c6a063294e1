import json
import struct

import numpy as np
import pytest

from plumbline.operators import audit as A
from plumbline.operators import masks as K
from plumbline.operators import neardup as N
from plumbline.sources import annotations as D
from plumbline.sources import corpus as P
from plumbline.sources import dumps as U
from plumbline.sources import images as I
from pyspark.sql import functions as F


def prints(seed, n=150):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n // 3)]
    out = set(base)
    for b in base:
        for flips in (1, 6, 7):
            v = b & (2**64 - 1)
            for bit in rng.choice(64, flips, replace=False):
                v ^= 1 << int(bit)
            out.add(v - 2**64 if v >= 2**63 else v)
    return sorted(out) + [0, -1, 1 << 62, -(2**63)]


@pytest.mark.parametrize("list_size", [1024, 16, 2])
def test_hamming_join_equals_all_pairs(spark, list_size):
    values = prints(1)
    df = spark.createDataFrame([(v,) for v in values + values[:5]], "fingerprint long")
    got = {(r.fp_a, r.fp_b): r.distance for r in N.hamming_pairs(df, 6, list_size).collect()}
    want = {}
    for i, a in enumerate(sorted(set(values))):
        for b in sorted(set(values))[i + 1 :]:
            d = bin((a ^ b) & (2**64 - 1)).count("1")
            if d <= 6:
                want[a, b] = d
    assert got == want and len(want) > 50
    with pytest.raises(ValueError):
        N.band_masks(0b111111, 6, 7)


def test_masks_leave_the_differing_bits_out():
    varying = 0xFFF00000FFFF0F
    masks = N.band_masks(varying, 3, 5)
    bits = [i for i in range(64) if varying >> i & 1]
    assert len(masks) == 10 and all(m & ~varying == 0 for m in masks)
    rng = np.random.default_rng(0)
    for _ in range(200):
        change = sum(1 << int(i) for i in rng.choice(bits, 3, replace=False))
        assert any(m & change == 0 for m in masks)


def test_hamming_join_of_a_full_key(spark):
    """Half of 40,000 fingerprints agree in 40 bits, so that they share most keys: split again, not all pairs."""
    rng = np.random.default_rng(4)
    crowd = rng.integers(0, 2**24, 20_000) << 20
    spread = rng.integers(-(2**62), 2**62, 20_000)
    values = np.unique(np.concatenate([crowd, spread]))
    df = spark.createDataFrame([(int(v),) for v in values], "fingerprint long")
    got = {(r.fp_a, r.fp_b) for r in N.hamming_pairs(df, 3).collect()}
    want = set()
    view = values.view(np.uint64)
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(view[i + 1 :] ^ view[i]) <= 3) + i + 1
        want |= {(int(values[i]), int(values[j])) for j in near}
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("list_size", [1024, 8])
def test_links_and_leaks_of_a_crowd_take_no_pairs(spark, list_size):
    """400 fingerprints in 12 bits are partners by the ten thousand; links stay a few per fingerprint and block."""
    crowd = [(i << 9) ^ 5 for i in range(400)]
    values = prints(3) + crowd
    df = spark.createDataFrame([(i, v, "abc"[i % 3]) for i, v in enumerate(values + values[:40])], "image_id long, fingerprint long, split string")
    pairs = N.hamming_pairs(df, 4, list_size)
    links = N.hamming_links(df, 4, list_size)
    assert pairs.count() > 20_000
    if list_size == 1024:
        assert links.count() < len(values)
    as_sets = lambda edges: {(r.node, r.component) for r in N.components(edges).collect()}
    assert as_sets(links) == as_sets(pairs)
    want = N.cross_split_near(df, pairs).agg(F.sum("id_pairs")).first()[0]
    assert N.near_leaks(df, 4, list_size=list_size).first().near_leaks == want
    listed = {(r.fp_a, r.fp_b): (r.id_a, r.n_a, r.id_b, r.n_b, r.id_pairs) for r in N.near_copies(df, 4).collect()}
    assert len(listed) == pairs.count()
    ids = {}
    for i, v in enumerate(values + values[:40]):
        ids.setdefault(v, []).append(i)
    assert all(x == (min(ids[a]), len(ids[a]), min(ids[b]), len(ids[b]), len(ids[a]) * len(ids[b])) for (a, b), x in listed.items())


def test_components_on_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    out = N.components(spark.createDataFrame(chain + star + [(5, 0)], "fp_a long, fp_b long")).collect()
    label = {r.node: r.component for r in out}
    assert len(out) == len(label) == 61 + 40
    assert {label[i] for i in range(61)} == {0}
    assert {label[1000 + i] for i in range(40)} == {1000}


@pytest.mark.parametrize("pivots,block", [(4, 16), (1, 1000)])
def test_cosine_join_equals_matrix_product(spark, pivots, block):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 16))
    v[60:] = v[:30] + rng.normal(size=(30, 16)) * 0.05
    v[59] = v[58] * 3.0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    for cut in (0.98, 0.3):
        got = {(r.id_a, r.id_b) for r in N.cosine_pairs(df, "id", "vec", cut, pivots, block).collect()}
        cos = v @ v.T
        want = {(i, j) for i in range(90) for j in range(i + 1, 90) if cos[i, j] >= cut and not np.array_equal(v[i], v[j])}
        assert got == want and want


def test_cosine_blocks_grow_with_the_table(spark, monkeypatch):
    """Twice the vectors are sent to as many tasks each, and no pair is lost."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "BLOCKS", 4)
    rng = np.random.default_rng(6)
    sent = []
    for n in (200, 400):
        v = rng.normal(size=(n, 16))
        v[n // 2 :] = v[: n // 2] + rng.normal(size=(n // 2, 16)) * 0.02
        df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if u[i] @ u[j] >= 0.98}
        out = N.cosine_pairs(df, "id", "vec")
        got = [(r.id_a, r.id_b) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        sent.append(out.rdd.getNumPartitions())
    assert sent[1] <= 1.5 * sent[0]


def test_cosine_bound_is_safe_and_saves_products():
    """No pair above the cosine is lost, and few of the others are multiplied in full."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 64))
    v[300:] = v[:300] + rng.normal(size=(300, 64)) * 0.02
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    axes = N.principal_axes(v[:200])
    assert axes.shape == (64, 16) and np.allclose(axes.T @ axes, np.eye(16))
    may = N.possible(v @ axes, v @ axes, 0.98)
    assert may[v @ v.T >= 0.98].all()
    assert axes.shape[1] / 64 + may.mean() < 0.5
    few = N.principal_axes(v[:3, :5])
    assert few.shape == (5, 5)


def test_copies_by_a_given_embedding(spark):
    """Every id pair within the cosine is behind one row; zeros, nulls and empty tables have none."""
    texts = ["a b c d e f", "a b c d e f", "a b c d e f g h", "x y", None, "", "x y", "x y", "a a b c d e f", "zz"]

    def letters(contents):
        return np.array([[float((t or "").count(c)) for c in "abcdefghxyz"] for t in contents])

    df = spark.createDataFrame(list(enumerate(texts)), "image_id long, content string")
    got = N.embedding_copies(N.embedded(df, letters), cosine_min=0.9).collect()
    v = letters(texts)
    v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    close = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if v[i] @ v[j] >= 0.9]
    assert sum(r.id_pairs for r in got) == len(close) and {(r.id_a, r.id_b) for r in got} == {(0, 0), (3, 3), (0, 8)}
    assert N.embedding_copies(N.embedded(df.limit(0), letters)).collect() == []
    with pytest.raises(Exception, match="vectors for"):
        N.embedded(df, lambda c: np.zeros((len(c) + 1, 2))).collect()


def corpus(spark):
    rows = [(1, "train", "a"), (2, "train", "a"), (3, "train", "b"), (4, "val", "b"), (5, "val", "c"), (6, "test", "a"), (7, "test", "d"), (8, "test", "c")]
    df = spark.createDataFrame(rows, "image_id long, split string, content string")
    return df.withColumn("digest", A.content_hash(F.col("content")))


def test_leaks_are_found_and_removed(spark):
    df = corpus(spark)
    assert A.cross_split_leaks(df).count() == 3
    assert {r[0] for r in A.leaked_ids(df).collect()} == {6}
    kept = A.first_occurrences(df)
    assert {r.image_id for r in kept.collect()} == {1, 3, 5, 7}
    assert {r.split: r.removed for r in A.removal_counts(df, kept).collect()} == {"train": 1, "val": 1, "test": 2}
    assert A.cross_split_leaks(df.join(kept.select("image_id"), "image_id", "left_semi")).count() == 0
    boxes = spark.createDataFrame([(1, 0), (2, 1), (6, 2)], "image_id long, gt_id long")
    assert [r.gt_id for r in A.boxes_of(kept, boxes).collect()] == [0]
    copies = {r.image_id: r.first_id for r in A.exact_copies(df).collect()}
    assert copies == {1: 1, 2: 1, 6: 1, 3: 3, 4: 3, 5: 5, 8: 5}


def test_near_leaks_count_equal_prints_once(spark):
    df = spark.createDataFrame([(1, "train", 5), (2, "test", 5), (3, "test", 4), (4, "test", 5)], "image_id long, split string, fingerprint long")
    out = N.cross_split_near(df, N.hamming_pairs(df, 4))
    assert out.agg(F.sum("id_pairs")).first()[0] == 3


def test_one_row_per_near_group(spark):
    df = spark.createDataFrame([(1, "test", 0), (2, "train", 1), (3, "val", 3), (4, "test", -1)], "image_id long, split string, fingerprint long")
    labels = N.components(N.hamming_pairs(df, 1))
    kept = N.keep_one_per_component(df, labels, A.split_rank(F.col("split")))
    assert {(r.image_id, r.members) for r in kept.collect()} == {(2, 3), (4, 1)}


def test_box_statistics(spark):
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 4.0, 2.0), (1, "a", 0.0, 0.0, 6.0, 6.0), (2, "b", 0.0, 0.0, 0.0, 3.0)], "image_id long, grp string, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    out = {(r.measure, r.grp): r for r in A.box_statistics(boxes, "grp", images).collect()}
    w = out["width", "pooled"]
    assert (w.n, w["mean"], w.p50, w.min, w.max) == (2, 5.0, 5.0, 4.0, 6.0) and w.std == pytest.approx(1.0)
    assert out["aspect_ratio", "a"].max == 2.0
    per = out["boxes_per_image", "pooled"]
    assert (per.n, per.p50) == (3, 0.0) and per["mean"] == pytest.approx(2 / 3)
    assert A.finer_level_advice(A.box_statistics(boxes, "grp"), 8).first().finer_level is True


def bmp(rgb):
    """Bytes of an uncompressed 24-bit bitmap."""
    h, w, _ = rgb.shape
    pad = (-w * 3) % 4
    rows = b"".join(rgb[y, :, ::-1].astype(np.uint8).tobytes() + b"\0" * pad for y in reversed(range(h)))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def test_sizes_from_headers(spark, tmp_path):
    """PNG, JPEG with a long first segment, both TIFF orders, bitmaps; what is broken keeps its row."""
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 60_002) + b"\xff" * 60_000 + b"\xff\xdb\0\x04ab\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, 33, 44) + b"rest"
    def tiff(e, head):
        return head + struct.pack(e + "IHHHIHHHHII", 8, 2, 256, 3, 1, 70, 0, 257, 4, 1, 90)
    files = {
        "a.png": png, "b.JPG": jpeg, "c.tif": tiff("<", b"II*\0"), "d.tiff": tiff(">", b"MM\0*"),
        "e.bmp": I.bitmap(np.zeros((5, 7, 3))), "f.png": png[:18], "g.jpg": jpeg[:500], "h.bmp": b"", "i.png": b"text",
        "j.bmp": b"BM" + b"\0" * 60, "k.bmp": b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 3, 4),
    }
    assert I.bitmap(np.arange(105).reshape(5, 7, 3)) == bmp(np.arange(105).reshape(5, 7, 3))
    rows = spark.createDataFrame([(f"train/{n}", bytearray(c)) for n, c in files.items()], "name string, content binary")
    assert I.write_files(rows.repartition(3), str(tmp_path)).count() == 11
    assert I.size_of(b"") == (None, None, "empty file")  # Spark's reader does not list such files
    got = {r.stem: (r.width, r.height, r.problem) for r in I.image_files(spark, f"{tmp_path}/*/*").collect()}
    want = {"a": (640, 480), "b": (44, 33), "c": (70, 90), "d": (70, 90), "e": (7, 5), "k": (3, 4)}
    assert {k: v[:2] for k, v in got.items() if v[2] is None} == want
    assert {k: v[2] for k, v in got.items() if v[2]} == {
        "f": "header ends early", "g": "header ends early", "i": "unknown format", "j": "no extent",
    }


def test_images_without_candidates_per_run(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    found = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 2), ("b", 0, 9)], "method string, seed int, image_id long")
    got = A.images_without_candidates(images, found, ["method", "seed"]).collect()
    assert sorted((r.method, r.image_id) for r in got) == [("a", 3), ("b", 1), ("b", 3)]
    assert {r.image_id for r in A.images_without_candidates(images, found).collect()} == {3}


def test_image_features(spark, tmp_path):
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (40, 30, 3))
    (tmp_path / "a.bmp").write_bytes(bmp(rgb))
    (tmp_path / "b.bmp").write_bytes(bmp(np.clip(rgb + 1, 0, 255)))
    (tmp_path / "c.bmp").write_bytes(bmp(np.full((20, 20, 3), 128)))
    images = spark.read.format("image").load(str(tmp_path)).select("image.*")
    out = {r.origin[-5]: r for r in K.style_features(images, "origin").collect()}
    x = rgb / 255.0
    luma = x @ [0.299, 0.587, 0.114]
    lap = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * luma[1:-1, 1:-1]
    r = out["a"]
    assert (r.mean_r, r.mean_g, r.mean_b) == pytest.approx(tuple(x.mean(axis=(0, 1))))
    assert r.std_luma == pytest.approx(luma.std()) and r.sharpness == pytest.approx(lap.var())
    assert out["c"].colourfulness == pytest.approx(0.0) and out["c"].sharpness == pytest.approx(0.0)
    fp = {r.origin[-5]: r.fingerprint for r in K.image_fingerprint(images, "origin").collect()}
    assert bin((fp["a"] ^ fp["b"]) & (2**64 - 1)).count("1") <= 6


def test_rod_mask(spark):
    pixels = [(1, x, y) for x in range(5, 35) for y in range(10, 14)] + [(2, 0, 0), (2, 5, 5), (2, 6, 6)]
    df = spark.createDataFrame(pixels, "sample long, x long, y long")
    boxes = spark.createDataFrame([(1, 5.0, 10.0, 35.0, 14.0), (2, 0.0, 0.0, 3.0, 3.0), (3, 0.0, 0.0, 3.0, 3.0)], "sample long, x1 double, y1 double, x2 double, y2 double")
    out = {r["sample"]: r for r in K.mask_morphology(K.runs_of_pixels(df), boxes).collect()}
    assert out[1].elongation > 2 and out[1].components == 1 and out[1].containment == 1.0
    assert out[1].orientation == pytest.approx(1.0)
    assert out[2].components == 2 and out[2].containment == pytest.approx(1 / 3)
    assert (out[3].containment, out[3].elongation, out[3].components) == (0.0, 0.0, 0)


def test_runs_against_pixels(spark):
    """Overlay, pieces, shape and Dice of random masks, from runs and from pixel arrays."""
    rng = np.random.default_rng(8)
    shapes = {k: [rng.random((14, 17)) < p for p in (0.25, 0.4, 0.5)] for k in range(12)}
    rows = [(k, f"b{b}", int(y), int(x)) for k, own in shapes.items() for b, m in enumerate(own) for y, x in zip(*np.nonzero(m))]
    pixels = spark.createDataFrame(rows, "sample long, backend string, y long, x long")
    masks = K.runs_of_pixels(pixels, ["sample", "backend"])
    truth = masks.where("backend = 'b2'").drop("backend")
    samples = spark.createDataFrame([(k, f"b{b}") for k in range(13) for b in range(3)], "sample long, backend string")
    got = {(r["sample"], r.backend): r.dice for r in K.dice(masks, truth, samples).collect()}
    assert len(got) == 39 and got[12, "b0"] == 1.0
    for k, own in shapes.items():
        for b, m in enumerate(own):
            assert got[k, f"b{b}"] == pytest.approx(2 * (m & own[2]).sum() / (m.sum() + own[2].sum()))
    agreed = K.consensus(masks, samples)
    lines = agreed.collect()
    assert all(b.x0 > a.x1 for a in lines for b in lines if (a["sample"], a.y) == (b["sample"], b.y) and b.x0 > a.x0)
    boxes = spark.createDataFrame([(k, 2.0, 3.0, 11.0, 9.0) for k in range(12)], "sample long, x1 double, y1 double, x2 double, y2 double")
    out = {r["sample"]: r for r in K.mask_morphology(agreed, boxes).collect()}
    for k, own in shapes.items():
        m = sum(x.astype(int) for x in own) >= 2
        ys, xs = np.nonzero(m)
        left, pieces = set(zip(ys.tolist(), xs.tolist())), 0
        while left:
            pieces += 1
            todo = [left.pop()]
            while todo:
                y, x = todo.pop()
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
        low, high = np.linalg.eigvalsh(np.cov(np.stack([xs, ys]), bias=True))
        assert out[k].components == pieces
        assert out[k].containment == pytest.approx(m[3:9, 2:11].sum() / m.sum())
        assert out[k].elongation == pytest.approx(np.sqrt(high / low))
        assert out[k].foreground_ratio == pytest.approx(m.sum() / 54)


def test_filled_boxes(spark):
    df = spark.createDataFrame([(1, -3.0, -1.0, 4.0, 2.0), (1, 2.0, 1.0, 6.0, 3.0), (1, 5.0, 5.0, 5.0, 9.0)], "sample long, x1 double, y1 double, x2 double, y2 double")
    runs = K.overlay(K.runs_of_boxes(df))
    assert sorted((r.y, r.x0, r.x1) for r in runs.collect()) == [(0, 0, 4), (1, 0, 6), (2, 2, 6)]


def test_label_files_become_boxes(spark, tmp_path):
    for split in ("train", "val"):
        (tmp_path / "labels" / split).mkdir(parents=True)
        (tmp_path / "images" / split).mkdir(parents=True)
    img = bmp(np.zeros((50, 100, 3)))
    (tmp_path / "labels/train/a.txt").write_text("0 0.5 0.5 0.2 0.4\n1 0.1 0.1 0.1 0.1 9\n\n")
    (tmp_path / "labels/train/b.txt").write_text("0 0.5 0.5 1 1\n")  # has no image
    (tmp_path / "labels/train/c.txt").write_text("1 0.25 0.5 0.1 0.2\n0 0.5 0.5 0.1 0.1\n")
    (tmp_path / "labels/val/z.txt").write_text("0 0.5 0.5 0.1 0.1")
    for name in ("train/a", "train/c", "val/z"):
        (tmp_path / f"images/{name}.bmp").write_bytes(img)
    lines, files = P.read_label_lines(spark, str(tmp_path)), P.image_files(spark, str(tmp_path))
    images, boxes = P.labels_to_boxes(lines, files, single_class=False)
    assert {(r.split, r.stem): r.image_id for r in images.collect()} == {("train", "a"): 0, ("train", "c"): 2, ("val", "z"): 0}
    got = [(r.image_id, r.gt_id, r.category_id, r.x1, r.y1, r.x2, r.y2) for r in boxes.where("split = 'train'").orderBy("gt_id").collect()]
    assert [g[:3] for g in got] == [(0, 0, 1), (2, 1, 2), (2, 2, 1)]
    assert got[0][3:] == pytest.approx((40.0, 15.0, 60.0, 35.0))


def test_annotation_documents_round_trip(spark, tmp_path):
    for split, ids in (("train", [1, 2]), ("test", [9])):
        doc = {
            "images": [{"id": i, "file_name": f"x/{i}.png", "width": 10, "height": 10, "camera": "c", "background": "b"} for i in ids],
            "annotations": [{"id": i, "image_id": i, "bbox": [1, 2, 3, 4], "category_id": 1, "iscrowd": 0, "area": 12} for i in ids]
            + [{"id": 99, "image_id": ids[0], "bbox": [1, 2, 0, 4], "category_id": 1}],
            "categories": [{"id": 1, "name": "rod"}],
        }
        (tmp_path / f"{split}.json").write_text(json.dumps(doc, indent=1))
    docs = P.read_annotations(spark, str(tmp_path / "*.json"))
    images, boxes = P.images_of(docs), P.boxes_of(docs)
    assert {(r.split, r.image_id) for r in images.collect()} == {("train", 1), ("train", 2), ("test", 9)}
    assert {(r.x1, r.y1, r.x2, r.y2) for r in boxes.collect()} == {(1.0, 2.0, 4.0, 6.0)} and boxes.count() == 3
    P.write_splits(images, boxes.drop("split"), str(tmp_path / "out"), boxes.limit(1))
    again = spark.read.parquet(str(tmp_path / "out/boxes"))
    assert {(r.image_id, r.gt_id) for r in again.collect()} == {(1, 0), (2, 1), (9, 2)}
    assert spark.read.parquet(str(tmp_path / "out/images")).where("split = 'test'").count() == 1


@pytest.mark.parametrize("range_bytes", [None, 4096, 700])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, range_bytes):
    """Whatever the ranges: brackets and quotes in strings, nested objects, other keys, a long object."""
    rng = np.random.default_rng(0)
    odd = ['a}b', 'q"}{[', "back\\", '\\"}', "é中}", "]}", ""]
    doc = {
        "info": {"about": {"deep": [{"id": 1}]}, "images": "no {array"},
        "images": [{"id": i, "file_name": odd[i % 7] + f"/{i}.png", "width": 10, "height": 10} for i in range(60)],
        "licenses": [],
        "annotations": [
            {"id": i, "image_id": int(rng.integers(60)), "bbox": [1.5, 2, i % 5, 4], "category_id": 1,
             "segmentation": {"size": [1, 2], "counts": "}" * (i % 3), "more": {"x": {}}}, "note": "z}" * (900 if i == 33 else 1)}
            for i in range(150)
        ],
        "categories": [{"id": 1, "name": "rod"}],
    }
    (tmp_path / "train.json").write_text(json.dumps(doc, indent=1 if range_bytes == 700 else None, ensure_ascii=False) + "\n")
    (tmp_path / "val.json").write_text(json.dumps({"images": doc["images"][:2], "annotations": []}))
    (tmp_path / "torn.json").write_text(json.dumps(doc)[:-300])
    rows = D.read_objects(spark, str(tmp_path), range_bytes).collect()
    got = {}
    for r in rows:
        got.setdefault((r.split, r.section), []).append(json.loads(r.object))
    order = lambda x: x["id"]
    for key in ("images", "annotations", "categories"):
        assert sorted(got["train", key], key=order) == doc[key]
    assert sorted(got["val", "images"], key=order) == doc["images"][:2]
    assert {k for k in got if k[0] in ("torn", "val")} == {("val", "images")}
    objects = D.read_objects(spark, str(tmp_path / "train.json"), range_bytes)
    assert D.images_in(objects).count() == 60 and D.boxes_in(objects).count() == 120
    if range_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        parts = spark.read.text(str(tmp_path / "train.json"), lineSep="}").rdd.getNumPartitions()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
        assert parts > 3


def test_written_documents_are_json(spark, tmp_path):
    images = spark.createDataFrame([("train", 1, "a.png"), ("train", 2, 'b".png'), ("val", 3, "c.png")], "split string, image_id long, file_name string")
    boxes = spark.createDataFrame([("train", 1, 7, 1.0, 2.0, 4.0, 6.0)], "split string, image_id long, gt_id long, x1 double, y1 double, x2 double, y2 double")
    D.write_documents(images, boxes, str(tmp_path / "docs"))
    (file,) = (tmp_path / "docs/split=train").glob("*.txt")
    doc = json.loads(file.read_text())
    assert [i["id"] for i in doc["images"]] == [1, 2] and doc["annotations"][0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    objects = D.read_objects(spark, str(tmp_path / "docs"))
    assert {(r.split, r.image_id) for r in D.images_in(objects).collect()} == {("train", 1), ("train", 2), ("val", 3)}
    assert [(r.split, r.gt_id, r.x2, r.y2) for r in D.boxes_in(objects).collect()] == [("train", 7, 4.0, 6.0)]


def test_metadata_last_row_wins(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Image_ID,Background_Color,Camera_System\na.png,red,c1\na.png,blue,c2\n")
    meta = P.read_metadata(spark, str(tmp_path / "m.csv"), "Image_ID", "Camera_System", "Background_Color")
    images = spark.createDataFrame([("d/a.png",), ("d/b.png",)], "file_name string")
    got = {r.file_name: (r.camera, r.background) for r in P.with_groups(images, meta).collect()}
    assert got == {"d/a.png": ("c2", "blue"), "d/b.png": ("unknown", "b0")}


def test_paths(spark):
    rows = ["r/Mannual_Microscope-2_set1/3.jpg", "r/Mannual_Seg_Microscope-1_set6/4.jpg", "r/Without_bacilli/5.jpg", "r/x/Thumbs.jpg"]
    out = P.describe_paths(spark.createDataFrame([(p,) for p in rows], "path string")).collect()
    assert [(r.camera, r.category, r.background, r.annotated) for r in out] == [
        ("micro2", "Mannual", "zn", True), ("micro1", "Mannual_Seg", "zn", True), ("unknown", "Without_bacilli", "zn_empty", False),
    ]


def test_reports_and_dumps(spark, tmp_path):
    (tmp_path / "report_erm_seed3.json").write_text('{"detection": {"worst_group_AP50": 0.1, "mean_AP50": NaN, "per_group_AP50": {"0": 0.1}}, "calibration": null, "collapsed": true, "reason": "x"}')
    (tmp_path / "report_erm_seed4.json").write_text('{"detection": {"worst_group_AP50": 0.3},\n "calibration": {"D-ECE": 0.2}}')
    (tmp_path / "notes.json").write_text("{}")
    got = {r.seed: r for r in U.report_figures(U.read_reports(spark, str(tmp_path / "*.json"))).collect()}
    assert set(got) == {3, 4}
    assert got[3].collapsed and got[3].mean_ap50 is None and got[3].ece is None and got[3].per_group_ap50 == {"0": 0.1}
    assert not got[4].collapsed and got[4].ece == 0.2
    path = str(tmp_path / "dump")
    a = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.6)], "method string, seed int, fused double")
    U.write_candidates(a, path)
    U.write_candidates(spark.createDataFrame([("m", 1, 0.9)], "method string, seed int, fused double"), path, force=True)
    assert {(r.seed, r.fused) for r in U.read_candidates(spark, path, "m").collect()} == {(0, 0.5), (1, 0.9)}
    assert U.read_candidates(spark, path, seed=1).count() == 1
    assert [r.tag for r in U.available_runs(spark, path, "m_seed1").collect()] == ["m_seed1"]
    wanted = spark.createDataFrame([("m", 1), ("n", 1)], "method string, seed int")
    assert U.pending_runs(wanted, U.read_candidates(spark, path)).collect()[0].method == "n"
    assert U.pending_runs(wanted, wanted, force=True).count() == 2
    digests = P.content_digests(spark, str(tmp_path / "*.json"))
    import hashlib

    assert {r.digest for r in digests.where("path LIKE '%notes%'").collect()} == {hashlib.sha256(b"{}").hexdigest()}


def test_filled_boxes_in_bands(spark):
    """Bands give the figures of the lines they stand for, in one row per box and cut."""
    rng = np.random.default_rng(3)
    corner = rng.integers(-4, 40, (60, 2))
    far = corner + rng.integers(0, 30, (60, 2))
    rows = [(int(i % 5), f"b{i % 3}", *map(float, (*corner[i], *far[i]))) for i in range(60)]
    df = spark.createDataFrame(rows, "sample long, backend string, x1 double, y1 double, x2 double, y2 double")
    truth, keys = df.where("backend = 'b2'").drop("backend"), ["sample", "backend"]
    samples = df.select("sample", "backend").distinct()
    around = truth.groupBy("sample").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    drawn, covered = K.bands_of_boxes((df, keys), (truth, ["sample"]))
    lines = K.overlay(K.runs_of_boxes(df, keys), keys), K.overlay(K.runs_of_boxes(truth))
    bands = K.overlay(drawn, keys), K.overlay(covered)
    out = []
    for masks, real in (lines, bands):
        agreed = K.consensus(masks, samples)
        out.append((
            sorted(K.dice(masks, real, samples).collect()),
            sorted(K.mask_morphology(agreed, around).collect()),
        ))
    assert out[0] == out[1]
    tall = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 1e6), (1, 4.0, 10.0, 12.0, 20.0)], "sample long, x1 double, y1 double, x2 double, y2 double")
    got = K.overlay(K.bands_of_boxes((tall, ["sample"]))[0])
    assert sorted((r.y, r["lines"], r.x0, r.x1) for r in got.collect()) == [(0, 10, 0, 9), (10, 10, 0, 12), (20, 999980, 0, 9)]
