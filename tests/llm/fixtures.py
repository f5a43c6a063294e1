"""Awkward documents, and plain versions of what the operators should find in them."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, empties, odd white space and a very long text."""
    base, passage = prose(1, 120), prose(2, 40)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 60, 110)]
    far = " ".join(w if k % 9 else "x" + w for k, w in enumerate(words))
    rows = [(1, base), (2, base), (3, base.upper()), *[(10 + k, t) for k, t in enumerate(near)], (20, far)]
    rows += [(30 + k, f"{prose(100 + k, 25)}\n{passage}\n{prose(200 + k, 25)}") for k in range(6)]
    rows += [(40, None), (41, ""), (42, " \t\n\x0b\x0c\r "), (43, "one"), (44, "one"), (45, "one two three")]
    rows += [(46, "Ünï cödé \x1c   text 中文 😀 " * 6), (47, "a" * 3000), (48, "ab" * 60 + "<|endoftext|>")]
    rows += [(50, prose(3, 6000)), (51, "line one is here\n" * 30), (None, base), (None, "nobody knows")]
    rows += [(60, prose(4, 70)), (60, prose(4, 70)), (61, prose(5, 30) + " " + prose(4, 70))]
    return rows


def documents(spark, rows=None, extra=()):
    """A documents table; ``extra`` are columns of a constant whose names may clash."""
    rows = texts() if rows is None else rows
    df = spark.createDataFrame(
        [(i, t, "en", None if i is None else f"src{i % 3}", None if t is None else len(t)) for i, t in rows], DOCUMENTS
    )
    from pyspark.sql import functions as F

    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
