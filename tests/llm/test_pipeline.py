"""The pipeline's stages one after another, each against its own input."""

from __future__ import annotations

import corpus_pipeline
import fixtures as fx
from test_across_documents import plain_components

from plumbline.llm import common, mixing, toxicity


def test_stages(spark, tmp_path):
    rows = [(k, fx.prose(k, 40)) for k in range(120)]
    rows += [(200 + k, fx.prose(500 + k, 30) + " scumbag moron") for k in range(60)]
    rows += [(300, fx.prose(3, 40)), (301, 'password = "hunter2hunter2" ' + fx.prose(900, 30)), (302, None), (303, "")]
    docs = fx.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 0) for k in range(120)] + [(200 + k, 1) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    text = dict(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in seen.collect()}
        stage(spark, seen, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r["doc_id"] for r in seen.collect()]
        if k < 4:
            assert seen.columns == docs.columns
        if k == 0:
            assert set(after) == {i for i in before if not 200 <= i < 260}
        if k == 1:
            assert sorted(after) == sorted({c for _, _, c in plain_components([(i, text[i]) for i in before])})
        if k == 2:
            masked = {r["doc_id"]: r for r in seen.collect()}
            assert set(after) == before and masked[301]["text"].startswith("[secret]")
            assert masked[301]["n_chars"] == len(masked[301]["text"]) and masked[302]["text"] is None
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(mixing.sizes(seen)).collect()}
        if k == 3:
            assert {i: after.count(i) for i in before} == want
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(seen.columns)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(whole.select("doc_id", "ids_sha256").collect()) == sorted(seen.select("doc_id", "ids_sha256").collect())


def test_toxicity_learns_from_other_folds_only(spark):
    docs = fx.documents(spark, [(k, "scumbag here" if k % 2 else "fine here") for k in range(100)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    assert not any(common.fold_of(i) == 0 for i in toxicity.fit(docs, labels).ids)


def test_join_stage_takes_five_words_and_80_percent(spark, tmp_path):
    words = [f"word{k}" for k in range(100)]
    changed = ["other" if k in (30, 70) else w for k, w in enumerate(words)]  # 86 / 106 on five words, 89 / 105 on four
    further = [f"new{k}" if k in (20, 45, 70) else w for k, w in enumerate(words)]  # 81 / 111
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(further)), (4, fx.prose(4, 60))]
    docs = fx.documents(spark, rows)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect())
    assert got == sorted({c for _, _, c in plain_components(rows, width=5, percent=80)}) == [1, 3, 4]
    assert 2 in {c for _, _, c in plain_components(rows)}  # the query's four words and 85 % keep it
