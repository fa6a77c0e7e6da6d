"""The pipeline's stages on a small corpus, each against what it must keep and drop."""

import collections

import pytest

import corpus_pipeline
from shopledger.llm.common import importable

from .test_operators import PRIVATE, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    importable(spark)
    path = str(tmp_path_factory.mktemp("tables"))
    passage = prose(777, 40, 90)
    texts = [prose(k, 150) for k in range(12)]
    texts += [texts[0], texts[1] + " end", "too short", None, f"{prose(60, 80)} {passage} {prose(61, 20)}", f"{prose(62, 80)} {PRIVATE['email']} {PRIVATE['phone']}"]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = after
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == {*range(14), 16, 17}
    assert kept[1] == {*range(12), 16, 17}
    assert kept[2] == kept[3] == {*range(12), 17}
    text = {r["doc_id"]: r for r in docs.collect()}[17]
    assert PRIVATE["email"] not in text["text"] and PRIVATE["phone"] not in text["text"] and text["n_chars"] == len(text["text"])


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {*range(12), 17}
    total = collections.Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 2048
    assert len(total) <= -(-sum(total.values()) // 2048) + 1


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
