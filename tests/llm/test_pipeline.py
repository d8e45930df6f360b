import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from test_jaccard_join import shingles  # noqa: E402

from logforge.llm import pii  # noqa: E402


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "source_mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "sentencepiece":
            assert out.columns == columns
        if name in ("toxicity", "ngram_jaccard_join"):
            assert 0.7 * before < out.count() < before
        if name == "ngram_jaccard_join":
            sets = [s for r in out.collect() if (s := shingles(r["text"]))]
            where = {}
            for i, s in enumerate(sets):
                for g in s:
                    where.setdefault(g, []).append(i)
            pairs = {(i, j) for m in where.values() if len(m) < 50 for i in m for j in m if i < j}
            assert not [p for p in pairs if 10 * len(sets[p[0]] & sets[p[1]]) >= 8 * len(sets[p[0]] | sets[p[1]])]
        if name == "pii":
            assert out.count() == docs.count() and not any(pii.base_spans(r["text"]) for r in out.collect())
        before, docs = out.count(), out
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where("n_tokens * 4 <> length(ids)").count() == 0 and out.count() > 500


def test_odd_documents(spark, odd, none, tmp_path):
    spark.createDataFrame([(4, 1), (7, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            now.count()
