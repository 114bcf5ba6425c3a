import re

import pyarrow as pa

import corpus_pipeline
from marginalia.llm import pieces, quality

from .fixtures import frame, rows
from .test_dedup import UPPER, brute_components

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "pieces"]
    good = {r.doc_id for r in quality.quality(spark, docs, labels).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    keep = {}
    for d, r in rows.items():
        key = (r.text or "").translate(UPPER)
        keep[key] = max(d, keep.get(key, d))
    left = sorted(keep.values())
    left = {d for d, _, c in brute_components([(d, rows[d].text) for d in left]) if d == c}
    state = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        state = stage(spark, state, SF)
        assert state.columns == columns, name
    assert {r.doc_id for r in state.collect()} == left
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", rows[d].text or "")) for d in left)
    back = pieces.decode_documents(spark, out).collect()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in back)
    assert abs(words - 1.5 * total) < 25 and {r.doc_id for r in got} <= left
    for r in back:
        assert (rows[r.doc_id].text or "").startswith(r.text)


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = [r for r in rows() if r[0] is not None]
    for name, data in (("some", good), ("none", [])):
        frame(spark, data).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    texts = {r[0]: r[1] for r in good}
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    back = pieces.decode_documents(spark, out).collect()
    assert back and all((texts[r.doc_id] or "").startswith(r.text or "") for r in back)
    none = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert none.columns == out.columns and none.count() == 0


def test_good_documents_of_awkward_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, quality.learnable())
    odd = frame(spark)
    kept = quality.keep_good(spark, docs.select(docs.columns).unionByName(odd.select(docs.columns)), labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count() + len(rows())
    scores = model.score(quality.features(pa.array([r[1] for r in rows()])))
    want = sorted(str(r[0]) for r, s in zip(rows(), scores, strict=True) if s >= quality.THRESHOLD)
    alone = quality.scorer(model)
    assert sorted(str(r.doc_id) for r in odd.filter(alone("text") >= quality.THRESHOLD).collect()) == want
    assert quality.keep_good(spark, docs.limit(0), labels).count() == 0
