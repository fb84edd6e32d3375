"""The pipeline's stages, each against what it says it does on its own input."""

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import brute_lines, secrets, shingles, texts


def test_pipeline(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = stage(spark, docs, DATA)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    stage = lambda n: dict((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/{n}").collect())
    before = dict(texts(spark, DATA))
    kept = stage("quality_rules")
    assert kept and all(before[i] == t for i, t in kept.items())
    assert all(len(t.split()) >= 50 for t in kept.values())
    gone, lines = brute_lines(sorted(kept.items())), stage("line_dedup")
    for i, t in kept.items():
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert lines.get(i, "") == want if want.split() else i not in lines
    single, sets = stage("ngram_join"), {}
    for i, t in sorted(lines.items()):
        s = shingles(t)
        if i in single:
            assert not any(5 * len(s & o) >= 4 * len(s | o) for o in sets.values() if s)
            sets[i] = s
    clean = stage("secret_scans")
    assert set(clean) == set(single)
    assert all((clean[i] == t) == (not secrets(t)) or "<secret>" in clean[i] for i, t in single.items())
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(clean)


def test_odd_documents(spark, odd_documents, tmp_path):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() > 0
    empty = odd_documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, None)
    assert empty.count() == 0
