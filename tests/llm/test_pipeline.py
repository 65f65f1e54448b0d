import brute

import corpus_pipeline
from tidemark.llm import pii


def test_stages_match_a_plain_version(spark, corpus, docs, tmp_path):
    long = [(i, t, "en", "s", len(t or "")) for i, t in corpus]
    df = spark.createDataFrame(long, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = {i: t for i, t in corpus}
    stats = {i: brute.statistics(t) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if stats[i]["n_words"] >= 50 and 100 * stats[i]["n_repeat_words"] <= 50 * stats[i]["n_words"]}
    rows = {i: rows[i] for i, (_, _, kept) in brute.exact(rows.items()).items() if kept}
    # No contract sets the stage's similarity, so it is 0.80.
    rows = {i: rows[i] for i, (_, c) in brute.near(rows.items(), 80).items() if i == c}
    data = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        data = stage(spark, data, folder)
        assert data.columns == df.columns, name
        path = f"{folder}/{name}"
        data.write.parquet(path)
        data = spark.read.parquet(path)
    assert {r["doc_id"]: r["text"] for r in data.collect()} == rows
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "MinHash near-dedup", "PII", "packing"] and pii.NAMES
