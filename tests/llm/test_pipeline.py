"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    text = " ".join(f"the of and word{i}" for i in range(60))
    rows = [(i, f"{text} doc{i} " + " ".join(f"own{i}x{k} and the" for k in range(120 if i % 3 else 30)), "en" if i % 2 else "fr", f"s{i % 3}", 1) for i in range(24)]
    rows += [(24, rows[1][1], "en", "s1", 1), (25, None, "en", "s0", 0), (26, "...", None, None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        if name == "language_id":
            assert 25 not in ids and 26 not in ids
        if name == "near_duplicates":
            assert 24 not in ids and 1 in ids
    assert {"sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
