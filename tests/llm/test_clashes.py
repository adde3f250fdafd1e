"""Stages on documents with columns that are named like the operators' own."""

import corpus_pipeline

EXTRA = ["score", "Predicted", "n_lines", "n_removed", "gone", "h", "th", "line", "keeper", "component_id", "n_shingles", "label", "n_words", "n_hit", "items", "contaminated", "bucket", "a.b", "sequence_id", "ids"]


def test_stages_keep_own_columns(spark, tmp_path):
    text = "these are some words of a text that goes on for long enough to be one"
    rows = [(k, None if k == 3 else "" if k == 4 else f"{text} {'again ' * (k % 2)}{k if k > 5 else ''}", None, *[f"v{k}"] * len(EXTRA)) for k in range(9)]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in EXTRA)
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert got, name
        if k < 4:
            assert out.columns == docs.columns, name
            assert all(r[c] == f"v{r.doc_id}" for r in got for c in EXTRA), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
