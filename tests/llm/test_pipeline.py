import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import test_op3
import test_op5
import test_op6
import test_op8

import corpus_pipeline
from spindrift.llm import quality, subwords


def test_stages_in_order(spark, tmp_path):
    """Each stage's output equals the brute-force version on its own input."""
    good, labels = test_op8.corpus(300)
    docs = [(i, t) for i, t, _ in good]
    docs += [(1000 + i, t) for i, t in test_op5.corpus(40)] + [(3000 + i, t) for i, t in test_op3.corpus(7)[:60]] + [(9000, None), (9001, "")]
    bench = [(1, " ".join(docs[5][1].split()[:12])), (2, "nowhere to be found")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    now, columns = spark.read.parquet(f"{d}/documents.parquet"), None
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or now.columns
        out = stage(spark, now, d)
        assert k == 4 or out.columns == columns, name
        out.write.parquet(f"{d}/out{k}")
        now = spark.read.parquet(f"{d}/out{k}")
        outs.append(now.collect())
    first, second, third, fourth, pieces = outs
    accepted = {r.doc_id for r in quality.op8_quality(spark, d).collect() if r.predicted}
    assert {r.doc_id for r in first} == accepted and len(first) < len(docs)
    brute = test_op5.brute(sorted((r.doc_id, r.text) for r in first))
    assert {r.doc_id: r.text for r in second} == {i: t for i, (_, gone, t) in brute.items() if not gone or t.strip()}
    assert all(r.n_chars == len(r.text or "") for r in second)
    keep = {r.split(", ")[-1].rstrip(")") for r in test_op3.brute([(r.doc_id, r.text) for r in second])}
    assert {str(r.doc_id) for r in third} == keep
    hit = {r[0] for r in test_op6.brute([(r.doc_id, r.text) for r in third], bench) if r[5]}
    assert {r.doc_id for r in fourth} == {r.doc_id for r in third} - hit
    spans = defaultdict(list)
    for r in pieces:
        spans[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(spans) == {r.doc_id for r in fourth}
    for r in fourth:
        at = 0
        for start, length, total in sorted(spans[r.doc_id]):
            assert start == at
            at += length
        assert at == total == len(subwords.encode(r.text, subwords.default_path())) + 1
    assert corpus_pipeline.run(spark, d).count() == len(pieces)
