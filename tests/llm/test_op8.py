import random
import zlib

import numpy as np
import pyarrow as pa

from spindrift.llm import quality


def corpus(n=400, seed=2):
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rnd.choice(["th", "er", "ón", "re", "ß", "an"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(8, 120))]
        kind, good = k % 5, 1
        text = " ".join(w + ("." if rnd.random() < 0.1 else "") for w in words).capitalize()
        if kind == 1:
            text, good = " ".join(w + rnd.choice(["###", "%%%", "$$$"]) for w in words), 0
        elif kind == 2 and k % 2:
            text, good = " ".join(w for w in words[:9] for _ in range(12)), 0
        docs.append((k, text, "x"))
        labels.append((k, good, 0))
    return docs, labels


def test_held_out_accuracy_and_stage(spark, tmp_path):
    docs, labels = corpus()
    docs += [(1000, "", "x"), (1001, None, "x"), (1002, "w" * 300000, "x"), (0, docs[0][1], "x"), (None, "no id", "x")]
    truth = {i: q for i, q, _ in labels}
    labels += [(3, None, 1), (None, 1, 0), (5000, 1, 1), (4, truth[4], 0)]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op8_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    out = quality.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"), str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in got if r.predicted}


def test_votes_equal_brute_force():
    docs, labels = corpus(120, 5)
    x = quality.terms(pa.array([t for _, t, _ in docs]))
    y = np.array([q for _, q, _ in labels], float)
    m = quality.fitted(x[:80], y[:80])
    for v, s in zip(x[80:], m.score(x[80:])):
        z = v @ m.weights
        sims = m.vectors @ (z / np.linalg.norm(z))
        near = np.argsort(-sims)[: quality.NEIGHBOURS]
        w = np.maximum(sims[near], 1e-6) ** quality.SHARPNESS
        assert abs((w * m.labels[near]).sum() / w.sum() - s) < 1e-3


def test_quality_that_only_words_tell():
    """Two vocabularies of words of the same shapes: the texts differ in nothing else."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    both = [[word() for _ in range(60)] for _ in range(2)]
    y = np.array([k % 2 for k in range(600)], float)
    shared = [word() for _ in range(40)]
    texts = [" ".join(rnd.choice(both[int(q)] if rnd.random() < 0.4 else shared) for _ in range(30)) + "." for q in y]
    x = quality.terms(pa.array(texts))
    assert len(np.unique(x[:, : quality.SHAPES - quality._SPECIAL], axis=0)) == 1
    m = quality.fitted(x[:400], y[:400])
    assert ((m.score(x[400:]) >= 0.5) == (y[400:] == 1)).mean() > 0.9


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()] == [0.5]
    assert quality.scored(docs.limit(0), quality.fit(docs, none)).count() == 0
