import hashlib
import random
import re

from spindrift.llm import decontaminate as dc


def brute(docs, bench, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    pats = []
    for i, t in bench:
        w = words(t)
        n = min(window, len(w))
        pats += [(i, w[k : k + n]) for k in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    ids.update([str(i)] if i is not None else [])
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_search_equals_brute_force(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    vocab = ["a", "bb", "Cé", "d1", "E", "ff", "ß", "g9"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    bench = [(k, text(rnd.choice([0, 1, 3, 9, 10, 14, 30]))) for k in range(12)] + [(3, "zz yy"), (None, "qq qq"), (50, None), (51, "")]
    docs = [(k, text(rnd.choice([0, 2, 20, 200])) + (rnd.choice(bench)[1] or "") + text(5)) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 300000 + " " + bench[11][1]), (0, docs[0][1]), (None, "qq QQ"), (103, "a " * 50000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(map(str, brute(docs, bench)))
    assert sorted(str(tuple(r)) for r in dc.op6_decontaminate(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(dc, "COMPILED_BYTES", 70_000)  # pieces are halved
    assert sorted(str(tuple(r)) for r in dc.op6_decontaminate(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    assert sorted(str(tuple(r)) for r in dc.op6_decontaminate(spark, str(tmp_path)).collect()) == want


def test_shift_table_grows_with_the_patterns():
    """Most positions are skipped, few patterns or many."""
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randrange(50_000)}" for _ in range(n))
    for words in (2_000, 60_000):
        (p,) = dc.compile_patterns([(str(k), text(200)) for k in range(words // 200)])
        assert p.shift.mean() > 6 and (p.shift == 0).mean() < 0.05 and p.size < dc.COMPILED_BYTES


def test_stage_keeps_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three", 7, "x"), (2, "four", 8, "y")], "doc_id long, text string, n_hit long, Items string")
    spark.createDataFrame([(1, "two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dc.stage(spark, docs.select("doc_id", "text"), str(tmp_path))
    assert [r.doc_id for r in out.collect()] == [2]
    assert dc.contamination(docs, docs.limit(0).select("doc_id", "text"), item="doc_id").filter("contaminated").count() == 0
    assert dc.contamination(docs.limit(0), docs.select("doc_id", "text"), item="doc_id").count() == 0
