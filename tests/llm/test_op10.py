import hashlib
import random
import re

from pyspark.sql import functions as F

from spindrift.llm import fingerprint as fp


def pieces(t):
    first = (t or "").split("\n")[0][:16]
    return {first, *(line[k : k + 512] for line in (t or "")[len(first) :].split("\n") for k in range(0, len(line), 512))} - {""}


def like(a, b):
    a, b = pieces(a), pieces(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeéfß ") for _ in range(rnd.randint(2, 9)))
    text = lambda: "\n".join(" ".join(word() for _ in range(rnd.choice([1, 4, 30, 90]))) for _ in range(rnd.choice([1, 3, 10, 120])))
    return [text() for _ in range(60)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(k * 3 % 61, t) for k, t in enumerate(texts())] + [(500, ""), (501, None), (502, "x"), (503, "same text"), (504, "same text"), (-9, "z" * 20000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fp.op10_fingerprint(spark, str(tmp_path)).collect()}
    rows.sort(key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt, r = t or "", rows[(k + 1) % len(rows)][1] or "", got[i]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r.near_edited - like(t, e)) < 1e-12 and abs(r.near_next - like(t, nxt)) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (pieces(t) == pieces(e))
        assert abs(published(r.fingerprint, r.edited_fingerprint) - r.near_edited) < 1e-12
        assert abs(published(r.fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint) - r.near_next) < 1e-12
    assert got[503].fingerprint == got[504].fingerprint
    assert re.fullmatch(r"8/-+", got[500].fingerprint)


def published(left, right):
    """Likeness of two published fingerprints, by their text alone."""

    def digests(text):
        out = set()
        for block in text.split("."):
            third, _, cells = block.partition("/")
            cells = [(0, 0, 0) if c == "-" else tuple(int(x or "0", 16) for x in c[:-1].split(":")) for c in re.findall(r"-|[^-;]+;", cells)]
            if int(third, 16) == 0:
                out |= {k for _, k, _ in cells}
                continue
            while single := {(k, h) for c, k, h in cells if c == 1}:
                for k, h in single:
                    t = int(third, 16)
                    s = h - (1 << 64) if h >> 63 else h
                    at = {j * t + (s >> 20 * j) % t for j in range(3)}
                    assert all(cells[i][0] > 0 for i in at)
                    cells = [(c - 1, a ^ k, b ^ h) if i in at else (c, a, b) for i, (c, a, b) in enumerate(cells)]
                    out.add(k)
            assert set(cells) <= {(0, 0, 0)}
        return out

    a, b = digests(left), digests(right)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints_compare_after_publication(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = fp.op10_fingerprint(spark, str(tmp_path))
    d = d.withColumns({"l": F.expr(fp.decoded("fingerprint")), "r": F.expr(fp.decoded("edited_fingerprint"))})
    for r in fp.compared(d, "l", "r", "again").collect():
        assert abs(r.again - r.near_edited) < 1e-12


def test_long_texts_and_few_changes(spark):
    a = [f"line {k}" for k in range(50_000)]
    b = [x for k, x in enumerate(a) if k not in (77, 4000)] + ["new"]
    d = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string")
    d = d.select(*(F.expr(fp.sketch(fp.digests(c))).alias(to) for c, to in (("a", "l"), ("b", "r"))))
    r = fp.compared(d, "l", "r", "near").select("near", "near_diff").first()
    assert sorted(x.c for x in r.near_diff) == [-1, 1, 1]


def test_peeling_recovers_digests_and_retries(spark):
    a, b = "\n".join(f"left {k}" for k in range(40)) + "\nboth", "both\n" + "\n".join(f"right {k}" for k in range(9))
    d = spark.createDataFrame([(a, b)], "a string, b string")
    d = d.select(*(F.expr(fp.sketch(fp.digests(c))).alias(to) for c, to in (("a", "l"), ("b", "r"))))
    d = fp.compared(d, "l", "r", "near")
    r = d.first()
    assert sorted(x.c for x in r.near_diff) == [-1] * 9 + [1] * 40
    want = {x[0] for x in spark.createDataFrame([(p,) for p in pieces(a) - pieces(b)], "p string").select(F.xxhash64("p")).collect()}
    assert {x.k for x in r.near_diff if x.c == 1} == want


def test_repeated_ids_nulls_and_empty_tables(spark, tmp_path):
    rows = [(1, "a", 1), (1, "b", 2), (1, "b", 2), (None, "c", 3), (None, None, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").write.parquet(f"{tmp_path}/documents.parquet")
    assert fp.op10_fingerprint(spark, str(tmp_path)).count() == 5
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fp.op10_fingerprint(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(4, "alone here")], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    r = fp.op10_fingerprint(spark, f"{tmp_path}/one").first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"alonealone").hexdigest()
