import random
import re

from spindrift.llm import jaccard


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        best[r] = min([x for x in (best.get(r), i) if x is not None], default=None)
    return sorted(map(str, ((i, len(sets[k]), best[find(k)]) for k, (i, _) in enumerate(docs))))


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "B", "ñ", "c.", "dd"]) + str(rnd.randint(0, 400))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([0, 2, 4, 5, 30, 90, 300]))] + (passage if rnd.random() < 0.4 else [])
        docs.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    w[rnd.randrange(len(w))] = word()
            docs.append("\n".join(w).upper() if rnd.random() < 0.3 else "  ".join(w))
    chain = [word() for _ in range(200)]  # each links with the next, the ends do not
    for _ in range(8):
        docs.append(" ".join(chain))
        chain = chain[18:] + [word() for _ in range(18)]
    hub = [word() for _ in range(120)]  # many near copies of one text
    for _ in range(60):
        w = list(hub)
        w[rnd.randrange(120)] = word()
        docs.append(" ".join(w))
    rnd.shuffle(docs)
    return [(k * 7 % 1009, t) for k, t in enumerate(docs)]


def check(spark, tmp_path, docs, parts=3):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(tuple(r)) for r in jaccard.op3_ngram_join(spark, str(tmp_path)).collect()) == brute(docs)


def test_groups_equal_brute_force(spark, tmp_path):
    check(spark, tmp_path, [*corpus(1), (5000, None), (5001, ""), (5002, " \n"), (3, "same id other text"), (3, "same id other text"), (None, "no id here"), (None, "NO id here"), (5004, "y" * 200000), (5005, "lone words " * 30000)])


def test_small_blocks_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    monkeypatch.setattr(jaccard, "MEMBERS", 5)
    check(spark, tmp_path, corpus(2)[:250])


def test_stage_keeps_one_of_each_group(spark, tmp_path):
    docs = corpus(4)[:120] + [(9000, "one two three four five six"), (9000, "one two three four five six"), (9001, ""), (9001, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n long".replace("n long", "n string"))
    want = {r.split(", ")[-1].rstrip(")") for r in brute(docs)}
    got = [r.doc_id for r in jaccard.stage(spark, df, "").collect()]
    assert sorted(str(x) for x in got) == sorted([*want, "9001"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert jaccard.op3_ngram_join(spark, str(tmp_path)).count() == 0
