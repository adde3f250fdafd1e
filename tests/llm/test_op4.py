import collections
import math
import pickle
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import attention, lm, subwords


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def corpus(n=250):
    rnd = random.Random(9)
    make = lambda: "".join(rnd.choice(["th", "er", "ón", "re", "ß", "an", "THE"]) for _ in range(rnd.randint(1, 4)))
    docs = [(k, " ".join(make() + rnd.choice(["", "", ",", "\n"]) for _ in range(rnd.choice([0, 1, 5, 40, 400])))) for k in range(n)]
    return [*docs, (900, None), (901, " \t\n"), (902, "q" * 30000), (903, "z " * 9000), (3, docs[3][1]), (904, "non breaking 　 wide")]


def brute_score(model, text, counts, n):
    """log10 of a text's chance: plain loops, one place at a time, attention over every id that its window shows."""
    v, p = lm.ids_of(subwords.default_path()), model.p
    words_ = [v.words((" " + w).encode())[0].tolist() for w in words(text)]
    stream = [i for w in words_ for i in w] + [v.end]

    def distribution(t):
        first = t // attention.SPAN * attention.SPAN - attention.CONTEXT
        shown = [(k, v.end if k == 0 else stream[k - 1]) for k in range(max(0, first), t + 1)]
        e = [p["e"][i] + p["pos"][k - first] for k, i in shown]
        q = e[-1] @ p["q"] / math.sqrt(attention.WIDTH)
        w = [math.exp(float(q @ (x @ p["k"]))) for x in e]
        h = e[-1] + sum(a * (x @ p["v"]) for a, x in zip(w, e)) / sum(w) @ p["o"]
        high = np.exp((h @ p["a"] + p["ba"]).astype(np.float64))
        low = np.exp((h @ p["b"] + p["t"]).astype(np.float64))
        return high / high.sum(), low / low.sum(axis=1, keepdims=True)

    chance = []
    for t, i in enumerate(stream):
        high, low = distribution(t)
        hi, lo = divmod(i, attention.DIGIT)
        chance.append((high[hi] * low[hi, lo], high[v.starts :].sum()))
    total, at = 0.0, 0
    for w, name in [*zip(words_, words(text)), ([v.end], None)]:
        own = math.prod(c for c, _ in chance[at : at + len(w)]) / chance[at][1]
        at += len(w)
        own *= chance[at][1] if at < len(stream) else 1
        total += math.log10(lm.MIX * counts[name] / n + (1 - lm.MIX) * own)
    return total


def test_counts_base_and_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_BYTES", 2 << 20)
    docs = corpus()
    rows = [(i, t, "x", 1.0) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, held string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in docs if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    models = []
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(real(*a)) or models[-1])
    got = lm.scored(spark.read.parquet(f"{tmp_path}/documents.parquet"), lm.remainder("doc_id", 7) == 2).collect()
    assert len(got) == len(docs)
    want, texts = {}, dict(docs)
    for i, t in docs:
        w = [*words(t), None]
        want[i] = (held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6
        if r.n_tokens < 500:
            assert abs(r.score - brute_score(models[0], texts[r.doc_id], c, n)) < 1e-3 + 1e-5 * abs(r.score), r.doc_id
    untrained = attention.Attention.new()
    held_texts = [r for r in got if r.held_out and 3 < r.n_tokens < 500]
    assert len(held_texts) > 10 and sum(r.score for r in held_texts) > sum(brute_score(untrained, texts[r.doc_id], c, n) for r in held_texts)


def test_all_documents_teach(spark, monkeypatch):
    """The rounds together see every id of what teaches once a pass; 40,000 copies of one row are no different."""
    rows = [(1, "one row of words")] * 40_000 + [(2, "others"), (3, None), (None, "no id"), (4, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.col("doc_id").eqNullSafe(2))
    v = lm.ids_of(subwords.default_path())
    want = sum(len(v.words("".join(" " + w for w in words(t)).encode())[0]) + 1 for i, t in rows if i != 2)
    seen = []
    real = lm.trained
    monkeypatch.setattr(lm, "LEAST_BYTES", 0)
    monkeypatch.setattr(lm, "trained", lambda *a: seen.append(real(*a)) or seen[-1])
    lm.fit(d, v.path, 1)
    assert sum(n for n, _ in seen) == want


def test_mixture_is_a_probability():
    """At every place the chances of all ids add up to one, those of ids that begin a word to what log10() says; so do the shares of words."""
    v, model = lm.ids_of(subwords.default_path()), attention.Attention.new(5)
    ids = np.random.default_rng(1).integers(0, v.end, 60)
    x, place, _ = attention.windows(ids, np.array([0, 60]), v.end)
    every = [model.log10(x[:1], np.full((1, attention.SPAN), t), v.starts) for t in range(lm.IDS)]
    p = 10.0 ** np.array([a[0] for a, _ in every])
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)
    assert np.allclose(p[v.starts * attention.DIGIT :].sum(axis=0), 10.0 ** every[0][1][0], atol=1e-4)
    e = subwords.encoder(v.path, v.ranks)
    assert all((e.decode_single_token_bytes(k)[0] == 0x20) == (v.of_rank[k] >= v.starts * attention.DIGIT) for k in range(v.ranks))
    assert len(set(v.of_rank.tolist()) | {v.end}) == v.ranks + 1 <= lm.IDS


def test_gradient_and_causality():
    a = attention.Attention.new(3)
    rnd = np.random.default_rng(0)
    ids = rnd.integers(0, lm.IDS - 1, 150)
    x, place, scored = attention.windows(ids, np.array([0, 70, 70, 150]), lm.IDS - 1)
    assert scored.sum() == 150 and sorted(p + k for p, s in zip(place, scored) for k in range(s)) == list(range(150))
    y = ids[np.minimum(place[:, None] + np.arange(attention.SPAN), 149)]
    good = np.arange(attention.SPAN)[None, :] < scored[:, None]
    _, g = a.gradient(x, y, good)
    for name in a.p:
        w, k = a.p[name], np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, eps = w[k], 1e-2
        w[k] = old + eps
        up = a.gradient(x, y, good)[0]
        w[k] = old - eps
        down = a.gradient(x, y, good)[0]
        w[k] = old
        assert abs((up - down) / (2 * eps) - g[name][k]) < 0.02 * abs(g[name][k]) + 2e-4, name
    before = a.log10(x, y)[0]
    x2 = x.copy()
    x2[:, attention.CONTEXT + 10 :] = 5
    assert np.allclose(a.log10(x2, y)[0][:, :10], before[:, :10], atol=1e-5)


def test_word_ids_have_one_start_each():
    w = ["don't", "a-b", "ünï", "x" * 500, " ", "<|endoftext|>", "1,000", "\x00"]
    v = lm.ids_of(subwords.default_path())
    ids, at = v.words("".join(" " + x for x in w).encode())
    rank = {i: k for k, i in enumerate(v.of_rank.tolist())}
    assert len(at) == len(w) + 1
    assert [subwords.encoder(v.path, v.ranks).decode([rank[i] for i in ids[a:b].tolist()]) for a, b in zip(at, at[1:])] == [" " + x for x in w]


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored(d, F.lit(False)).count() == 0


def test_sums_by_id():
    r = np.random.default_rng(4)
    for n in (0, 1, 500):
        ids, rows = r.integers(0, 50, n), r.standard_normal((n, 3)).astype(np.float32)
        want = np.zeros((60, 3))
        np.add.at(want, ids, rows)
        got = attention._sums_by(ids, rows, 60)
        assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-4)


def test_texts_are_cut_into_ids_once(spark):
    """encoded() has every document as the ids of its words and an end, and every distinct word with its count where documents teach."""
    v, docs = lm.ids_of(subwords.default_path()), corpus(60)
    d = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in docs], "doc_id long, text string, held boolean")
    rows = lm.encoded(d, v, 1 << 20).collect()
    of = lambda w: np.asarray(v.words((" " + w).encode())[0], "<u2").tobytes()
    want = sorted((i, i % 7 == 2, b"".join(map(of, words(t))) + np.array([v.end], "<u2").tobytes()) for i, t in docs)
    assert sorted((r.doc_id, r.held, bytes(r.ids)) for r in rows if r.fragment is None) == want
    teach, counted = collections.Counter(w for i, t in docs if i % 7 != 2 for w in words(t)), collections.Counter()
    for r in rows:
        if r.fragment is not None:
            counted.update(dict(zip(np.frombuffer(r.hashes, "<u8").tolist(), np.frombuffer(r.counts, "<u4").tolist())))
    every = {w for _, t in docs for w in words(t)}
    ids, at = zip(*(v.words((" " + w).encode()) for w in every))
    hashes = lm._hashes(np.concatenate(ids), np.cumsum([0, *map(len, ids)])).tolist()
    assert counted == collections.Counter({h: teach[w] for h, w in zip(hashes, every)}) and len(set(hashes)) == len(every)


def test_batches_leave_nothing_behind():
    """The arrays that batches share hold nothing of the batch before, also where that was larger or smaller."""
    v, r = lm.IDS - 1, np.random.default_rng(2)
    ids = r.integers(0, v, 4000)
    x, place, n = attention.windows(ids, np.array([0, 10, 1500, 1500, 4000]), v)
    y = ids[np.minimum(place[:, None] + np.arange(attention.SPAN), 3999)]
    good = np.arange(attention.SPAN)[None, :] < n[:, None]
    used = attention.Attention.new(1)
    for a, b in ((0, 60), (60, 70), (3, 64)):
        loss, g = used.gradient(x[a:b], y[a:b], good[a:b])
        loss2, g2 = attention.Attention.new(1).gradient(x[a:b], y[a:b], good[a:b])
        assert loss == loss2 and all(np.array_equal(g[k], g2[k]) for k in g)
        assert np.array_equal(used.log10(x[a:b], y[a:b])[0], attention.Attention.new(1).log10(x[a:b], y[a:b])[0])
    assert not used.rooms == {} and pickle.loads(pickle.dumps(used)).rooms == {}
