import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from spindrift.llm import packing, subwords


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def texts(n=80, seed=5):
    rnd = random.Random(seed)
    words = ["the", " thhaor", "é", "漢字", "\n\n", "  ", "'s", "123", "###", "\x00", " ", "🙂", "Ünï", "don't"]
    return ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.choice([0, 1, 5, 50, 900, 6000]))) for _ in range(n)]


def test_ids_equal_the_tokenizers_library(reference):
    for t in [*texts(), "x" * 5000, " " * 3000, None]:
        assert subwords.encode(t, subwords.default_path()).tolist() == reference.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [(2048, 128, 2048), (64, 3, 64), (64, 50, 20), (100, 2, 30)])
def test_packs_whole_and_within_limits(spark, reference, limits):
    tokens, segments, loss = limits
    rows = [(k, t, k % 7 * 3, "x") for k, t in enumerate([*texts(60), None, ""])] + [(0, "again", 0, "x"), (None, "no id", None, "x")]
    if tokens < 200:
        rows = [(a, b and b[:400], c, d) for a, b, c, d in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, skip long, ids string").repartition(3)
    out = [r.asDict() for r in packing.pack(df, loss_from="skip", max_tokens=tokens, max_segments=segments, max_loss=loss).collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        r["v"] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(r["v"]) == r["length"] > 0
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    skip = {(a, len(reference.encode(b or "", add_special_tokens=False).ids) + 1): c or 0 for a, b, c, _ in rows}
    for a, b, _, _ in rows:
        ids = reference.encode(b or "", add_special_tokens=False).ids + [1]
        got = sorted(by_doc[a, len(ids)], key=lambda r: r["start"])
        assert sum((r["v"] for r in got), []) == ids
        assert [r["start"] for r in got] == np.cumsum([0] + [r["length"] for r in got])[:-1].tolist()
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs])[:-1].tolist()
        total = sum(r["length"] for r in rs)
        assert total == tokens or total & (total - 1) == 0 and total < tokens
        assert len(rs) <= segments
        bearing = sum(max(0, r["start"] + r["length"] - max(r["start"], skip[r["doc_id"], r["doc_tokens"]])) for r in rs)
        assert bearing <= loss


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op9_pack(spark, str(tmp_path)).collect()
    ids = np.concatenate([subwords.encode("hello world", subwords.default_path()), [1]]).astype("<u4")
    first = [r for r in out if r.doc_id == 1]
    assert sum(r.length for r in first) == len(ids) == first[0].doc_tokens
    for r in first:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
