import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from spindrift.llm import tokencount as tc


def library(pieces):
    t = Tokenizer(models.Unigram([*pieces], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return t


@pytest.fixture(scope="module")
def reference():
    return library(tc.vocabulary(tc.default_path()))


def texts():
    rnd = random.Random(4)
    parts = ["the", "thhaor", "ción", "é", "漢字", "\n", "\n\n", " ", "  ", "▁", "123", "###", "\x00", "🙂", "ß", "<0x41>", "<s>", "<unk>", "Ünï", "a" * 40, "͸", "\uffff"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.choice([1, 3, 20, 400]))) for _ in range(250)]


def test_counts_equal_the_tokenizers_library(reference):
    all_texts = ["", " ", "  ", "▁", "\n", "x", "🙂" * 5, "q" * 20000, " leading", "trailing ", *texts()]
    got = tc.counter(tc.default_path()).column(pa.array([*all_texts, None]))
    assert got.tolist() == [*(len(e.ids) for e in reference.encode_batch(all_texts, add_special_tokens=False)), 0]


def test_ties_go_to_the_piece_that_starts_first():
    bytes_ = [(f"<0x{k:02X}>", -9.0) for k in range(256)]
    pieces = [(tc.UNKNOWN, 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), *bytes_]
    t, c = library(pieces), tc.Counter(tuple(pieces))
    rnd = random.Random(8)
    cases = ["".join(rnd.choice("aab c") for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    assert c.column(pa.array(cases)).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in cases]
    assert [c.text(x) for x in cases] == c.column(pa.array(cases)).tolist()


def test_query(spark, tmp_path, reference):
    docs = [(k, t, "x") for k, t in enumerate(texts()[:40])] + [(90, None, "x"), (None, "a b", "x"), (0, "again", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, len(t or ""), len(reference.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in docs]
    assert sorted(str(tuple(r)) for r in tc.op7_token_counts(spark, str(tmp_path)).collect()) == sorted(map(str, want))
    assert tc.counted(spark.createDataFrame([], "text string")).count() == 0
