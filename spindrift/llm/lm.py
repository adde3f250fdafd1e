"""LM scoring: a causal self-attention model on subword ids, mixed with the corpus's word counts.

A text is its words, in lower case A-Z, and one end.  Two models learn from all documents that are not
held out.  Word counts are one.  The attention model (attention.py) is the other: it sees words as
subword ids, the first merges of a public byte-level BPE, and every id of every text that teaches is
scored once in training.  Training goes over the data in ROUNDS: in each, every task begins with the
same model and takes a step for each batch of windows of its part of the texts, and the models that the
tasks end with are averaged by the ids they saw.  So the work is in proportion to the data, at every
size, and no task waits for another within a round.  Texts of less than LEAST_BYTES together are gone
over several times.

Ids that begin a word (and the end) have high digits of their own, so the chance that a word ends at a
place is read off with the model's first digit.  Given the words before it, a word has as its chance the
product of its subwords' chances, given that a word begins, times the chance that it ends there; these
add up to one over all words.  The score mixes it, with weight 1 - MIX, with the word's share of all
tokens that teach, which also adds up to one; a word that was never seen has the attention model's share
alone.  Every id is scored once, given CONTEXT to CONTEXT + SPAN - 1 ids before it.

Documents are dealt to buckets by hash, about BUCKET_BYTES of text in each.  A bucket is cut into words and
ids once, which are written down: training and scoring read those.  It sends each of its
distinct words' hashes once, with the bucket's own count, to the fragment of the hash; the fragment adds
up, and the totals go back.  So a frequent word costs a number for each bucket, and no table of all words
is ever in one place.

Null texts are empty: an end alone.  Repeated rows count again, and get equal scores.  A null doc_id is
not held out.  Texts are scored whole, however long, and an empty table has no scores.  Other columns are
not read, whatever their names.  Words are told apart by 64-bit hashes of their ids.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bytewords as bw
from spindrift.llm import subwords
from spindrift.llm.attention import DIGIT, SPAN, Adam, Attention, windows
from spindrift.llm.common import bounded_batches, parts, remainder, shared_dir, table, written

#: crc32(doc_id as text) modulo FOLDS; HELD_OUT teaches nothing.
FOLDS, HELD_OUT = 7, 2
#: Training is dealt to SLICES by hash; each round has some of them, and a rate.
SLICES = 16
ROUNDS = ((range(0, 1), 0.02), (range(1, 4), 0.01), (range(4, 10), 0.005), (range(10, 14), 0.002), (range(14, 16), 0.0007))
#: Bytes of text that training goes over at least, if there is any; passes over one text at most.
LEAST_BYTES, PASSES = 32 << 20, 64
#: Bytes of all texts for each task of a round at least: models of fewer steps average worse.
TASK_BYTES = 32 << 20
#: Bytes of ids, two each, that windows are made of and shuffled at once.
SHUFFLED = 2 << 20
#: Share of the word counts in a word's probability.
MIX = 0.25
#: Bytes of text of a bucket.
BUCKET_BYTES = 32 << 20
#: Ids.
IDS = DIGIT * DIGIT
#: Windows that are scored at once.
SCORED = 1024


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, data, at in bw.chunks(column):
        data = bw.lower(data)
        starts, ends, first = bw.spans(data, at, bw.NOT_SPACE)
        yield a, b, data, starts, ends, first, bw.span_hashes(data, starts, ends)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """A space before each of the words."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    out = np.where(place == 0, 0x20, data[np.maximum(np.repeat(starts, size) + place - 1, 0)] if len(data) else 0)
    return out.astype(np.uint8).tobytes()


@dataclass
class Ids:
    """The ids of a vocabulary: ranks that go on a word, then, from a high digit of their own, those that begin one, and the end."""

    path: str
    ranks: int
    of_rank: np.ndarray
    begins: np.ndarray  # by rank
    starts: int  # the first high digit of those that begin a word
    end: int

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, and offsets of the words."""
        ranks = subwords.encode(text.decode(), self.path, self.ranks).astype(np.int64)
        return self.of_rank[ranks], np.append(np.flatnonzero(self.begins[ranks]), len(ranks)).astype(np.int64)


@functools.lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    """As many of the first ranks as there are ids for."""
    e = subwords.encoder(path, IDS - 1)
    begins = np.array([e.decode_single_token_bytes(k)[0] == 0x20 for k in range(IDS - 1)])
    digits = lambda n: -(-n // DIGIT)
    ranks = next(r for r in range(IDS - 1, 0, -1) if digits(int((~begins[:r]).sum())) + digits(int(begins[:r].sum()) + 1) <= DIGIT)
    begins = begins[:ranks]
    starts = digits(int((~begins).sum()))
    of_rank = np.where(begins, starts * DIGIT + np.cumsum(begins) - 1, np.cumsum(~begins) - 1).astype(np.int32)
    return Ids(path, ranks, of_rank, begins, starts, starts * DIGIT + int(begins.sum()))


def _ragged(ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words in which, one after another, and offsets."""
    size = np.diff(at)[which]
    to = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(at[which] - to[:-1], size) + np.arange(to[-1])], to


def _unique(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and which of them each one is; only the distinct ones are sorted."""
    found = pa.array(hashes).dictionary_encode()
    distinct = np.asarray(found.dictionary)
    order = np.argsort(distinct)
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    return distinct[order], to[np.asarray(found.indices)]


def _with_ends(words: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with end's after each document, and offsets."""
    return np.insert(words, first[1:], end), first + np.arange(len(first))


@dataclass
class Vocabulary:
    """The distinct words of some chunks, each encoded once."""

    unique: np.ndarray  # hashes
    which: np.ndarray  # of each word of the chunks, one chunk after another
    ids: np.ndarray
    at: np.ndarray
    number: np.ndarray  # of each hash in ids and at; the end's is the last

    @classmethod
    def of(cls, chunked: list, vocabulary: Ids) -> Vocabulary:
        unique, which = _unique(np.concatenate([np.zeros(0, np.uint64), *(c[-1] for c in chunked)]))
        first = np.empty(len(unique), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]  # of several numbers for a place the last one stays
        new = np.zeros(len(which), bool)
        new[first] = True
        used, texts = 0, []
        for _, _, data, starts, ends, _, h in chunked:
            place = np.flatnonzero(new[used : used + len(h)])
            used += len(h)
            texts.append(_joined(data, starts[place], ends[place]))
        ids, at = vocabulary.words(b"".join(texts))
        number = np.empty(len(unique) + 1, np.int64)
        number[which[new]] = np.arange(len(unique))
        number[-1] = len(unique)
        return cls(unique, which, np.append(ids, np.int32(vocabulary.end)), np.append(at, len(ids) + 1), number)


def _averaged(t: pa.Table) -> pa.Table:
    n = np.asarray(t.column("n").combine_chunks()).astype(np.float64)
    p = sum(k * np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for k, x in zip(n, t.column("p"))) / n.sum()
    return pa.table({"task": t.column("task").slice(0, 1), "n": pa.array([int(n.sum())]), "p": pa.array([p.astype("<f4").tobytes()], pa.binary())})


def _streams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) of consecutive runs of rows of ids."""
    for a, b, data, at in bw.chunks(column):
        yield a, b, np.frombuffer(data.tobytes(), "<u2").astype(np.int32), at // 2


def trained(texts: DataFrame, vocabulary: Ids, model: Attention, rate: float, passes: int = 1) -> tuple[int, Attention]:
    """How many ids the texts have, and the average of the models that the tasks make of model.  texts: rows of ids."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, adam = None, 0, None

        def learn(chunked: list) -> None:
            nonlocal own, seen, adam
            adam = adam or Adam(rate, zlib.crc32(chunked[0][0]))
            own, xs, ys = own or shared.value.filled(shared.value.flat()), [], []
            for stream, at in chunked:
                x, place, n = windows(stream, at, vocabulary.end)
                y = stream[np.minimum(place[:, None] + np.arange(SPAN), len(stream) - 1)]
                y[np.arange(SPAN)[None, :] >= n[:, None]] = -1
                xs.append(x)
                ys.append(y)
            x, y = np.concatenate(xs), np.concatenate(ys)
            seen += int((y >= 0).sum())
            for _ in range(passes):
                own.train(x, np.maximum(y, 0), y >= 0, adam)

        left, size = [], 0
        for batch in batches:
            for _, _, stream, at in _streams(batch.column(0)):
                left.append((stream, at))
                size += 2 * len(stream)
                if size >= SHUFFLED:
                    learn(left)
                    left, size = [], 0
        if left:
            learn(left)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([own.flat().astype("<f4").tobytes()], pa.binary())], names=["n", "p"])

    made = texts.select("ids").mapInArrow(run, "n long, p binary")
    # Averaged in two steps, so that no group grows with the number of tasks.
    made = made.withColumn("task", F.pmod(F.xxhash64("p"), F.lit(64)).cast("int")).groupBy("task").applyInArrow(_averaged, "task int, n long, p binary")
    got = made.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(_averaged, "task int, n long, p binary").collect()
    shared.destroy()
    return (got[0].n, model.filled(np.frombuffer(bytes(got[0].p), "<f4"))) if got else (0, model)


def fit(documents: DataFrame, path: str, size: int, rounds=ROUNDS) -> Attention:
    """The attention model of all documents that are not held out, with their texts or as encoded() gives them.  size: bytes of all texts."""
    vocabulary, model = ids_of(path), Attention.new()
    if "ids" not in documents.columns:
        documents = encoded(documents, vocabulary, size)
    d = documents.filter("NOT held").select("ids", "slice").coalesce(max(1, int(size) // TASK_BYTES))
    passes = int(np.clip(LEAST_BYTES // max(1, size), 1, PASSES))
    for slices, rate in rounds:
        _, model = trained(d.filter(F.col("slice").between(slices[0], slices[-1])), vocabulary, model, rate, passes)
    return model


def _fragments(hashes: np.ndarray, n: int) -> np.ndarray:
    return np.floor((hashes >> np.uint64(32)).astype(np.float64) * (n / 2.0**32)).astype(np.int64)


def _hashes(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each word's ids; at: offsets of the words."""
    return bw.span_hashes(np.frombuffer(ids.astype("<u2").tobytes(), np.uint8), 2 * at[:-1], 2 * at[1:])


def _runs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of runs of numbers; at: their offsets."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _encoded(vocabulary: Ids, fragments: int):
    def run(t: pa.Table) -> pa.Table:
        """A bucket's documents as ids; and by fragment its distinct words and how often its documents that teach have them."""
        t = t.sort_by([("doc_id", "ascending"), ("slice", "ascending")])  # a shuffle's order is a matter of chance
        teach = ~np.asarray(t.column("held").combine_chunks())
        chunked = list(_words(t.column("text")))
        words = Vocabulary.of(chunked, vocabulary)
        used, n, ids = 0, np.zeros(len(words.unique), np.int64), []
        for a, b, _, _, _, first, h in chunked:
            which = words.which[used : used + len(h)]
            used += len(h)
            n += np.bincount(which[np.repeat(teach[a:b], np.diff(first))], minlength=len(n))
            own, docs_at = _with_ends(which, first, len(words.unique))
            stream, word_at = _ragged(words.ids, words.at, words.number[own])
            ids.append(_runs(stream.astype("<u2"), word_at[docs_at]))
        h = _hashes(words.ids, words.at)[words.number[:-1]]
        order = np.argsort(h)
        bucket, h, n = t.column("bucket")[0].as_py(), h[order], n[order]
        at = np.searchsorted(_fragments(h, fragments), np.arange(fragments + 1))
        k = np.flatnonzero(np.diff(at))
        at = np.append(at[k], len(h))
        rows = t.select(["bucket", "doc_id", "held", "slice"]).append_column("ids", pa.chunked_array(ids))
        own = {"bucket": pa.array(np.full(len(k), bucket, np.int32)), "fragment": pa.array(k.astype(np.int32)), "hashes": _runs(h.astype("<u8"), at), "counts": _runs(n.astype("<u4"), at)}
        return pa.concat_tables([rows, pa.table(own)], promote_options="default")

    return run


def encoded(documents: DataFrame, vocabulary: Ids, size: int) -> DataFrame:
    """Documents, with doc_id, text and held, as rows of ids; and rows of distinct words, which have a fragment, hashes and counts.  size: bytes of all texts."""
    spark = documents.sparkSession
    bounded_batches(spark)
    fragments = max(parts(spark), int(size) // BUCKET_BYTES + 1)
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held", F.lit(False)).alias("held"))
    d = d.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text", F.lit("slice")), F.lit(SLICES)).cast("int"))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(fragments)).cast("int"))
    own = f"bucket int, doc_id {d.schema['doc_id'].dataType.simpleString()}, held boolean, slice int, ids binary, fragment int, hashes binary, counts binary"
    return written(d.groupBy("bucket").applyInArrow(_encoded(vocabulary, fragments), own), "ids")


def _totals(t: pa.Table) -> pa.Table:
    """The words' counts in all buckets, for each bucket in its order; and the fragment's tokens and distinct words (bucket null)."""
    words = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("hashes")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t.column("counts")]).astype(np.int64)
    unique, which = _unique(np.concatenate(words))
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, which, counts)
    back, at = total[which], np.cumsum([0, *map(len, words)])
    n = len(t)
    return pa.table(
        {
            "bucket": pa.concat_arrays([t.column("bucket").combine_chunks(), pa.nulls(1, pa.int32())]),
            "fragment": pa.concat_arrays([t.column("fragment").combine_chunks(), pa.nulls(1, pa.int32())]),
            "totals": pa.array([*(back[a:b].astype("<u8").tobytes() for a, b in zip(at, at[1:])), None], pa.binary()),
            "tokens": pa.array([*[None] * n, int(total.sum())], pa.int64()),
            "distinct": pa.array([*[None] * n, int((total > 0).sum())], pa.int64()),
        }
    )


def log_words(model: Attention, vocabulary: Ids, stream: np.ndarray, word_at: np.ndarray, docs_at: np.ndarray) -> np.ndarray:
    """log10 of the chance of each word, given those before it.

    stream: ids; word_at: offsets of the words, of which each document's last one is its end; docs_at: offsets of the documents, in words.
    """
    x, place, n = windows(stream, word_at[docs_at], vocabulary.end)
    logs, begins, steps = np.empty(len(stream)), np.empty(len(stream)), np.arange(SPAN)
    for k in range(0, len(x), SCORED):
        at = place[k : k + SCORED, None] + steps
        good = steps[None, :] < n[k : k + SCORED, None]
        p, b = model.log10(x[k : k + SCORED], stream[np.minimum(at, len(stream) - 1)], vocabulary.starts)
        logs[at[good]], begins[at[good]] = p[good], b[good]
    # What begins a word is given that one begins; that it ends is that the next one begins.
    out = np.add.reduceat(logs, word_at[:-1]) - begins[word_at[:-1]]
    inner = np.ones(len(out), bool)
    inner[docs_at[1:] - 1] = False
    out[inner] += begins[word_at[1:-1][inner[:-1]]]
    return out


def scored(documents: DataFrame, held, path: str | None = None, rounds=ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held: a boolean Column; documents where it is true teach nothing.
    """
    spark = documents.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    path = path or subwords.default_path()
    vocabulary = ids_of(path)
    d = documents.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    size, ends = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held"))).first()
    rows = encoded(d, vocabulary, size)
    model = spark.sparkContext.broadcast(fit(rows, path, size, rounds))
    words = rows.filter("fragment IS NOT NULL").select("bucket", "fragment", "hashes", "counts")
    totals = written(words.groupBy("fragment").applyInArrow(_totals, "bucket int, fragment int, totals binary, tokens long, distinct long"), "counts")
    n, v = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, v = int(n) + ends, int(v) + (ends > 0)

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        n_docs = len(docs)
        if not n_docs:
            return pa.table({k: pa.array([], t) for k, t in zip(names, (kind, pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 2))})
        back = back.sort_by("fragment")
        totals = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x.as_buffer(), "<u8") for x in back.column("totals"))]).astype(np.float64)
        count = np.append(totals, ends)  # by hash; the end comes last
        log_base = np.log10(count + 1) - np.log10(n + v + 1)
        share = MIX * count / max(1, n)
        base, score = np.empty(n_docs), np.empty(n_docs)
        tokens, known = np.empty(n_docs, np.int64), np.empty(n_docs, np.int64)
        chunked, hashes = [], []
        for a, b, stream, at in _streams(docs.column("ids")):
            word_at = np.append(np.flatnonzero(stream >= vocabulary.starts * DIGIT), len(stream))
            docs_at = np.searchsorted(word_at, at)
            inner = np.ones(len(word_at) - 1, bool)
            inner[docs_at[1:] - 1] = False  # the ends
            chunked.append((a, b, stream, word_at, docs_at, inner))
            hashes.append(_hashes(stream, word_at)[inner])
        _, which = _unique(np.concatenate(hashes))  # in the order of totals
        used = 0
        for a, b, stream, word_at, docs_at, inner in chunked:
            own = np.full(len(inner), len(totals))
            own[inner] = which[used : used + np.count_nonzero(inner)]
            used += np.count_nonzero(inner)
            tokens[a:b] = np.diff(docs_at)
            known[a:b] = np.add.reduceat((count[own] > 0).astype(np.int64), docs_at[:-1])
            base[a:b] = np.add.reduceat(log_base[own], docs_at[:-1])
            log = log_words(model.value, vocabulary, stream, word_at, docs_at) + np.log10(1 - MIX)
            # A long word's chance may be too small for a number that is no logarithm.
            with np.errstate(divide="ignore", under="ignore"):
                both = np.where(share[own] > 0, np.logaddexp(np.log(share[own]), log * np.log(10)) / np.log(10), log)
            score[a:b] = np.add.reduceat(both, docs_at[:-1])
        return pa.table([docs.column("doc_id").combine_chunks(), docs.column("held").combine_chunks(), *map(pa.array, (tokens, known, base, score))], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    id_type = documents.schema["doc_id"].dataType.simpleString()
    kind = {"int": pa.int32(), "string": pa.string()}.get(id_type, pa.int64())
    both = rows.filter("fragment IS NULL").select("bucket", "doc_id", "held", "ids").groupBy("bucket").cogroup(totals.filter("bucket IS NOT NULL").select("bucket", "fragment", "totals").groupBy("bucket"))
    out = both.applyInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", FOLDS) == HELD_OUT)


QUERIES = {"op4_lm_score": op4_lm_score}
