"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text's terms are its words (letters and digits, in lower case A-Z), runs of one to four character
shapes (what is upper or lower case, digit, space, line end or which mark; a run of letters, digits or
spaces counts once), and two for repetition: words that repeat the one before, and runs of five words
that the text has already had.  Words and shapes are hashed to a fixed number of columns each and
weighted by inverse document frequency, and an SVD of the labelled sample gives the latent space.

Fitting takes at most SAMPLE labelled documents, those with the smallest hashes of doc_id.  Their
vectors are the only broadcast; its size follows from SAMPLE and the number of columns alone.
Every document is compared with all of them, block by block; the NEIGHBOURS most similar (and
any that tie with the last) vote with their labels, weighted by similarity.

An empty or null text has no direction: it gets the sample's share of label 1.  Repeated labels of
a document are averaged, null labels are left out.  Without any labels the score is 0.5.  Repeated
rows get the same score each; texts are read whole.  Columns named like a result column are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bytewords as bw
from spindrift.llm.common import appended, least_hashed, remainder, shielded, table

#: Columns of shapes and repetition, and of words.
SHAPES, WORDS = 1024, 1024
COLUMNS = SHAPES + WORDS
RANK = 64
#: Steps of the iteration that finds them.
STEPS = 24
#: Labelled documents that a fit takes at most.
SAMPLE = 4000
NEIGHBOURS = 9
#: Votes are similarities to this power.
SHARPNESS = 8
THRESHOLD = 0.7
BLOCK = 256
#: Folds of crc32(doc_id as text); the held-out one teaches nothing.
FOLDS, HELD_OUT = 4, 2

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE = range(1, 6)
_SHAPE = np.full(256, _LOWER, dtype=np.int64)
_SHAPE[0x00:0x20] = _SPACE
_SHAPE[0x20] = _SPACE
_SHAPE[0x0A] = _LINE
_SHAPE[0x30:0x3A] = _DIGIT
_SHAPE[0x41:0x5B] = _UPPER
_marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_SHAPE[_marks] = np.arange(6, 6 + len(_marks))
_RADIX = 6 + len(_marks)
_ONCE = _LINE  # shapes up to it count once in a run
_SPECIAL = 2
#: Of the terms for repetition, as against one shape; and of words.
WEIGHT, WORD_WEIGHT = 3, 1


def terms(column: pa.Array) -> np.ndarray:
    """Term frequencies of each row, damped; a row of COLUMNS float32 for each."""
    out = np.zeros((len(column), COLUMNS), dtype=np.float32)
    for a, b, data, at in bw.chunks(column):
        rows = b - a
        row = np.repeat(np.arange(rows), np.diff(at))
        shape = _SHAPE[data]
        keep = np.ones(len(shape), dtype=bool)
        if len(shape):
            keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] > _ONCE) | (row[1:] != row[:-1])
        shape, row = shape[keep], row[keep]
        counts = np.zeros(rows * SHAPES, dtype=np.int64)
        gram = np.zeros(len(shape), dtype=np.int64)
        for k in range(4):
            n = len(shape) - k
            if n <= 0:
                break
            gram = gram[:n] * _RADIX + shape[k:]
            inside = row[:n] == row[k:]
            place = (bw.mix((gram[inside] * 4 + k).astype(np.uint64)) % np.uint64(SHAPES - _SPECIAL)).astype(np.int64)
            counts += np.bincount(row[:n][inside] * SHAPES + place, minlength=len(counts))
        counts = counts.reshape(rows, SHAPES)
        low = bw.lower(data)
        starts, ends, first = bw.spans(low, at, bw.NOT_SPACE)
        words = bw.span_hashes(low, starts, ends)
        where = np.repeat(np.arange(rows), np.diff(first))
        if len(words) > 1:
            same = (words[1:] == words[:-1]) & (where[1:] == where[:-1])
            counts[:, -1] = np.bincount(where[1:][same], minlength=rows)
        grams, of = bw.sequences(words, first, 5)
        _, edges = bw.distinct(grams, of, rows)
        counts[:, -2] = np.bincount(of, minlength=rows) - np.diff(edges)
        size = np.maximum(np.diff(first), 1)[:, None]
        out[a:b, :SHAPES] = np.sqrt(counts / size)
        out[a:b, SHAPES - _SPECIAL : SHAPES] *= WEIGHT
        starts, ends, first = bw.spans(low, at, bw.ALNUM)
        place = (bw.span_hashes(low, starts, ends) % np.uint64(WORDS)).astype(np.int64)
        where = np.repeat(np.arange(rows), np.diff(first))
        found = np.bincount(where * WORDS + place, minlength=rows * WORDS).reshape(rows, WORDS)
        out[a:b, SHAPES:] = WORD_WEIGHT * np.sqrt(found / np.maximum(np.diff(first), 1)[:, None])
    return out


@dataclass
class Model:
    weights: np.ndarray  # columns to latent dimensions
    vectors: np.ndarray  # of labelled documents, of length one
    labels: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        for k in range(0, len(x), BLOCK):
            v = x[k : k + BLOCK] @ self.weights
            size = np.linalg.norm(v, axis=1)
            good = size > 1e-9
            s = (v[good] / size[good, None]) @ self.vectors.T
            n = min(NEIGHBOURS, s.shape[1])
            last = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            vote = np.where(s >= last[:, None], np.maximum(s, 1e-6) ** SHARPNESS, 0)
            out[k : k + BLOCK][good] = (vote @ self.labels) / vote.sum(axis=1)
        return np.clip(out, 0, 1)


def leading(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The RANK leading right singular vectors of x * idf, by subspace iteration: nothing of the size of x is made."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], RANK + 16)))[0]
    for _ in range(STEPS):
        q = np.linalg.qr(idf[:, None] * (x.T @ (x @ (idf[:, None] * q).astype(np.float32))).astype(np.float64))[0]
    # Rotated to the singular vectors within the space.
    small = (x @ (idf[:, None] * q).astype(np.float32)).astype(np.float64)
    return (q @ np.linalg.eigh(small.T @ small)[1][:, ::-1])[:, :RANK]


def fitted(x: np.ndarray, labels: np.ndarray) -> Model:
    """Latent space and labelled vectors of a sample."""
    if not len(labels):
        return Model(np.zeros((COLUMNS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
    top = leading(x, idf)
    sign = np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    weights = (idf[:, None] * top * sign).astype(np.float32)
    v = x @ weights
    size = np.linalg.norm(v, axis=1)
    good = size > 1e-9
    return Model(weights, (v[good] / size[good, None]).astype(np.float32), labels[good].astype(np.float32), float(labels.mean()))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most sample of the labelled documents, none of them held out."""
    teach = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))
    teach = least_hashed(teach.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y")), ["doc_id"], sample)
    teach = teach.select(F.col("doc_id").alias("t_id"), "y").checkpoint()
    d = documents.select("doc_id", "text").join(F.broadcast(teach), F.col("doc_id") == F.col("t_id")).select("t_id", "y", "text")
    x = appended(d, lambda batch: {"x": pa.array([zlib.compress(r.tobytes(), 1) for r in terms(batch.column(2))], pa.binary())}, "x binary").select("t_id", "y", "x")
    rows = sorted(x.groupBy("t_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect(), key=lambda r: r.t_id)
    table_ = np.empty((len(rows), COLUMNS), np.float32)
    for k, r in enumerate(rows):
        table_[k] = np.frombuffer(zlib.decompress(bytes(r.x)), np.float32)
    return fitted(table_, np.array([r.y for r in rows]))


def scored(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with score and predicted; columns of these names are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        score = np.concatenate([shared.value.score(terms(batch.column(text).slice(k, 1024))) for k in range(0, batch.num_rows, 1024)])
        return {"score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    return appended(documents, make, "score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    d, own = shielded(docs, ["score", "predicted"])
    return own(scored(d, model).filter("predicted = 1"))


QUERIES = {"op8_quality": op8_quality}
