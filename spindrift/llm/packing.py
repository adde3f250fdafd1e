"""Sequence packing as vector bin packing by the dot-product heuristic.

Every example has a demand in three dimensions: tokens, segments and loss-bearing tokens.
A sequence has a limit in each.  Whole stretches that fill a sequence go out at once; of the
rest, the sequence being filled takes, again and again, the example whose demand has the
largest dot product with what room is left, each dimension weighted by the mean demand.
When nothing fits whole, the heuristic's first choice among the others is cut to the room.
A sequence that still has room (its segments or loss tokens are used up, or a partition's
last one) is cut at powers of two, so that the format pads nothing.

Each partition packs its own rows, with a bounded pool of examples; there is no shuffle and
no state besides.  A sequence id holds the partition and a count, so a task that runs again
on the same rows gives the same ids.

Null texts are empty.  An empty text is one end token.  Repeated rows each get pieces, examples of equal
product go in the order they came.  Texts are packed whole, in as many pieces as it takes; an empty table
gives none.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import subwords
from spindrift.llm.common import bounded_batches, table

MAX_TOKENS = 2048
#: Segments of one sequence, and its loss-bearing tokens, at most.
MAX_SEGMENTS = 128
MAX_LOSS = 2048
END_ID = 1
#: Examples that wait in a partition, and their tokens together, at most.
POOL = 1024
POOL_TOKENS = 1 << 20


@dataclass
class Piece:
    doc: object
    ids: np.ndarray  # all ids of the document
    start: int
    length: int
    loss_from: int  # ids before it bear no loss
    sequence: int = 0
    offset: int = 0

    def loss(self, length: int | None = None) -> int:
        return max(0, self.start + (self.length if length is None else length) - max(self.start, self.loss_from))

    def fits(self, tokens: int, loss: int) -> int:
        """Ids from its start that fit in so many tokens and loss-bearing tokens."""
        return min(self.length, tokens, max(0, self.loss_from - self.start) + loss)

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids, self.start, n, self.loss_from), Piece(self.doc, self.ids, self.start + n, self.length - n, self.loss_from)


class Packer:
    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, pool: int = POOL):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be 1 at least")
        self.limit = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.pool = pool
        self.items: list[Piece | None] = []
        self.demand = np.zeros((pool + 1, 3))
        self.used = 0
        self.tokens = 0
        self.sequence = 0

    def add(self, piece: Piece) -> Iterator[Piece]:
        """Takes a document in; gives the pieces that are placed meanwhile."""
        tokens, _, loss = map(int, self.limit)
        while piece.length > (n := piece.fits(tokens, loss)) or n == tokens:
            head, piece = piece.split(n)
            yield from self.close([head])
            if not piece.length:
                return
        self.put(piece)
        while self.used >= self.pool or self.tokens > POOL_TOKENS:
            yield from self.fill()

    def put(self, piece: Piece) -> None:
        self.items.append(piece)
        self.demand[self.used] = piece.length, 1, piece.loss()
        self.used += 1
        self.tokens += piece.length

    def take(self, k: int) -> Piece:
        piece, last = self.items[k], self.items.pop()
        self.used -= 1
        if k < self.used:
            self.items[k] = last
            self.demand[k] = self.demand[self.used]
        self.tokens -= piece.length
        return piece

    def fill(self) -> Iterator[Piece]:
        """Fills one sequence from the pool."""
        weight = self.demand[: self.used].mean(axis=0) / self.limit**2
        room, placed = self.limit.copy(), []
        while self.used and room.min() >= 1:
            d = self.demand[: self.used]
            value = d @ (weight * room)
            whole = (d <= room).all(axis=1)
            if whole.any():
                piece = self.take(int(np.argmax(np.where(whole, value, -1))))
            else:
                piece = self.take(int(np.argmax(value)))
                piece, rest = piece.split(piece.fits(int(room[0]), int(room[2])))
                self.put(rest)
            placed.append(piece)
            room -= (piece.length, 1, piece.loss())
        yield from self.close(placed)

    def close(self, placed: list[Piece]) -> Iterator[Piece]:
        """Numbers the pieces of a sequence; one that is not full becomes several, of powers of two."""
        left, tokens = sum(p.length for p in placed), int(self.limit[0])
        queue = placed[::-1]
        while left:
            size = tokens if left == tokens else 1 << int(math.log2(left))
            at = 0
            while at < size:
                piece = queue.pop()
                if piece.length > size - at:
                    piece, rest = piece.split(size - at)
                    queue.append(rest)
                piece.sequence, piece.offset = self.sequence, at
                at += piece.length
                yield piece
            self.sequence += 1
            left -= size

    def finish(self) -> Iterator[Piece]:
        while self.used:
            yield from self.fill()


def pack(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    loss_from: str | None = None,
    tokenizer: str | None = None,
    end_id: int | None = END_ID,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    loss_from: a column with the number of leading ids of a document that bear no loss (null: none).
    """
    bounded_batches(documents.sparkSession)
    path = tokenizer or subwords.default_path()
    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), (F.col(loss_from) if loss_from else F.lit(0)).cast("long").alias("l"))
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 40
        ready: list[Piece] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([p.doc for p in ready], doc_type),
                    pa.array([p.start for p in ready], pa.int64()),
                    pa.array([p.length for p in ready], pa.int64()),
                    pa.array([p.ids[p.start : p.start + p.length].tobytes() for p in ready], pa.binary()),
                    pa.array([len(p.ids) for p in ready], pa.int64()),
                    pa.array([base + p.sequence for p in ready], pa.int64()),
                    pa.array([p.offset for p in ready], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            ready.clear()
            return out

        doc_type = None
        for batch in batches:
            doc_type = batch.column(0).type
            for doc, body, skip in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = np.concatenate([subwords.encode(body.as_py(), path), end])
                for p in packer.add(Piece(doc, ids, 0, len(ids), skip or 0)) if len(ids) else ():
                    ready.append(p)
                    size += p.length
                    if size > POOL_TOKENS:
                        yield flush()
                        size = 0
        ready += packer.finish()
        if ready:
            yield flush()

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pack(table(spark, sf_dir, "documents")))


def _digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return _digest(pack(docs))


QUERIES = {"op9_pack": op9_pack}
