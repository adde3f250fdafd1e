"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ten consecutive words of a benchmark item (an item of fewer,
but not none, is one window).  Patterns of one length share a shift table over blocks
of two words: it tells how far a window can move on without passing an occurrence, so
positions in between are never looked at.  The table grows with the patterns, so that
most of it stays free.  Where the shift is zero, the hash of the window's last block
selects the patterns that can end there, and their words are then compared directly.
Many stretches of text move in step, one numpy operation for all.

One broadcast has the compiled patterns of BLOCK_BYTES of benchmark text, and its size
is checked.  A larger benchmark takes several passes, one after another; each writes
what it found, by the text's hash, before the next one's patterns are sent.

Nulls have no words.  Items without words match nothing.  Null item ids are left out
of lists.  Repeated items and documents each count; an empty benchmark hits nothing.
Texts are searched whole, however long.  Extra columns stay; those named like a result
column are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bytewords as bw
from spindrift.llm.common import appended, bounded_batches, quoted, shielded, table, without, written

WINDOW = 10
#: Words that one stretch of text has; all stretches of a chunk move in step.
STRETCH = 64
#: UTF-8 bytes of benchmark text that one broadcast covers; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
#: Bytes of compiled patterns that one broadcast has at most; what compiles to more is halved.
COMPILED_BYTES = 128 << 20
#: A shift table has about eight places for each block of words, and bits from and to these.
_LEAST_BITS, _MOST_BITS = 16, 26


@dataclass
class Patterns:
    """The distinct windows of one length."""

    length: int
    shift: np.ndarray  # by the low bits of a block's hash
    suffix: np.ndarray  # sorted hashes of last blocks
    first: np.ndarray  # first word of each pattern, in the order of suffix
    words: np.ndarray  # hashes of the items' words
    text: bytes  # the items' words, with spaces between
    at: np.ndarray  # where a word begins in text, and one place behind the last
    item: list[str]
    items: np.ndarray  # numbers of items, a pattern's after another's
    items_at: np.ndarray

    @property
    def block(self) -> int:
        return min(2, self.length)

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.shift, self.suffix, self.first, self.words, self.at, self.items, self.items_at)) + len(self.text) + sum(map(len, self.item))

    def string(self, k: int) -> bytes:
        return self.text[self.at[self.first[k]] : self.at[self.first[k] + self.length] - 1]

    def ids(self, k: int) -> list[str]:
        return [self.item[i] for i in self.items[self.items_at[k] : self.items_at[k + 1]]]

    def places(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks & np.uint64(len(self.shift) - 1)).astype(np.int64)


def _block(words: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words up to end."""
    out = words[end] * bw._PLACE[1]
    return bw.mix(out + words[end - 1] * bw._PLACE[0] if size == 2 else out)


def compile_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """(item id, text) to the patterns of each length."""
    by_size: dict[int, list] = {}
    for item, text in items:
        data = bw.lower(np.frombuffer((text or "").encode(), dtype=np.uint8))
        starts, ends, _ = bw.spans(data, np.array([0, len(data)]), bw.ALNUM)
        if len(starts):
            raw = data.tobytes()
            by_size.setdefault(min(window, len(starts)), []).append((item, [raw[s:e] for s, e in zip(starts, ends)], bw.span_hashes(data, starts, ends)))
    out = []
    for size, found in sorted(by_size.items()):
        words = np.concatenate([h for _, _, h in found])
        text = b" ".join(w for _, ws, _ in found for w in ws) + b" "
        at = np.concatenate([[0], np.cumsum([len(w) + 1 for _, ws, _ in found for w in ws])])
        ids = sorted({i for i, _, _ in found if i is not None})
        number = {i: k for k, i in enumerate(ids)}
        by_text: dict[bytes, tuple[int, set[int]]] = {}
        begin = 0
        for item, ws, _ in found:
            for k in range(begin, begin + len(ws) - size + 1):
                own = by_text.setdefault(text[at[k] : at[k + size] - 1], (k, set()))[1]
                if item is not None:
                    own.add(number[item])
            begin += len(ws)
        first = np.array([k for k, _ in by_text.values()], np.int64)
        lists = [sorted(x) for _, x in by_text.values()]
        block = min(2, size)
        bits = min(_MOST_BITS, max(_LEAST_BITS, (8 * size * len(first)).bit_length()))
        shift = np.full(1 << bits, size - block + 1, dtype=np.uint8 if size < 256 else np.int64)
        for j in range(block - 1, size):
            np.minimum.at(shift, (_block(words, first + j, block) & np.uint64(len(shift) - 1)).astype(np.int64), size - 1 - j)
        suffix = _block(words, first + size - 1, block)
        order = np.argsort(suffix, kind="stable")
        lists = [lists[k] for k in order]
        items_ = np.array([i for x in lists for i in x], np.int32)
        out.append(Patterns(size, shift, suffix[order], first[order], words, text, at, ids, items_, np.cumsum([0, *map(len, lists)])))
    return out


def occurrences(p: Patterns, words: np.ndarray, first: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last words of the occurrences, and the pattern of each."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Stretches: window ends from lo to hi (exclusive), STRETCH at most, all within a row.
    lo, hi = first[:-1] + p.length - 1, first[1:]
    long = hi > lo
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return none
    n = -(-(hi - lo) // STRETCH)
    row = np.repeat(np.arange(len(lo)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = lo[row] + k * STRETCH
    stop = np.minimum(at + STRETCH, hi[row])
    zero = []
    while len(at):
        move = p.shift[p.places(_block(words, at, p.block))]
        zero.append(at[move == 0])
        at = at + np.maximum(move, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    at = np.concatenate(zero)
    key = _block(words, at, p.block)
    left, right = np.searchsorted(p.suffix, key, "left"), np.searchsorted(p.suffix, key, "right")
    n = right - left
    at, left = np.repeat(at, n), np.repeat(left, n)
    which = left + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    good = np.ones(len(at), dtype=bool)
    for j in range(p.length):  # most candidates end here, those left are compared as text
        good &= words[at - p.length + 1 + j] == p.words[p.first[which] + j]
    at, which = at[good], which[good]
    same = np.fromiter((p.string(w) == b" ".join(data[s:e] for s, e in zip(starts[a - p.length + 1 : a + 1], ends[a - p.length + 1 : a + 1])) for a, w in zip(at, which)), dtype=bool, count=len(at))
    return at[same], which[same]


def _search(column: pa.Array, patterns: list[Patterns]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """For each row: number of words, hit words (as their numbers) and matched items."""
    n_words, hits, items = np.zeros(len(column), np.int64), [], []
    for a, b, data, at in bw.chunks(column):
        data = bw.lower(data)
        starts, ends, first = bw.spans(data, at, bw.ALNUM)
        words, raw = bw.span_hashes(data, starts, ends), data.tobytes()
        n_words[a:b] = np.diff(first)
        steps = np.zeros(len(words) + 1, dtype=np.int64)
        found: list[set[str]] = [set() for _ in range(a, b)]
        for p in patterns:
            where, which = occurrences(p, words, first, raw, starts, ends)
            np.add.at(steps, where - p.length + 1, 1)
            np.add.at(steps, where + 1, -1)
            for r, w in set(zip(np.searchsorted(first, where, side="right") - 1, which)):
                found[r].update(p.ids(w))
        hit = np.cumsum(steps[:-1]) > 0
        hits += [np.flatnonzero(hit[first[r] : first[r + 1]]) for r in range(b - a)]
        items += found
    return n_words, hits, items


def _compiled(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[list[Patterns]]:
    """Patterns of the benchmark, a piece of checked size after another."""
    b = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    size = b.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n):
        own = b if n == 1 else b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        left = [[tuple(r) for r in own.collect()]]  # about BLOCK_BYTES
        while left:
            rows = left.pop()
            made = compile_patterns(rows, window)
            if sum(p.size for p in made) > COMPILED_BYTES and len(rows) > 1:
                left += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
            else:
                yield made


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """documents with n_words, n_hit, items (sorted ids of the benchmark items with occurring windows) and contaminated."""
    spark, shown = documents.sparkSession, ["n_words", "n_hit", "items", "contaminated"]
    passes = _compiled(benchmark, item, item_text, window)
    one, more = next(passes), next(passes, None)
    if more is None:
        shared = spark.sparkContext.broadcast(one)

        def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            n, hits, items = _search(batch.column(text), shared.value)
            n_hit = np.array([len(x) for x in hits], np.int64)
            return {"n_words": pa.array(n), "n_hit": pa.array(n_hit), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "contaminated": pa.array(n_hit > 0)}

        return appended(documents, make, "n_words long, n_hit long, items array<string>, contaminated boolean")
    # By the text, whose hashes stand for it: what a pass finds is all that stays of it.
    key = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    texts, found = documents.select(F.col(text).alias("text"), key[0].alias("k0"), key[1].alias("k1")), None
    for patterns in itertools.chain([one, more], passes):
        shared = spark.sparkContext.broadcast(patterns)

        def hit(batches, shared=shared):
            for batch in batches:
                _, hits, items = _search(batch.column(0), shared.value)
                own = [k for k, x in enumerate(hits) if len(x)]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(own, pa.int64())), batch.column(2).take(pa.array(own, pa.int64())), pa.array([hits[k] for k in own], pa.list_(pa.int64())), pa.array([sorted(items[k]) for k in own], pa.list_(pa.string()))], names=["k0", "k1", "hits", "items"])

        bounded_batches(spark)
        part = written(texts.mapInArrow(hit, "k0 long, k1 long, hits array<long>, items array<string>").dropDuplicates(["k0", "k1"]), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("k0", "k1").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.toDF("__k0", "__k1", "__n_hit", "__items")
    counted = appended(documents, lambda batch: {"n_words": pa.array(_search(batch.column(text), [])[0])}, "n_words long")
    out = counted.join(found, (key[0] == F.col("__k0")) & (key[1] == F.col("__k1")), "left")
    keep = without(documents, shown)
    return out.select(*quoted(keep), "n_words", F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"), F.col("__n_hit").isNotNull().alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    d, own = shielded(docs, ["n_words", "n_hit", "items", "contaminated"])
    return own(contamination(d, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), p AS (SELECT item_id, least({WINDOW}, len(w)) AS n, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS k, w FROM i WHERE len(w) > 0),
 pat AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[k + 1 : k + n], ' ') AS x FROM p),
 dw AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS k, w FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n),
 hit AS (SELECT r, k, dw.n, item FROM dw JOIN pat ON pat.n = dw.n AND pat.x = array_to_string(w[k + 1 : k + dw.n], ' ')),
 words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY r),
 items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL = {"op6_decontaminate": _SQL}
