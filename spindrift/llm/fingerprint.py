"""Document fingerprints: invertible Bloom lookup sketches, in SQL functions only.

A text's paragraphs (lines; long ones in pieces, and the first one's start apart) are hashed to
64-bit digests.  The digests are dealt to blocks, a power of two that grows with their number, and
each block is a table of cells in three parts.  A digest goes into one cell of each part: the cell
counts it and keeps the XOR of the digests and of their check hashes.

Peeling takes a digest out of every cell that holds just one, round after round, until nothing is
left.  A block of a fingerprint is built with the least number of cells from which its own digests
peel; one that peels from none of the sizes lists its digests.  So a fingerprint can be compared
with any other one, without the texts: first all blocks of each, added up to one, subtract and peel.
If the versions differ too much for that, they subtract block by block, the finer ones added up to
the coarser ones' number.  A block that doesn't peel is built again, larger, from the digests that
peel from the two fingerprints, and after the last size these digests themselves are compared.
What comes out are the digests in which the versions differ; likeness is Jaccard's.

Null texts are empty; an empty text has no paragraphs, and two of them are alike (1.0).  Repeated
rows and paragraphs give the same fingerprint as one.  Documents of equal id are in the order of their
texts' hashes; a null id comes last; in an empty table there is nothing to fingerprint.  A text's work
is in proportion to its paragraphs (and a sort of them).  Other columns are not read, whatever their
names.  Everything stays in the row: no Python, and one shuffle, which brings a document and the next
one together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import parts, table

#: Digests of one text that a block has at most on average, and the sizes (cells of a third) that it is tried with.
LOAD = 6
THIRDS = (8, 16, 20)
ROUNDS = 24
#: A short first piece of the text, lines, and pieces of long lines, in code units.
PIECE = r"\A[^\n]{1,16}|[^\n]{1,512}"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _mask(h: str, third: int) -> str:
    """SQL for the three cells of a check hash, one in each part, as bits of a long."""
    return "(" + " | ".join(f"shiftleft(1L, cast({third * k} + pmod(shiftright({h}, {20 * k}), {third}L) as int))" for k in range(3)) + ")"


def digests(text: str) -> str:
    """SQL for the distinct (digest k, check hash h) of a text's paragraphs."""
    return f"transform(array_distinct(transform(regexp_extract_all({text}, r'{PIECE}', 0), p -> xxhash64(p))), d -> named_struct('k', d, 'h', xxhash64(d)))"


def blocks(keys: str) -> str:
    """SQL for the number of blocks of so many digests."""
    return f"shiftleft(1, cast(ceil(log2(greatest(1D, size({keys}) / {LOAD}D))) as int))"


_EMPTY = "named_struct('c', 0, 'k', 0L, 'h', 0L)"
_ADD = "named_struct('c', a.c + z.c, 'k', a.k ^ z.k, 'h', a.h ^ z.h)"
_MINUS = "named_struct('c', a.c - z.c, 'k', a.k ^ z.k, 'h', a.h ^ z.h)"


def _bits(third: int) -> str:
    return "array(" + ", ".join(f"{1 << j}L" for j in range(3 * third)) + ")"


def block_cells(keys: str, third: int) -> str:
    """SQL for the cells of a block with these digests."""
    masked = f"transform({keys}, y -> named_struct('k', y.k, 'h', y.h, 'm', {_mask('y.h', third)}))"
    return _let(masked, "o", f"transform({_bits(third)}, w -> aggregate(o, {_EMPTY}, (s, x) -> IF(x.m & w = 0L, s, named_struct('c', s.c + 1, 'k', s.k ^ x.k, 'h', s.h ^ x.h))))")


def peeled(cells: str, third: int) -> str:
    """SQL for the digests (c, 1 or -1, k and h) of a block's cells, or null if peeling stops early."""
    pure = f"transform(array_distinct(filter(s.t, c -> (c.c = 1 OR c.c = -1) AND xxhash64(c.k) = c.h)), c -> named_struct('c', c.c, 'k', c.k, 'h', c.h, 'm', {_mask('c.h', third)}))"
    out = "IF(q.m & w = 0L, a, named_struct('c', a.c - q.c, 'k', a.k ^ q.k, 'h', a.h ^ q.h))"
    step = _let(pure, "u", f"IF(size(u) = 0, named_struct('t', s.t, 'd', s.d, 'on', false), named_struct('t', zip_with(s.t, {_bits(third)}, (c, w) -> aggregate(u, c, (a, q) -> {out})), 'd', concat(s.d, transform(u, q -> named_struct('c', q.c, 'k', q.k, 'h', q.h))), 'on', true))")
    start = f"named_struct('t', {cells}, 'd', filter(array({_EMPTY}), c -> false), 'on', true)"
    done = "IF(forall(s.t, c -> c.c = 0 AND c.k = 0L AND c.h = 0L), s.d, NULL)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> IF(s.on, {step}, s), s -> {done})"


def _block(keys: str) -> str:
    """SQL for a block of a fingerprint: cells of a third (0: a list of digests), and cells."""
    tries = [_let(block_cells("own", third), "made", f"IF(size(own) < 2 OR {peeled('made', third)} IS NOT NULL, named_struct('third', {third}, 'cells', made), NULL)") for third in THIRDS]
    listed = "named_struct('third', 0, 'cells', transform(own, x -> named_struct('c', 1, 'k', x.k, 'h', x.h)))"
    return _let(keys, "own", f"coalesce({', '.join(tries)}, {listed})")


def sketch(keys: str) -> str:
    """SQL for the blocks of a fingerprint of these digests.

    With a mark for each block among them, sorted digests lie block by block between the marks.
    """
    mark = "transform(sequence(0, n - 1), b -> named_struct('b', b, 'g', 0, 'k', 0L, 'h', 0L))"
    dealt = f"sort_array(concat(transform(ks, x -> named_struct('b', cast(x.k & (n - 1) as int), 'g', 1, 'k', x.k, 'h', x.h)), {mark}))"
    at = "filter(transform(row, (x, i) -> IF(x.g = 0, i, -1)), i -> i >= 0)"
    part = "slice(row, marks[b] + 2, IF(b + 1 < n, marks[b + 1], size(row)) - marks[b] - 1)"
    many = _let(dealt, "row", _let(at, "marks", f"transform(sequence(0, n - 1), b -> {_block(part)})"))
    return _let(keys, "ks", _let(blocks("ks"), "n", f"IF(n = 1, array({_block('ks')}), {many})"))


def encoded(blocks_: str) -> str:
    """SQL for a fingerprint as text: a block's third, then each cell's count, digests and check hashes, in hexadecimal; an empty cell is a dash."""
    cell = "IF(c.c = 0, '-', concat(hex(c.c), ':', hex(c.k), ':', hex(c.h), ';'))"
    return f"array_join(transform({blocks_}, t -> concat(hex(t.third), '/', array_join(transform(t.cells, c -> {cell}), ''))), '.')"


def decoded(text: str) -> str:
    """SQL for the blocks of a fingerprint that encoded() has made."""
    number = lambda x: f"cast(conv(nullif({x}, ''), 16, -10) as bigint)"
    cell = f"IF(c = '-', {_EMPTY}, {_let('split(rtrim(";", c), ":")', 'f', f'named_struct("c", cast({number("f[0]")} as int), "k", {number("f[1]")}, "h", {number("f[2]")})')})"
    cells = f"transform(regexp_extract_all(p[1], '-|[^-;]+;', 0), c -> {cell})"
    return f"transform(split({text}, '[.]'), t -> {_let('split(t, "/")', 'p', f'named_struct("third", cast({number("p[0]")} as int), "cells", {cells})')})"


def _added(blocks_: str, b: str, m: str) -> str:
    """SQL for the cells of every m-th block from b on, added up; null if they are not all of the first size."""
    several = f"filter({blocks_}, (t, i) -> pmod(i, {m}) = {b})" if b == "0" and m == "1" else f"transform(sequence({b}, size({blocks_}) - 1, {m}), j -> {blocks_}[j])"
    add = f"aggregate(slice(bs, 2, size(bs)), bs[0].cells, (s, t) -> zip_with(s, t.cells, (a, z) -> {_ADD}))"
    return _let(several, "bs", f"IF(exists(bs, t -> t.third <> {THIRDS[0]}), NULL, {add})")


def _own(blocks_: str, b: str, m: str) -> str:
    """SQL for the digests of every m-th block from b on."""
    sizes = " ".join(f"WHEN {third} THEN {peeled('t.cells', third)}" for third in THIRDS)
    return f"flatten(transform(transform(sequence({b}, size({blocks_}) - 1, {m}), j -> {blocks_}[j]), t -> CASE t.third {sizes} ELSE t.cells END))"


def differing(left: str, right: str) -> str:
    """SQL for the digests in which two fingerprints (their blocks) differ: c is 1 for the left one's own, -1 for the right one's."""
    minus = f"zip_with(l, r, (a, z) -> {_MINUS})"
    apart = lambda x, y, third: _let(x, "l", _let(y, "r", f"IF(l IS NULL OR r IS NULL, NULL, {peeled(minus, third)})"))
    larger = [apart(block_cells("ours", third), block_cells("theirs", third), third) for third in THIRDS[1:]]
    side = lambda a, z, c: f"transform(array_except(transform({a}, y -> named_struct('k', y.k, 'h', y.h)), transform({z}, y -> named_struct('k', y.k, 'h', y.h))), y -> named_struct('c', {c}, 'k', y.k, 'h', y.h))"
    again = f"coalesce({', '.join(larger)}, concat({side('ours', 'theirs', 1)}, {side('theirs', 'ours', -1)}))"
    fine = f"coalesce({apart(_added('lb', 'b', 'm'), _added('rb', 'b', 'm'), THIRDS[0])}, {_let(_own('lb', 'b', 'm'), 'ours', _let(_own('rb', 'b', 'm'), 'theirs', again))})"
    coarse = f"IF(m = 1, NULL, {apart(_added('lb', '0', '1'), _added('rb', '0', '1'), THIRDS[0])})"
    both = f"coalesce({coarse}, flatten(transform(sequence(0, m - 1), b -> {fine})))"
    return _let(left, "lb", _let(right, "rb", _let("least(size(lb), size(rb))", "m", both)))


def compared(df: DataFrame, left: str, right: str, to: str) -> DataFrame:
    """df with the differing digests of two columns of fingerprints' blocks in {to}_diff, and their likeness in to."""
    df = df.withColumn(f"{to}_diff", F.expr(differing(left, right)))
    n = lambda x: f"aggregate({x}, 0, (s, t) -> s + IF(t.third = 0, size(t.cells), aggregate(t.cells, 0, (v, c) -> v + c.c, v -> cast(v div 3 as int))))"
    total, d = f"({n(left)} + {n(right)})", f"size({to}_diff)"
    return df.withColumn(to, F.expr(_let(f"cast({total} as double)", "total", f"IF(total = 0, 1D, (total - {d}) / (total + {d}))")))


def _bucket(bounds: list, kind: str):
    """The number of bounds up to the id, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    k = math.isqrt(len(bounds)) + 1
    lit = lambda xs: "array(" + ", ".join(f"cast({x} as {kind})" for x in xs) + ")"
    coarse = f"size(filter({lit(bounds[::k])}, x -> x <= doc_id))"
    fine = _let(coarse, "g", f"IF(g = 0, 0, (g - 1) * {k} + size(filter(slice({lit(bounds)}, (g - 1) * {k} + 1, {k}), x -> x <= doc_id)))")
    return F.expr(fine)


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id and text with next_text, the text of the next document in descending doc_id; after the last comes the first.

    Documents go to buckets of id ranges; each bucket also gets the first document of the one below.
    """
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    n = 2 * parts(documents.sparkSession)
    bounds = d.agg(F.percentile_approx("doc_id", [k / (n + 1) for k in range(1, n + 1)], 10000)).first()[0]
    d = d.withColumns({"bucket": _bucket(sorted(set(bounds or [])), kind), "h": F.xxhash64("text")})
    firsts = d.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("f")).select("bucket", "f.*").collect()  # a row a bucket
    firsts.sort(key=lambda r: -r.bucket)
    into = [(r.doc_id, r.h, firsts[k - 1].bucket) for k, r in enumerate(firsts)]
    guests = documents.sparkSession.createDataFrame(into, f"g_id {kind}, g_h long, to int")
    ids = [i for i, _, _ in into if i is not None]
    guest = d.filter(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")))
    guest = guest.dropDuplicates(["to"]).select("doc_id", "text", F.col("to").alias("bucket"), "h", F.lit(1).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    both = d.withColumn("guest", F.lit(0)).unionByName(guest).withColumn("next_text", F.lead("text").over(order))
    return both.filter("guest = 0").select("doc_id", "text", "next_text")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"))
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    for c, to in (("text", "own"), ("edited", "ed"), ("next_text", "nx")):
        d = d.withColumn(to, F.expr(sketch(digests(c))))
    d = compared(compared(d.select("doc_id", "n_chars", "edited_sha256", "own", "ed", "nx"), "own", "ed", "near_edited"), "own", "nx", "near_next")
    return d.select("doc_id", "n_chars", "edited_sha256", F.expr(encoded("own")).alias("fingerprint"), F.expr(encoded("ed")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op10_fingerprint": op10_fingerprint}
