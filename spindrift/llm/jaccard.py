"""N-gram Jaccard join by vertical partitioning, and the groups it links.

A document's n-grams are 64-bit hashes of five words.  The global order of n-grams is cut
into fragments, and a document into the segments that fall into them; fragments are worked
on separately, and what they count is summed per document or per pair.

1. Screen.  A document that links with another set has at least 3/4 of its n-grams in some
   other document.  Fragments over the first part of the order count each document's n-grams
   that nobody else has; with more than 1/4 of its set alone, it can't link.
2. Order.  For the classes of equal sets that are left, fragments count document frequencies.
   In the order of rising frequency, linking sets share an n-gram among their first
   n - ceil(3n/4) + 1 ones, and those of frequency one are no use: the rest are its keys.
3. Candidates.  The documents of a key are compared with one of them, its pivot, and not all
   with all.  Those linked to it are one group, so pairs among them need no look.  Where other
   documents are left, these are compared with all of the key's, in blocks: a task gets two
   blocks and gives the groups that they join, not pairs.
4. Counting.  For each pair, fragments count common n-grams; the sums decide exactly.

Copies of a set are one class throughout.  Documents without words have no n-grams and link
with nothing; null texts are empty, an empty table has no rows.  Repeated rows are copies.  A null
doc_id is no candidate for a component's id.  Texts count whole, however long.  Other columns are not
read, whatever their names.  Hashes of 64 bits stand for n-grams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bytewords as bw
from spindrift.llm.common import bounded_batches, drop, shared_dir, table, written
from spindrift.llm.common import fragments as fragments_of
from spindrift.llm.graph import components

WORDS = 5
#: A link: DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Bytes of text for each fragment, about.
FRAGMENT_BYTES = 128 << 20
#: The part of the order that the screen looks at.
SCREEN = 0.4
#: Fragments in which pairs are counted, and members of a pivot that one task takes.
VERTICAL = 4
MEMBERS = 512
#: Documents of a block, and n-grams that two blocks are compared on at a time.
BLOCK = 256
COLUMNS = 4096


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, one row after another, and offsets."""
    values, counts = [], [np.zeros(1, np.int64)]
    for a, b, data, at in bw.chunks(column):
        data = bw.lower(data)
        starts, ends, first = bw.spans(data, at, bw.NOT_SPACE)
        grams, row = bw.sequences(bw.span_hashes(data, starts, ends), first, WORDS)
        v, edges = bw.distinct(grams, row, b - a)
        values.append(v)
        counts.append(np.diff(edges))
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _cut(values: np.ndarray, edges: np.ndarray, fragments: int, of: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fragment, counts for each row, values): the rows' segments in the first fragments of the order."""
    rows = len(edges) - 1
    row = np.repeat(np.arange(rows), np.diff(edges))
    high = (values >> np.uint64(32)).astype(np.float64) / 2.0**32
    f = np.floor(high * (fragments / of)).astype(np.int64)
    keep = f < fragments
    f, row, values = f[keep], row[keep], values[keep]
    order = np.argsort(f, kind="stable")  # rows and values stay in order within a fragment
    f, row, values = f[order], row[order], values[order]
    at = np.searchsorted(f, np.arange(fragments + 1))
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), np.bincount(row[at[k] : at[k + 1]], minlength=rows), values[at[k] : at[k + 1]]


def _numbered() -> Iterator[int]:
    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


_SCAN = "batch long, idx int, doc_id long, th long, n long, s0 long, s1 long, fragment int, counts binary, grams binary"


def _scan(documents: DataFrame, fragments: int) -> DataFrame:
    """A row for each document with its size and signature, and its segments for the screen, packed by batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered()
        for batch in batches:
            values, edges = _sets(batch.column(1))
            rows, no = len(edges) - 1, next(number)
            mixed = bw.mix(values + np.uint64(1))
            s0, s1 = _sums(mixed, edges), _sums(bw.mix(mixed ^ np.uint64(0xA5A5A5A5)), edges)
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, no)), pa.array(np.arange(rows, dtype=np.int32)), batch.column(0).cast(pa.int64()), batch.column(2), pa.array(np.diff(edges)),
                    pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), none(rows, pa.int32()), none(rows, pa.binary()), none(rows, pa.binary()),
                ],
                names=names,
            )
            cut = list(_cut(values, edges, fragments, SCREEN))
            n = len(cut)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, no)), *(none(n, t) for t in (pa.int32(), *[pa.int64()] * 5)), pa.array([k for k, _, _ in cut], pa.int32()),
                    pa.array([c.astype("<u4").tobytes() for _, c, _ in cut], pa.binary()), pa.array([v.astype("<u4").tobytes() for _, _, v in cut], pa.binary()),
                ],
                names=names,
            )

    names = [x.split()[0] for x in _SCAN.split(", ")]
    return documents.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, _SCAN)


def _binaries(t: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in t.column(column)]


def _frequencies(t: pa.Table, kind: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Counts by row of each packed segment, how often each value occurs in the fragment, and the segments' offsets."""
    counts, grams = _binaries(t, "counts", "<u4"), _binaries(t, "grams", kind)
    values = np.concatenate(grams)
    order = np.argsort(values)
    v = values[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    group = np.cumsum(new) - 1
    df = np.empty(len(v), np.int64)
    df[order] = np.bincount(group)[group]
    return counts, df, np.cumsum([0, *map(len, grams)])


def _alone(t: pa.Table) -> pa.Table:
    """For each batch, how many of each row's n-grams in this fragment no other row has."""
    counts, df, at = _frequencies(t, "<u4")
    out = []
    for k, c in enumerate(counts):
        alone = (df[at[k] : at[k + 1]] == 1).astype(np.int64)
        out.append(_sums(alone, np.concatenate([[0], np.cumsum(c.astype(np.int64))])).astype("<u4").tobytes())
    return pa.table({"batch": t.column("batch"), "alone": pa.array(out, pa.binary())})


def _alone_sums(t: pa.Table) -> pa.Table:
    total = np.sum(_binaries(t, "alone", "<u4"), axis=0, dtype=np.int64)
    return pa.table({"batch": pa.array(np.full(len(total), t.column("batch")[0].as_py())), "idx": pa.array(np.arange(len(total), dtype=np.int32)), "alone": pa.array(total)})


def _survivors(scan: DataFrame) -> DataFrame:
    """The documents with words whose n-grams alone do not rule out a link."""
    pieces = scan.filter("fragment IS NOT NULL").select("batch", "fragment", "counts", "grams")
    alone = pieces.groupBy("fragment").applyInArrow(_alone, "batch long, alone binary").groupBy("batch").applyInArrow(_alone_sums, "batch long, idx int, alone long")
    docs = scan.filter("fragment IS NULL AND n > 0").select("batch", "idx", "doc_id", "th", "n", "s0", "s1")
    return docs.join(alone, ["batch", "idx"], "left").filter(f"{DEN} * (n - coalesce(alone, 0)) >= {NUM} * n").drop("batch", "idx", "alone")


def _packed(texts: DataFrame, fragments: int) -> DataFrame:
    """(c, text) to packed sets of each batch (fragment null) and their segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered()
        for batch in batches:
            values, edges = _sets(batch.column(1))
            no = next(number)
            cut = [(None, np.diff(edges), values), *_cut(values, edges, fragments, 1.0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cut), no)), pa.array([k for k, _, _ in cut], pa.int32()),
                    pa.array([np.asarray(batch.column(0)).astype("<i8").tobytes(), *[None] * (len(cut) - 1)], pa.binary()),
                    pa.array([c.astype("<u4").tobytes() for _, c, _ in cut], pa.binary()), pa.array([v.astype("<u8").tobytes() for _, _, v in cut], pa.binary()),
                ],
                names=["batch", "fragment", "cs", "counts", "grams"],
            )

    return texts.mapInArrow(run, "batch long, fragment int, cs binary, counts binary, grams binary")


def _coded(t: pa.Table) -> pa.Table:
    """Codes of the document frequencies of each segment's values in their order: up to 16 as they are, above that eight to an octave."""
    _, df, at = _frequencies(t, "<u8")
    code = np.where(df <= 16, df, 16 + (8 * np.log2(df / 16)).astype(np.int64)).clip(max=255).astype(np.uint8)
    return pa.table({"batch": t.column("batch"), "fragment": t.column("fragment"), "cs": pa.nulls(len(t), pa.binary()), "counts": t.column("counts"), "grams": pa.array([code[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})


def _ordered(t: pa.Table) -> pa.Table:
    """A batch's documents that can still link: size, segments of the set, the keys among its first n-grams, and n-grams from each key on."""
    fragment = t.column("fragment").to_pylist()
    whole = fragment.index(None)
    counts, grams = _binaries(t, "counts", "<u4"), [x.as_buffer() for x in t.column("grams")]
    cs, values = np.frombuffer(t.column("cs")[whole].as_buffer(), "<i8"), np.frombuffer(grams[whole], "<u8")
    sizes = counts[whole].astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    # A document's values are sorted, and fragments are ranges: its codes follow one another by fragment.
    df = np.zeros(len(values), np.int64)
    place = edges[:-1].copy()
    for k in sorted((k for k, f in enumerate(fragment) if f is not None), key=lambda k: fragment[k]):
        c = counts[k].astype(np.int64)
        code = np.frombuffer(grams[k], np.uint8)
        df[np.repeat(place, c) + np.arange(len(code)) - np.repeat(np.cumsum(c) - c, c)] = code
        place += c
    out = {"c": [], "n": [], "segments": [], "keys": [], "rest": []}
    bounds = (np.arange(1, VERTICAL, dtype=np.uint64) << np.uint64(62)) if VERTICAL == 4 else np.linspace(0, 2**64, VERTICAL + 1)[1:-1].astype(np.uint64)
    for k, n in enumerate(sizes.tolist()):
        v, d = values[edges[k] : edges[k + 1]], df[edges[k] : edges[k + 1]]
        alone = int((d == 1).sum())
        first = n - -(-NUM * n // DEN) + 1 - alone
        if first <= 0 or not n:
            continue
        shared = np.flatnonzero(d > 1)
        at = [0, *np.searchsorted(v, bounds), n]
        out["c"].append(cs[k])
        out["n"].append(n)
        out["segments"].append([v[a:b].tobytes() for a, b in zip(at, at[1:])])
        keys = v[shared[np.lexsort((v[shared], d[shared]))[:first]]].view(np.int64)
        out["keys"].append(keys)
        out["rest"].append(n - alone - np.arange(len(keys)))
    return pa.table({"c": pa.array(out["c"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "segments": pa.array(out["segments"], pa.list_(pa.binary())), "keys": pa.array(out["keys"], pa.list_(pa.int64())), "rest": pa.array(out["rest"], pa.list_(pa.int64()))})


def _common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, v, role, b, segment), sorted: a pivot's segment before those of its members."""
    at, pivot = None, None
    for batch in batches:
        a, salt, v, role, b = (np.asarray(batch.column(k)) for k in range(5))
        segments = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(5)]
        out_a, out_b, out = [], [], []
        edges = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(salt) != 0) | (np.diff(v) != 0)) + 1), len(a)]
        for lo, hi in zip(edges, edges[1:]):
            key = (a[lo], salt[lo], v[lo])
            if key != at:
                at, pivot = key, segments[lo]
            own = [k for k in range(lo, hi) if role[k]]
            if not own:
                continue
            values = np.concatenate([segments[k] for k in own])
            if len(pivot) and len(values):
                found = pivot[np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)] == values
            else:
                found = np.zeros(len(values), bool)
            out.append(_sums(found.astype(np.int64), np.cumsum([0, *(len(segments[k]) for k in own)])))
            out_a.append(a[own])
            out_b.append(b[own])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out)], names=["a", "b", "common"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  sets: c, n, segments."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("k"))
    salted = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).alias("salt")).checkpoint()
    heads = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("c"))
    members = salted.join(sets, F.col("b") == F.col("c"))
    cut = lambda df, role, b: df.select("a", "salt", F.lit(role).alias("role"), b.alias("b"), F.posexplode("segments").alias("v", "segment"))
    rows = cut(heads, 0, F.lit(0).cast("long")).unionByName(cut(members, 1, F.col("b"))).select("a", "salt", "v", "role", "b", "segment")
    rows = rows.repartition("a", "salt", "v").sortWithinPartitions("a", "salt", "v", "role")
    common = rows.mapInArrow(_common, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    na, nb = (sets.select(F.col("c").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    return common.join(na, "a").join(nb, "b").filter(f"{DEN} * common >= {NUM} * (na + nb - common)").select("a", "b")


#: Sizes up to which a document can link at a key, if that is the first n-gram in common: what follows must be enough.
_REACH = f"floor({NUM + DEN} * r / {NUM}D) - n"


def _hopeful(rows: DataFrame) -> DataFrame:
    """Rows (g, c, n, r) that may have a partner at their key.

    Of two that link the smaller one reaches its own size, and the larger one reaches the smaller.
    """
    rows = rows.withColumn("reach", F.expr(_REACH))
    least = rows.filter("reach >= n").groupBy("g").agg(F.min("n").alias("least")).checkpoint()  # on its own, so that a large key's rows can be split in the join
    return rows.join(least, "g").filter("reach >= least").drop("least")


def _block_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, kind, i, j, role, label, n, segments), sorted by the first four, to labels (u, v) that link.

    A block of role 0 is compared with the one of role 1, or with itself if there is none.
    """

    def links(rows: list[tuple]) -> pa.RecordBatch:
        role, label, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        left = np.flatnonzero(role == 0)
        right = np.flatnonzero(role == 1) if (role == 1).any() else left
        common = np.zeros((len(left), len(right)), np.float32)
        for v in range(VERTICAL):
            parts = [np.frombuffer(r[3][v], "<u8") for r in rows]
            doc = np.repeat(np.arange(len(rows)), [len(x) for x in parts])
            _, column, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            shared = np.cumsum(many > 1) - 1
            keep = many[column] > 1
            doc, column = doc[keep], shared[column[keep]]
            for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
                here = (column >= at) & (column < at + COLUMNS)
                x = np.zeros((len(rows), COLUMNS), np.float32)
                x[doc[here], column[here] - at] = 1
                common += x[left] @ x[right].T
        good = DEN * common >= NUM * (n[left][:, None] + n[right][None, :] - common)
        good &= label[left][:, None] != label[right][None, :]
        x, y = np.nonzero(good)
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while root.get(k, k) != k:
                root[k] = k = root.get(root[k], root[k])
            return k

        out = []
        for u, v in sorted(set(zip(label[left][x].tolist(), label[right][y].tolist()))):
            if (a := find(u)) != (b := find(v)):
                root[max(a, b)] = min(a, b)
                out.append((u, v))
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

    at, rows = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(8)]
        for g, kind, i, j, role, label, n, segments in zip(*cols):
            if (g, kind, i, j) != at:
                if len(rows) > 1:
                    yield links(rows)
                at, rows = (g, kind, i, j), []
            rows.append((role, label, n, segments))
    if len(rows) > 1:
        yield links(rows)


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    return labels.join(roots.withColumnRenamed("v", "label"), "label", "left").select("c", F.coalesce("root", "label").alias("label")).checkpoint()


def link_classes(sets: DataFrame) -> DataFrame:
    """(c, label): classes of sets that link, directly or not, have the same label.  sets: c, n, segments, keys, rest."""
    keys = sets.select("c", "n", F.explode(F.arrays_zip("keys", "rest")).alias("x")).select("c", "n", F.col("x.keys").alias("g"), F.col("x.rest").alias("r")).distinct()
    # Keys of the same documents do the same work: they become one, in the place of the first.
    of = keys.groupBy("g").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("c")).alias("x"), F.sum(F.xxhash64("c", F.lit(1)) % (1 << 40)).alias("y")).filter("m > 1")
    same = of.groupBy("m", "x", "y").agg(F.min("g").alias("first"))
    keys = keys.join(of.join(same, ["m", "x", "y"]).select("g", "first"), "g").groupBy(F.col("first").alias("g"), "c", "n").agg(F.max("r").alias("r"))
    keys = written(keys, "keys")
    rows = written(_hopeful(keys), "hopeful")
    drop(sets.sparkSession, keys)
    labels = sets.select("c", F.col("c").alias("label")).distinct()

    # Each key's documents against its pivot, the one with the fewest rare n-grams.
    pivot = rows.groupBy("g").agg(F.min(F.struct(((F.col("n") - F.col("r")) / F.col("n")).alias("rare"), "c", "n", "reach")).alias("p")).checkpoint()
    near = rows.join(pivot.select("g", "p.*").withColumnsRenamed({"c": "p_c", "n": "p_n", "reach": "p_reach"}), "g")
    pairs = near.filter(f"c <> p_c AND {DEN} * least(n, p_n) >= {NUM} * greatest(n, p_n) AND reach >= p_n AND p_reach >= n").select(F.col("p_c").alias("a"), F.col("c").alias("b")).distinct().checkpoint()
    labels = _relabelled(labels, linked(pairs, sets).select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Where a key has several groups left, the documents outside the largest one against all, in blocks.
    now = rows.join(labels, "c")
    groups = now.groupBy("g", "label").agg(F.count("*").alias("m"))
    state = groups.groupBy("g").agg(F.sum("m").alias("all"), F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    blocks = lambda m: f"cast(ceil(({m}) / {BLOCK}D) as int)"
    state = state.select("g", F.col("top.label").alias("major"), F.expr(blocks("top.m")).alias("kc"), F.expr(blocks("all - top.m")).alias("ku")).checkpoint()
    now = now.join(state, "g").withColumn("own", F.expr("label = major")).withColumn("at", F.expr("cast(pmod(xxhash64(c, 7), IF(own, kc, ku)) as int)"))
    task = "named_struct('kind', {kind}, 'i', {i}, 'j', {j}, 'role', {role})"
    major = f"transform(sequence(0, ku - 1), x -> {task.format(kind=0, i='x', j='at', role=1)})"
    minor = f"transform(sequence(0, kc - 1), x -> {task.format(kind=0, i='at', j='x', role=0)})"
    among = f"transform(sequence(0, ku - 1), x -> {task.format(kind=1, i='least(at, x)', j='greatest(at, x)', role='IF(at <= x, 0, 1)')})"
    sent = now.select("g", "c", "label", F.expr(f"explode(IF(own, {major}, concat({minor}, {among})))").alias("t")).select("g", "t.*", "c", "label")
    cut = sent.join(sets.select("c", "n", "segments"), "c").select("g", "kind", "i", "j", "role", "label", "n", "segments")
    cut = cut.repartition("g", "kind", "i", "j").sortWithinPartitions("g", "kind", "i", "j")
    labels = _relabelled(labels, cut.mapInArrow(_block_links, "u long, v long"))
    drop(sets.sparkSession, rows)
    return labels


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, th (hash of its text), n_shingles, component_id (the least doc_id of its group) and keeper.

    keeper: whether (doc_id, th) is the one of its group that stays (the least).
    """
    spark = documents.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    fragments = fragments_of(documents, FRAGMENT_BYTES)
    scan = written(_scan(documents, fragments), "scan")
    survivors = written(_survivors(scan), "survivors")
    classes = survivors.groupBy("n", "s0", "s1").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    drop(spark, survivors)
    reps = classes.select("c", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th"))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    texts = d.join(reps.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))).select("c", "text")
    packed = written(_packed(texts, fragments), "sets")
    coded = packed.filter("fragment IS NOT NULL").groupBy("fragment").applyInArrow(_coded, packed.schema)
    both = packed.filter("fragment IS NULL").unionByName(coded)
    sets = written(both.groupBy("batch").applyInArrow(_ordered, "c long, n long, segments array<binary>, keys array<long>, rest array<long>").dropDuplicates(["c"]), "ordered")
    drop(spark, packed)
    labels = link_classes(sets)
    drop(spark, sets)
    groups = classes.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    best = groups.groupBy("label").agg(F.min("least").alias("component"), F.min("rep").alias("keeper")).checkpoint()
    groups = written(groups.join(best, "label").select("n", "s0", "s1", "component", "keeper"), "groups")
    drop(spark, classes)
    docs = scan.filter("fragment IS NULL").select("doc_id", "th", "n", "s0", "s1")
    out = docs.join(groups, ["n", "s0", "s1"], "left")
    own = F.col("keeper").isNull() | F.struct("doc_id", "th").eqNullSafe(F.col("keeper"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), own.alias("keeper"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least doc_id, and one row of it."""
    found = written(near_duplicates(docs).withColumnsRenamed({"doc_id": "__f_id", "th": "__f_th"}), "groups")
    th = F.xxhash64("text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__f_id")) & (th == F.col("__f_th"))
    kept = docs.join(found.filter("NOT keeper").select("__f_id", "__f_th").distinct(), same, "left_anti")
    again = found.filter("keeper AND n_shingles > 0").groupBy("__f_id", "__f_th").agg(F.count("*").alias("m")).filter("m > 1").select("__f_id", "__f_th")
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").withColumn("__th", th).dropDuplicates(["doc_id", "__th"]).drop("__th")
    return kept.join(again, same, "left_anti").unionByName(once)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_GRAMS = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END"
_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), s AS (SELECT r, unnest(list_distinct({_GRAMS})) AS g FROM d),
 n AS (SELECT r, count(*) AS n FROM s GROUP BY r), p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 reach AS (SELECT r, r AS c FROM d UNION SELECT reach.r, b FROM reach JOIN both_ways ON a = c), low AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = c GROUP BY reach.r)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN low USING (r)"""
QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE_SQL = {"op3_ngram_join": _SQL}
