"""WARC archives as a Python data source, ``format("warc")``.

Reading plans a partition for each stretch of a file (a file is cut where its manifest names
record boundaries; archives of other makers are one partition a file).  A reader inflates a
record's headers first.  Pushed predicates on the record type and on headers are tested on
them, and a record that fails, or whose payload nobody asked for, is skipped by the length
its gzip member states; only members that state none are inflated to find their end.

Writing gives each task a file with a name of its own.  Each write adds a manifest at commit that
names the files of the tasks that counted, so files of lost or repeated attempts are not read, and
what earlier writes left stays.

Payloads equal in digest and length: the record with the largest id is the response, the
others are revisits without payload.  Digests are grouped without their payloads.  Those that occur
more than once are broadcast if they are at most BROADCAST; of more, the ones that fill a
thousandth of all rows or more (there can't be over a thousand) are, and the rest is joined.

Null payloads are empty, a null id is smaller than any other, rows with the same id and payload are
all responses, repeated rows give a record each.  A payload is held whole by one task, however long.
Line ends in header values are percent-encoded.  Other columns of pages are not written, whatever
their names; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from spindrift.llm.common import bounded_batches, scratch, table, written

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
_HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Start of the manifests' names.
MANIFEST = "_manifest"
#: Compressed bytes of one partition of a file.
SPLIT = 32 << 20
#: Digests that one broadcast has at most, of about 100 bytes each; and the share of all rows that makes a digest hot.
BROADCAST, HOT = 200_000, 1000
_READ = 64 << 10


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def member(head: bytes, block: bytes) -> bytes:
    """A gzip member whose extra field "sl" has its compressed and its plain length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(head) + c.compress(block) + c.flush()
    plain = len(head) + len(block)
    size = 10 + 2 + 12 + len(body) + 8
    crc = zlib.crc32(block, zlib.crc32(head))
    if max(size, plain) >= 1 << 32:
        return struct.pack("<BBBBIBB", 31, 139, 8, 0, 0, 0, 255) + body + struct.pack("<II", crc, plain & 0xFFFFFFFF)
    return struct.pack("<BBBBIBB", 31, 139, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size, plain) + body + struct.pack("<II", crc, plain)


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, payload: bytes, size: int, refers_to: str | None) -> bytes:
    """One WARC record with an HTTP response as its block; a revisit has only its head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean(uri)}"] if uri is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return member(("\r\n".join(lines) + "\r\n\r\n").encode(), block + b"\r\n\r\n")


@dataclass
class Files(WriterCommitMessage):
    name: str | None
    splits: list[int]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name, out, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        for batch in iterator:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            for r in batch.to_pylist():
                data = record(r["record_type"], r["record_id"], r["target_uri"], r["date"], r["payload_digest"], r["payload"] or b"", r["payload_bytes"], r["refers_to"])
                if at - splits[-1] >= self.split:
                    splits.append(at)
                out.write(data)
                at += len(data)
        if out:
            out.close()
        return Files(name if out else None, [*splits, at])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({m.name: m.splits for m in messages if m and m.name}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int | None


class _Window:
    """A file read forward, with seeks over what is skipped."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""

    def need(self, n: int) -> bytes:
        """At least n bytes from here on, or all there are."""
        if len(self.data) < n:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(n - len(self.data), _READ))
        return self.data

    def skip(self, n: int) -> None:
        self.at += n
        self.data = self.data[n:]


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(file, start: int, end: int | None, wanted, payload: bool) -> Iterator[Record]:
    """Records of gzip members or of plain text from start to end.  wanted(headers): whether to give the record."""
    w = _Window(file, start)
    inside = False  # a gzip member that has more records
    while (end is None or w.at < end) and w.need(2):
        if not inside:
            zipped = w.data[:2] == b"\x1f\x8b"
            size = None
            if zipped:
                flags, skip = w.need(12)[3], 10
                if flags & 4:
                    extra = struct.unpack_from("<H", w.data, 10)[0]
                    x, skip = w.need(12 + extra)[12 : 12 + extra], 12 + extra
                    while len(x) >= 4:
                        tag, n = struct.unpack_from("<2sH", x)
                        if tag == b"sl" and n == 8:
                            size = struct.unpack_from("<I", x, 4)[0]
                        x = x[4 + n :]
                inflate = zlib.decompressobj(31)
                plain, used = b"", 0

                def more() -> bool:
                    nonlocal plain, used
                    chunk = w.need(used + 4096)[used : used + 4096]
                    if not chunk or inflate.eof:
                        return False
                    plain += inflate.decompress(chunk)
                    used += len(chunk) - len(inflate.unused_data)
                    return True
            else:
                plain, used = b"", 0

                def more() -> bool:
                    nonlocal plain, used
                    chunk = w.need(used + 4096)[used : used + 4096]
                    plain += chunk
                    used += len(chunk)
                    return bool(chunk)

        while (stop := plain.find(b"\r\n\r\n")) < 0 and more():
            pass
        if stop < 0:
            if plain.strip():
                raise ValueError(f"no WARC headers at byte {w.at}")
            return
        headers = _fields(plain[:stop].split(b"\r\n")[1:])
        length = int(headers.get("content-length", 0))
        total = stop + 4 + length + 4
        good = wanted(headers)
        if good:
            http_response = headers.get("content-type", "").startswith("application/http")
            r = Record(headers)
            while http_response and b"\r\n\r\n" not in plain[stop + 4 : stop + 4 + length] and len(plain) < stop + 4 + length and more():
                pass
            if http_response:
                top, _, _ = plain[stop + 4 : stop + 4 + length].partition(b"\r\n\r\n")
                r.http = _fields(top.split(b"\r\n")[1:])
            if payload:
                if zipped and not inflate.eof:
                    rest = w.need(size or used)
                    parts, have = [plain], len(plain)
                    while not inflate.eof and (size or have < total):
                        chunk = rest[used : size] if size else w.need(used + _READ)[used : used + _READ]
                        if not chunk:
                            raise ValueError(f"cut off record at byte {w.at}")
                        parts.append(inflate.decompress(chunk))
                        have += len(parts[-1])
                        used += len(chunk) - len(inflate.unused_data)
                    plain = b"".join(parts)
                elif not zipped:
                    plain = w.need(total)[:total]
                block = plain[stop + 4 : stop + 4 + length]
                r.payload = block.partition(b"\r\n\r\n")[2] if http_response else block
            yield r
        if not zipped:
            w.need(0)
            w.at, w.data = (w.at + total, w.data[total:]) if len(w.data) >= total else (w.at + total, b"")
        elif size:
            w.at, w.data = (w.at + size, w.data[size:]) if len(w.data) >= size else (w.at + size, b"")
        else:
            left = total
            while len(plain) < left and more():
                if len(plain) < left:
                    left, plain = left - len(plain), b""
            plain = plain[left:].lstrip()
            while not plain and more():
                plain = plain.lstrip()
            if not (inside := bool(plain)):
                w.skip(used)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower()  # true, false or verify
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADER and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((name, "in", (f.value,)))
            elif name in _HEADER and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in _HEADER and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _fs(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Stretch(root, 0, None)]
        files, manifests = {}, [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith(MANIFEST)]
        for path in manifests:
            with fs.open_input_stream(path) as f:
                files |= json.loads(f.read())
        if manifests:
            return [Stretch(f"{root}/{n}", a, b) for n, s in sorted(files.items()) for a, b in zip(s, s[1:]) if b > a]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [Stretch(x.path, 0, None) for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz")) and x.size]

    @staticmethod
    def value(name: str, headers: dict[str, str]) -> str | None:
        v = headers.get(_HEADER[name])
        if v is None:
            return None
        return v.strip("<>") if name in ("record_id", "refers_to") else v.removeprefix("sha1:") if name == "payload_digest" else v

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, values in self.tests:
            v = self.value(name, headers)
            if v is None or not (v in values if how == "in" else v.startswith(values[0])):
                return False
        return True

    def read(self, partition: Stretch):
        if partition is None:
            return
        fs, _ = _fs(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = {"payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(n, pa.string())) for k, n in enumerate(names)], names=names)
            rows.clear()
            return out

        with fs.open_input_file(partition.path) as f:
            for r in records(f, partition.start, partition.end, self.wanted, self.payload != "false"):
                stated = r.http.get("content-length")
                has = r.payload is not None and r.headers.get("warc-type") != "revisit"
                if self.payload == "verify" and has:
                    digest = base32(hashlib.sha1(r.payload).digest())
                    if digest != self.value("payload_digest", r.headers):
                        raise ValueError(f"payload of {r.headers.get('warc-record-id')} has digest {digest}")
                n = len(r.payload) if has else int(stated) if stated else None
                keep = r.payload if has and self.payload == "true" else None
                rows.append([*(self.value(c, r.headers) for c in _HEADER), n, list(r.headers.items()), keep])
                size += 200 + len(keep or b"")
                if size > 4 << 20:
                    yield batch()
                    size = 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """Options: path; payload, "true" (default), "false" or "verify" (digests are checked, no payload is given)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader({k: self.options[k] for k in ("path", "payload") if k in self.options})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    bounded_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def id_of(urn: str, prefix: str = "urn:x-page:"):
    """The number in a record id, null where there is none."""
    return F.expr(f"try_cast(substr({urn}, {len(prefix) + 1}) as bigint)")


def deduplicated(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records to write: each payload once, with the largest id; payloads under min_bytes always."""
    p = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    several = p.groupBy("sha", "payload_bytes").agg(F.max("id").alias("best"), F.count("*").alias("m")).filter("m > 1")
    several = written(several.withColumnsRenamed({"sha": "b_sha", "payload_bytes": "b_bytes"}), "digests")
    same = (F.col("sha") == F.col("b_sha")) & (F.col("payload_bytes") == F.col("b_bytes"))
    if several.count() <= BROADCAST:
        j = p.join(F.broadcast(several), same, "left")
    else:
        hot = F.col("m") >= F.lit(max(2, -(-pages.count() // HOT)))
        j = p.join(F.broadcast(several.filter(hot)), same, "left")
        others = several.filter(~hot).select(F.col("b_sha").alias("o_sha"), F.col("b_bytes").alias("o_bytes"), F.col("best").alias("o_best"), F.col("m").alias("o_m"))
        # Rows of hot digests have their answer; no key joins them with one another.
        free = F.when(F.col("m").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "target_uri").cast("string")))
        j = j.join(others.hint("shuffle_hash"), (free == F.col("o_sha")) & (F.col("payload_bytes") == F.col("o_bytes")), "left")
        j = j.withColumns({"best": F.coalesce("best", "o_best"), "m": F.coalesce("m", "o_m")})
    j = j.withColumn("best", F.when(F.col("m").isNull(), F.col("id")).otherwise(F.col("best")))
    again = ~F.col("id").eqNullSafe(F.col("best")) & (F.col("payload_bytes") >= min_bytes)
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return j.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("id").alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(again, urn("best")).alias("refers_to"),
        _base32("sha").alias("payload_digest"),
        "payload_bytes",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _base32(hexadecimal: str):
    """Base 32 of 160 bits in hexadecimal: 32 digits of five bits each."""
    quad = lambda k: F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("long")  # noqa: E731  20 bits, four digits
    digit = lambda v, s: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(v, s).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(quad(k), s) for k in range(8) for s in (15, 10, 5, 0)))


def write_warc(pages: DataFrame, path: str, **names) -> None:
    register(pages.sparkSession)
    deduplicated(pages, **names).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "true") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    out = read_warc(spark, path, "verify")
    return out.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31) + 1, 1)"
_DIGITS = " || ".join(f"(SELECT {' || '.join(_DIGIT.format(s=s) for s in (15, 10, 5, 0))} FROM (SELECT CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) AS v))" for k in range(8))
_SQL = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
 SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to, url FROM p"""
QUERIES = {"op2_warc": op2_warc}
ORACLE_SQL = {"op2_warc": _SQL}
