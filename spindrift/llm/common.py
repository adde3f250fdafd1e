"""Session helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch that goes to a Python worker; one longer row makes a batch of its own.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only in a session without other machines."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = spark.sparkContext.getCheckpointDir()
    if named is None and found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
        _drop_at_exit(spark, named)
    if found is None:
        spark.sparkContext.setCheckpointDir(named)
    return (named or found).rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)


class _Made(threading.local):
    """A thread's paths in the shared folder that are in use, in the order they were made; each thread's run has its own."""

    def __init__(self):
        self.paths: list[str] = []
        self.last: list[str] = []  # those of the stage before


made = _Made()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends, or before that by drop()."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    made.paths.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables of written(), or paths of scratch(), that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else t._scratch
        if path in made.paths:
            made.paths.remove(path)
        drop_path(spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that long texts do not fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df whose names do not clash with names, upper and lower case being the same."""
    taken = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(names: list[str]) -> list[str]:
    """Names as they stand in a select, dots and backticks included."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def shielded(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns named like names put out of the way, and what gives a result docs' own columns back."""
    taken = {x.lower() for x in names}
    new = [f"__own{k}_{c}" if c.lower() in taken else c for k, c in enumerate(docs.columns)]
    return docs.toDF(*new), lambda out: out.select(*(F.col(q).alias(c) for q, c in zip(quoted(new), docs.columns)))


def appended(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], adds: str) -> DataFrame:
    """df with columns that make derives from each Arrow batch; a column of df with such a name is replaced.

    Rows keep their order and number, there is no shuffle.
    """
    bounded_batches(df.sparkSession)
    more = T.StructType.fromDDL(adds)
    plain = [f"__dot{k}" if "." in c or "`" in c else c for k, c in enumerate(df.columns)]
    back = dict(zip(plain, df.columns))
    df = df.toDF(*plain)
    keep = without(df, more.names)
    schema = T.StructType([f for f in df.schema if f.name in set(keep)] + more.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = make(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [new[n] for n in more.names], names=keep + more.names)

    return df.mapInArrow(run, schema).toDF(*[back[c] for c in keep], *more.names)


def least_hashed(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most n rows, those whose columns have the least hashes.

    Hashes are even, so a cut at four times the share of n leaves few rows to sort, however many there are.
    """
    total, h = df.count(), F.xxhash64(*columns)
    if total > 8 * n:
        few = df.filter(h < int(4 * n / total * 2**64) - 2**63)
        if few.limit(n).count() == n:  # or else many rows are copies of a few
            df = few
    return df.orderBy(h, *columns).limit(n)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fragments(df: DataFrame, each: int) -> int:
    """How many groups to deal df's texts to: as many as shuffle partitions, or more, so that none has more than about so many bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # the plan does not know, and some columns of its guess may be gone
        size = df.agg(F.coalesce(F.sum(sum(F.coalesce(F.octet_length(quoted([f.name])[0]), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType))), F.lit(0))).first()[0]
    # Files are compressed, and a plan does not know how long its texts are among other columns.
    return max(parts(df.sparkSession), 4 * int(size) // each + 1)


def remainder(column: str, m: int):
    """crc32 of the number as text, modulo m."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))
