"""A catalog of categories: versions on disk, an atomic switch between them, and their state."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import geo
from spindrift.operators import postings
from spindrift.operators.partition import bounds, by_cell
from spindrift.plans import meta, planner
from spindrift.plans.request import parse as parse_request
from spindrift.sources import render
from spindrift.sources.schema import SchemaSpec, parse_header
from spindrift.sources.tsv import fetched, located, parse, read_lines

#: Versions of a category that stay on disk.
KEPT = 2
#: Seconds after which a load that has not ended is taken for broken off.
STALE = 6 * 3600


class NotFound(KeyError):
    pass


class NotReady(RuntimeError):
    pass


class Catalog:
    """root: a folder that Spark's file systems reach; places: other roots for some categories.

    A category's folder has a folder for each version and, in _switches, a numbered file for each switch to one;
    the highest number holds.  A file is made only if it does not exist, so a switch is one step on any store, and
    readers in other processes see it at their next get().
    """

    def __init__(self, spark: SparkSession, root: str, places: dict[str, str] | None = None):
        self.spark, self.root, self.places = spark, root.rstrip("/"), places or {}
        self.loaded: dict[str, DataFrame] = {}
        self.versions: dict[str, str] = {}
        self.cached: set[str] = set()
        self.specs: dict[str, SchemaSpec] = {}
        self.state: dict[str, dict] = {}
        self.metas: dict[str, meta.MetaSpec] = {}
        self.lock = threading.Lock()

    def _path(self, name: str) -> str:
        return f"{self.places.get(name, self.root)}/{name}"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read(self, path: str) -> str | None:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Writes a new file; False if there is one."""
        fs, at = self._fs(path)
        try:
            out = fs.create(at, False)
        except Exception:
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def history(self, name: str) -> list[dict]:
        """The switches of a category, the last one last."""
        at = f"{self._path(name)}/_switches"
        return [json.loads(text) for n in self._names(at) if n.endswith(".json") and (text := self._read(f"{at}/{n}"))]

    def current(self, name: str) -> str | None:
        """The version in use."""
        at = f"{self._path(name)}/_switches"
        for n in reversed([n for n in self._names(at) if n.endswith(".json")]):
            if text := self._read(f"{at}/{n}"):  # a file that is being written is empty
                return json.loads(text)["version"]
        return None

    def _switch(self, name: str, version: str) -> None:
        at = f"{self._path(name)}/_switches"
        entry = json.dumps({"version": version, "previous": self.current(name), "at": time.strftime("%Y-%m-%d %H:%M:%S")})
        while True:
            last = [n for n in self._names(at) if n.endswith(".json")]
            if self._create(f"{at}/{int(last[-1][:-5]) + 1 if last else 1:012d}.json", entry):
                return

    def roll_back(self, name: str) -> str:
        """Switches to the version before the one in use."""
        now = self.history(name)
        before = now[-1]["previous"] if now else None
        if before is None or not self._names(f"{self._path(name)}/{before}"):
            raise NotFound(f"{name} has no earlier version")
        self._switch(name, before)
        return before

    def _clean(self, name: str) -> None:
        """Deletes the folders of all versions but the last KEPT ones that were switched to."""
        kept = list(dict.fromkeys(h["version"] for h in reversed(self.history(name))))[:KEPT]
        for n in self._names(self._path(name)):
            if n.startswith("v-") and n not in kept:
                self._delete(f"{self._path(name)}/{n}")

    def load(self, name: str, data: str, header: str, parts: int = 8, on_stage: Callable[[str], None] | None = None, index: bool = True) -> dict:
        """Parses data under the header into a new version, clustered by grid cell, and switches to it.

        data: a path, or a URL that is copied first.  index: also posting lists and their lengths.  One load of a
        category runs at a time, in this process or any.  A failed load leaves the version in use as it is.
        """
        mark = f"{self._path(name)}/_loading"

        def stage(what: str, **more) -> None:
            self.state[name] = {"stage": what, "at": time.strftime("%Y-%m-%d %H:%M:%S"), **more}
            if on_stage:
                on_stage(what)

        with self.lock:
            fs, at = self._fs(mark)
            if fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > STALE:
                fs.delete(at, False)
            if not self._create(mark, ""):
                raise NotReady(f"{name} is being loaded")
        version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        base = f"{self._path(name)}/{version}"
        try:
            more = {}
            if data.startswith(("http://", "https://")):
                stage("downloading", bytes=0)
                more["bytes"] = fetched(self.spark, data, f"{base}/download", lambda n: stage("downloading", bytes=n))
                data = f"{base}/download"
            stage("parsing", **more)
            text = self._read(header) or ""
            spec = parse_header(text)
            lines = read_lines(self.spark, data)
            good, rejects = parse(lines, spec)
            stage("writing", **more)
            counted = {"records": Observation(), "rejects": Observation()}
            rows = F.count(F.lit(1)).alias("rows")
            by_cell(good, parts).observe(counted["records"], rows).write.parquet(f"{base}/records")
            located(rejects, lines).observe(counted["rejects"], rows).write.parquet(f"{base}/rejects")
            self._create(f"{base}/schema.json", json.dumps(spec.__dict__))
            self._create(f"{base}/header", text)
            if index:
                stage("indexing", **more)
                postings.write(postings.postings(self.spark.read.parquet(f"{base}/records")), f"{base}/postings")
                postings.lengths(self.spark.read.parquet(f"{base}/postings")).write.parquet(f"{base}/lengths")
            stage("switching", **more)
            self._switch(name, version)
            self._open(name, version)
            self._clean(name)
            stage("loaded", version=version, **more, **{k: o.get["rows"] for k, o in counted.items()})
        except Exception as e:
            stage("error", message=str(e)[:500])
            if self.current(name) != version:
                self._delete(base)
            raise
        finally:
            self._delete(mark)
        return self.state[name]

    def _open(self, name: str, version: str) -> None:
        base = f"{self._path(name)}/{version}"
        old = self.loaded.pop(name, None)
        records = self.spark.read.parquet(f"{base}/records")
        if name in self.cached:
            if old is not None:
                old.unpersist()
            records = records.cache()
        self.loaded[name], self.versions[name] = records, version
        self.specs[name] = SchemaSpec(**json.loads(self._read(f"{base}/schema.json")))
        records.createOrReplaceTempView(name)

    def define_meta(self, name: str, properties: str) -> None:
        self.metas[name] = meta.parse_properties(properties)

    def get(self, name: str) -> DataFrame:
        """A category's records; loads the current version on first use.  A meta-category follows its members' switches."""
        if name in self.metas:
            m = self.metas[name]
            return meta.union({k: self.get(k) for k in m.members}, m.parameters)
        version = self.current(name)
        if version is None:
            raise NotFound(name)
        if name not in self.loaded or self.versions[name] != version:
            self._open(name, version)
            self.state[name] = {"stage": "loaded", "version": version}
        return self.loaded[name]

    def search(self, name: str, query: str | dict) -> planner.Answer:
        """A request's answer, by posting lists where its keywords are rare; the header and the footer as it asks."""
        d = self.get(name)
        spec = self.specs.get(name) or SchemaSpec([], *([n for n in d.schema[c].dataType.names if n != "_none"] for c in ("txt", "num")))
        request = parse_request(query, spec.text, spec.number)
        base = None if name in self.metas else f"{self._path(name)}/{self.versions[name]}"
        head = self._read(f"{base}/header") if base else render.declared(spec)
        if base and self._names(f"{base}/postings"):
            read = self.spark.read.parquet
            plan = lambda watch: planner.plan(d, request, read(f"{base}/postings"), read(f"{base}/lengths"), d.count(), watch)
        else:
            plan = lambda watch: planner.plan(d, request, watch=watch)
        return planner.answer(plan, request, head)

    def nearest(self, name: str, query: str | dict) -> DataFrame:
        """The k nearest records, read from no more cells than hold them."""
        d = self.get(name)
        spec = self.specs[name]
        return planner.nearest(d, parse_request(query, spec.text, spec.number), self.zones(name))

    def record(self, name: str, record_id: int) -> DataFrame:
        return self.get(name).filter(F.col("record_id") == record_id)

    def zones(self, name: str) -> DataFrame:
        """Bounds of the records by coarse grid cell."""
        return bounds(self.get(name).withColumn("zone", F.shiftright(geo.cell(F.col("lat"), F.col("lon")), 20)), "zone")

    def cache(self, name: str) -> None:
        """In memory, also after a switch."""
        self.cached.add(name)
        self.loaded[name] = self.get(name).cache()

    def preload(self, names: list[str]) -> None:
        """Loads and caches the categories that a service starts with."""
        for name in names:
            self.cache(name)

    def unload(self, name: str) -> None:
        """From memory; files stay."""
        if name not in self.loaded:
            raise NotFound(name)
        self.loaded.pop(name).unpersist()
        self.cached.discard(name)
        self.spark.catalog.dropTempView(name)
        self.state[name] = {"stage": "unloaded"}

    def status(self, name: str | None = None) -> dict:
        if name is None:
            return {"categories": dict(self.state), "loaded": len(self.loaded)}
        if name not in self.state and self.current(name) is None:
            raise NotFound(name)
        return self.state.get(name, {"stage": "not loaded"})
