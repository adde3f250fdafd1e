"""How a request is run: by a scan, or by posting lists where its keywords are rare; with a time limit."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from spindrift.functions import geo
from spindrift.operators import postings
from spindrift.operators.predicates import Op
from spindrift.operators.search import search
from spindrift.plans.request import SearchRequest
from spindrift.sources import render

#: Posting lists are used if the rarest required keyword has at most this share of the records.
RARE = 0.01


#: Miles that every place is within.
WORLD = 12_500.0


@dataclass
class Answer:
    """A request's lines, with header and footer as it asked, and its counts."""

    lines: list[str]
    hits: int
    chars: int
    seconds: float
    io: dict[str, int] = field(default_factory=dict)


def answer(plan: Callable[[dict | None], DataFrame], request: SearchRequest, head: str | None = None) -> Answer:
    """Runs a plan within the request's time; plan(watch) gives search()'s columns and counts rows by watch.

    The counts that _iostats asks for: rows read, those that passed the coarse tests, those that match, and how many
    passed the coarse tests in vain.
    """
    watch = {k: Observation() for k in ("read", "candidates", "matches")} if request.iostats else None
    began = time.perf_counter()
    rows = plan(watch)
    rows = rows if request.k is not None or request.proximal else rows.orderBy("miles", "record_id")
    found = [r.line for r in collect_within(render.lines(rows), request.timeout)]
    seconds, chars = time.perf_counter() - began, sum(map(len, found))
    io = {k: o.get["rows"] for k, o in watch.items()} if watch else {}
    if io:
        io["FALSE_POSITIVES"] = io["candidates"] - io["matches"]
    top = render.header(head) if request.header and head is not None else []
    return Answer([*top, *found, *render.footer(len(found), chars, seconds, io, request.explain() if request.explained else None)], len(found), chars, seconds, io)


def nearest(category: DataFrame, request: SearchRequest, zones: DataFrame) -> DataFrame:
    """search() by growing circles: each reads only what its box reaches, until one holds k records that match.

    zones: bounds of parts of the category (partition.bounds).  They say how large a circle holds 2 k records at
    least, which is where the search begins; predicates may leave fewer, so it goes on with twice the radius.
    """
    most = request.effective_radius()
    most = WORLD if most is None else most
    if request.k is None or request.window:
        return search(category, request)
    # The farthest point of a zone is no farther than its centre plus half its height and half its width.
    half = ((F.col("north") - F.col("south")) / 2 + (F.col("east") - F.col("west")) / 2) * geo.DEGREE_MILES
    far = geo.miles(request.lat, request.lon, (F.col("north") + F.col("south")) / 2, (F.col("east") + F.col("west")) / 2) + half
    w = Window.orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    first = zones.select(far.alias("far"), "n").orderBy("far").limit(10_000).withColumn("n", F.sum("n").over(w)).filter(F.col("n") >= 2 * request.k).agg(F.min("far")).first()[0]
    radius = min(most, first if first is not None else WORLD)
    while radius < most:
        own = search(category, replace(request, radius=radius))
        if own.count() >= request.k:
            return own
        radius *= 2
    return search(category, request)


def plan(category: DataFrame, request: SearchRequest, posted: DataFrame | None = None, frequencies: DataFrame | None = None, records: int | None = None, watch: dict | None = None) -> DataFrame:
    """The request's result.

    With a posting table, its term frequencies (field, term, df) and the number of records, an all-of
    predicate on one field whose rarest keyword is rare becomes a semi-join on its posting list.
    """
    if posted is not None and frequencies is not None and records:
        for p in request.texts:
            if p.op is not Op.ALL or p.field not in category.schema["tok"].dataType.names or "" in p.keywords:
                continue
            found = frequencies.filter((F.col("field") == p.field) & F.col("term").isin(list(p.keywords))).agg(F.min("df"), F.count("*")).first()
            if found[1] < len(set(p.keywords)) or found[0] <= RARE * records:
                few = postings.matching(posted, category, p.field, Op.ALL, list(p.keywords))
                return search(few, replace(request, texts=[t for t in request.texts if t is not p]), watch)
    return search(category, request, watch)


def collect_within(df: DataFrame, seconds: float | None) -> list[Row]:
    """The rows, or a TimeoutError: Spark has no partial results, so an expired request has none."""
    if seconds is None:
        return df.collect()
    sc, group, late = df.sparkSession.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "search", interruptOnCancel=True)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
