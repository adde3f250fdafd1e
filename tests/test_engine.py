"""Requests, ingestion, the catalog, meta-categories, streams and the plans of searches."""

import functools
import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from spindrift.functions import geo
from spindrift.operators import partition, postings, proximal
from spindrift.operators.predicates import Op
from spindrift.operators.search import matching, nearest_batch, search
from spindrift.plans import categories as C
from spindrift.plans import meta, planner, registry
from spindrift.plans.catalog import Catalog, NotFound, NotReady
from spindrift.plans.request import BadRequest, parse
from spindrift.sources import render, tsv
from spindrift.sources.schema import parse_header
from spindrift.streaming import ingest

SF = "/root/testdata/sf0.001"
HEADER = "preamble\nFIELD DEFINITIONS\nFIELD-1\tid\tT:string\nFIELD-2\tLatitude\nFIELD-3\tLongitude\nFIELD-4\taddress\tT:string\nFIELD-5\ttype\nFIELD-6\tprice\tT:Number\nFIELD-7\tsold\tT:number\n=\nid\tLatitude\n"
LINES = [
    "a1\t25.76\t-80.19\t8th St. #0042\tCondo\t$1,234.50\t2011-05-03", "a2\t25.76\t-80.19\t_null\t\t\t_NULL", "a3\t25.76\t-80.19\tx\ty\tabc\t0", "a4\t95\t-80.19\tx\ty\t1\t0",
    "a5\tnorth\t-80.19\tx\ty\t1\t0", "a6\t25.76\t-80.19\tx\ty\t1", "a7\tNaN\t-80.19\tx\ty\t1\t0",
]


def test_header_and_lines(spark, tmp_path):
    spec = parse_header(HEADER)
    assert (spec.text, spec.number, spec.position("Latitude")) == (["id", "address", "type"], ["price", "sold"], 1)
    with pytest.raises(ValueError):
        parse_header("FIELD DEFINITIONS\nFIELD-1\tid\n=\n")
    (tmp_path / "d.asc").write_text("\n".join(LINES) + "\n")
    good, rejects = tsv.parse(tsv.read_lines(spark, str(tmp_path / "d.asc")), spec)
    rows = {r.txt.id: r for r in good.collect()}
    assert rows["a1"].tok.address == ["8", "st", "42"] and (rows["a1"].num.price, rows["a1"].num.sold) == (1234.5, 2110503)
    assert (rows["a2"].txt.address, rows["a2"].txt.type, rows["a2"].num.price, rows["a2"].num.sold) == ("", "", 0, 0)
    assert rows["a3"].num.price != rows["a3"].num.price
    assert {r.raw_line[:2]: r.reason for r in rejects.collect()} == {"a4": "latitude out of range", "a5": "coordinates are not numbers", "a6": "expected 7 fields, found 6", "a7": "coordinates are not numbers"}
    place = {r.raw_line[:2]: (r.file.rpartition("/")[2], r.line_no) for r in tsv.located(rejects, tsv.read_lines(spark, str(tmp_path / "d.asc"))).collect()}
    assert place == {f"a{k}": ("d.asc", k) for k in (4, 5, 6, 7)}
    head = render.header(HEADER)
    assert head[:2] == ["preamble", "FIELD-1\tid\tT:string"] and head[8] == "FIELD-8\tlatitude" and head[-3] == "=" and head[-1] == "=="
    assert head[-2] == "id\tLatitude\tlatitude\tlongitude\tdistance\tcompass_direction\toffset"
    assert parse_header(render.declared(spec)).fields == spec.fields and parse_header(render.declared(spec)).number == spec.number


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a", 900), ("b", 1)):
        (tmp_path / name).write_text("".join(f"{name} line {k}\n" for k in range(1, n + 1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        lines = tsv.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = tsv.located(lines.withColumn("reason", F.lit("x")), lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(got) == 901 and all(r.raw_line == f"{r.file[-1]} line {r.line_no}" for r in got)


def test_requests():
    fields = (["address"], ["price"])
    r = parse("category=homes&x1=-80&y1=25&d=5&numfind=10&address=main+st&address|=oak&price<=100&price>3&anyfield!=a+b&nothing=1", *fields)
    assert (r.lat, r.lon, r.k, r.radius, r.ignored) == (25, -80, 10, 5, ["nothing"])
    assert [(p.field, p.op, p.keywords) for p in r.texts] == [("address", Op.ALL, ("main", "st")), ("address", Op.ANY, ("oak",)), ("anyfield", Op.NONE, ("a", "b"))]
    assert [(p.op, p.value) for p in r.numbers] == [(Op.LE, 100), (Op.GT, 3)]
    w = parse("x1=-81&y1=25&x2=-80&y2=26&numfind=10", *fields)
    assert w.window == (25, -81, 26, -80) and w.effective_radius() is None
    assert round(parse("x1=-10&y1=40&x2=10&y2=50&numfind=1", *fields, compat=True).effective_radius(), 3) == 579.89
    assert parse("x1=0&y1=0&numfind=1&address=_null", *fields).texts[0].keywords == ("",)
    for bad in ("x1=-80&y1=25", "x1=a&y1=2&numfind=1", "x1=0&y1=0&x2=-1&y2=3&numfind=1", "x1=0&y1=0&x2=3&numfind=1", "x1=0&y1=0&numfind=1&price<=", "x1=0&y1=0&numfind=1.5"):
        with pytest.raises(BadRequest):
            parse(bad, *fields)


def test_plan_pushes_box_and_takes_ordered(spark):
    plan = search(C.docs(spark, SF), parse("x1=20&y1=10&d=300&numfind=5&lang=en", ["text", "lang", "source"], ["n_chars"]))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_catalog_life_cycle(spark, tmp_path):
    (tmp_path / "h").write_text(HEADER)
    (tmp_path / "d1").write_text("\n".join(LINES))
    (tmp_path / "d2").write_text(LINES[0])
    cat = Catalog(spark, f"file://{tmp_path}/store")
    with pytest.raises(NotFound):
        cat.get("homes")
    assert cat.load("homes", f"file://{tmp_path}/d1", f"file://{tmp_path}/h")["records"] == 3
    assert cat.status()["loaded"] == 1 and cat.status("homes")["rejects"] == 4
    first = cat.current("homes")
    with pytest.raises(Exception):
        cat.load("homes", f"file://{tmp_path}/missing", f"file://{tmp_path}/h")
    assert cat.status("homes")["stage"] == "error" and cat.current("homes") == first
    cat.load("homes", f"file://{tmp_path}/d2", f"file://{tmp_path}/h")
    assert cat.get("homes").count() == 1 and cat.current("homes") != first
    cat.define_meta("all", "categories=homes\nparameters=type=condo")
    assert cat.get("all").count() == 1 and cat.zones("homes").first().n == 1
    answer = cat.search("homes", "x1=-80&y1=25&numfind=5&address=8+st&header=1&_iostats=y&_xpred=y")
    assert answer.hits == 1 and answer.lines[0] == "preamble" and "STATS: 1 records" in "".join(answer.lines)
    assert answer.io == {"read": 1, "candidates": 1, "matches": 1, "FALSE_POSITIVES": 0} and "\ttext address = 8 st" in answer.lines
    assert cat.search("all", "x1=-80&y1=25&numfind=5&header=1").hits == 1
    assert spark.read.parquet(f"{cat._path('homes')}/{cat.current('homes')}/lengths").count() > 3
    cat.unload("homes")
    assert cat.status()["loaded"] == 0 and Catalog(spark, f"file://{tmp_path}/store").get("homes").count() == 1


def test_catalog_switches_are_seen_elsewhere(spark, tmp_path):
    (tmp_path / "h").write_text(HEADER)
    for k in range(4):
        (tmp_path / f"d{k}").write_text("\n".join(LINES[: 1 + k % 2]))
    one, two = (Catalog(spark, f"file://{tmp_path}/store") for _ in range(2))
    seen = []
    for k in range(4):
        one.load("homes", f"file://{tmp_path}/d{k}", f"file://{tmp_path}/h")
        seen.append(two.get("homes").count())
    assert seen == [1, 2, 1, 2] and len(one.history("homes")) == 4
    assert len([p for p in (tmp_path / "store" / "homes").iterdir() if p.name.startswith("v-")]) == 2
    assert one.roll_back("homes") == one.history("homes")[-3]["version"] and two.get("homes").count() == 1
    assert one._create(f"{one._path('homes')}/_loading", "")
    with pytest.raises(NotReady):
        two.load("homes", f"file://{tmp_path}/d0", f"file://{tmp_path}/h")
    one._delete(f"{one._path('homes')}/_loading")


def test_load_from_a_url(spark, tmp_path):
    (tmp_path / "h").write_text(HEADER)
    (tmp_path / "data.asc").write_text("\n".join(LINES))

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        cat = Catalog(spark, f"file://{tmp_path}/store", {"homes": f"file://{tmp_path}/elsewhere"})
        state = cat.load("homes", f"http://127.0.0.1:{server.server_port}/data.asc", f"file://{tmp_path}/h", index=False)
    finally:
        server.shutdown()
    assert (state["records"], state["rejects"], state["bytes"]) == (3, 4, len("\n".join(LINES))) and (tmp_path / "elsewhere" / "homes").exists()
    bad = spark.read.parquet(f"{cat._path('homes')}/{state['version']}/rejects").orderBy("line_no").collect()
    assert [r.line_no for r in bad] == [4, 5, 6, 7]


def test_nearest_reads_growing_circles(spark):
    docs = C.docs(spark, SF).select("record_id", "raw_line", "lat", "lon", "txt", "tok", "num")
    zones = partition.bounds(docs.withColumn("zone", F.shiftright(geo.cell(F.col("lat"), F.col("lon")), 24)), "zone").cache()
    for q in ("numfind=7", "numfind=7&lang=fr", "numfind=50&d=2500", "numfind=5&lang=nothing", "numfind=1000000"):
        r = parse(f"x1=179&y1=-60&{q}", ["text", "lang", "source"], ["n_chars"])
        assert planner.nearest(docs, r, zones).collect() == search(docs, r).collect(), q


def test_nearest_batch_equals_all_distances(spark):
    rnd = random.Random(5)
    places = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(400)] + [(900 + k, 90.0, 180.0) for k in range(3)] + [(950, -90.0, -180.0)]
    points = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(25)] + [(100, 90.0, 0.0), (101, -90.0, 180.0), (102, 0.0, 180.0)]
    records = spark.createDataFrame(places, "record_id long, lat double, lon double")
    q = spark.createDataFrame(points, "point_id long, lat double, lon double")
    got = {}
    for r in nearest_batch(records, q, 5).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.record_id))
    for i, lat, lon in points:
        want = sorted((proximal.miles(lat, lon, y, x), k) for k, y, x in places)[:5]
        assert sorted(got[i]) == [(n, k) for n, (_, k) in enumerate(want, 1)]
    assert nearest_batch(records, q, 1000).count() == len(points) * len(places)
    assert nearest_batch(records.limit(0), q, 3).count() == 0


def test_options_and_coordinates(spark):
    fields = (["text", "lang", "source"], ["n_chars"])
    r = parse("x1=0&y1=0&numfind=all&Latitude<=3&longitude>170", *fields)
    assert r.ignored == [] and r.timeout == 15 and not r.header
    docs = C.docs(spark, SF)
    assert {x.record_id for x in search(docs, r).collect()} == {x.record_id for x in docs.filter("lat <= 3 AND lon > 170").collect()}
    assert parse("x1=0&y1=0&numfind=1&timeout=2.5&header=1", *fields).timeout == 2.5
    assert parse("x1=0&y1=0&numfind=1&timeout=2&_debug=y", *fields).timeout is None
    with pytest.raises(TimeoutError):
        planner.answer(lambda w: spark.range(1 << 40).selectExpr("sum(sqrt(id)) AS s").selectExpr("cast(s AS string) AS raw_line", "0D AS lat", "0D AS lon", "0D AS metres", "'' AS compass"), parse("x1=0&y1=0&numfind=1&timeout=1", *fields))


def test_text_is_cleaned_once_in_a_filter(spark):
    for name in ("text_all_of", "anyfield_all_of", "topk_text_radius"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        fields = 3 if name.startswith("any") else 1
        assert plan.count("(?<![^ ])0+") == fields, name


def test_parts_cover_and_prune(spark, tmp_path):
    docs = C.docs(spark, SF).select("record_id", "lat", "lon", "num")
    partition.write(docs, f"{tmp_path}/p", 6, HEADER)
    assert sum((p / "_header").read_text() == HEADER for p in (tmp_path / "p").iterdir() if p.name.startswith("part=")) == 6
    parts = spark.read.parquet(f"{tmp_path}/p")
    bounds = partition.bounds(parts, "part").cache()
    assert bounds.agg(F.sum("n")).first()[0] == docs.count()
    r = parse("x1=20&y1=10&d=900&numfind=1000", [], ["n_chars"])
    near = partition.pruned(parts, bounds, r.lat, r.lon, r.radius)
    assert near.inputFiles() and len(partition.parts_in_reach(bounds, r.lat, r.lon, r.radius)) < 6
    ids = lambda d: sorted(x.record_id for x in d.withColumns({"raw_line": F.lit(""), "tok": F.struct(F.lit(None).cast("string").alias("_none"))}).transform(lambda y: matching(y, r)).collect())
    assert ids(near.drop("part")) == ids(docs)
    with pytest.raises(Exception):
        partition.write(docs, f"{tmp_path}/p", 6)


def test_proximal_pages_and_fold_agree(spark, monkeypatch):
    docs = matching(C.docs(spark, SF), parse("x1=20&y1=10&d=7000&numfind=500", ["text", "lang", "source"], ["n_chars"])).select("record_id", "lat", "lon", "miles")
    whole = [tuple(r) for r in proximal.kept(docs, 400, None).collect()]
    monkeypatch.setattr(proximal, "PAGE", 7)
    assert [tuple(r) for r in proximal.kept(docs, 400, 12).collect()] == whole[:12]
    line = spark.createDataFrame([(k, 0.0, m / 69.09, m) for k, m in enumerate([0.0, 0.5, 0.9, 1.2, 2.5])], "record_id long, lat double, lon double, miles double")
    assert [r.record_id for r in proximal.kept(line, 1.0, 10).collect()] == [0, 3, 4]


def test_scan_and_postings_agree_on_random_predicates(spark):
    docs = C.docs(spark, SF).cache()
    posted = postings.postings(docs).cache()
    vocabulary = [r.term for r in posted.filter("field = 'text'").groupBy("term").count().orderBy(F.desc("count")).limit(40).collect()]
    rnd = random.Random(3)
    for op, sign in ((Op.ALL, ""), (Op.ANY, "|"), (Op.NONE, "!")):
        words = rnd.sample(vocabulary, 3)
        r = parse({"x1": "0", "y1": "0", "numfind": "100000", f"text{sign}": " ".join(words)}, ["text", "lang", "source"], ["n_chars"])
        a = {x.record_id for x in search(docs, r).collect()}
        assert a == {x.record_id for x in postings.matching(posted, docs.select("record_id"), "text", op, words).collect()}


def test_meta_needs_categories():
    assert meta.parse_properties("# c\ncategories=a:b\nparameters=type=condo:x<=3").parameters == {"type": ["condo"], "x<": ["3"]}
    with pytest.raises(ValueError):
        meta.parse_properties("parameters=x=1")


def test_stream_appends_records(spark, tmp_path):
    spec = parse_header(HEADER)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.asc").write_text("\n".join(LINES))
    good, rejects = ingest.record_stream(spark, f"{tmp_path}/in", spec)
    for df, to in ((good, "good"), (rejects, "bad")):
        ingest.append(df, f"{tmp_path}/{to}", f"{tmp_path}/ck-{to}", once=True).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 3 and spark.read.parquet(f"{tmp_path}/bad").count() == 4


def test_bitmaps_combine(spark):
    posted = postings.postings(C.docs(spark, SF).select("record_id", F.struct("tok.lang", "tok.source").alias("tok"), "num")).cache()
    maps = postings.any_field(postings.bitmaps(posted)).cache()
    have = {}
    for r in posted.collect():
        have.setdefault(r.record_id, set()).add(r.term)
    for how, test in (("all", lambda s: {"en", "src1"} <= s), ("any", lambda s: bool({"en", "src1"} & s)), ("none", lambda s: not {"en", "src1"} & s)):
        got = sorted(r.record_id for r in postings.members(postings.combined(maps, ["en", "src1"], how)).collect())
        assert got == sorted(i for i, s in have.items() if test(s)), how


def test_planner_agrees_with_a_scan_and_stops_in_time(spark):
    docs = C.docs(spark, SF).cache()
    posted = postings.postings(docs).cache()
    frequencies = postings.document_frequency(postings.bitmaps(posted)).cache()
    rare = frequencies.filter("field = 'text' AND df = 1").first().term
    for words in (rare, "the", f"the {rare}", "nosuchword"):
        r = parse({"x1": "0", "y1": "0", "numfind": "50", "text": words}, ["text", "lang", "source"], ["n_chars"])
        df = planner.plan(docs, r, posted, frequencies, docs.count())
        assert df.collect() == search(docs, r).collect()
    assert len(planner.collect_within(docs.select("record_id"), 60)) == docs.count()
    slow = spark.range(1 << 40).agg(F.sum(F.sqrt("id")))
    with pytest.raises(TimeoutError):
        planner.collect_within(slow, 1.0)


def test_queries_without_a_limit_in_sql_have_none(spark):
    assert parse("x1=0&y1=0&numfind=all", [], []).k is None and parse("x1=0&y1=0&numfind=1000000", [], []).k == 1000000
    for name in (*registry._TEXT, *registry._MIXED_QUERIES, "num_float_compat", "radius_antimeridian", "window_compat_circle", "discard_approximate", "result_stats", "false_positives"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan, name


def test_bitmaps_of_all_fields_count_the_texts_terms(spark):
    want = {}
    for r in C.docs(spark, SF).select("tok.text").collect():
        for t in set(r.text):
            want[t] = want.get(t, 0) + 1
    got = registry.QUERIES["postings_bitmaps"](spark, SF).filter("field = 'text'").collect()
    assert len(want) > 100 and {r.term: r.df for r in got} == want
