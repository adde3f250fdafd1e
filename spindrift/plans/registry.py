"""Every query of the engine by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import geo, numeric
from spindrift.operators import partition, postings, stats
from spindrift.operators.predicates import Op
from spindrift.operators.search import matching, nearest_batch, search
from spindrift.plans import categories as C
from spindrift.plans import meta, planner
from spindrift.plans.request import EVERY, parse
from spindrift.sources import render
from spindrift.sources.schema import parse_header
from spindrift.sources.tsv import parse as parse_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DOCS = (["text", "lang", "source"], ["n_chars"])
# The same centre for all searches.
LAT, LON = 10.0, 20.0
AT = f"x1={LON}&y1={LAT}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- SQL for what the categories are made of -------------------------------------------------------

_LEAD = r"regexp_replace(t, '^0+', '')"
_TERM = rf"regexp_replace(CASE WHEN length(t) > 0 AND {_LEAD} = '' THEN '0' ELSE {_LEAD} END, '^([0-9]+)(st|nd|rd|th)$', '\1')"
_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'"


def _step(e: str) -> str:
    s = rf'''regexp_replace(regexp_replace({e}, '[^ -~]\]', ' ', 'g'), '[!@#$%^&*()/_=`{2 * chr(39)}+,.:;"\-?~<>{{}}\[\]\\|]', ' ', 'g')'''
    return rf"lower(regexp_replace(regexp_replace({s}, '[ \t\n\x0B\f\r]{{2,}}', ' ', 'g'), {_TRIM}))"


def _clean(raw: str, step: str) -> str:
    terms = f"array_to_string(list_transform(string_split({step}, ' '), lambda t: {_TERM}), ' ')"
    return f"CASE WHEN {raw} IS NULL OR lower({raw}) = '_null' THEN '' WHEN regexp_matches({step}, '[0-9]') THEN regexp_replace({terms}, {_TRIM}) ELSE {step} END"


def _place(i: str) -> str:
    f = lambda k, m, off: f"CAST(CAST((CAST({i} AS BIGINT) * {k}) % {m} / CAST(100 AS DOUBLE) - {off} AS FLOAT) AS DOUBLE)"
    return f"{f(104729, 18000, 90)} AS lat, {f(7919, 36000, 180)} AS lon"


def cte(name: str, source: str, ident: str, text: dict[str, str], numbers: dict[str, str], place: str | None = None) -> str:
    """A category as SQL: record_id, lat, lon, x_ cleaned texts, t_ their tokens, n_ numbers, raw_line."""
    raw = f"concat_ws(chr(9), {', '.join(f'CAST({c} AS VARCHAR)' for c in [ident, *text.values()])})"
    a = f"{name}0 AS (SELECT CAST({ident} AS BIGINT) AS record_id, {raw} AS raw_line, {place or _place(ident)}" + "".join(f", {c} AS r_{n}, {_step(c)} AS s_{n}" for n, c in text.items()) + "".join(f", CAST({c} AS DOUBLE) AS n_{n}" for n, c in numbers.items()) + f" FROM {source})"
    b = f"{name}1 AS (SELECT *" + "".join(f", {_clean(f'r_{n}', f's_{n}')} AS x_{n}" for n in text) + f" FROM {name}0)"
    c = f"{name} AS (SELECT *" + "".join(f", list_distinct(string_split(x_{n}, ' ')) AS t_{n}" for n in text) + f" FROM {name}1)"
    return ", ".join((a, b, c))


def sql_miles(lat1, lon1, lat2="lat", lon2="lon", factor: str = "") -> str:
    c = f"sin(radians({lat1})) * sin(radians({lat2})) + cos(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon1} - {lon2}))"
    return f"round(degrees(acos(greatest(least({c}, 1.0), -1.0))) * 60 * 1.1515{factor}, 6)"


def sql_compass(lat=LAT, lon=LON) -> str:
    ns, ew = f"CASE WHEN {lat} < lat THEN 'N' WHEN {lat} > lat THEN 'S' ELSE '' END", f"CASE WHEN {lon} < lon THEN 'E' WHEN {lon} > lon THEN 'W' ELSE '' END"
    return f"CASE WHEN concat({ns}, {ew}) = '' THEN 'N' ELSE concat({ns}, {ew}) END"


CTE_DOCS = "WITH " + cte("docs", "documents", "doc_id", {"text": "text", "lang": "lang", "source": "source"}, {"n_chars": "n_chars"})
CTE_PLAIN = f"WITH docs AS (SELECT doc_id AS record_id, {_place('doc_id')}, n_chars AS n_n_chars, concat_ws(chr(9), CAST(doc_id AS VARCHAR), text, lang, source) AS raw_line FROM documents)"
MILES = sql_miles(LAT, LON)
HIT = f"record_id, lat, lon, {MILES} AS miles"


def docs_request(rest: str, compat: bool = False):
    return parse(f"{AT}&{rest}", *DOCS, compat=compat)


def found(spark: SparkSession, d: str, rest: str, *columns: str, compat: bool = False) -> DataFrame:
    return search(C.docs(spark, d), docs_request(rest, compat)).select(*columns or ("record_id", "lat", "lon", "miles"))


# ---- normal forms ----------------------------------------------------------------------------------


@query("cleanse_text", f"{CTE_DOCS} SELECT record_id, md5(x_text) AS digest, CAST(length(x_text) AS BIGINT) AS n FROM docs")
def _(spark, d):
    return C.docs(spark, d).select("record_id", F.md5(F.col("txt.text").cast("binary")).alias("digest"), F.length("txt.text").cast("long").alias("n"))


@query("tokens_distinct", f"{CTE_DOCS} SELECT record_id, CAST(len(t_text) AS BIGINT) AS n, list_sum(list_transform(t_text, lambda t: length(t)))::BIGINT AS chars FROM docs")
def _(spark, d):
    chars = F.aggregate("tok.text", F.lit(0), lambda a, t: a + F.length(t))
    return C.docs(spark, d).select("record_id", F.size("tok.text").cast("long").alias("n"), chars.cast("long").alias("chars"))


# Numbers as text, of each kind that the normal form knows.
_RAW = """CASE o_orderkey % 9 WHEN 0 THEN concat('$', CAST(o_custkey AS {s}), ',250.50') WHEN 1 THEN '_null' WHEN 2 THEN ' ' WHEN 3 THEN 'abc' WHEN 4 THEN concat('00', CAST(o_custkey AS {s}))
 WHEN 5 THEN concat('-0', CAST(o_custkey AS {s})) WHEN 6 THEN concat(CAST(1985 + o_orderkey % 30 AS {s}), '-05-17 10:30') WHEN 7 THEN concat(CAST(o_custkey AS {s}), 'e5') ELSE concat('+', CAST(o_custkey AS {s}), '-3') END"""
_N1 = r"CASE WHEN regexp_replace(z, '^[ +_]*0*', '') = '' OR TRY_CAST(regexp_replace(z, '^[ +_]*0*', '') AS FLOAT) = 0 THEN '0' ELSE regexp_replace(z, '^[ +_]*0*', '') END"
_N2 = rf"CASE WHEN regexp_matches(y, '{numeric.DATE}') THEN concat(CASE WHEN y[1:4] >= '2000' THEN '2' ELSE '1' END, y[3:4], y[6:7], y[9:10]) ELSE y END"


@query(
    "cleanse_numeric",
    f"""WITH a AS (SELECT o_orderkey, {_RAW.format(s='VARCHAR')} AS raw FROM orders), b AS (SELECT *, regexp_replace(raw, {_TRIM}) AS w FROM a),
 c AS (SELECT *, CASE WHEN w = '' OR lower(w) = '_null' THEN '0' ELSE w END AS z FROM b), e AS (SELECT *, {_N1} AS y FROM c),
 f AS (SELECT *, regexp_replace({_N2}, '[^0-9.\\-]+', '', 'g') AS cleaned FROM e)
 SELECT o_orderkey, cleaned, TRY_CAST(cleaned AS DOUBLE) AS value, TRY_CAST(cleaned AS DOUBLE) IS NULL AS is_nan FROM f""",
)
def _(spark, d):
    o = C.table(spark, d, "orders").withColumn("raw", F.expr(_RAW.format(s="string")))
    v = numeric.number(F.col("raw"))
    return o.select("o_orderkey", numeric.clean_number(F.col("raw")).alias("cleaned"), F.when(~F.isnan(v), v).alias("value"), F.isnan(v).alias("is_nan"))


@query("date_to_cyymmdd", "SELECT o_orderkey, concat(CASE WHEN year(o_orderdate) >= 2000 THEN '2' ELSE '1' END, strftime(o_orderdate, '%y%m%d')) AS code FROM orders")
def _(spark, d):
    return C.table(spark, d, "orders").select("o_orderkey", numeric.clean_number(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("code"))


# ---- text predicates -------------------------------------------------------------------------------

_ALL = f"numfind={EVERY}"
_ANYTOK = "list_concat(t_text, t_lang, t_source)"
_TEXT = {
    "text_all_of": ("text=the of", "list_has_all(t_text, ['the', 'of'])"),
    "text_any_of": ("text|=thst ningún der", "list_has_any(t_text, ['thst', 'ningún', 'der'])"),
    "text_none_of": ("text!=the der", "NOT list_has_any(t_text, ['the', 'der'])"),
    "anyfield_all_of": ("anyfield=en src1 the", f"list_has_all({_ANYTOK}, ['en', 'src1', 'the'])"),
    "anyfield_any_of": ("anyfield|=es src3", f"list_has_any({_ANYTOK}, ['es', 'src3'])"),
    "anyfield_none_of": ("anyfield!=en src3 src5", f"NOT list_has_any({_ANYTOK}, ['en', 'src3', 'src5'])"),
}
for _name, (_rest, _cond) in _TEXT.items():
    query(_name, f"{CTE_DOCS} SELECT {HIT} FROM docs WHERE {_cond}")(lambda spark, d, r=_rest: found(spark, d, f"{r}&{_ALL}"))


# A category with empty texts, zero and unusable numbers.
_MIXED_TEXT = {"name": "c_name", "segment": "CASE WHEN c_custkey % 7 = 0 THEN '_NULL' WHEN c_custkey % 7 = 1 THEN '  ' ELSE c_mktsegment END", "code": "CAST(c_custkey * 3 % 1000 AS {s})"}
_MIXED_NUM = {"acctbal": "CASE WHEN c_custkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 13 = 0 THEN 0 ELSE c_acctbal END", "nationkey": "c_nationkey"}
_MIXED = (list(_MIXED_TEXT), list(_MIXED_NUM))
CTE_MIXED = "WITH " + cte("mixed", "customer", "c_custkey", {k: v.format(s="VARCHAR") for k, v in _MIXED_TEXT.items()}, _MIXED_NUM)


def mixed(spark: SparkSession, d: str) -> DataFrame:
    df = C.table(spark, d, "customer").selectExpr("c_custkey", *(f"{v.format(s='string')} AS {k}" for k, v in {**_MIXED_TEXT, **_MIXED_NUM}.items()))
    return C.category(df, "c_custkey", {k: k for k in _MIXED_TEXT}, {k: k for k in _MIXED_NUM})


_NAN = "NOT isnan(n_acctbal)"
_V = 5000.0
_MIXED_QUERIES = {
    "null_text": ("segment=_null", "list_contains(t_segment, '')"),
    "null_any_field": ("anyfield=_null", "(list_contains(list_concat(t_name, t_segment, t_code), '') OR n_acctbal = 0 OR n_nationkey = 0)"),
    "numeric_zero": ("acctbal=0", f"{_NAN} AND abs(n_acctbal) <= 9.999999747378752e-06"),
    "num_ne_nan": ("acctbal!=0", "(n_acctbal <> 0 OR isnan(n_acctbal))"),
    "num_le": (f"acctbal<={_V}", f"{_NAN} AND n_acctbal <= {_V}"),
    "num_lt": (f"acctbal<{_V}", f"{_NAN} AND n_acctbal < {_V}"),
    "num_ge": (f"acctbal>={_V}", f"{_NAN} AND n_acctbal >= {_V}"),
    "num_gt": (f"acctbal>{_V}", f"{_NAN} AND n_acctbal > {_V}"),
    "num_eq": ("nationkey=7", "abs(n_nationkey - 7) <= 9.999999747378752e-06"),
    "num_any_of": ("nationkey|=3&nationkey|=11", "(abs(n_nationkey - 3) <= 9.999999747378752e-06 OR abs(n_nationkey - 11) <= 9.999999747378752e-06)"),
    "text_range_numeric": ("code<=250&code>40", "TRY_CAST(x_code AS DOUBLE) <= 250 AND TRY_CAST(x_code AS DOUBLE) > 40"),
    "text_range_lex": ("segment>=b&segment<household", "x_segment >= 'b' AND x_segment < 'household'"),
    "conjunction": (f"name=customer&segment!=building&acctbal>={_V}&nationkey!=3&d=4000", f"list_contains(t_name, 'customer') AND NOT list_contains(t_segment, 'building') AND {_NAN} AND n_acctbal >= {_V} AND n_nationkey <> 3 AND {MILES} <= 4000"),
}
for _name, (_rest, _cond) in _MIXED_QUERIES.items():
    query(_name, f"{CTE_MIXED} SELECT {HIT} FROM mixed WHERE {_cond}")(
        lambda spark, d, r=_rest: search(mixed(spark, d), parse(f"{AT}&{_ALL}&{r}", *_MIXED)).select("record_id", "lat", "lon", "miles")
    )

_PARTS = (["name", "brand", "type"], ["size", "retailprice"])


@query(
    "num_float_compat",
    f"""WITH p AS (SELECT p_partkey AS record_id, CAST(p_retailprice AS DOUBLE) AS v, {_place('p_partkey')} FROM part)
 SELECT record_id, {MILES} AS miles FROM p WHERE v <= 1000.1 AND CAST(CAST(v AS FLOAT) AS DOUBLE) <= 1000.1""",
)
def _(spark, d):
    return search(C.parts(spark, d), parse(f"{AT}&{_ALL}&retailprice<=1000.1", *_PARTS, compat=True)).select("record_id", "miles")


# ---- geography -------------------------------------------------------------------------------------


@query("distance_units", f"{CTE_PLAIN} SELECT record_id, {MILES} AS miles, {sql_miles(LAT, LON, factor=' * 1.609344')} AS kilometres, {sql_miles(LAT, LON, factor=' * 0.8684')} AS nautical FROM docs")
def _(spark, d):
    each = {n: F.round(geo.distance(LAT, LON, F.col("lat"), F.col("lon"), u), 6).alias(n) for n, u in (("miles", "M"), ("kilometres", "K"), ("nautical", "N"))}
    return C.docs(spark, d).select("record_id", *each.values())


@query("topk_knn", f"{CTE_PLAIN} SELECT {HIT} FROM docs ORDER BY miles, record_id LIMIT 25")
def _(spark, d):
    return found(spark, d, "numfind=25")


@query("topk_text_radius", f"{CTE_DOCS} SELECT {HIT}, round({MILES} * 1609.343994140625, 3) AS metres, {sql_compass()} AS compass FROM docs WHERE list_has_all(t_text, ['the', 'of']) AND {MILES} <= 3000 ORDER BY miles, record_id LIMIT 10")
def _(spark, d):
    return found(spark, d, "text=the of&d=3000&numfind=10", "record_id", "lat", "lon", "miles", "metres", "compass")


@query("radius_antimeridian", f"{CTE_PLAIN} SELECT record_id, {sql_miles(5, 179)} AS miles FROM docs WHERE {sql_miles(5, 179)} <= 1500")
def _(spark, d):
    return search(C.docs(spark, d), parse(f"x1=179&y1=5&d=1500&{_ALL}", *DOCS)).select("record_id", "miles")


@query("window_query", f"{CTE_PLAIN} SELECT record_id, lat, lon, {sql_miles(15.0, 30.0)} AS miles FROM docs WHERE lat BETWEEN -20 AND 50 AND lon BETWEEN -10 AND 70 ORDER BY miles, record_id LIMIT 40")
def _(spark, d):
    return search(C.docs(spark, d), parse("x1=-10&y1=-20&x2=70&y2=50&numfind=40", *DOCS)).select("record_id", "lat", "lon", "miles")


@query("window_compat_circle", f"{CTE_PLAIN} SELECT record_id, {sql_miles(40.0, 0.0)} AS miles FROM docs WHERE lat BETWEEN 10 AND 70 AND lon BETWEEN -60 AND 60 AND {sql_miles(40.0, 0.0)} <= {sql_miles(40.0, 0.0, 70, 60)}")
def _(spark, d):
    return search(C.docs(spark, d), parse(f"x1=-60&y1=10&x2=60&y2=70&{_ALL}", *DOCS, compat=True)).select("record_id", "miles")


@query("compass_and_metres", f"{CTE_PLAIN} SELECT record_id, {sql_compass()} AS compass, round({MILES} * 1609.343994140625, 3) AS metres FROM docs")
def _(spark, d):
    return matching(C.docs(spark, d), docs_request(_ALL)).select("record_id", "compass", "metres")


@query("rectangle_distance", f"{CTE_PLAIN} SELECT record_id, round(6371229.0 * acos(greatest(least(cos(radians(y)) * cos(radians(lat)) * cos(radians(x - lon)) + sin(radians(y)) * sin(radians(lat)), 1.0), -1.0)), 3) AS metres FROM (SELECT *, greatest(-10.0, least(lat, 30.0)) AS y, greatest(5.0, least(lon, 60.0)) AS x FROM docs)")
def _(spark, d):
    return C.docs(spark, d).select("record_id", F.round(geo.rectangle_distance(F.col("lat"), F.col("lon"), -10, 5, 30, 60), 3).alias("metres"))


# Places with as many decimals as the rule for approximate ones looks at.
_SIX = {
    "lat": "CAST(concat('25.', lpad(CAST(doc_id % 1000 AS {s}), 3, '1'), CASE WHEN doc_id % 3 = 0 THEN '107' ELSE '113' END) AS DOUBLE)",
    "lon": "CAST(concat('-80.', lpad(CAST(doc_id * 7 % 1000 AS {s}), 3, '2'), CASE doc_id % 4 WHEN 0 THEN '001' WHEN 1 THEN '004' WHEN 2 THEN '999' ELSE '123' END) AS DOUBLE)",
}


@query("discard_approximate", f"WITH docs AS (SELECT doc_id AS record_id, {_SIX['lat'].format(s='VARCHAR')} AS lat, {_SIX['lon'].format(s='VARCHAR')} AS lon, doc_id FROM documents) SELECT record_id, lat, lon FROM docs WHERE NOT (doc_id % 3 = 0 AND doc_id % 4 <> 3)")
def _(spark, d):
    six = {k: F.expr(v.format(s="string").replace("doc_id", "record_id")) for k, v in _SIX.items()}
    return search(C.docs(spark, d).withColumns(six), docs_request(f"{_ALL}&discard_approximate_locations=1")).select("record_id", "lat", "lon")


@query(
    "proximal_dedup",
    f"""{CTE_PLAIN.replace('WITH docs', 'WITH RECURSIVE docs')}, c AS (SELECT record_id, lat, lon, {MILES} AS miles FROM docs WHERE {MILES} <= 6000),
 r AS (SELECT *, row_number() OVER (ORDER BY miles, record_id) AS rn FROM c),
 nxt AS (SELECT a.rn, min(b.rn) AS next FROM r a JOIN r b ON b.rn > a.rn AND {sql_miles('a.lat', 'a.lon', 'b.lat', 'b.lon')} >= 300 GROUP BY a.rn),
 k AS (SELECT CAST(1 AS BIGINT) AS rn UNION ALL SELECT nxt.next FROM k JOIN nxt ON nxt.rn = k.rn)
 SELECT record_id, miles FROM r WHERE rn IN (SELECT rn FROM k) ORDER BY miles, record_id LIMIT 60""",
)
def _(spark, d):
    return found(spark, d, "d=6000&discard_proximal_duplicates=300&numfind=60", "record_id", "miles")


@query("nearest_batch", f"""{CTE_PLAIN}, q AS (SELECT r_regionkey AS point_id, -60.0 + 30 * r_regionkey AS q_lat, -120.0 + 55 * r_regionkey AS q_lon FROM region),
 a AS (SELECT point_id, {sql_miles('q_lat', 'q_lon')} AS miles, record_id FROM docs, q), b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY miles, record_id) AS rank FROM a)
 SELECT CAST(point_id AS INTEGER) AS point_id, miles, record_id, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 4""")
def _(spark, d):
    q = C.table(spark, d, "region").selectExpr("r_regionkey AS point_id", "CAST(-60.0 + 30 * r_regionkey AS DOUBLE) AS lat", "CAST(-120.0 + 55 * r_regionkey AS DOUBLE) AS lon")
    return nearest_batch(C.docs(spark, d), q, 4)


# ---- records, unions, postings, partitions ---------------------------------------------------------

_HEADER = "FIELD DEFINITIONS\nFIELD-1\tid\tT:string\nFIELD-2\tLatitude\nFIELD-3\tLongitude\nFIELD-4\tname\tT:string\nFIELD-5\tbalance\tT:Number\n=\n"
_LINE = "concat_ws({tab}, CAST(c_custkey AS {s}), CASE c_custkey % 10 WHEN 1 THEN '95' WHEN 2 THEN 'north' ELSE '25.5' END, CASE WHEN c_custkey % 10 = 3 THEN '-180.5' ELSE '-80' END, c_name{more})"


@query(
    "coord_validation_rejects",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 4 THEN 'expected 5 fields, found 4' WHEN c_custkey % 10 = 1 THEN 'latitude out of range' WHEN c_custkey % 10 = 2 THEN 'coordinates are not numbers' WHEN c_custkey % 10 = 3 THEN 'longitude out of range' ELSE 'good' END AS outcome FROM customer",
)
def _(spark, d):
    line = f"CASE WHEN c_custkey % 10 = 4 THEN {_LINE.format(tab='char(9)', s='string', more='')} ELSE {_LINE.format(tab='char(9)', s='string', more=', CAST(c_acctbal AS string)')} END"
    lines = C.table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.expr(line).alias("raw_line"))
    good, rejects = parse_lines(lines, parse_header(_HEADER))
    return good.select(F.col("record_id").alias("id"), F.lit("good").alias("outcome")).unionByName(rejects.select(F.col("record_id").alias("id"), F.col("reason").alias("outcome")))


@query("record_lookup", f"{CTE_PLAIN} SELECT record_id, lat, lon, raw_line FROM docs WHERE record_id = 7")
def _(spark, d):
    return C.docs(spark, d).filter("record_id = 7").select("record_id", "lat", "lon", "raw_line")


@query(
    "meta_union_topk",
    f"""WITH p AS (SELECT 'customers' AS member, CAST(c_custkey AS BIGINT) AS record_id, {_place('c_custkey')}, c_acctbal AS b FROM customer
 UNION ALL SELECT 'suppliers', CAST(s_suppkey AS BIGINT), {_place('s_suppkey')}, s_acctbal FROM supplier)
 SELECT member, record_id, {MILES} AS miles FROM p WHERE b >= 0 AND {MILES} <= 5000 ORDER BY miles, record_id, member LIMIT 50""",
)
def _(spark, d):
    spec = meta.parse_properties("categories=customers:suppliers\nparameters=acctbal>=0")
    members = {"customers": C.customers(spark, d), "suppliers": C.suppliers(spark, d)}
    u = meta.union({k: members[k] for k in spec.members}, spec.parameters)
    r = parse(f"{AT}&d=5000&numfind=50", ["name"], ["acctbal", "nationkey"])
    return matching(u, r).select("member", "record_id", "miles").orderBy("miles", "record_id", "member").limit(r.k)


_POSTED = "p AS (" + " UNION ALL ".join(f"SELECT record_id, '{f}' AS field, unnest(t_{f}) AS term FROM docs" for f in DOCS[0]) + " UNION ALL SELECT record_id, 'n_chars', '' FROM docs WHERE n_n_chars = 0)"


@query("postings_build", f"{CTE_DOCS}, {_POSTED} SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(length(term)) AS BIGINT) AS chars FROM p GROUP BY field")
def _(spark, d):
    return postings.postings(C.docs(spark, d)).groupBy("field").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum(F.length("term")).alias("chars"))


for _name, _op, _words, _cond in (
    ("postings_all_of", Op.ALL, ["the", "of"], "list_has_all(t_text, ['the', 'of'])"),
    ("postings_any_of", Op.ANY, ["thst", "der"], "list_has_any(t_text, ['thst', 'der'])"),
    ("postings_none_of", Op.NONE, ["the", "der"], "NOT list_has_any(t_text, ['the', 'der'])"),
):

    def _posted(spark, d, op=_op, words=_words):
        docs = C.docs(spark, d)
        return postings.matching(postings.postings(docs), docs.select("record_id", "lat", "lon"), "text", op, words)

    query(_name, f"{CTE_DOCS} SELECT record_id, lat, lon FROM docs WHERE {_cond}")(_posted)


@query("postings_bitmaps", f"{CTE_DOCS}, {_POSTED} SELECT field, term, count(*) AS df FROM p GROUP BY ALL")
def _(spark, d):
    return postings.document_frequency(postings.bitmaps(postings.postings(C.docs(spark, d))))


_GRID = "CAST(least(greatest(floor(({c} - {low}) / {span} * 65536), 0), 65535) AS BIGINT)"
_CELL = "CAST(list_sum(list_transform(range(16), lambda b: (((gy >> CAST(b AS BIGINT)) & 1) << CAST(2 * b + 1 AS BIGINT)) | (((gx >> CAST(b AS BIGINT)) & 1) << CAST(2 * b AS BIGINT)))) AS BIGINT)"
_CELLS = f"g AS (SELECT *, {_GRID.format(c='lat', low='-90.0', span='180.0')} AS gy, {_GRID.format(c='lon', low='-180.0', span='360.0')} AS gx FROM docs), cells AS (SELECT *, {_CELL} AS cell FROM g)"


@query("grid_cells", f"{CTE_PLAIN}, {_CELLS} SELECT record_id, cell FROM cells")
def _(spark, d):
    return C.docs(spark, d).select("record_id", geo.cell(F.col("lat"), F.col("lon")).alias("cell"))


@query(
    "node_minmax_mbr",
    f"""{CTE_PLAIN}, {_CELLS} SELECT CAST(cell >> 26 AS BIGINT) AS zone, count(*) AS n, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east,
 CAST(min(n_n_chars) AS DOUBLE) AS n_chars_min, CAST(max(n_n_chars) AS DOUBLE) AS n_chars_max, (max(lat) - min(lat)) * (max(lon) - min(lon)) AS area FROM cells GROUP BY 1""",
)
def _(spark, d):
    return partition.bounds(C.docs(spark, d).withColumn("zone", F.shiftright(geo.cell(F.col("lat"), F.col("lon")), 26)), "zone")


@query("zorder_partitions", f"{CTE_PLAIN} SELECT count(*) AS records, 12 AS parts FROM docs")
def _(spark, d):
    p = partition.numbered(C.docs(spark, d).select("record_id", "lat", "lon"), 12).groupBy("part").agg(F.count("*").alias("n"), F.min("cell").alias("low"), F.max("cell").alias("high"))
    return p.agg(F.sum("n").alias("records"), F.count("*").cast("int").alias("parts"))


def _bits(c: str) -> str:
    e = f"CAST(floor(log2(abs({c}))) AS INTEGER)"
    e = f"({e} + CASE WHEN abs({c}) < pow(2, {e}) THEN -1 WHEN abs({c}) >= pow(2, {e} + 1) THEN 1 ELSE 0 END)"
    return f"CASE WHEN {c} = 0 THEN 0 ELSE CASE WHEN {c} < 0 THEN 2147483648 ELSE 0 END + CAST({e} + 127 AS BIGINT) * 8388608 + CAST(round((abs({c}) / pow(2, {e}) - 1) * 8388608) AS BIGINT) END"


_WOVEN = "list_sum(list_transform(range(32), lambda b: CAST((y >> b) & 1 AS HUGEINT) * CAST(pow(2, 2 * b + 1) AS HUGEINT) + CAST((x >> b) & 1 AS HUGEINT) * CAST(pow(2, 2 * b) AS HUGEINT)))"


@query(
    "zorder_bits",
    f"""{CTE_PLAIN}, f AS (SELECT record_id, CAST({_bits('lat')} AS BIGINT) AS y, CAST({_bits('lon')} AS BIGINT) AS x FROM docs), w AS (SELECT record_id, {_WOVEN} AS z FROM f)
 SELECT record_id, CAST(CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END AS BIGINT) AS z FROM w""",
)
def _(spark, d):
    return C.docs(spark, d).select("record_id", geo.zorder(F.col("lat"), F.col("lon")).alias("z"))


# ---- reports ---------------------------------------------------------------------------------------


@query("result_stats", f"{CTE_PLAIN} SELECT count(*) AS hits, CAST(sum(length(raw_line)) AS BIGINT) AS chars FROM docs WHERE {MILES} <= 3000")
def _(spark, d):
    return stats.result_stats(search(C.docs(spark, d), docs_request(f"d=3000&{_ALL}")))


@query("false_positives", f"{CTE_PLAIN} SELECT count(*) AS false_positives FROM docs WHERE {MILES} > 3000 AND lat BETWEEN 10 - 40 AND 10 + 40 AND lon BETWEEN 20 - 40 AND 20 + 40")
def _(spark, d):
    docs, radius = C.docs(spark, d), geo.miles(LAT, LON, F.col("lat"), F.col("lon")) <= 3000
    return stats.false_positives(docs, geo.in_rectangle(F.col("lat"), F.col("lon"), LAT - 40, LON - 40, LAT + 40, LON + 40), radius)


_EXPLAINED = "text=the of&lang|=en es&source!=src1&n_chars>=100&text<=m&anyfield=_null&price=3&d=500&numfind=5"


@query("explain_predicates", "SELECT unnest(['text text = the of', 'text anyfield = _null', 'text lang |= en es', 'text source != src1', 'number n_chars >= 100', 'range text <= m', 'radius 500 miles', 'ignored price']) AS line")
def _(spark, d):
    return spark.createDataFrame([(x,) for x in docs_request(_EXPLAINED).explain()], "line string")


@query("coordinate_predicates", f"{CTE_PLAIN} SELECT {HIT} FROM docs WHERE lat <= 3 AND lon > 100")
def _(spark, d):
    return found(spark, d, f"Latitude<=3&Longitude>100&{_ALL}")


@query("nearest_growing_circles", f"{CTE_DOCS} SELECT {HIT} FROM docs WHERE list_contains(t_lang, 'de') ORDER BY miles, record_id LIMIT 15")
def _(spark, d):
    docs = C.docs(spark, d)
    zones = partition.bounds(docs.withColumn("zone", F.shiftright(geo.cell(F.col("lat"), F.col("lon")), 24)), "zone")
    return planner.nearest(docs, docs_request("lang=de&numfind=15"), zones).select("record_id", "lat", "lon", "miles")


@query("postings_lengths", f"{CTE_DOCS}, {_POSTED} SELECT field, term, count(*) AS df FROM p GROUP BY ALL")
def _(spark, d):
    return postings.lengths(postings.postings(C.docs(spark, d))).select("field", "term", "df")


_DECLARED = "made for the test tables\nFIELD DEFINITIONS\nFIELD-1\tid\tT:string\nFIELD-2\tLatitude\nFIELD-3\tLongitude\nFIELD-4\tbalance\tT:Number\n=\nid\tLatitude\tLongitude\tbalance"
_RESULT = ["made for the test tables", "FIELD-1\tid\tT:string", "FIELD-2\tLatitude", "FIELD-3\tLongitude", "FIELD-4\tbalance\tT:Number", "FIELD-5\tlatitude", "FIELD-6\tlongitude", "FIELD-7\tdistance\tDistance", "FIELD-8\tcompass_direction\tCompass direction:  N S W E NW SW SE NE", "FIELD-9\toffset\t", "=", "id\tLatitude\tLongitude\tbalance\tlatitude\tlongitude\tdistance\tcompass_direction\toffset", "=="]


@query("result_header", "SELECT line, CAST(row_number() OVER () AS BIGINT) AS n FROM (SELECT unnest([" + ", ".join("'" + x.replace("\t", "' || chr(9) || '") + "'" for x in _RESULT) + "]) AS line)")
def _(spark, d):
    return spark.createDataFrame([(x, n) for n, x in enumerate(render.header(_DECLARED), 1)], "line string, n long")


@query("result_footer", f"{CTE_PLAIN} SELECT '===' AS line UNION ALL SELECT concat('STATS: ', count(*), ' records, ', sum(length(raw_line)), ' characters.') FROM docs WHERE {MILES} <= 3000 UNION ALL SELECT '===='")
def _(spark, d):
    r = stats.result_stats(matching(C.docs(spark, d), docs_request(f"d=3000&{_ALL}"))).first()
    return spark.createDataFrame([(x,) for x in render.footer(r.hits, r.chars, 0.0) if not x.startswith("TIME")], "line string")


_CUSTOMERS = f"SELECT c_custkey AS record_id, concat_ws(chr(9), CAST(c_custkey AS VARCHAR), c_name, c_mktsegment) AS raw_line, {_place('c_custkey')} FROM customer"


@query(
    "result_lines",
    f"""WITH c AS ({_CUSTOMERS}), h AS (SELECT *, {MILES} AS miles, {sql_compass()} AS compass FROM c ORDER BY miles, record_id LIMIT 20)
 SELECT concat_ws(chr(9), raw_line, CAST(lat AS VARCHAR), CAST(lon AS VARCHAR), CAST(round(miles * 1609.343994140625, 3) AS VARCHAR), compass, '') AS line FROM h""",
)
def _(spark, d):
    return render.lines(search(C.customers(spark, d), parse(f"{AT}&numfind=20", ["name", "segment"], ["acctbal", "nationkey"])))
