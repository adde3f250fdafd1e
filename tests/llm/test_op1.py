import html as h
import re
import time
from collections import Counter

import numpy as np

from spindrift.llm import html


def test_tree_fits_its_table():
    x, y = html.labelled()
    assert (html.tree().predict(x) == (y == 1)).mean() > 0.97
    assert 0.3 < y.mean() < 0.8


def test_generated_pages(spark):
    """On pages with an article, against the text between its tags."""
    pages = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = dict(zip((i for i, _ in pages), html.main_texts([p for _, p in pages])))
    for i, page in pages:
        assert got[i] == "\n".join(content(page))


def content(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " " if "br" in inner else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return [b for b in blocks if b]


def test_neighbours_decide_where_marks_are_missing(spark):
    """Block F1 on the generated pages without classes, ids and roles, and with plain div elements."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [re.sub(r"<(/?)(?:article|main|nav|aside|footer|header|section)\b", r"<\1div", re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", p)) for p in pages]
    both = [(Counter(got.split("\n")), Counter(content(p))) for got, p in zip(html.main_texts(plain), pages)]
    same, found, wanted = (sum(f(a, b).total() for a, b in both) for f in (lambda a, b: a & b, lambda a, b: a, lambda a, b: b))
    assert 2 * same / (found + wanted) >= 0.95


def test_long_pages_take_time_in_proportion():
    k = 100_000
    for page in ("<div>" * k + "</section>" * k, "<b><p>" + "<i>" * k + "</b>" * k, "<title>" * k + "<select>" * k, "<p>" + "<i> </i>" * k, "<a 'x" * k, "<!--" * k):
        began = time.perf_counter()
        html.blocks(page)
        assert time.perf_counter() - began < 20, page[:40]


def test_templates():
    cases = {
        "": "",
        None: "",
        "plain words": None,
        "<article><h1>T</h1><p>a&amp;b  c\n d&nbsp;e<script>x='<p>no'</script><!-- no --></p><p>Y<b>o</b>u</p></article>": "T\na&b c d e\nYou",
        "<body class='has-sidebar'><main><p>One<p>Two</main><footer><p>No</footer>": "One\nTwo",
        "<article><p>One<div class='advert-box'><p>Buy</div><p>Two</p><div id='comments'><article><p>Reader</article></div></article>": "One\nTwo",
        "<nav><ul><li><a href='/a'>A</a></ul></nav><article><p>In<a href=x>a link</a></p></article><div class='cookie notice'>We use</div>": "Ina link",
        "<article><p>open <b>tags<p>next</article><p>outside": "open tags\nnext",
        "<article><style>p{}</style><p title='a>b'>text</p><form><label>Name</label><input value=x></form></article>": "text",
        "<article><p>" + "w " * 200000 + "</article>": "w " * 199999 + "w",
        "<article><p>a < b and c > d &lt;p&gt;</article>": "a < b and c > d <p>",
        "<article><p>cut off <b": None,
        "<head><title>not shown<body><article><p>One two<p>Three</article>": "One two\nThree",
    }
    for page, want in cases.items():
        got = html.main_texts([page])[0]
        assert want is None or got == want, (page, got)


def test_query_and_nulls(spark, tmp_path):
    rows = [(1, "u", "<article><p>é🙂</p></article>", "x"), (2, None, None, "y"), (None, "u", "", "z"), (1, "u", "<article><p>é🙂</p></article>", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html.op1_html(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, [(1, "u", "é🙂", 2), (2, None, "", 0), (None, "u", "", 0), (1, "u", "é🙂", 2)]))
    assert html.extracted(spark.createDataFrame([], "html string")).count() == 0


def test_cart_on_a_known_rule():
    rnd = np.random.default_rng(1)
    x = rnd.random((400, 4))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    assert (html.Tree(x, y).predict(x) == (y == 1)).all()
