import json
import random

import duckdb
import pytest

from trackmill.llm import html_wrapper as W
from trackmill.llm.html_tree import Page

SCHEMA = "page_id long, url string, html string"


def text_of(source):
    return "\n".join(b.text for b in Page(source).article())


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
        ("<article><h1>T</h1><p><b>x.<br><p>y</article><footer>f</footer>", "T\nx.\ny"),
        ("<nav><a href=1>m</a></nav><main><p>one\n\t two</p></main><aside>s</aside>", "one two"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes<!-- no <p> --> on</p>", "yes on"),
        ("<p>5 < 6 &lt;b&gt; &#65;&#x42; &eacute; &ampx &bogus;</p>", "5 < 6 <b> AB é &x &bogus;"),
        ("<div class='site-header'>h</div><div id=cookie-bar>c</div><p>t</p><div class=\"ad\">a</div>", "t"),
        ("<article><header><h1>T</h1></header><p>t</p><div class='share'>s</div><footer>tags</footer></article>", "T\nt"),
        ("<article><h1>T</h1><p>t</article><section class=comments><article class='comment'><p>reader</article></section>", "T\nt"),
        ("<article class=teaser><p>other</article><article><h1>T</h1><p>t</article>", "T\nt"),
        ("<div class='has-sidebar'><p>t</p></div><div class=sidebar>s</div>", "t"),
        ("<p>a <span class=ad>ad <b>x</b></span> b</p><span class=ad><div>ad</div></span><p hidden>h<p style='display: none'>n<p>c", "a b\nc"),
        ("<form><p>f<input value='>'></p></form><button>b</button><select><option>1<option>2</select><p>t", "t"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>t <a href=4>link</a></p>", "t link"),
        ("<p title=\"a > b\" data-x='<p>'>t</p><p class=don't>u</p>", "t\nu"),
        ("<p title=\"never closed>t</p><p>u</p>", "t\nu"),
        ("<p>t</p><a href=", "t"),
        ("<P>T</P><SCRIPT>x</sCript ><p>u</p></div></article>", "T\nu"),
        ("<head><title>n</title><p>t", "t"),
        ("<noscript>n</noscript><iframe>n</iframe><textarea>n</textarea><p>t  u", "t u"),
        ("<div class=comments><article><h1>T</h1><p>all there is</article></div>", "T\nall there is"),
        ("<div id=content><p>long enough to be the most of the page</p></div><div><p>rest</p></div>", "long enough to be the most of the page"),
        ("<a href=1><h2>in a link</h2></a><p>t", "in a link\nt"),
    ],
)
def test_markup(source, want):
    assert text_of(source) == want


def test_long_deep_and_broken_pages_take_linear_time():
    assert text_of("<div>" * 30000 + "t") == "t"
    assert text_of("<p>x" * 60000).count("\n") == 59999
    assert text_of("<span id=a>" * 50000 + "<p>t") == "t"
    assert len(text_of('<a "' * 40000)) == 0 and text_of('<p x="' * 20000 + ">t") == "t"
    assert text_of("<" * 50000) == "<" * 50000
    assert text_of("<p>a<ul><li>b</ul>" * 20000).count("\n") == 39999


def random_tree(rng, depth=3):
    return [rng.choice("abc"), [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []]


def plain_match(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_match(x, y))
    return 1 + m[-1][-1]


def preorder(tree, up=-1, out=None):
    out = [] if out is None else out
    here = len(out)
    out.append((tree[0], up))
    for c in tree[1]:
        preorder(c, here, out)
    return out


def test_matching_is_simple_tree_matching():
    rng = random.Random(1)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        m = W.Matcher(json.dumps(a), json.dumps(b))
        places = m.mapping()
        pairs = [(i, j) for i, j in enumerate(places) if j >= 0]
        assert m.size(m.a, m.b) == plain_match(a, b) == len(pairs)
        na, nb = preorder(a), preorder(b)
        assert all(na[i][0] == nb[j][0] for i, j in pairs)
        assert all(places[na[i][1]] == nb[j][1] for i, j in pairs if i)
        assert [j for _, j in pairs] == sorted(j for _, j in pairs)


def site(host, n, body):
    return [(i, f"http://{host}/{i}", body(i)) for i in range(n)]


def extracted(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return {(r.page_id, r.url): r.text for r in W.main_texts(df).collect()}


def test_constant_slots_are_template_without_any_names(spark):
    words = "lorem ipsum dolor sit amet".split()
    a = site("a.x", 6, lambda i: f"<div><div>Our shop<br>Tel 1</div><div><h2>Title {i}</h2>{'<p>text %d</p>' % i * (1 + i % 3)}<p><i>again</i> {words[i % 5]}</p></div>" + ("<blockquote>extra</blockquote>" if i % 2 else "") + "<div>All rights reserved</div></div>")
    b = site("b.x", 2, lambda i: f"<div>Our shop</div><p>page {i}</p>")  # too few pages for a template
    c = site("c.x", 9, lambda i: "<div>copied</div><p>whole page</p>")  # copies are one page
    got = extracted(spark, a + b + c)
    for i in range(6):
        want = [f"Title {i}", *[f"text {i}"] * (1 + i % 3), f"again {words[i % 5]}"]
        text = got[i, f"http://a.x/{i}"].split("\n")
        assert text[: len(want)] == want and not {"Our shop Tel 1", "All rights reserved"} & set(text), text
    assert got[0, "http://b.x/0"] == "Our shop\npage 0" and got[3, "http://c.x/3"] == "copied\nwhole page"


def test_articles_keep_what_their_host_repeats(spark):
    page = lambda i: f"<div>frame</div><article><h1>One title</h1><p>text {i}</p><p>licence line</p><div>Read on {'' if i else i}</div></article>"
    few, many = extracted(spark, site("a.x", 4, page)), extracted(spark, site("a.x", 20, page))
    assert few[2, "http://a.x/2"] == "One title\ntext 2\nlicence line\nRead on"
    assert many[2, "http://a.x/2"] == "One title\ntext 2\nlicence line"


def test_a_host_of_one_article_keeps_it(spark):
    """Pages that differ in their menus and adverts only are copies of an article, not its template."""
    rows = site("a.x", 12, lambda i: f"<nav><ul><li><a href=/{i}>menu {i}</a></ul></nav><div class=ad>buy {i}</div><article><h1>One title</h1><p>The only text.</article>")
    assert set(extracted(spark, rows).values()) == {"One title\nThe only text."}


def test_odd_rows(spark, edge_texts):
    rows = [(i, [None, "", "no host", "http://h.x/1", "//u:p@H.X:80/2"][i % 5], t, 1, "s", [1]) for i, t in enumerate(edge_texts)]
    rows += [(None, "http://h.x/3", "<p>no id", 1, "s", [1])] * 2
    df = spark.createDataFrame(rows, SCHEMA + ", host int, shape string, parts array<int>").repartition(2)
    out = W.main_texts(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id is None} == {"no id"}
    assert W.main_texts(df.limit(0)).collect() == []


def test_hosts(spark):
    urls = ["http://A.x/b", "https://u:p@a.x:80?q", "//a.x", "a.x/b", None, "mailto:a@b", "http:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(W.host_of(df.url)).collect()] == ["a.x", "a.x", "a.x", "", "", "", ""]


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    out = W.main_texts(spark.read.parquet(f"{sf}/pages.parquet"))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({W.ORACLE})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
