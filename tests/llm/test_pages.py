import html
import re

import pytest

from tidemark.llm import catalog, pages

SCHEMA = "page_id long, url string, html string, host string, texts int"


def extract(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)
    return {r.page_id: r.text for r in pages.extract_text(frame).collect()}


def test_given_pages_equal_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r for r in catalog.op13_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", article)).split())
        text = re.sub(r"</?b>", "", article)
        if "<" not in text[-8:]:
            assert got[r.page_id].text == want, r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


PARTS = """<body class="has-sidebar"><header><h1>Site name</h1></header><div id="top-nav">Menu <a href="/">Home</a></div>
<div class="cookie-notice">We use cookies</div><div class="page with-sidebar"><main><article class="post"><header><h2>Title &amp; more</h2>
<span class="by">By Ann</span></header><p>First <b>bo</b>ld.<p>Second&nbsp;one<br>goes   on<div class="ad">Buy now</div>
<blockquote>Quote</blockquote><script>var x = "</p>";</script><form>Mail <input></form><ul><li>one<li>two</ul>
<footer>Posted in news</footer></article><section id="comments"><article class="comment">Nice!</article></section></main>
<aside>Other</aside></div><footer>End</footer><p hidden>secret</p>"""


def test_named_parts_go(spark):
    assert extract(spark, [(1, "http://a.example/1", PARTS)])[1] == "Title & more First bold. Second one goes on Quote one two"


def body(*parts):
    return "<html><body><div class='x1'>" + "".join(f"<div>{p}</div>" for p in parts) + "</div></body></html>"


def test_constant_slots_are_template(spark):
    rows = [(k, f"https://User@Site.example:80/p{k}", body("Welcome to our site", f"Heading {k}", *(f"Text {k} {j}" for j in range(1 + k % 3)), "All rights reserved"))
            for k in range(12)]
    rows += [(20, "https://other.example/", body("Welcome to our site", "Alone"))]  # one page shows no template
    copies = body("Hello", "Same story", "Bye")
    rows += [(30 + k, "https://copies.example/", copies) for k in range(5)]
    got = extract(spark, rows)
    assert all(got[k] == " ".join([f"Heading {k}", *(f"Text {k} {j}" for j in range(1 + k % 3))]) for k in range(12))
    assert got[20] == "Welcome to our site Alone" and {got[30 + k] for k in range(5)} == {"Hello Same story Bye"}


def test_articles_keep_what_few_pages_share(spark):
    page = lambda k, *more: "<article>" + "".join(f"<p>{t}</p>" for t in (f"Story {k} starts here", f"It goes on {k}", *more)) + "</article>"
    rows = [(k, "http://news.example/", page(k, "Subscribe today")) for k in range(10)]
    rows += [(100 + k, "http://quotes.example/", page(k, *(["Shared quote"] if k % 3 else []))) for k in range(10)]
    rows += [(200 + k, "http://near.example/", f"<article><p>Copied one</p><p>Copied two</p><p>Copied three</p><p>{k}</p></article>") for k in range(10)]
    got = extract(spark, rows)
    assert got[3] == "Story 3 starts here It goes on 3" and got[104].endswith("Shared quote") and got[205] == "Copied one Copied two Copied three 5"


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("  \n", ""), ("<", "<"), ("plain &am", "plain &am"), ("<!-- x --> y <!-- z", "y"), ("<![CDATA[x]]>y", "y"),
    ("<p>a<p>b</i></b>c", "a bc"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<b>x</b>y &lt;z&gt; &#233;&eacute;", "xy <z> éé"),
    ("<P CLASS='Sidebar'>s</P><P title='a > b'>t</P>", "t"), ("<div>x" * 3000, " ".join("x" * 3000)), ("<script>a</script", ""),
    ("<div class=widget>all in here</div>", "all in here"), ("<p style='display: none'>h</p>v", "v")])
def test_odd_pages(spark, page, want):
    root, _ = pages.content_tree(page or "")
    assert " ".join(x.text for x in pages.leaves(root)) == want


def test_odd_rows(spark):
    long_ = "<article>" + "".join(f"<p>para {k} of many" for k in range(3000)) + "</article>"
    rows = [(1, None, None), (None, "http://h.example/", ""), (2, "", "<p>x"), (3, "no host", "<p>y"), (4, "http://h.example/a", long_),
            (5, "http://h.example/b", long_.replace("of many", "of more")), (5, "http://h.example/b", "<p>z"), (6, "http://é.example", "<p>w</p>")]
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)
    got = sorted(((r.page_id, r.url, r.n_chars) for r in pages.extract_text(frame).collect()), key=str)
    assert len(got) == len(rows) and {g[2] for g in got if g[0] in (1, None)} == {0} and max(g[2] for g in got) > 40_000
    assert pages.extract_text(frame.limit(0)).count() == 0


def test_tree_matching_keeps_order():
    tree = lambda *t: pages.content_tree("<article>" + "".join(f"<p>{x}" for x in t) + "</article>")[0]
    a, b = tree("x", "t", "y", "end"), tree("t", "q", "end")
    pages.leaves(a), pages.leaves(b)
    weight, pairs = pages.match_trees(a, b, {})
    assert weight == 1 + 1 + 2 + 1 + 2 and sorted((x.text, y.text) for x, y in pairs) == [("end", "end"), ("t", "t")]
