import html
import re

from parley.llm import html_extract, queries

MODEL = html_extract.train()


def test_held_out_accuracy():
    right = blocks = pages = exact = 0
    for page in html_extract.labelled_pages(200, seed=777):
        nodes = html_extract.parse(page)
        labels = html_extract._labels(nodes)
        marginals = MODEL.marginals(nodes)
        own = [(y, p) for n, y, p in zip(nodes, labels, marginals, strict=True) if n.tag == "#text"]
        right += sum((p >= 0.5) == y for y, p in own)
        blocks += len(own)
        pages += 1
        exact += all((p >= 0.5) == y for y, p in own)
    assert right / blocks > 0.98 and exact / pages > 0.85


def test_messages_agree_with_enumeration():
    page = '<body><nav><a href=x>one two</a></nav><div class="content"><p>Some text, here.<p>More of it.</div></body>'
    nodes = html_extract.parse(page)
    own = MODEL.evidence(nodes)
    import itertools
    import math

    total, with_one = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(o for o, v in zip(own, y, strict=True) if v) + sum(MODEL.pair[html_extract._kind(n, nodes[n.parent])][y[n.parent]][y[i]] for i, n in enumerate(nodes) if i)
        total += math.exp(score)
        for i, v in enumerate(y):
            with_one[i] += v * math.exp(score)
    for a, b in zip(MODEL.marginals(nodes), with_one, strict=True):
        assert abs(a - b / total) < 1e-6


def test_parts_of_a_page():
    page = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header">Top</header>
    <nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><article><h1>Of a   title</h1><p><b>First one,&nbsp;with &amp; and <i>more</i>.<br>
    and so on.<p>The second paragraph is here, and it says more.</p><div class="ad">Buy this now.</div><form><p>Your mail please</p><input></form>
    <p>The third paragraph ends the text &lt;here&gt;.</p><section class="comments"><h3>Comments</h3><p>I like it a lot, thanks.</p></section></article>
    <aside><p>Something beside the text.</p></aside><div class="cookie-notice">We use cookies.</div><footer>&copy; us</footer>"""
    want = "Of a title\n\nFirst one, with & and more. and so on.\n\nThe second paragraph is here, and it says more.\n\nThe third paragraph ends the text <here>."
    assert MODEL.extract(page) == want


def test_query_matches_the_written_articles(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner))
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = {r.page_id: r for r in queries.op5_html_extract(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert {i: (r.text, r.n_chars) for i, r in got.items()} == {i: (w, len(w)) for i, w in want.items()}


def test_edges(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p", "x"), (4, "u", "<article><p>" + "word, " * 60000 + "end.</p>", None), (4, "u", "</div></p><<>><p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.main_texts(pages, MODEL).collect()
    assert sorted((r.page_id, r.n_chars) for r in got)[:3] == [(1, 0), (2, 0), (3, 0)] and len(got) == 5
    assert max(r.n_chars for r in got) == 360004
    assert html_extract.main_texts(pages.limit(0), MODEL).count() == 0


def test_pages_without_end_of_head_and_body():
    article = "<article><h1>Of a title</h1><p>The first paragraph is here, and it says more.<p>The second one ends the text.</article>"
    want = "Of a title\n\nThe first paragraph is here, and it says more.\n\nThe second one ends the text."
    for start in ("<head><title>x</title><body>", "<html><head><title>x</title>\n<body class=x>", "<head><meta charset=utf-8><title>x</title><style>p{}</style>", "<html><head><title>x</title></head>", "<head><title>x</title><a><body>"):
        assert MODEL.extract(start + article) == want, start
        assert MODEL.extract(start + article + "</body></html>") == want, start
    assert "".join(n.text for n in html_extract.parse("<head><title>x</title> Text of <b>the</b> body.")) == "Text of the body."
    for page in html_extract.labelled_pages(100, seed=778):
        assert MODEL.extract(page.replace("</head>", "").replace("</body></html>", "")) == MODEL.extract(page) != ""


def test_text_of_formulas_and_media_stays():
    page = "<article><p>The sum is <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, and it is used below.<p>See <object data=x>the drawing of it</object> here, please.<p>Hear <audio src=x>a talk</audio> or <video src=x>a film</video> of it.</article>"
    assert MODEL.extract(page) == "The sum is x=2, and it is used below.\n\nSee the drawing of it here, please.\n\nHear a talk or a film of it."


def test_open_and_stray_tags_take_linear_time():
    import time

    took = []
    for n in (4000, 32_000):
        page = "<article>" + "<i>" * n + "<p>Some text." + "</b>" * n + "<div></div>" * n + "</article>"
        began = time.perf_counter()
        html_extract.parse(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0], took
