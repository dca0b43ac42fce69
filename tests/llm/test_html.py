import re

import numpy as np

from keyloom.llm import html_text, queries

MODEL = html_text.trained()


def text(page):
    return html_text.main_text(page, MODEL)


def accuracy(model, pages=80, seed=99):
    rng, good, n = np.random.default_rng(seed), 0, 0
    for _ in range(pages):
        nodes = html_text.parse(html_text._labelled_page(rng))
        y, p = html_text.labels(nodes), model.marginals(nodes)
        blocks = [i for i, x in enumerate(nodes) if x.text]
        good += sum((p[i] >= 0.5) == y[i] for i in blocks)
        n += len(blocks)
    return good / n


def test_held_out_pages_and_what_the_messages_add():
    silent = html_text.TreeModel(MODEL.unary, np.zeros_like(MODEL.pair))
    assert accuracy(MODEL) > 0.97 and accuracy(silent) < 0.85


def brute_marginals(nodes):
    f = html_text.Forest([nodes])
    own = f.scores(MODEL.unary)
    z, out, edges = 0.0, np.zeros(len(nodes)), np.zeros((len(nodes), 4))
    for bits in range(1 << len(nodes)):
        y = [(bits >> i) & 1 for i in range(len(nodes))]
        s = sum(own[i] * y[i] for i in range(len(nodes))) + sum(MODEL.pair[html_text._edge(x), y[x.parent], y[i]] for i, x in enumerate(nodes) if x.parent >= 0)
        w = np.exp(s)
        z += w
        out += w * np.array(y)
        for i, x in enumerate(nodes):
            if x.parent >= 0:
                edges[i, 2 * y[x.parent] + y[i]] += w
    return out / z, edges / z


def test_messages_give_exact_marginals():
    nodes = html_text.parse("<body><nav><a>x</a></nav><article><p>One two.<p>Three</article><div class=ad>y</div></body>")
    assert len(nodes) < 16
    want, edges = brute_marginals(nodes)
    assert np.allclose(MODEL.marginals(nodes), want, atol=1e-6)
    f = html_text.Forest([nodes, nodes])  # trees side by side don't mix
    full, sides = MODEL.beliefs(f, f.scores(MODEL.unary))
    assert np.allclose(html_text._share(full), np.concatenate([want, want]), atol=1e-6)
    assert np.allclose(MODEL.edges(f, sides), np.concatenate([edges, edges]), atol=1e-6)


STORY = "<h1>A title here</h1><p>" + "First sentence of the story. Another one follows here. " * 6 + "</p><p>Second part of the text, with more words.</p>"
WANT = " ".join(re.sub("<[^>]*>", " ", STORY).split())
NAV, FOOT = "<nav><ul><li><a href='/'>Home</a><li><a href='/b'>News</a></ul></nav>", "<footer>&copy; 2020 Site</footer>"


def test_names_that_mislead():
    for tag in ("article", "div"):
        for names in ("post comment-open", "post tag-ads", "category-news", "post-123 post type-post status-publish tag-ads category-sidebar comments-open", "", "x1"):
            assert text(f"<body>{NAV}<{tag} class='{names}'>{STORY}</{tag}>{FOOT}</body>") == WANT, (tag, names)


def test_reader_comments_under_names_not_in_the_training_pages():
    known = {w for line in html_text.NAMES.values() for w in line.split()}
    for name in ("class='audience-notes'", "id=letters", "class='zzqx'", "class='fan-mail'", "class='reader-views'", "id=opinions"):
        said = f"<div {name}><div class=item><p>Great read, thanks a lot.</p></div><div class=item><p>I do not agree with this.</p></div></div>"
        assert text(f"<body>{NAV}<article>{STORY}</article>{said}{FOOT}</body>") == WANT, name
    assert not {"audience-notes", "letters", "zzqx", "fan-mail"} & known


def test_nothing_of_the_article_is_dropped_by_its_element():
    inner = "<p>So <math><mi>E</mi></math> is <svg><text>drawn</text></svg> here.</p><noscript>Plain words.</noscript><object data=x>Instead of it.</object><canvas>Drawn words.</canvas>"
    got = text(f"<body>{NAV}<article>{STORY}{inner}</article>{FOOT}</body>")
    assert got == WANT + " So E is drawn here. Plain words. Instead of it. Drawn words."
    for tag in ("object", "canvas", "noscript", "iframe", "select", "title", "textarea"):  # never closed
        assert "Second part of the text" in text(f"<body>{NAV}<article><p>Start of it all.</p><{tag}>{STORY}</article>{FOOT}</body>"), tag
    late = "Words of the story go on and on here, and they do not stop. " * 12
    assert text(f"<body>{NAV}<article>{STORY}<p>{late} You may subscribe to it.</p></article>{FOOT}</body>").endswith("subscribe to it.")


def test_depth_takes_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        html_text.parse("<b>" * n + "x" + "</i>" * n + "</b>" * n)
        html_text.parse("<b>" + "<div>" * n + "</b>" * n + "<li>" * n + "<p>" * n)
        return time.perf_counter() - began

    seconds(2_000)
    assert seconds(32_000) < 40 * max(seconds(2_000), 0.02)


def test_shapes():
    body = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav><article><h1>A title</h1><p>First &amp; <b>bold</b>\n  text.<p>Second&nbsp;part.<br>More<script>no()</script></article><div class='comments'><p>Nice post, thanks.</p></div><footer>&copy; 2020 Site</footer>"
    assert text(f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>") == "A title First & bold text. Second part. More"
    assert text(body) == "A title First & bold text. Second part. More"
    assert text("<article><p title=it's>One it's.</p><p title='a > b'>Two \"2\".</p></article>") == "One it's. Two \"2\"."
    assert text(None) == "" and text("") == "" and text("<!-- only -->") == "" and text("<script>x") == ""
    for odd in ("<", "<p", "</p>", "<a b='", "<p>" * 3000, "<div>" * 2000 + "x", "&#x110000; &#0;", "<!--", "a" * 300_000):
        text(odd)


def test_every_page_of_the_table(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op2_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == text(pages[r.page_id])  # alone as among others
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split()) and r.n_chars == len(r.text)


def test_nulls_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None, None, "z"), (1, None, None, "z"), (None, "u", "<article><p>Some text here.</p></article>", "z")], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in queries.op2_html_text(spark, str(tmp_path)).collect())
    assert got == [(0, "Some text here.", 15), (1, "", 0), (1, "", 0)]
    spark.createDataFrame([], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert queries.op2_html_text(spark, str(tmp_path)).count() == 0
