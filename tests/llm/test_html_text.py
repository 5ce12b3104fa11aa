import html
import re
import time

import pytest

from statera.llm import html_text
from statera.llm.queries import QUERIES
from tests.llm.cases import SF, texts

PAGE = """<html><head><title>T</title><style>x{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header><div id="cookie-notice">We use cookies to improve your
experience on this site.</div><div class=menu><a href=/>Home</a> <a href=/a>About us</a></div>%s<aside><h3>Related</h3><ul><li><a>One</a><li><a>Two</a></ul></aside>
<section class="comments"><p>I really liked this article a lot, thank you so much for writing it.</p></section><form><label>Your name</label></form><footer>Copyright 2020</footer></body></html>"""
BODIES = [
    ('<article><h2>Head &amp; line</h2><p>First <b>para</b>graph.</p><p>Two.</p></article>', "Head & line First paragraph. Two."),
    ('<div class="post-content"><h2>Headline here</h2><p>First paragraph has a <a href=x>link</a> and more text that goes on for quite a while, really.</p><p>Short one.</p><script>"<p>no</p>"</script></div>',
     "Headline here First paragraph has a link and more text that goes on for quite a while, really. Short one."),
    ('<main><p>a &lt; b\n\n  c</p><!-- no --><ul><li>one point<li>another point</ul><p>End.</p></main>', "a < b c one point another point End."),
]


@pytest.mark.parametrize(("body", "text"), BODIES)
def test_articles_come_out_whole(body, text):
    assert html_text.main_text(PAGE % body) == text


@pytest.mark.parametrize(("page", "text"), [("", ""), (None, ""), ("plain text", "plain text"), ("<p>cut &am", "cut &am"), ("<article><p>x<5 and 3>2 <a hre", "x<5 and 3>2"), ("<script>unclosed <p>x</p>", ""), ("<p>" * 3000 + "deep", "deep")])
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_tree_fits_its_table():
    x, y = html_text.labelled()
    assert len(y) < 400 and (html_text.said_by(html_text.tree(), x) == y).mean() > 0.95


def test_names_alone_do_not_decide():
    """Without the column of names the tree still tells most labelled blocks."""
    x, y = html_text.labelled()
    x[:, html_text.FEATURES.index("named")] = 0
    assert (html_text.said_by(html_text.tree(), x) == y).mean() > 0.8


LONG, MORE = "word " * 60, "text " * 45


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # neither an article nor class names
        (f"<div><a>Home</a> <a>About us</a></div><h1>The title of it</h1><p>{LONG}<p>{MORE}<p>A short end.<div>Copyright 2024 Some Corp</div>", f"The title of it {LONG}{MORE}A short end."),
        (f"<table><tr><td><a>Home</a><td><a>News</a></table><h2>Head line here now</h2><p>{LONG}</p><p>{MORE}</p><p>&copy; 2024 by the owners</p>", f"Head line here now {LONG}{MORE}".strip()),
        (f"<ul><li><a>One</a><li><a>Two</a></ul><div>{LONG}</div><div>{MORE}</div><div><a>Next page</a> <a>Last page</a></div>", f"{LONG}{MORE}".strip()),
        (f"<p>{LONG}<p><a>see the whole of this other text on that page</a><p>{MORE}", f"{LONG}see the whole of this other text on that page {MORE}".strip()),
        # names that hold a main-like word too
        (f"<p>{LONG}<p>{MORE}<div class='main-notice'><p>We use cookies here</p></div><div class='page sidebar'><p>{MORE}</p></div><div class=related-content><a>More of this</a></div>", f"{LONG}{MORE}".strip()),
        (f"<p>{LONG}<p>{MORE}<div class='content comments'><p>I liked it a lot</p><p>{LONG}</p></div>", f"{LONG}{MORE}".strip()),
        (f"<body class='page has-sidebar with-comments'><div class='content no-ads'><p>{LONG}<p>{MORE}</div>", f"{LONG}{MORE}".strip()),
        # linked paragraphs and list items of an article
        ("<article><p><a>This whole paragraph is a link to some page</a><p>And text.<ul><li><a>First source</a><li><a>Second source</a></ul></article>", "This whole paragraph is a link to some page And text. First source Second source"),
        ("<div role=main><p><a>All of it linked</a></p></div><p>Outside of it all.</p>", "All of it linked"),
        # an article inside an article is a reader's comment
        (f"<article><p>{MORE}</p><article><p>{LONG}</p></article><p>End.</p></article>", f"{MORE}End."),
    ],
)
def test_labelled_pages(page, text):
    assert html_text.main_text(page) == text


def test_hostile_pages_take_linear_time():
    pages = [x * (1_000_000 // len(x)) for x in ("<style", "<script", "<svg", "<script>", "<!--", '<a "', "<a ' \"", "<div>", "</p>", "<span class=ad>", "<b class=ad><div>", "<title><script><body")]
    pages += ["<span class=ad>" * 50_000 + "<hr>" * 50_000 + "</b>" * 50_000, "<p>" + "<div>" * 100_000 + "</p>" * 100_000]
    start = time.process_time()
    for page in pages:
        html_text.main_text(page)
    assert time.process_time() - start < 60


def test_quotes_that_do_not_close():
    assert html_text.main_text("<article><p>one<p title='x>two</p><p>three</article>") == "one two three"
    assert html_text.main_text("<article><p title='a>b'>one</p><p title=\"it's > all\">two</p></article>") == "one two"


def test_links_in_and_after_an_article():
    long = "word " * 60
    sources = "".join(f"<li><a href=x>Title of the source number {i} and its year</a>" for i in range(5))
    page = f"<article><p>A short start.</p><p><a href=x>see this page and that one</a> for more of it all</p><p>{long}</p><ul>{sources}</ul></article><footer><a href=/>Home page</a></footer>"
    titles = " ".join(f"Title of the source number {i} and its year" for i in range(5))
    assert html_text.main_text(page) == f"A short start. see this page and that one for more of it all {long}{titles}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>A long sentence <span class="notice">x</span> and the rest of it.</p><p>Next.</p></article>', "A long sentence and the rest of it. Next."),
        ("<article><p>A long <b class=ad>x</b> sentence<p>goes on <sup class=share>y</sup> here<p>to its end</article>", "A long sentence goes on here to its end"),
        ("<article><p>Never <span class=promo>closed<p>The next one<p>and one more</article>", "Never The next one and one more"),
        ("<article><p>One <span class=notice>a <span>b <span>c</span></span> d</span> two</p></article>", "One two"),
        ("<article><p>One <label class=menu>a <b>b</label> two</b> three</p></article>", "One two three"),
        ("<article><h2>Head <small class=share>x</small> line</h2><p>Text of it.</p></article>", "Head line Text of it."),
        ("<article><p>One</span> two</p></article>", "One two"),
        ("<article><span class=sidebar><div>a</span> b</div></span><p>Text</p></article>", "Text"),
    ],
)
def test_a_named_inline_element_ends_where_it_is_closed(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>one <svg class=i/> two</p><p>three</p></article>", "one two three"),
        ("<article><p>one <svg/> keep me</p><p>keep too <svg><text>no</text></svg> end</p></article>", "one keep me keep too end"),
        ("<article><p>one <math/> two <MATH><mi>x</mi></MATH> three</p></article>", "one two three"),
        ("<article><p>one <svg class=i> two</p><p>three</p></article>", "one two three"),
        *((f"<article><p>one <{tag} class=x> two</p><p>three</p></article>", "one two three") for tag in ("button", "object", "noscript", "video", "audio", "canvas", "select")),
        ("<article><p>one <button>two</p><p>three <button>no</button> four</p></article>", "one two three four"),
        ("<article><p>one <script>no</p><p>no</article>", "one"),
        ("<html><head><title>no</title><article><p>one</p></article>", "one"),
        ("<html><head><title>no</title></head><article><p>one <video>no</video>two</p></article>", "one two"),
        ("<article><p>one <object><object>no</object> two</p></article>", "one two"),
        ("<article><header><p>one</p></header></article>", "one"),
    ],
)
def test_hidden_elements_hide_themselves_alone(page, text):
    assert html_text.main_text(page) == text


def test_many_unclosed_hidden_elements_take_linear_time():
    assert html_text.main_text("<article>" + "<p>word <svg> and <button> more" * 30_000).count("word") == 30_000


def test_edge_cases(spark):
    rows = [(1, "u", None, "t", 5), (2, None, "", "t", 5), (2, None, "", "t", 5), (None, "u", "<p>" + "long words here " * 20000, "t", 5)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extracted(docs, ["page_id", "url"]).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, 319_999]
    assert html_text.extracted(docs.limit(0), ["page_id", "url"]).collect() == []


def test_query_against_the_articles(spark):
    got = {r["page_id"]: r["text"] for r in QUERIES["op4_html_text"](spark, SF).collect()}
    for r in texts(f"{SF}/pages.parquet", "page_id", "html"):
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        plain = re.sub(r"</?[bh]1?>", "", re.sub(r"<br>|</?p>|</h1>", " ", article))
        assert got[r["page_id"]] == " ".join(html.unescape(plain).split())


TITLED = "<h1>Title one two</h1>"
WHOLE = f"Title one two {LONG}{MORE}".strip()


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form><div class=menu><a>Home</a></div>{TITLED}<p>{LONG}</p><p>{MORE}</p><div class=footer>foot</div></form>",
        f"<form action=x><article>{TITLED}<p>{LONG}</p><p>{MORE}</p></article><footer>Some words of it</footer></form>",
        f"<div class='site menu-open'>{TITLED}<p>{LONG}</p><p>{MORE}</p></div>",
        f"<div class='social science'>{TITLED}<p>{LONG}</p><p>{MORE}</p></div>",
        f"<nav><a>Home</a></nav><article class='promo story'>{TITLED}<p>{LONG}</p><p>{MORE}</p></article>",
        f"<article>{TITLED}<article><p>{LONG}</p><p>{MORE}</p></article></article>",
        f"<div class='reply-page'>{TITLED}<p>{LONG}</p><p>{MORE}</p></div>",
        # comments and the site's name under names in another language, or none
        f"<div class=kopfzeile>Seitenname</div>{TITLED}<p>{LONG}</p><p>{MORE}</p><div class=kommentare><h3>Zwei Kommentare</h3><div><a>Anna</a></div><p>Das war ein guter Text finde ich sehr</p>"
        "<div><a>Antworten</a></div><div><a>Bert</a></div><p>Ich finde das nicht so gut wie den anderen Text von gestern</p><div><a>Antworten</a></div></div>",
        f"{TITLED}<p>{LONG}</p><p>{MORE}</p><h3>Two answers</h3><div><a>Ann</a></div><div>That was a good text I think</div><div><a>Bob</a></div><div>It was not as good as the other one of yesterday</div><div><a>Reply</a></div>",
    ],
)
def test_pages_that_a_name_or_a_form_surrounds(page):
    assert html_text.main_text(page) == WHOLE


def test_what_only_a_part_of_the_page_is_in_stays_furniture():
    for tag in ("<form>", "<div class=sidebar>", "<div class='user comments'>"):
        assert html_text.main_text(f"{TITLED}<p>{LONG}</p><p>{MORE}</p>{tag}<p>{MORE}</p></div></form>") == WHOLE
    # a long thread of comments is more than the article, but the heading isn't in it
    assert html_text.main_text(f"{TITLED}<p>{MORE}</p><section class=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>") == f"Title one two {MORE}".strip()
    assert html_text.main_text(f"<article>{TITLED}<p>{MORE}</p></article><div class=related><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>") == f"Title one two {MORE}".strip()


def test_short_paragraphs_keep_their_heading():
    page = "<div><a>Home</a> <a>News</a></div><h1>A title of words</h1><p>short para one of some words here</p><p>another short para of words</p><p>a third one that is also short</p>"
    assert html_text.main_text(page) == "A title of words short para one of some words here another short para of words a third one that is also short"


def test_query_by_brute_force(spark):
    """The query's texts, from the blocks by plain loops: neighbours by index, the tree walked block by block."""
    got = {r["page_id"]: r for r in QUERIES["op4_html_text"](spark, SF).collect()}
    for row in texts(f"{SF}/pages.parquet", "page_id", "html"):
        found = html_text.blocks(row["html"] or "")
        article, kept = any(b.zone in (html_text.MAIN, html_text.NESTED) for b in found), []
        for i, b in enumerate(found):
            around = [found[j] if 0 <= j < len(found) else None for j in (i, i - 1, i + 1)]
            values = [v for n in around for v in ((n.words, n.linked / n.words) if n else (0, 0))] + [b.zone, b.heading, b.paragraph, b.named, article]
            node = html_text.tree()
            while isinstance(node, tuple):
                f, cut, left, right = node
                node = left if values[f] <= cut else right
            if node >= 0.5:
                kept.append(b.text)
        text = " ".join(kept)
        assert (got[row["page_id"]]["text"], got[row["page_id"]]["n_chars"]) == (text, len(text))
    assert len(got) == len(texts(f"{SF}/pages.parquet", "page_id"))


def test_frames_against_sums_over_all_blocks():
    """What the marks add up to, from each block's own chain of marks."""
    import random

    draw, seen = random.Random(4), []
    original = html_text._places
    html_text._places = lambda marks, prose, headed: seen.append(([(m.outer, m.prose, m.mains, m.heads) for m in marks], prose)) or original(marks, prose, headed)
    try:
        for _ in range(60):
            opens = ["<div class=menu>", "<form>", "<article>", "<section class=comments>", "<div>"]
            page = "".join(draw.choice([draw.choice(opens), f"<p>{'w ' * draw.randint(1, 9)}</p>", "<h2>head</h2>", "<p><a>x y</a></p>", draw.choice(["</div>", "</form>", "</article>", "</section>"])]) for _ in range(40))
            found = html_text.blocks(page)
            marks, prose = seen[-1]
            assert prose == sum(b.words for b in found if not b.heading and 2 * b.linked < b.words)
            children = {i: sum(p for o, p, _, _ in marks if o == i) for i in range(len(marks))}
            assert all(p >= children[i] for i, (_, p, _, _) in enumerate(marks)) and sum(p for o, p, _, _ in marks if o < 0) <= prose
            assert sum(h for o, _, _, h in marks if o < 0) <= 1
    finally:
        html_text._places = original
