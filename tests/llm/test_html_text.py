"""HTML extraction."""

import html as html_lib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.llm.html_text import EXAMPLES, block_tree, extract_text, main_text
from quarrylens.llm.tree import decide

TREE = block_tree()

MARKED = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it a better one for all readers of it.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   para\twith <a href=x>link</a>&nbsp;text.
<p><b>Unclosed bold<br>next<p>Short.</p><script>var a = "</p><p>no</p>";</script><!-- <p>nor this</p> -->
<aside class="ad">Buy this now and here</aside><ul><li>one<li>two</ul><form><p>Your mail please</p></form></article>
<section id="comments"><article><p>I liked this article a lot and say so here in many words indeed.</p></article></section></main>
<div class="sidebar"><p>Another long text beside the article, which is not a part of it in any way at all.</p></div>
<footer>All rights kept</footer></body></html>"""


def test_tree_fits_its_table():
    assert all((decide(TREE, row) >= 0.5) == bool(label) for row, label in EXAMPLES)


def test_marked_page():
    assert main_text(MARKED, TREE).split("\n\n") == [
        "Title & more",
        "First para with link text.",
        "Unclosed bold next",
        "Short.",
        "one",
        "two",
    ]


def test_unmarked_page():
    long = "This paragraph has quite a few words, so that it is plainly a part of the text of this page."
    page = f"""<div id="menu"><a href=a>Home</a> <a href=b>News</a></div><div><h1>The head line</h1><p>{long}</p>
    <p>Short one.</p><p>{long}</p></div><p><a href=c>More</a> <a href=d>Less</a></p><div class="footer">Copyright</div>"""
    assert main_text(page, TREE).split("\n\n") == ["The head line", long, "Short one.", long]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("a < b & c &gt; d", "a < b & c > d"),
        ("<article><p>cut off <a href='x", "cut off"),
        ("<article><p>one</p>two<p>three", "one\n\ntwo\n\nthree"),
        ("<article><p>&amp;lt;b&amp;gt;</article>", "&lt;b&gt;"),
        ("<article><p title='a > b'>x</p></article>", "x"),
        ("<script>only", ""),
        ("<nav><p>only</p></nav>", ""),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page, TREE) == text


def test_against_a_plain_cut(spark):
    """Random pages of a known form: the article's blocks, and nothing else."""
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        blocks = [" ".join(rng.choice(["a&b", "word", "é", "x<y"]) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 9))]
        body = "".join(f"<p>{html_lib.escape(b)}</p>" for b in blocks)
        menu = "".join(f"<li><a href=/{k}>m{k}</a></li>" for k in range(rng.randint(0, 6)))
        page = f"<body><nav><ul>{menu}</ul></nav><div class='ad'>Buy it</div><article>{body}</article><footer>Foot {i}</footer>"
        rows.append((i, f"u{i}", page))
        want[i] = "\n\n".join(re.sub(r"\s+", " ", b) for b in blocks)
    rows += [(100, None, None), (101, "u", ""), (1, "u1", rows[1][2]), (102, "u", "<article><p>" + "long " * 200_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.withColumn("TEXT", F.lit("old")).withColumn("n_chars", F.lit(-1)).withColumn("more", F.lit(1))
    found = extract_text(pages)
    assert found.columns == ["page_id", "url", "html", "more", "text", "n_chars"]
    got = found.collect()
    assert len(got) == len(rows)
    for row in got:
        expect = want.get(row["page_id"], "")
        if row["page_id"] == 102:
            expect = ("long " * 200_000).strip()
        assert row["text"] == expect and row["n_chars"] == len(expect)
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>one <svg width=1 /> two<p>three</article>", "one two\n\nthree"),
        ("<article><p>one <math/> two<p>three", "one two\n\nthree"),
        ("<article><p>one<p>two <button>Share<p>three</article>", "one\n\ntwo Share\n\nthree"),
        ("<article><object data=x><p>one<p>two</article><p>three", "one\n\ntwo"),
        ("<article><button>a <p>one<p>two <button>hidden</button> three</article>", "a\n\none\n\ntwo three"),
        ("<article><p>one <object>x <object>y</object> z</object> two", "one two"),
        ("<article><p>one <button><div>x<p>y</div></button> two", "one two"),
        ("<article><p>one <svg><title/><style/><g><path d=x></svg> two", "one two"),
        ("<article><p>one <svg><article>x</article></svg> <select><option>a<option>b</select>two", "one two"),
        ("<article><style-guide>one</style-guide> <title-x>two</title-x>", "one two"),
        ("<article><p>one <iframe><p>x</iframe> two <video><a href=v>get it</a></video>", "one two"),
    ],
)
def test_hidden_elements_end(page, text):
    assert main_text(page, TREE) == text
