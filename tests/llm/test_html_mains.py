"""Pages with nested and sibling main elements, and main text outside of them."""

from __future__ import annotations

import random
import time

import pytest

from weftline.llm import html_text, queries

LONG = "A sentence that goes on for long enough to count as a line of the main text of this page. "


def test_nested_and_sibling_mains_keep_their_text():
    nested = f"<body><main><h1>Head</h1><p>Intro.</p><article><p>{LONG}</p></article><p>End.</p></main><p>Imprint</p></body>"
    assert html_text.main_text(nested) == f"Head\nIntro.\n{LONG.strip()}\nEnd."
    between = "<p>x</p>" * 9
    siblings = f"<body><article><h2>One</h2><p>{LONG}</p></article>{between}<article><h2>Two</h2><p>Short.</p></article></body>"
    assert html_text.main_text(siblings) == f"One\n{LONG.strip()}\nTwo\nShort."


def test_a_long_line_outside_surges_and_a_short_one_does_not():
    page = f"<body><p>{LONG * 3}</p><p>Imprint</p><article><p>Text.</p></article><p>{LONG}</p></body>"
    assert html_text.main_text(page) == f"{(LONG * 3).strip()}\nText."


PROSE = "Long prose that goes on and on for a good while, so that it counts as text of the page itself."
P = f"<p>{PROSE}</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<main><h1>Big Title</h1><article><p>One.</p></article><article>{P}<p>Two</p></article></main>", ["Big Title", "One.", PROSE, "Two"]),
        (f'<article><div class="related-work">{P}</div><p id="search-algorithms">Short text</p></article>', [PROSE, "Short text"]),
        (f"<header>Site</header><article><header><h1>Head</h1></header>{P}<footer>By me</footer></article>", ["Head", PROSE]),
        (f"<body><div class=ad>Buy now{P}{P}</body>", [PROSE, PROSE]),
        (f"<p title='it's'>hello {PROSE}</p>", [f"hello {PROSE}"]),
        ("a<b", ["a<b"]),
        (f"<div>Home</div><div>About</div>{P}{P}<div>Copyright 2024 by a company</div>", [PROSE, PROSE]),
        (f"<div>Home</div><h1>Title</h1>{P}<p>End.</p>", ["Title", PROSE, "End."]),
        (f"<ul><li><a href=x>Home</a><li><a href=y>About</a></ul>{P}<a href=z>never closed{P}", [PROSE, "never closed", PROSE]),
        (f'<div class="sidebar-left">{P}</div>{P}<div class="cookie-notice">{P}</div><section id=comments>{P}{P}{P}</section>', [PROSE]),
        (f'<div class="widget"><article>{P}</article></div>', [PROSE]),
        ("<article><p>é&amp;&nbsp;x</p><p hidden>no</p><p>  two \n words", ["é& x", "two words"]),
    ],
)
def test_pages_that_mislead(page, text):
    assert html_text.main_text(page) == "\n".join(text)


PARAGRAPHS = [f"Paragraph {i} of a body that lies beside the element it should be in, with some words more." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # the main element is wrong: it holds the heading only, a teaser, or the menu
        (f"<article><h1>T</h1></article><div>{BODY}</div>", ["T", *PARAGRAPHS]),
        (f"<div>{BODY}</div><article><p>Read on.</p></article>", [*PARAGRAPHS, "Read on."]),
        (f"<main><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></main><div>{BODY}</div>", PARAGRAPHS),
        (f"<main><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>{P}<p><a href=c>Source</a></p></main>", [PROSE, "Source"]),
        # none at all
        (f"<h1>Title</h1><p>Short para one.</p>{P}{P}", ["Title", "Short para one.", PROSE, PROSE]),
        (f"<div>\n<h1>Title</h1>\n</div>\n<div>\n<p>Short para one.</p>\n</div>\n<div>{P}{P}</div>", ["Title", "Short para one.", PROSE, PROSE]),
        # parts that names mark, longer than the text
        (f'<div class="cookie-notice">{P}{P}{P}</div><p>Short text. It ends.</p>', ["Short text. It ends."]),
        ('<article><p>One.</p><div class="promo">Longer than the text itself, by far.</div></article>', ["One."]),
        (f'<div class="widget">{P}</div>', [PROSE]),
        (f'<div id="modal"><article>{P}</article></div>', [PROSE]),
    ],
)
def test_windows_decide_where_elements_are_wrong(page, text):
    assert html_text.main_text(page) == "\n".join(text)


def test_windows_and_elements_do_not_always_agree():
    """On made-up pages whose elements are right in two of three the text is right in all of them; all lines in main
    elements would be right in those two only."""
    rng, right, by_tags = random.Random(8), 0, 0
    for k in range(90):
        body = [f"Line {i} of page {k}: " + "word " * rng.randrange(14, 30) + "end." for i in range(rng.randrange(3, 9))]
        inner = "".join(f"<p>{x}</p>" for x in body)
        menu = "<ul>" + "".join(f"<li><a href=x{i}>Item {i}</a></li>" for i in range(5)) + "</ul>"
        page = [f"<main>{inner}</main>{menu}", f"<div>{inner}</div>{menu}<main><p><a href=z>All</a></p></main>", f"{menu}<article>{menu}{inner}</article>"][k % 3]
        right += html_text.main_text(page) == "\n".join(body)
        by_tags += [x.text for x in html_text.lines(page) if x.main and x.text] == body
    assert right == 90 and by_tags == 30


@pytest.mark.parametrize("bad", ["<p a='", '<a x="<a "x=', "<div>", "<div class=ad>", "<!--", "<", '<a x="><a "x=', "<nav>", "<p class=ad>"])
def test_broken_markup_takes_time_in_proportion(bad):
    began = time.process_time()
    html_text.main_text(bad * 20_000)
    assert time.process_time() - began < 5


def test_query_over_odd_rows(spark, tmp_path):
    page = f"<nav>menu</nav><article>{P}</article>"
    rows = [(1, "u", page, 1), (1, "u", page, 1), (None, None, page, 1), (2, "u", None, 1), (3, "u", "", 1), (4, "u", page * 2000, 1)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int").write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in queries.op10_html_text(spark, str(tmp_path)).collect())
    whole = "\n".join([PROSE] * 2000)
    assert found == [(0, None, PROSE, len(PROSE)), (1, "u", PROSE, len(PROSE)), (1, "u", PROSE, len(PROSE)), (2, "u", "", 0), (3, "u", "", 0), (4, "u", whole, len(whole))]
