"""HTML wrappers inside article elements, on long levels and with copies."""

import time

import pandas as pd
import pytest

from daygrain.llm import html_wrapper


def _rule(pages):
    parts = pd.concat(html_wrapper._fold_pages(iter([pd.DataFrame({"host": "h", "html": pages})])))
    return html_wrapper.decide(html_wrapper._merge(parts))


PAGE = ("<body><div>Home About us</div><{0}><h2>About</h2><h2>Title {1}</h2><p>Body {1} of words that vary {1}.</p>"
        "<div class='mod-12'>Get our app <b>today</b> for free</div><p>Second {1} paragraph.</p>{2}</{1}></{0}><div>All rights reserved</div></body>")


@pytest.mark.parametrize("element", ["article", "main", "div id=story"])
def test_constant_blocks_inside_the_article_go(element):
    pages = [PAGE.format(element, f"n{i} x{i * 7}", "<div class=zz><p>Follow us on paper</p><p>Write to us</p></div>" if i % 4 else "") for i in range(40)]
    rule = _rule(pages)
    for i, page in enumerate(pages):
        text = html_wrapper.extract(page, rule)
        assert "Get our app" not in text and "Follow us" not in text and "Write to us" not in text and "Home" not in text
        assert f"Title n{i} x{i * 7} Body n{i} x{i * 7} of words that vary n{i} x{i * 7}. Second n{i} x{i * 7} paragraph." in text
    if element != "div id=story":  # constant headings of an article stay
        assert html_wrapper.extract(pages[3], rule).startswith("About Title n3")
        alone = html_wrapper.extract(pages[3], None)
        assert "Get our app" in alone and alone != html_wrapper.extract(pages[3], rule)  # only the host's pages tell


def test_rare_and_varied_blocks_inside_the_article_stay():
    pages = [PAGE.format("article", f"n{i}", f"<div class=note><p>{'The same words of a few' if i < 6 else f'Note {i} alone'}</p></div>") for i in range(40)]
    rule = _rule(pages)
    assert "The same words of a few" in html_wrapper.extract(pages[2], rule) and "Note 30 alone" in html_wrapper.extract(pages[30], rule)


def test_copies_of_a_page_are_no_constants():
    copy = "<body><article><h2>One</h2><p>A page that stands here many times.</p><p>All of it is text.</p></article></body>"
    others = [f"<body><article><h2>T{i}</h2><p>Own words {i} of a page.</p><p>More {i}.</p></article></body>" for i in range(8)]
    rule = _rule([copy] * 60 + others)
    assert html_wrapper.extract(copy, rule) == "One A page that stands here many times. All of it is text."
    assert all(html_wrapper.extract(p, rule) == f"T{i} Own words {i} of a page. More {i}." for i, p in enumerate(others))


def test_a_text_that_starts_late_in_a_host():
    """A block that first appears on the eleventh page, and then on all, goes as well."""
    box = "<div class=q>Read our new letter every week</div>"
    pages = [f"<body><article><h2>T{i}</h2><p>Own words {i}.</p>{box if i >= 10 else ''}<p>More {i}.</p></article></body>" for i in range(60)]
    rule = _rule(pages)
    assert [html_wrapper.extract(p, rule) for p in pages] == [f"T{i} Own words {i}. More {i}." for i in range(60)]


def test_articles_of_constants_alone_stay():
    pages = [f"<body><article><p>Nothing is here yet.</p></article><div>{i} words of a counter that varies</div></body>" for i in range(9)]
    assert {html_wrapper.extract(p, _rule(pages)) for p in pages} == {"Nothing is here yet."}


def test_long_levels_take_time_in_proportion():
    def page(k, n=20_000):
        return "<body><article>" + "".join(f"<h2>t{k} {i}</h2><p>words {k} {i} vary</p>" for i in range(n // 2)) + "</article></body>"
    began = time.time()
    whole = html_wrapper._sum(html_wrapper.page_wrapper(page(1)), html_wrapper.page_wrapper(page(2)))
    text = html_wrapper.extract(page(3), html_wrapper.decide(whole))
    assert time.time() - began < 30
    assert text == " ".join(f"t3 {i} words 3 {i} vary" for i in range(10_000))


def test_cuts_keep_order_and_bound_tables():
    a, b = list(range(5000)), [x for x in range(5000) if x % 7] + [9999]
    anchors = html_wrapper._anchors(a, b)
    assert len(anchors) == len(b) - 1 and all(a[i] == b[j] for i, j in anchors)
    for found in (anchors, []):
        cuts = html_wrapper._cuts(len(a), len(b), found)
        assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b)) and cuts == sorted(cuts)
        assert max((x - i) * (z - j) for (i, j), (x, z) in zip(cuts, cuts[1:])) <= 2 * html_wrapper.TABLE
    assert html_wrapper._anchors(["a", "b", "c"], ["c", "a", "b"]) == [(0, 1), (1, 2)]
    assert html_wrapper._anchors([None, "x", "x"], [None, "x"]) == []
