"""Main texts of pages of many shapes, against the blocks they were built from."""

import random

import numpy as np
import pytest

from plumbline.llm import html

ARTICLE = ["A title", "The first paragraph has a good many words, and a comma or two, so that it looks like text.", "Short one.", "The second paragraph goes on for a while as well, with words enough to be told from a menu."]
BODY = f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p><p>{ARTICLE[3]}</p>"
WHOLE = "\n".join(ARTICLE)


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "related-work", "menu-open", "social-science", "with-comments", "sidebar-left", "navigator"])
def test_classes_around_the_article_tell_nothing(name):
    assert html.main_text(f'<body><div class="x {name}">{BODY}</div><nav><a>Home</a></nav></body>') == WHOLE


@pytest.mark.parametrize("name", ["ad", "ads-wrapper", "comments-area", "comment-list", "cookie-notice", "newsletter-signup", "share-buttons", "related-posts", "site-footer", "sidebar", "breadcrumbs"])
def test_marked_blocks_go(name):
    noise = "<p>Somebody wrote quite a lot of words here, none of which belong to the article of this page.</p>"
    assert html.main_text(f'<body><div>{BODY}<div class="{name}">{noise}</div></div><div id="{name}">{noise}</div></body>') == WHOLE


def test_foreign_elements_close_by_a_slash():
    assert html.main_text("<article><p>foo<svg/>bar</p><p>x<svg><path/><rect></rect></svg>y <math/>z</p></article>") == "foobar\nxy z"


def test_only_white_space_is_white_space():
    assert html.main_text("<p>a​b﻿c⁠d&nbsp;&nbsp;e　f\n\tg</p>") == "a​b﻿c⁠d e f g"


def test_a_form_around_the_whole_page():
    assert html.main_text(f"<body><form>{BODY}</form></body>") == WHOLE
    assert html.main_text("<body><form><p>Nothing but a form of several words here.</p></form></body>") == "Nothing but a form of several words here."
    assert html.main_text(f"<body><article>{BODY}</article><form><p>Write to us about anything at all that you want to say.</p></form></body>") == WHOLE


def test_ratios_choose_the_region(monkeypatch):
    menu = "".join(f"<li><a href='/{k}'>{k} entry</a></li>" for k in range(12))
    page = f"<body><div><ul>{menu}</ul></div><div><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p><p>{ARTICLE[3]}</p></div><div><span>©</span><i>x</i><b>y</b><u>z</u></div></body>"
    text = "\n".join(ARTICLE[1:])
    assert html.main_text(page) == text
    inside = f"<main><div><ul>{menu}</ul></div><div><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p><p>{ARTICLE[3]}</p></div></main>"
    assert html.main_text(inside) == text
    in_one = f"<article><p>{ARTICLE[1]}</p><ul>{menu}</ul><p>{ARTICLE[3]}</p><ul><li>{ARTICLE[2]}</li></ul></article>"
    assert html.main_text(in_one) == "\n".join([ARTICLE[1], ARTICLE[3], ARTICLE[2]])
    monkeypatch.setattr(html, "content_lines", lambda ratios: np.arange(len(ratios)) < 8)  # the menu counts as content
    assert html.main_text(page) != text and html.main_text(inside) != text


def test_content_lines_against_a_restatement():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        ratios = rng.gamma(1.0, 40.0, n)
        logs = np.log1p(ratios)
        smooth = []
        for i in range(n):  # a Gaussian over three lines on each side, the edges repeated
            weights = [np.exp(-0.5 * d * d) for d in range(-3, 4)]
            smooth.append(sum(w * logs[min(max(i + d, 0), n - 1)] for w, d in zip(weights, range(-3, 4))) / sum(weights))
        got = html.content_lines(ratios)
        high, low = [s for s, g in zip(smooth, got) if g], [s for s, g in zip(smooth, got) if not g]
        assert high and (not low or max(low) < min(high))
        if low:  # the threshold stands midway between the means
            middle = (np.mean(high) + np.mean(low)) / 2
            assert max(low) < middle <= min(high) + 1e-9


def built(rng):
    """A page and the blocks of its article."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    blocks = [words(rng.randrange(4, 9)), *(words(rng.randrange(1, 60)) for _ in range(rng.randrange(3, 15)))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" if rng.random() < 0.8 else f"<blockquote><b>{b}</b></blockquote>" for b in blocks[1:])
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(rng.randrange(3, 9))) + "</ul>"
    holder = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article class='post'>{}</article></main>", "<div class='page has-sidebar'><article>{}</article></div>"])
    page = f"<html><head><title>{words(5)}</title><style>p{{}}</style></head><body><header><p>{words(9)}</p></header><nav>{menu}</nav><div class='ad'>{words(12)}</div>{holder.format(body)}"
    return page + f"<aside>{words(20)}</aside><section id='comments'><p>{words(40)}</p></section><footer>{words(15)}</footer><script>var x = '<p>no</p>'</script></body></html>", blocks


def test_built_pages():
    rng = random.Random(8)
    for _ in range(300):
        page, blocks = built(rng)
        assert html.main_text(page) == "\n".join(blocks)


def test_rows_of_every_kind(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html.extract_main_text(none).count() == 0
    long = "<article>" + "<p>some words of a paragraph</p>" * 40_000 + "</article>"
    deep = "<div>" * 3000 + "<p>deep down</p>"
    rows = [(1, "u", long, 5), (1, "u", long, 5), (2, None, deep, None), (None, "v", None, 1), (3, "w", "<<<>&#xFFFFFFFF;&bogus", 1)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(((r.page_id or 0), len(r.text)) for r in got)[:2] == [(0, 0), (1, 40_000 * 26 + 39_999 - 40_000)]
    assert {r.page_id: r.text for r in got}[2] == "deep down"
