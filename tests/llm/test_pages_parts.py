"""Which parts of a page are no article, and the density sums by the formula on random trees."""

import math
import random

import pytest

from tempora.llm import pages

BODY = "<p>First paragraph of the article, quite long, with many words.</p><p>Second one goes on, long enough to count.</p>"
WANT = "First paragraph of the article, quite long, with many words. Second one goes on, long enough to count."
OTHER = "<p>" + "Words that somebody else has written below the text, and at great length. " * 6 + "</p>"


@pytest.mark.parametrize("inner", [BODY, f"<main>{BODY}</main>", f"<article>{BODY}</article>", f'<div id="wrap">{BODY}</div>'])
def test_a_form_around_the_page_stays(inner):
    assert pages.main_text(f'<body><form action="/x" id="aspnetForm"><input name="q">{inner}<button>Go</button></form></body>') == WANT


def test_a_form_beside_the_article_goes():
    form = "<form><p>Write to us, please, and leave the address of your own.</p></form>"
    assert pages.main_text(f"<body><article>{BODY}</article>{form}</body>") == WANT
    assert pages.main_text(f"<body><article>{BODY}{form}</article></body>") == WANT
    assert pages.main_text(f"<body><article>{BODY}</article><form>{OTHER}</form></body>") == WANT


def test_hidden_counts_as_a_name_only():
    assert pages.main_text(f'<div>{BODY.replace("<p>", "<p data-v2=" + chr(34) + "hidden gem" + chr(34) + ">")}</div>') == WANT
    for mark in ("hidden", 'hidden=""', 'hidden="until-found"', 'id=x hidden class="y"', 'aria-hidden="true"'):
        assert pages.main_text(f"<div>{BODY}<p {mark}>Words that are not shown to any reader.</p></div>") == WANT


@pytest.mark.parametrize("box", ['<div id="comments">%s</div>', '<div class="post-comments">%s</div>', '<ol class="comment-list"><li>%s</li></ol>'])
def test_comments_longer_than_the_article_go(box):
    assert pages.main_text(f"<body><div>{BODY}</div>{box % OTHER}</body>") == WANT
    assert pages.main_text(f"<body><article>{BODY}</article>{box % OTHER}</body>") == WANT


def test_comments_made_of_articles_go():
    nested = f'<section class="comments"><article>{OTHER}</article><article class="comment">{OTHER}</article></section>'
    assert pages.main_text(f"<body><article>{BODY}{nested}</article></body>") == WANT
    assert pages.main_text(f"<body><div>{BODY}</div>{nested}</body>") == WANT


def test_a_state_of_comments_is_no_name():
    assert pages.main_text(f'<body><div class="post comments-closed">{BODY}</div><p><a href="/">Home</a></p></body>') == WANT
    assert pages.main_text(f'<body><div class="comments"><h1>Head</h1>{BODY}</div><div>x</div></body>').startswith(f"Head {WANT}")


@pytest.mark.parametrize("name", ["cookie-consent-overlay", "main-navigation", "post-comments", "footer-widgets", "sidebar-left", "siteFooter"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_compound_names_go_beside_a_short_article(name, tag):
    short = "<p>One short paragraph is all there is.</p>"
    noise = f'<div class="{name}">{OTHER}</div>'
    assert pages.main_text(f"<body>{noise}<{tag}>{short}</{tag}>{noise}</body>") == "One short paragraph is all there is."


def test_an_advert_longer_than_the_article_goes():
    advert = f'<div class="ad">{OTHER}</div>'
    assert pages.main_text(f"<body>{advert}<article><h1>Short head.</h1><p>Short text.</p></article></body>") == "Short head. Short text."


def test_a_teaser_does_not_hide_the_article_in_a_named_box():
    page = f'<body><div class="header">{OTHER}</div><article><p>Tiny.</p></article></body>'
    assert "somebody else has written" in pages.main_text(page)


def test_the_head_of_main_stays():
    head = "<header><h1>The heading of it all</h1><p>And its lead, which is long enough to count as text.</p></header>"
    got = pages.main_text(f"<body><header><p>Site name and claim.</p></header><main>{head}{BODY}</main></body>")
    assert got == f"The heading of it all And its lead, which is long enough to count as text. {WANT}"


def _random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "p", "a", "b", "section", "span"])
        inner = "" if depth > 3 or rng.random() < 0.4 else _random_page(rng, depth + 1)
        out.append(f"{rng.choice(['', 'Some words ', 'more of them here '])}<{tag}>{rng.choice(['', 'text ', 'longer text, too '])}{inner}</{tag}>")
    return "".join(out)


def _counts(node):
    """Characters, tags, link characters and link tags of a subtree, by recursion."""
    chars = tags = link_chars = link_tags = 0
    for part in node.parts:
        if isinstance(part, str):
            chars += sum(not c.isspace() for c in part)
        else:
            c, t, lc, lt = _counts(part)
            chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt
    return (chars, tags, chars, link_tags + 1) if node.tag == "a" else (chars, tags, link_chars, link_tags)


def _density(node, whole):
    c, t, lc, lt = _counts(node)
    if not c:
        return 0.0
    t, ratio = max(t, 1), c / max(lc, 1) * max(t, 1) / max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e)
    return c / t * max(math.log(max(ratio, 1.0)), 1e-6) / max(math.log(base), 0.1)


@pytest.mark.parametrize("seed", range(20))
def test_densities_and_sums_are_those_of_the_formula(seed):
    root = pages.tree(_random_page(random.Random(seed)))
    whole = _counts(root)
    for node in pages.measure(root):
        assert (node.chars, node.tags, node.link_chars, node.link_tags) == _counts(node)
        assert math.isclose(node.density, _density(node, whole), abs_tol=1e-12)
        assert math.isclose(node.total, sum(_density(p, whole) for p in node.parts if not isinstance(p, str)), abs_tol=1e-9)


def test_empty_tables_repeats_and_clashing_names(spark):
    kind = "page_id long, html string, text string, row string"
    assert pages.extract(spark.createDataFrame([], kind)).count() == 0
    page = f"<article>{BODY}</article>"
    rows = [(1, page, "t", "r"), (1, page, "t", "r"), (None, None, None, None), (2, "", "", ""), (3, "<p>" + "word " * 200_000, "", "")]
    got = pages.extract(spark.createDataFrame(rows, kind)).collect()
    texts = sorted((r["row"]["page_id"] or 0, len(r["text"])) for r in got)
    assert texts == [(0, 0), (1, len(WANT)), (1, len(WANT)), (2, 0), (3, 5 * 200_000 - 1)]
    assert {r["row"]["text"] for r in got if r["row"]["page_id"] == 1} == {"t"}
