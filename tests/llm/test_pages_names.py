import pytest

from tempora.llm import pages

BODY = "<p>First paragraph of the article, quite long, with many words.</p><p>Second one goes on, long enough to count.</p>"
WANT = "First paragraph of the article, quite long, with many words. Second one goes on, long enough to count."


@pytest.mark.parametrize("name", ["content has-sidebar", "overflow-hidden", "no-header", "page with-nav", "hidden", "header"])
def test_a_wrapper_of_the_article_stays(name):
    assert pages.main_text(f'<body><div class="{name}">{BODY}</div></body>') == WANT
    assert pages.main_text(f'<body><div id="{name}"><main>{BODY}</main></div></body>') == WANT


@pytest.mark.parametrize("name", ["article-header", "post-header"])
def test_the_head_of_an_article_stays(name):
    head = "The heading of it all and its lead, which is long enough to count as text."
    got = pages.main_text(f'<article><div class="{name}"><h1>{head}</h1></div>{BODY}</article>')
    assert got == f"{head} {WANT}"


@pytest.mark.parametrize("name", ["ad", "x sidebar y", "cookie-notice", "share-buttons", "related_links", "comments"])
def test_named_noise_goes(name):
    noise = f'<div class="{name}"><p>Some other words that are no part of it.</p></div>'
    assert pages.main_text(f"<body><div>{noise}{BODY}{noise}</div></body>") == WANT
    assert pages.main_text(f"<article>{BODY}{noise}</article>") == WANT
