"""Pages whose article stands in wrappers of all kinds, and markup that is none: each text is written down here."""

import pytest

from tapal.llm import extract

TEXT = "A sentence of the article, with enough words to be the content of this page."
MENU = '<ul class="menu"><li><a href="/">Home</a><li><a href="/a">About</a></ul>'

WRAPPERS = [
    '<div class="main-content has-sidebar">{}</div>', '<article class="post comments-open">{}</article>', '<div class="content no-banner">{}</div>', '<div class="post with-sidebar">{}</div>', '<main class="no-footer">{}</main>',
    '<div class="entry-content js-search-off">{}</div>', '<article class="entry has-header has-footer">{}</article>', '<div class="content sidebar-open">{}</div>', '<section class="story menu-closed">{}</section>', '<div id="content" class="ad-free">{}</div>',
    '<div class="article-body comments-closed">{}</div>', '<article class="post tag-news no-comments">{}</article>', '<div class="post-content share-enabled">{}</div>', '<div class="text is-sponsored-off">{}</div>', '<main class="has-cookie-notice">{}</main>',
    '<article class="post sharing-disabled">{}</article>', '<div class="story without-ads">{}</div>', '<div class="main nav-hidden">{}</div>', '<div class="content hide-sidebar">{}</div>', '<article class="with-related">{}</article>',
    '<div class="content content-with-sidebar">{}</div>', '<article class="post allows-comments">{}</article>', '<div class="body-text show-menu">{}</div>', '<div class="content footer-visible">{}</div>', '<div class="article has_sidebar">{}</div>',
    '<section id="main" class="no-nav">{}</section>', '<div role="main" class="header-active">{}</div>', '<article class="not-sponsored">{}</article>', '<div class="post comment-on">{}</div>', '<div class="main-story has-more-stories">{}</div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_no_class_empties_an_article(wrapper):
    page = f"<html><body>{MENU}{wrapper.format(f'<h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p>')}<div class='sidebar'>Aside text</div></body></html>"
    assert extract.main_text(page) == f"Title\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize("name", ["sidebar", "comments", "comment-body", "site-footer", "nav-menu", "ad", "sidebar-left", "article-footer", "newsletter-signup"])
def test_names_of_other_things(name):
    page = f"<body><article><p>{TEXT}</p><p>{TEXT}</p></article><div class='{name}'>Some other text. Not of the article.</div></body>"
    assert extract.main_text(page) == f"{TEXT}\n{TEXT}"


def test_article_header_and_ownership():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>The title of it</h1></header><p>{TEXT}</p><p>{TEXT}</p></article><div>All rights reserved 2024</div><div>© 2024 The Paper</div></body>"
    assert extract.main_text(page) == f"The title of it\n{TEXT}\n{TEXT}"


ODD = ["<![foo[x]]>", "<![foo[x", "<![CDATA[a > b]]>", "<![if !IE]>", "<![endif]>", "<![", "<![ [", "<!foo>", "<!>", "<!-->", "<?php x ?>", "<!DOCTYPE html [ <!ENTITY x \"y\"> ]>", "<!doctype html [<!ELEMENT a (b)> <!ENTITY c ']>'>]  >", "</ >", "<a b='", "&#xD800;&#99999999999;"]


def test_odd_markup_stops_nothing(spark):
    """Before a page, inside it and at its end: the job goes on, and what stands before it is read."""
    article = f"<article><p>{TEXT}</p></article>"
    pages = [(3 * k + i, "u", page) for k, odd in enumerate(ODD) for i, page in enumerate((odd + article, f"<article><p>{TEXT}</p>{odd}", f"<article><p>{TEXT}</p>{odd}</article>"))]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == 3 * len(ODD)
    for k, odd in enumerate(ODD):
        before, behind, inside = (got[3 * k + i] for i in range(3))
        assert TEXT in behind and TEXT in inside, odd
        if odd.endswith(">") and ";" not in odd:
            assert before == behind == inside == TEXT, odd
