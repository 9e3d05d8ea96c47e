"""Hand-made pages of different build, with what their main text is."""

import numpy as np
import pytest

from tapal.llm import extract

ONE = "The first paragraph tells what happened, with enough words to be read as prose."
TWO = "A second one goes on from there, and it ends with a full stop as well."
THREE = "Finally the story comes to its end, some time after it began."
LINKS = "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(6))

PAGES = {
    "article": (f"<header><h1>Site</h1></header><nav><ul>{LINKS}</ul></nav><article><h1>Title</h1><p>{ONE}</p><p>{TWO}</p></article><footer>All rights reserved.</footer>", f"Title\n{ONE}\n{TWO}"),
    "divs only": (f'<div id="top-menu"><ul>{LINKS}</ul></div><div class="content"><h2>Title</h2><div>{ONE}</div><div>{TWO}</div></div><div class="sidebar">Read also this and that.</div>', f"Title\n{ONE}\n{TWO}"),
    "plain paragraphs": (f"<p>{ONE}<p>{TWO}<p>{THREE}", f"{ONE}\n{TWO}\n{THREE}"),
    "advert inside": (f'<article><p>{ONE}</p><div class="advert"><p>Buy three of them today and pay for two only.</p></div><p>{TWO}</p></article>', f"{ONE}\n{TWO}"),
    "comments": (f'<main><p>{ONE}</p><p>{TWO}</p></main><section id="comments"><h2>Comments</h2><p>I read it all, and I do not agree with a word of it.</p></section>', f"{ONE}\n{TWO}"),
    "table": (f"<article><p>{ONE}</p><table><tr><th>Year</th><th>Cases</th></tr><tr><td>2020</td><td>12</td></tr></table><p>{TWO}</p></article>", f"{ONE}\nYear\nCases\n2020\n12\n{TWO}"),
    "short title and list": (f"<article><h1>X</h1><p>{ONE}</p><ul><li>one</li><li>two</li></ul></article>", f"X\n{ONE}\none\ntwo"),
    "spaces of all kinds": ("<article><p>One　two three&nbsp;four\n\n five.</p><p> </p><p> Six seven eight. </p></article>", "One two three four five.\nSix seven eight."),
    "references": (f"<article><p>Caf&eacute; &amp; bar &#8212; &#x65e5;&#x672c; &lt;b&gt;.</p><p>{ONE}</p></article>", f"Café & bar — 日本 <b>.\n{ONE}"),
    "form and notice": (f'<div class="cookie-notice">We use cookies.</div><article><p>{ONE}</p></article><form><label>Name</label><p>Write to us whenever you like to.</p></form>', ONE),
    "hidden": (f'<article><p>{ONE}</p><p style="display: none">Nobody sees this part of the page.</p><p>{TWO}</p></article>', f"{ONE}\n{TWO}"),
    "scripts": (f'<script>if (a < b) {{ c("</p>") }}</script><style>p {{}}</style><article><p>{ONE}<script>x()</script></p></article><noscript>On!</noscript>', ONE),
    "deep": ("<div>" * 60 + f"<p>{ONE}</p>" + "</div>" * 60 + f"<footer><div><p>{'Imprint '}</p></div></footer>", ONE),
    "link inside prose": (f'<article><p>{ONE} See <a href="/x">the other story</a> for more.</p></article>', f"{ONE} See the other story for more."),
    "only menu": (f"<nav><ul>{LINKS}</ul></nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, expected = PAGES[name]
    assert extract.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{html}</body></html>") == expected


def test_tree_distance():
    root = extract.Node(None)
    a = extract.Node(root)
    b, c = extract.Node(a), extract.Node(a)
    assert [extract.tree_distance(*x) for x in ((b, b), (b, a), (b, c), (root, c), (extract.Node(b), extract.Node(root)))] == [0, 1, 2, 2, 4]


def test_fitted_weights():
    """The fit tells kinds apart where there are enough blocks, and keeps the prior where there are not."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000)
    x = np.stack([np.ones(4000), rng.normal(1 + 2 * y, 0.5), rng.random(4000) * (1 - y), (rng.random(4000) < 0.1 + 0.8 * y) * 1.0], axis=1)
    w = np.array(extract.fitted(x, y))
    assert (((x @ w) > 0) == y).mean() > 0.9
    assert extract.fitted(x[:100], y[:100]) == extract.TEXT_WEIGHTS


def test_fit_does_not_hang_on_the_order(spark):
    rows = [(k, f"u{k}", f"<nav><ul>{LINKS}</ul></nav><article><h1>T</h1>" + f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>" * 2 + "</article>") for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = extract.fit(df.repartition(3))
    assert own == extract.fit(df.orderBy(df.page_id.desc())) != extract.TEXT_WEIGHTS
    assert {r.text for r in extract.extract(df).collect()} == {"\n".join(["T", *[ONE, TWO, THREE] * 2])}
