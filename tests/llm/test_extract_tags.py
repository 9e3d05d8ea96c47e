import pytest

from tapal.llm import extract

TEXT = "A sentence of the article, with enough words to be the content of this page."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><body><article><p>{}</p></article></body></html>",
        "<head><title>T</title><meta charset=utf-8><article><p>{}</p></article>",
        "<head><noscript><style>p{{}}</style><body><article><p>{}</p></article>",
        "<body><button>Press<article><p>{}</p></article>",
        "<body><select><option>One<option>Two<article><p>{}</p></article>",
        "<head><title>T</title>{}",
        "<body><noscript><p>Switch scripts on.</p></noscript><article><p>{}</p></article>",
    ],
)
def test_unclosed_silent_elements(spark, page):
    df = spark.createDataFrame([(1, "u", page.format(TEXT))], "page_id long, url string, html string")
    assert [r.text for r in extract.extract(df).collect()] == [TEXT]
