import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed + i * 13) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    a, block = prose(1, 120), "\n".join(f"shared line {i} of the block" for i in range(12))
    rows = [
        (1, a, "en", "s"), (2, a, "en", "s"), (3, a + " tail", "en", None), (None, a, "en", "s"), (4, None, None, None), (5, "", "en", "s"), (5, "", "en", "s"), (6, "one", "xx", "s"),
        (7, prose(2, 60) + "\n" + block, "en", "s"), (8, prose(3, 60) + "\n" + block, "en", "s"), (9, "x" * 100_000, "de", "s"), (10, prose(4, 20_000), "en", "s"), (11, prose(5, 80), "en", "s"), (11, prose(6, 80), "en", "s"),
        (12, "的 是 不 了 😀", "fr", "s"), (13, " \t\n ", "en", "s"), (None, None, None, None), (14, "a\x00b\n\nc", "es", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", "1 as _id", "'k' as _th", "2 as fp", "3 as ids", "4 as _row", "5 as n_words", "6 as label", "7 as _text", "8 as decoded", "9 as gone")
