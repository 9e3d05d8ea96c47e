"""Folding of names against Unicode's decomposition, character by character."""

from tapal.functions import scalar as S
from tapal.functions.text_udfs import fold

from tests.test_address import one


def test_folding_like_decomposition(spark):
    values = ["É-a", "ﬁn ½ Ⅳ ㎏", "Ａｂｃ１２", "été", "ß Ł ø", "𝐀𝟗", "ŉ ǆ", "Ç ü ñ Ÿ", "日本", "", "a b", "x²", *[chr(c) + "a" for c in range(0xC0, 0x250, 7)]]
    assert one(spark, values, S.normalize_hierarchy) == [fold(v) for v in values]
