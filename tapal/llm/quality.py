"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those of its
language by Jensen-Shannon distance. A language's common words are those that most of its
documents hold, and its references are sums over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapal.llm.common import cut

#: Common words of a language: so many of those that most of its documents hold, none of more characters than that.
BINS, COMMON_CHARS = 8, 32
WORD = "[\\x20\\x09-\\x0D]+"
#: A document with fewer words is not compared: its histograms are too coarse.
MIN_WORDS = 50
#: Jensen-Shannon distances (base 2, the square root of the divergence) beyond which a document is rejected. A histogram
#: of n words is off by chance with 1 / sqrt(n), so that common words are allowed WORD_SLACK / sqrt(n) more.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.15
WORD_SLACK = 1.0
#: Languages whose references and common words are broadcast at most, 1.3 KB each at most; more of them are joined by key.
BROADCAST_LANGUAGES = 20_000
#: Words that a language needs before its reference is used.
MIN_REFERENCE_WORDS = 1000


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col("_text"), F.lit(pattern))


def _texts(docs: DataFrame) -> DataFrame:
    """docs with _text, _lang (nulls are empty) and the text's _words."""
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return df.withColumn("_words", F.filter(F.split("_text", WORD), lambda w: w != ""))


def common_words(docs: DataFrame) -> DataFrame:
    """(_lang, _list): the BINS words that most of all documents of a language hold, equal counts by the word.

    Counts are summed before the shuffle, and each partition gives on only its first BINS words of a language.
    """
    counts = _texts(docs.select("text", "lang")).select("_lang", F.explode(F.array_distinct("_words")).alias("_word")).where(F.length("_word") <= COMMON_CHARS).groupBy("_lang", "_word").count()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.col("count").desc(), "_word"))
    top = counts.withColumn("_rank", rank).where(F.col("_rank") <= BINS)
    return top.groupBy("_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_word"))), lambda x: x["_word"]).alias("_list"))


def _by_language(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with the columns of table, one row for each language, which is broadcast if it is few; it should be a stored table."""
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_LANGUAGES else table, "_lang", "left")


def features(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs with columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lang, _classes and _common.

    lists has the common words of each language. A null text counts as one without words. Any own columns of these
    names are replaced.
    """
    df = _by_language(_texts(docs.drop("_list")), lists)
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("_bits", F.expr("cast(ceil(log2(n_words + 2)) as int)"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", _count("[#*$%&|<>]").cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # A word window is its hash, shortened by the bits that hold its place; equal neighbours in sorted order are compared by their words.
    df = df.withColumn("_keys", F.expr("case when n_words >= 3 then sort_array(transform(sequence(0, size(_words) - 3), i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | cast(i as bigint))) else array() end"))
    df = df.withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1")).withColumn("_n", F.expr("greatest(size(_keys) - 1, 0)"))
    same = " and ".join(f"_words[cast((p.x & _mask) as int) + {k}] = _words[cast((p.y & _mask) as int) + {k}]" for k in range(3))
    df = df.withColumn("_pairs", F.expr(f"filter(zip_with(slice(_keys, 1, _n), slice(_keys, 2, _n), (x, y) -> if(shiftrightunsigned(x ^ y, _bits) = 0, named_struct('x', x, 'y', y), null)), p -> p is not null and {same})"))
    df = df.withColumn("_at", F.expr("sort_array(array_distinct(concat(transform(_pairs, p -> p.x & _mask), transform(_pairs, p -> p.y & _mask))))"))
    covered = "aggregate(zip_with(slice(_at, 1, size(_at) - 1), slice(_at, 2, size(_at) - 1), (x, y) -> least(y - x, 3L)), 3L, (a, x) -> a + x)"
    df = df.withColumn("n_repeat_words", F.expr(f"case when size(_at) = 0 then 0L else {covered} end"))
    upper, digit, mark = _count("[A-Z]"), _count("[0-9]"), _count("[.,;:!?'\"()\\-]")
    blank = F.length("_text") - F.col("word_chars")
    beyond = F.octet_length("_text") - F.length("_text")
    known = [upper, digit, mark, F.col("n_symbols"), blank, beyond]
    df = df.withColumn("_known", F.array(*[x.cast("double") for x in known]))
    rest = F.length("_text").cast("double") - F.aggregate("_known", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("_classes", F.concat("_known", F.array(F.greatest(rest, F.lit(0.0)))))
    df = df.withColumn("_found", F.filter("_words", lambda w: F.array_contains("_list", w)))
    df = df.withColumn("_own", F.expr(f"transform(sequence(0, {BINS - 1}), i -> cast(coalesce(size(filter(_found, x -> x = get(_list, i))), 0) as double))"))
    # The second use of _found keeps it a column; with one only, it would be moved into the counts and made for each of them.
    df = df.withColumn("_common", F.concat("_own", F.array(F.col("n_words").cast("double") - F.coalesce(F.size("_found"), F.lit(0)))))
    return df.drop("_text", "_words", "_bits", "_lines", "_keys", "_mask", "_n", "_pairs", "_at", "_known", "_found", "_list", "_own")


def references(features_of: DataFrame) -> DataFrame:
    """A row for each language: ref_classes and ref_common, sums over all its documents, and ref_words."""
    sums = [F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(7)] + [F.sum(F.col("_common")[i]).alias(f"w{i}") for i in range(BINS + 1)]
    out = features_of.groupBy("_lang").agg(F.sum("n_words").alias("ref_words"), *sums)
    return out.select("_lang", "ref_words", F.array(*[f"c{i}" for i in range(7)]).alias("ref_classes"), F.array(*[f"w{i}" for i in range(BINS + 1)]).alias("ref_common"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if either is empty."""
    total = "aggregate({0}, 0D, (a, x) -> a + x)"
    part = "if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)"
    scaled = [f"transform({h}, x -> x / {total.format(h)})" for h in (p, q)]
    body = f"sqrt(greatest(aggregate(zip_with({scaled[0]}, {scaled[1]}, (x, y) -> {part}), 0D, (a, x) -> a + x) / 2, 0D))"
    return F.expr(f"case when {total.format(p)} = 0 or {total.format(q)} = 0 then 0D else {body} end")


def judge(features_of: DataFrame, refs: DataFrame) -> DataFrame:
    """features_of with base_failed, class_distance, word_distance and kept.

    refs has a row for each language, and all of them are used. They are broadcast if they are few, as a language may
    hold most of the documents. A document of less than MIN_WORDS words, or of a language whose reference has too few words, keeps the base rules' verdict.
    """
    df = _by_language(features_of, refs.where(F.col("ref_words") >= MIN_REFERENCE_WORDS))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    enough = (F.col("n_words") >= MIN_WORDS) & F.col("ref_words").isNotNull()
    df = df.withColumn("class_distance", F.when(enough, distance("_classes", "ref_classes"))).withColumn("word_distance", F.when(enough, distance("_common", "ref_common")))
    near = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE + WORD_SLACK / F.sqrt("n_words"), F.lit(True))
    return df.withColumn("kept", ~F.col("base_failed") & near)


def quality_rules(docs: DataFrame) -> DataFrame:
    """A verdict for each row of docs (columns doc_id, text, lang; others are ignored).

    Null texts are texts without words and fail the base rules; a null or unknown lang is a language of its own.
    Repeated rows each get a row; an empty table gives an empty result.
    """
    found = cut(features(docs.select("doc_id", "text", "lang"), cut(common_words(docs))).drop("text"))
    return judge(found, cut(references(found)))


def rejected_removed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns."""
    lists = cut(common_words(docs))
    refs = cut(references(features(docs.select("text", "lang"), lists)))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"), F.col("lang"))
    # The place keeps the filter above the features; pushed below, it would compute them once for each use.
    found = features(own, lists).withColumn("_place", F.monotonically_increasing_id())
    return judge(found, refs).where(F.col("kept") & (F.col("_place") >= 0)).select("_row.*")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
