"""Each opN_ query over small tables with odd rows, against a plain version of its contract."""

import base64
import collections
import hashlib
import math
import re

import pytest

from tapal.llm import chat, decontaminate, lines, quality, queries, substrings, tokens, unigram
from tests.llm.conftest import prose
from tests.llm.test_operators import base_rules, components_by_hand, slow_fingerprint, slow_fitting, slow_viterbi

QUERIES = queries.queries()
ITEMS = [(1, prose(4, 30)), (2, None), (3, ""), (4, prose(400, 20)), (4, prose(400, 20))]
ARTICLE = "<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>Words of the article, some of them at least.</p></article></body></html>"
PAGES = [(1, "u1", ARTICLE), (2, "u2", ARTICLE), (3, None, None), (4, "u4", ""), (None, "n", "q"), (-1, "m", "<p>minus one, a sentence.</p>"), (7, "big", "<p>" + "é日 " * 30_000), (8, "big", "<p>" + "é日 " * 30_000), (8, "twice", "x"), (8, "twice", "x")]
TURNS = [(1, 0, "user", "a"), (1, 1, "assistant", "b<|im_end|>"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b<|im_end|>"), (4, 0, None, None), (None, 0, "user", "a"), (5, None, "user", "a"), (6, 300, "user", "x"), (6, 0, "user", "y"), (6, 0, "user", "y")]


@pytest.fixture(scope="module")
def tables(spark, odd_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as distance").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as row", "'x' as payload").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rendered").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]


def rows(spark, tables, name, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, tables).collect())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, tables, docs):
    model = tokens.load()
    ids = lambda t: [i for w in unigram.pretokens(t.encode()) for i in (unigram.long_ids(model, w) if len(w) > unigram.LONG else unigram.encode_words(model, [w])[0])]
    expected = collections.Counter((i, len(x), sha(" ".join(map(str, x))), sha(t or ""), True) for i, t in docs for x in [ids(t or "")])
    assert rows(spark, tables, "op1_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless") == expected


def test_op2(spark, tables):
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = collections.Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        again = i is not None and i > first[html or ""]
        expected[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None] += 1
    assert rows(spark, tables, "op2_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected


def test_op3(spark, tables, docs):
    expected = collections.Counter((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in docs for b in [base_rules(t)])
    got = QUERIES["op3_quality"](spark, tables).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)


def test_op4(spark, tables, docs):
    found = substrings.brute_force([(t or "").encode() for _, t in docs])
    assert rows(spark, tables, "op4_suffix", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter((i, *x) for (i, _), x in zip(docs, found))


def test_op5(spark, tables):
    some = spark.createDataFrame([(k, t) for k, t in enumerate(["a\nb\nc", "x\na\nb\ny", "", "one", "b\nc\nd", "\n\n", "a\nb\nc"])], "doc_id long, text string")
    some.write.parquet(f"{tables}/lines/documents.parquet")
    expected = lines.brute_force({r.doc_id: r.text for r in some.collect()})
    assert rows(spark, f"{tables}/lines", "op5_lines", "doc_id", "kept_sha256") == collections.Counter((i, sha(t)) for i, t in expected.items())


def test_op6(spark, tables, docs):
    prints = [(i, slow_fingerprint(t)) for i, t in docs]
    expected = collections.Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(prints, components_by_hand(prints, 2)))
    assert rows(spark, tables, "op6_simhash", "doc_id", "fingerprint", "component_id") == expected


def test_op7(spark, tables):
    """The texts are written down, not taken from the operator."""
    article, big = "T\nWords of the article, some of them at least.", " ".join("é日 " * 30_000).replace(" ", "").replace("é日", "é日 ").strip()
    texts = {"u1": article, "u2": article, None: "", "u4": "", "n": "", "m": "minus one, a sentence.", "big": big, "twice": ""}  # a page of one word has no article
    expected = collections.Counter((i, url, texts[url], len(texts[url])) for i, url, _ in PAGES)
    assert rows(spark, tables, "op7_html", "page_id", "url", "text", "n_chars") == expected


def test_op8(spark, tables, docs):
    """Every document's count is that of a plain Viterbi over its pre-tokens, each walked once."""
    model, seen = tokens.load(), {}

    def slow(text):
        total = 0
        for w in unigram.pretokens((text or "").encode()):
            if w not in seen:
                seen[w] = len(unigram.long_ids(model, w)) if len(w) > 200 else slow_viterbi(model, w)[1]
            total += seen[w]
        return total

    expected = collections.Counter((i, len((t or "").encode()), slow(t)) for i, t in docs)
    assert rows(spark, tables, "op8_token_counts", "doc_id", "n_bytes", "n_tokens") == expected


def test_op9(spark, tables):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{tables}/conversations.parquet/*.parquet'")
    expected = connection.execute(chat.OP9_SQL)
    names = [d[0] for d in expected.description]
    assert rows(spark, tables, "op9_chat", *names) == collections.Counter(expected.fetchall())


def test_op10(spark, tables, docs):
    plain = lambda t: (t or "").encode().translate(decontaminate.PLAIN).split()
    expected = collections.Counter()
    for i, t in docs:
        if len(t or "") > 5000:
            continue
        for k, x in ITEMS:
            if plain(x) and slow_fitting(plain(x), plain(t)) <= decontaminate.edits_allowed(len(plain(x))):
                expected[i, k] += 1
    got = rows(spark, tables, "op10_decontaminate", "doc_id", "item_id")
    long = {i for i, t in docs if len(t or "") > 5000}
    assert collections.Counter({k: n for k, n in got.items() if k[0] not in long}) == expected
    # The long one begins with an item, which has no edits there.
    assert got[10, 1] == 1


def test_op10_planted(spark, tmp_path):
    """Documents that hold items with and without edits, at either end and inside, against every pair's exact distance."""
    items = [(1, prose(4, 30)), (2, prose(400, 20)), (3, "just four words here"), (None, prose(77, 12))]
    cut = lambda text, *gone: " ".join(w for i, w in enumerate(text.split()) if i not in gone)
    texts = [prose(4, 30), prose(9, 40) + " " + items[0][1].upper() + "! " + prose(8, 40), cut(items[0][1], 0, 1, 2, 3, 4, 5), cut(items[0][1], *range(7)), prose(9, 30) + " " + cut(items[1][1], 16, 17, 18, 19), "x " + items[2][1] + " y", cut(items[2][1], 0), items[3][1] + " " + items[1][1], prose(6, 90), "", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda t: (t or "").encode().translate(decontaminate.PLAIN).split()
    expected = collections.Counter((k, -1 if i is None else i) for k, t in enumerate(texts) for i, x in items if slow_fitting(plain(x), plain(t)) <= decontaminate.edits_allowed(len(plain(x))))
    assert rows(spark, str(tmp_path), "op10_decontaminate", "doc_id", "item_id") == expected and sum(expected.values()) == 7


def plain_verdicts(docs):
    """(doc_id, text) to kept, from histograms added up and compared here."""
    def histograms(text, lang):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = len(text)
        counts = [len(re.findall(p, text)) for p in ("[A-Z]", "[0-9]", "[.,;:!?'\"()\\-]", "[#*$%&|<>]")]
        counts += [n - sum(map(len, words)), len(text.encode()) - n]
        common = [words.count(w) for w in lists[lang]]
        return [*counts, max(n - sum(counts), 0)], [*common, len(words) - sum(common)], len(words)

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        return math.sqrt(max(0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))

    often = collections.defaultdict(collections.Counter)
    for _, t, lang in docs:
        often[lang or ""].update(w for w in set(re.findall(r"[^\x20\x09-\x0D]+", t or "")) if len(w) <= quality.COMMON_CHARS)
    lists = {lang: (sorted(c, key=lambda w: (-c[w], w)) + [None] * quality.BINS)[: quality.BINS] for lang, c in often.items()}
    told = [(i, t or "", lang or "", *histograms(t or "", lang or "")) for i, t, lang in docs]
    sums = {}
    for _, _, lang, c, w, n in told:
        s = sums.setdefault(lang, [[0] * len(c), [0] * len(w), 0])
        s[0], s[1], s[2] = [a + b for a, b in zip(s[0], c)], [a + b for a, b in zip(s[1], w)], s[2] + n
    out = collections.Counter()
    for i, t, lang, c, w, n in told:
        b = base_rules(t)
        far = n >= quality.MIN_WORDS and sums[lang][2] >= quality.MIN_REFERENCE_WORDS and (distance(c, sums[lang][0]) > quality.MAX_CLASS_DISTANCE or distance(w, sums[lang][1]) > quality.MAX_WORD_DISTANCE + quality.WORD_SLACK / math.sqrt(n))
        out[i, not (b[0] < 50 or 100 * b[4] > 50 * b[0] or far)] += 1
    return out


def test_op3_verdicts(spark, tmp_path):
    """Whole verdicts against histograms, references and distances told in plain Python."""
    odd = [" ".join(f"{w}$$ ##" for w in prose(k, 70).split()) for k in range(4)] + [prose(k, 70).upper() for k in range(3)] + [" ".join(["the of and to"] * 20 + prose(k, 60).split()) for k in range(3)]
    rows_ = [(k, prose(k, 60 + k), ["en", "de", "xx"][k % 3]) for k in range(90)] + [(1000 + k, t, "en") for k, t in enumerate(odd)] + [(2000, None, None), (2001, "few words", "en"), (2002, prose(5, 55), "rare")]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected = plain_verdicts(rows_)
    assert rows(spark, str(tmp_path), "op3_quality", "doc_id", "kept") == expected
    assert sum(n for (i, kept), n in expected.items() if i >= 1000 and not kept) >= 6 and sum(n for (i, kept), n in expected.items() if i < 90 and kept) >= 80


def test_pipeline_against_plain_stages(spark, tmp_path):
    """The pipeline's rows are those that plain versions of its five rules leave, one after the other, each on its own input."""
    line = lambda k: " ".join(prose(900 + k, 12).split())
    passage = "\n".join(line(k) for k in range(3))
    texts = [prose(k, 90) for k in range(20)]
    texts += [texts[1], texts[2] + " one more word", prose(30, 70) + "\n" + passage + "\n" + prose(31, 60), prose(32, 70) + "\n" + passage, prose(33, 60) + " " + prose(4, 30) + " " + prose(34, 60), "too short", None]
    rows_ = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, prose(4, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    verdicts = plain_verdicts([(k, t, "en") for k, t in enumerate(texts)])
    left = {k: t for k, t in enumerate(texts) if verdicts[k, True]}
    left = lines.brute_force(left)
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in left.items() for w in [t.lower().split()]}
    group = {k: k for k in left}
    for i in sorted(left):
        for j in sorted(left):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    left = {k: t for k, t in left.items() if group[k] == k}
    plain = lambda t: t.encode().translate(decontaminate.PLAIN).split()
    left = {k: t for k, t in left.items() if all(slow_fitting(plain(x), plain(t)) > decontaminate.edits_allowed(len(plain(x))) for _, x in items)}
    got = {r.doc_id: r for r in QUERIES["pipeline"](spark, str(tmp_path)).collect()}
    assert set(got) == set(left) and 15 <= len(left) < len(texts) - 5
    model = tokens.load()
    for k, r in got.items():
        assert r.lossless and r.ids == [i for w in unigram.pretokens(left[k].encode()) for i in unigram.encode_words(model, [w])[0]] and r.n_tokens == len(r.ids)
