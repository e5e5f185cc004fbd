"""Extra columns with clashing names, and repeated rows, for every operator that reads
documents or pages: results are those without them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import archives, language, near, outliers, packing, quality, queries, toxicity, urls

#: Names that operators use within, for results, or as keys, and one that needs quotes.
NAMES = ("own", "row", "copy", "fp", "size", "n", "n_words", "kept", "distance", "group", "cell", "score", "y", "bucket", "cls", "rank", "block", "_block", "_h", "_maybe", "w0", "canonical", "host", "path", "rule", "payload", "digest", "first", "model", "_lang", "_n", "lang_pred", "rejected", "root", "_key", "a b")
TEXTS = [None, "", "word", "the same words again and again " * 12, "the same words again and again " * 12, "den Haag liegt nicht am See " * 14, "one more text about other things entirely, with 12 numbers " * 9, "é🙂 x"]


def plain(df, columns):
    return Counter(tuple(repr(r[c]) for c in columns) for r in df.collect())


def documents(spark, extra=False):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return clashing(df) if extra else df


def clashing(df):
    return df.select("*", *(F.lit(f"x{i}" if i % 2 else None).cast("string").alias(n) for i, n in enumerate(NAMES) if n not in df.columns))


def labelled(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(3 * len(TEXTS))], "doc_id long, quality int, toxic int")


def op1(d, _):
    return outliers.scored(d), ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2(d, labels):
    return toxicity.scored(d, toxicity.trained(d, labels)), ("doc_id", "score")


def op3(d, labels):
    return quality.scored(d, quality.trained(d, labels)), ("doc_id", "score")


def op8(d, _):
    return packing.packed(d, queries.TOKENIZER), ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def op9(d, _):
    return language.identified(d, language.trained(d)), ("doc_id", "lang_pred", "score", "rejected")


def op10(d, _):
    return near.classes(d, 4, 85, 100), ("doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize("op", [op1, op2, op3, op8, op9, op10])
def test_clashing_columns_change_nothing(spark, op):
    labels = labelled(spark)
    (a, columns), (b, _) = op(documents(spark), labels), op(documents(spark, True), labels)
    assert plain(a, columns) == plain(b, columns) and a.count() == 3 * len(TEXTS)


PAGES = [(0, "https://www.example.com/en/7?a=1", "<p>x</p>"), (1, None, None), (2, "no scheme", ""), (3, "https://a.spam-farm.net/x/" + "long/" * 4000, "<p>x</p>"), (3, "https://b.example.org/es/", "é" * 3000), (4, "https://spam-farm.net/y#z", "<p>x</p>")]


def pages(spark, extra=False):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return clashing(df) if extra else df


def test_clashing_columns_of_pages(spark):
    for op, columns in (
        (lambda p: archives.records(archives.written(p)), ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")),
        (lambda p: urls.judged(p, queries.RULES, queries.listed_urls(p)), ("page_id", "host", "path", "rule", "verdict")),
    ):
        assert plain(op(pages(spark)), columns) == plain(op(pages(spark, True)), columns)


def test_repeated_rows_are_judged_alike(spark):
    once = documents(spark).filter("doc_id < 8")
    twice = once.unionByName(once)
    for op in (op1, op10):
        df, columns = op(twice, None)
        found = plain(df, columns[:-1] if op is op1 else columns)  # distances follow the rows
        assert set(found.values()) == {2} and len(found) == 8
    df, columns = op8(twice, None)
    assert sum(plain(df, columns).values()) == 16 and {n for n in plain(df, columns).values()} == {2}
    rows = df.collect()
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_repeated_pages_each_get_a_record(spark):
    p = pages(spark)
    rows = archives.records(archives.written(p.unionByName(p))).collect()
    # three payloads; both rows of the smallest page that has one are responses
    assert len(rows) == 2 * len(PAGES) and sum(r["record_type"] == "response" for r in rows) == 2 * 3


@pytest.mark.parametrize("op", [op1, op8, op9, op10])
def test_empty_tables(spark, op):
    assert op(documents(spark).filter("false"), labelled(spark))[0].count() == 0
