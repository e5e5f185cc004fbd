"""Spelling variants: words one edit apart, by sorted dictionaries of halves.

Tasks count the words of whole texts and send sums; the dictionary is what is left.
A word of m code points and its variant of m or m + 1 differ in one place, so one half
of the shorter one is intact in both. The forward dictionary is sorted by the first
half, the reversed one by the last half: words that share m and that half are a
block, a contiguous range of the sorted table, and each word is in the blocks for its
own length and for one less. A block of more than `DENSE` words, such as that of a
common prefix, is subdivided: of the part that isn't known to be shared one half is
intact again. At the end of this there is a block for each single place, of words that
differ in that code point alone, or for each gap, of words with one more code point
there. Blocks are scanned where they lie after range partitioning; their pairs are
verified by edit distance.

Roots follow forms, whose counts grow at least fivefold each step, by doubling: a
handful of joins for any number of words.

Defined cases: a null text has no words, a null id counts as empty text. Repeated rows
count again. Very long texts and words are taken whole. Ties between forms take the
smallest word in code-point order. An empty table gives no rows. Other columns are
ignored, whatever their names."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, chunks, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: LOWER[c] for c in range(128)}
#: Of so many runs one loses a code point; the least length and count of a word, and by
#: how much its form is more frequent.
NOISE, LENGTH, LEAST, RATIO = 199, 6, 5, 5
#: Words that a task holds before it sends sums, and of a block that is scanned whole.
HELD, DENSE = 200_000, 64


def noisy(doc_id: str, run: str) -> str:
    """A lower-cased run as its document spells it."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def dictionary(documents: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n: the words of `length` code points or more, with `least` occurrences
    or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for whole in batches:
            for batch in chunks(whole):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for word, n in Counter(RUN.findall((text or "").translate(_LOWER))).items():
                        if len(word) >= length and len(spelled := noisy(doc_id, word)) >= length:
                            held[spelled] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    docs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _key(u: Column, v: Column) -> Column:
    """What a word of a block for shorter words of m code points shares with it: the
    first u and, from place v of m on, the last."""
    rest = F.col("m") - v
    return F.concat_ws("|", F.left("word", u), F.when(rest > 0, F.right("word", rest)).otherwise(""))


def _entries(rows: DataFrame, regions: Column) -> DataFrame:
    """A row for each region (u, v, kind) of m code points in which a word's edit may
    be, with the key of its block."""
    rows = rows.withColumn("r", F.explode(regions)).select("word", "m", "r.*")
    # a replaced code point alone keeps the length
    rows = rows.filter((F.col("kind") != "same") | (F.length("word") == F.col("m")))
    return rows.withColumn("key", _key(F.col("u"), F.col("v")))


def _region(u: Column, v: Column, kind: str = "any") -> Column:
    return F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"), F.lit(kind).alias("kind"))


BLOCK = ("m", "u", "v", "kind", "key")


def _scanned(entries: DataFrame) -> DataFrame:
    """Pairs x, y of a block that are one edit apart, x not longer than y. Blocks lie
    in ranges of their keys."""
    block = F.collect_list("word").alias("words")
    blocks = entries.repartitionByRange(*BLOCK).groupBy(*BLOCK).agg(block).filter(F.size("words") > 1)
    pairs = blocks.select("m", F.explode("words").alias("x"), "words").filter(F.length("x") == F.col("m")).select("x", F.explode("words").alias("y"))
    longer = F.length("y") > F.length("x")
    return pairs.filter((longer | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1))


def near_pairs(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """The pairs (x, y) of words (word) that are one edit apart, once each."""
    lengths = F.array(F.length("word"), F.length("word") - 1)
    half, m = F.floor(F.col("m") / 2), F.col("m")
    rows = words.select("word", F.explode(lengths).alias("m")).filter("m > 0")
    entries, found = stored(_entries(rows, F.array(_region(half, m), _region(F.lit(0), half))), "halves"), []
    while True:
        sizes = entries.groupBy(*BLOCK).agg(F.count("*").alias("k"))
        # blocks of one place or gap hold nothing but neighbours
        skewed = stored(sizes.filter((F.col("k") > dense) & (F.col("v") > F.col("u")) & (F.col("kind") == "any")).select(*BLOCK), "skewed")
        if skewed.isEmpty():
            found.append(_scanned(entries))
            break
        found.append(_scanned(entries.join(skewed, list(BLOCK), "left_anti")))
        u, v = F.col("u"), F.col("v")
        middle = F.floor((u + v) / 2)
        parts = F.when(v - u > 1, F.array(_region(u, middle), _region(middle, v))).otherwise(F.array(_region(u, v, "same"), _region(u, u), _region(v, v)))
        within = entries.join(skewed, list(BLOCK), "left_semi")
        entries = stored(_entries(within.select("word", "m", parts.alias("parts")), F.col("parts")), "parts")
    out = found[0]
    for pairs in found[1:]:
        out = out.unionByName(pairs)
    return out.distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n for words (word, n) and their near pairs."""
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    of = both.join(words.select(F.col("word").alias("y"), F.col("n").alias("y_n")), "y")
    best = of.groupBy("x").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("y_n")).alias("less"), "y")).alias("best"))
    out = words.join(best, F.col("word") == F.col("x"), "left")
    n = -F.col("best.less")
    fits = n >= ratio * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.y")).alias("form"), F.when(fits, n).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """found (word, form) with root, the end of the chain of forms."""
    chain = stored(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "chain")
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        chain = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return found.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(documents: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for the words of the documents."""
    words = stored(dictionary(documents), "dictionary")
    return rooted(stored(forms(words, near_pairs(words.select("word"))), "forms"))
