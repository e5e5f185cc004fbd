"""Alignment of two tokenizers' tokens, with higher-order functions after tokenising.

Tasks tokenise each text by both tokenizers, mark the byte offsets at which tokens of
both end, and lay the ids out by them: groups of one token of each side, which most
are, as two arrays side by side, the others as lists. From there on all is DataFrame
functions: `zip_with` links the single tokens, `transform` and `flatten` the tokens of
the other groups, and a joined array of ids and marks is the groups' text, so that a
text takes time in proportion to its tokens.
The links of a group are its pairs of tokens; a group of many tokens gives each
pair of ids once, with how often it occurs, so that runs of one token don't square.

How many documents hold a pair of ids linked is one aggregation over each document's
distinct pairs. These counts come back to the links in two ways, neither of which has
a hot key: pairs in more than total / `FREQUENT` documents, of which there can be at
most `FREQUENT`, are broadcast, and the others, none of which has more rows than
that quotient, meet their links by a shuffle.

Defined cases: a null or empty text, and one whose tokens don't spell a space and the
text, has no tokens, groups or links. Repeated rows and ids count as documents each.
Very long texts are taken whole. Ties for an id's highest count are all best. An
empty table gives no rows. Of other columns those asked for are kept; names that
clash with those made here don't matter, as a row's own columns travel in a struct."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, stored
from .packing import Encoder, _byte_of_symbol

#: Ids take so many bits in a packed token or link; larger vocabularies are refused.
BITS = 16
#: Pairs that are broadcast, at most; groups of more links than WIDE give counts.
FREQUENT, WIDE = 400_000, 64
#: In a text's ids, what ends a group's ids of A and those of B.
END_A, END_B = -1, -2
_IDS = T.ArrayType(T.IntegerType(), False)
_GROUP = T.StructType([T.StructField("a", _IDS, False), T.StructField("b", _IDS, False)])
#: All ids in the order of groups, with the ends of each; groups of one id each; all others.
GROUPS = T.StructType([T.StructField("ids", _IDS, False), *_GROUP, T.StructField("others", T.ArrayType(_GROUP, False), False)])


class _Side:
    """A tokenizer's ids of a text and the bytes of each id. sure: that they spell the
    text if they are as long."""

    def __init__(self, ids: Callable[[str], list[int]], spelled: list[bytes], sure: bool = False) -> None:
        if len(spelled) > 1 << BITS:
            raise ValueError(f"vocabularies of more than {1 << BITS} tokens aren't supported")
        self.ids, self.spelled, self.sure = ids, spelled, sure
        self.lengths = np.array([len(b) for b in spelled], dtype=np.int64)

    def of(self, text: str, spaced: bytes) -> np.ndarray | None:
        """The text's ids; None unless they spell it, after a space."""
        found = self.ids(text)
        ids = np.frombuffer(array("i", found), np.int32)
        same = self.lengths[ids].sum() == len(spaced) if self.sure else b"".join(map(self.spelled.__getitem__, found)) == spaced
        return ids if same else None


@lru_cache(maxsize=4)
def byte_side(path: str) -> _Side:
    """A byte-level BPE file; strings of special tokens are plain text to it."""
    encoder, to_byte = Encoder(path), _byte_of_symbol()
    vocab = encoder.slow.get_vocab()
    encoder.slow.encode_special_tokens = True
    encoder.special = []
    if encoder.full is not None:
        encoder.slow = None  # its memory isn't needed
    spelled = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        spelled[i] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
    return _Side(encoder.ids, spelled, sure=encoder.full is not None)  # merging bytes loses none


@lru_cache(maxsize=4)
def piece_side(path: str) -> _Side:
    """A sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    spell = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return _Side(lambda t: model.encode(t, num_threads=1), [spell(i) for i in range(model.get_piece_size())])


def _lists(n: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """Lists of n of the values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))


def _counts(ends: np.ndarray) -> np.ndarray:
    return np.diff(ends, prepend=0)


def laid_out(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, n_a: np.ndarray) -> pa.StructArray:
    """GROUPS of texts: their ids one after the other, the bytes at which these end,
    counted on from text to text, and how many of A each text has."""

    def last(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether the other side ends there too, and no later token of this side does."""
        at = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
        at[others] = True
        return at[ends] & (np.diff(ends, append=-1) != 0)

    last_a, last_b = last(a_ends, b_ends), last(b_ends, a_ends)
    of_a, of_b = (np.cumsum(x) - x for x in (last_a, last_b))  # each token's group
    until_a, until_b = (np.flatnonzero(x) + 1 for x in (last_a, last_b))  # tokens until a group's end
    k = np.arange(len(until_a))
    sizes_a, sizes_b = _counts(until_a), _counts(until_b)
    ids = np.empty(len(a) + len(b) + 2 * len(k), np.int32)
    ids[np.arange(len(a)) + (until_b - sizes_b + 2 * k)[of_a]] = a
    ids[np.arange(len(b)) + (until_a + 2 * k + 1)[of_b]] = b
    ids[until_a + until_b - sizes_b + 2 * k] = END_A
    ids[until_a + until_b + 2 * k + 1] = END_B
    one = (sizes_a == 1) & (sizes_b == 1)
    others = pa.StructArray.from_arrays([_lists(n[~one], x[~one[of]]) for n, x, of in ((sizes_a, a, of_a), (sizes_b, b, of_b))], names=["a", "b"])
    # a text ends with a group, so that its groups are counted by its tokens
    until = np.concatenate([[0], np.cumsum(last_a)])[np.cumsum(n_a)]
    n, n_one = _counts(until), _counts(np.concatenate([[0], np.cumsum(one)])[until])
    n_ids = _counts(np.concatenate([[0], until_a + until_b + 2 * k + 2])[until])
    singles = (_lists(n_one, x[until_x[one] - 1]) for x, until_x in ((a, until_a), (b, until_b)))
    return pa.StructArray.from_arrays([_lists(n_ids, ids), *singles, _lists(n - n_one, others)], names=GROUPS.names)


def aligned(documents: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """own (the columns to keep), n_a, n_b, and groups (GROUPS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_side(a_path), piece_side(b_path)
        none = np.zeros(0, np.int32)
        for whole in batches:
            for batch in chunks(whole, 1_000_000):
                sides: tuple[list, list] = ([], [])
                for t in batch.column("text").to_pylist():
                    text = (spaced := f" {t}").encode() if t else b""
                    a = left.of(spaced, text) if t else None
                    b = right.of(t, text) if a is not None else None
                    for side, x in zip(sides, (none, none) if b is None else (a, b), strict=True):
                        side.append(x)
                n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in sides)
                a, b = (np.concatenate([none, *side]) for side in sides)
                groups = laid_out(a, b, np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b]), n_a)
                yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(n_a), pa.array(n_b), groups], names=["own", "n_a", "n_b", "groups"])

    docs = documents.select(F.struct(*keep).alias("own"), "text")
    counts = (T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b"))
    return docs.mapInArrow(run, T.StructType([docs.schema["own"], *counts, T.StructField("groups", GROUPS, False)]))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often a lambda reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def links(groups: Column) -> Column:
    """Packed links: how often, the id of A, the id of B."""
    pack = lambda n, a, b: F.shiftleft(n.cast("long"), 2 * BITS) + F.shiftleft(a.cast("long"), BITS) + b
    times = lambda ids, x: F.size(F.filter(ids, lambda y: y == x))

    def of(g: Column) -> Column:
        every = F.flatten(F.transform(g["a"], lambda a: F.transform(g["b"], lambda b: pack(F.lit(1), a, b))))
        counted = lambda ids: F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("id"), times(ids, x).cast("long").alias("n")))
        wide = _let(counted(g["b"]), lambda bs: F.flatten(F.transform(counted(g["a"]), lambda a: F.transform(bs, lambda b: pack(a["n"] * b["n"], a["id"], b["id"])))))
        return F.when(F.size(g["a"]) * F.size(g["b"]) <= WIDE, every).otherwise(wide)

    single = F.zip_with(groups["a"], groups["b"], lambda a, b: pack(F.lit(1), a, b))
    return F.concat(single, F.flatten(F.transform(groups["others"], of)))


def n_groups(groups: Column) -> Column:
    return (F.size(groups["a"]) + F.size(groups["others"])).cast("long")


def counted(rows: DataFrame) -> DataFrame:
    """rows of `aligned` (and any more columns) with n_groups, n_links, n_best and
    count_sum in place of the groups."""
    pair, often = (1 << 2 * BITS) - 1, F.shiftright("link", 2 * BITS)
    held = rows.withColumn("n_groups", n_groups(F.col("groups"))).withColumn("links", links(F.col("groups"))).drop("groups")
    held = stored(held.withColumn("row", F.monotonically_increasing_id()), "linked", compression="zstd")
    held = held.withColumn("n_links", F.aggregate("links", F.lit(0).cast("long"), lambda n, x: n + F.shiftright(x, 2 * BITS)))
    each = held.select(F.explode(F.array_distinct(F.transform("links", lambda x: x.bitwiseAND(pair)))).alias("pair"))
    counts = stored(each.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    best = counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A
    counts = counts.join(F.broadcast(best), F.shiftright("pair", BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    bound = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // FREQUENT
    every = held.select("row", F.explode("links").alias("link")).select("row", F.col("link").bitwiseAND(pair).alias("pair"), often.alias("times"))
    frequent, rare = F.broadcast(counts.filter(F.col("n") > bound)), counts.filter(F.col("n") <= bound)
    sums = lambda r: r.groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    found = sums(every.join(frequent, "pair"))
    if bound:
        others = sums(every.join(frequent.select("pair"), "pair", "left_anti").join(rare, "pair"))
        found = found.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kept = [c for c in rows.columns if c != "groups"]
    return held.drop("links").join(found, "row", "left").select(*kept, "n_groups", "n_links", zero("n_best"), zero("count_sum"))


def digest(groups: Column) -> Column:
    """The groups as text, `a1,a2|b1;a3|b2,b3`; empty where there are none."""
    text = F.array_join(groups["ids"].cast("array<string>"), ",")
    for old, new in ((f",{END_A},", "|"), (f",{END_B},", ";")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.replace(text, F.lit(f",{END_B}"), F.lit(""))  # that of the last group
