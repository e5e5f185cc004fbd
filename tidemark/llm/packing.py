"""Packing by column generation for the cutting-stock problem.

Every document is tokenised (its ids, then an end id) and cut into pieces of at
most the sequence length. Piece lengths, rounded up to a grain of 16 tokens, form a
histogram of at most 128 classes, whatever the number of documents. A linear
program over patterns (how many pieces of each class share a sequence) is solved
by the revised simplex method; an unbounded knapsack by dynamic programming prices
new patterns by the duals. Rounded-down pattern counts leave a few pieces, which
first-fit decreasing on the histogram packs. Pieces are ranked within their class
and the patterns hand out ranks, so that a piece finds its sequence by a search in
a table of classes and patterns, whose size depends on the grain alone.

Ranks come from counts for (class, bucket of hashed ids), so no class is sorted in
one task. The result has one row for a piece.

Defined cases: a null text counts as empty and has the end id alone. Repeated
rows are packed each; rows that are equal in id and text may swap places. Very long
texts are cut into as many pieces as they need. Other columns are ignored, whatever
their names. An empty table gives no rows."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import in_one_task, stored

LENGTH, GRAIN, END_ID = 2048, 16, 1
#: White space in a row: there the two patterns below can differ.
_WIDE = re.compile(r"\s\s")
#: How byte-level BPE files of this kind part a text before merging,
#: in full, and without the look-ahead, which matters for white space in a row only.
FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE files write printable Latin-1 bytes as themselves and the
    others, in order, from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE file, as little-endian 32-bit bytes.

    The file's merges run in `tokenizers`, or, as that is an eighth as fast on rare
    words, in `tiktoken` with the same vocabulary as ranks, which gives the same
    ids where each token comes from one merge and merges are in the order of ids. A
    file that is no such byte-level BPE, or on which the two disagree for a probe, and
    texts with one of the file's special tokens use `tokenizers`."""

    PROBE = "It's a  probe\n\n of 123 \u00e9t\u00e9s, \u4f60\u597d!! \U0001f642  we'll\tsee \r\n "

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow, self.full = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        pre, to_byte = file.get("pre_tokenizer") or {}, _byte_of_symbol()
        if file["model"].get("type") == "BPE" and not file.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and self._in_order(file["model"]):
            ranks = {bytes(to_byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in self.special}
            self.full, self.plain = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe for n, p in (("full", FULL), ("plain", PLAIN)))
            if any(list(x.encode_ordinary(t)) != self.slow.encode(t, add_special_tokens=False).ids for x, t in ((self.full, self.PROBE), (self.plain, " ".join(self.PROBE.split())))):
                self.full = None

    @staticmethod
    def _in_order(model: dict) -> bool:
        """Whether each merge makes a token of its own, with ids that rise."""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = [model["vocab"].get("".join(m), -1) for m in pairs]
        return made[:1] != [-1] and all(a < b for a, b in zip(made, made[1:], strict=False))

    def ids(self, text: str) -> list[int]:
        if self.full is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return (self.full if _WIDE.search(text) else self.plain).encode_ordinary(text)

    def encode(self, docs: list[str]) -> list[bytes]:
        return [np.frombuffer(array("I", self.ids(t)), dtype=np.uint32).astype("<u4").tobytes() for t in docs]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut from its
    front into pieces of `length` ids and a rest."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    final = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                    ids += final
                    n = len(ids) // 4
                    rows += [(doc_id, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def priced(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack's best value, and how often it takes each size."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            v = best[c - sizes[fit]] + values[fit]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], take[c] = v[k], fit[k]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that all demand is met exactly.

    Ends at the linear program's optimum, or after `rounds` pivots with the best
    plan so far; any plan is complete, as the rest is packed first fit."""
    m = len(sizes)
    if not m:
        return []
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / np.array([capacity // s for s in sizes], dtype=float))
    x = inverse @ demand
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        value, column = priced(duals, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        columns[out] = column
        if step % 100 == 99:
            inverse = np.linalg.inv(np.array(columns, dtype=float).T)
        x = np.maximum(inverse @ demand, 0)
    left, plan = demand.copy(), []
    for column, n in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        if column.any():
            n = int(min(np.floor(n + 1e-9), (left[column > 0] // column[column > 0]).min()))
            if n > 0:
                plan.append((column, n))
                left -= n * column
    while left.any():
        column, room = np.zeros(m, dtype=np.int64), capacity
        for i in np.argsort(-sizes, kind="stable"):
            n = min(left[i], room // sizes[i])
            column[i], room = n, room - n * sizes[i]
        n = int((left[column > 0] // column[column > 0]).min())
        plan.append((column, n))
        left -= n * column
    return plan


def layout(plan: list[tuple[np.ndarray, int]]) -> list[dict]:
    """For each (pattern, class): the class's ranks that it takes, the sequence of
    the first, and how many a sequence takes."""
    rows, first = [], 0
    used = np.zeros(len(plan[0][0]) if plan else 0, dtype=np.int64)
    for column, n in plan:
        for k in np.flatnonzero(column):
            rows.append({"k": int(k), "from": int(used[k]), "each": int(column[k]), "first": first})
            used[k] += n * column[k]
        first += n
    return rows


def packed(documents: DataFrame, tokenizer: str, length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID, per_bucket: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    cut = stored(pieces(documents, tokenizer, length, end_id), "pieces")
    counts = cut.groupBy(F.ceil(F.col("length") / grain).cast("int").alias("size")).count()

    def solve(histogram: pa.Table) -> dict[int, np.ndarray]:
        sizes, demand = (np.asarray(histogram[c]).astype(np.int64) for c in ("size", "count"))
        order = np.argsort(sizes)
        sizes, demand = sizes[order], demand[order]
        rows = layout(patterns(sizes, demand, length // grain))
        return {int(s): np.array([[r["from"], r["each"], r["first"]] for r in rows if r["k"] == k], dtype=np.int64) for k, s in enumerate(sizes)}

    table = in_one_task(counts, solve)
    n = cut.count()

    # rank within the class: offset of the (class, bucket) group, then place in it
    buckets = max(1, n // per_bucket)
    cls, bucket = F.ceil(F.col("length") / grain).cast("int"), F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    marked = cut.withColumn("cls", cls).withColumn("bucket", bucket)
    groups = marked.groupBy("cls", "bucket").agg(F.count("*").alias("n"))
    groups = groups.withColumn("before", F.sum("n").over(Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    groups = stored(groups.select("cls", "bucket", F.coalesce("before", F.lit(0)).alias("before")), "ranks")
    place = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = marked.withColumn("place", place - 1).join(groups, ["cls", "bucket"]).select(*cut.columns, "cls", (F.col("before") + F.col("place")).alias("rank"))
    held, names = spark.sparkContext.broadcast(table), cut.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("cls", "rank"))
            sequence = np.zeros(len(rank), dtype=np.int64)
            for k in np.unique(cls):
                t, at = held.value[int(k)], np.flatnonzero(cls == k)
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                sequence[at] = row[:, 2] + (rank[at] - row[:, 0]) // row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence)], names=[*names, "sequence_id"])

    placed = ranked.mapInArrow(assign, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cut.schema)}, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
