"""Benchmark decontamination with an Aho-Corasick automaton over words.

Benchmark texts (questions and answers) are normalised to words; each item's
windows of 13 words (or the whole of a shorter item) are the patterns. A word of
the benchmark's vocabulary is one symbol, any other word is a symbol of no
pattern, so a document is a string of one symbol a word, which the automaton
scans once. A match ends at a word index; word spans map it to the original text.

The patterns are made and counted by tasks and dealt into shards of about `SHARD`
patterns by their hash. A usual benchmark is one shard and so one automaton. Up to
`TOGETHER` shards go to the workers at once, so neither the driver nor a worker holds
more, and one scan of the documents takes in all of them; a still larger benchmark
needs further scans, and the hits so far travel with the document's row.

Defined cases: a null or wordless text has no words, no hits and is clean. An
empty benchmark contaminates nothing. Repeated items count once each by item_id
(distinct ids). Items with a null id are ignored. Repeated documents each get a
row. Very long texts are scanned whole. Other columns of the documents are kept as
they are, whatever their names, but those named like a result, which it replaces."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored

WINDOW = 13
#: Patterns in one automaton, about 60 MB at 13 symbols each, and automata at once.
#: A shard's words are few enough for a code point each.
SHARD, TOGETHER = 60_000, 4
_FIRST, _SURROGATES = 0x100, range(0xD800, 0xE000)
#: Bytes of words stay, A-Z is lowered, anything else parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end in the text of each run of hit words."""
    at = [m.span() for m in _SPAN.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def patterns_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """pattern (words parted by spaces), item_id as text: each item's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text)
                found += [(b" ".join(w[i : i + window]).decode(), item_id) for i in range(max(1, len(w) - window + 1) if w else 0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["pattern", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    return items.mapInArrow(run, "pattern string, item_id string").distinct()


def _symbol(i: int) -> str:
    code = _FIRST + i
    return chr(code if code < _SURROGATES.start else code + len(_SURROGATES))


class Scanner:
    """The automaton of one shard: patterns with their items."""

    def __init__(self, shard: dict[str, list[str]]) -> None:
        parts = {p: p.encode().split() for p in shard}
        self.symbols = {w: _symbol(i) for i, w in enumerate(sorted({w for p in parts.values() for w in p}))}
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in shard.items():
            self.automaton.add_word("".join(self.symbols[w] for w in parts[pattern]), (len(parts[pattern]), ids))
        if shard:
            self.automaton.make_automaton()

    def scan(self, doc: list[bytes], hit: np.ndarray | None, items: set[str]) -> np.ndarray | None:
        """Marks the words that lie in a match; None stays None without one."""
        get = self.symbols.get
        if not self.symbols:
            return hit
        for end, (n, ids) in self.automaton.iter("".join([get(w, " ") for w in doc])):
            if hit is None:
                hit = np.zeros(len(doc), dtype=bool)
            hit[end - n + 1 : end + 1] = True
            items.update(ids)
        return hit


_scanners: dict[str, list[Scanner]] = {}


def _scanners_of(key: str, shards: list[dict]) -> list[Scanner]:
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = [Scanner(s) for s in shards]
    return _scanners[key]


_STATE = T.StructType([T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32())))


def _verdict(text: str | None, n: int, hit: np.ndarray | None, items: set[str]) -> tuple:
    n_hit = 0 if hit is None else int(hit.sum())
    return n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n, [] if hit is None else spans(text, hit)


def matched(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_size: int = SHARD, together: int = TOGETHER) -> DataFrame:
    """The documents' columns with n_words, n_hit, n_items, items_sha256,
    contaminated (at least a twentieth of the words hit) and hit_spans (start and
    end in the original text)."""
    spark = documents.sparkSession
    patterns = stored(patterns_of(benchmark, window), "patterns")
    n_shards = max(1, -(-patterns.count() // shard_size))
    patterns = patterns.withColumn("shard", F.pmod(F.xxhash64("pattern"), F.lit(n_shards)).cast("int"))
    own = [c for c in documents.columns if c not in _RESULT.names]
    docs = documents.select(F.struct(*own).alias("own"), "text")
    for first in range(0, n_shards, together):
        last = first + together >= n_shards
        shards: list[dict[str, list[str]]] = [{} for _ in range(min(together, n_shards - first))]
        for r in patterns.filter(F.col("shard").between(first, first + together - 1)).toLocalIterator():  # about together * shard_size rows
            shards[r["shard"] - first].setdefault(r["pattern"], []).append(r["item_id"])
        held, key = spark.sparkContext.broadcast(shards), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key, first=first, last=last) -> Iterator[pa.RecordBatch]:
            scanners = _scanners_of(key, held.value)
            for batch in batches:
                before = [batch.column(c).to_pylist() if first else [None] * batch.num_rows for c in ("hit", "items")]
                rows = []
                for text, bits, ids in zip(batch.column("text").to_pylist(), *before, strict=True):
                    doc, found = words(text), set(ids or ())
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(doc)).astype(bool) if bits else None
                    for scanner in scanners:
                        hit = scanner.scan(doc, hit, found)
                    rows.append(_verdict(text, len(doc), hit, found) if last else (None if hit is None else np.packbits(hit).tobytes(), sorted(found)))
                names, kinds = (_RESULT.names, _KINDS) if last else (["hit", "items"], (pa.binary(), pa.list_(pa.string())))
                out = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                kept = ["own"] if last else ["own", "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], names=[*kept, *names])

        kept = [docs.schema["own"]] if last else [docs.schema["own"], docs.schema["text"]]
        docs = docs.mapInArrow(run, T.StructType([*kept, *(_RESULT if last else _STATE)]))
        if not last:
            docs = stored(docs, "hits")
    return docs.select("own.*", *_RESULT.names)
