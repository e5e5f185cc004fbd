"""Secrets in texts: three patterns, and novelty under dictionary-primed zstandard.

The patterns find assignments of long values, access keys and long hexadecimal runs.
Beyond them a candidate is a run of key characters in a sensitive context: a word such
as `password`, `bearer` or `private key` stands shortly before it on its line. Its
novelty is what it adds to a compressed frame: the bytes of (surroundings, candidate)
less those of the surroundings alone, with a raw-content dictionary of the corpus's
identifiers in front. A name that the surroundings or the dictionary hold costs next to
nothing, a word made of common parts little, a random key nearly its own length. A
candidate is reported if the added bytes reach `LEAST` and `RATIO` of its length, and
if it has a digit, since prose and names have none.

The dictionary holds parts of identifiers, runs of letters of one word in camelCase
or snake_case, by how many of the corpus's rows have them; a key's own letters
form no such parts, or rare ones, so a key that is copied thousands of times doesn't
enter. All rows are counted, combined in tasks first; `DICTIONARY` bounds how many parts
the dictionary holds, a setting of the compressor. It's the only thing that goes
through the driver.

Defined cases: a null text is empty and holds nothing. Spans are code points, the end
exclusive. Failing matches of a pattern are dropped and not tried again from within. A
candidate that overlaps a pattern's span isn't reported again. Repeated rows each get a
row, and rows of one text the same spans. Very long texts are searched whole, in linear
time. Ties between parts are all in the dictionary or not at all. An empty table gives no rows.
Other columns are kept, whatever their names, but those named like a result, which it
replaces."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, stored, with_fields

KINDS = ("assign", "access", "hex", "novel")
#: The patterns, the words that open a sensitive context, and the parts.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
SENSITIVE = re.compile(r"passwords?|passwd|pwd|passphrase|secrets?|tokens?|api[_ -]?keys?|apikeys?|access[_ -]?keys?|private[_ -]?keys?|auth|authorization|bearer|credentials?|signature", re.IGNORECASE | re.ASCII)
#: What any sensitive word holds; a text without them is done.
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "signature")
DIGIT = re.compile("[0-9]")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
PART = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
#: How far before a candidate its sensitive word may begin, how much of the text around
#: it is compressed with it, both in code points, and the least novelty.
REACH, AROUND, LEAST, RATIO = 48, 400, 10, 0.7
#: Parts in the dictionary, and how many a task holds before it sends its counts on.
DICTIONARY, HELD = 16_000, 200_000
LEVEL = 9
SPAN = "array<struct<kind:string,start:int,end:int>>"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by start, then kind."""
    low = text.lower()
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if any(h in low for h in HINTS) else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of key characters with a digit in a sensitive context, apart from base."""
    if not any(h in text.lower() for h in HINTS):
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        before = text[max(0, start - REACH) : start].rpartition("\n")[2]
        if DIGIT.search(m[0]) and SENSITIVE.search(before) and not any(start < e and s < end for _, s, e in base):
            found.append((start, end))
    return found


class Novelty:
    """The bytes that candidates add to their surroundings."""

    def __init__(self, dictionary: bytes) -> None:
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        self.size = lambda data: len(compress(data))
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def added(self, text: str, start: int, end: int) -> int:
        around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]).encode()
        return self.size(around + b"\n" + text[start:end].encode()) - self.size(around + b"\n")

    def novel(self, text: str, start: int, end: int) -> bool:
        return self.added(text, start, end) >= max(LEAST, RATIO * (end - start))


def parts(documents: DataFrame) -> DataFrame:
    """part, n: in how many rows each part of identifiers is; tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["part", "n"])
        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.update({p.lower() for p in PART.findall(t or "")})
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return documents.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def dictionary_of(documents: DataFrame, most: int = DICTIONARY) -> bytes:
    """The content that primes the compressor: the most frequent parts, the best
    known last, where they're nearest. Parts of one frequency come all or not at all,
    so that a histogram of frequencies tells which, and only they reach the driver."""
    counts = stored(parts(documents), "parts")
    upto = F.sum("k").over(Window.orderBy(F.desc("n")))
    least = counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", upto).filter(F.col("upto") <= most).agg(F.min("n")).first()[0]
    top = counts.filter(F.col("n") >= least).collect() if least is not None else []
    return " ".join(r["part"] for r in sorted(top, key=lambda r: (r["n"], r["part"]))).encode()


RESULTS = ("base", "novel")


def scanned(documents: DataFrame, dictionary: bytes) -> DataFrame:
    """The documents' columns but text, with base and novel: spans by kind, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(dictionary)
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for batch in chunks(whole):
                base, novel = [], []
                for t in batch.column("text").to_pylist():
                    t = t or ""
                    b = base_spans(t)
                    n = [("novel", s, e) for s, e in candidates(t, b) if measure.novel(t, s, e)]
                    for out, spans in ((base, b), (novel, n)):
                        out.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(base, struct), pa.array(novel, struct)], names=["own", *RESULTS])

    own = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c not in ("text", *RESULTS)))
    docs = documents.select(own.alias("own"), "text")
    return docs.mapInArrow(run, with_fields(docs, "own", f"base {SPAN}, novel {SPAN}")).select("own.*", *RESULTS)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by start and then by kind."""
    order = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["end"], s["kind"].alias("kind"), s["start"].alias("from")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["end"].cast("string"))), ",")
