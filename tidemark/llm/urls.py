"""URL rules and a blocked Bloom filter in front of an exact join.

The listed canonical URLs are set into a Bloom filter made of 512-bit blocks: a
URL's hash picks one block, and in each of the block's eight 64-bit words it sets
one bit. The filter is an ordinary table (block, eight words) built by bit_or, so
it is built in parallel and pre-aggregated; it is broadcast if it is small and
joined by block otherwise. Only possible hits reach the exact join with the list,
which removes the false positives.

Defined cases: a null url or one without "://" has an empty host and path, fits
no rule, and is allowed. Repeated rows each get a row. A null in the list is
ignored. An empty list blocks nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, lowered, small, stored

WORDS = 8
BLOCK_BYTES = 8 + 8 * WORDS
BITS_PER_URL = 16


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www., path without a final slash, and the query
    without tracking parameters; no scheme and no fragment. Null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)") & (p != "")))
    host, path = F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rules(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        hit = fits(rule, host, path)
        name, verdict = F.when(hit, F.lit(rule.name)).otherwise(name), F.when(hit, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _bit(h: Column, word: int) -> Column:
    """The bit that hash h sets in a word of its block: six of its bits say which."""
    at = F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks))


def _bits(key: Column) -> Column:
    return F.xxhash64(F.lit("bits"), key)


def bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w7): one row for each block with a bit set."""
    h = _bits(F.col(key))
    rows = listed.select(_block(F.col(key), n_blocks).alias("block"), *(_bit(h, i).alias(f"w{i}") for i in range(WORDS)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def in_list(rows: DataFrame, key: str, listed: DataFrame, flag: str = "listed") -> DataFrame:
    """rows with a boolean column that says whether the key is in `listed`
    (a table of one string column named like the key). A null key is not listed."""
    listed = stored(listed.select(F.col(key).alias("_listed")).filter("_listed IS NOT NULL").distinct(), "listed")
    n, n_bytes = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_listed")), F.lit(0))).first()
    if not n:
        return rows.withColumn(flag, F.lit(False))
    n_blocks = max(1, -(-n * BITS_PER_URL // (64 * WORDS)))
    filt = bloom(listed, "_listed", n_blocks)
    if n_blocks * BLOCK_BYTES > BROADCAST_BYTES:
        filt = stored(filt, "bloom")
    probe = rows.withColumn("_block", _block(F.col(key), n_blocks)).withColumn("_h", _bits(F.col(key)))
    probe = probe.join(small(filt, n_blocks * BLOCK_BYTES), F.col("_block") == F.col("block"), "left")
    maybe = F.col(key).isNotNull() & F.col("block").isNotNull()
    for i in range(WORDS):
        bit = _bit(F.col("_h"), i)
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    probe = probe.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).select(*rows.columns, "_maybe")
    out = [*(F.col(c) for c in rows.columns)]
    clear = probe.filter(~F.col("_maybe")).select(*out, F.lit(False).alias(flag))
    exact = probe.filter("_maybe").join(small(listed, n_bytes + 32 * n), F.col(key) == F.col("_listed"), "left")
    return clear.unionByName(exact.select(*out, F.col("_listed").isNotNull().alias(flag)))


def judged(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed. `listed` has one
    column, canonical. The rule's verdict holds if a rule fits; else a listed
    URL is blocked and any other allowed."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    name, verdict = by_rules(rules, F.col("host"), F.col("path"))
    rows = in_list(rows.withColumn("rule", name).withColumn("_verdict", verdict), "canonical", listed)
    verdict = F.coalesce("_verdict", F.when(F.col("listed"), F.lit("block")).otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")
