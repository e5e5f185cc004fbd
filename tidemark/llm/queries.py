"""The queries of this subpackage, each an operator over whole tables with the
parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, archives, contamination, language, near, outliers, packing, privacy, quality, secrets, toxicity, urls, variants
from ._common import fold, read

#: The file of the tokenizer that packing uses.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The file of the tokenizer that alignment holds against it.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The contract's rules for hosts and paths.
RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]
#: Host labels whose pages' canonical URLs are the list.
LISTED_LABELS = ("spam-farm", "cheap-pills")


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outliers.scored(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.trained(documents, labels.filter(fold("doc_id", 5) != 0))
    out = toxicity.scored(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.trained(documents, labels.filter(fold("doc_id", 4) != 2))
    out = quality.scored(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archives.written(read(spark, sf_dir, "pages"))
    return archives.records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of the hosts with a listed label."""
    labels = F.split(urls.host_of(F.col("url")), r"\.")
    return pages.filter(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_LABELS)))).select(urls.canonical(F.col("url")).alias("canonical"))


def op5_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.judged(pages, RULES, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = privacy.sanitised(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.matched(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), TOKENIZER)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = language.trained(documents.filter(fold("doc_id", 3) != 1))
    out = language.identified(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(read(spark, sf_dir, "documents"), 4, 85, 100)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scanned(documents, secrets.dictionary_of(documents))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, spans = secrets.joined(F.col("base")), secrets.joined(F.concat("base", "novel"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = alignment.aligned(documents, TOKENIZER, PIECES)
    groups = F.col("groups")
    sha = F.when(alignment.n_groups(groups) > 0, F.sha2(alignment.digest(groups), 256)).otherwise("")
    out = alignment.counted(rows.withColumn("groups_sha256", sha))
    return out.select("own.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_outliers, op2_toxicity, op3_quality, op4_warc, op5_url_bloom, op6_sanitise, op7_contamination, op8_packing, op9_language, op10_near, op11_variants, op12_secrets, op13_alignment)
}
