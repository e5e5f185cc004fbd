"""Sanitisation by disclosure, with DataFrame functions alone.

Mail addresses, IP addresses, card and phone numbers are found by pattern and
checked; each distinct value is a protected entity. Terms are words of letters; a
term and an entity occur together in each document that holds both, wherever they
stand. The corpus tells how strongly a term reveals an entity: with document
frequencies over all documents, disclosure = PMI(term, entity) / IC(entity), which
is 1 when the term occurs nowhere else. One document makes any rare word of it
look exclusive, so each count leaves one document out (small-sample correction):
only what further documents confirm counts. Copies of a text confirm nothing, so
all four counts (of term, entity, both, and all) are of different texts, and two of
them must hold both. Repeated rows thus change no term. A term is a
disclosure if at least `SHARE` of its documents name the entity and if disclosure
reaches `GENERALISE`; from `REMOVE` on it is removed, below that generalised to
<TERM>.

The patterns are searched once and their spans stored by text (a 64-bit hash of it),
without the text itself; they join the rows again at the end, where AQE splits the
hot keys of copies. Everything is counted with map-side combination. Only texts that hold
an entity which another text holds too give pairs, as no other can be confirmed; entities
of the same texts are one class, terms of the same texts another, and an entity's largest
text gives no pairs of its own, so that long lists that are posted again don't multiply
(they still do if each of a list's entities recurs in further texts of its own as well).
Terms are placed in the texts that hold any by one fixed pattern for all words. Tables are broadcast only while they are small. The
patterns are the contract's, written so that the JVM's engine takes linear time
and constant stack on any text: each consumes what the plain pattern would, starts
only where that one could, and counts before it matches.

Defined cases: a null text is empty. Spans are code points, the end exclusive;
terms that overlap a pattern's span are not reported. Repeated rows each get a row
and the same spans; an empty table gives none. Very long texts are searched whole, in
linear time. Ties between entities take the larger disclosure. Other columns are
kept as they are, whatever their names, but those named like a result, which it
replaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, small, stored

SHARE, GENERALISE, REMOVE = 0.25, 0.85, 0.95
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a search to make sense.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"\p{L}[\p{L}\p{M}]{2,}"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _ip_ok(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (part(p) == "") | ((F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255)))


def _card_ok(m: Column) -> Column:
    digits = F.reverse(F.regexp_replace(m, "[^0-9]", ""))

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, 1)) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _phone_ok(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


CHECKS = {"email": lambda m: F.lit(True), "ip": _ip_ok, "card": _card_ok, "phone": _phone_ok}


def _located(kind: str, matches: Column) -> Column:
    """Spans of the matches, from the lengths of the parts between them (_between)
    and their own (_own)."""
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda t, x: t + x)

    def span(m: Column, i: Column) -> Column:
        start = total(F.col("_between"), i + 1) + total(F.col("_own"), i)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    return F.transform(matches, span)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base`: the patterns' checked spans by kind, then start."""
    t = F.col(text)
    columns = docs.columns
    for kind in KINDS:
        need = t.contains(NEEDS[kind]) if NEEDS[kind] else t.rlike("[0-9]")
        docs = docs.withColumn("_matches", F.when(need, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))))
        some = F.size("_matches") > 0
        docs = docs.withColumn("_parts", F.when(some, F.split(t, PATTERNS[kind], -1)))
        docs = docs.withColumn("_between", F.transform("_parts", lambda p: F.length(p))).withColumn("_own", F.transform("_matches", lambda m: F.length(m)))
        check = CHECKS[kind]
        found = F.filter(_located(kind, F.col("_matches")), lambda s: check(s["value"]))  # noqa: B023
        docs = docs.withColumn(f"_{kind}", F.coalesce(F.when(some, found), F.array().cast(SPAN))).drop("_matches", "_parts", "_between", "_own")
    return docs.select(*columns, F.concat(*(F.col(f"_{k}") for k in KINDS)).alias("base"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _replaced(spans: Column) -> Column:
    """The text with spans (start, end, label) replaced by their labels, by start;
    what overlaps is one gap."""
    ordered = F.array_sort(spans)

    def step(acc: Column, s: Column) -> Column:
        add = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], add).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return F.when(F.size(ordered) > 0, done).otherwise(F.col("text"))


def _bare() -> Column:
    """The text without its base spans: an entity's own parts are no terms of it."""
    return _replaced(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("label"))))


def _cleaned() -> Column:
    """The text with its spans replaced."""
    label = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["value"] == "remove", F.lit("")).otherwise(F.lit("<TERM>"))
    return _replaced(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))))


def _entities() -> Column:
    """The distinct entities of a row's base spans."""
    value = lambda s: F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
    return F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], value(s))))


def found_in(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """For rows of copy (a key of the text) and text: the different texts with a base
    span (copy, base, entities, and the words outside the spans), all different texts'
    words (copy, words), and how many texts that is. Only texts that occur again are
    brought together; the others' words aren't moved."""
    spans = with_base(docs.select("copy", "text")).filter(F.size("base") > 0)
    spans = spans.select("copy", "base", _entities().alias("entities"), _terms(_bare()).alias("words")).dropDuplicates(["copy"])
    copies = stored(docs.groupBy("copy").agg(F.count("*").alias("n")), "copies")
    n, again = copies.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    again = small(copies.filter("n > 1").select("copy"), 48 * again)
    words = docs.select("copy", _terms(F.col("text")).alias("words"))
    repeated = stored(words.join(again, "copy", "left_semi").dropDuplicates(["copy"]), "repeated")
    return stored(spans, "spans"), words.join(again, "copy", "left_anti").unionByName(repeated), n


def _classes(rows: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (copy, item): the items with their class, which all items of the same
    texts share, and how many texts that is; and the texts of each class (copy, class)."""
    of = lambda *seed: F.bit_xor(F.xxhash64("copy", *map(F.lit, seed)))
    items = rows.groupBy(item).agg(F.count("*").alias("df"), of(1).alias("x"), of(2).alias("y"))
    items = stored(items.filter("df > 1").select(item, "df", F.xxhash64("x", "y", "df").alias("class")), "classed")
    n, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(item)), F.lit(0))).first()
    held = rows.join(small(items.select(item, "class"), n_bytes + 32 * n), item).select("copy", "class").distinct()
    return items, stored(held, "held")


def _pairs(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """entity, term, joint: how many texts hold both of two classes, two at least.
    entities, terms: copy, class. Of an entity's texts the one with the most terms gives
    none, as a term of two texts is in another one too; it's asked for those of the
    others alone."""
    sizes = terms.groupBy("copy").agg(F.count("*").alias("k"))
    sized = entities.join(sizes, "copy").select("copy", F.col("class").alias("entity"), "k")
    largest = stored(sized.groupBy("entity").agg(F.max_by("copy", F.struct("k", "copy")).alias("largest")), "largest")
    rest = sized.join(largest, "entity").filter("copy <> largest").select("copy", "entity")
    rest = rest.join(terms.withColumnRenamed("class", "term"), "copy").groupBy("entity", "term").agg(F.count("*").alias("k"))
    rest = stored(rest.join(largest, "entity"), "rest")
    own = terms.select(F.col("copy").alias("largest"), F.col("class").alias("term"), F.lit(1).alias("own"))
    joint = F.col("k") + F.coalesce("own", F.lit(0))
    return rest.join(own, ["largest", "term"], "left").select("entity", "term", joint.alias("joint")).filter("joint > 1")


def disclosing(mentions: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """term, disclosure, action: the terms that reveal an entity, from what `found_in`
    gives. Entities of the same texts are one class, and so are terms of the same texts
    with entities: a list of addresses that is posted twice is one pair of classes."""
    entities, of_entities = _classes(mentions.select("copy", F.explode("entities").alias("entity")), "entity")
    near = mentions.select("copy", "words").join(of_entities.select("copy").distinct(), "copy", "left_semi")
    terms, of_terms = _classes(near.select("copy", F.explode("words").alias("term")), "term")
    pairs = stored(_pairs(of_entities, of_terms), "pairs")
    frequency = entities.select(F.col("class").alias("entity"), F.col("df").alias("df_entity")).distinct()
    found = stored(pairs.join(frequency, "entity").select(F.col("term").alias("class"), "joint", "df_entity").distinct(), "found")
    candidates = stored(terms.join(found.select("class").distinct(), "class", "left_semi").select("term", "class"), "candidates")
    n, n_bytes = candidates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if not n:
        return candidates.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action"))
    every = words.select(F.explode("words").alias("term"))
    if n_bytes + 32 * n <= BROADCAST_BYTES:  # beyond it all words are counted, and the join is of counts
        every = every.join(F.broadcast(candidates.select("term")), "term", "left_semi")
    df = every.groupBy("term").agg(F.count("*").alias("df_term"))
    scored = candidates.join(df, "term").join(found, "class").filter((F.col("df_entity") < total) & (F.col("joint") >= SHARE * F.col("df_term")))
    joint, term, entity, others = F.col("joint") - 1, F.col("df_term") - 1, F.col("df_entity") - 1, total - 1
    scored = scored.withColumn("d", F.log(joint * others / (term * entity)) / F.log(F.lit(others) / entity))
    best = scored.groupBy("term").agg(F.max("d").alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    return stored(best.withColumn("action", F.when(F.col("disclosure") >= REMOVE, F.lit("remove")).otherwise("generalise")), "terms")


def _spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """copy, terms: where the texts (copy, text) hold terms (term, action). The words of
    each text are found by one pattern and placed by a running sum of their lengths."""
    n, n_bytes = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    found = F.arrays_zip(F.split("text", WORD, -1).alias("gap"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"))
    rows = texts.select("copy", F.posexplode(found).alias("i", "x")).select("copy", "i", F.length("x.gap").alias("gap"), "x.word")
    before = Window.partitionBy("copy").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = F.coalesce(F.length("word"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + long).over(before).cast("int")).withColumn("term", F.lower("word"))
    rows = rows.join(small(terms.select("term", "action"), n_bytes + 64 * n), "term")
    span = F.struct((F.col("end") - F.length("word")).alias("start"), F.col("end"), F.col("action"))
    return rows.groupBy("copy").agg(F.array_sort(F.collect_list(span)).alias("found"))


def _marked(docs: DataFrame, mentions: DataFrame, words: DataFrame, terms: DataFrame) -> DataFrame:
    """docs with base and `terms`, the spans of disclosing terms outside the base spans;
    the value says what to do with one."""
    n, n_bytes = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n:
        # the texts that hold any are fetched once each, however many copies they have
        held = words.select("copy", F.explode("words").alias("term")).join(small(terms.select("term"), n_bytes + 32 * n), "term", "left_semi").select("copy").distinct()
        texts = stored(docs.select("copy", "text").join(stored(held, "holding").hint("shuffle_hash"), "copy", "left_semi").dropDuplicates(["copy"]), "texts")
        marks = mentions.select("copy", "base").join(_spans(texts, terms), "copy", "full")
    else:
        marks = mentions.select("copy", "base", F.array().cast("array<struct<start:int,end:int,action:string>>").alias("found"))
    apart = F.filter("found", lambda s: ~F.exists(F.coalesce("base", F.array().cast(SPAN)), lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    found = F.transform(apart, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("value")))
    marks = stored(marks.select("copy", "base", found.alias("terms")), "marks")
    parts = F.coalesce(F.size("base"), F.lit(0)) + F.coalesce(F.size("terms"), F.lit(0))
    rows, spans = marks.agg(F.count("*"), F.coalesce(F.sum(parts), F.lit(0))).first()
    marks = F.broadcast(marks) if 64 * rows + 96 * spans <= BROADCAST_BYTES else marks.hint("shuffle_hash")  # grows with the documents
    none = F.array().cast(SPAN)
    return docs.join(marks, "copy", "left").withColumn("base", F.coalesce("base", none)).withColumn("terms", F.coalesce("terms", none))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


RESULTS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def sanitised(documents: DataFrame) -> DataFrame:
    """The documents' columns with text replaced, and n_email, n_ip, n_card,
    n_phone, base_sha256 and spans of the original text."""
    own = F.struct(*(c for c in documents.columns if c not in ("text", *RESULTS)))
    docs = documents.select(own.alias("own"), F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    mentions, words, total = found_in(docs)
    out = _marked(docs, mentions, words, disclosing(mentions, words, total))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("own.*", _cleaned().alias("text"), *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"))
