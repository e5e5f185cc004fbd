"""The pipeline's stages, one after the other, on the smallest tables."""

import re

import pyarrow as pa

import corpus_pipeline as P
from tidemark.llm import near
from tidemark.llm._common import BATCH_BYTES, read, stored


def test_stages_act_on_what_came_before(spark, sf):
    docs, seen = read(spark, sf, "documents"), {}
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == list(P.COLUMNS)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["language", "near", "contamination", "privacy", "packing"]
    assert set(seen["privacy"]) == set(seen["contamination"]) < set(seen["near"]) < set(seen["language"])
    groups = near.classes(read(spark, sf, "documents")).collect()
    assert set(seen["near"]) == {r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]} & set(seen["language"])
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in seen["privacy"].values())
    assert len(seen["contamination"]) > 0.9 * len(seen["near"])
    rows = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in rows} == set(seen["privacy"])


def test_one_of_repeated_ids_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, None, None, None, None), (None, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] for r in P.near_stage(spark, docs, "").collect()), key=str)
    assert got == [1, 3, None]


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, c), (3, c), (3, c), (5, c + " end"), (5, d), (5, e), (5, e), (7, e), (8, " \n"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.near_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, a), (None, b), (3, c), (5, d), (5, e), (8, " \n"), (8, None), (None, "")], key=str)


def test_stages_take_an_empty_table(spark, sf):
    docs = read(spark, sf, "documents").limit(0)
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), f"empty-{name}")
        assert docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, sf).count() == 0


def test_stages_hand_small_batches_to_python(spark):
    text = "some words of a text " * 1000
    docs = spark.range(800).selectExpr("id AS doc_id", f"'{text}' AS text", "'en' AS lang", "'s' AS source", f"{len(text)}L AS n_chars").coalesce(1)
    P.language_stage(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 16_000_000 and max(found) < 1.5 * BATCH_BYTES
