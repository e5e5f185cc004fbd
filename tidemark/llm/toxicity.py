"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of lexicon terms, their distance
from second-person words, shares of capitals, punctuation and obfuscated words
(digits or signs inside a word). The lexicon holds a short fixed list and terms and
stems (beginnings of words, for languages that inflect and compound) learned from
labelled rows by their smoothed log-odds. Trees of depth 3 fit the
logistic loss on binned features; out-of-fold scores are calibrated by isotonic
regression (pool adjacent violators).

Training uses a bounded sample of labelled rows, `SAMPLE` at most by a hash of the
id. Scoring sees all rows: a worker looks each distinct token up once.

Defined cases: a null or empty text has features of zero and gets a score like any
other. Without labelled rows of both kinds every score is the share of toxic ones,
or 0 without any. Repeated rows each get a row and equal texts equal scores; an id
with several labels counts with each, null labels and ids not at all. Very long texts
are scored whole. Other columns are kept as they are, but a score, which is replaced;
an empty table gives no rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import TokenTable, chunks, in_one_task, sampled, segment_sum, small, texts

SAMPLE, TREES, DEPTH, RATE, BINS, LEAST, FOLDS = 6000, 60, 3, 0.15, 32, 8, 5
NEAR = 6
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
#: Insults that are in the lexicon without training.
LEXICON = ("clown", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
#: Second-person words of the four languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros", "vuestro")
#: Signs and digits that stand for letters.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]")
#: Columns of a token's row.
LEX, WEIGHT, YOU, LETTERS, CAPITALS, PUNCTUATION, OBFUSCATED, SHOUTED, LENGTH = range(9)


def plain(token: str) -> str:
    """The token in lower case, without punctuation and with signs as letters."""
    t = _EDGE.sub("", token.lower())
    if t.isalpha():
        return t
    return "".join(c for c in t.translate(STANDS_FOR) if c.isalpha()) if any(c.isalpha() for c in t) else ""


def weight_of(p: str, lexicon: dict[str, float]) -> float:
    """The largest weight of the term and its stems, 0 outside the lexicon."""
    return max(lexicon.get(p, 0.0), *(lexicon.get(f"{p[:n]}*", 0.0) for n in STEMS))


def token_rows(tokens: list[str], lexicon: dict[str, float]) -> np.ndarray:
    out = np.zeros((len(tokens), 9))
    for i, t in enumerate(tokens):
        p, letters, capitals = plain(t), sum(map(str.isalpha, t)), sum(map(str.isupper, t))
        hidden = bool(_INNER.search(t))
        weight = weight_of(p, lexicon) if p else 0.0
        out[i] = (weight > 0, weight, p in _YOU, letters, capitals, sum(not c.isalnum() for c in t), hidden, letters > 2 and capitals == letters, len(t))
    return out


_YOU = frozenset(SECOND_PERSON)
FEATURES = ("log_tokens", "lexicon", "lexicon_density", "lexicon_weight", "weight_density", "largest_weight", "near_you", "you_density", "capitals", "punctuation", "obfuscated", "shouted", "token_length")


def features(table: TokenTable, docs: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    rows, counts = table.of([d.split() for d in docs])
    sums = segment_sum(rows, counts)
    n = np.maximum(counts, 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    largest, close = np.zeros(len(counts)), np.zeros(len(counts))
    hits = np.flatnonzero(rows[:, LEX] > 0) if len(rows) else np.zeros(0, np.int64)
    if len(hits):
        np.maximum.at(largest, owner[hits], rows[hits, WEIGHT])
        you = np.flatnonzero(rows[:, YOU] > 0)
        if len(you):
            k = np.searchsorted(you, hits)
            # the next one at or after the hit, and the last one before it
            for there, at in ((k < len(you), k), (k > 0, k - 1)):
                other = you[np.clip(at, 0, len(you) - 1)]
                ok = there & (owner[other] == owner[hits]) & (np.abs(other - hits) <= NEAR) & (other != hits)
                np.add.at(close, owner[hits[ok]], 1.0)
    letters = np.maximum(sums[:, LETTERS], 1)
    return np.column_stack(
        [np.log1p(counts), sums[:, LEX], sums[:, LEX] / n, sums[:, WEIGHT], sums[:, WEIGHT] / n, largest, close, sums[:, YOU] / n, sums[:, CAPITALS] / letters, sums[:, PUNCTUATION] / np.maximum(sums[:, LENGTH], 1), sums[:, OBFUSCATED] / n, sums[:, SHOUTED] / n, sums[:, LENGTH] / n]
    )


@dataclass
class Trees:
    """Boosted trees; a node is (feature, edge, left, right, value), leaves have feature -1."""

    base: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            f, e, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= e[at], left[at], right[at])
                at = np.where(inner, go, at)
            out += v[at]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    raw = np.full(len(y), model.base)
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        nodes: list = []

        def grow(rows: np.ndarray, depth: int, nodes: list = nodes, g: np.ndarray = g, h: np.ndarray = h) -> int:
            me = len(nodes)
            value = -RATE * g[rows].sum() / (h[rows].sum() + 1)
            nodes.append((-1, 0.0, me, me, value))
            best = (1e-3, None)
            if depth < DEPTH and len(rows) >= 2 * LEAST:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if len(e):
                        b = binned[rows, f]
                        gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                        gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], (f, k))
            if best[1]:
                f, k = best[1]
                low = binned[rows, f] <= k
                left, right = grow(rows[low], depth + 1), grow(rows[~low], depth + 1)
                nodes[me] = (f, float(edges[f][k]), left, right, 0.0)
            else:
                raw[rows] += value
            return me

        grow(np.arange(len(y)), 0)
        model.trees.append(nodes)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (scores, values) of the rising fit of y on score."""
    levels, level = np.unique(score, return_inverse=True)  # equal scores are one point
    blocks: list[list[float]] = []  # sum, number, first score, last score
    for s, v, n in zip(levels, np.bincount(level, y), np.bincount(level), strict=True):
        blocks.append([v, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([x for b in blocks for x in ((b[2], b[3]) if b[2] < b[3] else (b[2],))])
    value = np.array([x for b in blocks for x in [b[0] / b[1]] * (2 if b[2] < b[3] else 1)])
    # no score is 0 or 1, which half a row of the other kind would keep it from
    least = 0.5 / (len(y) + 1)
    return at, np.clip(value, least, 1 - least)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.value[0])
        raw = self.trees.raw(x)
        # a trace of the raw score orders the rows of one step; a step itself never falls
        return np.clip(np.interp(raw, self.at, self.value) + 1e-4 * np.tanh(raw / 4), 0, 1)


def learned_lexicon(docs: list[str], y: np.ndarray, most: int = 400) -> dict[str, float]:
    """The fixed list, and terms and stems ("abcd*") with log-odds above 2 that
    enough toxic texts hold (1 in 80, 4 at least); the `most` of largest log-odds times
    texts, a bound on the model's size."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for d, v in zip(docs, y, strict=True):
        terms = {p for t in set(d.split()) if (p := plain(t))}
        seen[int(v)].update(terms)
        seen[int(v)].update({f"{p[:n]}*" for p in terms for n in STEMS if len(p) >= n})
    n1, n0 = y.sum(), (1 - y).sum()
    odds = {w: (k, float(np.log((k + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1)))) for w, k in seen[1].items() if k >= max(4, n1 / 80)}
    top = sorted(((k, v, w) for w, (k, v) in odds.items() if v > 2), key=lambda p: (-p[0] * p[1], len(p[2]), p[2]))[:most]
    return {w: 3.0 for w in LEXICON} | {w: v for _, v, w in top}


def fitted(docs: list[str], labels: list[int]) -> Model:
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    # the lexicon must not have seen the rows that it describes, so each fold has its own
    fold = np.array([zlib.crc32(f"fold{d}".encode()) % FOLDS for d in docs])
    out = np.zeros((len(y), len(FEATURES)))
    for k in range(FOLDS):
        lexicon = learned_lexicon([d for d, f in zip(docs, fold, strict=True) if f != k], y[fold != k])
        at = np.flatnonzero(fold == k)
        if len(at):
            out[at] = features(TokenTable(lambda t, lexicon=lexicon: token_rows(t, lexicon)), [docs[i] for i in at])
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.any() and (~rest).any():
            raw[~rest] = boosted(out[rest], y[rest]).raw(out[~rest])
    at, value = isotonic(raw, y)
    return Model(learned_lexicon(docs, y), boosted(out, y), at, value)


def trained(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from (doc_id, toxic) in `labels` and the documents' texts."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    chosen = sampled(rows, "doc_id", rows.count(), most)
    sample = documents.select("doc_id", "text").join(small(chosen, 16 * most), "doc_id").select("text", "y")

    def fit(table: pa.Table) -> Model:
        found = sorted(zip(texts(table), table["y"].to_pylist(), strict=True), key=lambda r: (zlib.crc32(r[0].encode()), r))
        return fitted([r[0] for r in found], [r[1] for r in found])

    return in_one_task(sample, fit)


_SCHEMA = T.StructType([T.StructField("score", T.DoubleType())])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """The documents' columns with score."""
    docs = documents.drop("score")
    columns = docs.columns
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = TokenTable(lambda t: token_rows(t, model.lexicon))
        for whole in batches:
            for batch in chunks(whole):
                score = model.scores(features(table, texts(batch)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*columns, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *_SCHEMA]))
