"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` tokens. A passage's vector holds the mean
of its tokens' hashed embeddings (random signs) and of their shapes (length,
capitals, symbols, digits, marks), and its share of distinct tokens. A layer
encodes it; gated attention, softmax(w (tanh(V h) * sigmoid(U h))), weighs the
passages; a logistic unit scores the weighted sum. Only documents have labels: the
attention weights are learned from them. Training is full-batch Adam in numpy.

Training uses a bounded sample of labelled rows, `SAMPLE` at most by a hash of the
id; scoring sees all rows and whole texts.

Defined cases: a null or empty text is one passage of zeros. Without labelled rows
of both kinds every score is the share of good ones, or 0 without any. Repeated rows
each get a row and equal texts equal scores; an id with several labels counts with
each, null labels and ids not at all. Very long texts are scored whole. Other columns
are kept as they are, but a score, which is replaced; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import TokenTable, chunks, in_one_task, sampled, segment_sum, small, texts

SAMPLE, PASSAGE, EMBED, HIDDEN, GATE, EPOCHS, RATE = 4000, 128, 12, 12, 6, 250, 0.02
SHAPES = 7


def token_rows(tokens: list[str]) -> np.ndarray:
    """Hashed signs, then shapes, of each token."""
    out = np.zeros((len(tokens), EMBED + SHAPES))
    signs = np.array([zlib.crc32(t.lower().strip(".,;:!?\"'()").encode("utf-8", "surrogatepass")) for t in tokens], dtype=np.int64)
    if len(tokens):
        out[:, :EMBED] = ((signs[:, None] >> np.arange(EMBED)) & 1) * 2.0 - 1.0
    for i, t in enumerate(tokens):
        n = len(t)
        letters, upper, digits = sum(map(str.isalpha, t)), sum(map(str.isupper, t)), sum(map(str.isdigit, t))
        marks = sum(c in ".,;:!?\"'()-" for c in t)
        out[i, EMBED:] = (np.log1p(n), upper / n, digits / n, marks / n, (n - letters - digits - marks) / n, letters == 0, t[-1] in ".!?")
    return out


def passages(table: TokenTable, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All passages' vectors and each text's number of passages."""
    split = [d.split() for d in docs]
    rows, counts = table.of(split)
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    index = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    sizes = np.minimum(PASSAGE, np.repeat(counts, per_doc) - index * PASSAGE)
    sizes = np.maximum(sizes, 0)
    x = segment_sum(rows, sizes) / np.maximum(sizes, 1)[:, None]
    distinct = [len(set(t[a : a + PASSAGE])) for t in split for a in range(0, max(1, len(t)), PASSAGE)]
    return np.column_stack([x, np.array(distinct) / np.maximum(sizes, 1), np.log1p(sizes)]), per_doc


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(((x - self.mean) / self.scale) @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        a = ((t * s) @ w["a"])[:, 0]
        a = a - np.repeat(np.maximum.reduceat(a, np.cumsum(counts) - counts), counts)
        a = np.exp(a)
        a /= np.repeat(segment_sum(a, counts), counts)
        z = segment_sum(a[:, None] * h, counts)
        return {"h": h, "t": t, "s": s, "att": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])[:, 0]}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), self.constant) if self.constant is not None else self.forward(x, counts)["p"]


def fitted(docs: list[str], labels: list[int], seed: int = 3) -> Model:
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 0.0)
    x, counts = passages(TokenTable(token_rows), docs)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    shape = {"E": (x.shape[1], HIDDEN), "e": (1, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE, 1), "c": (HIDDEN, 1), "d": (1, 1)}
    model = Model(mean, scale, {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k.isupper() or k in "ac" else np.zeros(s) for k, s in shape.items()})
    xs, w = (x - mean) / scale, model.w
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        f = model.forward(x, counts)
        h, t, s, att, z = (f[k] for k in ("h", "t", "s", "att", "z"))
        dl = ((f["p"] - y) / len(y))[:, None]
        g = {"c": z.T @ dl, "d": dl.sum(axis=0, keepdims=True)}
        dz = np.repeat(dl @ w["c"].T, counts, axis=0)
        dh = att[:, None] * dz
        # through the softmax of a bag
        da = (dz * h).sum(axis=1)
        da = att * (da - np.repeat(segment_sum(att * da, counts), counts))
        gate = da[:, None] * w["a"].T
        g["a"] = (t * s).T @ da[:, None]
        dt, ds = gate * s * (1 - t**2), gate * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh += dt @ w["V"].T + ds @ w["U"].T
        de = dh * (1 - h**2)
        g["E"], g["e"] = xs.T @ de, de.sum(axis=0, keepdims=True)
        for k in w:
            grad = g[k] + (1e-4 * w[k] if k not in "ed" else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad**2
            w[k] = w[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def trained(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from (doc_id, quality) in `labels` and the documents' texts."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    chosen = sampled(rows, "doc_id", rows.count(), most)
    sample = documents.select("doc_id", "text").join(small(chosen, 16 * most), "doc_id").select("text", "y")

    def fit(table: pa.Table) -> Model:
        found = sorted(zip(texts(table), table["y"].to_pylist(), strict=True), key=lambda r: (zlib.crc32(r[0].encode()), r))
        return fitted([r[0] for r in found], [r[1] for r in found])

    return in_one_task(sample, fit)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """The documents' columns with score."""
    docs = documents.drop("score")
    columns = docs.columns
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable(token_rows)
        for whole in batches:
            for batch in chunks(whole, 4_000_000):
                x, counts = passages(table, texts(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(x, counts))], names=[*columns, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType())]))
