"""Language identification: averaged hashed subword embeddings, a linear softmax
trained by stochastic gradient descent in numpy, and calibrated rejection.

A token's subwords are its character n-grams of 1 to 4 with edge marks, hashed
into buckets with an embedding each. A document's vector is the average over all
its tokens' subwords; a linear layer and a softmax follow. As the layer is linear,
scoring sums each token's class scores, which a worker computes once a token.

Training uses a bounded sample of labelled rows (`SAMPLE` for each language, by a
hash of the id); a fifth of it is held back to fit the softmax temperature and the
rejection threshold: the confidence that all but 1 in 1000 correct predictions
reach, and never more than `MOST_REJECT`.

Defined cases: a null text or one without a letter is `und` with score 0 and is
rejected. With no labelled row at all, everything is `und`. Ties go to the
language that sorts first. Repeated rows each get a row and equal texts equal
predictions. Very long texts are read whole. Other columns are kept as they are, but
those named like a result, which are replaced; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import TokenTable, chunks, in_one_task, segment_sum, small, stored, texts

SAMPLE, BUCKETS, DIM, EPOCHS, BATCH, RATE = 400, 1 << 15, 12, 4, 16, 0.5
MOST_REJECT = 0.5
NGRAMS = (1, 2, 3, 4)


def subwords(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the tokens, and the token that it belongs to.
    Characters other than letters count as edges."""
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = ["".join([c if c.isalpha() else "_" for c in f"_{t.lower()}_"]) for t in tokens]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    edge = chars == ord("_")
    found, owners = [], []
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ (chars[n - 1 :] + np.uint64(n << 24))
        h ^= h >> np.uint64(29)
        # within one token, and of edges only the first and last character may be one
        ok = owner[:m] == owner[n - 1 :]
        for k in range(1, n - 1):
            ok &= ~edge[k : k + m]
        if n <= 2:
            ok &= ~(edge[:m] & edge[n - 1 :])
        at = np.flatnonzero(ok)
        mixed = h[at] * np.uint64(0xD6E8FEB86659FD93)
        found.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """Summed class scores and number of subwords of each token."""
        buckets, owner = subwords(tokens)
        out = np.zeros((len(tokens), len(self.langs) + 1))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.scores[buckets, k], len(tokens))
        out[:, -1] = np.bincount(owner, minlength=len(tokens))
        return out

    def probabilities(self, table: TokenTable, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Softmax of each document, and whether it has a subword."""
        sums = segment_sum(*table.of([d.split() for d in docs]))
        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), sums[:, -1] > 0


def fitted(docs: list[str], labels: list[str], seed: int = 9) -> Model:
    """Trains on texts with known languages."""
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    held = order[: len(docs) // 5] if len(docs) >= 20 else order[:0]
    train = order[len(held) :]
    bags = []
    for d in docs:
        b, n = np.unique(subwords(d.split())[0], return_counts=True)
        bags.append((b, n / max(1, n.sum())))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    share = np.bincount(y[train], minlength=len(langs)) / max(1, len(train))
    weight = 1 / np.maximum(share * len(langs), 0.05)
    steps = EPOCHS * -(-len(train) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for a in range(0, len(train), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            part = [i for i in train[a : a + BATCH] if len(bags[i][0])]
            if not part:
                continue
            idx = np.concatenate([bags[i][0] for i in part])
            w = np.concatenate([bags[i][1] for i in part])
            counts = np.array([len(bags[i][0]) for i in part])
            v = segment_sum(emb[idx] * w[:, None], counts)
            z = v @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p
            g[np.arange(len(part)), y[part]] -= 1
            g *= weight[y[part]][:, None]
            gv = g @ out.T
            out -= rate * v.T @ g / len(part)
            bias -= rate * g.mean(axis=0)
            # a subword's share of a document is small; its step is scaled up to make up for that
            np.subtract.at(emb, idx, rate * 20 * w[:, None] * np.repeat(gv, counts, axis=0))
    model = Model(langs, emb @ out, bias)
    if len(held):
        table = TokenTable(model.token_rows)
        check, truth = [docs[i] for i in held], y[held]
        best = (np.inf, 1.0)
        for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
            model.temperature = t
            p, _ = model.probabilities(table, check)
            best = min(best, (-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-9)).mean(), t))
        model.temperature = best[1]
        p, some = model.probabilities(table, check)
        right = p.max(axis=1)[(p.argmax(axis=1) == truth) & some]
        if len(right):
            model.reject = float(min(MOST_REJECT, np.quantile(right, 0.001)))
    return model


def trained(documents: DataFrame, per_language: int = SAMPLE) -> Model | None:
    """A model from the rows of `documents` with a lang; None without any. At
    most about `per_language` rows of each language are used."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = stored(rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")), "langs")
    n, n_bytes = counts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_lang")), F.lit(0))).first()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    rows = rows.join(small(counts, n_bytes + 48 * n), F.col("lang") == F.col("_lang")).filter(draw < F.lit(float(per_language)) / F.col("_n") * (1 << 30))

    def fit(sample: pa.Table) -> Model:
        """In the order of the rows' hashes, so that the outcome doesn't hang on theirs."""
        found = sorted(zip(sample["text"].to_pylist(), sample["lang"].to_pylist(), strict=True), key=lambda r: (zlib.crc32(r[0].encode()), r))
        return fitted([r[0] for r in found], [r[1] for r in found])

    return in_one_task(rows.select("text", "lang"), fit)


_SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents' columns with lang_pred, score and rejected."""
    docs = documents.drop(*_SCHEMA.names)
    columns = docs.columns
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = TokenTable(model.token_rows) if model else None
        for whole in batches:
            for batch in chunks(whole):
                docs = texts(batch)
                letters = np.array([any(map(str.isalpha, d)) for d in docs], dtype=bool)
                if model:
                    p, _ = model.probabilities(table, docs)
                    pred = np.where(letters, np.array(model.langs, dtype=object)[p.argmax(axis=1)], "und")
                    score = np.where(letters, p.max(axis=1), 0.0)
                    rejected = ~letters | (score < model.reject)
                else:
                    pred, score, rejected = np.full(len(docs), "und", dtype=object), np.zeros(len(docs)), np.ones(len(docs), dtype=bool)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=[*columns, *_SCHEMA.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *_SCHEMA]))
