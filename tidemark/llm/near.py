"""Exact Jaccard self-join of n-gram sets and its connected components.

A document's set holds the 64-bit hashes of its distinct n-word shingles. Sets are
grouped by a hash of their content first, so that copies count once. Two sets of
sizes a <= b that reach the threshold t differ in at most H = (a+b)(1-t)/(1+t)
hashes and have a >= tb. Sizes fall into bands [lo, lo/t]; the smaller set's band
fixes H and a partition of the hash universe into m segments, of which the first D
tolerate one difference: a set emits a signature for each segment's subset and,
in those D, for the subset without each one of its elements. As m + D > H, two
linked sets share a signature. m and D come from a cost model: signatures emitted,
subject to slack for empty segments, which emit nothing; a set with more empty
segments than the slack emits those too, so no pair is lost. A set takes part in
its own band and in the one below, where its smaller partners are.

Signatures meet by hash bucket, as binary blocks. A signature that more than
`SMALL` sets of one task hold is combined there: its sets are paired with one hub,
and only the hub goes on, so that no block grows with a hot group. A group of up to
`SMALL` sets gives all its pairs; a larger one gives a star. Pairs are verified on
the texts' whole sets, best pairs first: each set with the partner it shares most
signatures with, then those whose ends aren't connected yet.

Before, sets leave that have too many lone elements, which no other set of a pair has (two
sets that link share t of either): long texts share a signature with many others by a common
line, and nothing else. Once roots are known, elements within one root are lone, too, as
only pairs of different roots are left. What a
large group's star leaves apart is settled exactly, without the group's pairs, by
differences to one of its sets (see `families`): stars of sure links, sets that can have
no other link, and signatures of segments of the differences.

Defined cases: null or wordless texts have an empty set and are linked with
nothing. A text with fewer words than n has one shingle, its whole sequence.
Repeated rows and repeated ids each get a row; ties take the smallest id. Very long texts are
taken whole; other columns are ignored, whatever their names. Null ids take part like any other; a component's id is its smallest, null if it has none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, chunks, freed, small, stored
from .families import linked_families

WORDS, NUM, DEN = 5, 80, 100
SMALL = 6
BLOCK_BYTES = 24 << 20
#: Sets whose counts a task holds at once, about.
COUNTS = 1 << 20
#: Pairs of one set that a task verifies together, about.
PARTNERS = 256
#: Links that one task contracts at once.
BLOCK_LINKS = 200_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _shingled(text: str | None, n: int) -> np.ndarray:
    """The hashes of a text's shingles, one after the other."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    get = _hashes.__getitem__
    ids = np.array([get(w) for w in words], dtype=np.uint64)
    k, h = min(n, len(ids)), np.zeros(max(1, len(ids) - n + 1), np.uint64)
    h += np.uint64(k)
    for i in range(k):
        h = _mixed(h * _A + ids[i : i + len(h)])
    return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(_shingled(text, n))


def in_order(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles sorted, and in the order in which they first occur."""
    h = _shingled(text, n)
    s, first = np.unique(h, return_index=True)
    return s, h[np.sort(first)]


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@lru_cache(maxsize=None)
def band_of(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(index, lo, hi) of the size's band."""
    k, lo = 0, 1
    while True:
        hi = max(lo, lo * den // num)
        if size <= hi:
            return k, lo, hi
        k, lo = k + 1, hi + 1


@lru_cache(maxsize=None)
def allocation(lo: int, hi: int, num: int, den: int) -> tuple[int, int, int]:
    """(m, D, slack) for a band: the cheapest number of segments and of segments
    with one-deletion neighbours."""
    most = (hi + hi * den // num) * (den - num) // (den + num)
    best = None
    for d in range(4):
        for m in range(max(1, d, most + 1 - d), most + 14 + most // 8):
            slack, mean = m + d - most - 1, lo / m
            empty = m * exp(-mean)
            if slack < 0 or (mean < 2.5 and lo > 3) or (empty + 2 * sqrt(empty) > slack + 0.5 and lo > 3):
                continue
            cost = m + d * hi / m
            if best is None or cost < best[0]:
                best = (cost, m, d, slack)
    if best is None:  # tiny bands: whole sets, all their differences in one segment each
        best = (0, most + 1, 0, 0)
    return best[1:]


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of a set, in its band and the one below."""
    if not len(s):
        return np.zeros(0, np.uint64)
    size, out = len(s), []
    k, lo, hi = band_of(size, num, den)
    bands = [(k, lo, hi)]
    if lo > 1 and (size * num + den - 1) // den < lo:
        bands.append(band_of(lo - 1, num, den))
    extra = _mixed(s + _A)
    for k, lo, hi in bands:
        m, d, slack = allocation(lo, hi, num, den)
        seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
        ids, sums = seg[starts], np.add.reduceat(extra, starts)
        salt = (ids + np.uint64(k << 32)) * _A
        own = [_mixed(sums ^ _mixed(salt))]
        units = np.ones(m, dtype=np.int64)
        units[:d] += 1
        full = np.zeros(m, dtype=bool)
        full[ids.astype(np.int64)] = True
        single = 0
        for i in range(min(d, len(ids))):
            if ids[i] < d:
                b = starts[i + 1] if i + 1 < len(starts) else size
                if b - starts[i] > 1:
                    own.append(_mixed((sums[i] - extra[starts[i] : b]) ^ _mixed(salt[i : i + 1])))
                else:
                    single += 2
        if units[~full].sum() + single > slack:
            # an empty subset's sum is zero; so is that of a single element's deletion
            bare = [np.flatnonzero(~full).astype(np.uint64)]
            bare += [ids[i : i + 1] for i in range(min(d, len(ids))) if ids[i] < d]
            at = np.concatenate(bare)
            own.append(_mixed(_mixed((at + np.uint64(k << 32)) * _A)))
        out += own
    return np.unique(np.concatenate(out))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _starts(sig: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1]) if len(sig) else np.zeros(0, np.int64)


def _grouped(sig: np.ndarray, fp: np.ndarray, heavy: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets that share a signature, and whether the group is a large one:
    more than `small` sets, or the hub of a task's combined group is among them."""
    order = np.lexsort((fp, sig))
    sig, fp, heavy = sig[order], fp[order], heavy[order]
    many = np.logical_or.reduceat(heavy, _starts(sig)) if len(sig) else heavy
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])]) if len(sig) else np.zeros(0, bool)
    sig, fp = sig[keep], fp[keep]
    starts = _starts(sig)
    sizes = np.diff(np.concatenate([starts, [len(sig)]]))
    many = many | (sizes > small)
    a, b, big = [], [], []
    for n in range(2, small + 1):
        at = starts[(sizes == n) & ~many]
        for i in range(n):
            for j in range(i + 1, n):
                a.append(fp[at + i])
                b.append(fp[at + j])
                big.append(np.zeros(len(at), bool))
    many &= sizes > 1
    if many.any():
        at, n = starts[many], sizes[many]
        rest = np.concatenate([np.arange(s + 1, s + k) for s, k in zip(at, n, strict=True)])
        a.append(np.repeat(fp[at], n - 1))
        b.append(fp[rest])
        big.append(np.ones(len(rest), bool))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(a), np.concatenate(b), np.concatenate(big)


class _Combiner:
    """Map-side combination of the signatures that many sets of a task hold."""

    def __init__(self, small: int) -> None:
        self.small, self.sig, self.hub = small, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, sig: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of rows (sig, fp): those that go on, whether they are hubs, and the pairs
        (hub, fp) of the rest."""
        order = np.lexsort((fp, sig))
        sig, fp = sig[order], fp[order]
        starts = _starts(sig)
        sizes = np.diff(np.concatenate([starts, [len(sig)]]))
        at = np.searchsorted(self.sig, sig[starts])
        known = np.zeros(len(starts), bool)
        inside = at < len(self.sig)
        known[inside] = self.sig[at[inside]] == sig[starts][inside]
        hot = known | (sizes > self.small)
        if not hot.any():
            return sig, fp, np.zeros(len(sig), bool), fp[:0], fp[:0]
        of_hot = np.repeat(hot, sizes)
        ids, inverse, counts = np.unique(fp[of_hot], return_inverse=True, return_counts=True)
        # the hub is the set that is in most hot groups, so that groups share hubs
        weight = np.zeros(len(sig), np.int64)
        weight[of_hot] = counts[inverse]
        by = np.lexsort((fp, -weight, sig))
        best = by[starts]
        hub = fp[best]
        hub[known] = self.hub[at[known]]
        new = hot & ~known
        if len(self.sig) > 1_000_000:
            self.sig, self.hub = self.sig[:0], self.hub[:0]
        self.sig, self.hub = np.concatenate([self.sig, sig[starts][new]]), np.concatenate([self.hub, hub[new]])
        order = np.argsort(self.sig, kind="stable")
        self.sig, self.hub = self.sig[order], self.hub[order]
        a, b = np.repeat(hub, sizes)[of_hot], fp[of_hot]
        apart = a != b
        light = ~of_hot
        out = np.concatenate([sig[light], sig[starts][new]]), np.concatenate([fp[light], hub[new]])
        flags = np.concatenate([np.zeros(int(light.sum()), bool), np.ones(int(new.sum()), bool)])
        return *out, flags, a[apart], b[apart]


def _pair_batch(a: np.ndarray, b: np.ndarray, n: np.ndarray, big: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs a < b with how often each was met."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, n, big = a[order], b[order], n[order], big[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    n = np.add.reduceat(n, starts) if len(starts) else n
    any_big = np.logical_or.reduceat(big, starts) if len(starts) else big
    return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(n.astype(np.int64)), pa.array(any_big.astype(bool))], names=["a", "b", "n", "big"])


def row_key() -> Column:
    """A key of a row's id and text, the same whenever it is computed."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def worded() -> Column:
    """Whether a text has a word, as `shingles` splits it."""
    return F.coalesce(F.col("text").rlike(r"[^\x09-\x0d\x20]"), F.lit(False))


def sets_of(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, row (its key), size, fp of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s := shingles(t, n)), fingerprint(s)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))], names=["doc_id", "row", "size", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row long, size long, fp long")


def candidates(documents: DataFrame, total: int, n: int, num: int, den: int, small: int) -> DataFrame:
    """Pairs a < b of fingerprints that share a signature: a, b, n, big. `total`
    is the number of shingles, which sets the number of blocks."""
    blocks = max(1, int(total * 0.45 * 16 / BLOCK_BYTES))
    buckets = 4 * blocks
    names, kinds = ["bucket", "kind", "x", "y"], (pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combine = _Combiner(small)
        for whole in batches:
            for batch in chunks(whole, 1_500_000):
                seen, sigs, fps = set(), [], []
                for t in batch.column("text").to_pylist():
                    s = shingles(t, n)
                    if len(s) and (fp := fingerprint(s)) not in seen:
                        seen.add(fp)
                        sigs.append(signatures(s, num, den))
                        fps.append(np.full(len(sigs[-1]), fp, np.int64))
                if not sigs:
                    continue
                sig, fp, hub, a, b = combine(np.concatenate(sigs), np.concatenate(fps))
                rows = []
                # kind 0: signatures, 1: signatures of hubs, 2: pairs
                for kind, x, y, at in ((0, sig[~hub], fp[~hub], sig[~hub]), (1, sig[hub], fp[hub], sig[hub]), (2, a, b, _mixed(b.view(np.uint64)))):
                    bucket = (at % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    x, y, bucket = x[order], y[order], bucket[order]
                    edges = np.searchsorted(bucket, np.arange(buckets + 1))
                    rows += [(k, kind, x[i:j].tobytes(), y[i:j].tobytes()) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[tuple[list[bytes], list[bytes]], ...]] = {}
        for batch in batches:
            for k, kind, x, y in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                xs, ys = held.setdefault(k, (([], []), ([], []), ([], [])))[kind]
                xs.append(x)
                ys.append(y)
        for k in list(held):
            light, hubs, pairs = held.pop(k)
            of = lambda parts, i, t: np.frombuffer(b"".join(parts[i]), t)
            sig, fp = (np.concatenate([of(light, i, t), of(hubs, i, t)]) for i, t in ((0, np.uint64), (1, np.int64)))
            heavy = np.arange(len(sig)) >= len(sig) - len(of(hubs, 0, np.uint64))
            a, b, big = _grouped(sig, fp, heavy, small)
            x, y = of(pairs, 0, np.int64), of(pairs, 1, np.int64)
            yield _pair_batch(np.concatenate([a, x]), np.concatenate([b, y]), np.ones(len(a) + len(x), np.int64), np.concatenate([big, np.ones(len(x), bool)]))

    emitted = documents.select("text").mapInArrow(emit, "bucket int, kind int, x binary, y binary")
    pairs = emitted.repartition(blocks, "bucket").mapInArrow(meet, "a long, b long, n long, big boolean")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("big").alias("big"))


def verified(pairs: DataFrame, sets: DataFrame, documents: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The links (a, b) among pairs (a, b) of fingerprints, by their whole sets; stored."""
    size = lambda s: sets.select(F.col("fp").alias(s), F.col("size").alias(f"size_{s}"), F.col("row").alias(f"row_{s}"))
    known = pairs.select("a", "b").join(size("a"), "a").join(size("b"), "b")
    near = F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num
    known = stored(known.filter(near).select("a", "b", "row_a", "row_b"), "pairs")
    freed(documents.sparkSession)  # the shuffles of the steps before, which the last query may still have held
    needed = _few(known.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct(), 32 * known.count())
    texts = documents.select(row_key().alias("row"), "text").filter("text IS NOT NULL").join(needed, "row", "left_semi")
    texts = stored(texts.dropDuplicates(["row"]), "texts", compression="zstd")
    # a set with many partners goes to several tasks, once each; its partners follow it
    many = known.groupBy("a").agg(F.count("*").alias("k")).filter(F.col("k") > PARTNERS)
    block = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("k", F.lit(1)) / PARTNERS)).alias("block")
    known = stored(known.join(many, "a", "left").select("a", "b", "row_a", "row_b", block), "blocks")
    heads = known.select("a", "block", F.lit(None).cast("long").alias("b"), F.col("row_a").alias("row")).distinct()
    sent = heads.unionByName(known.select("a", "block", "b", F.col("row_b").alias("row")))
    both = sent.join(texts.hint("shuffle_hash"), "row").select("a", "block", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, s, fs = None, np.zeros(0, np.uint64), 0
        for batch in batches:
            out = []
            for a, block, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b", "text")), strict=True):
                t = shingles(text, n)
                if b is None:
                    head, s, fs = (a, block), t, fingerprint(t)
                elif head == (a, block) and fs == a and fingerprint(t) == b and linked(s, t, num, den):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    both = both.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    links = stored(both.mapInArrow(run, "a long, b long").distinct(), "verified")
    freed(documents.sparkSession, texts)  # they're as large as the documents
    return links


def _contracted(links: DataFrame, blocks: int) -> DataFrame:
    """Links (a, b) from roots to nodes with the components of each block's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = [x for x in up if up[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

    return stored(links.repartition(blocks).mapInArrow(run, "a long, b long"), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the links (a, b); the root is the component's
    smallest node. Tasks contract blocks of links to stars; rounds of small messages
    join the stars of several blocks."""
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    blocks = max(1, -(-links.count() // BLOCK_LINKS))
    links = _contracted(links, blocks)
    if blocks == 1:
        return _roots(links)
    # stars in turn: each node's larger, then smaller, neighbours move to its smallest
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u"), "low")
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u"), "least")
        joined = large.join(least, F.col("b") == F.col("u"))
        new = joined.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).unionByName(joined.select(F.col("m").alias("a"), "b"))
        new = stored(new.filter("a <> b").distinct(), "links")
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            return _roots(new)
        links = new


def _roots(stars: DataFrame) -> DataFrame:
    """(node, root) of links from roots to nodes, roots included."""
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _rooted(rows: DataFrame, roots: DataFrame, column: str, to: str) -> DataFrame:
    """rows with the root of a column's node; a node without links is its own."""
    r = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(r, F.col(column) == F.col("_node"), "left").withColumn(to, F.coalesce("_root", column)).drop("_node", "_root")


def _of_texts(documents: DataFrame, wanted: DataFrame, sets: DataFrame, n: int, columns: dict[str, Callable[[np.ndarray, np.ndarray], object]], types: dict[str, str]) -> DataFrame:
    """fp and columns computed from the sets `wanted` (fp), sorted and in their texts'
    order; stored."""
    chosen = stored(wanted.join(sets.select("fp", "row"), "fp").select("row").distinct(), "chosen")
    docs = documents.select(row_key().alias("row"), "text").join(_few(chosen, 16 * chosen.count()), "row", "left_semi")
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 1_500_000):
                found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for t in batch.column("text").to_pylist():
                    s, ordered = in_order(t, n)
                    if len(s):
                        found[fingerprint(s)] = (s, ordered)
                out = [pa.array([f(*s) for s in found.values()], kinds[types[c]]) for c, f in columns.items()]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *out], names=["fp", *columns])

    schema = ", ".join(["fp long", *(f"{c} {types[c]}" for c in columns)])
    return stored(docs.select("text").mapInArrow(run, schema).dropDuplicates(["fp"]), "members", compression="zstd")


def _emitted(sets: list[tuple[int, int, np.ndarray]], buckets: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """Of sets (fp, root, elements), by bucket of the elements: fps, roots, how many elements
    each has there, and these. An element of several roots goes on with two of them alone."""
    own = np.repeat(np.arange(len(sets)), [len(s) for _, _, s in sets])
    fp, root = (np.array([x[i] for x in sets], np.int64) for i in (0, 1))
    elem = np.concatenate([s for _, _, s in sets])
    order = np.lexsort((root[own], elem))
    elem, own = elem[order], own[order]
    starts = _starts(elem)
    sizes = np.diff(np.concatenate([starts, [len(elem)]]))
    ends = starts + sizes - 1
    keep = np.repeat(root[own[starts]] == root[own[ends]], sizes)
    keep[starts] = keep[ends] = True
    elem, own = elem[keep], own[keep]
    bucket = (elem % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((own, bucket))
    elem, own, bucket = elem[order], own[order], bucket[order]
    runs = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]))
    n = np.diff(np.concatenate([runs, [len(elem)]]))
    at, edges = _starts(bucket), np.concatenate([_starts(bucket), [len(bucket)]])
    of = np.searchsorted(runs, edges)
    fp, root, n = fp[own[runs]], root[own[runs]], n.astype(np.int32)
    return [(int(bucket[i]), fp[a:b].tobytes(), root[a:b].tobytes(), n[a:b].tobytes(), elem[i:j].tobytes()) for i, j, a, b in zip(at, edges[1:], of[:-1], of[1:], strict=True)]


def _lone(fp: np.ndarray, root: np.ndarray, elem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets and how many of their elements no set of another root has; rows may recur."""
    order = np.lexsort((fp, elem))
    fp, root, elem = fp[order], root[order], elem[order]
    new = np.concatenate([[True], (elem[1:] != elem[:-1]) | (fp[1:] != fp[:-1])])
    fp, root, elem = fp[new], root[new], elem[new]
    starts = _starts(elem)
    one = np.minimum.reduceat(root, starts) == np.maximum.reduceat(root, starts)
    return np.unique(fp[np.repeat(one, np.diff(np.concatenate([starts, [len(elem)]])))], return_counts=True)


def accompanied(documents: DataFrame, members: DataFrame, n: int, num: int, den: int, share: float = 1) -> DataFrame:
    """The members (fp, size, row, root) that may link to one of another root: those of
    which num / den are also in sets of other roots, as far as a share of all hashes tells.
    Elements meet as binary blocks; their number is bounded by that of all shingles."""
    count, total = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, int(total * share * 24 / (2 * BLOCK_BYTES)))
    buckets, below = 4 * blocks, np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))
    names, kinds = ["bucket", "fp", "root", "n", "elem"], (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 1_500_000):
                found: dict[int, tuple[int, int, np.ndarray]] = {}
                for text, fp, root in zip(*(batch.column(c).to_pylist() for c in ("text", "fp", "root")), strict=True):
                    s = shingles(text, n)
                    if fingerprint(s) == fp:
                        found[fp] = (fp, root, s[: np.searchsorted(s, below, "right")])
                sets = [x for x in found.values() if len(x[2])]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_emitted(sets, buckets), strict=True), kinds, strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, fps, counts = None, ([], [], [], []), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def summed() -> tuple[np.ndarray, np.ndarray]:
            """The counts so far with those of the bucket that is held."""
            fp, root, many, elem = (np.frombuffer(b"".join(x), t) for x, t in zip(held, (np.int64, np.int64, np.int32, np.uint64), strict=True))
            fp, lone = _lone(np.repeat(fp, many), np.repeat(root, many), elem)
            fp, at = np.unique(np.concatenate([fps, fp]), return_inverse=True)
            return fp, np.bincount(at, np.concatenate([counts, lone]), len(fp)).astype(np.int64)

        row = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (fps, counts)], names=["fp", "lone"])
        for batch in batches:
            for k, *parts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if k != key and key is not None:
                    fps, counts = summed()
                    held = ([], [], [], [])
                    if len(fps) > COUNTS:
                        yield row()
                        fps, counts = fps[:0], counts[:0]
                key = k
                for kept, part in zip(held, parts, strict=True):
                    kept.append(part)
        if key is not None:
            fps, counts = summed()
            yield row()

    docs = documents.select(row_key().alias("row"), "text").join(_few(members.select("row", "fp", "root"), 24 * count), "row")
    emitted = docs.select("text", "fp", "root").mapInArrow(emit, "bucket int, fp binary, root binary, n binary, elem binary")
    # a set has a row of counts from each task; so their number follows the cores, and each reads its buckets in turn
    tasks = min(blocks, 2 * documents.sparkSession.sparkContext.defaultParallelism)
    lone = emitted.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "fp long, lone long").groupBy("fp").agg(F.sum("lone").alias("lone"))
    shared = F.col("size") - F.coalesce("lone", F.lit(0))
    out = stored(members.join(lone, "fp", "left").filter(shared * den >= F.col("size") * num).select(members.columns), "accompanied")
    freed(documents.sparkSession, members)  # the elements' shuffle
    return out


def _among(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) of two members (fp)."""
    held = small(members.select("fp"), 16 * members.count())
    for s in ("a", "b"):
        pairs = pairs.join(held.withColumnRenamed("fp", s), s, "left_semi")
    return pairs


def _few(rows: DataFrame, n_bytes: int) -> DataFrame:
    """rows, of n_bytes, to find documents by: broadcast if few, else without sorting texts."""
    out = small(rows, n_bytes)
    return out if out is not rows else rows.hint("shuffle_hash")


def members_of(documents: DataFrame, members: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """fp, size, sigs of the sets `members` (fp)."""
    return _of_texts(documents, members, sets, n, {"size": lambda s, _: len(s), "sigs": lambda s, _: signatures(s, num, den).view(np.int64)}, {"size": "long", "sigs": "array<long>"})


def hashes_of(documents: DataFrame, members: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """fp, hashes (in their text's order) of the sets `members` (fp)."""
    return _of_texts(documents, members, sets, n, {"hashes": lambda _, o: o.view(np.int64)}, {"hashes": "array<long>"})


def classes(documents: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents; sets link when
    den * |intersection| >= num * |union|."""
    return rooted_rows(documents, n, num, den, small).select("doc_id", "n_shingles", "component_id")


def rooted_rows(documents: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN, small: int = SMALL) -> DataFrame:
    """classes with each row's key and the root of its set's component, which tells
    components apart where ids don't (null or repeated ones); a row without words
    has no root."""
    found = stored(sets_of(documents, n), "sets")
    sets = found.filter("size > 0").groupBy("fp", "size").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.count("*").alias("copies"))
    sets = stored(sets, "classes")
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pairs = stored(candidates(documents, total, n, num, den, small), "candidates")
    freed(documents.sparkSession)  # the signatures' shuffle
    # the sets that may have a link, of which a part of the hashes shows most
    members = pairs.select(F.explode(F.array("a", "b")).alias("fp"), "big").groupBy("fp").agg(F.max("big").alias("big"))
    members = stored(members.join(sets.select("fp", "size", "row"), "fp").withColumn("root", F.col("fp")), "paired")
    members = accompanied(documents, members, n, num, den, min(1, 1.75 * (den - num) / den))
    pairs = stored(_among(pairs.select("a", "b", "n"), members), "candidates")
    # each set with the partner that shares most signatures, then the pairs still apart
    first = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    roots = components(verified(first.select("a", "b"), sets, documents, n, num, den))
    members = accompanied(documents, stored(_rooted(members.drop("root"), roots, "fp", "root"), "rooted"), n, num, den)
    apart = _rooted(_rooted(_among(pairs.select("a", "b"), members), roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb")
    done = first.select("a", "b")
    apart = stored(apart.select("a", "b").join(done, ["a", "b"], "left_anti"), "apart")
    roots = _joined(roots, verified(apart, sets, documents, n, num, den))
    big = members.filter("big").select("fp")
    if not big.isEmpty():
        signed = members_of(documents, big, sets, n, num, den)
        found_sets = stored(_rooted(signed, roots, "fp", "root"), "rooted", compression="zstd")
        freed(documents.sparkSession, signed)
        roots = _joined(roots, linked_families(found_sets, lambda wanted: hashes_of(documents, wanted, sets, n), num, den))
    held = _rooted(sets, roots, "fp", "root")
    smallest = held.groupBy("root").agg(F.min("rep").alias("component"))
    held = stored(held.join(smallest, "root").select(F.col("fp").alias("_fp"), F.col("size").alias("_size"), "root", "component"), "held")
    out = found.join(held, (F.col("fp") == F.col("_fp")) & (F.col("size") == F.col("_size")), "left")
    return out.select("doc_id", "row", F.col("size").alias("n_shingles"), "root", F.coalesce("component", "doc_id").alias("component_id"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    edges = _rooted(_rooted(stored(links, "more"), roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    known = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return components(known.unionByName(edges))
