"""Links within hot families of similar sets, without their pairs.

A family is a group of sets that share a signature, with one of them as its hub. Every
set is described by its difference d to the hub, so that sets x, y differ in
|d(x) xor d(y)| hashes, of which at most h = (|x| + |y|)(1-t)/(1+t) may differ in a link.

1. Stars. With e = |d| - size (1-t)/(1+t), e(x) + e(c) <= 0 makes a link sure. The set c
   of least e gets one link to each such x; from there on they have one root, and only
   pairs of different roots count.
2. Own elements. An element of d that no other set of the family has differs in every
   pair. With w of these and s others, x and y differ in at least w(x) + w(y) +
   |s(x) - s(y)|. A set for which no set of another root stays within h leaves.
3. Segments. Elements are put into at most `CUTS` segments by where in the hub's order the
   change stands: its removed hashes' own places, for an added one the place after the
   last common hash before it (the least of the sets', so that it's the same in all). A
   form's slots thus become segments. If different contents of segment j differ in at
   least f(j) elements, a link can differ in at most q segments, where the q least f stay
   within h, and agrees in the others. Segments are dealt to g > q parts, and each set
   has a signature for each choice of g - q parts. g comes from a cost model: signatures
   emitted, and pairs expected from the frequencies of the segments' contents.
   Where no choice is possible, the rarest common elements of d are keys (prefix filter).
4. In a group of a key, sets of other roots than the most usual one meet all its sets, as
   two of that root needn't. Groups with up to `DENSE` of them are joined where roots differ and 2.
   allows it, also with s and f taken segment by segment, so that a row meets `DENSE` others at most;
   denser ones are families of their own, whose members agree in the key's parts.

Any assignment of elements to segments gives right results; a poor one only costs more.
After `LEVELS` levels groups are joined as they are, which a family can only reach by
being dense and yet apart in all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import freed, small, stored

#: None of these changes the result: sets that each one of a group is joined with, levels above that,
#: segments, contents of a segment that are compared, classes of s and w, signatures of a
#: set at most, the size at which a family's cost is taken if it is smaller, and the cost
#: beyond which a scheme isn't worth it.
DENSE, LEVELS, CUTS, CONTENTS, CLASSES, CHOICES, TYPICAL, DEAREST = 64, 6, 24, 64, 32, 1000, 8192, 500
#: Elements that contents are compared by at once.
COLUMNS = 1 << 14
#: Sets of a file of differences at most, so that a task that takes their elements apart
#: reads few of them.
PER_FILE = 1000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def _by_family(rows: DataFrame, facts: DataFrame, n_bytes: int, how: str = "inner") -> DataFrame:
    """rows with a family's facts, of about n_bytes each, which are broadcast if few."""
    return rows.join(small(facts, n_bytes * facts.count()), "family", how)


def difference(own: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, places, starts of changes) of two sets in their texts' order."""
    order = np.argsort(hub, kind="stable")
    at = np.minimum(np.searchsorted(hub, own, sorter=order), len(hub) - 1)
    place = order[at]
    common = hub[place] == own
    after = np.maximum.accumulate(np.where(common, place, -1)) + 1
    left = np.ones(len(hub), bool)
    left[place[common]] = False
    gone = np.flatnonzero(left)
    first = gone[np.diff(gone, prepend=-2) != 1]
    added = after[~common]
    return np.concatenate([own[~common], hub[gone]]), np.concatenate([added, gone]), np.unique(np.concatenate([added, first]))


def _differences(kin: DataFrame, hashes: DataFrame) -> DataFrame:
    """kin (family, hub, fp, size, root) with elem, place and runs of each set, and n elements."""
    hubs = stored(kin.select(F.col("hub").alias("fp")).distinct().join(hashes, "fp").select(F.col("fp").alias("hub"), F.col("hashes").alias("head")), "hubs")
    n_bytes = hubs.agg(F.coalesce(F.sum(8 * F.size("head")), F.lit(0))).first()[0]
    both = kin.join(hashes, "fp").join(small(hubs, n_bytes), "hub").select("family", "fp", "size", "root", "hashes", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                of = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)]  # noqa: B023, E731
                found = [difference(x, h) for x, h in zip(of("hashes"), of("head"), strict=True)]
                out = [pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int64())), *(pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("family", "fp", "size", "root")), *out], names=["family", "fp", "size", "root", "n", "elem", "place", "runs"])

    return stored(both.mapInArrow(run, "family long, fp long, size long, root long, n long, elem array<long>, place array<int>, runs array<int>"), "differences", compression="zstd", maxRecordsPerFile=PER_FILE)


def _starred(differences: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Sure links, and the sets of families that aren't done by them, without their
    elements: family, fp, size, n, root (after these links), outer (not the centre's root)
    and h (differences a link may have)."""
    rows = differences.select("family", "fp", "size", "root", "n").withColumn("e", F.col("n") * (den + num) - F.col("size") * (den - num))
    facts = stored(rows.groupBy("family").agg(F.min(F.struct("e", "fp", "root")).alias("centre"), F.max("size").alias("largest")), "centres")
    rows = _by_family(rows, facts, 64).withColumn("sure", F.col("e") + F.col("centre.e") <= 0)
    links = rows.filter(F.col("sure") & (F.col("root") != F.col("centre.root"))).select(F.col("centre.fp").alias("a"), F.col("fp").alias("b"))
    root = F.when(F.col("sure"), F.col("centre.root")).otherwise(F.col("root"))
    h = F.floor((F.col("size") + F.least("largest", F.col("size") * den / num)) * (den - num) / (den + num)).cast("long")
    rows = rows.select("family", "fp", "size", root.alias("root"), (root != F.col("centre.root")).alias("outer"), h.alias("h"), "n")
    left = rows.filter("outer").select("family").distinct()
    return links, _by_family(rows, stored(left, "left"), 16, "left_semi")


def _elements(rows: DataFrame) -> DataFrame:
    return rows.select("family", "fp", F.explode(F.arrays_zip("elem", "place")).alias("x")).select("family", "fp", "x.elem", "x.place")


def _within(w: Column, s: Column) -> Column:
    """Whether own elements w and differences s, both of a pair, stay within its h."""
    return w + s <= F.least("h_x", "h_y")


def _alive(rows: DataFrame, differences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that can have a link at all, with w and s, without their elements; and what is
    known of elements: family, k (how many sets have it), and elem and place if k > 1, else
    fp."""
    families = stored(rows.select("family").distinct(), "families")
    known = _elements(_by_family(differences, families, 16, "left_semi")).groupBy("family", "elem")
    known = known.agg(F.count("*").alias("k"), F.min("fp").alias("fp"), F.min("place").alias("place"))
    shared = lambda c: F.when(F.col("k") > 1, F.col(c)).alias(c)
    known = stored(known.select("family", "k", F.when(F.col("k") == 1, F.col("fp")).alias("fp"), shared("elem"), shared("place")), "elements", compression="zstd")
    own = known.filter("k = 1").groupBy("family", "fp").agg(F.count("*").alias("w"))
    rows = rows.join(own, ["family", "fp"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    rows = stored(rows.withColumn("s", F.col("n") - F.col("w")).drop("n"), "described")
    freed(rows.sparkSession)  # the elements' shuffle
    facts = stored(rows.groupBy("family").agg(F.ceil((F.max("h") + 1) / CLASSES).alias("step"), F.max("h").alias("most")), "steps")
    classed = _by_family(rows.select("family", "w", "s", "root", "outer"), facts, 24).filter(F.col("w") <= F.col("most"))
    by = classed.groupBy("family", "step", F.floor(F.col("w") / F.col("step")).alias("w"), F.floor(F.col("s") / F.col("step")).alias("s"))
    by = by.agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("outer").alias("outer"))
    classes = stored(by.groupBy("family").agg(F.first("step").alias("step"), F.collect_list(F.struct("w", "s", "lo", "hi", "outer")).alias("classes")), "profiles")
    n_bytes = classes.agg(F.coalesce(F.sum(48 * F.size("classes")), F.lit(0))).first()[0]

    def near(c: Column) -> Column:
        apart = F.greatest(F.lit(0), F.abs(F.col("s") - c["s"] * F.col("step")) - F.col("step"))
        other = (c["lo"] != F.col("root")) | (c["hi"] != F.col("root"))
        return other & (F.col("outer") | c["outer"]) & (F.col("w") + c["w"] * F.col("step") + apart <= F.col("h"))

    # least: elements of the differences of any set that may be a partner, at least
    kept = rows.join(small(classes, n_bytes), "family").withColumn("partners", F.filter("classes", near))
    kept = kept.withColumn("least", F.array_min(F.transform("partners", lambda c: (c["w"] + c["s"]) * F.col("step"))))
    kept = kept.filter(F.size("partners") > 0).drop("classes", "step", "partners")
    return stored(kept, "alive"), known


def _mixed_roots(rows: DataFrame, by: list[str]) -> DataFrame:
    """The groups (by) of several roots: k sets, the usual root, how many have others, and a
    hash of the members."""
    found = rows.groupBy(*by, "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("members")).groupBy(*by)
    found = found.agg(F.sum("n").alias("k"), F.max_by("root", F.struct("n", "root")).alias("usual"), (F.sum("n") - F.max("n")).alias("others"), F.bit_xor("members").alias("members"))
    return found.filter("others > 0")


def _met(rows: DataFrame, groups: DataFrame, by: list[str], floors: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of sets of different roots that meet in the groups (by, with their usual
    root) and may link, as far as w, s and, with floors, sizes tell. The side that is held
    for each group has only sets of other roots than the usual one."""
    shared = rows.join(groups.select(*by, "usual"), by).withColumn("outer", F.col("root") != F.col("usual"))
    columns = ("fp", "root", "outer", "h", "w", "s", *(["sizes"] if floors else []))
    side = lambda rows, s: rows.select(*by, *(F.col(c).alias(f"{c}_{s}") for c in columns))
    few = side(shared.filter("outer"), "x")
    both = side(shared, "y").join(_by_family(few, floors, 4 * CUTS + 32, "left") if floors else few, by)
    once = ~F.col("outer_y") | (F.col("fp_x") < F.col("fp_y"))
    own = F.col("w_x") + F.col("w_y")
    both = both.filter((F.col("root_x") != F.col("root_y")) & once & _within(own, F.abs(F.col("s_x") - F.col("s_y"))))
    if floors:
        differ = lambda x, y: F.when(x == y, 0).otherwise(F.abs(F.shiftright(x, 8) - F.shiftright(y, 8)))
        floor = F.zip_with(F.zip_with("sizes_x", "sizes_y", lambda x, y: F.when(x != y, 1).otherwise(0)), F.coalesce("floors", F.array_repeat(F.lit(1), CUTS + 1)), lambda n, f: n * f)
        apart = F.aggregate(F.zip_with(F.zip_with("sizes_x", "sizes_y", differ), floor, lambda a, b: F.greatest(a, b)), F.lit(0), lambda n, x: n + x)
        both = both.filter(_within(own, apart))
    return both.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b")).distinct()


def _contents(kept: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """family, fp, elem, k, seg of the kept sets' shared elements; and family, fp, seg,
    v (a hash of the content), n (its elements)."""
    cuts = kept.select("family", F.explode("runs").alias("r")).groupBy("family").agg(F.array_distinct(F.percentile_approx("r", [k / CUTS for k in range(CUTS)], 10_000)).alias("cuts"))
    elements = _elements(kept).drop("place").join(known.filter("k > 1").drop("fp"), ["family", "elem"])
    elements = _by_family(elements, stored(cuts, "cuts"), 4 * CUTS + 32)
    elements = stored(elements.withColumn("seg", F.size(F.filter("cuts", lambda c: c <= F.col("place")))).drop("cuts", "place"), "placed")
    return elements, stored(elements.groupBy("family", "fp", "seg").agg(F.bit_xor(F.xxhash64("elem")).alias("v"), F.count("*").alias("n")), "contents")


def least_apart(owner: np.ndarray, elem: np.ndarray) -> int | None:
    """In how many elements two of the sets differ at least; set owner[i] has elem[i]."""
    m, (_, place) = int(owner.max()) + 1, np.unique(elem, return_inverse=True)
    if m < 2:
        return None
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both, sizes = np.zeros((m, m)), np.bincount(owner, minlength=m)
    for k in range(0, int(place[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(place, [k, k + COLUMNS])
        has = np.zeros((m, COLUMNS), np.float32)
        has[owner[i:j], place[i:j] - k] = 1
        both += has @ has.T
    apart = sizes[:, None] + sizes[None] - 2 * both
    return int(apart[~np.eye(m, dtype=bool)].min())


def _least_apart(shown: DataFrame) -> DataFrame:
    """family, seg, common: in how many elements two contents (v) of a segment differ at
    least. A segment's contents, `CONTENTS` at most, meet in one row: no pairs are made."""
    held = shown.groupBy("family", "seg", "v").agg(F.collect_list("elem").alias("elems"))
    held = held.groupBy("family", "seg").agg(F.collect_list("elems").alias("elems"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                sets = batch.column("elems").flatten()
                owner = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy(zero_copy_only=False))
                least = least_apart(owner, sets.flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("seg"), pa.array([least], pa.int64())], names=["family", "seg", "common"])

    return held.mapInArrow(run, "family long, seg int, common long")


def scheme(floors: list[int], same: list[float], sets: int, most: int) -> tuple[int, list[int]]:
    """(q, part of each segment) of least cost: pairs within `most` differences agree in
    all but q parts. floors: how much different contents of a segment differ at least;
    same: how likely two sets agree in it. q is -1 where nothing can be chosen."""
    total = np.cumsum(sorted(floors))
    q, m = int((total <= most).sum()), len(floors)
    best, half = None, max(sets, TYPICAL) / 2
    for g in range(q + 1, m + 1):
        if comb(g, q) > CHOICES:
            break
        part, weight, p = [0] * m, [0.0] * g, [1.0] * g
        for j in sorted(range(m), key=lambda j: same[j]):
            part[j] = k = min(range(g), key=lambda k: weight[k])
            weight[k] -= np.log(max(same[j], 1e-9))
            p[k] *= same[j]
        chosen = np.zeros(g - q + 1)  # elementary symmetric sums of p
        chosen[0] = 1
        for x in p:
            chosen[1:] += chosen[:-1] * x
        cost = comb(g, q) + half * chosen[g - q]
        if best is None or cost < best[0]:
            best = (cost, part)
    return (q, best[1]) if best and best[0] < DEAREST else (-1, [])


def _schemes(kept: DataFrame, elements: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """family, q, segs, parts of each family that has a scheme; and family, floors: how
    much different contents of each segment differ at least."""
    facts = kept.groupBy("family").agg(F.count("*").alias("sets"), F.max("h").alias("h"), F.min("w").alias("w"), F.min(F.when(F.col("outer"), F.col("w"))).alias("w_outer"))
    facts = stored(facts, "facts")
    values = contents.groupBy("family", "seg", "v").agg(F.count("*").alias("k"), F.min("fp").alias("fp"), F.first("n").alias("n"))
    values = stored(values, "values")
    segs = values.groupBy("family", "seg").agg(F.count("*").alias("values"), F.sum("k").alias("filled"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.min("n").alias("least"))
    few = segs.filter(F.col("values") <= CONTENTS).select("family", "seg")
    shown = stored(values.join(few, ["family", "seg"]).select("family", "seg", "v", "n", "fp").join(elements.select("family", "fp", "seg", "elem"), ["family", "fp", "seg"]).drop("fp"), "shown")
    common = _least_apart(shown)
    segs = _by_family(segs, facts, 48).join(common, ["family", "seg"], "left")
    empty = F.col("sets") - F.col("filled")
    apart = F.when(empty > 0, F.col("least")).otherwise(2 * F.col("least"))
    floor = F.when(F.col("values") <= CONTENTS, F.least(apart, F.coalesce("common", apart))).otherwise(1)
    same = (F.col("squares") + empty * empty) / (F.col("sets") * F.col("sets"))
    varied = segs.filter((F.col("values") > 1) | (empty > 0)).select("family", "sets", (F.col("h") - F.col("w") - F.coalesce("w_outer", F.lit(0))).alias("most"), F.struct("seg", F.greatest(F.lit(1), floor).alias("floor"), same.alias("same")).alias("s"))
    lists = varied.groupBy("family", "sets", "most").agg(F.collect_list("s").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for family, sets, most, s in zip(*(batch.column(c).to_pylist() for c in ("family", "sets", "most", "s")), strict=True):
                s = sorted(s, key=lambda x: x["seg"])
                q, parts = scheme([x["floor"] for x in s], [x["same"] for x in s], sets, most)
                if q >= 0:
                    out.append((family, q, [x["seg"] for x in s], parts))
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["family", "q", "segs", "parts"])

    of = lambda j: F.coalesce(F.get(F.filter("s", lambda x: x["seg"] == j), F.lit(0))["floor"], F.lit(1)).cast("int")
    floors = stored(lists.select("family", F.transform(F.sequence(F.lit(0), F.lit(CUTS)), of).alias("floors")), "floors")
    return stored(lists.mapInArrow(run, "family long, q int, segs array<int>, parts array<int>"), "schemes"), floors


def _chosen(kept: DataFrame, contents: DataFrame, schemes: DataFrame) -> DataFrame:
    """family, fp, key: a key for each choice of parts of each set."""
    held = contents.groupBy("family", "fp").agg(F.collect_list("seg").alias("seg"), F.collect_list("v").alias("v"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    rows = _by_family(kept.select("family", "fp").join(held, ["family", "fp"], "left"), schemes, 8 * CUTS + 48)
    rows = rows.select("family", "fp", none("seg", "array<int>"), none("v", "array<bigint>"), "q", "segs", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            families, fps, keys = [], [], []
            for family, fp, seg, v, q, segs, parts in zip(*(batch.column(c).to_pylist() for c in ("family", "fp", "seg", "v", "q", "segs", "parts")), strict=True):
                g, part = max(parts) + 1, dict(zip(segs, parts, strict=True))
                if (g, q) not in choices:
                    choices[g, q] = np.array(list(combinations(range(g), g - q)), np.int64)
                at = choices[g, q]
                whole = np.zeros(g, np.uint64)
                for j, x in zip(seg, v, strict=True):
                    if j in part:  # others are the same in all sets
                        whole[part[j] : part[j] + 1] += _mixed(np.array([x], np.int64).view(np.uint64) + np.uint64(j + 1))
                places = _mixed(whole + (np.arange(g).astype(np.uint64) + np.uint64(1)) * _MIX[0])
                keys.append(_mixed(places[at].sum(axis=1, dtype=np.uint64) + _mixed((at + 1).astype(np.uint64)).sum(axis=1, dtype=np.uint64)))
                families.append(np.full(len(at), family, np.int64))
                fps.append(np.full(len(at), fp, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(families)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(keys).view(np.int64))], names=["family", "fp", "key"])

    return rows.mapInArrow(run, "family long, fp long, key long")


def _sizes(contents: DataFrame) -> DataFrame:
    """family, fp, sizes: how many shared elements each segment has, and eight bits of
    their hash."""
    code = F.col("n") * 256 + F.pmod("v", F.lit(256))
    held = contents.groupBy("family", "fp").agg(F.collect_list(F.struct("seg", code.cast("int").alias("n"))).alias("held"))
    of = lambda j: F.coalesce(F.get(F.filter("held", lambda x: x["seg"] == j), F.lit(0))["n"], F.lit(0))
    return held.select("family", "fp", F.transform(F.sequence(F.lit(0), F.lit(CUTS)), of).alias("sizes"))


def _rarest(kept: DataFrame, elements: DataFrame, schemes: DataFrame) -> DataFrame:
    """family, fp, key: the rarest shared elements of the sets in families without a
    scheme, so many that two sets within h of each other share one."""
    rows = _by_family(kept, schemes.select("family"), 16, "left_anti")
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("w") + F.col("least") - F.col("h")) / 2))
    take = rows.select("family", "fp", F.greatest(F.lit(0), F.col("s") - need + 1).cast("int").alias("take"))
    ordered = elements.groupBy("family", "fp").agg(F.sort_array(F.collect_list(F.struct("k", "elem"))).alias("order"))
    return ordered.join(take, ["family", "fp"]).select("family", "fp", F.explode(F.slice("order", F.lit(1), F.col("take"))).alias("x")).select("family", "fp", F.col("x.elem").alias("key"))


def _groups(kin: DataFrame) -> DataFrame:
    """family, hub, fp, size, root of the groups (family, key) of several roots: their
    sets around the one that is in most groups, groups of one hub together. Any set can be
    a group's hub; groups of mostly the same sets take one, as a set is described and
    compared in every family that it's in: each set names the hub of most of its groups,
    and a group takes the one that most of its sets name."""
    mixed = kin.groupBy("family", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("family", "key")
    rows = stored(kin.join(mixed, ["family", "key"]), "mixed")
    weight = rows.groupBy("family", "fp").agg(F.count("*").alias("weight"))
    heaviest = F.max_by(F.struct("fp", "weight"), F.struct("weight", -F.col("fp")))
    hubs = rows.join(weight, ["family", "fp"]).groupBy("family", "key").agg(heaviest.alias("hub"))
    named = rows.select("family", "key", "fp").join(hubs, ["family", "key"]).groupBy("family", "fp", "hub").agg(F.count("*").alias("n"))
    named = stored(named.groupBy("family", "fp").agg(F.max_by("hub.fp", F.struct("n", "hub.weight", -F.col("hub.fp"))).alias("hub")), "named")
    hubs = rows.select("family", "key", "fp").join(named, ["family", "fp"]).groupBy("family", "key", "hub").agg(F.count("*").alias("n"))
    hubs = hubs.groupBy("family", "key").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    return rows.join(hubs, ["family", "key"]).select(F.xxhash64("family", "hub").alias("family"), "hub", "fp", "size", "root").distinct()


def _parted(kin: DataFrame) -> DataFrame:
    """Dense groups (family, key, fp, size, root) as families, each with a hub."""
    family = F.xxhash64("family", "key")
    rows = kin.select(family.alias("family"), "fp", "size", "root")
    hubs = stored(rows.groupBy("family").agg(F.min_by("fp", F.xxhash64("fp")).alias("hub")), "heads")
    return _by_family(rows, hubs, 24)


def linked_families(found: DataFrame, hashes_for: Callable[[DataFrame], DataFrame], num: int, den: int, dense: int = DENSE, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) that join all linked sets of different roots which share a
    signature. found: fp, size, root, sigs; hashes_for gives fp and hashes, in their
    text's order, of the sets (fp) that are in a family at all."""
    kin = stored(_groups(found.select(F.lit(0).cast("long").alias("family"), F.explode("sigs").alias("key"), "fp", "size", "root")), "kin")
    sizes = stored(found.select("fp", "size"), "sizes")
    freed(sizes.sparkSession, found)  # its signatures
    hashes = hashes_for(kin.select("fp").distinct())
    sure, pairs = [], []
    for level in range(levels):
        # the one table of all differences; it stays no longer than it's read
        differences = _differences(kin, hashes)
        links, rows = _starred(differences, num, den)
        sure.append(stored(links, "sure"))
        rows = stored(rows, "starred")
        freed(sizes.sparkSession)  # the shuffles of hashes
        alive, known = _alive(rows, differences)
        # families of few other roots are joined as they are, without their elements
        mixed = stored(_mixed_roots(alive, ["family"]), "roots")
        pairs.append(stored(_met(alive, mixed.filter(F.col("others") <= dense), ["family"]), "met"))
        dearer = mixed.filter(F.col("others") > dense).select("family")
        alive = stored(_by_family(alive, dearer, 16, "left_semi"), "dearer")
        kept = differences.select("family", "fp", "elem", "place", "runs").join(small(alive, 80 * alive.count()), ["family", "fp"])
        kept = stored(kept, "kept", compression="zstd", maxRecordsPerFile=PER_FILE)
        freed(sizes.sparkSession, differences)
        if kept.isEmpty():
            freed(sizes.sparkSession, known)
            break
        elements, contents = _contents(kept, known)
        freed(sizes.sparkSession, known)
        schemes, floors = _schemes(kept, elements, contents)
        keys = _chosen(kept, contents, schemes).unionByName(_rarest(kept, elements, schemes))
        about = kept.select("family", "fp", "size", "root", "outer", "h", "w", "s").join(_sizes(contents), ["family", "fp"], "left")
        keys = stored(keys.join(about, ["family", "fp"]).withColumn("sizes", F.coalesce("sizes", F.array_repeat(F.lit(0), CUTS + 1))), "keys")
        by = stored(_mixed_roots(keys, ["family", "key"]), "groups")
        last = level == levels - 1
        pairs.append(_met(keys, by if last else by.filter(F.col("others") <= dense), ["family", "key"], floors))
        # keys of the same sets count once
        over = by.filter(F.col("others") > dense).groupBy("family", "members", "k").agg(F.min("key").alias("key")).select("family", "key")
        if last or over.isEmpty():
            break
        over = keys.join(over, ["family", "key"])
        kin = stored(_parted(over), "kin")
    out = reduce(DataFrame.unionByName, sure)
    if not pairs:
        return out
    sets = hashes.join(sizes, "fp")
    of = lambda s: sets.select(F.col("fp").alias(s), F.col("size").alias(f"size_{s}"), F.col("hashes").alias(f"hashes_{s}"))
    close = stored(reduce(DataFrame.unionByName, pairs).distinct(), "close")
    both = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    exact = close.join(of("a"), "a").join(of("b"), "b").filter((both > 0) & (both * den >= (F.col("size_a") + F.col("size_b") - both) * num))
    return out.unionByName(exact.select("a", "b"))
