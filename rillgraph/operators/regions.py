"""Memory regions and mod/ref: partitions of objects by the points-to sets that hold them, and effects closed over calls."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.operators.fixpoint import closure, fixpoint
from rillgraph.sources.shared import materialise

#: Objects of a set whose parts are all looked up, at most; those of larger sets, up to the second number, if these are not more than so many parts for each row.
SMALL, MOST, PARTS = 12, 20, 128
#: Parts that are looked up at once, about; digests that a task remembers; bits of the filter of all sets at most, which are 16 MB to broadcast.
AT_ONCE, SEEN, FILTER_BITS = 1 << 19, 1 << 20, 1 << 27


def signatures(psets: DataFrame) -> DataFrame:
    """(pset, objs): each points-to set of rows (pset, obj) as a sorted array."""
    return psets.groupBy("pset").agg(F.sort_array(F.collect_set("obj")).alias("objs"))


def distinct_regions(psets: DataFrame) -> DataFrame:
    """(region, objs): each different points-to set is a region, named by its smallest pset."""
    return signatures(psets).groupBy("objs").agg(F.min("pset").alias("region")).select("region", "objs")


def disjoint_regions(psets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(region, obj): the coarsest disjoint sets that every points-to set is a union of; with by (such as func), within each group.

    Objects that the same points-to sets hold are together. Only a digest of each object's sets is grouped by, so that objects in
    many sets do not make long rows: two sums of hashes, 128 bits.
    """
    by = by or []
    named = psets.select(*by, "pset", "obj").distinct()
    digest = named.groupBy(*by, "obj").agg(F.sum(F.xxhash64("pset").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "pset").cast("decimal(38,0)")).alias("b"), F.count("*").alias("n"))
    least = digest.groupBy(*by, "a", "b", "n").agg(F.min("obj").alias("region"))
    return digest.join(least, [*by, "a", "b", "n"]).select(*by, "region", "obj")


def _hashed(x: np.ndarray, seed: int) -> np.ndarray:
    """Spark's xxhash64 of longs, unsigned."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda y, n: y << np.uint64(n) | y >> np.uint64(64 - n)
    h = (np.array([seed], np.uint64) + p5 + np.uint64(8)) ^ turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


#: Seeds of the two halves of a set's digest: xxhash64(obj) and xxhash64(1, obj).
SEEDS = (42, int(_hashed(np.array([1]), 42)[0]))


def _filled(named: DataFrame, n: int) -> np.ndarray:
    """A bit for each half of n sets' digests: 8 to 32 for each set, within FILTER_BITS."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    place = named.select(F.explode(F.array("part", "part2")).alias("h")).select(F.pmod("h", F.lit(bits)).alias("at"))
    held = place.groupBy(F.floor(F.col("at") / (1 << 15)).alias("k")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(1 << 15))).alias("b"))
    filled = np.zeros(bits // 8, np.uint8)
    for k, b in held.collect():
        filled[k << 12 : (k + 1) << 12] = np.frombuffer(b, np.uint8)
    return filled


class _Seen:
    """Digests that a task has handed on, some of them: a place is taken once and kept."""

    def __init__(self) -> None:
        self.part, self.part2 = np.zeros(SEEN, np.uint64), np.zeros(SEEN, np.uint64)

    def holds(self, part: np.ndarray, part2: np.ndarray) -> np.ndarray:
        at = part & np.uint64(SEEN - 1)
        return (self.part[at] == part) & (self.part2[at] == part2)

    def add(self, part: np.ndarray, part2: np.ndarray) -> None:
        at = part & np.uint64(SEEN - 1)
        free = (self.part[at] | self.part2[at]) == 0
        self.part[at[free]], self.part2[at[free]] = part[free], part2[free]


def _parts(objs: np.ndarray, filled: np.ndarray, seen: _Seen) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, part, part2): those parts of sets of one size (rows of objs), all 2^m of them, that are sets themselves, and a few that are not.

    Sets come in the order in which they are preferred, so a part that was seen has its set already; and a set that was seen, as itself or as a part,
    has no part that is new.
    """
    n, m = objs.shape
    bits = np.uint64(8 * len(filled) - 1)
    held = lambda h: (filled[(h & bits) >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    for first in range(0, n, step := max(1, AT_ONCE >> m)):
        each = [_hashed(objs[first : first + step], seed) for seed in SEEDS]
        own = [np.bitwise_xor.reduce(h, axis=1) for h in each]
        order = np.lexsort(own[::-1])  # equal sets: the first stays
        again = np.zeros(len(order), bool)
        again[order[1:]] = (own[0][order[1:]] == own[0][order[:-1]]) & (own[1][order[1:]] == own[1][order[:-1]])
        rows = np.flatnonzero(~again & ~seen.holds(*own))
        a, b = (np.zeros((len(rows), 1), np.uint64) for _ in SEEDS)
        for k in range(m):
            a, b = (np.concatenate([x, x ^ h[rows, k : k + 1]], axis=1) for x, h in zip((a, b), each, strict=True))
        at = np.flatnonzero(held(a.ravel()))
        at = at[at & ((1 << m) - 1) != 0]  # not the empty part
        part, part2 = a.ravel()[at], b.ravel()[at]
        new = held(part2) & ~seen.holds(part, part2)
        at, part, part2 = at[new], part[new], part2[new]
        seen.add(part, part2)
        yield first + rows[at >> m], part, part2


def bound(sizes: dict[int, int]) -> int:
    """Objects of the largest sets whose parts are all looked up: at least SMALL, at most MOST. sizes: how many sets there are of each size."""
    rows, parts = sum(m * n for m, n in sizes.items()), 0
    for m in range(1, MOST + 1):
        parts += sizes.get(m, 0) << m
        if m > SMALL and parts > PARTS * rows:
            return m - 1
    return MOST


def superset_regions(psets: DataFrame) -> DataFrame:
    """(pset, rep): the largest points-to set that holds all of each one, the smallest name of equal ones; itself if none is larger.

    Sets go by digests of 128 bits, the exclusive or of their objects' hashes. All parts of each small set (see bound()) are looked up in a broadcast filter of all
    digests, so that only those which are sets themselves become rows; of each digest's rows the best one stays. Larger sets meet those that hold the object which
    the fewest of them hold. No join is by broadcast: these tables are small as files and not in memory.
    """
    obj = F.col("obj").cast("long") if psets.schema["obj"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("obj")
    each = psets.filter("pset is not null and obj is not null").select("pset", obj.alias("obj")).distinct()
    halves = F.bit_xor(F.xxhash64("obj")).alias("part"), F.bit_xor(F.xxhash64(F.lit(1).cast("long"), "obj")).alias("part2")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("obj"), F.lit(64)).cast("int"))).alias("bits")
    named = materialise(each.repartition("pset").groupBy("pset").agg(*halves, bits, F.collect_list("obj").alias("objs")), "sets")  # rows are shuffled, not halves of aggregates
    sizes = dict(named.groupBy(F.size("objs")).count().collect())
    small = bound(sizes)
    shared = named.sparkSession.sparkContext.broadcast(_filled(named, sum(sizes.values())))

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            sizes = batch["objs"].value_lengths().to_numpy(zero_copy_only=False)
            starts, flat = np.cumsum(sizes) - sizes, batch["objs"].flatten().to_numpy(zero_copy_only=False)
            for m in np.unique(sizes)[::-1]:
                of = np.flatnonzero(sizes == m)
                for row, part, part2 in _parts(flat[starts[of][:, None] + np.arange(m)], shared.value, seen):
                    if len(row):
                        yield pa.record_batch([part.view(np.int64), part2.view(np.int64), np.full(len(row), m, np.int32), batch["pset"].take(pa.array(of[row]))], names=["part", "part2", "m", "other"])

    kind = psets.schema["pset"].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("part2", T.LongType()), T.StructField("m", T.IntegerType()), T.StructField("other", kind)])
    parts = named.filter(F.size("objs") <= small).select("pset", "objs").sortWithinPartitions(F.size("objs").desc(), "pset").mapInArrow(found, schema)
    if max(sizes, default=0) > small:
        parts = parts.unionByName(_large(named, small))
    best = parts.groupBy("part", "part2").agg(F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("t"))
    return named.select("pset", "part", "part2").hint("merge").join(best.hint("merge"), ["part", "part2"]).select("pset", F.col("t.other").alias("rep"))


def _large(named: DataFrame, small: int) -> DataFrame:
    """(part, part2, m, other): the sets that sets of more than small objects (other, of m) hold, themselves among them."""
    large = named.groupBy("part", "part2").agg(F.min("pset").alias("pset")).select("pset").hint("merge").join(named.filter(F.size("objs") > small).hint("merge"), "pset")
    large = materialise(large.select(F.col("pset").alias("other"), F.col("objs").alias("sig"), F.size("objs").alias("m"), F.col("bits").alias("sig_bits")), "large")
    held = large.select("other", "sig", "m", "sig_bits", F.explode("sig").alias("obj"))
    often = held.groupBy("obj").agg(F.count("*").alias("often"))
    own = named.select("pset", F.size("objs").alias("n"), F.explode("objs").alias("obj")).hint("merge").join(often.hint("merge"), "obj")
    rare = own.groupBy("pset", "n").agg(F.count("*").alias("k"), F.min(F.struct("often", "obj"))["obj"].alias("obj")).filter("k = n").select("pset", "obj")  # an object that none of them holds rules a set out
    asked = rare.hint("merge").join(named.hint("merge"), "pset").select("part", "part2", "objs", "bits", "obj")
    holds = (F.col("m") >= F.size("objs")) & (F.col("bits").bitwiseAND(F.col("sig_bits")) == F.col("bits")) & (F.size(F.array_except("objs", "sig")) == 0)
    met = asked.hint("merge").join(held.hint("merge"), "obj").filter(holds)
    return met.select("part", "part2", "m", "other")


def regions_of(regions: DataFrame, psets: DataFrame) -> DataFrame:
    """(pset, region): regions (region, obj) that a points-to set holds wholly."""
    sized = regions.groupBy("region").agg(F.count("*").alias("n"))
    held = psets.distinct().join(regions, "obj").groupBy("pset", "region").agg(F.count("*").alias("k"))
    return held.join(sized, "region").filter("k = n").select("pset", "region")


def mod_ref(local: DataFrame, calls: DataFrame, visible: DataFrame | None = None, globals_: DataFrame | None = None) -> DataFrame:
    """(func, obj, effect): what functions modify (mod) or read (ref), their own (local, of the same columns) and through callees.

    Of a callee's effects a caller sees those on what the call can reach (visible: cs, obj) and on globals (obj); all if neither is
    given. calls: (caller, callee, cs). Whatever is modified counts as read too.
    """
    own = local.select("func", "obj", "effect")
    own = own.unionByName(own.filter("effect = 'mod'").withColumn("effect", F.lit("ref"))).distinct()
    c = calls.select("caller", F.col("callee").alias("__f"), "cs").distinct()

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        up = new.join(c, new["func"] == c["__f"]).select(F.col("caller").alias("func"), "obj", "effect", "cs")
        if visible is None and globals_ is None:
            return up.drop("cs")
        seen = up.limit(0).drop("cs")
        if visible is not None:
            seen = seen.unionByName(up.join(visible.select("cs", "obj").distinct(), ["cs", "obj"], "left_semi").select("func", "obj", "effect"))
        if globals_ is not None:
            seen = seen.unionByName(up.join(globals_.select("obj").distinct(), "obj", "left_semi").select("func", "obj", "effect"))
        return seen

    return fixpoint(own, step, label="mod-ref")


def global_closure(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst): globals that roots (column src) refer to through initialisers and constants (src, dst)."""
    return closure(refs, roots)
