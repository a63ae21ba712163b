"""SimHash near-dedup through vantage-point trees.

A document's fingerprint has a bit set where over half its shingles' hashes have it. Distinct fingerprints are
partitioned by a vantage-point tree, fitted on a bounded sample: a node sends what is within its distance to the left, the rest to the
right. By the triangle inequality, two fingerprints within the radius can only be parted by a node if both are near its
boundary, so those of one side's edge also visit the other side, and each shard compares what lives there with itself and with its
visitors. A shard that has many more than its share of the sample foretold is divided again by a tree of its own, so no large shard is
compared one with all. All pairs within the radius are found; a shard hands on a spanning forest of its links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import partitions, rows, table
from rillgraph.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Distinct fingerprints of a shard, about, and of the sample that the tree is fitted on at most.
SHARD, SAMPLE = 4096, 1 << 15


def hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each shingle of n words, repeats included; of fewer words, of all of them; of none, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1].tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row (id, fp) for each document; fp is the fingerprint as a signed long. A null text has no words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches):
            fp = np.array([fingerprint(hashes(t, shingle)) for _, t in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(made, "id long, fp long")


class Tree:
    """A vantage-point tree over 64-bit fingerprints; shards are its leaves."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int) -> None:
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.chance = np.random.default_rng(7)
        self._grow(sample, max(8, leaf))

    def _grow(self, x: np.ndarray, leaf: int) -> int:
        best = None
        if len(x) > leaf:
            for vantage in x[self.chance.integers(0, len(x), 12)]:
                counts = np.bincount(np.bitwise_count(x ^ vantage), minlength=65)
                near = np.cumsum(counts)
                for mu in {int(np.searchsorted(near, len(x) * q)) for q in (0.4, 0.5, 0.6)}:
                    if 0 < near[mu] < len(x):
                        balance = max(near[mu], len(x) - near[mu])
                        inner = counts[max(0, mu + 1 - self.radius) : mu + 1].sum()
                        outer = counts[mu + 1 : mu + 1 + self.radius].sum()
                        cost = balance + min(inner, outer)
                        if cost < len(x) and (best is None or cost < best[0]):
                            best = (cost, vantage, mu, inner <= outer)
        if best is None:
            self.nodes.append((self.leaves,))
            self.leaves += 1
            return len(self.nodes) - 1
        _, vantage, mu, inward = best
        at = len(self.nodes)
        self.nodes.append(None)
        d = np.bitwise_count(x ^ vantage)
        left, right = self._grow(x[d <= mu], leaf), self._grow(x[d > mu], leaf)
        self.nodes[at] = (vantage, mu, inward, left, right)
        return at

    def deal(self, x: np.ndarray, visits: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places in x, whether each visits) for the shards that get any; each fingerprint lives in one shard, but those that only visit from the
        first on."""
        todo = [(0, np.arange(len(x)), np.zeros(len(x), bool) if visits is None else visits)]
        while todo:
            at, own, visits = todo.pop()
            if not len(own):
                continue
            if len(self.nodes[at]) == 1:
                yield self.nodes[at][0], own, visits
                continue
            vantage, mu, inward, left, right = self.nodes[at]
            d = np.bitwise_count(x[own] ^ vantage).astype(np.int64)
            home = d <= mu
            # those that live here visit over one side of the boundary; visitors go wherever a match may live
            over_right = home & (d > mu - self.radius) & (visits | inward)
            over_left = ~home & (d <= mu + self.radius) & (visits | (not inward))
            for side, stay, over in ((left, home, over_left), (right, ~home, over_right)):
                todo.append((side, np.concatenate([own[stay], own[over]]), np.concatenate([visits[stay], np.ones(over.sum(), bool)])))


def linked(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among own and between own and visitors, as two arrays of fingerprints."""
    everyone = np.concatenate([own, visitors])
    parent = np.arange(len(everyone))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    block = max(1, (1 << 18) // max(1, len(everyone)))
    for k in range(0, len(own), block):
        rest = everyone[k:]  # earlier ones have met these already
        near = np.bitwise_count(own[k : k + block, None] ^ rest[None, :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            if j > i:
                p, q = root(k + i), root(k + j)
                if p != q:
                    parent[q] = p
                    a.append(k + i)
                    b.append(k + j)
    return everyone[a], everyone[b]


def divided(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As linked(), by a tree fitted on the shard itself if it is large; forests of its parts together connect the same."""
    tree = None
    if len(own) > 2 * SHARD:
        sample = own if len(own) <= SAMPLE else np.random.default_rng(3).choice(own, SAMPLE, replace=False)
        tree = Tree(sample, SHARD * len(sample) // len(own), radius)
    if tree is None or tree.leaves == 1:
        return linked(own, visitors, radius)
    x, u, v = np.concatenate([own, visitors]), [], []
    for _, at, visits in tree.deal(x, np.arange(len(x)) >= len(own)):
        a, b = linked(np.sort(x[at[~visits]]), np.unique(x[at[visits]]), radius)
        u.append(a)
        v.append(b)
    return np.concatenate(u), np.concatenate(v)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect what pairs of the distinct fingerprints (column fp) within the radius connect."""
    n = distinct.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").sort("fp").limit(2 * SAMPLE)
    tree = Tree(np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64), int(SHARD * share), radius)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for shard, own, visits in tree.deal(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(x[own].view(np.int64)), pa.array(visits)], names=["shard", "fp", "visits"])

    def compared(group: pa.Table) -> pa.Table:
        x, visits = group["fp"].to_numpy().view(np.uint64), group["visits"].to_numpy()
        u, v = divided(np.sort(x[~visits]), np.unique(x[visits]), radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    shards = distinct.select("fp").mapInArrow(dealt, "shard int, fp long, visits boolean")
    shards = shards.repartition(max(partitions(distinct.sparkSession), min(4 * tree.leaves, 4096)), "shard")
    return shards.groupBy("shard").applyInArrow(compared, "u long, v long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row for each document: id, fingerprint (16 hexadecimal digits), component_id, the smallest id reachable by links.

    Texts without words have fingerprint zero and link like any other. Rows of equal ids are rows of their own; ids that are null
    are no component's smallest unless all its ids are null. No rows give no rows. Other columns are not read.
    """
    made = table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = table(made.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    found = made.join(named, F.col("fp") == F.col("f"))
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
