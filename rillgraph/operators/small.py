"""Graphs of a checked size, walked in tasks instead of rounds of joins.

A round of joins costs a job however few rows it adds. Where a graph has at most LOCAL_EDGES edges, which is counted first, its edges
are broadcast and each task walks from its own share of the sources, or one task orders the whole graph. Callers have a distributed way
for larger graphs, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a graph that is broadcast, at most: a few MB.
LOCAL_EDGES = 1 << 18
#: Edges of a graph that is broadcast as arrays are at most so many times as many: 4 bytes for each, 16 for a node.
ARRAYS = 8
#: Rows that a task hands on at once, about.
AT_ONCE = 1 << 16


def edges_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> list[tuple] | None:
    """The distinct edges if there are at most LOCAL_EDGES; else None."""
    if edges.schema[src].dataType.typeName() in ("struct", "array", "map"):
        return None
    found = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s is not null and d is not null").distinct()
    held = found.limit(LOCAL_EDGES + 1).toArrow()
    return None if held.num_rows > LOCAL_EDGES else list(zip(held["s"].to_pylist(), held["d"].to_pylist(), strict=True))


def successors(edges: Iterable[tuple]) -> dict:
    """Each node's successors."""
    out: dict = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    return out


def arrays_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The distinct edges between longs, if there are at most ARRAYS * LOCAL_EDGES, as sorted nodes, where each one's successors begin, and these; else None."""
    if any(edges.schema[c].dataType.typeName() != "long" for c in (src, dst)):
        return None
    found = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s is not null and d is not null").distinct()
    held = found.limit(ARRAYS * LOCAL_EDGES + 1).toArrow()
    if held.num_rows > ARRAYS * LOCAL_EDGES:
        return None
    s, d = (held[c].to_numpy() for c in ("s", "d"))
    nodes = np.unique(np.concatenate([s, d]))
    s, d = np.searchsorted(nodes, s), np.searchsorted(nodes, d)
    return nodes, np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(nodes)))]).astype(np.int64), d[np.argsort(s, kind="stable")].astype(np.int32)


def spread(graph: tuple[np.ndarray, np.ndarray, np.ndarray], seeds: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(seed, node): what each seed (one column) reaches by one edge or more in a graph as arrays_of() gives it; a task walks from many seeds at once."""
    first = seeds.select(F.col(seeds.columns[0]).cast("long").alias(names[0])).filter(F.col(names[0]).isNotNull()).distinct()
    shared = seeds.sparkSession.sparkContext.broadcast(graph)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, begin, to = shared.value
        n = max(1, len(nodes))
        for batch in batches:
            given = batch.column(0).to_numpy()
            for k in range(0, len(given), 256):
                own = given[k : k + 256]
                at = np.minimum(np.searchsorted(nodes, own), n - 1)
                own, at = (x[nodes[at] == own] for x in (own, at)) if len(nodes) else (own[:0], at[:0])
                key, found = np.arange(len(own), dtype=np.int64) * n + at, np.zeros(0, np.int64)
                while len(key):
                    who, v = key // n, key % n
                    many = begin[v + 1] - begin[v]
                    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[v], many)
                    key = np.setdiff1d(np.unique(np.repeat(who, many) * n + to[place]), found, assume_unique=True)
                    found = np.union1d(found, key)
                yield pa.RecordBatch.from_arrays([pa.array(own[found // n]), pa.array(nodes[found % n])], names=list(names))

    return first.mapInArrow(walk, f"`{names[0]}` long, `{names[1]}` long")


def walked(edges: list[tuple], seeds: DataFrame, names: tuple[str, str], depth: int | None = None) -> DataFrame:
    """(seed, node, depth): what each seed (one column) reaches by one edge or more, with the least number of edges, at most depth."""
    first = seeds.select(F.col(seeds.columns[0]).alias(names[0])).distinct()
    shared = seeds.sparkSession.sparkContext.broadcast(successors(edges))

    def breadth(start) -> list[tuple]:
        ahead, found, todo, k = shared.value, {}, [start], 0
        while todo and (depth is None or k < depth):
            k += 1
            following = []
            for n in todo:
                for m in ahead.get(n, ()):
                    if m not in found:
                        found[m] = k
                        following.append(m)
            todo = following
        return [(start, m, d) for m, d in found.items()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            a, b, c = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(c, pa.int32())], names=[*names, "depth"])

        held: list[tuple] = []
        for batch in batches:
            for start in batch.column(0).to_pylist():
                held += breadth(start)
                if len(held) >= AT_ONCE:
                    yield out(held, batch.column(0).type)
                    held = []
            if held:
                yield out(held, batch.column(0).type)
                held = []

    name = first.schema[0].dataType.simpleString()
    return first.mapInArrow(walk, f"`{names[0]}` {name}, `{names[1]}` {name}, depth int")


def components(edges: list[tuple]) -> dict:
    """The smallest node of each node's strongly connected component."""
    ahead, number, low, rep = successors(edges), {}, {}, {}
    stack, held = [], set()
    for root in sorted({n for e in edges for n in e}):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        held.add(root)
        path = [(root, iter(ahead.get(root, ())))]
        while path:
            node, rest = path[-1]
            for m in rest:
                if m not in number:
                    number[m] = low[m] = len(number)
                    stack.append(m)
                    held.add(m)
                    path.append((m, iter(ahead.get(m, ()))))
                    break
                if m in held:
                    low[node] = min(low[node], number[m])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(stack.pop())
                    held.difference_update(own)
                    rep |= dict.fromkeys(own, min(own))
    return rep


def levels(edges: list[tuple]) -> dict:
    """The longest path that ends at each node; nodes on or behind a cycle are absent."""
    ahead, into = successors(edges), {}
    for s, d in edges:
        into[d] = into.get(d, 0) + 1
        into.setdefault(s, 0)
    level = dict.fromkeys((n for n, k in into.items() if not k), 0)
    todo = list(level)
    seen = dict(level)
    for n in todo:
        for m in ahead.get(n, ()):
            seen[m] = max(seen.get(m, 0), seen[n] + 1)
            into[m] -= 1
            if not into[m]:
                level[m] = seen[m]
                todo.append(m)
    return level


def dominator_tree(edges: Iterable[tuple], entries: Iterable) -> dict:
    """The immediate dominator of each node that the entries reach; None for those that nothing but itself dominates."""
    ahead, behind = successors(edges), {}
    order, seen = [], set()
    for start in sorted(set(entries)):  # nodes in postorder
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(ahead.get(start, ())))]
        while path:
            node, rest = path[-1]
            for m in rest:
                if m not in seen:
                    seen.add(m)
                    path.append((m, iter(ahead.get(m, ()))))
                    break
            else:
                path.pop()
                order.append(node)
    place = {n: k for k, n in enumerate(order)}
    top = len(order)  # stands before all entries
    for s, d in edges:
        if s in place and d in place:
            behind.setdefault(place[d], []).append(place[s])
    for n in set(entries):
        behind.setdefault(place[n], []).append(top)
    up = np.full(top + 1, -1, np.int64)
    up[top] = top
    changed = True
    while changed:
        changed = False
        for k in range(top - 1, -1, -1):
            new = -1
            for p in behind.get(k, ()):
                if up[p] < 0:
                    continue
                a, b = p, new
                while b >= 0 and a != b:  # where the two ways up meet
                    if a < b:
                        a = up[a]
                    else:
                        b = up[b]
                new = a
            if new != up[k]:
                up[k], changed = new, True
    return {n: None if up[k] == top else order[up[k]] for k, n in enumerate(order)}


def table(like: DataFrame, column: str, values: dict, name: str, kind: str) -> DataFrame:
    """(node, name) of a dictionary whose keys are of like's column's type."""
    spark, of = like.sparkSession, like.schema[column].dataType.simpleString()
    return spark.createDataFrame(list(values.items()), f"node {of}, {name} {kind or of}")
