"""Checkers over sink paths of a program graph: their order, and the pairs that each rule reports.

A sink path is a row (source, path, sink, role, field_ctx, steps, possible): how a value gets from its source to a sink, as an array of steps
(node, func, via) from the source on, via in intra, call, ret being the edge into the node. possible says whether its guard can hold.

1. diverging() finds, for two paths of a source, the last function that both are in and where in it each goes its own way.
2. related() decides by instruction order and blocks whether the first of these points reaches and dominates the second.
3. ordered() puts a source's paths into program order, and found() walks over that order by a rule.

The walk is sequential by definition, so a source's paths are one group; they are few, as the search for paths is limited. Rules are objects in RULES;
register() adds others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.config import AnalysisConfig
from rillgraph.operators.reach import instruction_order

FOUND = "source long, rule string, sink1 long, sink2 long"
#: Whether the first path's point reaches, and dominates, the second's: by places in the list of paths.
Relation = dict[tuple[int, int], tuple[bool, bool]]
#: Sources that are worked through in one group, about.
SOURCES = 256


def split_point(a: list[tuple], b: list[tuple]) -> tuple[int, int] | None:
    """The nodes at which two lists of steps (node, func, via) go their own ways within the last function common to both; None if one leaves it by a
    return.

    As long as both are at the same node, or in the same function, they are together. Behind that, a path's node is the last one in the common
    function: where it calls out of it, or its end.
    """
    k, last = 0, min(len(a), len(b)) - 1
    common = a[0][1]
    while k < last and (a[k + 1][0] == b[k + 1][0] or a[k + 1][1] == b[k + 1][1]):
        k += 1
        common = a[k][1]

    def point(steps: list[tuple]) -> int | None:
        at = steps[k][0]
        for before, step in zip(steps[k:], steps[k + 1 :], strict=False):
            if before[1] == common and step[1] != common:
                if step[2] == "ret":
                    return None
                at = before[0]
            elif step[1] == common:
                at = step[0]
        return at

    one, two = point(a), point(b)
    return None if one is None or two is None else (one, two)


def _dealt(df: DataFrame, at: int) -> DataFrame:
    """df with a column bucket that puts at sources in one group, about: a group of its own for each source costs more than what is done in it."""
    n = df.select("source").distinct().count()
    return df.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(max(1, n // at))))


def diverging(paths: DataFrame) -> DataFrame:
    """(source, p, q, i1, i2): for paths p and q of a source, the nodes where they go their own ways; without pairs that a return rules out."""

    def each(group: pa.Table) -> pa.Table:
        given: dict[int, list] = {}
        for source, path, steps in zip(*(group[c].to_pylist() for c in ("source", "path", "steps")), strict=True):
            given.setdefault(source, []).append((path, [(x["node"], x["func"], x["via"]) for x in steps]))
        out = []
        for source, own in given.items():
            own.sort(key=lambda x: x[0])
            for p, a in own:
                out += [(source, p, q, *at) for q, b in own if p != q and (at := split_point(a, b)) is not None]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 5)], names=["source", "p", "q", "i1", "i2"])

    return _dealt(paths.select("source", "path", "steps"), SOURCES).groupBy("bucket").applyInArrow(each, "source long, p long, q long, i1 long, i2 long")


def related(paths: DataFrame, insts: DataFrame, block_reach: DataFrame, dom: DataFrame) -> DataFrame:
    """(source, p, q, reachable, dominates) of paths' pairs, by instructions (inst, func, bb, ord), reachable blocks (src, dst) and dominators (func, a, b)."""
    pairs = diverging(paths)
    order = instruction_order(pairs.select("i1", "i2").distinct(), insts, block_reach, dom)
    return pairs.join(order, ["i1", "i2"]).filter("reachable or dominates").select("source", "p", "q", "reachable", "dominates")


def in_order(paths: list[tuple], rel: Relation) -> list[int]:
    """Places of paths (sink, role) in program order: each goes before the first one that it reaches, or last.

    Null stores come after all others, and before each one that they reach, until one that is a null store itself or that does not reach them.
    """
    reaches = lambda a, b: rel.get((a, b), (False, False))[0]
    null = lambda k: paths[k][1] == "null_store"
    out: list[int] = []
    for k in sorted(range(len(paths)), key=lambda k: (null(k), k)):
        placed, at = False, 0
        while at < len(out):
            other = out[at]
            if paths[other][0] != paths[k][0] and reaches(k, other):
                out.insert(at, k)
                placed = True
                if not null(k) or null(other) or not reaches(other, k):
                    break
                at += 1
            at += 1
        if not placed:
            out.append(k)
    return out


@dataclass(frozen=True)
class Rule:
    """A checker: its name, the roles of its sinks, and what it reports of a source's paths (sink, role, field_ctx) in order.

    walk gives pairs of places; new says whether a pair has not been reported before and may be.
    """

    name: str
    roles: tuple[str, ...]
    walk: Callable[[list[tuple], list[int], Relation, Callable[[int, int], bool]], None]


def _double_free(paths: list[tuple], order: list[int], rel: Relation, new: Callable[[int, int], bool]) -> None:
    """All later reachable releases, until a reachable null store."""
    for i, a in enumerate(order):
        for b in order[i + 1 :] if paths[a][1] == "dealloc" else ():
            if rel.get((a, b), (False,))[0]:
                if paths[b][1] == "null_store":
                    break
                if paths[b][1] == "dealloc":
                    new(a, b)


def _use_after_free(paths: list[tuple], order: list[int], rel: Relation, new: Callable[[int, int], bool]) -> None:
    """The first reachable use that is a new report, until a reachable null store."""
    for i, a in enumerate(order):
        for b in order[i + 1 :] if paths[a][1] == "dealloc" else ():
            if rel.get((a, b), (False,))[0] and (paths[b][1] == "null_store" or (paths[b][1] == "use" and new(a, b))):
                break


def _double_lock(paths: list[tuple], order: list[int], rel: Relation, new: Callable[[int, int], bool]) -> None:
    """Later reachable acquisitions of the same field, but those that a release reachable before them dominates."""
    for i, a in enumerate(order):
        if paths[a][1] != "lock":
            continue
        safe: set[int] = set()
        for j, b in enumerate(order[i + 1 :], i + 1):
            if paths[a][2] != paths[b][2] or not rel.get((a, b), (False,))[0]:
                continue
            if paths[b][1] == "lock" and b not in safe:
                new(a, b)
            elif paths[b][1] == "unlock":
                safe |= {z for z in order[j + 1 :] if rel.get((b, z), (False, False))[1]}


def _leak(paths: list[tuple], order: list[int], rel: Relation, new: Callable[[int, int], bool]) -> None:
    """Sources without a release that some path reaches."""
    if not any(p[1] == "dealloc" for p in paths):
        new(-1, -1)


RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    """Add a rule under its name."""
    RULES[rule.name] = rule
    return rule


for _rule in (Rule("double_free", ("dealloc", "null_store"), _double_free), Rule("use_after_free", ("dealloc", "use", "null_store"), _use_after_free), Rule("double_lock", ("lock", "unlock"), _double_lock), Rule("leak", ("dealloc", "null_store"), _leak)):
    register(_rule)


def possible(paths: DataFrame, guards: DataFrame) -> DataFrame:
    """paths without those whose sink's condition (source, node, some_path) can't hold."""
    never = guards.filter("not some_path").select("source", F.col("node").alias("sink"))
    return paths.join(never, ["source", "sink"], "left_anti")


def _walked(rule: Rule, source: int, paths: list[tuple], rel: Relation) -> list[tuple]:
    """The pairs of sinks that a rule reports of paths (path, sink, role, field_ctx); -1 stands for none."""
    at = {p[0]: k for k, p in enumerate(paths)}
    own = {(at[p], at[q]): x for (p, q), x in rel.items() if p in at and q in at}
    bare = [p[1:] for p in paths]
    seen: set[tuple[int, int]] = set()

    def new(a: int, b: int) -> bool:
        pair = (bare[a][0] if a >= 0 else source, bare[b][0] if b >= 0 else source)
        if pair in seen:
            return False
        seen.add(pair)
        return True

    rule.walk(bare, in_order(bare, own), own, new)
    return [(source, rule.name, *pair) for pair in sorted(seen)]


def found(sources: DataFrame, paths: DataFrame, relation: DataFrame, rules: list[str], api: DataFrame | None = None) -> DataFrame:
    """FOUND of the rules for sources (source); a leak's sinks are the source itself. With api (source), only sources that an interface has a path to.

    paths: (source, path, sink, role, field_ctx), with possible guards only; relation: as related() gives it.
    """
    chosen = [RULES[r] for r in rules]
    given = sources.select("source").distinct()
    if api is not None:
        given = given.join(api.select("source").distinct(), "source", "left_semi")
    given = _dealt(given, SOURCES)
    empty = given.select("bucket", "source", *(F.lit(None).cast(t).alias(c) for c, t in (("path", "long"), ("sink", "long"), ("role", "string"), ("field_ctx", "string"))))
    own = paths.join(given, "source").select("bucket", "source", "path", "sink", "role", F.col("field_ctx").cast("string").alias("field_ctx"))
    related = relation.join(given, "source").select(F.col("bucket").alias("b"), "source", "p", "q", "reachable", "dominates")

    def each(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        held: dict[int, list] = {}
        rel: dict[int, Relation] = {}
        for source, *path in zip(*(rows[c].to_pylist() for c in ("source", "path", "sink", "role", "field_ctx")), strict=True):
            of = held.setdefault(source, [])
            if path[0] is not None:
                of.append(tuple(path))
        for source, p, q, *x in zip(*(pairs[c].to_pylist() for c in ("source", "p", "q", "reachable", "dominates")), strict=True):
            rel.setdefault(source, {})[p, q] = tuple(x)
        out = []
        for source, of in held.items():
            of.sort(key=lambda x: x[0])
            out += [x for rule in chosen for x in _walked(rule, source, [p for p in of if p[2] in rule.roles], rel.get(source, {}))]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["source", "rule", "sink1", "sink2"])

    return own.unionByName(empty).groupBy("bucket").cogroup(related.groupBy("b")).applyInArrow(each, FOUND)


def run(config: AnalysisConfig, sources: DataFrame, paths: DataFrame, relation: DataFrame, api: DataFrame | None = None) -> DataFrame:
    """FOUND of the checkers that the options ask for, as far as they are rules."""
    return found(sources, paths, relation, [c for c in config.checkers if c in RULES], api)
