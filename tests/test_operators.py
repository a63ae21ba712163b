"""Operators on hand-written facts and on random graphs, against plain Python."""

import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from rillgraph.config import AnalysisConfig
from rillgraph.functions import scalars
from rillgraph.operators import callgraph, contexts, fixpoint, guards, pointsto, reach, regions, small, typestate, valueflow

ITEMS = "source long, ord int, node long, role string, field_ctx int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def line(spark, *roles, ctx=None):
    return spark.createDataFrame([(1, k, 10 + k, r, (ctx or {}).get(k, 0)) for k, r in enumerate(roles)], ITEMS)


@pytest.mark.parametrize(
    ("roles", "free", "use", "leak"),
    [
        (("alloc", "dealloc", "dealloc"), [(1, 11, 12)], [], 0),
        (("alloc", "dealloc", "null_store", "dealloc"), [], [], 0),
        (("alloc", "dealloc", "use", "use"), [], [(1, 11, 12)], 0),
        (("alloc", "dealloc", "null_store", "use"), [], [], 0),
        (("alloc", "use"), [], [], 1),
        (("alloc", "dealloc", "dealloc", "use", "dealloc"), [(1, 11, 12), (1, 11, 14), (1, 12, 14)], [(1, 11, 13), (1, 12, 13)], 0),
    ],
)
def test_release_rules(spark, roles, free, use, leak):
    items = line(spark, *roles)
    assert rows(typestate.double_free(items)) == free
    assert rows(typestate.use_after_free(items)) == use
    assert typestate.never_freed(items).count() == leak


def test_double_lock(spark):
    assert rows(typestate.double_lock(line(spark, "lock", "lock"))) == [(1, 0, 10, 11)]
    assert rows(typestate.double_lock(line(spark, "lock", "unlock", "lock"))) == []
    assert rows(typestate.double_lock(line(spark, "lock", "lock", ctx={1: 1}))) == []
    assert rows(typestate.double_lock(line(spark, "lock", "unlock", "lock", ctx={1: 1}))) == [(1, 0, 10, 12)]


def test_exclusive_branches_have_no_pair(spark):
    items = line(spark, "alloc", "dealloc", "dealloc")
    reachable = spark.createDataFrame([(10, 11), (10, 12)], "a long, b long")
    assert typestate.pairs(items, reachable, "dealloc", "dealloc", "null_store").count() == 0
    both = spark.createDataFrame([(11, 12)], "a long, b long")
    assert rows(typestate.pairs(items, both, "dealloc", "dealloc", "null_store")) == [(1, 11, 12)]


def test_first_new(spark):
    found = spark.createDataFrame([(1, 1, 5, 2, 7), (1, 1, 5, 3, 8), (1, 2, 5, 3, 7), (1, 2, 5, 4, 9)], "source long, ord1 int, sink1 long, ord2 int, sink2 long")
    assert rows(typestate.first_new(found)) == [(1, 5, 7), (1, 5, 9)]


def random_edges(seed, n, m):
    chance = random.Random(seed)
    return sorted({(chance.randrange(n), chance.randrange(n)) for _ in range(m)})


def closed(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not new:
            return out
        out |= new


@pytest.mark.parametrize(("seed", "local"), [(1, 1 << 18), (2, 0), (3, 5)])
def test_closure_and_components(spark, monkeypatch, seed, local):
    monkeypatch.setattr(small, "LOCAL_EDGES", local)
    edges = random_edges(seed, 14, 18)
    df = spark.createDataFrame(edges, "src long, dst long")
    found = closed(edges)
    assert set(rows(fixpoint.closure(df))) == found
    assert rows(fixpoint.closure(fixpoint.closure(df))) == rows(fixpoint.closure(df))
    nodes = {x for e in edges for x in e}
    want = {n: min({n} | {m for m in nodes if (n, m) in found and (m, n) in found}) for n in nodes}
    assert dict(rows(reach.components(df))) == want


def test_no_fixpoint_is_an_error(spark):
    seed = spark.createDataFrame([(0,)], "n long")
    with pytest.raises(RuntimeError):
        fixpoint.fixpoint(seed, lambda new, _: new.select((F.col("n") + 1).alias("n")), max_rounds=3)
    known = spark.createDataFrame([(k,) for k in range(5)], "n long")
    up = lambda new, _: new.filter("n < 40").select((F.col("n") + 1).alias("n"))
    assert rows(fixpoint.fixpoint(seed, up, known=known)) == sorted(((k,) for k in range(5)), key=str)
    assert fixpoint.fixpoint(seed, up).count() == 41  # more rounds than are kept apart


def test_slices(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x_warn"), ("x_warn", "d"), ("d", "a")], "caller string, callee string")
    roots = spark.createDataFrame([("a",)], "func string")
    black = callgraph.named_like(edges.select(F.col("callee").alias("func")), spark.createDataFrame([("warn",)], "part string"))
    assert rows(callgraph.slice_forward(edges, roots, 5)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("a", "x_warn", 1)]
    assert rows(callgraph.slice_forward(edges, roots, 2, black)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    stop = spark.createDataFrame([("b",)], "func string")
    got = {r[1] for r in rows(callgraph.slice_backward(edges, spark.createDataFrame([("c",)], "func string"), stop))}
    assert got == {"c", "b"}
    paths = {r.func: r.path for r in callgraph.paths(edges, roots, 5).collect()}
    assert paths["d"] == ["a", "x_warn", "d"] and paths["c"] == ["a", "b", "c"]
    assert rows(callgraph.back_off(callgraph.slice_forward(edges, roots, 5), 4)) == [("a", 1, 3)]


def brute_andersen(addr, copy, load, store):
    pts, copies = {(p, o) for o, p in addr}, set(copy)
    while True:
        more = copies | {(o, d) for s, d in load for v, o in pts if v == s} | {(s, o) for s, d in store for v, o in pts if v == d}
        new = pts | {(d, o) for s, d in more for v, o in pts if v == s}
        if (new, more) == (pts, copies):
            return pts
        pts, copies = new, more


@pytest.mark.parametrize(("seed", "local"), [(3, 1 << 18), (4, 0)])
def test_andersen(spark, monkeypatch, seed, local):
    monkeypatch.setattr(small, "LOCAL_EDGES", local)
    chance = random.Random(seed)
    some = lambda n, a, b: sorted({(chance.randrange(*a), chance.randrange(*b)) for _ in range(n)})
    addr, copy, load, store = some(8, (100, 106), (0, 12)), some(9, (0, 12), (0, 12)), some(5, (0, 12), (0, 12)), some(5, (0, 12), (0, 12))
    frame = lambda x, names: spark.createDataFrame(x, names)
    pts, _ = pointsto.andersen(frame(addr, "obj long, ptr long"), *(frame(x, "src long, dst long") for x in (copy, load, store)))
    assert set(rows(pts)) == brute_andersen(addr, copy, load, store)


def test_fields_and_collapse(spark):
    frame = spark.createDataFrame
    addr, none = frame([(100, 1)], "obj long, ptr long"), frame([], "src long, dst long")
    gep = frame([(1, 2, 3), (2, 3, 2)], "src long, dst long, offset long")
    pts, _ = pointsto.andersen(addr, none, gep=gep)
    at = lambda k: 100 + (k << 48)
    assert rows(pts) == sorted([(1, 100), (2, at(3)), (3, at(5))], key=str)
    pts, _ = pointsto.andersen(addr, none, gep=gep, variant_gep=frame([(3, 4)], "src long, dst long"))
    assert rows(pts) == [(1, 100), (2, 100), (3, 100), (4, 100)]
    pairs = frame([(1, 2), (1, 9)], "a long, b long")
    assert rows(pointsto.aliases(pairs, frame([(1, 100), (2, at(3))], "var long, obj long"))) == [(1, 2)]


def test_indirect_calls(spark):
    frame = spark.createDataFrame
    calls = {
        "callsites": frame([(7, 1, 2), (8, 1, 1)], "cs long, funptr long, n_args int"), "functions": frame([("f", 50, 2), ("g", 51, 1)], "func string, obj long, n_args int"),
        "args": frame([(7, 0, 20), (7, 1, 21), (8, 0, 22)], "cs long, pos int, node long"), "params": frame([("f", 0, 30), ("f", 1, 31), ("g", 0, 32)], "func string, pos int, node long"),
        "rets": frame([("f", 40)], "func string, node long"), "results": frame([(7, 41)], "cs long, node long"),
    }
    addr = frame([(50, 1), (60, 20), (61, 22), (62, 40)], "obj long, ptr long")
    pts, copies = pointsto.andersen(addr, frame([], "src long, dst long"), calls=calls)
    assert rows(copies) == [(20, 30), (21, 31), (40, 41)] and (30, 60) in rows(pts) and (41, 62) in rows(pts)


def test_matched_contexts(spark):
    e = [(1, 10, "call", 7), (10, 11, "intra", 0), (11, 2, "ret", 7), (11, 3, "ret", 8), (2, 4, "intra", 0)]
    edges = spark.createDataFrame(e, "src long, dst long, kind string, cs long")
    got = {(r.node, tuple(r.ctx)) for r in reach.forward(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(1, ()), (10, (7,)), (11, (7,)), (2, ()), (4, ())}
    sink = spark.createDataFrame([(2,)], "node long")
    assert (4,) not in {(r.node,) for r in reach.forward(edges, spark.createDataFrame([(1,)], "node long"), sink).collect()}


def test_backward_paths(spark):
    e = [(1, 2, None), (2, 4, 5), (1, 3, None), (3, 4, None), (4, 2, None)]
    edges = spark.createDataFrame(e, "src long, dst long, offset long")
    got = reach.backward_paths(edges, spark.createDataFrame([(1, 4)], "source long, sink long"))
    assert [(r.path_id, r.path, r.field_ctx) for r in got.orderBy("path_id").collect()] == [(0, [1, 2, 4], [5]), (1, [1, 3, 4], [])]


def test_long_chain(spark):
    edges = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert reach.components(edges).filter("node = rep").count() == 1001
    assert fixpoint.closure(edges, spark.createDataFrame([(0,)], "src long")).count() == 1000
    assert reach.levels(edges).agg(F.max("level")).first()[0] == 1000
    ring = edges.unionByName(spark.createDataFrame([(1000, 0)], "src long, dst long"))
    assert reach.components(ring).filter("rep = 0").count() == 1001
    with pytest.raises(ValueError):
        reach.levels(ring)


@pytest.mark.parametrize("local", [1 << 18, 0])
def test_levels(spark, monkeypatch, local):
    monkeypatch.setattr(small, "LOCAL_EDGES", local)
    edges = sorted({(min(e), max(e)) for e in random_edges(6, 12, 20) if e[0] != e[1]})
    want = {n: 0 for e in edges for n in e}
    for n in sorted(want):
        want[n] = max([want[s] + 1 for s, d in edges if d == n], default=0)
    assert dict(rows(reach.levels(spark.createDataFrame(edges, "src long, dst long")))) == want
    with pytest.raises(ValueError):
        reach.levels(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


@pytest.mark.parametrize("local", [1 << 18, 3])
def test_dominators_of_random_graphs(spark, monkeypatch, local):
    monkeypatch.setattr(small, "LOCAL_EDGES", local)
    for seed in (1, 2):
        edges = random_edges(seed, 8, 14)
        found = closed(edges)
        blocks = {0} | {b for a, b in found if a == 0}
        around = lambda a: {0} - {a} | {d for s, d in closed([e for e in edges if a not in e]) if s == 0 != a}
        want = {("f", a, b) for a in blocks for b in blocks if b not in around(a)}
        df = spark.createDataFrame([("f", s, d) for s, d in edges] + [("g", 0, 1)], "func string, src long, dst long")
        got = reach.dominators(df, spark.createDataFrame([("f", 0), ("g", 0)], "func string, bb long"))
        assert set(rows(got.filter("func = 'f'"))) == want and got.filter("func = 'g'").count() == 3


def test_dominance(spark):
    e = spark.createDataFrame([("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3), ("f", 3, 0)], "func string, src long, dst long")
    dom = reach.dominators(e, spark.createDataFrame([("f", 0)], "func string, bb long"))
    assert rows(dom) == [("f", a, b) for a, b in [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (2, 2), (3, 3)]]
    df = reach.frontiers(e, dom)
    assert rows(df) == [("f", 0, 0), ("f", 1, 3), ("f", 2, 3), ("f", 3, 0)]
    phis = reach.iterated_frontier(spark.createDataFrame([("f", "r", 1)], "func string, key string, bb long"), df)
    assert rows(phis) == [("f", "r", 0), ("f", "r", 3)]
    insts = spark.createDataFrame([(1, "f", 0, 0), (2, "f", 0, 1), (3, "f", 1, 0)], "inst long, func string, bb long, ord int")
    blocks = fixpoint.closure(spark.createDataFrame([(0, 1)], "src long, dst long"))
    got = reach.instruction_order(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1)], "i1 long, i2 long"), insts, blocks, dom)
    assert rows(got) == [(1, 2, True, True), (2, 1, False, False), (2, 3, True, True), (3, 1, False, False)]


def test_guard_algebra():
    a, b = guards.var(1), guards.var(2)
    assert guards.either(a, guards.negated(a)) == guards.TRUE and guards.both(a, guards.negated(a)) == guards.FALSE
    assert guards.negated(guards.both(a, b)) == guards.either(guards.negated(a), guards.negated(b))
    assert guards.either(guards.both(a, b), guards.both(a, guards.negated(b))) == a
    assert guards.shown(guards.both(a, guards.negated(b))) == "v1&!v2"
    assert guards.edge_guard(2, 1, 5) == guards.var(5) and guards.edge_guard(1, 0, 5) == guards.TRUE and guards.edge_guard(2, 0, 5, "eq_null") == guards.FALSE
    assert guards.edge_guard(5, 4, 0).support() == (0, 1, 2)
    many, any_ = guards.TRUE, guards.FALSE
    for v in range(60):
        many, any_ = guards.both(many, guards.var(v)), guards.either(any_, guards.var(v, False))
    assert many not in (guards.TRUE, guards.FALSE) and guards.negated(many) == any_ and guards.both(many, any_) == guards.FALSE
    assert guards.shown(many) == "&".join(f"v{v}" for v in range(60))
    chance = random.Random(9)
    for _ in range(50):
        x, y = (reduce(chance.choice((guards.both, guards.either)), [guards.var(chance.randrange(6), chance.random() < 0.5) for _ in range(5)]) for _ in range(2))
        true = {v for v in range(6) if chance.random() < 0.5}
        assert guards.holds(guards.both(x, y), true) == (guards.holds(x, true) and guards.holds(y, true))
        assert guards.holds(guards.either(x, guards.negated(y)), true) == (guards.holds(x, true) or not guards.holds(y, true))


def test_guarded_release(spark):
    edges = [(1, 1, 2, 0, True), (1, 1, 3, 0, False), (1, 2, 5, None, None), (1, 3, 6, None, None), (9, 9, 10, 3, True)]
    df = spark.createDataFrame(edges, "source long, src long, dst long, v int, positive boolean")
    sinks = spark.createDataFrame([(1, 5), (1, 6), (9, 10)], "source long, node long")
    assert rows(guards.slice_verdicts(df, sinks)) == [(1, "true", True, True, False), (9, "v3", False, True, False)]
    cfg = [("f", 0, 1, 0, 2, 0, None, False), ("f", 0, 2, 1, 2, 0, None, False), ("f", 1, 3, 0, 1, 1, None, False), ("f", 2, 3, 0, 1, 1, None, False), ("f", 3, 4, 0, 1, 1, None, True)]
    df = spark.createDataFrame(cfg, "func string, src long, dst long, succ_ix int, n_succ int, first_var int, test string, exits boolean")
    got = {(r.src, r.dst): r.guard for r in guards.block_guards(df).collect()}
    assert got == {(0, 1): "!v0", (0, 2): "v0", (0, 3): "true", (1, 3): "true", (2, 3): "true"}


def test_closure_as_arrays(spark, monkeypatch):
    """A graph too large for the walk of one seed is walked from many at once, without rounds: cycles, loops, nulls, seeds outside the graph."""
    chance = random.Random(12)
    e = {(chance.randrange(300) - 50, chance.randrange(300) - 50) for _ in range(330)} | {(7, 7), (1000, 1001), (1001, 1000)}
    df = spark.createDataFrame([*e, (None, 1), (1, None)], "src long, dst long")
    seeds = spark.createDataFrame([(k,) for k in (*range(-60, 260), 1000, 5000, None)], "src long")
    want = rows(fixpoint.closure(df, seeds)), rows(fixpoint.closure(df))
    monkeypatch.setattr(small, "LOCAL_EDGES", 50)
    monkeypatch.setattr(fixpoint, "fixpoint", None)
    assert (rows(fixpoint.closure(df, seeds)), rows(fixpoint.closure(df))) == want


def test_supersets_of_frequent_objects(spark):
    """Sets of one to twelve objects against all pairs; small ones meet by parts of three objects, not by one object that many sets hold."""
    chance = random.Random(11)
    sets = {k: frozenset(chance.sample(range(40), chance.choice([1, 2, 3, 4, 5, 6, 7] * 6 + [9, 12]))) for k in range(2000)}
    df = spark.createDataFrame([(k, o) for k, x in sets.items() for o in x], "pset long, obj long")
    want = {k: min((-len(y), j) for j, y in sets.items() if x <= y)[1] for k, x in sets.items()}
    found = regions.superset_regions(df)
    assert dict(rows(found)) == want
    assert "part#" in found._jdf.queryExecution().optimizedPlan().toString()


def test_supersets_without_broadcast_joins(spark):
    """Tables that are small as files are not sent through the driver; sets of up to 30 objects, some on each side of the bound, copies, repeated rows and nulls."""
    chance = random.Random(13)
    sets = {k: frozenset(chance.sample(range(-20, 20), chance.choice([1, 2, 3, 5, 9, 13, 14, 21, 30]))) for k in range(-500, 700)}
    sets |= {k + 5000: frozenset(list(sets[k])[: chance.randrange(1, 20)]) for k in range(600)} | {k + 9000: sets[k] for k in range(100)}
    held = [(k, o) for k, x in sets.items() for o in x]
    df = spark.createDataFrame(held + held[:500] + [(None, 1), (99999, None)], "pset long, obj long")
    want = {k: min((-len(y), j) for j, y in sets.items() if x <= y)[1] for k, x in sets.items()}
    assert regions.SMALL <= regions.bound(Counter(len(x) for x in sets.values())) < 21
    found = regions.superset_regions(df)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert dict(rows(found)) == want
    assert dict(rows(regions.superset_regions(df.select(F.col("pset").cast("string"), F.col("obj").cast("string"))))) == {str(k): min((-len(y), str(j)) for j, y in sets.items() if x <= y)[1] for k, x in sets.items()}


def test_regions(spark):
    sets = {1: {1, 2, 3}, 2: {2, 3, 4}, 3: {2, 3}, 4: {9}, 5: {1, 2, 3}}
    df = spark.createDataFrame([(k, o) for k, s in sets.items() for o in s], "pset long, obj long")
    got = {}
    for region, obj in rows(regions.disjoint_regions(df)):
        got.setdefault(region, set()).add(obj)
    assert got == {1: {1}, 2: {2, 3}, 4: {4}, 9: {9}}
    assert {r.region: set(r.objs) for r in regions.distinct_regions(df).collect()} == {1: {1, 2, 3}, 2: {2, 3, 4}, 3: {2, 3}, 4: {9}}
    assert dict(rows(regions.superset_regions(df))) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1}
    held = rows(regions.regions_of(regions.disjoint_regions(df), df))
    assert all(got[r] <= sets[p] for p, r in held) and len(held) == 8


def test_mod_ref(spark):
    local = spark.createDataFrame([("c", 1, "mod"), ("c", 2, "ref"), ("b", 3, "ref")], "func string, obj long, effect string")
    calls = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "caller string, callee string, cs long")
    seen = spark.createDataFrame([(2, 1)], "cs long, obj long")
    only = spark.createDataFrame([(3,)], "obj long")
    got = set(rows(regions.mod_ref(local, calls, seen, only)))
    assert got == {("c", 1, "mod"), ("c", 1, "ref"), ("c", 2, "ref"), ("b", 3, "ref"), ("b", 1, "mod"), ("b", 1, "ref"), ("a", 3, "ref")}


def test_memory_ssa(spark):
    ops = [(1, "f", 0, 0, 5, "chi"), (2, "f", 1, 0, 5, "chi"), (3, "f", 2, 0, 5, "mu"), (4, "f", 3, 0, 5, "phi"), (5, "f", 3, 1, 5, "mu")]
    tree = [("f", 0, None), ("f", 1, 0), ("f", 2, 0), ("f", 3, 0)]
    got = valueflow.renamed(spark.createDataFrame(ops, "op long, func string, bb long, ord int, region long, kind string"), spark.createDataFrame(tree, "func string, bb long, parent long"))
    assert {r.op: (r.use, r["def"]) for r in got.collect()} == {1: (0, 1), 2: (1, 2), 3: (1, None), 4: (None, 3), 5: (3, None)}


def test_value_flow(spark):
    frame = spark.createDataFrame
    e = frame([(1, 2), (2, 3), (3, 4), (2, 2)], "src long, dst long")
    assert rows(valueflow.bypassed(e, frame([(2,), (3,)], "node long"))) == [(1, 4)]
    sites = frame([(1, "main", "kmalloc.3"), (2, "main", "kfree"), (3, "other", "kmalloc")], "cs long, caller string, callee string")
    known = frame([("kmalloc", "alloc"), ("kfree", "dealloc")], "name string, role string")
    args, results = frame([(2, 0, 20)], "cs long, pos int, node long"), frame([(1, 10), (3, 30)], "cs long, node long")
    assert rows(valueflow.roles(sites, known, args, results, frame([("main",)], "caller string"))) == [(10, "alloc"), (20, "dealloc")]
    nodes = frame([(1, "Load"), (2, "Gep"), (3, "Gep"), (4, "Load")], "node long, kind string")
    assert rows(valueflow.uses(nodes, frame([(9, 2), (9, 3), (1, 7), (8, 4)], "src long, dst long"))) == [(4,), (9,)]


def test_flow_sensitive_strong_update(spark):
    # p = &o (1); *p = &a (2); *p = &b (3); q = *p (4): q holds b only
    frame = spark.createDataFrame
    nodes = frame([(1, "addr", 100, 1), (11, "addr", 200, 2), (12, "addr", 201, 3), (2, "store", 2, 1), (3, "store", 3, 1), (4, "load", 1, 5)], "loc long, kind string, src long, dst long")
    edges = frame([(1, 2, None), (1, 3, None), (1, 4, None), (11, 2, None), (12, 3, None), (2, 3, 100), (3, 4, 100)], "src long, dst long, var long")
    flat = frame([(1, 100), (2, 200), (3, 201)], "var long, obj long")
    strong = valueflow.flow_sensitive(nodes, edges, frame([(100,)], "obj long"), flat)
    assert {r.obj for r in strong.filter("loc = 4 and var = 5").collect()} == {201}
    weak = valueflow.flow_sensitive(nodes, edges, frame([], "obj long"), flat)
    assert {r.obj for r in weak.filter("loc = 4 and var = 5").collect()} == {200, 201}


def test_use_after_return(spark):
    # f: local 1 flows to 2, out of f by a return to 5; the global 8 flows to 5 too
    e = [(1, 2, "intra", 0), (2, 5, "ret", 3), (8, 2, "intra", 0)]
    edges = spark.createDataFrame(e, "src long, dst long, kind string, cs long")
    funcs = spark.createDataFrame([(1, "f"), (2, "f"), (5, "main")], "node long, func string")
    own, pointers = spark.createDataFrame([(1, "f")], "node long, func string"), spark.createDataFrame([(8,)], "node long")
    assert rows(valueflow.use_after_return(edges, own, funcs, pointers)) == [(1, 8)]
    inside = edges.filter("kind <> 'ret'")
    assert rows(valueflow.use_after_return(inside, own, funcs, pointers)) == []


def test_contexts(spark):
    names = spark.createDataFrame([("__initcall_a_early",), ("__initcall_b_rootfs",), ("__initcall_c6",), ("__initcall_d4s",), ("__initcall_e",)], "n string")
    assert [r[0] for r in names.select(contexts.initcall_level(F.col("n"))).collect()] == [0, 5, 6, 4, 8]
    members = spark.createDataFrame([(0, c, m) for c, ms in {"a": "xy", "b": "yz", "c": "pqr", "d": "x"}.items() for m in ms], "level int, context string, member string")
    assert {r.context: r.grp for r in contexts.grouped(members, 3).collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}
    f = spark.createDataFrame([("api", "drivers/x.c", True, False, False), ("inner", "drivers/x.c", True, False, False), ("other", "fs/y.c", True, False, False)], "func string, file string, is_ext_linkage boolean, address_taken boolean, is_decl boolean")
    assert rows(contexts.api_functions(f, spark.createDataFrame([("api", "inner")], "caller string, callee string"), "drivers")) == [("api",)]


def test_scalars(spark):
    df = spark.createDataFrame([([12, 18, 30], [1, 2, 3, 9], [4, 2, 3, 9], "ab.c.d", " one  two ", 5, [3, 0, 7])], "s array<long>, a array<long>, b array<long>, n string, t string, k int, c array<long>")
    got = df.select(
        scalars.gcd(F.col("s")), scalars.path_distance(F.col("a"), F.col("b")), scalars.common_suffix(F.col("a"), F.col("b")), scalars.base_name(F.col("n")), scalars.last_word(F.col("t")),
        scalars.branch_bits(F.col("k")), scalars.bit(F.col("k"), 2), scalars.resolved(F.col("c"), F.lit(4).cast("long")), scalars.resolved(F.col("c"), F.lit(7).cast("long")),
        scalars.strided(F.lit(2), F.array(F.struct(F.lit(3).alias("num"), F.lit(10).alias("stride")), F.struct(F.lit(2).alias("num"), F.lit(1).alias("stride")))), scalars.half_average(F.col("s")),
        scalars.inverted(F.create_map(F.lit("x"), F.lit("y"))),
    ).first()
    assert tuple(got) == (6, 1, 3, "ab", "two", 3, 1, [3, 4, 7], None, [2, 3, 12, 13, 22, 23], 21, {"y": "x"})


def test_config():
    assert AnalysisConfig(double_lock=True, leak=True).checkers == ["leak", "double_lock"] and AnalysisConfig().func_limit == 3000
    with pytest.raises(ValueError):
        AnalysisConfig(syscall="a", driver="b")
