"""Checkers over sink paths, projections, and the operators of contexts, guards and value-flow graphs that they build on."""

import random

import pytest
from pyspark.sql import functions as F

from rillgraph.analysis import Analysis
from rillgraph.config import AnalysisConfig
from rillgraph.operators import callgraph, checkers, contexts, guards, pointsto, projections, reach, valueflow

STEPS = "source long, path long, sink long, role string, field_ctx string, steps array<struct<node:long,func:string,via:string>>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def world(spark, blocks, cfg, paths):
    """What found() needs: blocks (node, func, bb, ord), edges of blocks (func, src, dst) with entry 0, paths (path, role, field, steps) of source 1."""
    insts = spark.createDataFrame(blocks, "inst long, func string, bb long, ord int")
    edges = spark.createDataFrame(cfg, "func string, src long, dst long")
    entry = edges.select("func").distinct().withColumn("bb", F.lit(0).cast("long"))
    dom = reach.dominators(edges, entry)
    ahead = reach.closure(edges.select("src", "dst"))
    df = spark.createDataFrame([(1, p, steps[-1][0], role, field, steps) for p, role, field, steps in paths], STEPS)
    return df, checkers.related(df, insts, ahead, dom)


def straight(spark, *roles, fields=None):
    """Sinks of one function, one after another; node 10 + k."""
    blocks = [(1, "f", 0, 0)] + [(10 + k, "f", 0, k + 1) for k in range(len(roles))]
    paths = [(k, r, (fields or {}).get(k, ""), [(1, "f", "intra"), (10 + k, "f", "intra")]) for k, r in enumerate(roles)]
    return world(spark, blocks, [("f", 0, 1)], paths)


def report(spark, given, *rules, api=(1,)):
    paths, rel = given
    source = lambda *s: spark.createDataFrame([(x,) for x in s], "source long")
    return [tuple(r)[1:] for r in rows(checkers.found(source(1), paths, rel, list(rules), source(*api) if api is not None else None))]


def test_rules_on_a_line(spark):
    assert report(spark, straight(spark, "dealloc", "dealloc"), "double_free") == [("double_free", 10, 11)]
    assert report(spark, straight(spark, "dealloc", "null_store", "dealloc"), "double_free", "leak") == []
    assert report(spark, straight(spark, "dealloc", "use", "use"), "use_after_free") == [("use_after_free", 10, 11)]
    assert report(spark, straight(spark, "dealloc", "null_store", "use"), "use_after_free") == []
    assert report(spark, straight(spark, "null_store"), "leak") == [("leak", 1, 1)]
    assert report(spark, straight(spark, "lock", "lock"), "double_lock") == [("double_lock", 10, 11)]
    assert report(spark, straight(spark, "lock", "unlock", "lock"), "double_lock") == []
    assert report(spark, straight(spark, "lock", "lock", fields={1: "4"}), "double_lock") == []
    # no interface leads there
    assert report(spark, straight(spark, "dealloc", "dealloc"), "double_free", api=()) == []


def test_branches(spark):
    # 0 -> 1, 2 -> 3: releases in both branches exclude each other, one behind the join does not
    cfg = [("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3)]
    blocks = [(1, "f", 0, 0), (10, "f", 1, 0), (11, "f", 2, 0), (12, "f", 3, 0)]
    way = lambda n: [(1, "f", "intra"), (n, "f", "intra")]
    both = world(spark, blocks, cfg, [(0, "dealloc", "", way(10)), (1, "dealloc", "", way(11))])
    assert report(spark, both, "double_free") == []
    three = world(spark, blocks, cfg, [(0, "dealloc", "", way(10)), (1, "dealloc", "", way(11)), (2, "dealloc", "", way(12))])
    assert report(spark, three, "double_free") == [("double_free", 10, 12), ("double_free", 11, 12)]
    # a release of the lock in one branch doesn't dominate the second acquisition; one in front of it does
    some = [(0, "lock", "", way(1)), (1, "unlock", "", way(10)), (2, "lock", "", way(12))]
    assert report(spark, world(spark, blocks, cfg, some), "double_lock") == [("double_lock", 1, 12)]
    always = [(0, "lock", "", way(1)), (1, "unlock", "", way(13)), (2, "lock", "", way(12))]
    assert report(spark, world(spark, [*blocks, (13, "f", 3, -1)], cfg, always), "double_lock") == []


def test_calls(spark):
    # f calls g (releases) at node 5 and then h (uses) at node 6; order is that of the calls
    blocks = [(1, "f", 0, 0), (5, "f", 0, 1), (6, "f", 0, 2), (20, "g", 0, 0), (30, "h", 0, 0)]
    free = [(1, "f", "intra"), (5, "f", "intra"), (20, "g", "call")]
    use = [(1, "f", "intra"), (6, "f", "intra"), (30, "h", "call")]
    cfg = [("f", 0, 1), ("g", 0, 1), ("h", 0, 1)]
    assert report(spark, world(spark, blocks, cfg, [(0, "dealloc", "", free), (1, "use", "", use)]), "use_after_free") == [("use_after_free", 20, 30)]
    swapped = world(spark, [*blocks[:1], (5, "f", 0, 2), (6, "f", 0, 1), *blocks[3:]], cfg, [(0, "dealloc", "", free), (1, "use", "", use)])
    assert report(spark, swapped, "use_after_free") == []
    assert checkers.split_point([(1, "f", ""), (20, "g", "ret")], [(1, "f", ""), (6, "f", "intra")]) is None


def test_order_and_own_rules(spark):
    rel = {(2, 1): (True, False), (1, 0): (True, False), (2, 0): (True, False)}
    paths = [(10, "dealloc"), (11, "dealloc"), (12, "dealloc")]
    assert checkers.in_order(paths, rel) == [2, 1, 0]
    # a null store that reaches and is reached by both stands before each
    loop = {(0, 1): (True, False), (2, 0): (True, False), (0, 2): (True, False), (2, 1): (True, False), (1, 2): (True, False)}
    assert checkers.in_order([(10, "dealloc"), (11, "dealloc"), (12, "null_store")], loop) == [2, 0, 2, 1]
    rule = checkers.register(checkers.Rule("any_use", ("use",), lambda paths, order, rel, new: [new(a, a) for a in order]))
    try:
        assert report(spark, straight(spark, "use", "dealloc"), "any_use") == [("any_use", 10, 10)]
    finally:
        checkers.RULES.pop(rule.name)
    paths, rel = straight(spark, "dealloc", "dealloc")
    one = spark.createDataFrame([(1,)], "source long")
    assert [r.rule for r in checkers.run(AnalysisConfig(double_free=True, leak=True, use_after_return=True), one, paths, rel).collect()] == ["double_free"]


def test_impossible_paths_go(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0, True), (1, 2, 5, 0, False), (1, 1, 6, 0, False)], "source long, src long, dst long, v int, positive boolean")
    sinks = spark.createDataFrame([(1, 5), (1, 6)], "source long, node long")
    found = guards.sink_guards(edges, sinks)
    assert rows(found) == [(1, 5, "false", False), (1, 6, "!v0", True)]
    paths = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "source long, path long, sink long")
    assert [r.sink for r in checkers.possible(paths, found).collect()] == [6]


def test_guards_across_calls(spark):
    inner = spark.createDataFrame([("f", 0, 1, "v0", False), ("g", 0, 2, "v5", False), ("g", 0, 3, "true", True)], "func string, src long, dst long, guard string, always boolean")
    cross = spark.createDataFrame([("f", 0, 1, "g", 0, 2), ("f", 0, 1, "g", 0, 3), ("f", 1, 1, "g", 0, 0), ("f", 0, 9, "g", 0, 2)], "func string, src long, at long, to_func string, entered long, dst long")
    assert rows(guards.crossing_guards(inner, cross)) == sorted([("f", 0, "g", 2, "(v0)&(v5)", False), ("f", 0, "g", 3, "v0", False), ("f", 1, "g", 0, "true", True)], key=str)


def test_projections(spark):
    frame = spark.createDataFrame
    types = frame([("S", "struct", None), ("T", "struct", None), ("U", "struct", None), ("int", "other", None), ("pS", "pointer", "S"), ("pi", "pointer", "int")], "type string, kind string, of string")
    # T holds S first, S holds a pointer; U holds int and, second, S
    fields = frame([("S", 0, "int"), ("S", 1, "pi"), ("T", 0, "int"), ("T", 1, "S"), ("U", 0, "V"), ("U", 1, "S")], "type string, ix int, field_type string")
    types = types.unionByName(frame([("V", "struct", None)], types.schema))
    g = frame([(k, t) for k, t in enumerate(("S", "T", "U", "int", "pS", "pi"))], "node long, type string")
    assert [r.type for r in projections.structured_globals(g, types, fields).orderBy("node").collect()] == ["S", "T", "pS"]
    objects = frame([(1, False, False, True), (2, True, False, True), (3, False, True, True), (4, False, False, False)], "obj long, is_const boolean, is_blackhole boolean, has_pointer boolean")
    assert [r.obj for r in projections.pointer_objects(objects).collect()] == [1]
    locs = frame([(1, "a.c", "f", 3, "x")], "node long, file_name string, func_name string, line int, var_name string")
    assert rows(projections.places(frame([(1,), (2,)], "node long"), locs)) == [(1, "a.c", "f", 3, "x"), (2, "Unknown", "Unknown", 0, "no Name")]
    assert rows(projections.resolved_names(frame([("a",), ("b",)], "func string"), frame([("a", "real")], "alias string, target string"))) == [("a", "real"), ("b", "b")]
    one, two = projections.objects_of(frame([(1, "global", False, False), (2, "heap", False, True), (3, "stack", False, False), (4, "stack", True, False)], "obj long, kind string, is_dummy boolean, is_field boolean"))
    assert ([r.obj for r in one.collect()], [r.obj for r in two.collect()]) == ([1], [3])
    edges = frame([(1, 7, None), (2, 7, "ext")], "edge long, inst long, ext_callee string")
    assert [r.func for r in projections.edge_functions(edges, frame([(7, "f")], "inst long, func string")).orderBy("edge").collect()] == ["f", "ext"]
    nodes = frame([(1, "f", "x", False), (2, "f", "p", True), (3, "g", "y", False), (4, "f", "z", False), (5, "f", "myarg", False)], "node long, func string, name string, is_param boolean")
    api, used = frame([("f",)], "func string"), frame([(1, 9), (2, 9), (3, 9), (5, 9)], "src long, dst long")
    assert rows(projections.stack_sources(nodes, api, used)) == [(1,), (5,)] and rows(projections.stack_sources(nodes, api, used, light=True)) == [(1,)]


def test_graph_of_calls(spark):
    frame = spark.createDataFrame
    calls = frame([(7, "g")], "cs long, func string")
    args, params = frame([(7, 0, 2)], "cs long, pos int, node long"), frame([("g", 0, 3)], "func string, pos int, node long")
    rets, results = frame([("g", 4)], "func string, node long"), frame([(7, 5)], "cs long, node long")
    memory = {
        "actual_in": frame([(7, 11, 100)], "cs long, node long, obj long"), "formal_in": frame([("g", 12, 100), ("g", 13, 101)], "func string, node long, obj long"),
        "formal_out": frame([("g", 14, 100)], "func string, node long, obj long"), "actual_out": frame([(7, 15, 100)], "cs long, node long, obj long"),
    }
    more = valueflow.connected(calls, args, params, rets, results, memory)
    assert rows(more) == sorted([(2, 3, "call", 7, None), (4, 5, "ret", 7, None), (11, 12, "call", 7, 100), (14, 15, "ret", 7, 100)], key=str)
    defs, uses = frame([(1, 50), (3, 51), (4, 52), (5, 53)], "node long, ptr long"), frame([(2, 50), (6, 53), (4, 51)], "node long, ptr long")
    whole = valueflow.graph(defs, uses, more)
    assert {(r.src, r.dst, r.kind) for r in whole.collect()} >= {(1, 2, "intra"), (3, 4, "intra"), (5, 6, "intra"), (2, 3, "call")}
    kinds = frame([(1, "Addr"), (2, "ActualParm"), (3, "FormalParm"), (4, "FormalRet"), (5, "ActualRet"), (6, "Store")], "node long, kind string")
    edges, nodes = valueflow.with_phis(whole.filter("obj is null"), kinds)
    assert rows(edges) == sorted([(1, 3, "call", 7, None), (3, 5, "ret", 7, None), (5, 6, "intra", None, None)], key=str)
    assert rows(nodes) == [(1, "Addr"), (3, "TInterPhi"), (5, "TInterPhi"), (6, "Store")]
    sites, known = frame([(7, "kfree.1"), (8, "other")], "cs long, callee string"), frame([("kfree", "dealloc")], "name string, role string")
    n, e = valueflow.external_sinks(sites, known, frame([(7, 0, 50), (8, 0, 50)], "cs long, pos int, ptr long"), defs, 1000)
    assert rows(n) == [(1007, "ActualParm", 7, "dealloc", 50)] and rows(e) == [(1, 1007, "intra", 7, None)]
    entry = valueflow.global_entry(frame([(20, 60)], "node long, ptr long"), frame([(60, 100), (60, 102)], "var long, obj long"), frame([(12, 100), (13, 101)], "node long, obj long"))
    assert rows(entry) == [(20, 12, "indirect", 100)]


def test_memory_edges(spark):
    ops = [(1, "f", 0, 0, 5, "chi"), (2, "f", 1, 0, 5, "chi"), (3, "f", 2, 0, 5, "mu"), (4, "f", 3, 0, 5, "phi"), (5, "f", 3, 1, 5, "mu")]
    tree = [("f", 0, None), ("f", 1, 0), ("f", 2, 0), ("f", 3, 0)]
    ops, tree = spark.createDataFrame(ops, "op long, func string, bb long, ord int, region long, kind string"), spark.createDataFrame(tree, "func string, bb long, parent long")
    got = valueflow.memory_edges(ops, tree, spark.createDataFrame([(5, 100)], "region long, obj long"))
    assert rows(got) == sorted([(1, 2, "indirect", None, 100), (1, 3, "indirect", None, 100), (4, 5, "indirect", None, 100)], key=str)


def test_locks_and_direct_returns(spark):
    frame = spark.createDataFrame
    # object 1 is handed by call 7 to 2, locked at 3; object 4 of another function flows there by call 8
    e = frame([(1, 2, "call", 7), (4, 2, "call", 8), (2, 3, "intra", None)], "src long, dst long, kind string, cs long")
    nodes = frame([(1, "Addr", "api"), (4, "Addr", "other"), (2, "Phi", "g")], "node long, kind string, func string")
    assert rows(valueflow.lock_objects(e, frame([(3,)], "node long"), nodes, frame([("api",)], "func string"))) == [(1,)]
    # 1 is returned to 2 and stored at 3; where it is stored comes from address 6, and 5 is in the forward slice
    e = frame([(1, 2, "ret", 7), (2, 3, "intra", None), (6, 3, "intra", None), (1, 5, "intra", None), (5, 3, "intra", None), (3, 9, "intra", None)], "src long, dst long, kind string, cs long")
    nodes = frame([(3, "Store"), (9, "Store"), (5, "Addr"), (6, "Addr")], "node long, kind string")
    assert rows(valueflow.direct_returns(e, frame([(1,)], "node long"), nodes)) == [(1, 3, 6)]


def test_locks_of_many_arguments_are_one_search(spark, monkeypatch):
    """What any argument leads to is as by a search for each, and no state is kept for each argument: random calls, returns and cycles."""
    chance = random.Random(8)
    seen, fixpoint = [], reach.fixpoint
    monkeypatch.setattr(reach, "fixpoint", lambda seed, *a, **k: seen.append(seed.columns) or fixpoint(seed, *a, **k))
    for _ in range(1):
        e = {(chance.randrange(40), chance.randrange(40), chance.choice(["call", "ret", "ret", "intra"]), chance.randrange(3)) for _ in range(70)}
        e = spark.createDataFrame(sorted(e), "src long, dst long, kind string, cs long")
        locks, nodes = spark.createDataFrame([(k,) for k in range(0, 40, 9)], "node long"), spark.createDataFrame([(k, "Addr", "f") for k in range(40)], "node long, kind string, func string")
        want = rows(valueflow.backward(e, locks).select("node").distinct())
        seen.clear()
        assert rows(valueflow.lock_objects(e, locks, nodes, spark.createDataFrame([("f",)], "func string"))) == want and seen == [["node", "ctx"]]


def test_context_levels_and_maps(spark):
    frame = spark.createDataFrame
    edges = frame([("a", "b", "direct"), ("a", "x", "indirect"), ("a", "y", "indirect"), ("b", "c", "direct")], "caller string, callee string, kind string")
    found = contexts.refined(edges, frame([("a",), ("b",)], "func string"), 5, lambda own: own.filter("func = 'y'").select(F.lit("a").alias("caller"), F.col("func").alias("callee")))
    assert rows(found) == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "y"), ("b", "b"), ("b", "c")]
    members = frame([(0, "a", "x"), (1, "b", "y"), (2, "c", "z")], "level int, context string, member string")
    assert {r.context: r.grp for r in contexts.grouped_by_limit(members, 2).collect()} == {"a": 0, "b": 0, "c": 1}
    # variable 1 flows to 2 (in f) and on to 3 (in g); 3 is written from 8 too, to which 9 flows (in h)
    cons = frame([(1, 2, "f"), (2, 3, "g"), (8, 3, "k"), (9, 8, "h")], "src long, dst long, func string")
    funcs, names = contexts.variable_functions(frame([(1,)], "var long"), cons, frame([(9, "obj9"), (8, "obj8")], "node long, name string"))
    assert rows(funcs) == [(1, "f"), (1, "g"), (1, "h")] and rows(names) == [(1, "obj8"), (1, "obj9")]
    calls = frame([("init", "m"), ("m", "f"), ("top", "init")], "caller string, callee string")
    assert rows(contexts.with_callers(funcs, calls, frame([("init",)], "func string"))) == [(1, x) for x in ("f", "g", "h", "init", "m")]
    assert contexts.merged_maps(funcs, funcs, funcs).count() == 3
    new = contexts.replaced(members, frame([(1, "b", "w")], members.schema))
    groups = frame([(0, "a", 0), (0, "b", 0)], "level int, context string, grp int")
    assert rows(contexts.group_members(groups, new)) == [(0, 0, "w"), (0, 0, "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_a_chain_is_that_of_the_chain(seed):
    chance = random.Random(seed)
    place = list(range(8))
    chance.shuffle(place)
    rel = {(a, b): (True, False) for a in range(8) for b in range(8) if place[a] < place[b]}
    assert [place[k] for k in checkers.in_order([(k, "use") for k in range(8)], rel)] == list(range(8))


def test_analysis_reads_its_options(spark, tmp_path):
    frame = spark.createDataFrame
    (tmp_path / "ignore.txt").write_text("warn\n")
    (tmp_path / "known.txt").write_text("1\na.c f 3 x b.c g 4 y 0 5 1.5")
    config = AnalysisConfig(func_limit=3, cxtlimit=1, cg_ignore=str(tmp_path / "ignore.txt"), import_bugs=str(tmp_path / "known.txt"), rm_deref=True, path_sens=True, double_free=True, use_after_return_lite=True, alias_rule="veto")
    run = Analysis(spark, config)
    edges = frame([("a", "b"), ("b", "c"), ("a", "do_warn"), ("c", "d")], "caller string, callee string")
    assert rows(run.context(edges, frame([("a",)], "func string"))) == [("a", "a"), ("a", "b")]
    assert {r.grp for r in run.groups(frame([(0, "x", m) for m in range(2)] + [(0, "y", m) for m in range(5, 7)], "level int, context string, member int")).collect()} == {0, 1}
    assert rows(run.aliases(frame([(1, 2, True), (1, 2, False)], "a long, b long, alias boolean"))) == [(1, 2, False)]
    assert rows(run.unknown(frame([("a.c", "f", 3), ("a.c", "f", 4)], "file_name string, func_name string, line long"))) == [("a.c", "f", 4)]
    deep = frame([(1, 2, "call", 1), (2, 3, "call", 2)], "src long, dst long, kind string, cs long")
    assert {r.node for r in run.flows(deep, frame([(1,)], "node long")).collect()} == {1, 2}
    nodes = frame([(2, "Load", 1)], "node long, kind string, ptr_def long")
    assert run.graph(frame([(1, 2, "direct")], "src long, dst long, kind string"), nodes).count() == 0
    pts, _ = run.points_to(frame([(100, 1)], "obj long, ptr long"), frame([(1, 2)], "src long, dst long"))
    assert rows(pts) == [(1, 100), (2, 100)]
    paths, rel = straight(spark, "dealloc", "dealloc")
    source, never = frame([(1,)], "source long"), frame([(1, 11, False)], "source long, node long, some_path boolean")
    assert run.check(source, paths, rel).count() == 1 and run.check(source, paths, rel, never).count() == 0
    e = frame([(1, 2, "intra", 0), (2, 5, "ret", 3), (8, 2, "intra", 0)], "src long, dst long, kind string, cs long")
    got = run.use_after_return(e, frame([(1, "f")], "node long, func string"), frame([(1, "f"), (2, "f"), (5, "main")], "node long, func string"), frame([(8,)], "node long"))
    assert set(got) == {"use_after_return_lite"} and rows(got["use_after_return_lite"]) == [(1, 8)]


def test_broad_and_saved_paths(spark):
    frame = spark.createDataFrame
    calls = frame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "bad"), ("d", "e"), ("e", "a")], "caller string, callee string")
    wide = callgraph.broad(calls, frame([("c", "handler"), ("a", "b")], "func string, operand string"))
    roots, black = frame([("a",)], "func string"), frame([("bad",)], "func string")
    assert "handler" in {r.func for r in callgraph.slice_forward(wide, roots, 3).collect()} and wide.count() == 8
    got = {(r.func, r.why) for r in callgraph.saved_paths(calls, roots, 2, black).collect()}
    # b calls c, which a calls already, and a blacklisted one; d is as deep as allowed and calls on
    assert got == {("b", "visited"), ("b", "filtered"), ("d", "depth")}
    deep = {(r.func, r.why) for r in callgraph.saved_paths(calls, roots, 9).collect()}
    assert deep == {("bad", "leaf"), ("b", "visited"), ("e", "visited")}


def test_threads_and_byte_offsets(spark):
    frame = spark.createDataFrame
    pts = frame([(1, 100), (2, 100), (3, 101)], "var long, obj long")
    assert rows(pointsto.matched_threads(frame([(7, 1), (8, 3)], "cs long, var long"), frame([(9, 2)], "cs long, var long"), pts)) == [(7, 9)]
    geps = pointsto.byte_geps(frame([(1, 2, "S", 1), (2, 3, "T", 2)], "src long, dst long, type string, ix int"), frame([("S", 1, 8), ("T", 2, 4)], "type string, ix int, at int"))
    found, _ = pointsto.andersen(frame([(100, 1)], "obj long, ptr long"), frame([], "src long, dst long"), gep=geps)
    assert {(r.var, r.obj >> 48) for r in found.collect()} == {(1, 0), (2, 8), (3, 12)}


def test_memory_nodes_go(spark):
    g = "src long, dst long, kind string, cs long, obj long"
    # 1 -> actual in 2 -> (call) 3 formal in -> 4; 5 -> formal out 6 -> (ret) 7 actual out -> 8; object 101 isn't handed on
    e = spark.createDataFrame([(1, 2, "intra", None, 100), (2, 3, "call", 7, 100), (3, 4, "intra", None, 100), (3, 9, "intra", None, 101), (5, 6, "intra", None, 100), (6, 7, "ret", 7, 100), (7, 8, "intra", None, 100), (1, 4, "intra", None, None)], g)
    nodes = spark.createDataFrame([(2, "ActualIn"), (3, "FormalIn"), (6, "FormalOut"), (7, "ActualOut"), (1, "Store")], "node long, kind string")
    assert rows(valueflow.without_memory_nodes(e, nodes)) == sorted([(1, 4, "call", 7, 100), (5, 8, "ret", 7, 100), (1, 4, "intra", None, None)], key=str)
    kept = valueflow.without_memory_nodes(e.unionByName(spark.createDataFrame([(3, 11, "call", 9, 100)], g)), nodes)
    assert (1, 3, "call", 7, 100) in rows(kept) and (3, 11, "call", 9, 100) in rows(kept)
    row = valueflow.statistics(e, reach.components(e)).first()
    assert (row.edges, row.direct, row.inter, row.nodes, row.top_out, row.cycles, row.largest_cycle) == (8, 1, 2, 9, 2, 0, 1)
    paths = spark.createDataFrame([(1, 8, [1, 3, 8]), (2, 8, [2, 8]), (1, 9, [1, 9])], "local long, pointer long, path array<long>")
    assert rows(valueflow.first_paths(paths.select("local", "pointer"), paths)) == sorted([(2, 8, [2, 8]), (1, 9, [1, 9])], key=str)


def test_sources_share_groups(spark):
    """Many sources go through the rules in few groups, each with its own paths and relation; a source without paths leaks."""
    paths, insts = [], []
    for k in range(600):
        insts += [(10 * k + j, f"f{k}", 0, j) for j in range(4)]
        paths += [(k, j, 10 * k + j, role, "", [(10 * k, f"f{k}", "intra"), (10 * k + j, f"f{k}", "intra")]) for j, role in ((1, "dealloc"), (2, "null_store" if k % 2 else "use"), (3, "dealloc")) if k % 3]
    df, insts = spark.createDataFrame(paths, STEPS), spark.createDataFrame(insts, "inst long, func string, bb long, ord int")
    apart = checkers.diverging(df)
    rel = checkers.related(df, insts, spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "func string, a long, b long"))
    found = checkers.found(spark.range(600).select(F.col("id").alias("source")), df, rel, ["double_free", "use_after_free", "leak"])
    want = [(k, "leak", k, k) for k in range(0, 600, 3)]
    for k in range(600):
        if k % 3 and not k % 2:
            want += [(k, "double_free", 10 * k + 1, 10 * k + 3), (k, "use_after_free", 10 * k + 1, 10 * k + 2)]
    assert rows(found) == sorted(want, key=str)
    assert all("bucket" in x._jdf.queryExecution().optimizedPlan().toString() for x in (apart, found))
