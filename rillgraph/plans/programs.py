"""Queries over program facts made from the driver's tables, for operators that the other plans do not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.functions import scalars
from rillgraph.operators import callgraph, contexts, guards, pointsto, reach, regions, typestate, valueflow
from rillgraph.plans import lenses
from rillgraph.plans.lenses import CALLS, CELLS, CONTEXTS, COPIES, FUNCTIONS, PSETS


def _lines(s, d):
    """(order, line, part)."""
    return lenses.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()


_LINES = "lines AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)"


def _parts(s, d):
    return lenses.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("func"), "p_size", "p_type")


def _bind(s, d):
    """Orders as calls of the function l_partkey % 20 of their first line: lines as arguments, the functions' parameters by position."""
    l = _lines(s, d)  # noqa: E741
    calls = l.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("cs"), (F.col("l_partkey") % 20).alias("func")).distinct()
    args = l.select(F.col("l_orderkey").alias("cs"), (F.col("l_linenumber") - 1).alias("pos"), F.col("l_partkey").alias("node"))
    params = s.range(20).select(F.col("id").alias("func"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("pos")).withColumn("node", 10**9 + F.col("func") * 10 + F.col("pos") + 1)
    rets = s.range(20).select(F.col("id").alias("func"), (10**9 + F.col("id") * 10 + 9).alias("node"))
    results = calls.select("cs", (F.col("cs") + 2 * 10**9).alias("node"))
    return pointsto.bind(calls, args, params, rets, results)


def _crossing(s, d):
    c = lenses.contexts(s, d)
    actual = lenses.psets(s, d).select(F.col("pset").alias("cs"), F.col("pset").alias("node"), "obj")
    formal = c.select(F.col("level").alias("func"), F.col("context").alias("node"), F.col("member").alias("obj"))
    calls = actual.select("cs", (F.col("cs") % 25).cast("int").alias("func")).distinct()
    return valueflow.crossing(actual, formal, calls)


def _bypassed(s, d):
    e = lenses.calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).filter("src <> dst")
    return valueflow.bypassed(e, lenses.functions(s, d).filter("node % 4 = 0"))


def _chain(s, d):
    """Points-to chains: the cell of an order's first part points to that of the next order's first part."""
    addr, copy = lenses.cells(s, d), lenses.copies(s, d)
    ahead = copy.join(addr.withColumnsRenamed({"obj": "a", "ptr": "src"}), "src").join(addr.withColumnsRenamed({"obj": "b", "ptr": "dst"}), "dst")
    cells = ahead.select(F.col("a").alias("var"), F.col("b").alias("obj")).distinct()
    return pointsto.chain(cells, cells.select(F.col("var").alias("obj")).distinct())


def _combined(s, d):
    """Two analyses that say whether neighbouring orders share a part: by all lines, and by the first line."""
    p = lenses.copies(s, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    first = p.select("a", "b", (F.col("a") % 2 == 0).alias("alias"))
    return pointsto.combined(first.unionByName(p.select("a", "b", (F.col("b") % 3 == 0).alias("alias"))), "veto")


def _guards(s, d):
    """Blocks of a function for each supplier: its parts modulo 8, each branching to the next two."""
    c = lenses.contexts(s, d).select(F.col("context").cast("string").alias("func"), (F.col("member") % 8).cast("long").alias("src")).distinct()
    e = c.select("func", "src", F.explode(F.array(F.lit(0), F.lit(1))).alias("succ_ix"))
    e = e.select("func", "src", (F.col("src") + F.col("succ_ix") + 1).alias("dst"), "succ_ix", F.lit(2).alias("n_succ"), F.col("src").cast("int").alias("first_var"), F.lit(None).cast("string").alias("test"), F.lit(False).alias("exits"))
    return guards.block_guards(e)


def _phis(s, d):
    e = lenses.calls(s, d).select(F.lit(0).alias("func"), F.col("caller").alias("src"), F.col("callee").alias("dst")).filter("src < dst")
    dom = reach.dominators(e, s.createDataFrame([(0, 0)], "func int, bb long"))
    return reach.frontiers(e, dom).select("a", "b")


def _ssa(s, d):
    """Each supplier as a function whose blocks are its parts modulo 6, a tree by halves, with a definition or use in each."""
    c = lenses.contexts(s, d)
    ops = c.select(F.col("member").alias("op"), F.col("context").alias("func"), (F.col("member") % 6).alias("bb"), F.col("member").cast("int").alias("ord"), (F.col("member") % 3).alias("region"), F.when(F.col("member") % 2 == 0, "mu").otherwise("chi").alias("kind"))
    tree = c.select(F.col("context").alias("func")).distinct().select("func", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("bb"))
    return valueflow.renamed(ops, tree.withColumn("parent", F.when(F.col("bb") > 0, F.floor((F.col("bb") - 1) / 2))))


def _tree(s, d):
    """Each function below the least of its callers, if that is smaller."""
    return lenses.calls(s, d).filter("caller < callee").groupBy("callee").agg(F.min("caller").alias("caller"))


def _uar(s, d):
    kind = F.when(F.col("callee") % 5 == 0, "call").when(F.col("callee") % 3 == 0, "ret").otherwise("intra")
    e = lenses.calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), kind.alias("kind"), (F.col("callee") % 3).cast("long").alias("cs")).filter("src < dst")
    func = lambda c: (c % 4).cast("string").alias("func")
    nodes = lenses.functions(s, d).select("node", func(F.col("node")))
    return valueflow.use_after_return(e, nodes.filter("node < 6"), nodes, nodes.filter("node % 11 = 0").select("node"), limit=3)


def _pairs(s, d):
    i = lenses.items(s, d)
    ahead = i.select(F.col("node").alias("a"), "source", F.col("ord").alias("o")).join(i.select(F.col("node").alias("b"), "source", F.col("ord").alias("p")), "source").filter("o < p and (a + b) % 2 = 0").select("a", "b")
    return typestate.pairs(i, ahead, "dealloc", "use", "null_store")


QUERIES = {
    "j6_parameters": _bind,
    "j5_indirect_calls": lambda s, d: pointsto.indirect_calls(
        _lines(s, d).select(F.col("l_orderkey").alias("var"), F.col("l_partkey").alias("obj")),
        _lines(s, d).groupBy(F.col("l_orderkey").alias("cs")).agg(F.count("*").cast("int").alias("n_args")).withColumn("funptr", F.col("cs")),
        _parts(s, d).select(F.col("id").alias("func"), F.col("id").alias("obj"), (F.col("p_size") % 7 + 1).cast("int").alias("n_args")),
    ),
    "j11_crossing": _crossing,
    "j18_combined": _combined,
    "x20_chain": _chain,
    "x28_block_guards": _guards,
    "x41_frontiers": _phis,
    "x42_memory_ssa": _ssa,
    "c6_use_after_return": _uar,
    "x32_reachable_pairs": _pairs,
    "g2_merged_edges": lambda s, d: valueflow.merged_edges(
        lenses.psets(s, d).select((F.col("pset") % 100).alias("src"), (F.col("obj") % 10).alias("dst"), F.lit("indirect").alias("kind"), F.lit(0).alias("cs"), "obj")
    ).select("src", "dst", "kind", "cs", F.array_join(F.transform("objs", lambda x: x.cast("string")), ",").alias("objs")),
    "g7_bypassed": _bypassed,
    "j9_direct_edges": lambda s, d: valueflow.direct_edges(
        lenses.contexts(s, d).filter("level < 12").select(F.col("context").alias("node"), F.col("member").alias("ptr")), lenses.contexts(s, d).filter("level >= 12").select(F.col("context").alias("node"), F.col("member").alias("ptr"))
    ),
    "p10_null_stores": lambda s, d: valueflow.null_stores(lenses.calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))),
    "p11_parameter_stores": lambda s, d: valueflow.parameter_stores(
        lenses.calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")),
        lenses.functions(s, d).select("node", F.when(F.col("node") % 3 == 0, "TInterPhi").when(F.col("node") % 3 == 1, "Addr").otherwise("Store").alias("kind")),
    ),
    "p14_uses": lambda s, d: valueflow.uses(
        lenses.functions(s, d).select("node", F.when(F.col("node") % 2 == 0, "Load").otherwise("Gep").alias("kind")), _tree(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    ),
    "p7_named_like": lambda s, d: callgraph.named_like(_parts(s, d).select("func"), s.createDataFrame([("d wid",), ("gear",)], "part string")).distinct(),
    "p9_api_functions": lambda s, d: contexts.api_functions(
        _parts(s, d).select("id", F.col("id").alias("func"), F.col("p_type").alias("file"), (F.col("p_size") % 2 == 0).alias("is_ext_linkage"), (F.col("p_size") % 3 == 0).alias("address_taken"), (F.col("p_size") % 11 == 0).alias("is_decl")),
        lenses.calls(s, d).filter("caller < callee"), "E"
    ),
    "ra_context": lambda s, d: callgraph.slice_forward(lenses.calls(s, d), s.createDataFrame([(3,), (4,)], "func long"), 2).select("func").distinct(),
    "x16_globals": lambda s, d: regions.global_closure(lenses.copies(s, d), lenses.copies(s, d).select("src")),
    "f15_strides": lambda s, d: _parts(s, d).select("id", F.array_join(F.transform(scalars.strided(F.col("p_size"), F.array(F.struct(F.lit(3).alias("num"), F.lit(10).alias("stride")))), lambda x: x.cast("string")), ",").alias("offsets")),
    "x12_call_kinds": lambda s, d: callgraph.edges_of(
        lenses.calls(s, d).filter("callee % 2 = 0"), lenses.calls(s, d).filter("callee % 3 = 0"), lenses.calls(s, d).filter("callee % 5 = 0").withColumn("kind", F.lit("fork"))
    ).groupBy("kind").agg(F.count("*").alias("n")),
}

ORACLES = {
    "j6_parameters": f"""
WITH {_LINES}, c AS (SELECT DISTINCT l_orderkey AS cs, l_partkey % 20 AS func FROM lines WHERE l_linenumber = 1)
SELECT l_partkey AS src, 1000000000 + func * 10 + CASE WHEN l_linenumber <= 2 THEN l_linenumber ELSE 0 END AS dst FROM lines JOIN c ON l_orderkey = cs
UNION SELECT 1000000000 + func * 10 + 9, cs + 2000000000 FROM c""",
    "j5_indirect_calls": f"""
WITH {_LINES}, n AS (SELECT l_orderkey, count(*) AS n FROM lines GROUP BY 1)
SELECT DISTINCT l.l_orderkey AS cs, l_partkey AS func FROM lines l JOIN n ON n.l_orderkey = l.l_orderkey JOIN part ON p_partkey = l_partkey AND p_size % 7 + 1 = n""",
    "j11_crossing": f"""
WITH {PSETS}, {CONTEXTS}
SELECT DISTINCT pset AS src, context AS dst, pset AS cs, obj FROM psets JOIN ctx ON member = obj AND level = pset % 25""",
    "j18_combined": """
WITH copies AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)
SELECT src AS a, dst AS b, src % 2 = 0 AND dst % 3 = 0 AS alias FROM copies""",
    "x20_chain": f"""
WITH RECURSIVE {COPIES}, {CELLS},
held AS (SELECT DISTINCT a.obj AS var, b.obj AS obj FROM copies JOIN cells a ON a.ptr = src JOIN cells b ON b.ptr = dst),
w AS (SELECT DISTINCT var AS root, var AS obj FROM held UNION SELECT root, held.obj FROM w JOIN held ON held.var = w.obj)
SELECT DISTINCT root, obj FROM w""",
    "x41_frontiers": f"""
WITH RECURSIVE {CALLS}, d AS (SELECT caller AS src, callee AS dst FROM calls WHERE caller < callee),
b AS (SELECT 0::BIGINT AS n UNION SELECT dst FROM b JOIN d ON b.n = d.src),
around AS (SELECT a.n AS a, 0::BIGINT AS n FROM b a WHERE a.n <> 0 UNION SELECT a, d.dst FROM around JOIN d ON around.n = d.src WHERE d.dst <> a),
dom AS (SELECT a.n AS a, b.n AS b FROM b a, b b WHERE NOT EXISTS (SELECT 1 FROM around r WHERE r.a = a.n AND r.n = b.n))
SELECT DISTINCT x.a, d.dst AS b FROM d JOIN dom x ON x.b = d.src WHERE NOT EXISTS (SELECT 1 FROM dom y WHERE y.a = x.a AND y.b = d.dst AND y.a <> y.b)""",
    "x32_reachable_pairs": f"""
WITH {lenses.ITEMS}, i AS (SELECT * FROM items),
p AS (SELECT a.source, a.ord AS o1, a.node AS sink1, b.ord AS o2, b.node AS sink2, b.role FROM i a JOIN i b ON a.source = b.source AND a.ord < b.ord WHERE a.role = 'dealloc' AND (a.node + b.node) % 2 = 0)
SELECT DISTINCT source, sink1, sink2 FROM p WHERE role = 'use' AND NOT EXISTS (SELECT 1 FROM p k WHERE k.source = p.source AND k.o1 = p.o1 AND k.role = 'null_store' AND k.o2 <= p.o2)""",
    "g2_merged_edges": f"""
WITH {PSETS}
SELECT pset % 100 AS src, obj % 10 AS dst, 'indirect' AS kind, 0 AS cs, array_to_string(list_sort(list(DISTINCT obj)), ',') AS objs FROM psets GROUP BY 1, 2""",
    "g7_bypassed": f"""
WITH RECURSIVE {CALLS}, e AS (SELECT caller AS src, callee AS dst FROM calls WHERE caller <> callee),
w AS (SELECT src, dst FROM e WHERE src % 4 <> 0 UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src WHERE w.dst % 4 = 0)
SELECT DISTINCT src, dst FROM w WHERE dst % 4 <> 0 AND src <> dst""",
    "j9_direct_edges": f"WITH {CONTEXTS} SELECT DISTINCT a.context AS src, b.context AS dst, 'direct' AS kind FROM ctx a JOIN ctx b USING (member) WHERE a.level < 12 AND b.level >= 12",
    "p10_null_stores": f"WITH {CALLS} SELECT DISTINCT callee AS node FROM calls WHERE caller = 0",
    "p11_parameter_stores": f"WITH {CALLS} SELECT callee AS node FROM calls WHERE callee % 3 = 2 GROUP BY callee HAVING bool_or(caller % 3 = 0) AND bool_or(caller % 3 = 1)",
    "p14_uses": f"""
WITH {CALLS}, {FUNCTIONS}, e AS (SELECT min(caller) AS src, callee AS dst FROM calls WHERE caller < callee GROUP BY callee),
leaf AS (SELECT node, node % 2 = 0 AS load FROM functions WHERE node NOT IN (SELECT src FROM e)),
l AS (SELECT node, row_number() OVER (PARTITION BY coalesce(src, -node - 1) ORDER BY node) AS r FROM leaf LEFT JOIN e ON dst = node WHERE load)
SELECT node FROM l WHERE r = 1 UNION SELECT src FROM leaf JOIN e ON dst = node WHERE NOT load""",
    "p7_named_like": "SELECT DISTINCT p_name AS func FROM part WHERE contains(p_name, 'd wid') OR contains(p_name, 'gear')",
    "p9_api_functions": f"""
WITH RECURSIVE {CALLS}, own AS (SELECT p_partkey AS func FROM part WHERE contains(p_type, 'E') AND (p_size % 2 = 0 OR p_size % 3 = 0) AND p_size % 11 <> 0),
e AS (SELECT * FROM calls WHERE caller < callee),
w AS (SELECT func AS root, func FROM own UNION SELECT root, callee FROM w JOIN e ON caller = func)
SELECT func FROM own WHERE func NOT IN (SELECT func FROM w WHERE root <> func)""",
    "ra_context": f"""
WITH RECURSIVE {CALLS}, w AS (SELECT f AS func, 0 AS k FROM (VALUES (3::BIGINT), (4::BIGINT)) AS v(f) UNION SELECT callee, k + 1 FROM w JOIN calls ON caller = func WHERE k < 2)
SELECT DISTINCT func FROM w""",
    "x16_globals": f"""
WITH RECURSIVE {COPIES},
w AS (SELECT src, dst FROM copies UNION SELECT w.src, c.dst FROM w JOIN copies c ON c.src = w.dst)
SELECT DISTINCT src, dst FROM w""",
    "f15_strides": "SELECT p_partkey AS id, array_to_string([p_size, p_size + 10, p_size + 20], ',') AS offsets FROM part",
    "x12_call_kinds": f"WITH {CALLS} SELECT 'direct' AS kind, count(*) AS n FROM calls WHERE callee % 2 = 0 UNION ALL SELECT 'indirect', count(*) FROM calls WHERE callee % 3 = 0 UNION ALL SELECT 'fork', count(*) FROM calls WHERE callee % 5 = 0",
}
