"""Queries over further program facts from the driver's tables: checkers over sink paths, projections, graph building, context maps; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.operators import checkers, contexts, pointsto, projections, valueflow
from rillgraph.plans import lenses
from rillgraph.plans.lenses import CALLS, CONTEXTS, COPIES, FUNCTIONS, ITEMS, PSETS
from rillgraph.sources import readers


def _paths(s, d):
    """L1 as sink paths of straight functions: (paths, relation)."""
    i = lenses.items(s, d)
    func = F.col("source").cast("string")
    step = lambda node: F.struct(node.cast("long").alias("node"), func.alias("func"), F.lit("intra").alias("via"))
    paths = i.select("source", F.col("ord").cast("long").alias("path"), F.col("node").alias("sink"), "role", "field_ctx", F.array(step(F.lit(-1)), step(F.col("node"))).alias("steps"))
    paths = paths.filter("role in ('dealloc', 'use', 'null_store')")
    insts = i.select(F.col("node").alias("inst"), func.alias("func"), F.lit(0).cast("long").alias("bb"), "ord")
    none = s.createDataFrame([], "src long, dst long")
    return i, paths, checkers.related(paths, insts, none, s.createDataFrame([], "func string, a long, b long"))


def _found(s, d):
    i, paths, rel = _paths(s, d)
    return checkers.found(i.select("source"), paths, rel, ["double_free", "use_after_free", "leak"])


def _kinds(s, d):
    """Functions as types: pointers, structs, arrays and others by turns."""
    k = lenses.functions(s, d).select(F.col("node").alias("type"))
    kind = F.element_at(F.array(*map(F.lit, ("pointer", "struct", "array", "other"))), (F.col("type") % 4 + 1).cast("int"))
    return k.select("type", kind.alias("kind"), F.floor(F.col("type") / 2).alias("of"))


def _structured(s, d):
    fields = lenses.calls(s, d).select(F.col("caller").alias("type"), F.col("callee").alias("ix"), F.col("callee").alias("field_type"))
    return projections.structured_globals(lenses.functions(s, d).select("node", F.col("node").alias("type")), _kinds(s, d), fields.filter("type % 4 = 1")).select("node")


def _edges(s, d):
    kind = F.when(F.col("callee") % 2 == 0, "call").when(F.col("callee") % 3 == 0, "ret").otherwise("intra")
    return lenses.calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), kind.alias("kind"), (F.col("callee") % 4).cast("long").alias("cs"))


_EDGES = "e AS (SELECT caller AS src, callee AS dst, CASE WHEN callee % 2 = 0 THEN 'call' WHEN callee % 3 = 0 THEN 'ret' ELSE 'intra' END AS kind, callee % 4 AS cs FROM calls)"


def _locks(s, d):
    nodes = lenses.functions(s, d).select("node", F.when(F.col("node") % 3 == 0, "Addr").otherwise("Phi").alias("kind"), (F.col("node") % 4).cast("string").alias("func"))
    return valueflow.lock_objects(_edges(s, d), lenses.functions(s, d).filter("node % 25 = 0"), nodes, s.createDataFrame([("1",), ("2",)], "func string"))


def _connected(s, d):
    c = lenses.contexts(s, d)
    calls = c.select(F.col("context").alias("cs"), F.col("level").alias("func")).distinct()
    args = c.select(F.col("context").alias("cs"), (F.col("member") % 5).cast("int").alias("pos"), F.col("member").alias("node"))
    params = calls.select("func", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).distinct().withColumn("node", 10**9 + F.col("func") * 10 + F.col("pos"))
    rets = calls.select("func", (10**9 + F.col("func") * 10 + 9).alias("node")).distinct()
    return valueflow.connected(calls, args, params, rets, calls.select("cs", (2 * 10**9 + F.col("cs")).alias("node")))


def _phis(s, d):
    kinds = lenses.functions(s, d).select("node", F.element_at(F.array(*map(F.lit, ("Addr", "ActualParm", "FormalParm", "FormalRet", "ActualRet"))), (F.col("node") % 5 + 1).cast("int")).alias("kind"))
    e = _edges(s, d).filter("src % 5 in (0, 2, 4) and dst % 5 in (1, 3) or src % 5 in (1, 3) and dst % 5 in (0, 2, 4) or src % 5 = 0 and dst % 5 = 0").withColumn("obj", F.lit(None).cast("long"))
    return valueflow.with_phis(e, kinds)[0].drop("obj")


def _variables(s, d):
    """Copies as a constraint graph whose edges are in the function src % 50; variables are orders without a predecessor."""
    c = lenses.copies(s, d)
    # each order flows to its successor; the next number after every tenth does so too
    near = c.filter("src % 10 = 0").select((F.col("src") + 1).alias("src"), "dst")
    edges = c.unionByName(near).distinct().withColumn("func", (F.col("src") % 50).cast("string"))
    first = c.select(F.col("src").alias("var")).filter("var % 2 = 0").join(c.select(F.col("dst").alias("var")), "var", "left_anti")
    return edges, first


def _variable_functions(s, d):
    edges, first = _variables(s, d)
    return contexts.variable_functions(first, edges, edges.select(F.col("src").alias("node"), F.lit("x").alias("name")).limit(0))[0]


def _with_callers(s, d):
    c = lenses.calls(s, d)
    found = lenses.functions(s, d).filter("node % 7 = 0").select((F.col("node") % 5).alias("var"), F.col("node").alias("func"))
    return contexts.with_callers(found, c, lenses.functions(s, d).filter("node % 3 = 0").select(F.col("node").alias("func")))


def _refined(s, d):
    c = lenses.calls(s, d).withColumn("kind", F.when(F.col("callee") % 2 == 0, "direct").otherwise("indirect"))
    resolved = c.filter("kind = 'indirect' and callee % 3 = 0")
    roots = s.createDataFrame([(3,), (4,)], "func long")
    inside = lambda own: resolved.join(own.withColumnRenamed("func", "caller"), "caller", "left_semi").join(own.withColumnRenamed("func", "callee"), "callee", "left_semi")
    return contexts.refined(c, roots, 3, inside)


def _fields(s, d):
    """Copies of every third order move the address of its first part by 3."""
    c = lenses.copies(s, d)
    seed = lenses.addresses(s, d).select(F.col("ptr").alias("var"), "obj")
    return pointsto.propagate(seed, c.filter("src % 3 <> 0"), c.filter("src % 3 = 0").select("src", "dst", F.lit(3).alias("offset")))


def _effects(s, d):
    l = lenses.read(s, d, "lineitem").filter("l_linenumber <= 3").select("l_orderkey", "l_linenumber", "l_partkey").distinct()  # noqa: E741
    named = F.element_at(F.array(*map(F.lit, ("a", "b", "c", "d"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    calls = l.select(F.col("l_orderkey").alias("cs"), named.alias("name"), (F.col("l_linenumber") - 2).cast("int").alias("pos"), F.col("l_partkey").alias("node"))
    known = s.createDataFrame([("a", "copy_arg0"), ("b", "store_arg1"), ("c", "load_store"), ("d", "alloc")], "name string, effect string")
    got = pointsto.external_effects(calls, known)
    pairs = [got[k].toDF("a", "b").withColumn("effect", F.lit(k)) for k in ("copy", "store", "load_store", "addr")]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).unionByName(pairs[3]).distinct()


def _regions(s, d):
    p = lenses.psets(s, d).select(F.col("pset").alias("node"), (F.col("obj") % 20).alias("region"), (F.col("pset") % 5000).alias("version")).distinct()
    return valueflow.indirect_edges(p.filter("node % 3 = 0"), p.filter("node % 3 = 1"), p.select("region", (F.col("region") + 1000).alias("obj")).distinct()).drop("kind")


def _sources(s, d):
    nodes = lenses.functions(s, d).select("node", (F.col("node") % 4).cast("string").alias("func"), F.concat(F.when(F.col("node") % 5 == 0, "arg").otherwise("v"), F.col("node").cast("string")).alias("name"), (F.col("node") % 7 == 0).alias("is_param"))
    return projections.stack_sources(nodes, s.createDataFrame([("1",), ("2",)], "func string"), lenses.calls(s, d).select(F.col("caller").alias("src")), light=True)


def _places(s, d):
    locs = lenses.read(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file_name"), F.col("p_type").alias("func_name"), F.col("p_size").alias("line"), F.col("p_name").alias("var_name")).filter("line > 10")
    return projections.places(lenses.read(s, d, "part").select(F.col("p_partkey").alias("node")), locs)


def _objects(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("global", "heap", "stack"))), (F.col("p_size") % 3 + 1).cast("int"))
    o = lenses.read(s, d, "part").select(F.col("p_partkey").alias("obj"), kind.alias("kind"), (F.col("p_size") % 5 == 0).alias("is_dummy"), (F.col("p_size") % 7 == 0).alias("is_field"))
    wide, stack = projections.objects_of(o)
    return wide.select("obj", F.lit("wide").alias("part")).unionByName(stack.select("obj", F.lit("stack").alias("part")))


def _edge_functions(s, d):
    l = lenses.read(s, d, "lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_partkey").alias("inst"), F.when(F.col("l_suppkey") % 10 == 0, F.col("l_suppkey").cast("string")).alias("ext_callee")).distinct()  # noqa: E741
    return projections.edge_functions(l, lenses.read(s, d, "part").select(F.col("p_partkey").alias("inst"), F.col("p_brand").alias("func"))).groupBy("func").agg(F.count("*").alias("n"))


def _unknown(s, d):
    r = lenses.reports(s, d)
    place = [F.col("api_name").alias("file_name"), F.col("type").alias("func_name"), F.col("version").cast("long").alias("line")]
    known = r.filter("status = 'Positive'").select(F.col("api_name").alias("loc1_file"), F.col("type").alias("loc1_func"), F.col("version").cast("long").alias("loc1_line"))
    return readers.without_known(r.select(*place).distinct(), known)


def _external(s, d):
    c = lenses.contexts(s, d)
    sites = c.select(F.col("context").alias("cs"), F.when(F.col("context") % 3 == 0, "free.1").otherwise("other").alias("callee")).distinct()
    args = c.select(F.col("context").alias("cs"), (F.col("member") % 50).cast("int").alias("pos"), F.col("member").alias("ptr"))
    defs = lenses.addresses(s, d).select(F.col("ptr").alias("node"), F.col("obj").alias("ptr"))
    return valueflow.external_sinks(sites, s.createDataFrame([("free", "dealloc")], "name string, role string"), args, defs, 10**9)[1].select("src", "dst", "cs")


def _entry(s, d):
    pts = lenses.addresses(s, d).select(F.col("ptr").alias("var"), "obj")
    stores = lenses.read(s, d, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("ptr")).filter("node % 3 = 0")
    return valueflow.global_entry(stores, pts, lenses.contexts(s, d).filter("level = 0").select(F.col("context").alias("node"), F.col("member").alias("obj")))


QUERIES = {
    "c_sink_paths": _found,
    "p4_structured_globals": _structured,
    "p12_stack_sources": _sources,
    "p15_without_dereferences": lambda s, d: valueflow.without_dereferences(
        _edges(s, d).select("src", "dst", F.lit("direct").alias("kind")),
        lenses.calls(s, d).groupBy(F.col("callee").alias("node")).agg(F.min("caller").alias("ptr_def")).withColumn("kind", F.when(F.col("node") % 2 == 0, "Load").otherwise("Copy")),
    ),
    "p16_dereferenced_globals": lambda s, d: valueflow.dereferenced_globals(lenses.functions(s, d), lenses.calls(s, d).select(F.col("caller").alias("var"), F.col("callee").alias("obj")), lenses.functions(s, d).filter("node % 9 = 0").select(F.col("node").alias("obj"))),
    "p17_pointer_objects": lambda s, d: projections.pointer_objects(lenses.read(s, d, "part").select(F.col("p_partkey").alias("obj"), (F.col("p_size") % 5 == 0).alias("is_const"), (F.col("p_size") % 7 == 0).alias("is_blackhole"), (F.col("p_size") % 2 == 0).alias("has_pointer"))).select("obj"),
    "p18_places": _places,
    "p19_resolved_names": lambda s, d: projections.resolved_names(lenses.read(s, d, "part").select(F.col("p_name").alias("func")).distinct(), lenses.read(s, d, "part").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").cast("string").alias("target")).filter("target like '%7'")),
    "p21_objects": _objects,
    "p21_edge_functions": _edge_functions,
    "j4_field_points_to": _fields,
    "j7_external_effects": _effects,
    "j10_indirect_edges": _regions,
    "j12_global_entry": _entry,
    "j20_without_known": _unknown,
    "x18_variable_functions": _variable_functions,
    "x23_lock_objects": _locks,
    "g3_connected": lambda s, d: _connected(s, d).select("src", "dst", "kind", "cs"),
    "g5_phis": _phis,
    "g8_external_sinks": _external,
    "rb_refined": _refined,
    "rk_with_callers": _with_callers,
    "rl_group_members": lambda s, d: contexts.group_members(lenses.contexts(s, d).select("level", "context", (F.col("context") % 3).cast("int").alias("grp")).distinct(), contexts.replaced(lenses.contexts(s, d), lenses.contexts(s, d).filter("context % 10 = 0 and member % 2 = 0"))),
}

ORACLES = {
    "c_sink_paths": f"""
WITH {ITEMS},
free AS (
  SELECT DISTINCT a.source, 'double_free' AS rule, a.node AS sink1, b.node AS sink2 FROM items a JOIN items b ON a.source = b.source AND a.ord < b.ord
  WHERE a.role = 'dealloc' AND b.role = 'dealloc' AND NOT EXISTS (SELECT 1 FROM items k WHERE k.source = a.source AND k.role = 'null_store' AND k.ord > a.ord AND k.ord < b.ord)),
firsts AS (
  SELECT a.source, a.node AS sink1, (SELECT min(b.ord) FROM items b WHERE b.source = a.source AND b.ord > a.ord AND b.role = 'use') AS u,
    (SELECT min(k.ord) FROM items k WHERE k.source = a.source AND k.ord > a.ord AND k.role = 'null_store') AS stop FROM items a WHERE a.role = 'dealloc')
SELECT * FROM free
UNION ALL SELECT f.source, 'use_after_free', f.sink1, i.node FROM firsts f JOIN items i ON i.source = f.source AND i.ord = f.u WHERE f.stop IS NULL OR f.u < f.stop
UNION ALL SELECT source, 'leak', source, source FROM items GROUP BY source HAVING count(*) FILTER (role = 'dealloc') = 0""",
    "p4_structured_globals": f"""
WITH RECURSIVE {CALLS}, {FUNCTIONS}, t AS (SELECT node AS type, node % 4 AS kind, node // 2 AS of FROM functions),
f AS (SELECT caller AS type, callee AS ft, t.kind FROM calls JOIN t ON t.type = callee WHERE caller % 4 = 1),
first AS (SELECT type, min(ft) AS nested FROM f WHERE kind = 1 GROUP BY type),
h AS (SELECT DISTINCT type FROM f WHERE kind = 0 UNION SELECT first.type FROM h JOIN first ON nested = h.type)
SELECT node FROM functions WHERE node IN (SELECT type FROM h) OR node IN (SELECT a.type FROM t a JOIN t b ON b.type = a.of WHERE a.kind = 0 AND b.kind IN (1, 2))""",
    "p12_stack_sources": f"WITH {CALLS}, {FUNCTIONS} SELECT node FROM functions WHERE node % 4 IN (1, 2) AND node % 7 <> 0 AND node % 5 <> 0 AND node IN (SELECT caller FROM calls)",
    "p15_without_dereferences": f"WITH {CALLS}, n AS (SELECT callee AS node, min(caller) AS def FROM calls GROUP BY callee) SELECT caller AS src, callee AS dst, 'direct' AS kind FROM calls JOIN n ON node = callee WHERE NOT (callee % 2 = 0 AND def = caller)",
    "p16_dereferenced_globals": f"WITH {CALLS}, {FUNCTIONS} SELECT node FROM functions WHERE node % 9 = 0 OR node IN (SELECT caller FROM calls WHERE callee % 9 = 0)",
    "p17_pointer_objects": "SELECT p_partkey AS obj FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 2 = 0",
    "p18_places": """
SELECT p_partkey AS node, CASE WHEN p_size > 10 THEN p_brand ELSE 'Unknown' END AS file_name, CASE WHEN p_size > 10 THEN p_type ELSE 'Unknown' END AS func_name,
  CASE WHEN p_size > 10 THEN p_size ELSE 0 END AS line, CASE WHEN p_size > 10 THEN p_name ELSE 'no Name' END AS var_name FROM part""",
    "p19_resolved_names": "SELECT p_name AS func, CASE WHEN CAST(min(p_partkey) AS VARCHAR) LIKE '%7' THEN CAST(min(p_partkey) AS VARCHAR) ELSE p_name END AS target FROM part GROUP BY p_name",
    "p21_objects": "SELECT p_partkey AS obj, CASE WHEN p_size % 3 = 2 THEN 'stack' ELSE 'wide' END AS part FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0",
    "p21_edge_functions": """
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, CASE WHEN l_suppkey % 10 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS ext FROM lineitem)
SELECT coalesce(ext, p_brand) AS func, count(*) AS n FROM e LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "j4_field_points_to": f"""
WITH RECURSIVE {COPIES},
pts AS (SELECT ptr AS var, obj, 0::BIGINT AS off FROM addr UNION SELECT dst, obj, CASE WHEN src % 3 = 0 THEN (off + 3) % 16384 ELSE off END FROM pts JOIN copies ON var = src)
SELECT DISTINCT var, obj + off * 281474976710656 AS obj FROM pts""",
    "j7_external_effects": """
WITH c AS (SELECT DISTINCT l_orderkey AS cs, l_linenumber - 2 AS pos, l_partkey AS node, l_orderkey % 4 AS k FROM lineitem WHERE l_linenumber <= 3)
SELECT DISTINCT a.node AS a, r.node AS b, 'copy' AS effect FROM c a JOIN c r USING (cs) WHERE a.k = 0 AND a.pos = 0 AND r.pos = -1
UNION SELECT b.node, a.node, 'store' FROM c a JOIN c b USING (cs) WHERE a.k = 1 AND a.pos = 0 AND b.pos = 1
UNION SELECT b.node, a.node, 'load_store' FROM c a JOIN c b USING (cs) WHERE a.k = 2 AND a.pos = 0 AND b.pos = 1
UNION SELECT cs, node, 'addr' FROM c WHERE k = 3 AND pos = -1""",
    "j10_indirect_edges": f"""
WITH {PSETS}, p AS (SELECT DISTINCT pset AS node, obj % 20 AS region, pset % 5000 AS version FROM psets)
SELECT DISTINCT a.node AS src, b.node AS dst, region + 1000 AS obj FROM p a JOIN p b USING (region, version) WHERE a.node % 3 = 0 AND b.node % 3 = 1""",
    "j12_global_entry": f"""
WITH {CONTEXTS}, addr AS (SELECT DISTINCT l_partkey AS obj, l_orderkey AS ptr FROM lineitem WHERE l_linenumber = 1)
SELECT DISTINCT o_custkey AS src, context AS dst, 'indirect' AS kind, obj FROM orders JOIN addr ON ptr = o_orderkey JOIN ctx ON member = obj WHERE level = 0 AND o_custkey % 3 = 0""",
    "j20_without_known": f"""
WITH {lenses.REPORTS} SELECT DISTINCT api_name AS file_name, type AS func_name, CAST(version AS BIGINT) AS line FROM reports r
WHERE NOT EXISTS (SELECT 1 FROM reports k WHERE k.status = 'Positive' AND k.api_name = r.api_name AND k.type = r.type AND k.version = r.version)""",
    "x18_variable_functions": f"""
WITH RECURSIVE {COPIES}, e AS (SELECT src, dst FROM copies UNION SELECT src + 1, dst FROM copies WHERE src % 10 = 0),
v AS (SELECT src AS var FROM copies WHERE src % 2 = 0 AND src NOT IN (SELECT dst FROM copies)),
r AS (SELECT var, var AS node FROM v UNION SELECT var, dst FROM r JOIN e ON src = node),
o AS (SELECT DISTINCT r.var, e.src AS node FROM r JOIN e ON e.dst = r.node WHERE r.node <> r.var AND NOT EXISTS (SELECT 1 FROM r x WHERE x.var = r.var AND x.node = e.src)),
b AS (SELECT var, node FROM o UNION SELECT var, src FROM b JOIN e ON dst = node)
SELECT DISTINCT var, CAST(src % 50 AS VARCHAR) AS func FROM r JOIN e ON src = node UNION SELECT var, CAST(src % 50 AS VARCHAR) FROM b JOIN e ON dst = node""",
    "x23_lock_objects": f"""
WITH RECURSIVE {CALLS}, {FUNCTIONS}, {_EDGES},
w AS (
  SELECT node AS source, node, []::BIGINT[] AS ctx FROM functions WHERE node % 25 = 0
  UNION
  SELECT source, src, CASE kind WHEN 'ret' THEN list_append(CASE WHEN len(ctx) < 3 THEN ctx ELSE ctx[2:3] END, cs) WHEN 'call' THEN ctx[1:len(ctx) - 1] ELSE ctx END FROM w JOIN e ON w.node = e.dst
  WHERE kind <> 'call' OR len(ctx) = 0 OR ctx[len(ctx)] = cs)
SELECT DISTINCT node FROM w WHERE node % 3 = 0 AND node % 4 IN (1, 2) AND node IN (SELECT node FROM functions)""",
    "g3_connected": f"""
WITH {CONTEXTS}
SELECT DISTINCT member AS src, 1000000000 + level * 10 + member % 5 AS dst, 'call' AS kind, context AS cs FROM ctx WHERE member % 5 < 2
UNION SELECT 1000000000 + level * 10 + 9, 2000000000 + context, 'ret', context FROM ctx""",
    "g5_phis": f"""
WITH {CALLS}, {_EDGES},
k AS (SELECT *, src % 5 IN (1, 3) AS a, dst % 5 IN (1, 3) AS b FROM e),
u AS (SELECT * FROM k WHERE (NOT a AND b) OR (a AND NOT b) OR (src % 5 = 0 AND dst % 5 = 0))
SELECT src, dst, kind, cs FROM u WHERE NOT a AND NOT b UNION SELECT x.src, y.dst, y.kind, y.cs FROM u x JOIN u y ON x.dst = y.src WHERE x.b""",
    "g8_external_sinks": f"""
WITH {CONTEXTS}, addr AS (SELECT DISTINCT l_partkey AS obj, l_orderkey AS ptr FROM lineitem WHERE l_linenumber = 1)
SELECT DISTINCT ptr AS src, 1000000000 + context AS dst, context AS cs FROM ctx JOIN addr ON obj = member WHERE context % 3 = 0 AND member % 50 = 0""",
    "rb_refined": f"""
WITH RECURSIVE {CALLS},
w AS (SELECT f AS root, f AS func, 0 AS k FROM (VALUES (3::BIGINT), (4::BIGINT)) AS v(f) UNION SELECT root, callee, k + 1 FROM w JOIN calls ON caller = func WHERE k < 3),
own AS (SELECT DISTINCT func FROM w),
finer AS (SELECT caller, callee FROM calls WHERE caller IN (SELECT func FROM own) AND callee IN (SELECT func FROM own) AND (callee % 2 = 0 OR callee % 3 = 0)),
x AS (SELECT f AS root, f AS func, 0 AS k FROM (VALUES (3::BIGINT), (4::BIGINT)) AS v(f) UNION SELECT root, callee, k + 1 FROM x JOIN finer ON caller = func WHERE k < 3)
SELECT DISTINCT root, func FROM x""",
    "rk_with_callers": f"""
WITH RECURSIVE {CALLS}, {FUNCTIONS}, f AS (SELECT node % 5 AS var, node AS func FROM functions WHERE node % 7 = 0),
w AS (SELECT func AS root, func FROM f UNION SELECT root, caller FROM w JOIN calls ON callee = func WHERE func % 3 <> 0)
SELECT DISTINCT var, w.func FROM f JOIN w ON root = f.func""",
    "rl_group_members": f"WITH {CONTEXTS} SELECT DISTINCT level, CAST(context % 3 AS INT) AS grp, member FROM ctx WHERE context % 10 <> 0 OR member % 2 = 0",
}
