"""Pointer, region, reachability and context queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.operators import callgraph, contexts, fixpoint, guards, pointsto, reach, regions, typestate
from rillgraph.plans import lenses
from rillgraph.plans.lenses import CALLS, CONTEXTS, PSETS


def _pointer_facts(s, d):
    """Orders are pointers to cells of their customer; those with a second line load, those with a third store through them."""
    copy = lenses.copies(s, d)
    line = lenses.read(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    addr = lenses.cells(s, d)
    some = lambda n: line.filter(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("src")).distinct().join(copy, "src").select("src", "dst")
    return addr, copy, some(2), some(3)


def _andersen(s, d):
    return pointsto.andersen(*_pointer_facts(s, d))[0]


def _alias(s, d):
    """Pairs of consecutive orders that share a part, transitively along copies."""
    copy = lenses.copies(s, d)
    seed = lenses.addresses(s, d).select(F.col("ptr").alias("var"), "obj")
    pts = pointsto.propagate(seed, copy)
    return pointsto.aliases(copy.select(F.col("src").alias("a"), F.col("dst").alias("b")), pts)


def _flow_edges(s, d):
    """L2 as a value-flow graph: calls of even functions open a site, those of functions divisible by 3 return to one."""
    kind = F.when(F.col("callee") % 2 == 0, "call").when(F.col("callee") % 3 == 0, "ret").otherwise("intra")
    return lenses.calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), kind.alias("kind"), (F.col("callee") % 4).cast("long").alias("cs"))


def _cfl(s, d):
    found = reach.forward(_flow_edges(s, d), s.createDataFrame([(0,), (1,)], "node long"))
    return found.select("source", "node", F.array_join(F.transform("ctx", lambda x: x.cast("string")), ",").alias("ctx"))


def _paths(s, d):
    edges = lenses.calls(s, d).filter("caller < callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.when(F.col("callee") % 2 == 0, F.col("callee") % 5).alias("offset"))
    first = edges.select(F.col("src").alias("source"), F.col("dst").alias("mid"))
    pairs = first.join(edges.select(F.col("src").alias("mid"), F.col("dst").alias("sink")), "mid").select("source", "sink").distinct()
    found = reach.backward_paths(edges, pairs, max_edges=4, max_paths=20)
    return found.select("source", "sink", "path_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _edges(s, d):
    return lenses.calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).filter("src <> dst")


def _api(s, d, context=0):
    return lenses.contexts(s, d).filter(F.col("context") == context).select("member")


def _rare(s, d):
    """Members of context 0 of which it has 100 pieces or more: few, so that there are contexts with none of them."""
    l = lenses.read(s, d, "lineitem").filter("l_suppkey = 0")  # noqa: E741
    return l.groupBy(F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("n")).filter("n >= 100").select("member")


_RARE = "rare AS (SELECT l_partkey AS member FROM lineitem WHERE l_suppkey = 0 GROUP BY 1 HAVING sum(l_quantity) >= 100)"


def _guarded(s, d):
    """Segments of L1 as slices: each release hangs on a condition of its own item."""
    i = lenses.items(s, d).filter("role = 'dealloc'")
    edges = i.select("source", F.col("source").alias("src"), (F.col("node") + 10**9).alias("dst"), (F.col("node") % 3).alias("v"), (F.col("node") % 2 == 0).alias("positive"))
    return guards.slice_verdicts(edges, i.select("source", (F.col("node") + 10**9).alias("node")))


def _mod_ref(s, d):
    c = lenses.calls(s, d)
    local = lenses.contexts(s, d).select(F.col("context").alias("func"), (F.col("member") % 50).alias("obj"), F.when(F.col("member") % 20 == 0, "mod").otherwise("ref").alias("effect")).distinct()
    return regions.mod_ref(local, c.withColumn("cs", F.lit(0)), globals_=local.filter("obj % 20 = 0").select("obj").distinct())


def _dominators(s, d):
    e = _edges(s, d).filter("src < dst").withColumn("func", F.lit(0))
    entry = s.createDataFrame([(0, 0)], "func int, bb long")
    return reach.dominators(e, entry).select("a", "b")


QUERIES = {
    "x5_andersen": _andersen,
    "j17_alias": _alias,
    "x7_scc": lambda s, d: reach.components(_edges(s, d)),
    "o1_levels": lambda s, d: reach.levels(_edges(s, d).filter("src < dst")),
    "x11_reachable": lambda s, d: fixpoint.closure(_edges(s, d), s.createDataFrame([(0,), (7,)], "src long")),
    "x24_matched_slice": _cfl,
    "x25_backward_paths": _paths,
    "x26_verified": lambda s, d: reach.verified(_edges(s, d).select(F.col("src").alias("source"), (F.col("dst") + 1).alias("sink")), _edges(s, d).filter("src < dst")),
    "x31_dominators": _dominators,
    "x27_guarded_release": _guarded,
    "x22_mod_ref": _mod_ref,
    "rr_disjoint_regions": lambda s, d: regions.disjoint_regions(lenses.psets(s, d)),
    "rr_distinct_regions": lambda s, d: regions.distinct_regions(lenses.psets(s, d)).select("region", F.array_join(F.transform("objs", lambda x: x.cast("string")), ",").alias("objs")),
    "rr_superset_regions": lambda s, d: regions.superset_regions(lenses.psets(s, d)),
    "rs_alias_regions": lambda s, d: regions.regions_of(regions.disjoint_regions(lenses.psets(s, d)), lenses.psets(s, d)),
    "j13_relevant": lambda s, d: contexts.relevant(lenses.contexts(s, d).filter("context > 0"), _rare(s, d)),
    "j13_irrelevant": lambda s, d: contexts.irrelevant(lenses.contexts(s, d).filter("context > 0"), _rare(s, d)),
    "j14_restricted": lambda s, d: contexts.restricted(lenses.psets(s, d).select((F.col("pset") % 5).alias("var"), F.col("obj").alias("member")).distinct(), lenses.contexts(s, d)),
    "rj_undefined_below": lambda s, d: contexts.undefined_below(lenses.contexts(s, d).filter("member % 2 = 0"), lenses.contexts(s, d).filter("member % 3 = 0").select("level", "member")),
    "rm_totals": lambda s, d: contexts.totals(lenses.contexts(s, d)),
    "rn_level_map": lambda s, d: contexts.level_map(lenses.contexts(s, d)),
    "ro_merged": lambda s, d: contexts.merged(_api(s, d), lenses.contexts(s, d), contexts.relevant(lenses.contexts(s, d).filter("context > 0"), _rare(s, d)), [10**9]),
    "rp_reduction": lambda s, d: contexts.reduction(lenses.contexts(s, d), lenses.contexts(s, d).join(_api(s, d), "member", "left_semi")),
    "rg_grouped": lambda s, d: contexts.grouped(lenses.contexts(s, d), 1500),
    "rd_reduced": lambda s, d: contexts.reduced(lenses.calls(s, d), s.createDataFrame([(0,), (1,)], "func long"), 30, 6),
    "e1_union": lambda s, d: _api(s, d, 0).unionByName(_api(s, d, 1)).distinct(),
    "e2_intersect": lambda s, d: _api(s, d, 0).intersect(_api(s, d, 1)),
    "e3_difference": lambda s, d: _api(s, d, 0).subtract(_api(s, d, 1)),
    "a7_degrees": lambda s, d: callgraph.degrees(lenses.calls(s, d)),
    "a4_set_sizes": lambda s, d: lenses.psets(s, d).groupBy("pset").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sets")),
    "c8_partial_leaks": lambda s, d: typestate.partial_leaks(lenses.items(s, d), _guarded(s, d).filter("all_paths").select("source")),
}

_REACH = f"""{CALLS}, e AS (SELECT caller AS src, callee AS dst FROM calls WHERE caller <> callee)"""

#: Each source's literals v(node % 3), negated for odd nodes: the disjunction of them, spelled over the variables that matter.
_VERDICTS = """
lit AS (SELECT DISTINCT source, node % 3 AS v, node % 2 = 0 AS yes FROM items WHERE role = 'dealloc'),
sure AS (SELECT source, bool_or(n = 2) AS all_paths FROM (SELECT source, v, count(*) AS n FROM lit GROUP BY 1, 2) GROUP BY source),
vars AS (SELECT source, list(v ORDER BY v) AS vs, list(yes ORDER BY v) AS ys FROM lit JOIN sure USING (source) WHERE NOT all_paths GROUP BY source),
terms AS (
  SELECT source, k, list_reduce(list_transform(range(1, len(vs) + 1), lambda j: (CASE WHEN (k >> CAST(j - 1 AS INT)) & 1 = 1 THEN '' ELSE '!' END) || 'v' || CAST(vs[j] AS VARCHAR)), lambda x, y: x || '&' || y) AS term,
    len(list_filter(range(1, len(vs) + 1), lambda j: ((k >> CAST(j - 1 AS INT)) & 1 = 1) = ys[j])) > 0 AS holds
  FROM (SELECT *, unnest(range(0, 1 << CAST(len(vs) AS INT))) AS k FROM vars)),
spelled AS (SELECT source, string_agg(term, '|' ORDER BY k) AS guard FROM terms WHERE holds GROUP BY source),
many AS (SELECT source, count(*) AS n, count(DISTINCT node) AS nodes FROM items WHERE role = 'dealloc' GROUP BY source),
meet AS (SELECT a.source FROM items a JOIN items b ON a.source = b.source AND a.node < b.node WHERE a.role = 'dealloc' AND b.role = 'dealloc' AND NOT (a.node % 3 = b.node % 3 AND a.node % 2 <> b.node % 2) GROUP BY 1),
verdicts AS (
  SELECT s.source, CASE WHEN all_paths THEN 'true' ELSE guard END AS guard, all_paths, TRUE AS some_path, s.source IN (SELECT source FROM meet) AS pair
  FROM sure s LEFT JOIN spelled USING (source))"""

ORACLES = {
    "x27_guarded_release": f"WITH {lenses.ITEMS}, {_VERDICTS} SELECT * FROM verdicts",
    "c8_partial_leaks": f"WITH {lenses.ITEMS}, {_VERDICTS} SELECT source FROM verdicts WHERE NOT all_paths",
    "j17_alias": """
WITH RECURSIVE copies AS (
  SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL),
addr AS (SELECT DISTINCT l_partkey AS obj, l_orderkey AS ptr FROM lineitem WHERE l_linenumber = 1),
pts AS (SELECT ptr AS var, obj FROM addr UNION SELECT dst, obj FROM pts JOIN copies ON var = src)
SELECT DISTINCT c.src AS a, c.dst AS b FROM copies c JOIN pts p ON p.var = c.src JOIN pts q ON q.var = c.dst AND p.obj = q.obj""",
    "x7_scc": f"""
WITH RECURSIVE {_REACH},
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
back AS (SELECT a.src AS node, min(a.dst) AS m FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT n.node, least(n.node, coalesce(m, n.node)) AS rep FROM n LEFT JOIN back USING (node)""",
    "o1_levels": f"""
WITH RECURSIVE {_REACH},
d AS (SELECT src, dst FROM e WHERE src < dst),
w AS (SELECT src AS node, 0 AS level FROM d UNION SELECT d.dst, level + 1 FROM w JOIN d ON w.node = d.src)
SELECT node, max(level) AS level FROM w GROUP BY node""",
    "x11_reachable": f"""
WITH RECURSIVE {_REACH},
r AS (SELECT src, dst FROM e WHERE src IN (0, 7) UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT DISTINCT src, dst FROM r""",
    "x24_matched_slice": f"""
WITH RECURSIVE {CALLS},
e AS (SELECT caller AS src, callee AS dst, CASE WHEN callee % 2 = 0 THEN 'call' WHEN callee % 3 = 0 THEN 'ret' ELSE 'intra' END AS kind, callee % 4 AS cs FROM calls),
w AS (
  SELECT s AS source, s AS node, []::BIGINT[] AS ctx FROM (VALUES (0::BIGINT), (1::BIGINT)) AS v(s)
  UNION
  SELECT source, dst, CASE kind WHEN 'call' THEN list_append(ctx, cs) WHEN 'ret' THEN ctx[1:len(ctx) - 1] ELSE ctx END FROM w JOIN e ON w.node = e.src
  WHERE kind = 'intra' OR (kind = 'ret' AND (len(ctx) = 0 OR ctx[len(ctx)] = cs)) OR (kind = 'call' AND len(ctx) < 3))
SELECT DISTINCT source, node, array_to_string(ctx, ',') AS ctx FROM w""",
    "x25_backward_paths": f"""
WITH RECURSIVE {CALLS},
e AS (SELECT caller AS src, callee AS dst FROM calls WHERE caller < callee),
w AS (
  SELECT DISTINCT a.src AS source, b.dst AS sink, b.dst AS cur, [b.dst] AS path FROM e a JOIN e b ON a.dst = b.src
  UNION
  SELECT source, sink, e.src, list_prepend(e.src, path) FROM w JOIN e ON w.cur = e.dst WHERE cur <> source AND len(path) <= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY source, sink ORDER BY len(path), path) - 1 AS path_id FROM w WHERE cur = source)
SELECT source, sink, path_id::INT AS path_id, array_to_string(path, '>') AS path FROM r WHERE path_id <= 20""",
    "x26_verified": f"""
WITH RECURSIVE {_REACH},
r AS (SELECT src, dst FROM e WHERE src < dst UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src AND e.src < e.dst)
SELECT p.source, p.sink FROM (SELECT src AS source, dst + 1 AS sink FROM e) p
WHERE EXISTS (SELECT 1 FROM r WHERE r.src = p.source AND r.dst = p.sink)""",
    "x31_dominators": f"""
WITH RECURSIVE {_REACH},
d AS (SELECT src, dst FROM e WHERE src < dst),
b AS (SELECT 0::BIGINT AS n UNION SELECT dst FROM b JOIN d ON b.n = d.src),
around AS (SELECT a.n AS a, 0::BIGINT AS n FROM b a WHERE a.n <> 0 UNION SELECT a, d.dst FROM around JOIN d ON around.n = d.src WHERE d.dst <> a)
SELECT a.n AS a, b.n AS b FROM b a, b b WHERE NOT EXISTS (SELECT 1 FROM around r WHERE r.a = a.n AND r.n = b.n)""",
    "x22_mod_ref": f"""
WITH RECURSIVE {CALLS}, {CONTEXTS},
own AS (SELECT DISTINCT context AS func, member % 50 AS obj, CASE WHEN member % 20 = 0 THEN 'mod' ELSE 'ref' END AS effect FROM ctx),
base AS (SELECT * FROM own UNION SELECT func, obj, 'ref' FROM own WHERE effect = 'mod'),
w AS (SELECT * FROM base UNION SELECT c.caller, w.obj, w.effect FROM w JOIN calls c ON w.func = c.callee WHERE w.obj IN (SELECT obj FROM own WHERE obj % 20 = 0))
SELECT DISTINCT func, obj, effect FROM w""",
    "rr_disjoint_regions": f"""
WITH {PSETS}, sig AS (SELECT obj, list(pset ORDER BY pset) AS s FROM psets GROUP BY obj)
SELECT min(obj) OVER (PARTITION BY s) AS region, obj FROM sig""",
    "rr_distinct_regions": f"""
WITH {PSETS}, sig AS (SELECT pset, list(obj ORDER BY obj) AS s FROM psets GROUP BY pset)
SELECT min(pset) AS region, array_to_string(s, ',') AS objs FROM sig GROUP BY s""",
    "rr_superset_regions": f"""
WITH {PSETS}, p AS (SELECT * FROM psets), n AS (SELECT pset, count(*) AS n FROM p GROUP BY pset),
c AS (SELECT a.pset, b.pset AS other, count(*) AS k FROM p a JOIN p b ON a.obj = b.obj GROUP BY 1, 2),
o AS (SELECT c.pset, c.other, m.n AS m, row_number() OVER (PARTITION BY c.pset ORDER BY m.n DESC, c.other) AS r FROM c JOIN n ON n.pset = c.pset AND n.n = c.k JOIN n m ON m.pset = c.other)
SELECT pset, other AS rep FROM o WHERE r = 1""",
    "rs_alias_regions": f"""
WITH {PSETS}, sig AS (SELECT obj, list(pset ORDER BY pset) AS s FROM psets GROUP BY obj),
reg AS (SELECT min(obj) OVER (PARTITION BY s) AS region, obj FROM sig),
n AS (SELECT region, count(*) AS n FROM reg GROUP BY region),
k AS (SELECT pset, region, count(*) AS k FROM psets JOIN reg USING (obj) GROUP BY 1, 2)
SELECT pset, region FROM k JOIN n USING (region) WHERE k = n""",
    "j13_relevant": f"WITH {CONTEXTS}, {_RARE} SELECT DISTINCT context FROM ctx WHERE context > 0 AND member IN (SELECT member FROM rare)",
    "j13_irrelevant": f"WITH {CONTEXTS}, {_RARE} SELECT DISTINCT context FROM ctx WHERE context > 0 EXCEPT SELECT context FROM ctx WHERE member IN (SELECT member FROM rare)",
    "j14_restricted": f"WITH {CONTEXTS}, {PSETS} SELECT DISTINCT pset % 5 AS var, context, member FROM psets JOIN ctx ON obj = member",
    "rj_undefined_below": f"""
WITH {CONTEXTS}
SELECT context, level, member FROM ctx u WHERE member % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ctx d WHERE d.member = u.member AND d.member % 3 = 0 AND d.level < u.level)""",
    "rm_totals": f"WITH {CONTEXTS} SELECT count(DISTINCT context) AS contexts, count(DISTINCT member) AS members, max(level) AS top_level FROM ctx",
    "rn_level_map": f"""
WITH {CONTEXTS}, one AS (SELECT DISTINCT level, context FROM ctx)
SELECT level, count(*) AS contexts, string_agg(CAST(context AS VARCHAR), ',' ORDER BY context) AS names FROM one GROUP BY level""",
    "ro_merged": f"""
WITH {CONTEXTS}, {_RARE}
SELECT member FROM ctx WHERE context = 0 UNION SELECT 1000000000 UNION
SELECT member FROM ctx WHERE context IN (SELECT context FROM ctx WHERE context > 0 AND member IN (SELECT member FROM rare))""",
    "rp_reduction": f"""
WITH {CONTEXTS}
SELECT context, count(*) AS original, count(*) FILTER (member IN (SELECT member FROM ctx WHERE context = 0)) AS relevant FROM ctx GROUP BY context""",
    "rd_reduced": f"""
WITH RECURSIVE {CALLS},
walk AS (SELECT f AS root, f AS func, 0 AS depth FROM (VALUES (0::BIGINT), (1::BIGINT)) AS v(f) UNION SELECT root, callee, depth + 1 FROM walk JOIN calls ON func = caller WHERE depth < 6),
sliced AS (SELECT root, func, min(depth) AS depth FROM walk GROUP BY root, func),
upto AS (SELECT DISTINCT root, depth, count(*) OVER (PARTITION BY root ORDER BY depth) AS n FROM sliced),
best AS (SELECT root, max(depth) AS depth FROM upto WHERE n < 30 GROUP BY root)
SELECT s.root, s.func FROM sliced s JOIN best b ON s.root = b.root AND s.depth <= b.depth""",
    "e1_union": f"WITH {CONTEXTS} SELECT DISTINCT member FROM ctx WHERE context IN (0, 1)",
    "e2_intersect": f"WITH {CONTEXTS} SELECT member FROM ctx WHERE context = 0 INTERSECT SELECT member FROM ctx WHERE context = 1",
    "e3_difference": f"WITH {CONTEXTS} SELECT member FROM ctx WHERE context = 0 EXCEPT SELECT member FROM ctx WHERE context = 1",
    "a7_degrees": f"WITH {CALLS}, d AS (SELECT caller, count(*) AS n FROM calls GROUP BY caller) SELECT max(n) AS top, round(avg(n), 6) AS mean, count(*) AS nodes FROM d",
    "a4_set_sizes": f"WITH {PSETS}, d AS (SELECT pset, count(*) AS n FROM psets GROUP BY pset) SELECT n, count(*) AS sets FROM d GROUP BY n",
}
