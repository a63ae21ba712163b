"""Reachability with contexts and paths, dominance, strongly connected components and topological levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators import small
from rillgraph.operators.fixpoint import closure, fixpoint
from rillgraph.sources.shared import materialise

CONTEXT, PATH, PATHS, FIELDS = 3, 25, 100, 5


def push(ctx: Column, site: Column, limit: int = CONTEXT) -> Column:
    """The call string with the site behind it; at the limit the oldest site goes."""
    return F.when(F.size(ctx) < limit, F.array_append(ctx, site)).otherwise(F.array_append(F.slice(ctx, 2, limit - 1), site))


def matches(ctx: Column, site: Column) -> Column:
    """Whether a return to the site fits the call string: an empty one fits any."""
    return (F.size(ctx) == 0) | (F.element_at(ctx, -1) == site)


def pop(ctx: Column) -> Column:
    """The call string without its last site."""
    return F.when(F.size(ctx) == 0, ctx).otherwise(F.slice(ctx, 1, F.size(ctx) - 1))


def forward(edges: DataFrame, sources: DataFrame, sinks: DataFrame | None = None, limit: int = CONTEXT, truncate: bool = False) -> DataFrame:
    """(source, node, ctx) that each source (column node) reaches over edges (src, dst, kind in intra, call, ret; cs) in matched contexts.

    A call beyond the limit drops the item, or, with truncate, the oldest site. Sinks (column node) are reached but not passed.
    """
    e = materialise(edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), "kind", "cs").distinct(), "edges")
    seed = sources.select(F.col("node").alias("source"), "node", F.array().cast("array<bigint>").alias("ctx")).distinct()

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        if sinks is not None:
            passed = sinks.select("node").distinct()
            new = new.filter("source = node").unionByName(new.filter("source <> node").join(passed, "node", "left_anti").select(*new.columns))
        hop = new.join(e, new["node"] == e["__s"])
        fits = (F.col("kind") == "intra") | ((F.col("kind") == "ret") & matches(F.col("ctx"), F.col("cs")))
        fits = fits | ((F.col("kind") == "call") & ((F.size("ctx") < limit) | F.lit(truncate)))
        then = F.when(F.col("kind") == "call", push(F.col("ctx"), F.col("cs"), limit)).when(F.col("kind") == "ret", pop(F.col("ctx"))).otherwise(F.col("ctx"))
        return hop.filter(fits).select("source", F.col("__d").alias("node"), then.alias("ctx"))

    return fixpoint(seed, step, label="forward")


def reached(edges: DataFrame, sources: DataFrame, limit: int = CONTEXT) -> DataFrame:
    """(node) that any of the sources (column node) reaches, as by forward() with truncate, in one search for all of them: what lies ahead of a node and a call string
    does not depend on the source, so rows grow with the nodes, not with sources times nodes.

    A call string that ends in another one of the node's fits no more returns than that one, before and after any edge, so only the shorter goes on.
    """
    e = materialise(edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), "kind", "cs").filter("kind in ('intra', 'call', 'ret')").distinct(), "edges")
    seed = sources.select("node", F.array().cast("array<bigint>").alias("ctx")).distinct()

    def step(new: DataFrame, full: DataFrame) -> DataFrame:
        hop = new.join(e, new["node"] == e["__s"])
        fits = (F.col("kind") != "ret") | matches(F.col("ctx"), F.col("cs"))
        then = F.when(F.col("kind") == "call", push(F.col("ctx"), F.col("cs"), limit)).when(F.col("kind") == "ret", pop(F.col("ctx"))).otherwise(F.col("ctx"))
        found = hop.filter(fits).select(F.col("__d").alias("node"), then.alias("ctx")).distinct()
        shorter = F.filter("all", lambda x: (F.size(x) < F.size("ctx")) & (F.slice(F.col("ctx"), F.size("ctx") - F.size(x) + 1, F.size(x)) == x))
        known = full.unionByName(found).groupBy("node").agg(F.collect_set("ctx").alias("all"))
        return found.join(known, "node").filter(F.size(shorter) == 0).select("node", "ctx")

    return fixpoint(seed, step, label="reached").select("node").distinct()


def backward_paths(edges: DataFrame, pairs: DataFrame, within: DataFrame | None = None, max_edges: int = PATH, max_paths: int = PATHS) -> DataFrame:
    """(source, sink, path_id, path, field_ctx): simple paths from pairs' sinks back to their sources, numbered by length and order of nodes.

    Edges (src, dst, offset): an offset joins the field context, of which the last FIELDS stay. within (source, node): where to search; what no
    source reaches is never entered. Reported are paths of at most max_edges edges, the first max_paths + 1 of each pair; path_counts() says how
    many there are.
    """
    found = _backward(edges, pairs, within, max_edges)
    order = Window.partitionBy("source", "sink").orderBy(F.size("path"), "path", "field_ctx")
    return found.withColumn("path_id", F.row_number().over(order) - 1).filter(F.col("path_id") <= max_paths)


def path_counts(edges: DataFrame, pairs: DataFrame, within: DataFrame | None = None, max_edges: int = PATH, max_paths: int = PATHS) -> DataFrame:
    """(source, sink, paths, cut): how many paths of at most max_edges edges each pair has, and whether backward_paths() leaves some out."""
    n = _backward(edges, pairs, within, max_edges).groupBy("source", "sink").agg(F.count("*").alias("paths"))
    return n.withColumn("cut", F.col("paths") > max_paths + 1)


def _backward(edges: DataFrame, pairs: DataFrame, within: DataFrame | None, max_edges: int) -> DataFrame:
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("offset").alias("__o")).distinct()
    seed = pairs.select("source", "sink", F.col("sink").alias("cur"), F.array("sink").alias("path"), F.array().cast("array<bigint>").alias("field_ctx")).distinct()
    ahead = closure(edges, pairs.select(F.col("source").alias("src"))).unionByName(pairs.select(F.col("source").alias("src"), F.col("source").alias("dst"))).distinct()
    near = ahead.select(F.col("src").alias("__w"), F.col("dst").alias("__n"))
    if within is not None:
        near = near.join(within.select(F.col("source").alias("__w"), F.col("node").alias("__n")).distinct(), ["__w", "__n"], "left_semi")
    near = materialise(near, "near")

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        hop = new.filter((F.col("cur") != F.col("source")) & (F.size("path") <= max_edges)).join(e, new["cur"] == e["__d"])
        hop = hop.filter(~F.array_contains("path", F.col("__s")))
        hop = hop.join(near, (F.col("source") == F.col("__w")) & (F.col("__s") == F.col("__n")), "left_semi")
        grown = F.when(F.col("__o").isNull(), F.col("field_ctx")).otherwise(F.slice(F.array_append("field_ctx", F.col("__o")), F.greatest(F.lit(1), F.size("field_ctx") + 2 - FIELDS), FIELDS))
        return hop.select("source", "sink", F.col("__s").alias("cur"), F.concat(F.array("__s"), "path").alias("path"), grown.alias("field_ctx"))

    return fixpoint(seed, step, label="paths").filter("cur = source").drop("cur")


def verified(pairs: DataFrame, edges: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Those pairs (source, sink) whose source reaches the sink over edges (src, dst); sinks of exempt (column sink) pass."""
    found = closure(edges, pairs.select(F.col("source").alias("src")))
    real = pairs.join(found.select(F.col("src").alias("source"), F.col("dst").alias("sink")), ["source", "sink"], "left_semi")
    return real if exempt is None else real.unionByName(pairs.join(exempt, "sink", "left_semi").select(*pairs.columns)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, rep): the smallest node of each node's strongly connected component.

    Nodes without edges into or out of what is left are components of their own and go first. Each round then labels what is left with the
    least node that reaches it; nodes that reach their label back are its component. Once few edges are left
    (small.LOCAL_EDGES, counted), they are settled in one pass.
    """
    left = materialise(edges.select("src", "dst").distinct(), "edges")
    todo = materialise(_nodes(left), "nodes")
    done = [todo.limit(0).select("node", F.col("node").alias("rep"))]
    while not todo.isEmpty():
        held = small.edges_of(left)
        if held is not None:
            rep = small.table(left, "src", small.components(held), "rep", "")
            done.append(materialise(todo.join(rep, "node", "left").select("node", F.coalesce("rep", "node").alias("rep")), "components"))
            break
        inner = materialise(left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node"))), "nodes")
        done.append(materialise(todo.join(inner, "node", "left_anti").select("node", F.col("node").alias("rep")), "components"))
        todo, left = inner, materialise(_among(left, inner), "edges")
        color = _least(todo, left)
        same = left.join(color.withColumnsRenamed({"node": "src", "rep": "a"}), "src").join(color.withColumnsRenamed({"node": "dst", "rep": "b"}), "dst").filter("a = b")
        back = materialise(same.select(F.col("dst").alias("__d"), F.col("src").alias("node"), F.col("a").alias("__r")), "edges")
        step = lambda new, _, back=back: new.select("rep", F.col("node").alias("__n")).join(back, (F.col("__n") == F.col("__d")) & (F.col("rep") == F.col("__r"))).select("node", "rep")
        done.append(fixpoint(color.filter("node = rep"), step, label="scc"))
        todo = materialise(todo.join(done[-1], "node", "left_anti"), "nodes")
        left = materialise(_among(left, todo), "edges")
        done = [materialise(reduce(DataFrame.unionByName, done), "components")]
    return reduce(DataFrame.unionByName, done)


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes."""
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")


def _least(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rep): the least node that reaches each. Only nodes whose label has changed send it on."""
    label = materialise(nodes.select("node", F.col("node").alias("rep")), "labels")
    changed = label
    while not changed.isEmpty():
        hop = changed.join(edges, changed["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("rep").alias("__new"))
        both = materialise(label.join(hop, "node", "left").select("node", F.least("rep", "__new").alias("rep"), (F.col("__new") < F.col("rep")).alias("__c")), "labels")
        label, changed = both.drop("__c"), both.filter("__c").drop("__c")
    return label


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path that ends at each node of an acyclic graph: a topological order. A cycle is an error.

    Few edges (small.LOCAL_EDGES, counted) are ordered in one pass; in a larger graph the nodes that a path of k edges ends at are found round by round.
    """
    held = small.edges_of(edges)
    if held is not None:
        level = small.levels(held)
        if len(level) < len({n for e in held for n in e}):
            raise ValueError("the graph has a cycle")
        return small.table(edges, "src", level, "level", "int")
    e = materialise(edges.select("src", "dst").distinct(), "edges")
    nodes = materialise(_nodes(e), "nodes")
    n, k = nodes.count(), 0
    found = [nodes.withColumn("level", F.lit(0))]
    frontier = nodes
    while True:
        frontier = materialise(frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct(), "frontier")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("level").alias("level"))
        k += 1
        if k >= n:
            raise ValueError("the graph has a cycle")
        found.append(frontier.withColumn("level", F.lit(k)))
        if len(found) > 16:
            found = [materialise(reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("level").alias("level")), "levels")]


def dominators(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """(func, a, b): block a dominates block b, over edges (func, src, dst) and entries (func, bb): b is reachable, but not around a.

    Functions of at most small.LOCAL_EDGES edges, which is counted, are settled one by one by immediate dominators; for larger ones, what is reached
    around each block is found round by round.
    """
    sized = edges.groupBy("func").count()
    large = materialise(sized.filter(F.col("count") > small.LOCAL_EDGES).select("func"), "large")
    if large.isEmpty():
        return _dominators(edges, entry)
    big = lambda df: df.join(large, "func", "left_semi")
    rest = lambda df: df.join(large, "func", "left_anti")
    return _dominators(rest(edges), rest(entry)).unionByName(_dominators_by_rounds(big(edges), big(entry)))


def _dominators(edges: DataFrame, entry: DataFrame) -> DataFrame:
    import pandas as pd

    def each(key, given: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        up = small.dominator_tree(list(zip(given["src"].tolist(), given["dst"].tolist(), strict=True)), entries["bb"].tolist())
        a, b = [], []
        for node in up:
            over = node
            while over is not None:
                a.append(over)
                b.append(node)
                over = up[over]
        return pd.DataFrame({"func": [key[0]] * len(a), "a": a, "b": b})

    of, bb = (edges.schema[c].dataType.simpleString() for c in ("func", "src"))
    given = edges.select("func", "src", "dst").distinct()
    return given.groupBy("func").cogroup(entry.select("func", "bb").groupBy("func")).applyInPandas(each, f"func {of}, a {bb}, b {bb}")


def _dominators_by_rounds(edges: DataFrame, entry: DataFrame) -> DataFrame:
    keyed = _keyed(edges)
    reached = fixpoint(entry.select(F.struct("func", "bb").alias("n")), lambda new, _: new.join(keyed, new["n"] == keyed["src"]).select(F.col("dst").alias("n")), label="blocks")
    blocks = reached.select("n.func", F.col("n.bb").alias("b"))
    e = edges.select(F.col("func").alias("__f"), F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    cuts = blocks.withColumnRenamed("b", "a")
    seed = cuts.join(entry, "func").filter("a <> bb").select("func", "a", F.col("bb").alias("b"))
    around = fixpoint(seed, lambda new, _: new.join(e, (new["func"] == e["__f"]) & (new["b"] == e["__s"])).filter(F.col("__d") != F.col("a")).select("func", "a", F.col("__d").alias("b")), label="around")
    return cuts.join(blocks, "func").join(around, ["func", "a", "b"], "left_anti")


def _keyed(edges: DataFrame) -> DataFrame:
    return edges.select(F.struct("func", F.col("src").alias("bb")).alias("src"), F.struct("func", F.col("dst").alias("bb")).alias("dst"))


def frontiers(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(func, a, b): b is in a's dominance frontier: a dominates a predecessor of b, but not b strictly."""
    into = edges.select("func", F.col("src").alias("p"), F.col("dst").alias("b")).distinct()
    over = into.join(dom.withColumnRenamed("b", "p"), ["func", "p"]).select("func", "a", "b").distinct()
    return over.join(dom.filter("a <> b"), ["func", "a", "b"], "left_anti")


def iterated_frontier(defs: DataFrame, df: DataFrame) -> DataFrame:
    """(func, key, bb): where definitions (func, key, bb) need merging: the frontier of them and of merges."""
    f = df.withColumnsRenamed({"func": "__f", "a": "__a", "b": "__b"})
    hop = lambda x: x.join(f, (x["func"] == f["__f"]) & (x["bb"] == f["__a"])).select("func", "key", F.col("__b").alias("bb"))
    return fixpoint(hop(defs), lambda new, _: hop(new), label="phis")


def instruction_order(pairs: DataFrame, insts: DataFrame, block_reach: DataFrame, dom: DataFrame) -> DataFrame:
    """pairs (i1, i2) of instructions (inst, func, bb, ord) with reachable and dominates: within a block by order, else by blocks."""
    a = insts.select(F.col("inst").alias("i1"), F.col("func").alias("f1"), F.col("bb").alias("b1"), F.col("ord").alias("o1"))
    b = insts.select(F.col("inst").alias("i2"), F.col("func").alias("f2"), F.col("bb").alias("b2"), F.col("ord").alias("o2"))
    both = pairs.join(a, "i1").join(b, "i2").filter("f1 = f2")
    r = block_reach.select(F.col("src").alias("b1"), F.col("dst").alias("b2"), F.lit(True).alias("r"))
    d = dom.select(F.col("func").alias("f1"), F.col("a").alias("b1"), F.col("b").alias("b2"), F.lit(True).alias("d"))
    both = both.join(r, ["b1", "b2"], "left").join(d, ["f1", "b1", "b2"], "left")
    here = F.col("b1") == F.col("b2")
    reach = F.coalesce("r", F.lit(False)) | (here & (F.col("o1") < F.col("o2")))
    dominates = F.when(here, F.col("o1") <= F.col("o2")).otherwise(F.coalesce("d", F.lit(False)))
    return both.select("i1", "i2", reach.alias("reachable"), dominates.alias("dominates"))
