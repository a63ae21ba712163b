"""Value-flow graphs: definitions joined to uses, memory SSA, simplification, roles of nodes, and the use-after-return query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators import reach
from rillgraph.operators.fixpoint import fixpoint
from rillgraph.sources.shared import materialise


def direct_edges(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(src, dst, kind): a node that defines a pointer (node, ptr) to each that uses it."""
    d = defs.select(F.col("node").alias("src"), "ptr")
    return d.join(uses.select(F.col("node").alias("dst"), "ptr"), "ptr").filter("src <> dst").select("src", "dst", F.lit("direct").alias("kind")).distinct()


def indirect_edges(defs: DataFrame, uses: DataFrame, regions: DataFrame) -> DataFrame:
    """(src, dst, kind, obj): definitions of a version of a region (node, region, version) to its uses, labelled with its objects."""
    both = defs.select(F.col("node").alias("src"), "region", "version").join(uses.select(F.col("node").alias("dst"), "region", "version"), ["region", "version"])
    return both.join(regions, "region").select("src", "dst", F.lit("indirect").alias("kind"), "obj").distinct()


def crossing(actual: DataFrame, formal: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, cs, obj): a call's nodes (cs, node, obj) to the callee's (func, node, obj) where their points-to sets meet."""
    a = actual.join(calls.select("cs", "func"), "cs").select("cs", "func", F.col("node").alias("src"), "obj")
    return a.join(formal.select("func", F.col("node").alias("dst"), "obj"), ["func", "obj"]).select("src", "dst", "cs", "obj").distinct()


def merged_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, cs, objs): one edge for each (src, dst, kind, cs), with the union of its objects."""
    return edges.groupBy("src", "dst", "kind", "cs").agg(F.sort_array(F.collect_set("obj")).alias("objs"))


def bypassed(edges: DataFrame, removable: DataFrame) -> DataFrame:
    """(src, dst) without removable nodes (node): paths through them become edges; self edges that this makes go."""
    e = materialise(edges.select("src", "dst").distinct(), "edges")
    gone = materialise(removable.select("node").distinct(), "removable")
    into = e.join(gone, e["src"] == gone["node"], "left_anti")
    out = e.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    found = fixpoint(into, lambda new, _: new.join(gone, new["dst"] == gone["node"], "left_semi").join(out, F.col("dst") == F.col("__s")).select("src", F.col("__d").alias("dst")), label="bypass")
    return found.join(gone, found["dst"] == gone["node"], "left_anti").filter("src <> dst").distinct()


def without_dereferences(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) without the direct ones from a pointer's definition to the address side of stores and loads (nodes: node, kind, ptr_def)."""
    deref = nodes.filter("kind in ('Store', 'Load')").select(F.col("ptr_def").alias("src"), F.col("node").alias("dst"), F.lit("direct").alias("kind"))
    return edges.join(deref, ["src", "dst", "kind"], "left_anti")


def roles(callsites: DataFrame, catalog: DataFrame, args: DataFrame, results: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(node, role): by the catalog (name, role), the results of allocations called within the context (caller), and the first arguments of releases
    and locks. Names count up to their first dot."""
    named = callsites.withColumn("name", F.substring_index("callee", ".", 1)).join(catalog, "name")
    alloc = named.filter("role = 'alloc'")
    if within is not None:
        alloc = alloc.join(within.select("caller").distinct(), "caller", "left_semi")
    sources = alloc.join(results, "cs").select("node", "role")
    sinks = named.filter("role <> 'alloc'").join(args.filter("pos = 0"), "cs").select("node", "role")
    return sources.unionByName(sinks).distinct()


def uses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): loads that nothing follows, and the parents of such geps; of several under one parent the first by id."""
    leaf = nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    up = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")).distinct()
    first = Window.partitionBy("parent").orderBy("node")
    gep = leaf.filter("kind = 'Gep'").join(up, "node").withColumn("r", F.row_number().over(first)).filter("r = 1").select(F.col("parent").alias("node"))
    load = leaf.filter("kind = 'Load'").join(up, "node", "left").withColumn("r", F.row_number().over(Window.partitionBy(F.coalesce("parent", -F.col("node") - 1)).orderBy("node"))).filter("r = 1").select("node")
    return load.unionByName(gep).distinct()


def null_stores(edges: DataFrame) -> DataFrame:
    """(node): what node 0, the null pointer, flows to."""
    return edges.filter("src = 0").select(F.col("dst").alias("node")).distinct()


def parameter_stores(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(node): stores that both a formal parameter's phi and an address flow into (kinds: node, kind)."""
    into = edges.join(kinds.select(F.col("node").alias("src"), "kind"), "src").groupBy(F.col("dst").alias("node"))
    both = into.agg(F.bool_or(F.col("kind") == "TInterPhi").alias("p"), F.bool_or(F.col("kind") == "Addr").alias("a")).filter("p and a")
    return both.join(kinds.filter("kind = 'Store'"), "node", "left_semi").select("node")


def dereferenced_globals(nodes: DataFrame, pts: DataFrame, globals_: DataFrame) -> DataFrame:
    """(node): nodes that are globals (column obj) or point to one."""
    own = nodes.join(globals_.select(F.col("obj").alias("node")), "node", "left_semi").select("node")
    other = pts.join(globals_.select("obj"), "obj", "left_semi").select(F.col("var").alias("node")).join(nodes, "node", "left_semi")
    return own.unionByName(other.select("node")).distinct()


def renamed(ops: DataFrame, tree: DataFrame) -> DataFrame:
    """Memory SSA versions: (op, func, region, use, def) of ops (op, func, bb, ord, region, kind in mu, chi, phi).

    Along the dominator tree (func, bb, parent; the entry's parent null), a use has the last definition's version, a definition a new one, numbered
    in the order of the walk. Functions are walked one by one, each a group of rows.
    """
    import pandas as pd

    def walk(key, rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for r in blocks.sort_values("bb").itertuples():
            below.setdefault(None if pd.isna(r.parent) else int(r.parent), []).append(int(r.bb))
        own = {b: g.sort_values(["ord", "op"]) for b, g in rows.groupby("bb")}
        count: dict = {}
        out = []
        todo = [(b, {}) for b in reversed(below.get(None, []))]
        while todo:
            b, now = todo.pop()
            now = dict(now)
            for r in own[b].itertuples() if b in own else ():
                use = now.get(r.region, 0) if r.kind != "phi" else None
                new = None
                if r.kind != "mu":
                    new = count[r.region] = count.get(r.region, 0) + 1
                    now[r.region] = new
                out.append((r.op, key[0], r.region, use, new))
            todo += [(x, now) for x in reversed(below.get(b, []))]
        return pd.DataFrame(out, columns=["op", "func", "region", "use", "def"]).astype({"use": "Int64", "def": "Int64"})

    kinds = dict(ops.dtypes)
    return ops.groupBy("func").cogroup(tree.groupBy("func")).applyInPandas(walk, f"op long, func {kinds['func']}, region long, use long, def long")


def flow_sensitive(nodes: DataFrame, edges: DataFrame, singletons: DataFrame, flow_insensitive: DataFrame) -> DataFrame:
    """(loc, var, obj): what holds behind each node (loc, kind in addr, copy, store, other; src, dst) of a value-flow graph (src, dst; var: the memory that flows, null: top-level).

    A store kills what its target held if the target, by the flow-insensitive solution (var, obj), is one object that stands for one cell
    (singletons: obj). That is fixed beforehand, so what follows only grows.
    """
    one = flow_insensitive.groupBy("var").agg(F.count("*").alias("n"), F.min("obj").alias("obj")).filter("n = 1").join(singletons, "obj", "left_semi").select(F.col("var").alias("dst"), F.col("obj").alias("killed"))
    stores = nodes.filter("kind = 'store'").join(one, "dst", "left").select("loc", "src", "dst", "killed")
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("var").alias("__v"))
    kills = stores.filter("killed is not null").select(F.col("loc").alias("__d"), F.col("killed").alias("__v"))
    through = e.join(kills, ["__d", "__v"], "left_anti")
    seed = nodes.filter("kind = 'addr'").select("loc", F.col("dst").alias("var"), F.col("src").alias("obj"))
    copies = nodes.filter("kind = 'copy'").select(F.col("loc").alias("__l"), F.col("src").alias("__from"), F.col("dst").alias("__to"))
    loads = nodes.filter("kind = 'load'").select(F.col("loc").alias("__l"), F.col("src").alias("__from"), F.col("dst").alias("__to"))

    def step(new: DataFrame, full: DataFrame) -> DataFrame:
        # memory and pointers flow along edges that carry them; at a node they are transferred
        flows = new.join(e.filter("__v is null"), new["loc"] == F.col("__s")).select(F.col("__d").alias("loc"), "var", "obj")
        flows = flows.unionByName(new.join(through, (new["loc"] == F.col("__s")) & (new["var"] == F.col("__v"))).select(F.col("__d").alias("loc"), "var", "obj"))
        copied = new.join(copies, (new["loc"] == F.col("__l")) & (new["var"] == F.col("__from"))).select("loc", F.col("__to").alias("var"), "obj")
        s = stores.select(F.col("loc").alias("__l"), F.col("src").alias("__src"), F.col("dst").alias("__dst"))
        value = lambda df: df.join(s, (df["loc"] == F.col("__l")) & (df["var"] == F.col("__src"))).select(F.col("__l").alias("l"), F.col("__dst").alias("p"), F.col("obj").alias("value"))
        target = lambda df: df.join(s, (df["loc"] == F.col("__l")) & (df["var"] == F.col("__dst"))).select(F.col("__l").alias("l"), F.col("__dst").alias("p"), F.col("obj").alias("cell"))
        stored = value(new).join(target(full), ["l", "p"]).unionByName(value(full).join(target(new), ["l", "p"]).select("l", "p", "value", "cell"))
        stored = stored.select(F.col("l").alias("loc"), F.col("cell").alias("var"), F.col("value").alias("obj"))
        address = lambda df: df.join(loads, (df["loc"] == F.col("__l")) & (df["var"] == F.col("__from"))).select(F.col("__l").alias("l"), F.col("obj").alias("cell"), F.col("__to").alias("to"))
        held = lambda df: df.select(F.col("loc").alias("l"), F.col("var").alias("cell"), F.col("obj").alias("value"))
        loaded = address(new).join(held(full), ["l", "cell"]).unionByName(address(full).join(held(new), ["l", "cell"]))
        return flows.unionByName(copied).unionByName(stored).unionByName(loaded.select(F.col("l").alias("loc"), F.col("to").alias("var"), F.col("value").alias("obj")))

    return fixpoint(seed, step, label="flow")


def use_after_return(edges: DataFrame, locals_: DataFrame, funcs: DataFrame, pointers: DataFrame, limit: int = 10) -> DataFrame:
    """(local, pointer): stack objects (node, func) whose address is still held by a pointer (node: global, heap or another function's stack) when
    their function has returned.

    Forward in matched contexts (edges as in reach.forward; funcs: node, func) until a return leaves the object's function with no
    call of it open; from what is reached then, backward to pointers. limit: sites of a call string; 10 in full, 3 for the light query.
    """
    found = reach.forward(edges, locals_, limit=limit, truncate=True)
    own = locals_.select(F.col("node").alias("source"), F.col("func").alias("home")).distinct()
    outside = edges.filter("kind = 'ret'").join(funcs.select(F.col("node").alias("src"), F.col("func").alias("from")), "src")
    left = found.filter(F.size("ctx") == 0).join(own, "source").join(outside, (F.col("node") == F.col("src")) & (F.col("home") == F.col("from")))
    left = left.select("source", F.col("dst").alias("node")).distinct()
    back = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    met = fixpoint(left, lambda new, _: new.join(back, new["node"] == back["__d"]).select("source", F.col("__s").alias("node")), label="backward")
    return met.join(pointers.select("node").distinct(), "node", "left_semi").filter("source <> node").select(F.col("source").alias("local"), F.col("node").alias("pointer")).distinct()


def global_entry(stores: DataFrame, pts: DataFrame, formal_in: DataFrame) -> DataFrame:
    """(src, dst, kind, obj): stores that initialise globals (node, ptr) to the entry function's incoming memory (node, obj), on what ptr points to (var, obj)."""
    written = stores.join(pts, stores["ptr"] == pts["var"]).select(F.col("node").alias("src"), "obj")
    return written.join(formal_in.select(F.col("node").alias("dst"), "obj"), "obj").select("src", "dst", F.lit("indirect").alias("kind"), "obj").distinct()


GRAPH = ("src", "dst", "kind", "cs", "obj")


def _as_graph(edges: DataFrame) -> DataFrame:
    """Edges with all columns of GRAPH, null where they have none."""
    return edges.select(*(F.col(c).cast("string") if c == "kind" else F.col(c).cast("long") if c in edges.columns else F.lit(None).cast("long").alias(c) for c in GRAPH))


def connected(calls: DataFrame, args: DataFrame, params: DataFrame, rets: DataFrame, results: DataFrame, memory: dict[str, DataFrame] | None = None) -> DataFrame:
    """GRAPH edges that calls (cs, func) add, found so far or only now: arguments (cs, pos, node) to parameters (func, pos, node), returned nodes (func, node)
    to results (cs, node), and memory (actual_in: cs, node, obj; formal_in, formal_out: func, node, obj; actual_out: cs, node, obj)."""
    given = calls.join(args.withColumnRenamed("node", "src"), "cs").join(params.withColumnRenamed("node", "dst"), ["func", "pos"])
    back = calls.join(rets.withColumnRenamed("node", "src"), "func").join(results.withColumnRenamed("node", "dst"), "cs")
    out = _as_graph(given.withColumn("kind", F.lit("call"))).unionByName(_as_graph(back.withColumn("kind", F.lit("ret"))))
    if memory is not None:
        into = crossing(memory["actual_in"], memory["formal_in"], calls).withColumn("kind", F.lit("call"))
        leave = calls.join(memory["formal_out"].withColumnRenamed("node", "src"), "func").join(memory["actual_out"].withColumnRenamed("node", "dst"), ["cs", "obj"])
        out = out.unionByName(_as_graph(into)).unionByName(_as_graph(leave.withColumn("kind", F.lit("ret"))))
    return out.distinct()


def memory_edges(ops: DataFrame, tree: DataFrame, regions: DataFrame) -> DataFrame:
    """GRAPH edges through memory within functions: versions by renamed(), each definition's to its uses, with the regions' objects (region, obj)."""
    versions = materialise(renamed(ops, tree), "versions")
    region = F.struct("func", "region")
    defs = versions.filter("def is not null").select(F.col("op").alias("node"), region.alias("region"), F.col("def").alias("version"))
    uses_ = versions.filter("use is not null and use > 0").select(F.col("op").alias("node"), region.alias("region"), F.col("use").alias("version"))
    named = versions.select("func", "region").distinct().join(regions, "region").select(region.alias("region"), "obj")
    return _as_graph(indirect_edges(defs, uses_, named).filter("src <> dst"))


def graph(defs: DataFrame, uses_: DataFrame, *more: DataFrame) -> DataFrame:
    """GRAPH: the value-flow graph of top-level pointers (defs, uses: node, ptr) and further edges: connected(), memory_edges(), global_entry()."""
    out = _as_graph(direct_edges(defs, uses_).withColumn("kind", F.lit("intra")))
    for edges in more:
        out = out.unionByName(_as_graph(edges.withColumn("kind", F.when(F.col("kind") == "indirect", "intra").otherwise(F.col("kind")))))
    return out.distinct()


def with_phis(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) where a formal parameter, or the result of a call, is a phi of what its calls give: actual parameters and returned nodes go.

    edges: GRAPH; nodes: (node, kind in ActualParm, FormalParm, FormalRet, ActualRet and others). What defines an argument then flows into the phi
    by the call's edge, what defines a returned value by the return's.
    """
    kind = nodes.select("node", "kind").distinct()
    gone = kind.filter("kind in ('ActualParm', 'FormalRet')").select("node")
    outer = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("__n"), F.col("dst").alias("__to"), F.col("kind").alias("__kind"), F.col("cs").alias("__cs"))
    through = edges.join(outer, edges["dst"] == outer["__n"]).select("src", F.col("__to").alias("dst"), F.col("__kind").alias("kind"), F.col("__cs").alias("cs"), "obj")
    rest = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*GRAPH)
    made = kind.join(gone, "node", "left_anti").withColumn("kind", F.when(F.col("kind").isin("FormalParm", "ActualRet"), "TInterPhi").otherwise(F.col("kind")))
    return rest.unionByName(through.select(*GRAPH)).distinct(), made


def external_sinks(callsites: DataFrame, catalog: DataFrame, args: DataFrame, defs: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node of its own for the first argument of each call (cs, callee) of a release or lock of the catalog (name, role), numbered first_id +
    cs, and an edge from the argument's definition (node, ptr; args: cs, pos, ptr)."""
    called = callsites.withColumn("name", F.substring_index("callee", ".", 1)).join(catalog.filter("role in ('dealloc', 'lock', 'unlock')"), "name")
    own = called.join(args.filter("pos = 0"), "cs").select((F.col("cs") + first_id).alias("node"), F.lit("ActualParm").alias("kind"), "cs", "role", "ptr")
    edges = own.join(defs.select(F.col("node").alias("src"), "ptr"), "ptr").select("src", F.col("node").alias("dst"), F.lit("intra").alias("kind"), "cs", F.lit(None).cast("long").alias("obj"))
    return own.distinct(), edges.distinct()


def against(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, kind, cs) turned round: a return is entered, a call left."""
    turned = F.when(F.col("kind") == "call", "ret").when(F.col("kind") == "ret", "call").otherwise(F.col("kind"))
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), turned.alias("kind"), "cs")


def backward(edges: DataFrame, starts: DataFrame, limit: int = reach.CONTEXT) -> DataFrame:
    """(source, node, ctx): what flows into each start (node) in matched contexts, against the edges (src, dst, kind, cs): a return is entered, a call left."""
    return reach.forward(against(edges), starts, limit=limit, truncate=True)


def lock_objects(edges: DataFrame, locks: DataFrame, nodes: DataFrame, api: DataFrame) -> DataFrame:
    """(node): objects that are locked or unlocked: address nodes (node, kind, func) of the interface's functions (func) that flow into the arguments (node)."""
    met = reach.reached(against(edges), locks)
    own = nodes.filter("kind = 'Addr'").join(api.select("func").distinct(), "func", "left_semi").select("node")
    return met.join(own, "node", "left_semi")


def _depths(edges: DataFrame, starts: DataFrame, stop: DataFrame, limit: int) -> DataFrame:
    """(source, node, depth): the least number of edges by which starts reach nodes in matched contexts; nodes of stop (node) are reached but not passed."""
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), "kind", "cs")
    seed = starts.select("source", "node", F.array().cast("array<bigint>").alias("ctx"), F.lit(0).alias("depth")).distinct()
    ends = materialise(stop.select("node").distinct(), "ends")

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        hop = new.join(ends, "node", "left_anti").join(e, F.col("node") == F.col("__s"))
        fits = (F.col("kind") != "ret") | reach.matches(F.col("ctx"), F.col("cs"))
        then = F.when(F.col("kind") == "call", reach.push(F.col("ctx"), F.col("cs"), limit)).when(F.col("kind") == "ret", reach.pop(F.col("ctx"))).otherwise(F.col("ctx"))
        return hop.filter(fits).select("source", F.col("__d").alias("node"), then.alias("ctx"), (F.col("depth") + 1).alias("depth"))

    found = fixpoint(seed, step, ["source", "node", "ctx"], label="depths")
    return found.groupBy("source", "node").agg(F.min("depth").alias("depth"))


def direct_returns(edges: DataFrame, sources: DataFrame, nodes: DataFrame, limit: int = reach.CONTEXT) -> DataFrame:
    """(source, store, addr): what a source (node) returned from a call is assigned to: forward to the first store, from there backward to the first address node
    outside the forward slice.

    nodes: (node, kind); first means by the fewest edges, then by id.
    """
    stores, addrs = nodes.filter("kind = 'Store'").select("node"), nodes.filter("kind = 'Addr'").select("node")
    ahead = materialise(_depths(edges, sources.select(F.col("node").alias("source"), "node"), stores, limit), "ahead")
    first = ahead.join(stores, "node", "left_semi").groupBy("source").agg(F.min_by("node", F.struct("depth", "node")).alias("store"))
    turned = F.when(F.col("kind") == "call", "ret").when(F.col("kind") == "ret", "call").otherwise(F.col("kind"))
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), turned.alias("kind"), "cs")
    # edges into a source's forward slice are not gone back over, so each source walks a graph of its own
    back = fixpoint(
        first.select("source", "store", F.col("store").alias("node"), F.array().cast("array<bigint>").alias("ctx"), F.lit(0).alias("depth")),
        lambda new, _: _back(new, against, ahead, addrs, limit),
        ["source", "store", "node", "ctx"],
        label="back",
    )
    met = back.join(addrs, "node", "left_semi").groupBy("source", "store").agg(F.min_by("node", F.struct("depth", "node")).alias("addr"))
    return met.select("source", "store", "addr")


def _back(new: DataFrame, against: DataFrame, ahead: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    e = against.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), "kind", "cs")
    hop = new.join(ends, "node", "left_anti").join(e, F.col("node") == F.col("__s"))
    hop = hop.join(ahead.select(F.col("source").alias("__x"), F.col("node").alias("__y")), (F.col("source") == F.col("__x")) & (F.col("__d") == F.col("__y")), "left_anti")
    fits = (F.col("kind") != "ret") | reach.matches(F.col("ctx"), F.col("cs"))
    then = F.when(F.col("kind") == "call", reach.push(F.col("ctx"), F.col("cs"), limit)).when(F.col("kind") == "ret", reach.pop(F.col("ctx"))).otherwise(F.col("ctx"))
    return hop.filter(fits).select("source", "store", F.col("__d").alias("node"), then.alias("ctx"), (F.col("depth") + 1).alias("depth"))


MEMORY = ("ActualIn", "FormalOut", "ActualOut", "FormalIn")


def without_memory_nodes(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = MEMORY) -> DataFrame:
    """GRAPH edges without the nodes (node, kind) that only hand memory on: an edge into one and an edge out of it that carry the same object become one.

    A node stays if edges between functions lead both into and out of it, as one edge cannot be of two calls.
    """
    inter = F.col("kind").isin("call", "ret")
    some = nodes.filter(F.col("kind").isin(*kinds)).select("node")
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.bool_or(inter).alias("a"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.bool_or(inter).alias("b"))
    gone = materialise(some.join(into, "node").join(out, "node").filter("not (a and b)").select("node"), "handed")
    e = edges.select(*GRAPH).withColumn("from_gone", F.lit(False))
    ends = e.join(gone, F.col("src") == F.col("node"), "left").withColumn("from_gone", F.col("node").isNotNull()).drop("node")
    ends = ends.join(gone, F.col("dst") == F.col("node"), "left").withColumn("to_gone", F.col("node").isNotNull()).drop("node")
    ends = materialise(ends, "ends")
    hop = ends.filter("from_gone").select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("kind").alias("__k"), F.col("cs").alias("__c"), F.col("obj").alias("__o"), F.col("to_gone").alias("__t"))
    kind = F.when(F.col("kind") == "intra", F.col("__k")).otherwise(F.col("kind"))
    both = lambda df: df.join(hop, (F.col("dst") == F.col("__s")) & F.col("obj").eqNullSafe(F.col("__o"))).filter("kind = 'intra' or __k = 'intra'")
    step = lambda new, _: both(new.filter("to_gone")).select("src", F.col("__d").alias("dst"), kind.alias("kind"), F.coalesce("cs", "__c").alias("cs"), "obj", F.col("__t").alias("to_gone"))
    start = ends.filter("not from_gone").select(*GRAPH, "to_gone")
    return fixpoint(start, step, label="handed").filter("not to_gone").select(*GRAPH)


def statistics(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(edges, direct, indirect, inter, nodes, top_in, top_out, mean_out, cycles, largest_cycle): a graph's figures, with its components (node, rep)."""
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("obj").isNull()).alias("direct"), F.count_if(F.col("obj").isNotNull()).alias("indirect"), F.count_if(F.col("kind").isin("call", "ret")).alias("inter"))
    degree = lambda c, n: edges.groupBy(c).agg(F.count("*").alias("n")).agg(F.max("n").alias(f"top_{n}"), F.round(F.avg("n"), 6).alias(f"mean_{n}"))
    size = components.groupBy("rep").agg(F.count("*").alias("n"))
    c = size.agg(F.sum("n").alias("nodes"), F.count_if(F.col("n") > 1).alias("cycles"), F.max("n").alias("largest_cycle"))
    # one row each
    return e.join(degree("dst", "in").drop("mean_in")).join(degree("src", "out")).join(c).select("edges", "direct", "indirect", "inter", "nodes", "top_in", "top_out", "mean_out", "cycles", "largest_cycle")


def first_paths(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(local, pointer, path) of use_after_return(): for each pointer the first path (local, pointer, path) that leads to it, by length, then by nodes."""
    both = found.join(paths, ["local", "pointer"])
    return both.groupBy("pointer").agg(F.min_by(F.struct("local", "path"), F.struct(F.size("path"), F.col("path"), F.col("local"))).alias("x")).select("x.local", "pointer", "x.path")
