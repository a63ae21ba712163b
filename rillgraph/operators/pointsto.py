"""Inclusion-based points-to analysis: address, copy, load, store, field and indirect-call rules to a fixpoint.

Variables and objects share one space of ids; a field of an object is the pair (object, offset), encoded by field(). Copies are
closed inside, loads and stores add copies outside, so few outer rounds are needed. All relations are narrow rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.operators import small
from rillgraph.operators.fixpoint import fixpoint
from rillgraph.sources.shared import materialise

#: Fields of an object at most; offsets are taken modulo this.
FIELDS = 1 << 14


def field(obj: Column, offset: Column) -> Column:
    """The id of an object's field: offset 0 is the object itself. Ids of objects are below 2^48."""
    return F.when(offset == 0, obj).otherwise(obj + F.shiftleft(F.pmod(offset, F.lit(FIELDS)).cast("long"), 48))


def base(obj: Column) -> Column:
    """The object that a field belongs to."""
    return obj.bitwiseAND((1 << 48) - 1)


def offset_of(obj: Column) -> Column:
    """A field's offset."""
    return F.shiftright(obj, 48)


def propagate(pts: DataFrame, copy: DataFrame, gep: DataFrame | None = None, collapsed: DataFrame | None = None, label: str = "pts", known: DataFrame | None = None) -> DataFrame:
    """pts (var, obj) closed under copy (src, dst) and gep (src, dst, offset): field addresses move by the offset.

    Objects whose base is in collapsed (column obj) have no fields: all offsets are the object. known: pairs that are closed already. Over few
    plain copies (small.LOCAL_EDGES, counted) variables are walked from; else what is new moves an edge a round.
    """
    held = small.edges_of(copy) if gep is None else None
    if held is not None:
        pts = canonical(pts, collapsed)
        ahead = small.walked(held, pts.select("var"), ("__s", "__d"))
        moved = pts.join(ahead, pts["var"] == ahead["__s"]).select(F.col("__d").alias("var"), "obj")
        parts = [pts.select("var", "obj"), moved] + ([known.select("var", "obj")] if known is not None else [])
        return materialise(reduce(DataFrame.unionByName, parts).distinct(), label)
    edge = copy.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.lit(0).cast("long").alias("__o"))
    if gep is not None:
        edge = edge.unionByName(gep.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("offset").cast("long").alias("__o")))
    edge = edge.distinct()

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        out = new.join(edge, new["var"] == edge["__s"])
        moved = F.when(F.col("__o") == 0, F.col("obj")).otherwise(field(base(F.col("obj")), offset_of(F.col("obj")) + F.col("__o")))
        return canonical(out.select(F.col("__d").alias("var"), moved.alias("obj")), collapsed)

    return fixpoint(canonical(pts, collapsed).select("var", "obj"), step, label=label, known=known)


def canonical(pts: DataFrame, collapsed: DataFrame | None) -> DataFrame:
    """pts with fields of collapsed objects replaced by the objects."""
    if collapsed is None:
        return pts
    out = pts.join(collapsed.select(F.col("obj").alias("__c")).distinct(), base(F.col("obj")) == F.col("__c"), "left")
    return out.select("var", F.when(F.col("__c").isNotNull(), base(F.col("obj"))).otherwise(F.col("obj")).alias("obj")).distinct()


def load_copies(pts: DataFrame, load: DataFrame) -> DataFrame:
    """What loads copy: from each object that the address points to."""
    return pts.join(load, pts["var"] == load["src"]).select(F.col("obj").alias("src"), "dst").distinct()


def store_copies(pts: DataFrame, store: DataFrame) -> DataFrame:
    """What stores copy: to each object that the address points to."""
    return pts.join(store, pts["var"] == store["dst"]).select("src", F.col("obj").alias("dst")).distinct()


def indirect_calls(pts: DataFrame, callsites: DataFrame, functions: DataFrame, limit: int | None = None) -> DataFrame:
    """(cs, func): functions (func, obj, n_args) that a call's pointer (cs, funptr, n_args) points to, of as many arguments.

    With a limit, at most so many edges, those of the smallest call sites and functions, as an analysis that gives up then has; none by default.
    """
    found = callsites.join(pts, callsites["funptr"] == pts["var"]).join(functions.withColumnRenamed("n_args", "__n").withColumnRenamed("obj", "__o"), F.col("obj") == F.col("__o"))
    edges = found.filter(F.col("n_args") == F.col("__n")).select("cs", "func").distinct()
    return edges if limit is None else edges.orderBy("cs", "func").limit(limit)


def bind(calls: DataFrame, args: DataFrame, params: DataFrame, rets: DataFrame, results: DataFrame) -> DataFrame:
    """Copies (src, dst) of calls (cs, func): arguments (cs, pos, node) to parameters (func, pos, node) by position, those behind the
    last one to the function's vararg (pos -1, if any), returned nodes (func, node) to results (cs, node)."""
    given = calls.join(args.withColumnRenamed("node", "src"), "cs")
    taken = params.withColumnsRenamed({"func": "__f", "pos": "__p", "node": "dst"})
    zipped = given.join(taken, (F.col("func") == F.col("__f")) & (F.col("pos") == F.col("__p"))).select("src", "dst")
    last = params.filter("pos >= 0").groupBy("func").agg(F.max("pos").alias("__last"))
    extra = given.join(last, "func", "left").filter(F.col("pos") > F.coalesce("__last", F.lit(-1)))
    vararg = params.filter("pos = -1").select("func", F.col("node").alias("dst"))
    back = calls.join(rets.withColumnRenamed("node", "src"), "func").join(results.withColumnRenamed("node", "dst"), "cs").select("src", "dst")
    return zipped.unionByName(extra.join(vararg, "func").select("src", "dst")).unionByName(back).distinct()


def andersen(
    addr: DataFrame,
    copy: DataFrame,
    load: DataFrame | None = None,
    store: DataFrame | None = None,
    gep: DataFrame | None = None,
    variant_gep: DataFrame | None = None,
    calls: dict[str, DataFrame] | None = None,
    max_rounds: int = 1000,
    call_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(points-to (var, obj), copies (src, dst)) of the least solution.

    addr (obj, ptr), copy, load, store (src, dst), gep (src, dst, offset), variant_gep (src, dst): a field at an unknown offset, which
    collapses the objects that src points to. calls: callsites (cs, funptr, n_args), functions (func, obj, n_args), args (cs, pos, node),
    params (func, pos, node), rets (func, node), results (cs, node).
    """
    seed = addr.select(F.col("ptr").alias("var"), "obj").distinct()
    if variant_gep is not None:
        copy = copy.unionByName(variant_gep.select("src", "dst"))
    known = materialise(copy.select("src", "dst").distinct(), "copies")
    collapsed, everything = None, seed
    pts = new = propagate(seed, known, gep)
    for _ in range(max_rounds):
        # what the last round's new pairs add; only in a round with a collapse is all looked at again
        more = known.limit(0)
        if load is not None:
            more = more.unionByName(load_copies(new, load))
        if store is not None:
            more = more.unionByName(store_copies(new, store))
        if calls is not None:
            found = indirect_calls(new, calls["callsites"], calls["functions"], call_limit)
            more = more.unionByName(bind(found, calls["args"], calls["params"], calls["rets"], calls["results"]))
        fresh = False
        if variant_gep is not None:
            met = new.join(variant_gep, new["var"] == variant_gep["src"]).select(base(F.col("obj")).alias("obj")).distinct()
            met = materialise(met if collapsed is None else met.join(collapsed, "obj", "left_anti"), "collapsed")
            fresh = not met.isEmpty()
            collapsed = met if collapsed is None else materialise(met.unionByName(collapsed), "collapsed")
            # a collapsed object's fields are the object, as variables too
            more = merged(known.unionByName(more), collapsed)
        added = materialise(more.distinct().join(known, ["src", "dst"], "left_anti"), "copies")
        if added.isEmpty() and not fresh:
            return pts, known
        known = materialise(known.unionByName(added), "copies")
        if fresh:
            pts = new = propagate(pts.unionByName(everything), known, gep, collapsed)
            continue
        moved = pts.join(added, pts["var"] == added["src"]).select(F.col("dst").alias("var"), "obj").distinct()
        moved = materialise(canonical(moved, collapsed).join(pts, ["var", "obj"], "left_anti"), "pts")
        before, pts = pts, propagate(moved, known, gep, collapsed, known=pts)
        new = materialise(pts.join(before, ["var", "obj"], "left_anti"), "pts")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def merged(copies: DataFrame, collapsed: DataFrame) -> DataFrame:
    """copies, and copies between a collapsed object and its fields, both ways."""
    nodes = copies.select(F.col("src").alias("n")).unionByName(copies.select(F.col("dst").alias("n"))).distinct()
    fields = nodes.filter(offset_of(F.col("n")) > 0).join(collapsed, base(F.col("n")) == F.col("obj")).select("n", "obj")
    both = fields.select(F.col("n").alias("src"), F.col("obj").alias("dst")).unionByName(fields.select(F.col("obj").alias("src"), F.col("n").alias("dst")))
    return copies.unionByName(both)


def aliases(pairs: DataFrame, pts: DataFrame) -> DataFrame:
    """(a, b): those pairs of variables that point to a common object, a field-insensitive object meeting all its fields."""
    own = pts.select("var", "obj", base(F.col("obj")).alias("b"))
    x = pairs.join(own.withColumnsRenamed({"var": "a_", "obj": "ao", "b": "ab"}), F.col("a") == F.col("a_"))
    y = x.join(own.withColumnsRenamed({"var": "b_", "obj": "bo", "b": "bb"}), (F.col("b") == F.col("b_")) & (F.col("ab") == F.col("bb")))
    return y.filter((F.col("ao") == F.col("bo")) | (F.col("ao") == F.col("ab")) | (F.col("bo") == F.col("bb"))).select("a", "b").distinct()


def combined(verdicts: DataFrame, rule: str = "veto") -> DataFrame:
    """(a, b, alias) of several analyses (a, b, alias): veto if any denies, conservative if any affirms."""
    agree = F.bool_and("alias") if rule == "veto" else F.bool_or("alias")
    return verdicts.groupBy("a", "b").agg(agree.alias("alias"))


def chain(pts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, obj): objects reachable from seeds (column obj) through what their cells and fields point to."""
    cells = pts.select(base(F.col("var")).alias("__v"), F.col("obj").alias("__o")).distinct()
    start = seeds.select(F.col("obj").alias("root"), "obj").distinct()
    return fixpoint(start, lambda new, _: new.join(cells, base(new["obj"]) == cells["__v"]).select("root", F.col("__o").alias("obj")), label="chain")


def external_effects(calls: DataFrame, effects: DataFrame) -> dict[str, DataFrame]:
    """Edges that external calls (cs, name, pos, node; pos -1 is the result) stand for, by catalog (name, effect).

    Effects: copy_arg0 (result is argument 0), store_arg1 (argument 1 stored through argument 0), load_store (what
    argument 1 points to copied to what argument 0 points to, as memcpy does), alloc (result points to a new object, the call).
    """
    named = calls.join(effects, "name")
    by = lambda pos: named.filter(F.col("pos") == pos).select("cs", "effect", F.col("node").alias(f"n{pos}".replace("-1", "r")))
    zero, one, result = by(0), by(1), by(-1)
    both = zero.join(one, ["cs", "effect"])
    back = zero.join(result, ["cs", "effect"])
    return {
        "copy": back.filter("effect = 'copy_arg0'").select(F.col("n0").alias("src"), F.col("nr").alias("dst")),
        "store": both.filter("effect = 'store_arg1'").select(F.col("n1").alias("src"), F.col("n0").alias("dst")),
        "load_store": both.filter("effect = 'load_store'").select(F.col("n1").alias("src"), F.col("n0").alias("dst")),
        "addr": result.filter("effect = 'alloc'").select(F.col("cs").alias("obj"), F.col("nr").alias("ptr")),
    }


def matched_threads(forks: DataFrame, joins: DataFrame, pts: DataFrame) -> DataFrame:
    """(fork, join): thread starts (cs, var) and waits (cs, var) whose thread variables may be the same, by what they point to (var, obj)."""
    a = forks.select(F.col("cs").alias("fork"), "var").join(pts, "var").select("fork", base(F.col("obj")).alias("obj")).distinct()
    b = joins.select(F.col("cs").alias("join"), "var").join(pts, "var").select("join", base(F.col("obj")).alias("obj")).distinct()
    return a.join(b, "obj").select("fork", "join").distinct()


def byte_geps(geps: DataFrame, layouts: DataFrame) -> DataFrame:
    """(src, dst, offset) of field accesses (src, dst, type, ix) in bytes, by the types' layouts (type, ix, at): locations instead of field numbers.

    propagate() takes them as they are; a field of a nested struct is one access after another, so offsets add up to its place in the whole.
    """
    return geps.join(layouts, ["type", "ix"]).select("src", "dst", F.col("at").cast("long").alias("offset"))
