"""Call graphs: slices within a depth, paths, callers, thread edges, dead functions, and the depth that a budget allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators.fixpoint import fixpoint
from rillgraph.sources.shared import materialise


def edges_of(direct: DataFrame, indirect: DataFrame | None = None, threads: DataFrame | None = None) -> DataFrame:
    """(caller, callee, kind): direct, indirect, fork and join edges as one relation without repeats."""
    parts = [direct.select("caller", "callee", F.lit("direct").alias("kind"))]
    if indirect is not None:
        parts.append(indirect.select("caller", "callee", F.lit("indirect").alias("kind")))
    if threads is not None:
        parts.append(threads.select("caller", "callee", "kind"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def slice_forward(edges: DataFrame, roots: DataFrame, max_depth: int, blacklist: DataFrame | None = None) -> DataFrame:
    """(root, func, depth): what each root (column func) reaches in at most max_depth calls, with the least depth.

    Blacklisted functions (column func) are neither in the slice nor expanded; a root always is.
    """
    calls = edges.select(F.col("caller").alias("__c"), F.col("callee").alias("__f")).distinct()
    if blacklist is not None:
        calls = calls.join(blacklist.select(F.col("func").alias("__f")), "__f", "left_anti")
    seed = roots.select(F.col("func").alias("root"), "func", F.lit(0).alias("depth")).distinct()

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        hop = new.filter(F.col("depth") < max_depth).join(calls, new["func"] == calls["__c"])
        return hop.select("root", F.col("__f").alias("func"), (F.col("depth") + 1).alias("depth"))

    return fixpoint(seed, step, ["root", "func"], label="slice")


def slice_backward(edges: DataFrame, roots: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(root, func, depth): what reaches each root; functions of stop are reached but not passed."""
    calls = edges.select(F.col("callee").alias("__c"), F.col("caller").alias("__f")).distinct()
    seed = roots.select(F.col("func").alias("root"), "func", F.lit(0).alias("depth")).distinct()

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        if stop is not None:
            new = new.join(stop.select(F.col("func")), "func", "left_anti")
        return new.join(calls, new["func"] == calls["__c"]).select("root", F.col("__f").alias("func"), (F.col("depth") + 1).alias("depth"))

    return fixpoint(seed, step, ["root", "func"], label="slice")


def paths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, func, depth, path): breadth-first tree paths; of equal lengths, the path that comes first in order of its functions."""
    calls = edges.select(F.col("caller").alias("__c"), F.col("callee").alias("__f")).distinct()
    seed = roots.select(F.col("func").alias("root"), "func", F.lit(0).alias("depth"), F.array("func").alias("path")).distinct()

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        hop = new.filter(F.col("depth") < max_depth).join(calls, new["func"] == calls["__c"])
        return hop.select("root", F.col("__f").alias("func"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("__f")).alias("path"))

    return fixpoint(seed, step, ["root", "func"], label="paths")


def leaves(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of paths() that end at functions which call none."""
    return found.join(edges.select(F.col("caller").alias("func")).distinct(), "func", "left_anti")


def back_off(sliced: DataFrame, limit: int) -> DataFrame:
    """(root, depth, functions): for each root the largest depth at which its slice has fewer than limit functions."""
    by_depth = sliced.groupBy("root", "depth").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("root").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = by_depth.withColumn("functions", F.sum("n").over(upto)).filter(F.col("functions") < limit)
    return summed.groupBy("root").agg(F.max("depth").alias("depth"), F.max("functions").alias("functions"))


def callers(edges: DataFrame) -> DataFrame:
    """(callee, callers): how many functions call each."""
    return edges.groupBy("callee").agg(F.countDistinct("caller").alias("callers"))


def dead(functions: DataFrame, edges: DataFrame, address_taken: DataFrame | None = None) -> DataFrame:
    """Functions (column func) that nothing calls and whose address nothing takes."""
    out = functions.select("func").distinct().join(edges.select(F.col("callee").alias("func")), "func", "left_anti")
    return out if address_taken is None else out.join(address_taken.select("func"), "func", "left_anti")


def named_like(functions: DataFrame, parts: DataFrame) -> DataFrame:
    """Functions whose name contains one of the parts (column part, a short list of a file): blacklist, sinks, catalog names.

    One alternation is searched for instead of a join of all names with all parts; the list comes to the driver.
    """
    import re

    given = sorted({r.part for r in parts.select("part").distinct().collect() if r.part})
    if not given:
        return functions.limit(0)
    return functions.filter(F.col("func").rlike("|".join(re.escape(p) for p in given)))


def degrees(edges: DataFrame) -> DataFrame:
    """(top, mean, nodes): the largest and the mean number of calls out of a function, and how many functions call."""
    out = edges.groupBy("caller").agg(F.count("*").alias("n"))
    return out.agg(F.max("n").alias("top"), F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("nodes"))


def most_called(edges: DataFrame) -> DataFrame:
    """(callee, n): the function that most others call, the last of equal ones."""
    into = edges.groupBy("callee").agg(F.count("*").alias("n"))
    return into.agg(F.max_by("callee", F.struct("n", "callee")).alias("callee"), F.max("n").alias("n"))


def broad(edges: DataFrame, operands: DataFrame) -> DataFrame:
    """Calls (caller, callee) with the functions that stand as operands (func, operand) in a function's code, as arguments or in what it assigns: what broad
    slices follow too."""
    return edges.select("caller", "callee").unionByName(operands.select(F.col("func").alias("caller"), F.col("operand").alias("callee"))).distinct()


def saved_paths(edges: DataFrame, roots: DataFrame, max_depth: int, blacklist: DataFrame | None = None) -> DataFrame:
    """(root, func, depth, path, why) of paths() that a walk reports: at functions that call none (leaf), that call a blacklisted one (filtered), that call one
    reached already (visited), and at the greatest depth (depth)."""
    calls = edges.select("caller", "callee").distinct()
    kept = calls if blacklist is None else calls.join(blacklist.select(F.col("func").alias("callee")), "callee", "left_anti").select("caller", "callee")
    found = materialise(paths(kept, roots, max_depth), "paths")
    why = lambda df, name: df.select(*found.columns).distinct().withColumn("why", F.lit(name))
    # in the tree, a function's path is that of its caller and itself; other calls end at what is reached already
    tree = found.filter("depth > 0").select(F.col("root").alias("__r"), F.element_at("path", -2).alias("__u"), F.col("func").alias("__v"))
    ahead = found.filter(F.col("depth") < max_depth).join(kept, F.col("func") == F.col("caller"))
    again = ahead.join(tree, (F.col("root") == F.col("__r")) & (F.col("func") == F.col("__u")) & (F.col("callee") == F.col("__v")), "left_anti")
    out = why(leaves(found, calls), "leaf").unionByName(why(again, "visited"))
    out = out.unionByName(why(found.filter(F.col("depth") == max_depth).join(calls, F.col("func") == F.col("caller"), "left_semi"), "depth"))
    if blacklist is not None:
        into = calls.join(blacklist.select(F.col("func").alias("callee")), "callee", "left_semi")
        out = out.unionByName(why(found.join(into, F.col("func") == F.col("caller"), "left_semi"), "filtered"))
    return out
