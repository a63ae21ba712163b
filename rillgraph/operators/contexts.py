"""Context reduction by set algebra: relevance, levels, grouping under a capacity, and the statistics of what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.operators import callgraph
from rillgraph.operators.fixpoint import closure
from rillgraph.sources.shared import materialise


def initcall_level(name: Column) -> Column:
    """The level that an initcall's global name ends with: early 0, rootfs 5, a digit (or a digit and s) itself, else 8."""
    last = F.element_at(F.split(name, "_initcall_?|__initcall_"), -1)
    tail = F.regexp_extract(last, r"(\d)s?$", 1)
    return F.when(last.endswith("early"), 0).when(last.endswith("rootfs"), 5).when(tail != "", tail.cast("int")).otherwise(8)


def relevant(initcalls: DataFrame, api: DataFrame) -> DataFrame:
    """Initcalls (context) that leave undefined some variable (member) which the API uses (member)."""
    return initcalls.join(api.select("member").distinct(), "member", "left_semi").select("context").distinct()


def irrelevant(initcalls: DataFrame, api: DataFrame) -> DataFrame:
    """The others."""
    return initcalls.select("context").distinct().join(relevant(initcalls, api), "context", "left_anti")


def undefined_below(uses: DataFrame, defines: DataFrame) -> DataFrame:
    """(context, level, member): uses that no strictly lower level defines (defines: level, member)."""
    least = defines.groupBy("member").agg(F.min("level").alias("__least"))
    return uses.join(least, "member", "left").filter("__least is null or __least >= level").select("context", "level", "member")


def merged(api: DataFrame, members: DataFrame, chosen: DataFrame, extra: list | None = None) -> DataFrame:
    """(member): the API's members (member) with those of the chosen contexts, and extra ones."""
    own = api.select("member").unionByName(members.join(chosen.select("context"), "context", "left_semi").select("member"))
    if extra:
        own = own.unionByName(api.sparkSession.createDataFrame([(x,) for x in extra], api.select("member").schema))
    return own.distinct()


def restricted(mapped: DataFrame, members: DataFrame) -> DataFrame:
    """(var, context, member): what a variable maps to (var, member), within each context's own members (context, member)."""
    return mapped.join(members.select("context", "member").distinct(), "member").select("var", "context", "member")


def totals(members: DataFrame) -> DataFrame:
    """(contexts, members, top_level): distinct counts and the highest level."""
    return members.agg(F.countDistinct("context").alias("contexts"), F.countDistinct("member").alias("members"), F.max("level").alias("top_level"))


def level_map(members: DataFrame) -> DataFrame:
    """(level, contexts, names): how many contexts each level has, and which, in order."""
    one = members.select("level", "context").distinct()
    return one.groupBy("level").agg(F.count("*").alias("contexts"), F.array_join(F.transform(F.sort_array(F.collect_set("context")), lambda x: x.cast("string")), ",").alias("names"))


def reduction(original: DataFrame, kept: DataFrame) -> DataFrame:
    """(context, original, relevant): members before and after."""
    a = original.groupBy("context").agg(F.countDistinct("member").alias("original"))
    b = kept.groupBy("context").agg(F.countDistinct("member").alias("relevant"))
    return a.join(b, "context", "left").select("context", "original", F.coalesce("relevant", F.lit(0)).alias("relevant"))


def grouped(members: DataFrame, capacity: int) -> DataFrame:
    """(level, context, group): first fit by order of contexts, a group of a level holding at most capacity distinct members.

    A context of more members than that has a group of its own. Filling in order is sequential within a level, as it is defined; only
    contexts and their members of one level meet in a task.
    """
    import pandas as pd

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        groups: list[set] = []
        out = []
        for context, own in rows.sort_values("context").groupby("context", sort=True):
            own = set(own["member"])
            for k, g in enumerate(groups):
                if len(g | own) <= capacity:
                    g |= own
                    break
            else:
                k = len(groups)
                groups.append(own)
            out.append((rows["level"].iloc[0], context, k))
        return pd.DataFrame(out, columns=["level", "context", "grp"])

    kinds = dict(members.dtypes)
    return members.select("level", "context", "member").distinct().groupBy("level").applyInPandas(fill, f"level {kinds['level']}, context {kinds['context']}, grp int")


def reduced(edges: DataFrame, roots: DataFrame, limit: int, max_depth: int, blacklist: DataFrame | None = None) -> DataFrame:
    """(root, func): the functions of each root's slice at the largest depth that keeps fewer than limit of them."""
    found = callgraph.slice_forward(edges, roots, max_depth, blacklist)
    depth = callgraph.back_off(found, limit).select("root", F.col("depth").alias("__d"))
    return found.join(depth, "root").filter(F.col("depth") <= F.col("__d")).select("root", "func")


def api_functions(functions: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    """Driver interface: functions (func, file, is_ext_linkage, address_taken, is_decl) of files that contain part, visible from outside and defined, that no
    other such function reaches by calls."""
    own = functions.filter(F.col("file").contains(part) & (F.col("is_ext_linkage") | F.col("address_taken")) & ~F.col("is_decl")).select("func").distinct()
    hop = edges.filter(F.col("caller") != F.col("callee"))
    called = callgraph.slice_forward(hop, own, 1000).filter("root <> func").select("func")
    return own.join(called, "func", "left_anti")


def refined(edges: DataFrame, roots: DataFrame, depth: int, indirect: Callable[[DataFrame], DataFrame], blacklist: DataFrame | None = None) -> DataFrame:
    """(root, func): a finer context. The slice over all calls is cut out, indirect calls (caller, callee) are resolved within it by a points-to analysis
    of its functions (func), and the slice is taken again over direct and resolved calls (edges: caller, callee, kind).

    All roots count, each with its own functions: a union where one call of the analysis after the other would overwrite the first.
    """
    coarse = callgraph.slice_forward(edges, roots, depth, blacklist).select("func").distinct()
    own = edges.join(coarse.withColumnRenamed("func", "caller"), "caller", "left_semi").join(coarse.withColumnRenamed("func", "callee"), "callee", "left_semi")
    resolved = indirect(coarse).select("caller", "callee")
    finer = own.filter("kind = 'direct'").select("caller", "callee").unionByName(resolved).distinct()
    return callgraph.slice_forward(finer, roots, depth, blacklist).select("root", "func")


def grouped_by_limit(members: DataFrame, limit: int) -> DataFrame:
    """(context, grp): as grouped(), without regard to levels."""
    return grouped(members.withColumn("level", F.lit(0)), limit).select("context", "grp")


def variable_functions(variables: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((var, func), (var, name)): the functions that handle a global variable, and the globals and heap objects that flow to where it does.

    Forward over the constraint graph's edges (src, dst, func) from each variable (var): functions of edges out of what is reached. From other
    predecessors of what is reached, backward: functions of edges into those, and names (node, name) of the objects met.
    """
    own = variables.select("var").distinct()
    reached = closure(edges, own.select(F.col("var").alias("src"))).select(F.col("src").alias("var"), F.col("dst").alias("node"))
    reached = materialise(reached.unionByName(own.select("var", F.col("var").alias("node"))).distinct(), "reached")
    ahead = reached.join(edges.select(F.col("src").alias("node"), "func"), "node").select("var", "func")
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("p"))
    other = reached.filter("node <> var").join(into, "node").select("var", F.col("p").alias("node")).distinct().join(reached, ["var", "node"], "left_anti")
    up = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), other.select(F.col("node").alias("src")).distinct())
    back = materialise(other.join(up, other["node"] == up["src"]).select("var", F.col("dst").alias("node")).unionByName(other.select("var", "node")).distinct(), "back")
    behind = back.join(edges.select(F.col("dst").alias("node"), "func"), "node").select("var", "func")
    return ahead.unionByName(behind).filter("func is not null").distinct(), back.join(names, "node").select("var", "name").distinct()


def with_callers(found: DataFrame, calls: DataFrame, initcalls: DataFrame) -> DataFrame:
    """(var, func) of found with the functions that lead to those by calls (caller, callee), up to initcalls (func), which are not passed."""
    up = callgraph.slice_backward(calls, found.select("func").distinct(), initcalls).select(F.col("root").alias("func"), F.col("func").alias("__f"))
    return found.select("var", "func").unionByName(found.join(up, "func").select("var", F.col("__f").alias("func"))).distinct()


def merged_maps(*maps: DataFrame) -> DataFrame:
    """The union of several groups' maps (var, func) or (var, name)."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.distinct()


def replaced(members: DataFrame, new: DataFrame) -> DataFrame:
    """members (context, level, member) with those of the contexts in new in their place."""
    return members.join(new.select("context").distinct(), "context", "left_anti").unionByName(new.select(*members.columns))


def group_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(level, grp, member): the members of a group's contexts, from the contexts as they are now (groups: level, context, grp)."""
    return groups.join(members.select("context", "member"), "context").select("level", "grp", "member").distinct()


def module_subset(functions: DataFrame, globals_: DataFrame, keep_functions: DataFrame, keep_globals: DataFrame, always_functions: list[str], always_globals: list[str]) -> tuple[DataFrame, DataFrame]:
    """Functions (func) and globals (name) of a module that are kept: those asked for and those never dropped."""
    def kept(given: DataFrame, chosen: DataFrame, key: str, always: list[str]) -> DataFrame:
        marked = given.join(chosen.select(key).distinct().withColumn("__k", F.lit(True)), key, "left")
        return marked.filter(F.col("__k").isNotNull() | F.col(key).isin(always)).drop("__k")

    return kept(functions, keep_functions, "func", always_functions), kept(globals_, keep_globals, "name", always_globals)
