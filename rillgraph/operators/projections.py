"""Projections of program facts: which globals, objects and functions matter, and where nodes are in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.operators.fixpoint import fixpoint


def structured_globals(globals_: DataFrame, types: DataFrame, fields: DataFrame) -> DataFrame:
    """globals (node, type) whose type is a pointer to a struct or array, or a struct that holds a pointer.

    types: (type, kind in pointer, struct, array, other; of: what a pointer points to); fields: (type, ix, field_type) of structs. A struct holds a pointer
    if a field is one; of its nested structs only the first is looked into, and the first of that one, and so on.
    """
    kinds = types.select("type", "kind", "of")
    kind = lambda c: kinds.select(F.col("type").alias(c), F.col("kind").alias("__k"))
    to = kinds.filter("kind = 'pointer'").join(kind("of"), "of").filter("__k in ('struct', 'array')").select("type")
    held = fields.join(kind("field_type"), "field_type")
    first = held.filter("__k = 'struct'").groupBy("type").agg(F.min_by("field_type", "ix").alias("__f"))
    nested = first.withColumnsRenamed({"type": "__t"})
    seed = held.filter("__k = 'pointer'").select("type").distinct()
    pointed = fixpoint(seed, lambda new, _: new.join(nested, new["type"] == nested["__f"]).select(F.col("__t").alias("type")), label="structs")
    return globals_.join(to.unionByName(pointed).distinct(), "type", "left_semi").select(*globals_.columns)


def pointer_objects(objects: DataFrame) -> DataFrame:
    """objects (obj, is_const, is_blackhole, has_pointer) that inclusion analysis follows: no constants, no unknown memory, none without pointers."""
    return objects.filter(~F.col("is_const") & ~F.col("is_blackhole") & F.col("has_pointer"))


def places(nodes: DataFrame, locs: DataFrame) -> DataFrame:
    """nodes (node, ...) with file_name, func_name, line, var_name of locs (node, ...); Unknown, Unknown, 0, no Name where there is none."""
    own = locs.select("node", "file_name", "func_name", "line", "var_name")
    default = {"file_name": "Unknown", "func_name": "Unknown", "line": 0, "var_name": "no Name"}
    both = nodes.join(own, "node", "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in default.items()})


def resolved_names(functions: DataFrame, aliases: DataFrame) -> DataFrame:
    """functions (func, ...) with target: the function that an alias (alias, target) stands for, else its own name."""
    return functions.join(aliases.select(F.col("alias").alias("func"), "target"), "func", "left").withColumn("target", F.coalesce("target", "func"))


def objects_of(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Global and heap objects, and stack objects, of objects (obj, kind, is_dummy, is_field); dummies and fields are in neither."""
    whole = objects.filter(~F.col("is_dummy") & ~F.col("is_field"))
    return whole.filter("kind in ('global', 'heap')"), whole.filter("kind = 'stack'")


def edge_functions(edges: DataFrame, insts: DataFrame) -> DataFrame:
    """edges (edge, inst, ext_callee) with func: the external function that a call edge is of, else the one around its instruction (inst, func)."""
    return edges.join(insts.select("inst", "func"), "inst", "left").withColumn("func", F.coalesce("ext_callee", "func"))


def stack_sources(nodes: DataFrame, api: DataFrame, edges: DataFrame, light: bool = False) -> DataFrame:
    """(node): stack objects (node, func, name, is_param) of the interface's functions (func) that something uses (edges: src) and that are no
    parameters; the light query leaves out names with arg in them too."""
    own = nodes.filter(~F.col("is_param")).join(api.select("func").distinct(), "func", "left_semi")
    if light:
        own = own.filter(~F.contains(F.coalesce("name", F.lit("")), F.lit("arg")))
    return own.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("node")
