"""Catalogs of function names: what external calls do, kernel allocation and locking, threads, system calls.

The lists are long and belong to the analysed system, so they are inputs: a file has one entry in each line, the name and its category (and, for
system calls, a group), separated by blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.functions.scalars import base_name
from rillgraph.operators.callgraph import named_like

#: Categories of external calls whose functions count as external although a definition is there.
EXTERNAL = ("ALLOC", "KALLOC", "REALLOC", "NOSTRUCT_ALLOC", "NOOP", "FREE", "KFREE", "KLOCK", "KUNLOCK")
#: The tests that a category passes.
TESTS = {"alloc": ("ALLOC", "KALLOC", "NOSTRUCT_ALLOC"), "dealloc": ("FREE", "KFREE"), "noop": ("NOOP",), "realloc": ("REALLOC",), "lock": ("KLOCK",), "unlock": ("KUNLOCK",), "static": ("STAT",)}


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, category, grp) of a catalog file; grp is null where lines have two words."""
    t = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("t")).filter(F.size("t").isin(2, 3) & ~F.get("t", F.lit(0)).startswith("#"))
    return t.select(*(F.get("t", F.lit(k)).alias(n) for k, n in enumerate(("name", "category", "grp")))).distinct()


def categorised(functions: DataFrame, known: DataFrame) -> DataFrame:
    """functions (func, is_decl, ...) with their category, by the name before its first dot, and is_ext."""
    one = known.groupBy("name").agg(F.min("category").alias("category"))
    both = functions.withColumn("__n", base_name(F.col("func"))).join(one, F.col("__n") == F.col("name"), "left").drop("__n", "name")
    intrinsic = F.col("func").startswith("llvm.")
    return both.withColumn("is_ext", F.col("is_decl") | intrinsic | F.coalesce(F.col("category").isin(*EXTERNAL), F.lit(False)))


def passes(category: Column, test: str) -> Column:
    """Whether a category passes a test of TESTS."""
    return F.coalesce(category.isin(*TESTS[test]), F.lit(False))


def declared(functions: DataFrame, known: DataFrame) -> DataFrame:
    """functions (func, is_decl): those whose name contains an allocation, release or lock of the catalog become declarations."""
    named = known.filter(F.col("category").isin("KALLOC", "KFREE", "KLOCK", "KUNLOCK")).select(F.col("name").alias("part"))
    hit = named_like(functions.select("func").distinct(), named).withColumn("__hit", F.lit(True))
    both = functions.join(hit, "func", "left")
    return both.withColumn("is_decl", F.col("is_decl") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def related(syscalls: DataFrame, name: str) -> DataFrame:
    """(name): system calls of the same group as the given one."""
    own = syscalls.filter(F.col("name") == name).select("grp").distinct()
    return syscalls.join(own, "grp", "left_semi").select("name").distinct()


def syscalls_of(syscalls: DataFrame, names: DataFrame) -> DataFrame:
    """(name, category, grp): the system calls (name, category, grp) that these functions (func) are, by the name behind a sys_ or compat_sys_ in front."""
    own = names.select(F.regexp_replace("func", r"^(__x64_|__se_|__do_)?(compat_)?sys_", "").alias("name")).distinct()
    return syscalls.withColumn("__n", F.regexp_replace("name", r"^(compat_)?sys_", "")).join(own.withColumnRenamed("name", "__n"), "__n", "left_semi").drop("__n")


def census(callsites: DataFrame, known: DataFrame) -> DataFrame:
    """(category, calls): how often each kind of catalog function is called (callsites: callee)."""
    named = callsites.withColumn("name", base_name(F.col("callee"))).join(known.select("name", "category").distinct(), "name")
    return named.groupBy("category").agg(F.count("*").alias("calls"))
