"""Ordered source-sink patterns: released twice, used after release, acquired twice, never released.

Items are rows (source, ord, node, role, field_ctx): what is reached from a source, in path order. On a straight line every later
item is reachable and every earlier one dominates, so a kill between two items is a change of the running count of
kills, and pairs are found by an equi-join on (source, count of kills) instead of all pairs. Where reachability is
a relation of its own, pairs() takes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epochs(items: DataFrame, kill: Column, by: list[str]) -> DataFrame:
    """items with epoch: how many kills stand before each in its group."""
    order = Window.partitionBy(*by).orderBy("ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("epoch", F.coalesce(F.sum(kill.cast("long")).over(before), F.lit(0)))


def _pairs(items: DataFrame, first: Column, second: Column, by: list[str]) -> DataFrame:
    a = items.filter(first).select(*by, "epoch", F.col("ord").alias("ord1"), F.col("node").alias("sink1"))
    b = items.filter(second).select(*by, "epoch", F.col("ord").alias("ord2"), F.col("node").alias("sink2"))
    return a.join(b, [*by, "epoch"]).filter("ord1 < ord2")


def double_free(items: DataFrame) -> DataFrame:
    """(source, sink1, sink2): two releases with no null store between, all such pairs."""
    marked = epochs(items, F.col("role") == "null_store", ["source"])
    release = F.col("role") == "dealloc"
    return _pairs(marked, release, release, ["source"]).select("source", "sink1", "sink2").distinct()


def use_after_free(items: DataFrame) -> DataFrame:
    """(source, sink1, sink2): each release and the first use behind it, no null store between."""
    marked = epochs(items, F.col("role") == "null_store", ["source"])
    rest = Window.partitionBy("source", "epoch").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    first = F.first(F.when(F.col("role") == "use", F.col("node")), ignorenulls=True).over(rest)
    found = marked.withColumn("sink2", first).filter((F.col("role") == "dealloc") & F.col("sink2").isNotNull())
    return found.select("source", F.col("node").alias("sink1"), "sink2")


def double_lock(items: DataFrame) -> DataFrame:
    """(source, field_ctx, sink1, sink2): two acquisitions of one field with no release of it between."""
    by = ["source", "field_ctx"]
    marked = epochs(items, F.col("role") == "unlock", by)
    lock = F.col("role") == "lock"
    return _pairs(marked, lock, lock, by).select(*by, "sink1", "sink2").distinct()


def never_freed(items: DataFrame) -> DataFrame:
    """(source, node): allocations of sources that no release follows."""
    freed = items.filter("role = 'dealloc'").select("source").distinct()
    return items.filter("role = 'alloc'").join(freed, "source", "left_anti").select("source", "node")


def partial_leaks(items: DataFrame, all_paths: DataFrame) -> DataFrame:
    """Sources released on some path but not on all (all_paths: column source)."""
    freed = items.filter("role = 'dealloc'").select("source").distinct()
    return freed.join(all_paths.select("source"), "source", "left_anti")


def pairs(items: DataFrame, reach: DataFrame, first: str, second: str, kill: str | None = None) -> DataFrame:
    """(source, sink1, sink2) over a reachability relation (a, b) of nodes.

    Sinks of the two roles in path order whose nodes are reachable, as long as no reachable kill comes before the second one.
    """
    a = items.filter(F.col("role") == first).select("source", F.col("ord").alias("o1"), F.col("node").alias("sink1"))
    b = items.select("source", F.col("ord").alias("o2"), F.col("node").alias("sink2"), F.col("role").alias("r2"))
    # along the relation, not over all pairs of a source
    onward = reach.select(F.col("a").alias("sink1"), F.col("b").alias("sink2")).distinct()
    both = a.join(onward, "sink1").join(b, ["source", "sink2"]).filter("o1 < o2")
    if kill is not None:
        stop = F.min(F.when(F.col("r2") == kill, F.col("o2"))).over(Window.partitionBy("source", "o1", "sink1"))
        both = both.withColumn("stop", stop).filter("stop is null or o2 < stop")
    return both.filter(F.col("r2") == second).select("source", "sink1", "sink2").distinct()


def first_new(found: DataFrame) -> DataFrame:
    """Of candidates (source, ord1, sink1, ord2, sink2), what a scan reports that, for each first sink, stops at the first pair not
    reported before, in order of source, first and second sink."""
    import pandas as pd

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        seen, out = set(), []
        for (o, _), rows in group.sort_values(["ord1", "sink1", "ord2", "sink2"]).groupby(["ord1", "sink1"], sort=True):
            for r in rows.itertuples():
                if (r.sink1, r.sink2) not in seen:
                    seen.add((r.sink1, r.sink2))
                    out.append((r.source, r.sink1, r.sink2))
                    break
        return pd.DataFrame(out, columns=["source", "sink1", "sink2"])

    return found.groupBy("source").applyInPandas(scan, "source long, sink1 long, sink2 long")
