"""Connected components of links between 64-bit nodes, by alternating large and small stars.

Every round moves links to smaller neighbours: first each node's larger neighbours are linked to its smallest one,
then its smaller ones. Stars of their components' smallest nodes remain. A node's smallest neighbour is found by a partial
minimum before the shuffle, and hubs are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v) after a large or a small star."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        moved = near.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        moved = links.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Of links (u, v), longs in any direction, repeats and loops allowed: a row (node, root) for each node that isn't
    its component's smallest, root being that. No links give no rows; links with a null are none."""
    links = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = table(links, "links")
    # equal sets of links have equal counts and sums of hashes
    state = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(links)
    while before[0]:
        links = table(_star(_star(links, True), False), "links")
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
