"""Mixing sources to target weights by Efraimidis-Spirakis sampling, by built-in functions only.

Each document gets the exponential key -ln(u) / quality, u a hash of its id. Within a source, documents in
order of key are taken until their sizes reach what the target leaves after complete epochs. The order is cut
into buckets of equal probability: of a source's documents the share p has weight 1 and the rest LESS, so a key is above k
with probability p exp(-k) + (1 - p) exp(-LESS k). Prefix sums of a source of any size so run in many even tasks: sums of
buckets first, then sums within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.llm.common import SPACE, table, words

#: Sources in order of their names weigh this, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own size.
MAX_EPOCHS = 3
#: Documents of a source that one bucket of keys holds, about.
BUCKET_ROWS = 8192
SEED = "mix"
#: The quality weight of documents that look less like prose.
LESS = 0.25


def quality(size: Column, text: Column) -> Column:
    """The document's quality weight: 1 for 50 words or more of 3 to 10 characters on average, else LESS."""
    chars = F.length(F.translate(text, SPACE, ""))
    return F.when((size >= 50) & (chars >= 3 * size) & (chars <= 10 * size), 1.0).otherwise(LESS)


def targets(sources: DataFrame) -> DataFrame:
    """sources (__src, n, p, source_size) with target: the total shared by weight, none above MAX_EPOCHS times its size.

    The sum of min(cap, level * weight) is the total at one level: the largest that any source reached
    would see if all with a smaller cap for their weight were full. One row for each source goes to one task.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("__src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("double")
    s = sources.withColumn("w", weight).withColumn("cap", (MAX_EPOCHS * F.col("source_size")).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = everything.orderBy("ratio", F.col("__src").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    s = s.withColumn("top", F.max("level").over(everything))
    return s.select("__src", "n", "p", "source_size", F.least("cap", F.col("top") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: id, size, source_size, target, taken (its size times the copies that the mix takes).

    A null text has size 0 and is taken 0 times. A null source is a source of its own, last in order. A null id has a
    key like any other; rows of equal ids have equal keys and follow each other. No rows give no rows. Texts of any length are
    counted whole, where they lie. Other columns are not read, whatever their names.
    The document in which the rest of a target ends is taken if at least its half fits.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sized = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__src"), text.alias("__t"))
    sized = sized.select("__id", "__src", "__t", F.size(words(F.col("__t"))).cast("long").alias("size"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("__id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (drawn.cast("double") + 0.5) / float(1 << 52)
    sized = sized.select("__id", "__src", "size", u.alias("u"), quality(F.col("size"), F.col("__t")).alias("w"))
    sized = table(sized.select("__id", "__src", "size", "w", (-F.log("u") / F.col("w")).alias("key")), "sizes")

    full = F.avg((F.col("w") == 1).cast("double"))
    sources = targets(sized.groupBy("__src").agg(F.count("*").alias("n"), full.alias("p"), F.sum("size").alias("source_size")))
    sources = sources.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS)).withColumnRenamed("__src", "__s")
    sources = table(sources, "sources")
    placed = sized.join(sources.select("__s", "buckets", "p"), F.col("__src").eqNullSafe(F.col("__s"))).drop("__s")
    above = F.col("p") * F.exp(-F.col("key")) + (1 - F.col("p")) * F.exp(-LESS * F.col("key"))
    bucket = F.least(F.floor((1 - above) * F.col("buckets")), F.col("buckets") - 1).cast("long")
    placed = placed.select("__id", "__src", "size", "key", bucket.alias("bucket"))
    sums = placed.groupBy("__src", "bucket").agg(F.sum("size").alias("sum"))
    over = Window.partitionBy("__src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(over), F.lit(0))).join(sources, F.col("__src").eqNullSafe(F.col("__s")))
    sums = sums.select(F.col("__s"), F.col("bucket").alias("__b"), "base", "source_size", "target")
    within = Window.partitionBy("__src", "bucket").orderBy("key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = summed.join(sums, F.col("__src").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    more = (epochs < MAX_EPOCHS) & (F.col("base") + F.col("before") + F.col("size") / 2 <= rest)
    return summed.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("size") * (epochs + more.cast("long"))).alias("taken"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each copy taken, none for documents not taken, with their own columns.

    Rows of equal ids are one document: each is taken as often as that of them which is taken most. Null and empty texts have size 0
    and are not taken; no rows give no rows.
    """
    taken = mix(docs, id_col, text_col, source_col).withColumnRenamed(id_col, "__i")
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    copies = taken.select("__i", copies.alias("__n")).groupBy("__i").agg(F.max("__n").alias("__n")).filter("__n > 0")
    named = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{id_col}`").alias("__id"))
    both = given.join(copies, F.col("__id").eqNullSafe(F.col("__i")))
    return both.select("__row", F.explode(F.sequence(F.lit(1), "__n"))).select(*named)
