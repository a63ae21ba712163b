"""Quality rules with host-level verdicts, by built-in functions only.

Each document's rule failures are found in its own row, without a shuffle. Failures are then counted
by host (partial sums before the shuffle, so a host with a third of all rows is no hot key), host
rates are shrunk towards an empirical beta prior, and the verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import SPACE, table, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host whose shrunk failure rate is above this loses all its documents.
HOST_RATE = 0.5
#: Bounds of the prior's strength in documents.
STRENGTH = (1.0, 1000.0)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """The documents' measures as columns __id, __host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and base_failed; with carry, instead the documents' own columns with __host and __failed.

    A null text has no words, an empty one neither; both fail. Rows are judged one by one, so equal ids do not matter,
    and columns of the same names as the measures do not clash: they are not read.
    """
    own = [F.col(f"`{c}`") for c in docs.columns] if carry else []
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    if carry:
        base = docs.select(F.struct(*own).alias("__row"), F.col(f"`{host_col}`").alias("__host"), text.alias("__text"))
        kept = ["__row", "__host"]
    else:
        base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{host_col}`").alias("__host"), text.alias("__text"))
        kept = ["__id", "__host"]
    base = base.select(*kept, "__text", words(F.col("__text")).alias("__w"))
    n = F.size("__w")
    window = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    base = base.select(*kept, "__text", "__w", F.when(n >= 4, window).otherwise(F.array().cast("array<bigint>")).alias("__h"))
    base = base.select(*kept, "__text", "__w", "__h", (F.size(F.array_distinct("__h")) < F.size("__h")).alias("__again"))
    # windows in order of hash and place; only texts in which some window recurs need them
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.select(*kept, "__text", "__w", F.when(F.col("__again"), placed).alias("__s"))
    equal = lambda x, j: F.get("__s", j)["h"] == x["h"]
    twice = F.filter("__s", lambda x, j: F.coalesce(equal(x, j - 1), F.lit(False)) | F.coalesce(equal(x, j + 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    repeats = F.when(F.col("__s").isNull(), 0).otherwise(F.size(covered)).cast("long")
    base = base.select(*kept, "__text", F.size("__w").cast("long").alias("n_words"), repeats.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    if carry:
        # a generated column: filters on it stay above, while those on a plain one would be taken apart into the windows' lambdas
        return base.select("__row", "__host", F.explode(F.array(failed)).alias("__failed"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return base.select(
        *kept,
        "n_words",
        F.length(F.translate("__text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(lines).alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
    )


def dup_lines(lines: Column) -> Column:
    """How many of the lines equal an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def counts(measures: DataFrame, failed: str) -> DataFrame:
    """A row for each host: its documents and how many of them fail. A null host is a host of its own."""
    return measures.groupBy("__host").agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("int")).alias("f"))


def rejected_hosts(hosts: DataFrame) -> DataFrame:
    """Those of counts() whose shrunk failure rate is above HOST_RATE, as __bad_host, with __bad true.

    The prior beta(m * s, (1 - m) * s) is fitted to the hosts' rates by moments: m their mean, s from their variance,
    within STRENGTH. Its two numbers are all that comes to the driver.
    """
    rate = F.col("f") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m = m or 0.0
    s = min(max(m * (1 - m) / v - 1, STRENGTH[0]), STRENGTH[1]) if v else STRENGTH[1]
    shrunk = (F.col("f") + F.lit(m * s)) / (F.col("n") + F.lit(s))
    return hosts.filter(shrunk > HOST_RATE).select(F.col("__host").alias("__bad_host"), F.lit(True).alias("__bad"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document: id, measures, base_failed and kept. An empty table gives no rows."""
    measures = table(measured(docs, id_col, text_col, host_col), "quality")
    bad = rejected_hosts(counts(measures, "base_failed"))
    judged = measures.join(bad, F.col("__host").eqNullSafe(F.col("__bad_host")), "left")
    return judged.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("__bad").isNull()).alias("kept"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, with their own columns, whatever their names.

    A null or empty text has no words and fails. Rows of equal ids are judged each by its own text, and each counts for its host; a null host is a host of its
    own. Texts are measured whole, where they lie, however long. An empty table stays empty.
    The measures are taken twice, once for the hosts' counts and once for the rows kept: texts are never shuffled
    unless the rejected hosts are too many to broadcast.
    """
    bad = rejected_hosts(table(counts(measured(docs, id_col, text_col, host_col, carry=True), "__failed"), "hosts"))
    passed = measured(docs, id_col, text_col, host_col, carry=True).filter(~F.col("__failed"))
    return passed.join(bad, F.col("__host").eqNullSafe(F.col("__bad_host")), "left_anti").select("__row.*")
