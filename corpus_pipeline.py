"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, packing, each over all that the stage before kept."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from rillgraph.llm import common, lines, mixing, near, packing, quality


#: What the stage before left in the shared folder; when this thread's next one starts, its result is written and this can go.
_left = threading.local()


def _stage(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage's function of (spark, docs, sf_dir)."""

    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.sweep(getattr(_left, "made", []))
        common.settle(spark)  # and the shuffle files of stages before
        start = list(common.made)
        out = f(docs)
        _left.made = [x for x in common.made if x not in start]
        return out

    return step


def _line_dedup(docs: DataFrame) -> DataFrame:
    """Lines found in many documents go from all of them, but for documents that would lose most of their text: those are copies, of which near dedup
    leaves one."""
    return lines.deduped(docs, copies=0.5)


#: Name and function of each stage; a function's result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality_rules", _stage(quality.keep)),  # documents that fail a rule, or whose host fails, go
    ("line_dedup", _stage(_line_dedup)),  # lines found in many documents go from all of them
    ("near_dedup", _stage(near.one_of_each)),  # of each group of near copies (five words, similarity 0.8) one stays
    ("mixing", _stage(mixing.sampled)),  # a row for each copy that the mix takes
    ("packing", _stage(packing.packed)),  # where each piece lies in which sequence
]

#: Tokens, fingerprints' mixing and the packing are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        made = stage[1](spark, docs, sf_dir)
        path = common.scratch(spark, stage[0])
        made.write.parquet(path)
        return spark.read.schema(made.schema).parquet(path)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
