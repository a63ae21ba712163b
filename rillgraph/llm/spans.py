"""Spans of repeated windows in documents: how they are kept, joined to texts and taken out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import likely, settle, small_batches

SPANS = "doc long, tie long, spans binary"
#: Stands for a null id, which comes before all others.
NULL_ID = -(1 << 63)


def _keys(docs: DataFrame, id_col: str, text_col: str, unique: bool) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tie = F.lit(0).cast("long") if unique else F.xxhash64(text)
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc"), tie.alias("tie"), text.alias("text")


def _unique(docs: DataFrame, id_col: str) -> bool:
    """Whether no id is repeated; else documents are told apart by their texts' hashes too."""
    return docs.groupBy(F.col(f"`{id_col}`").alias("i")).count().filter("count > 1").isEmpty()


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, text) of each row, which go to Python in small batches. Shuffle files of what has ended before go first."""
    settle(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select(*_keys(docs, id_col, text_col, _unique(docs, id_col)))


def joined(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, list of spans or null) of each row."""
    each = found.groupBy("doc", "tie").agg(F.collect_list("spans").alias("spans")).withColumnsRenamed({"doc": "d", "tie": "t"})
    texts = identified(docs, id_col, text_col)
    both = texts.join(each, (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return both.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc"), "text", "spans")


def only(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, tie, text, list of spans) of those of identified() that have spans."""
    each = found.groupBy("doc", "tie").agg(F.collect_list("spans").alias("spans")).withColumnsRenamed({"doc": "d", "tie": "t"})
    few = likely(texts, F.col("doc"), found.select("doc").distinct())
    both = few.join(each, (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t")))
    return both.select("doc", "tie", "text", "spans")


def of_places(docs: np.ndarray, ties: np.ndarray, places: np.ndarray) -> pa.Table:
    """SPANS of single places; spans are pairs (first, end) of runs as 64-bit integers."""
    order = np.lexsort((places, ties, docs))
    docs, ties, places = docs[order], ties[order], places[order]
    other = np.ones(len(docs), bool)
    other[1:] = (docs[1:] != docs[:-1]) | (ties[1:] != ties[:-1])
    new = other.copy()
    new[1:] |= places[1:] > places[:-1] + 1
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(docs))[: len(first)] - 1
    pairs = np.stack([places[first], places[last] + 1], axis=1).astype("<i8")
    heads = np.nonzero(other[first])[0]
    edges = np.append(heads, len(first))
    return pa.table({
        "doc": pa.array(docs[first[heads]], pa.int64()),
        "tie": pa.array(ties[first[heads]], pa.int64()),
        "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()),
    })


def staying(found: list[bytes] | None, n: int, window: int) -> np.ndarray:
    """Which of n units no window of the spans covers."""
    if not found:
        return np.ones(n, bool)
    pairs = np.concatenate([np.frombuffer(x, "<i8") for x in found]).reshape(-1, 2)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, pairs[:, 1] + window - 1, -1)
    return np.cumsum(steps[:n]) == 0
