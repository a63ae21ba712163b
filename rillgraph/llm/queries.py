"""The operators' queries over whole tables, as the driver runs them, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import fingerprint, lines, mixing, packing, prefix, quality, simhash, sql, superkmers, tokens, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to bit-packed files and read back."""
    return tokens.read(tokens.write(_documents(spark, sf_dir)))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.compared(_documents(spark, sf_dir))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in many documents dropped from all of them."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    cut = lines.applied(docs, lines.bitmaps(docs))
    return cut.select("__row.doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights."""
    return mixing.mix(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, equal payloads once, and read back."""
    return warc.read(warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of every document."""
    return simhash.grouped(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and verdicts of every document."""
    return quality.verdicts(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences."""
    return packing.packed(_documents(spark, sf_dir))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of words removed from every document."""
    found = superkmers.removed(_documents(spark, sf_dir))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of bytes removed from every document."""
    found = prefix.removed(_documents(spark, sf_dir))
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_fingerprints": op2_fingerprints,
    "op3_lines": op3_lines,
    "op4_mix": op4_mix,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_suffixes": op10_suffixes,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their DuckDB SQL by name."""
    return dict(sql.ORACLES)
