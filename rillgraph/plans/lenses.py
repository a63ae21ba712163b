"""Deterministic views of the driver's tables as program facts, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: (source, ord, node, role, field_ctx), a source for each user's stretch from one signup to the next: the user's number times 2^32 and the stretch's."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    segment = F.sum((F.col("event_type") == "signup").cast("long")).over(by_user.rowsBetween(Window.unboundedPreceding, 0))
    roles = F.create_map(*(F.lit(x) for x in ("signup", "alloc", "purchase", "dealloc", "error", "null_store", "click", "use", "view", "other")))
    e = e.select((F.col("user_id") * 2**32 + segment).cast("long").alias("source"), F.row_number().over(by_user).alias("ord"), F.col("event_id").alias("node"), roles[F.col("event_type")].alias("role"))
    return e.withColumn("field_ctx", F.lit(0))


ITEMS = """
items AS (
  SELECT CAST(user_id * 4294967296 + sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS source,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id AS node,
    CASE event_type WHEN 'signup' THEN 'alloc' WHEN 'purchase' THEN 'dealloc' WHEN 'error' THEN 'null_store' WHEN 'click' THEN 'use' ELSE 'other' END AS role
  FROM events)"""


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 for locks: a source for each user, views acquire and clicks release the field k % 4."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    role = F.when(F.col("event_type") == "view", "lock").when(F.col("event_type") == "click", "unlock").otherwise("other")
    ctx = (F.get_json_object("props", "$.k").cast("int") % 4).alias("field_ctx")
    return e.select(F.col("user_id").alias("source"), F.row_number().over(by_user).alias("ord"), F.col("event_id").alias("node"), role.alias("role"), ctx)


LOCKS = """
locks AS (
  SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id AS node,
    CASE event_type WHEN 'view' THEN 'lock' WHEN 'click' THEN 'unlock' ELSE 'other' END AS role,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 4 AS field_ctx
  FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: (caller, callee): suppliers are functions, and an order whose first line is of two pieces or less is a call; as many functions as suppliers."""
    l = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_quantity <= 2")  # noqa: E741
    n = read(spark, sf_dir, "supplier").count()
    return l.select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % n).alias("callee")).distinct()


CALLS = "calls AS (SELECT DISTINCT l_suppkey AS caller, mod(l_partkey, (SELECT count(*) FROM supplier)) AS callee FROM lineitem WHERE l_linenumber = 1 AND l_quantity <= 2)"


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: (node), every function: the numbers from 0 to that of the suppliers."""
    n = read(spark, sf_dir, "supplier").count()
    return spark.range(n + 1).select(F.col("id").alias("node"))


FUNCTIONS = "functions AS (SELECT range AS node FROM range((SELECT count(*) + 1 FROM supplier)))"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: (obj, ptr), the part of an order's first line."""
    l = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1")  # noqa: E741
    return l.select(F.col("l_partkey").alias("obj"), F.col("l_orderkey").alias("ptr")).distinct()


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: (obj, ptr), the part of an order's first line as a memory cell of the order's customer, who has 16."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ptr"), "o_custkey")
    return addresses(spark, sf_dir).join(o, "ptr").select((F.lit(10**12) + F.col("o_custkey") * 16 + F.col("obj") % 16).alias("obj"), "ptr").distinct()


CELLS = "cells AS (SELECT DISTINCT 1000000000000 + o_custkey * 16 + obj % 16 AS obj, ptr FROM addr JOIN orders ON o_orderkey = ptr)"


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: (src, dst), each order of a customer and the next one."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("src"), following.alias("dst")).filter("dst is not null")


COPIES = """
copies AS (
  SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL),
addr AS (SELECT DISTINCT l_partkey AS obj, l_orderkey AS ptr FROM lineitem WHERE l_linenumber = 1)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: (bug_id, version, api_name, type, status, duration), a bug for each order."""
    status = F.create_map(*(F.lit(x) for x in ("F", "False", "O", "NotChecked", "P", "Positive")))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("bug_id"), F.year("o_orderdate").alias("version"), F.concat(F.lit("api_"), F.col("o_custkey").cast("string")).alias("api_name"),
        F.substring("o_orderpriority", 1, 1).alias("type"), status[F.col("o_orderstatus")].alias("status"), F.col("o_totalprice").alias("duration"),
    )


REPORTS = """
reports AS (
  SELECT o_orderkey AS bug_id, CAST(year(o_orderdate) AS INT) AS version, 'api_' || CAST(o_custkey AS VARCHAR) AS api_name, substr(o_orderpriority, 1, 1) AS type,
    CASE o_orderstatus WHEN 'F' THEN 'False' WHEN 'O' THEN 'NotChecked' WHEN 'P' THEN 'Positive' END AS status, o_totalprice AS duration
  FROM orders)"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5: (context, level, member), a context for each supplier with the parts that it supplies, its nation being its level."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("context"), F.col("l_partkey").alias("member")).distinct()  # noqa: E741
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("context"), F.col("s_nationkey").alias("level"))
    return l.join(s, "context").select("context", "level", "member")


CONTEXTS = """
ctx AS (
  SELECT DISTINCT l_suppkey AS context, s_nationkey AS level, l_partkey AS member
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def psets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6: (pset, obj), the parts of each order, modulo 500."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pset"), (F.col("l_partkey") % 500).alias("obj")).distinct()


PSETS = "psets AS (SELECT DISTINCT l_orderkey AS pset, l_partkey % 500 AS obj FROM lineitem)"
