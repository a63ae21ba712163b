"""Checker and call-graph queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.operators import callgraph, pointsto, typestate
from rillgraph.plans import lenses
from rillgraph.plans.lenses import CALLS, COPIES, ITEMS, LOCKS

DEPTH = 4


def _roots(spark, sf_dir, below=3):
    return lenses.calls(spark, sf_dir).filter(F.col("caller") < below).select(F.col("caller").alias("func")).distinct()


def _sliced(spark, sf_dir, depth=DEPTH):
    return callgraph.slice_forward(lenses.calls(spark, sf_dir), _roots(spark, sf_dir), depth)


def _text_path(df):
    return df.select("root", "func", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


QUERIES = {
    "c1_double_free": lambda s, d: typestate.double_free(lenses.items(s, d)),
    "c2_use_after_free": lambda s, d: typestate.use_after_free(lenses.items(s, d)),
    "c3_double_lock": lambda s, d: typestate.double_lock(lenses.locks(s, d)),
    "c4_never_freed": lambda s, d: typestate.never_freed(lenses.items(s, d)),
    "x11_callers": lambda s, d: callgraph.callers(lenses.calls(s, d)),
    "x13_slice_forward": _sliced,
    "x13_slice_blacklist": lambda s, d: callgraph.slice_forward(
        lenses.calls(s, d), _roots(s, d), DEPTH, lenses.calls(s, d).filter("callee % 7 = 0").select(F.col("callee").alias("func")).distinct()
    ),
    "x14_slice_backward": lambda s, d: callgraph.slice_backward(
        lenses.calls(s, d), s.createDataFrame([(51,)], "func long"), lenses.calls(s, d).filter("caller % 5 = 0").select(F.col("caller").alias("func")).distinct()
    ).select("root", "func"),
    "x15_paths": lambda s, d: _text_path(callgraph.paths(lenses.calls(s, d), _roots(s, d, 1), 3)),
    "x17_actual_depth": lambda s, d: _sliced(s, d).groupBy("root").agg(F.max("depth").alias("depth")),
    "rd_back_off": lambda s, d: callgraph.back_off(_sliced(s, d, 6), 40),
    "p6_dead_functions": lambda s, d: callgraph.dead(lenses.calls(s, d).select(F.col("caller").alias("func")), lenses.calls(s, d)),
    "x3_copy_points_to": lambda s, d: _points_to(s, d),
}


def _points_to(spark, sf_dir):
    """(var, obj) from addresses along copies: what is new moves on, no variable's copies are closed that nothing points from."""
    seed = lenses.addresses(spark, sf_dir).select(F.col("ptr").alias("var"), "obj")
    return pointsto.propagate(seed, lenses.copies(spark, sf_dir))


_SLICE = f"""
{CALLS},
walk AS (
  SELECT DISTINCT caller AS root, caller AS func, 0 AS depth FROM calls WHERE caller < 3
  UNION
  SELECT root, callee, depth + 1 FROM walk JOIN calls ON func = caller WHERE depth < %d),
sliced AS (SELECT root, func, min(depth) AS depth FROM walk GROUP BY root, func)"""

ORACLES = {
    "c1_double_free": f"""
WITH {ITEMS}
SELECT DISTINCT a.source, a.node AS sink1, b.node AS sink2 FROM items a JOIN items b ON a.source = b.source AND a.ord < b.ord
WHERE a.role = 'dealloc' AND b.role = 'dealloc'
  AND NOT EXISTS (SELECT 1 FROM items k WHERE k.source = a.source AND k.role = 'null_store' AND k.ord > a.ord AND k.ord < b.ord)""",
    "c2_use_after_free": f"""
WITH {ITEMS},
firsts AS (
  SELECT a.source, a.node AS sink1, a.ord, (SELECT min(b.ord) FROM items b WHERE b.source = a.source AND b.ord > a.ord AND b.role = 'use') AS u,
    (SELECT min(k.ord) FROM items k WHERE k.source = a.source AND k.ord > a.ord AND k.role = 'null_store') AS stop
  FROM items a WHERE a.role = 'dealloc')
SELECT f.source, f.sink1, i.node AS sink2 FROM firsts f JOIN items i ON i.source = f.source AND i.ord = f.u WHERE f.stop IS NULL OR f.u < f.stop""",
    "c3_double_lock": f"""
WITH {LOCKS}
SELECT DISTINCT a.source, a.field_ctx, a.node AS sink1, b.node AS sink2
FROM locks a JOIN locks b ON a.source = b.source AND a.field_ctx = b.field_ctx AND a.ord < b.ord
WHERE a.role = 'lock' AND b.role = 'lock' AND NOT EXISTS (
  SELECT 1 FROM locks k WHERE k.source = a.source AND k.field_ctx = a.field_ctx AND k.role = 'unlock' AND k.ord > a.ord AND k.ord < b.ord)""",
    "c4_never_freed": f"""
WITH {ITEMS}
SELECT source, node FROM items a WHERE role = 'alloc' AND NOT EXISTS (SELECT 1 FROM items b WHERE b.source = a.source AND b.role = 'dealloc')""",
    "x11_callers": f"WITH {CALLS} SELECT callee, count(DISTINCT caller) AS callers FROM calls GROUP BY callee",
    "x13_slice_forward": f"WITH RECURSIVE {_SLICE % DEPTH} SELECT * FROM sliced",
    "x13_slice_blacklist": f"""
WITH RECURSIVE {CALLS},
walk AS (
  SELECT DISTINCT caller AS root, caller AS func, 0 AS depth FROM calls WHERE caller < 3
  UNION
  SELECT root, callee, depth + 1 FROM walk JOIN calls ON func = caller WHERE depth < {DEPTH} AND callee % 7 <> 0)
SELECT root, func, min(depth) AS depth FROM walk GROUP BY root, func""",
    "x14_slice_backward": f"""
WITH RECURSIVE {CALLS},
walk AS (
  SELECT 51::BIGINT AS root, 51::BIGINT AS func
  UNION
  SELECT root, caller FROM walk JOIN calls ON func = callee WHERE func NOT IN (SELECT caller FROM calls WHERE caller % 5 = 0))
SELECT DISTINCT root, func FROM walk""",
    "x15_paths": f"""
WITH RECURSIVE {CALLS},
walk AS (
  SELECT DISTINCT caller AS root, caller AS func, 0 AS depth, [caller] AS path FROM calls WHERE caller < 1
  UNION ALL
  SELECT root, callee, depth + 1, list_append(path, callee) FROM walk JOIN calls ON func = caller WHERE depth < 3),
best AS (SELECT *, row_number() OVER (PARTITION BY root, func ORDER BY depth, path) AS r FROM walk)
SELECT root, func, depth, array_to_string(path, '>') AS path FROM best WHERE r = 1""",
    "x17_actual_depth": f"WITH RECURSIVE {_SLICE % DEPTH} SELECT root, max(depth) AS depth FROM sliced GROUP BY root",
    "rd_back_off": f"""
WITH RECURSIVE {_SLICE % 6},
upto AS (SELECT DISTINCT root, depth, count(*) OVER (PARTITION BY root ORDER BY depth) AS functions FROM sliced)
SELECT root, max(depth) AS depth, max(functions) AS functions FROM upto WHERE functions < 40 GROUP BY root""",
    "p6_dead_functions": f"WITH {CALLS} SELECT DISTINCT caller AS func FROM calls WHERE caller NOT IN (SELECT callee FROM calls)",
    "x3_copy_points_to": f"""
WITH RECURSIVE {COPIES},
pts AS (SELECT ptr AS var, obj FROM addr UNION SELECT dst, obj FROM pts JOIN copies ON var = src)
SELECT DISTINCT var, obj FROM pts""",
}
