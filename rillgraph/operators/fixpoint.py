"""The semi-naive fixpoint driver: recursion over relations as a loop of joins on what the last round added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.operators import small
from rillgraph.sources.shared import drop, materialise, new_path

#: Rounds whose tables are merged into one: what is known is read from as many files at most.
COMPACT = 16


def fixpoint(
    seed: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    key: list[str] | None = None,
    max_rounds: int | None = None,
    label: str = "fixpoint",
    known: DataFrame | None = None,
) -> DataFrame:
    """All rows that seed and step lead to, and those known before, whose consequences are known too.

    step(delta, full) gives candidate rows from those that the last round added (delta) and all so far (full). Rows whose key (all
    columns by default) is known are no news; of several with one key, that with the smallest other columns is taken, so that
    results do not depend on the order of rows. Every round is a Parquet table in the shared folder and full is all of
    them, merged every COMPACT rounds, so neither plans nor lineage nor lists of files grow. Recursions over growing values need not end:
    max_rounds makes that an error, and nothing is returned in part.
    """
    spark, key = seed.sparkSession, key or seed.columns
    rest = [c for c in seed.columns if c not in key]

    def distinct(df: DataFrame) -> DataFrame:
        df = df.select(*seed.columns)
        if not rest:
            return df.distinct()
        best = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__best"))
        return best.select(*key, "__best.*").select(*seed.columns)

    root, paths, rounds = new_path(spark, label), [], 0

    def read(*where: str) -> DataFrame:
        return spark.read.schema(seed.schema).parquet(*where)

    def written(df: DataFrame) -> DataFrame:
        nonlocal rounds
        path = f"{root}/round={rounds:05d}"
        rounds += 1
        df.write.parquet(path)
        paths.append(path)
        return read(path)

    start = distinct(seed)
    if known is not None:
        written(known.select(*seed.columns))
        start = start.join(read(*paths).select(*key), key, "left_anti").select(*seed.columns)
    delta = written(start)
    while not delta.isEmpty():
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        if len(paths) > COMPACT:
            old = paths[:-1]
            merged = f"{root}/merged={rounds:05d}"
            read(*old).write.parquet(merged)
            paths[:-1] = [merged]
            for path in old:
                drop(spark, path)
        full = read(*paths)
        delta = written(distinct(step(delta, full)).join(full.select(*key), key, "left_anti").select(*seed.columns))
    return read(*paths)


def closure(edges: DataFrame, seeds: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Pairs (src, dst) joined by a path of one edge or more, from the seeds (column src) or from everywhere.

    A graph of few edges (small.LOCAL_EDGES, counted) is walked from each seed, one of several times as many (small.ARRAYS) from many at once, as arrays. In a larger one, paths from seeds grow by an edge a round; from
    everywhere they double: what the last round found, of more than half of the greatest length so far, is followed by all that is known,
    so rounds are the logarithm of the longest path.
    """
    held = small.edges_of(edges, src, dst)
    if held is not None:
        return small.walked(held, edges.select(src) if seeds is None else seeds.select(src), (src, dst)).select(src, dst)
    graph = small.arrays_of(edges, src, dst)
    if graph is not None:
        return small.spread(graph, edges.select(src) if seeds is None else seeds.select(src), (src, dst))
    first = materialise(edges.select(src, dst).distinct(), "edges")
    if seeds is None:
        ahead = lambda full: full.withColumnsRenamed({src: "__mid", dst: "__to"})
        return fixpoint(first, lambda new, full: new.join(ahead(full), F.col(dst) == F.col("__mid")).select(src, F.col("__to").alias(dst)), label="closure")
    hop = first.withColumnsRenamed({src: "__mid", dst: "__to"})
    start = first.join(seeds.select(src).distinct(), src, "left_semi")
    return fixpoint(start, lambda new, _: new.join(hop, new[dst] == hop["__mid"]).select(src, hop["__to"].alias(dst)), label="closure")
