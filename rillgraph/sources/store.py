"""The report store: parsed reports, comments and triage as JSON, typed records of bugs, search and browsing."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgraph.sources.readers import ENTRIES, locations

#: The checkers' sections in the order of a report, and the parts that give a bug's pointer.
CHECKERS = ("Use-After-Return", "Memory-Leak", "Use-After-Free", "Double-Free", "Double-Lock")
POINTER = ("DANGLING POINTER", "SOURCE", "Never Free at")
LOCAL = "LOCAL VARIABLE"

COMMENTS = "id string, text string, date timestamp"
TRIAGE = "type string, file_name string, function_name string, line int, name string, is_leak boolean"


def write_reports(entries: DataFrame, path: str) -> None:
    """Parsed reports as JSON lines, a folder for each version."""
    entries.withColumn("v", F.col("version")).write.mode("overwrite").partitionBy("v").json(path)


def read_reports(spark: SparkSession, path: str, versions: list[str] | None = None) -> DataFrame:
    """The entries written by write_reports(), of these versions only if given: other folders are not read."""
    df = spark.read.schema(f"{ENTRIES}, v string").json(path)
    return (df if versions is None else df.filter(F.col("v").isin(versions))).drop("v")


def commented(comments: DataFrame) -> DataFrame:
    """COMMENTS of (version, api_name, number, text): the id joins the first three by colons, the date is now."""
    return comments.select(F.concat_ws(":", "version", "api_name", F.col("number").cast("string")).alias("id"), "text", F.current_timestamp().alias("date"))


def write_comments(comments: DataFrame, path: str) -> None:
    """COMMENTS as JSON lines."""
    comments.write.mode("overwrite").json(path)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(version, api_name, number, text, date) of COMMENTS."""
    part = F.split("id", ":")
    return spark.read.schema(COMMENTS).json(path).select(F.get(part, F.lit(0)).alias("version"), F.get(part, F.lit(1)).alias("api_name"), F.get(part, F.lit(2)).try_cast("int").alias("number"), "text", "date")


def triage(known: DataFrame, records: DataFrame) -> DataFrame:
    """TRIAGE: what is known, and a row, not yet judged, for each place of a bug that is new: its local variable if it has one, else its pointer."""
    place = F.coalesce("local", "pointer")
    new = records.select(F.col("checker").alias("type"), place["file_name"].alias("file_name"), place["function_name"].alias("function_name"), place["line"].alias("line"), place["name"].alias("name")).distinct()
    key = new.columns
    return known.unionByName(new.join(known.select(*key), key, "left_anti").withColumn("is_leak", F.lit(None).cast("boolean")))


def write_triage(rows: DataFrame, path: str) -> None:
    """TRIAGE as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_triage(spark: SparkSession, path: str) -> DataFrame:
    """TRIAGE."""
    return spark.read.schema(TRIAGE).json(path)


def bug_records(entries: DataFrame) -> DataFrame:
    """(file, report, version, ord, checker, bug, pointer, local, places, duration): a typed record for each bug, checkers numbered in a report's order.

    pointer and local are places (file_name, function_name, line, name); places maps each part's title to one.
    """
    place = F.struct("file_name", "function_name", "line", "name")
    by = ["file", "report", "section", "bug"]
    chosen = lambda *parts: F.max(F.when(F.col("part").isin(*parts), place))
    found = locations(entries).groupBy(*by).agg(chosen(*POINTER).alias("pointer"), chosen(LOCAL).alias("local"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", place)))).alias("places"))
    took = entries.filter("bug > 0").groupBy(*by, "version").agg(F.max(F.when(F.col("key") == "Duration (sec)", F.col("value"))).try_cast("double").alias("duration"))
    checker = F.replace("section", F.lit(" Analysis Statistic"))
    order = F.array_position(F.array(*map(F.lit, CHECKERS)), checker).cast("int")
    return took.join(found, by, "left").select("file", "report", "version", order.alias("ord"), checker.alias("checker"), "bug", "pointer", "local", "places", "duration")


def general(entries: DataFrame) -> DataFrame:
    """(file, report, version, key, value) of a report's first section: module, interface, limits."""
    return entries.filter("section = 'General Info'").select("file", "report", "version", "key", "value")


def listed(entries: DataFrame, section: str) -> DataFrame:
    """(file, report, ord, value): the lines of a section that is a list, such as the blacklist, the sinks, and the total."""
    return entries.filter(F.col("section") == section).select("file", "report", "ord", F.concat_ws("  ", F.when(F.col("key") != "", F.col("key")), "value").alias("value"))


def search(records: DataFrame, text: str) -> DataFrame:
    """Records whose pointer or local variable is in the function of that name, or whose number it is."""
    hit = (F.col("pointer.function_name") == text) | F.coalesce(F.col("local.function_name") == text, F.lit(False))
    if text.isdigit():
        hit = hit | (F.col("bug") == int(text))
    return records.filter(hit)


def browsed(reports: DataFrame, skip: bool = False) -> DataFrame:
    """(version, api_name, previous, following) of reports (version, api_name, bugs), in order of names.

    Behind the last report comes the second, before the first the last but one, as in the browser; a single one is its own neighbour. With skip, reports
    without bugs are passed over.

    Frames start at the version's first row, in one order or the other, so each is one running value: a frame that ends at the last row is read anew for every row.
    """
    order = Window.partitionBy("version").orderBy("api_name")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.when(F.col("bugs") > 0, F.col("api_name")) if skip else F.col("api_name")
    back = Window.partitionBy("version").orderBy(F.desc("api_name"))
    behind, ahead = (F.last(wanted, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for w in (order, back))
    back = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second, last_but_one = F.coalesce(F.nth_value("api_name", 2).over(whole), "api_name"), F.coalesce(F.nth_value("api_name", 2).over(back), "api_name")
    return reports.select("version", "api_name", F.coalesce(behind, last_but_one).alias("previous"), F.coalesce(ahead, second).alias("following"))


class Phases:
    """Wall-clock seconds of named phases on the driver."""

    def __init__(self) -> None:
        self.took: list[tuple[str, float]] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Time what is in the block; lazy plans have to be run in it."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self.took.append((name, time.perf_counter() - start))

    def table(self, spark: SparkSession) -> DataFrame:
        """(phase, seconds), a row for each name."""
        return spark.createDataFrame(self.took, "phase string, seconds double").groupBy("phase").agg(F.sum("seconds").alias("seconds"))
