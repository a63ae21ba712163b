"""Readers of the text inputs: graphs, name lists, initcall contexts, known bugs, reports, memory samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The edge kinds of a graph text.
EDGES = ("addr", "copy", "load", "store", "normal-gep", "variant-gep", "call", "ret")


def graph_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind: v or o) and edges (src, dst, kind, offset) of a graph text; lines of other shapes are left out."""
    t = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("t"))
    number = lambda k: F.get("t", F.lit(k)).try_cast("long")
    nodes = t.filter(F.size("t") == 2).select(number(0).alias("id"), F.get("t", F.lit(1)).alias("kind")).filter("id is not null and kind in ('v', 'o')")
    edges = t.filter(F.size("t").isin(3, 4)).select(number(0).alias("src"), number(2).alias("dst"), F.get("t", F.lit(1)).alias("kind"), F.when(F.size("t") == 4, number(3)).alias("offset"))
    return nodes.distinct(), edges.filter(F.col("kind").isin(*EDGES) & F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def names(spark: SparkSession, path: str) -> DataFrame:
    """(part): the parts of names in a blacklist or list of sinks, one in each line that isn't blank."""
    return spark.read.text(path).select(F.btrim("value").alias("part")).filter("part <> ''").distinct()


def memory_samples(spark: SparkSession, path: str) -> DataFrame:
    """(used, max, total) of lines used/max/total in kB."""
    t = spark.read.text(path).select(F.split(F.btrim("value"), "/").alias("t")).filter(F.size("t") == 3)
    return t.select(*(F.get("t", F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(("used", "max", "total"))))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _rows(schema: str, parse):
    """A function for mapInArrow that parses each (file, value)."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [(file, *r) for r in parse(text or "")]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return made


class _Tokens:
    """White-space separated tokens, read one after another."""

    def __init__(self, text: str) -> None:
        self.left = iter(text.split())

    def word(self) -> str:
        return next(self.left, "")

    def number(self) -> int:
        return int(next(self.left, "0"))

    def words(self) -> list[str]:
        return [self.word() for _ in range(self.number())]


CONTEXTS = "file string, owner_kind string, owner string, level int, depth int, kind string, member string"


def parse_initcalls(text: str) -> list[tuple]:
    """Rows behind the file's name in CONTEXTS: initcalls with their functions, globals and undefined variables, the totals, and variables with
    theirs. One row of kind initcall or variable stands for each owner itself."""
    t, out = _Tokens(text), []
    for _ in range(t.number()):
        name, level = t.word(), t.number()
        lists = [(kind, t.words()) for kind in ("function", "global", "undefined")]
        depth = t.number()
        out.append(("initcall", name, level, depth, "initcall", name))
        out += [("initcall", name, level, depth, kind, m) for kind, ms in lists for m in ms]
    out += [("totals", kind, t.number(), None, "totals", kind) for kind in ("max_depth", "max_functions", "max_globals")]
    for _ in range(t.number()):
        name = t.word()
        lists = [(kind, t.words()) for kind in ("function", "global")]
        out.append(("variable", name, None, None, "variable", name))
        out += [("variable", name, None, None, kind, m) for kind, ms in lists for m in ms]
    return out


def initcalls(spark: SparkSession, path: str) -> DataFrame:
    """The initcall contexts of files, as CONTEXTS."""
    return _whole(spark, path).mapInArrow(_rows(CONTEXTS, parse_initcalls), CONTEXTS)


BUGS = "file string, number int, loc1_file string, loc1_func string, loc1_line long, loc1_var string, loc2_file string, loc2_func string, loc2_line long, loc2_var string, functions string, counter long, time double"


def parse_bugs(text: str) -> list[tuple]:
    """Known bugs behind the file's name in BUGS; functions are name=file:func:line:var, separated by blanks."""
    t, out = _Tokens(text), []
    place = lambda: (t.word(), t.word(), t.number(), t.word())
    for k in range(t.number()):
        a, b = place(), place()
        functions = " ".join(f"{t.word()}=" + ":".join(map(str, place())) for _ in range(t.number()))
        out.append((k, *a, *b, functions, t.number(), float(t.word() or 0)))
    return out


def known_bugs(spark: SparkSession, path: str) -> DataFrame:
    """The known bugs of files, as BUGS."""
    return _whole(spark, path).mapInArrow(_rows(BUGS, parse_bugs), BUGS)


def without_known(sources: DataFrame, bugs: DataFrame) -> DataFrame:
    """Sources (file_name, func_name, line) that no known bug has as its local variable's place."""
    known = bugs.select(F.col("loc1_file").alias("file_name"), F.col("loc1_func").alias("func_name"), F.col("loc1_line").alias("line"))
    return sources.join(known.distinct(), ["file_name", "func_name", "line"], "left_anti")


#: A report's entries: report (its number in the file), version, section, bug (its number in the section, 0: none), part, ord, key, value.
ENTRIES = "file string, report int, version string, section string, bug int, part string, ord int, key string, value string"
_RULE = re.compile(r"^[=_#/-]{6,}|^[=_-]+(\+[=_-]+)+$|^/{6,}")


def parse_reports(text: str) -> list[tuple]:
    """Entries of all reports of a log, in order, behind the file's name in ENTRIES.

    A report starts at a line with the word REPORT. Its version is that in the line of its module, else v0.0. A section starts with a line that
    ends with a colon before a rule; a numbered one is a bug of the section before. Within, an upper-case line with a colon starts a part. A
    line of a part is an entry whose key is what stands before two blanks or more, if any, and whose value is the rest; a line
    with a vertical bar is a row of a table, its first cells the key and the last two the value.
    """
    out: list[tuple] = []
    report, version, section, bug, part, ord_, group = -1, "v0.0", "", 0, "", 0, ""
    lines = text.split("\n")
    for k, line in enumerate(lines):
        clean = line.strip()
        if "REPORT" in line and set(clean) - set("/ REPOT") == set():
            report, version, section, bug, part, ord_ = report + 1, "v0.0", "", 0, "", 0
            continue
        if report < 0 or not clean or _RULE.match(clean):
            continue
        following = lines[k + 1].strip() if k + 1 < len(lines) else ""
        if clean.endswith(":") and following.startswith("======"):
            numbered = re.match(r"(\d+)\. (.*):$", clean)
            bug, part, group = (int(numbered[1]), "", "") if numbered else (0, "", "")
            section = section if numbered else clean[:-1].strip()
            continue
        if bug and clean.endswith(":") and (clean.isupper() or " at:" in clean):
            part = clean[:-1].strip()
            continue
        if "|" in clean:
            cells = [c.strip() for c in line.split("|")]
            group = cells[0] or group
            key, value = f"{group}/{cells[1]}".rstrip("/"), "/".join(cells[2:4])
        else:
            both = re.split(r"\s{2,}", clean, maxsplit=1)
            key, value = (both[0], both[1]) if len(both) == 2 else ("", clean)
        if key == "Module":
            found = re.search(r"v\d.*\.", value)
            version = found[0][:-1] if found else "v0.0"
        out.append([report, version, section, bug, part, ord_, key, value])
        ord_ += 1
    last = {}
    for r in out:  # the version stands behind the report's first lines
        last[r[0]] = r[1]
    return [(r[0], last[r[0]], *r[2:]) for r in out]


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Entries of report logs, as ENTRIES."""
    return _whole(spark, path).mapInArrow(_rows(ENTRIES, parse_reports), ENTRIES)


def checker_stats(entries: DataFrame) -> DataFrame:
    """(file, report, version, checker, duration, variables, bugs) of each checker's section."""
    e = entries.filter(F.col("section").endswith("Analysis Statistic") & (F.col("bug") == 0))
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).try_cast("double")
    found = e.groupBy("file", "report", "version", F.replace("section", F.lit(" Analysis Statistic")).alias("checker"))
    return found.agg(value("Time (sec)").alias("duration"), value("Num analyzed variables").cast("long").alias("variables"), value("Num bugs found").cast("long").alias("bugs"))


def partitioner_stats(entries: DataFrame) -> DataFrame:
    """(file, report, level, metric, relevant, original) of the table of contexts' sizes."""
    e = entries.filter("section = 'Partitioner Statistic'").withColumn("c", F.split("value", "/")).filter(F.size("c") == 2)
    level = F.split("key", "/")
    e = e.select("file", "report", F.get(level, F.lit(0)).alias("level"), F.coalesce(F.get(level, F.lit(1)), F.get(level, F.lit(0))).alias("metric"), F.get("c", F.lit(0)).try_cast("long").alias("relevant"), F.get("c", F.lit(1)).try_cast("long").alias("original"))
    return e.filter("relevant is not null")


def system_info(entries: DataFrame) -> DataFrame:
    """(file, report, kernel_name, kernel_release, processor, num_cores, mem_usage, mem_max_usage, mem_total)."""
    e = entries.filter("section = 'System Info'")
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    memory = F.split(F.max(F.when(F.col("key").contains("Total-Mem"), F.col("value"))), "/")
    return e.groupBy("file", "report").agg(
        value("Kernel Name").alias("kernel_name"), value("Kernel Release").alias("kernel_release"), value("Processor").alias("processor"), value("Num Cores").try_cast("int").alias("num_cores"),
        *(F.get(memory, F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(("mem_usage", "mem_max_usage", "mem_total"))),
    )


def locations(entries: DataFrame) -> DataFrame:
    """(file, report, section, bug, part, file_name, function_name, line, name) of the places that a bug's parts give."""
    e = entries.filter("bug > 0 and key in ('File', 'Function', 'Line', 'Name')")
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return e.groupBy("file", "report", "section", "bug", "part").agg(value("File").alias("file_name"), value("Function").alias("function_name"), value("Line").try_cast("int").alias("line"), value("Name").alias("name"))


def function_locations(entries: DataFrame) -> DataFrame:
    """(file, report, section, bug, function_name, file_name, line) of lines - function file (ln: n)."""
    whole = F.concat_ws("  ", F.when(F.col("key") != "", F.col("key")), "value")
    pattern = r"^-\s*(\S+)\s+(\S+)\s+\(ln:\s*(\d+)\)"
    e = entries.filter(F.col("part") == "FUNCTION-LOCATION MAP").withColumn("t", whole).filter(F.col("t").rlike(pattern))
    part = lambda k: F.regexp_extract("t", pattern, k)
    return e.select("file", "report", "section", "bug", part(1).alias("function_name"), part(2).alias("file_name"), part(3).cast("int").alias("line"))


def tidy_path(lines: DataFrame, column: str = "value") -> DataFrame:
    """Path lines without blank ones, rules and continuation marks (one plus sign), trailing .digits cut, arrows as HTML entities."""
    #: Arrows of calls, returns and assignments, and their entities.
    arrows = {"--->": "&#8674;", "<---": "&#8672;", "===>": "&#8658;", "<===": "&#8656;", "++>": "&#10565;", "<++": "&#10566;"}
    kept = lines.filter((F.length(F.col(column)) - F.length(F.replace(F.col(column), F.lit("+"))) != 1) & (F.btrim(F.col(column)) != "") & ~F.col(column).contains("________"))
    text = F.replace(F.regexp_replace(F.col(column), r"\.\d*$", ""), F.lit("."), F.lit(".&emsp;"))
    for arrow, entity in arrows.items():
        text = F.replace(text, F.lit(arrow), F.lit(entity))
    return kept.withColumn(column, text)


def system(spark: SparkSession) -> DataFrame:
    """One row about the driver's machine: kernel_name, kernel_release, kernel_version, processor, num_cores, mem_total."""
    import os
    import platform

    u = platform.uname()
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 1024
    return spark.createDataFrame([(u.system, u.release, u.version, u.machine, os.cpu_count() or 1, total)], "kernel_name string, kernel_release string, kernel_version string, processor string, num_cores int, mem_total long")
