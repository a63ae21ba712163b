"""Writers: reports and bugs as text, initcall contexts, known bugs, graphs in DOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the report's form.
DOUBLE, SINGLE, WIDTH = "=" * 54, "_" * 54, 54


def entry(key: str, value: Column, width: int = WIDTH) -> Column:
    """A line with the key on the left and the value on the right."""
    text = value.cast("string")
    return F.concat(F.lit(key), F.lpad(text, F.greatest(F.lit(width - len(key)), F.length(text) + 1), F.lit(" ")))


def location(loc: Column) -> Column:
    """A place (file_name, func_name, line, var_name) as four lines."""
    return F.concat_ws("\n", entry("File", loc["file_name"]), entry("Function", loc["func_name"]), entry("Line", loc["line"]), entry("Name", loc["var_name"]))


def api_path(path: Column) -> Column:
    """The functions from the interface to the source, one in a line."""
    return F.array_join(F.transform(F.reverse(path), lambda f: F.concat(F.lit("-> "), f)), "\n")


def leak_text(bugs: DataFrame) -> DataFrame:
    """(source, text): never-freed bugs (source: place, api_path, duration)."""
    text = F.concat_ws("\n", F.lit(DOUBLE), F.lit(SINGLE), F.lit("Never Free at:\n"), location(F.col("source")), F.lit(""), F.lit(SINGLE), F.lit("API TO SOURCE:\n"), api_path(F.col("api_path")), F.lit(""), F.lit(SINGLE), entry("Duration (sec)", F.col("duration").cast("long")), F.lit(DOUBLE))
    return bugs.select("source", text.alias("text"))


def double_sink_text(bugs: DataFrame) -> DataFrame:
    """(sink1, sink2, text): bugs (source, sink1, sink2: places; api_path; path1, path2: text; duration)."""
    part = lambda title, body: F.concat_ws("\n", F.lit(SINGLE), F.lit(f"{title}:\n"), body)
    text = F.concat_ws(
        "\n", F.lit(DOUBLE), part("SOURCE", location(F.col("source"))), part("FIRST SINK", location(F.col("sink1"))), part("SECOND SINK", location(F.col("sink2"))), part("API TO SOURCE", api_path(F.col("api_path"))),
        part("PATH TO FIRST SINK", F.col("path1")), part("PATH TO SECOND SINK", F.col("path2")), F.lit(SINGLE), entry("Duration (sec)", F.col("duration").cast("long")), F.lit(DOUBLE),
    )
    return bugs.select("sink1", "sink2", text.alias("text"))


def use_after_return_text(bugs: DataFrame) -> DataFrame:
    """(pointer, local, text): bugs (pointer, local: places; api_path; local_path, pointer_path: text; functions: map of names to places; duration, null: timed out)."""
    part = lambda title, body: F.concat_ws("\n", F.lit(SINGLE), F.lit(f"{title}:\n"), body)
    entries = F.array_sort(F.map_entries("functions"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    one = lambda e: F.concat(F.lit(" - "), F.rpad(e["key"], F.greatest(F.lit(25), F.length(e["key"]) + 1), F.lit(" ")), e["value"]["file_name"], F.lit(" (ln: "), e["value"]["line"].cast("string"), F.lit(")"))
    text = F.concat_ws(
        "\n", F.lit(DOUBLE), part("DANGLING POINTER", location(F.col("pointer"))), part("LOCAL VARIABLE", location(F.col("local"))), part("API TO LOCALVAR", api_path(F.col("api_path"))),
        part("LOCALVAR TO OUTOFSCOPE", F.col("local_path")), part("DANGLINGPTR TO OUTOFSCOPE", F.col("pointer_path")), part("FUNCTION-LOCATION MAP", F.array_join(F.transform(entries, one), "\n")),
        F.lit(SINGLE), entry("Duration (sec)", F.coalesce(F.col("duration").cast("long").cast("string"), F.lit("timeout"))), F.lit(DOUBLE),
    )
    return bugs.select("pointer", "local", text.alias("text"))


def first_of_equal(bugs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of bugs with equal keys, the first in order."""
    return bugs.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")


def checker_section(stats: DataFrame, bugs: DataFrame) -> DataFrame:
    """(checker, text): each checker's section (stats: checker, duration, variables) with its numbered bugs (checker, type, text)."""
    numbered = bugs.withColumn("n", F.row_number().over(Window.partitionBy("checker").orderBy("text")))
    one = numbered.groupBy("checker").agg(F.sort_array(F.collect_list(F.struct("n", F.format_string("%d. %s:\n%s", "n", "type", "text").alias("t")))).alias("b"), F.count("*").alias("bugs"))
    s = stats.join(one, "checker", "left").withColumn("bugs", F.coalesce("bugs", F.lit(0)))
    head = F.concat_ws("\n", F.concat("checker", F.lit(" Analysis Statistic:")), F.lit(DOUBLE), F.lit(SINGLE), entry("Time (sec)", F.col("duration").cast("long")), F.lit(SINGLE), entry("Num analyzed variables", F.col("variables")), F.lit(SINGLE), entry("Num bugs found", F.col("bugs")))
    return s.select("checker", F.concat(head, F.lit("\n\n\n\n\n"), F.coalesce(F.array_join(F.transform("b", lambda x: x["t"]), "\n\n\n"), F.lit(""))).alias("text"))


def append_report(sections: DataFrame, path: str) -> None:
    """Append texts (ord, text) in order below a banner; one file, as a report is small."""
    banner = "#" * 54 + "\n" + "/" * 22 + " REPORT " + "/" * 24 + "\n" + "#" * 54
    whole = sections.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n\n").alias("t"))
    whole.select(F.concat(F.lit(banner + "\n"), "t").alias("value")).write.mode("append").text(path)


def dot(nodes: DataFrame, edges: DataFrame, name: str = "graph") -> DataFrame:
    """(value): lines of a DOT graph of nodes (id, label) and edges (src, dst, label), in order."""
    n = nodes.select(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string('  %d [label="%s"];', "id", F.replace("label", F.lit('"'), F.lit("'"))).alias("value"))
    e = edges.select(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string('  %d -> %d [label="%s"];', "src", "dst", F.replace("label", F.lit('"'), F.lit("'"))).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, 0, 0, f"digraph {name} {{"), (3, 0, 0, "}")], "k int, a long, b long, value string")
    return n.unionByName(e).unionByName(ends).orderBy("k", "a", "b", "value").select("value")


def initcall_text(contexts: DataFrame) -> DataFrame:
    """(value): a file of initcall contexts (as read: owner_kind, owner, level, depth, kind, member), in one row; lists are in order of names."""
    listed = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("member"))))
    spelled = lambda c: F.concat_ws("\n", F.size(c).cast("string"), F.when(F.size(c) > 0, F.array_join(c, "\n")))
    own = contexts.groupBy("owner_kind", "owner").agg(F.max("level").alias("level"), F.max("depth").alias("depth"), listed("function").alias("f"), listed("global").alias("g"), listed("undefined").alias("u"))
    text = F.when(F.col("owner_kind") == "initcall", F.concat_ws("\n", "owner", F.col("level").cast("string"), spelled(F.col("f")), spelled(F.col("g")), spelled(F.col("u")), F.col("depth").cast("string")))
    own = own.withColumn("text", F.coalesce(text, F.when(F.col("owner_kind") == "totals", F.col("level").cast("string")), F.concat_ws("\n", "owner", spelled(F.col("f")), spelled(F.col("g")))))
    order = F.when(F.col("owner") == "max_depth", 0).when(F.col("owner") == "max_functions", 1).otherwise(2)
    part = lambda kind, by: F.sort_array(F.collect_list(F.when(F.col("owner_kind") == kind, F.struct(by.alias("o"), "text"))))
    one = own.agg(part("initcall", F.col("owner")).alias("i"), part("totals", order).alias("t"), part("variable", F.col("owner")).alias("v"))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["text"]), "\n"))
    return one.select(F.concat_ws("\n", F.size("i").cast("string"), joined("i"), joined("t"), F.size("v").cast("string"), joined("v")).alias("value"))


def bug_text(bugs: DataFrame) -> DataFrame:
    """(value): a file of known bugs (as read), in one row."""
    functions = F.transform(F.filter(F.split("functions", " "), lambda x: x != ""), lambda x: F.translate(x, "=:", "  "))
    one = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("loc1_file", "loc1_func", "loc1_line", "loc1_var", "loc2_file", "loc2_func", "loc2_line", "loc2_var")), F.size(functions).cast("string"), F.when(F.size(functions) > 0, F.array_join(functions, " ")), F.col("counter").cast("string"), F.col("time").cast("string"))
    found = bugs.agg(F.sort_array(F.collect_list(F.struct("file", "number", one.alias("t")))).alias("b"))
    return found.select(F.concat_ws("\n", F.size("b").cast("string"), F.array_join(F.transform("b", lambda x: x["t"]), "\n")).alias("value"))


def annotate(insts: DataFrame, marks: DataFrame) -> DataFrame:
    """Instructions (inst, ...) with the sorted annotations (inst, mark) of slices, sources, sinks and races."""
    return insts.join(marks.groupBy("inst").agg(F.array_join(F.sort_array(F.collect_set("mark")), ",").alias("annotation")), "inst", "left")
