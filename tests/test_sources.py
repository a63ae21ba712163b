"""Readers, writers, catalogs and the streaming rules."""

import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rillgraph import catalog as registered
from rillgraph.plans import lenses
from rillgraph.sources import catalogs, readers, store, writers
from rillgraph.streaming import typestate as streaming


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_graph_text(spark, tmp_path):
    path = put(tmp_path, "g.txt", "1 v\n2 o\n2 addr 1\n1 normal-gep 3 4\n1 gep 3 4\nbad\n\n1 copy\n1 v v v v\n")
    nodes, edges = readers.graph_text(spark, path)
    assert rows(nodes) == [(1, "v"), (2, "o")]
    assert rows(edges) == [(1, 3, "normal-gep", 4), (2, 1, "addr", None)]


def test_names_and_samples(spark, tmp_path):
    assert rows(readers.names(spark, put(tmp_path, "b.txt", "warn\n\n print \nwarn\n"))) == [("print",), ("warn",)]
    assert rows(readers.memory_samples(spark, put(tmp_path, "m.txt", "1/2/3\nx\n4/5/6\n"))) == [(1, 2, 3), (4, 5, 6)]


INITCALLS = "1\nfirst\n4\n2\nf1\nf2\n0\n1\nv\n3\n7\n8\n9\n1\nv\n1\nf1\n1\ng1\n"


def test_initcalls_round_trip(spark, tmp_path):
    got = readers.initcalls(spark, put(tmp_path, "i.txt", INITCALLS))
    assert {(r.owner, r.kind, r.member) for r in got.collect()} >= {("first", "function", "f2"), ("first", "undefined", "v"), ("v", "global", "g1"), ("v", "function", "f1")}
    assert {r.owner: r.level for r in got.filter("owner_kind = 'totals'").collect()} == {"max_depth": 7, "max_functions": 8, "max_globals": 9}
    assert writers.initcall_text(got).first().value + "\n" == INITCALLS
    assert readers.parse_initcalls("0\n0\n0\n0\n0\n") == [("totals", k, 0, None, "totals", k) for k in ("max_depth", "max_functions", "max_globals")]


def test_known_bugs_round_trip(spark, tmp_path):
    text = "1\na.c f 3 x b.c g 4 y 1 f a.c f 2 z 5 1.5"
    got = readers.known_bugs(spark, put(tmp_path, "k.txt", text))
    assert writers.bug_text(got).first().value == text
    sources = spark.createDataFrame([("a.c", "f", 3), ("a.c", "f", 9)], "file_name string, func_name string, line long")
    assert rows(readers.without_known(sources, got)) == [("a.c", "f", 9)]


def report(spark):
    place = F.struct(F.lit("lib/pool.c").alias("file_name"), F.lit("pool_grow").alias("func_name"), F.lit(271).alias("line"), F.lit("slab").alias("var_name"))
    bug = spark.range(1).select(place.alias("source"), F.array(F.lit("pool_open")).alias("api_path"), F.lit(0.2).alias("duration"))
    bugs = writers.leak_text(bug).select(F.lit("Memory-Leak").alias("checker"), F.lit("Memory-Leak").alias("type"), "text")
    stats = spark.createDataFrame([("Memory-Leak", 0.7, 1), ("Double-Free", 2.0, 5)], "checker string, duration double, variables long")
    return writers.checker_section(stats, bugs)


HEAD = """General Info:
======================================================
______________________________________________________
Module                              image-v6.1.0.bc
______________________________________________________
API                                            SYSCALL



System Info:
======================================================
______________________________________________________
Kernel Name                                      Linux
______________________________________________________
Num Cores                                           12
______________________________________________________
Used/Max/Total-Mem (kB)                    70/80/990000



Partitioner Statistic:
======================================================
 Type      |                             |  R  |  O
======================================================
 API       | Functions                   |   21|   34
           | Global Variables            |    5|    8
-----------+-----------------------------+-----+-----
 Kernel    | Functions                   |   55|   89
======================================================"""


def test_report_round_trip(spark, tmp_path):
    sections = report(spark).select((F.col("checker") == "Double-Free").cast("int").alias("ord"), "text").unionByName(spark.createDataFrame([(-1, HEAD)], "ord int, text string"))
    for _ in range(2):
        writers.append_report(sections, f"{tmp_path}/report")
    entries = readers.reports(spark, f"{tmp_path}/report").cache()
    stats = readers.checker_stats(entries)
    assert {(r.checker, r.version, r.duration, r.variables, r.bugs) for r in stats.collect()} == {("Memory-Leak", "v6.1.0", 0.0, 1, 1), ("Double-Free", "v6.1.0", 2.0, 5, 0)}
    assert stats.count() == 4
    place = readers.locations(entries).select("section", "bug", "file_name", "function_name", "line", "name").distinct()
    assert rows(place) == [("Memory-Leak Analysis Statistic", 1, "lib/pool.c", "pool_grow", 271, "slab")]
    sizes = readers.partitioner_stats(entries).select("level", "metric", "relevant", "original").distinct()
    assert rows(sizes) == [("API", "Functions", 21, 34), ("API", "Global Variables", 5, 8), ("Kernel", "Functions", 55, 89)]
    info = readers.system_info(entries).first()
    assert (info.kernel_name, info.num_cores, info.mem_usage, info.mem_total) == ("Linux", 12, 70, 990000)


def test_double_sink_text_and_dedup(spark):
    place = lambda line: F.struct(F.lit("a.c").alias("file_name"), F.lit("f").alias("func_name"), F.lit(line).alias("line"), F.lit("p").alias("var_name"))
    bugs = spark.range(2).select(place(1).alias("source"), place(2).alias("sink1"), place(3).alias("sink2"), F.array(F.lit("g"), F.lit("api")).alias("api_path"), F.lit("p1").alias("path1"), F.lit("p2").alias("path2"), F.lit(1.0).alias("duration"), "id")
    one = writers.first_of_equal(bugs, ["sink1", "sink2"], ["id"])
    text = writers.double_sink_text(one).first().text
    assert one.first().id == 0 and "FIRST SINK:" in text and "-> api\n-> g" in text


def test_paths_and_dot(spark):
    lines = spark.createDataFrame([("a.1 ---> b.22",), ("+",), (" ",), ("_" * 54,), ("x ===> y",)], "value string")
    assert rows(readers.tidy_path(lines)) == [("a.&emsp;1 &#8674; b",), ("x &#8658; y",)]
    nodes, edges = spark.createDataFrame([(1, 'a"b')], "id long, label string"), spark.createDataFrame([(1, 1, "copy")], "src long, dst long, label string")
    assert [r.value for r in writers.dot(nodes, edges).collect()] == ["digraph graph {", "  1 [label=\"a'b\"];", '  1 -> 1 [label="copy"];', "}"]


def test_catalogs(spark, tmp_path):
    known = catalogs.catalog(spark, put(tmp_path, "c.txt", "# names\nkmalloc KALLOC\nkfree KFREE\nread NOOP files\nwrite NOOP files\n"))
    f = spark.createDataFrame([("my_kmalloc_x", False), ("kfree.5", False), ("main", False), ("llvm.dbg", False)], "func string, is_decl boolean")
    assert {r.func: r.is_ext for r in catalogs.categorised(f, known).collect()} == {"my_kmalloc_x": False, "kfree.5": True, "main": False, "llvm.dbg": True}
    assert {r.func for r in catalogs.declared(f, known).filter("is_decl").collect()} == {"my_kmalloc_x", "kfree.5"}
    assert rows(catalogs.related(known, "read")) == [("read",), ("write",)]
    calls = spark.createDataFrame([("kfree.1",), ("kfree",), ("x",)], "callee string")
    assert rows(catalogs.census(calls, known)) == [("KFREE", 2)]
    assert readers.system(spark).count() == 1


def streamed(spark, tmp_path, files, schema, make, name):
    """What a stream finds that reads the files one by one."""
    for k, df in enumerate(files):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        os.utime(next(Path(f"{tmp_path}/in/{k}").glob("*.parquet")), (1000 + k, 1000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


def test_stream_agrees_with_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = lenses.read(spark, sf, "events").filter("user_id < 8").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    days = (last - first).days + 2
    end = spark.createDataFrame([(10**9, last + timedelta(days=days + 1), -1, "view")], events.schema)
    # three batches of mixed order, within what the watermark allows
    files = [events.filter(F.col("event_id") % 3 == k) for k in range(3)] + [end]
    got = streamed(spark, tmp_path, files, events.schema, lambda s: streaming.findings(s, f"{days} days"), "found")
    got = got.filter("source >= 0")
    from rillgraph.operators import typestate

    items = lenses.items(spark, sf).filter(F.col("source") < 8 << 32)
    assert rows(got.filter("rule = 'double_free'").drop("rule")) == rows(typestate.double_free(items))
    assert rows(got.filter("rule = 'use_after_free'").drop("rule")) == rows(typestate.use_after_free(items))


def test_late_events_are_dropped(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batch = lambda *e: spark.createDataFrame([(i, at(h), 1, k) for i, h, k in e], schema)
    # the click of hour 1 comes 89 hours behind; that of hour 99.5 comes out of order, before the release in time
    files = [batch((1, 0, "purchase")), batch((2, 100, "purchase")), batch((4, 1, "click"), (5, 99.5, "click")), batch((6, 101, "click")), batch((9, 300, "view"))]
    got = streamed(spark, tmp_path, files, schema, streaming.findings, "late")
    assert rows(got) == sorted([(1 << 32, "use_after_free", 1, 5), (1 << 32, "double_free", 1, 2), (1 << 32, "use_after_free", 2, 6)], key=str)
    counted = streamed(spark, tmp_path / "w", files, schema, streaming.windowed, "windows")
    assert {(r.event_type, r.n) for r in counted.collect()} == {("purchase", 1), ("click", 1)}


def test_registered_queries_have_names_and_sql():
    q, o = registered.queries(), registered.oracle_sql()
    assert len(q) > 60 and set(o) <= set(q)


@pytest.mark.parametrize("name", ["c1_double_free", "x17_actual_depth", "q8_overview"])
def test_queries_run(spark, name):
    assert registered.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
