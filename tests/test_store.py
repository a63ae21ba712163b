"""The report store, and operators that other tests do not reach."""

import pytest
from pyspark.sql import functions as F

from rillgraph.operators import contexts, pointsto, valueflow
from rillgraph.sources import catalogs, readers, store, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reports") / "log")
    place = lambda f, n: F.struct(F.lit("fs/a.c").alias("file_name"), F.lit(f).alias("func_name"), F.lit(n).alias("line"), F.lit("p").alias("var_name"))
    bug = spark.range(1).select(
        place("keep", 7).alias("pointer"), place("own", 3).alias("local"), F.array(F.lit("inner"), F.lit("api")).alias("api_path"), F.lit("a -> b").alias("local_path"), F.lit("c").alias("pointer_path"),
        F.create_map(F.lit("zz"), place("zz", 9), F.lit("own"), place("own", 3)).alias("functions"), F.lit(2.7).alias("duration"),
    )
    text = writers.use_after_return_text(bug)
    double = spark.range(1).select(place("src", 1).alias("source"), place("f1", 2).alias("sink1"), place("f2", 3).alias("sink2"), F.array(F.lit("api")).alias("api_path"), F.lit("x").alias("path1"), F.lit("y").alias("path2"), F.lit(1.0).alias("duration"))
    bugs = text.select(F.lit("Use-After-Return").alias("checker"), F.lit("Use-After-Return").alias("type"), "text").unionByName(writers.double_sink_text(double).select(F.lit("Double-Free").alias("checker"), F.lit("Double-Free").alias("type"), "text"))
    stats = spark.createDataFrame([("Use-After-Return", 1.0, 2), ("Double-Free", 1.0, 2)], "checker string, duration double, variables long")
    sections = writers.checker_section(stats, bugs).select(F.when(F.col("checker") == "Double-Free", 2).otherwise(1).alias("ord"), "text")
    head = "General Info:\n" + "=" * 54 + "\nModule                              image-v6.2.1.bc\nAPI                                            DRIVER"
    names = "Blacklist:\n" + "=" * 54 + "\nwarn\nprint"
    writers.append_report(sections.unionByName(spark.createDataFrame([(0, head), (9, names)], "ord int, text string")), path)
    return readers.reports(spark, path)


def test_typed_records(spark, entries):
    got = {r.checker: r for r in store.bug_records(entries).collect()}
    uar, free = got["Use-After-Return"], got["Double-Free"]
    assert (uar.ord, uar.pointer.function_name, uar.local.line, uar.duration, uar.version) == (1, "keep", 3, 2.0, "v6.2.1")
    assert (free.ord, free.pointer.function_name, free.local) == (4, "src", None) and set(free.places) == {"SOURCE", "FIRST SINK", "SECOND SINK"}
    assert {r.function_name for r in readers.function_locations(entries).collect()} == {"own", "zz"}
    assert ("API", "DRIVER") in {(r.key, r.value) for r in store.general(entries).collect()}
    assert [r.value for r in store.listed(entries, "Blacklist").orderBy("ord").collect()] == ["warn", "print"]
    found = lambda text: [r.checker for r in store.search(store.bug_records(entries), text).collect()]
    assert found("own") == ["Use-After-Return"] and found("src") == ["Double-Free"] and len(found("1")) == 2 and found("f1") == []


def test_json(spark, entries, tmp_path):
    store.write_reports(entries, f"{tmp_path}/json")
    assert rows(store.read_reports(spark, f"{tmp_path}/json", ["v6.2.1"])) == rows(entries) and store.read_reports(spark, f"{tmp_path}/json", ["v1"]).count() == 0
    given = spark.createDataFrame([("v1", "api", 3, "looks\nreal")], "version string, api_name string, number int, text string")
    store.write_comments(store.commented(given), f"{tmp_path}/c")
    assert rows(store.read_comments(spark, f"{tmp_path}/c").drop("date")) == rows(given)
    known = spark.createDataFrame([("Double-Free", "fs/a.c", "src", 1, "p", True)], store.TRIAGE)
    store.write_triage(store.triage(known, store.bug_records(entries)), f"{tmp_path}/t")
    assert {(r.type, r.function_name, r.is_leak) for r in store.read_triage(spark, f"{tmp_path}/t").collect()} == {("Double-Free", "src", True), ("Use-After-Return", "own", None)}


def test_browsing(spark):
    reports = spark.createDataFrame([("v", x, n) for x, n in (("a", 1), ("b", 0), ("c", 2), ("d", 0))] + [("w", "z", 0)], "version string, api_name string, bugs int")
    assert rows(store.browsed(reports)) == [("v", "a", "c", "b"), ("v", "b", "a", "c"), ("v", "c", "b", "d"), ("v", "d", "c", "b"), ("w", "z", "z", "z")]
    assert rows(store.browsed(reports, skip=True)) == [("v", "a", "c", "c"), ("v", "b", "a", "c"), ("v", "c", "a", "b"), ("v", "d", "c", "b"), ("w", "z", "z", "z")]


def test_browsing_reads_each_row_once(spark):
    """No frame starts behind a row and ends at the version's last one, which takes the square of the version's rows; neighbours as by plain Python."""
    bugs = {f"api_{k}": int(k % 7 == 3) for k in range(3000)}
    reports = spark.createDataFrame([("v", x, n) for x, n in bugs.items()], "version string, api_name string, bugs int").repartition(5)
    names = sorted(bugs)
    for skip in (False, True):
        found = store.browsed(reports, skip)
        assert "RowFrame, 1, unboundedfollowing" not in found._jdf.queryExecution().toString()
        wanted = [x for x in names if bugs[x] or not skip]
        want = [("v", x, max((y for y in wanted if y < x), default=names[-2]), min((y for y in wanted if y > x), default=names[1])) for x in names]
        assert rows(found) == want


def test_phases(spark):
    p = store.Phases()
    for name in ("read", "check", "read"):
        with p.phase(name):
            pass
    assert {r.phase for r in p.table(spark).collect()} == {"read", "check"} and len(p.took) == 3


def test_other_operators(spark):
    frame = spark.createDataFrame
    insts, marks = frame([(1, "a"), (2, "b")], "inst long, text string"), frame([(1, "sink"), (1, "race"), (1, "sink")], "inst long, mark string")
    assert [r.annotation for r in writers.annotate(insts, marks).orderBy("inst").collect()] == ["race,sink", None]
    calls = frame([(7, "memcpy", 0, 1), (7, "memcpy", 1, 2), (8, "strcpy", 0, 3), (8, "strcpy", -1, 4), (9, "alloc", -1, 5), (6, "put", 0, 10), (6, "put", 1, 11)], "cs long, name string, pos int, node long")
    effects = frame([("memcpy", "load_store"), ("strcpy", "copy_arg0"), ("alloc", "alloc"), ("put", "store_arg1")], "name string, effect string")
    got = {k: rows(v) for k, v in pointsto.external_effects(calls, effects).items()}
    assert got == {"copy": [(3, 4)], "store": [(11, 10)], "load_store": [(2, 1)], "addr": [(9, 5)]}
    nodes, pts, own = frame([(1,), (2,), (3,)], "node long"), frame([(2, 100), (3, 101)], "var long, obj long"), frame([(100,), (1,)], "obj long")
    assert rows(valueflow.dereferenced_globals(nodes, pts, own)) == [(1,), (2,)]
    e = frame([(1, 2, "direct"), (1, 3, "direct"), (2, 3, "indirect")], "src long, dst long, kind string")
    kinds = frame([(2, "Load", 1), (3, "Copy", 1)], "node long, kind string, ptr_def long")
    assert rows(valueflow.without_dereferences(e, kinds)) == [(1, 3, "direct"), (2, 3, "indirect")]
    f, g = contexts.module_subset(frame([("a",), ("b",), ("c",)], "func string"), frame([("x",), ("y",)], "name string"), frame([("a",)], "func string"), frame([("x",)], "name string"), ["c"], [])
    assert rows(f) == [("a",), ("c",)] and rows(g) == [("x",)]
    known = frame([("sys_read", "NOOP", "files"), ("sys_fork", "NOOP", "proc")], "name string, category string, grp string")
    assert [r.name for r in catalogs.syscalls_of(known, frame([("__x64_sys_read",), ("vfs_read",)], "func string")).collect()] == ["sys_read"]
