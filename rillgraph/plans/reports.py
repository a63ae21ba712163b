"""Report analytics and scalar queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.functions import scalars
from rillgraph.operators import callgraph
from rillgraph.plans import lenses
from rillgraph.plans.lenses import REPORTS
from rillgraph.sources import store


def versions_of(bugs: DataFrame) -> DataFrame:
    """(api_name, versions): in which versions each interface has bugs."""
    return bugs.groupBy("api_name").agg(F.array_join(F.transform(F.sort_array(F.collect_set("version")), lambda x: x.cast("string")), ",").alias("versions"))


def overview(bugs: DataFrame, types: list[str]) -> DataFrame:
    """(version, one column for each type): how many different bugs, counted by interface, type and status."""
    one = bugs.select("version", "type", F.struct("api_name", "type", "status").alias("b"))
    counted = one.groupBy("version").pivot("type", types).agg(F.countDistinct("b"))
    return counted.select("version", *(F.coalesce(F.col(f"`{t}`"), F.lit(0)).alias(f"t{t}") for t in types))


def actual_total(bugs: DataFrame) -> DataFrame:
    """(type, actual, total): bugs found positive and all bugs, for each type and for TOTAL."""
    return bugs.rollup("type").agg(F.count_if(F.col("status") == "Positive").alias("actual"), F.count("*").alias("total")).select(F.coalesce("type", F.lit("TOTAL")).alias("type"), "actual", "total")


def slow(bugs: DataFrame) -> DataFrame:
    """(version, api_name, duration): interfaces whose duration is above their version's average."""
    total = bugs.groupBy("version", "api_name").agg(F.round(F.sum("duration"), 2).alias("duration"))
    average = total.groupBy("version").agg(F.avg("duration").alias("m")).withColumnRenamed("version", "v")
    return total.join(average, F.col("version") == F.col("v")).filter("duration > m").select("version", "api_name", "duration")


def first_corruptions(bugs: DataFrame) -> DataFrame:
    """(bug_id, api_name, type): of equal bugs of an interface the first, without removed ones."""
    order = Window.partitionBy("api_name", "type", "status").orderBy("version", "bug_id")
    return bugs.filter("status <> 'Remove'").withColumn("r", F.row_number().over(order)).filter("r = 1").select("bug_id", "api_name", "type")


def triaged(bugs: DataFrame, updates: DataFrame) -> DataFrame:
    """bugs with the status of updates (bug_id, status), those removed gone."""
    new = updates.select(F.col("bug_id").alias("__i"), F.col("status").alias("__s"))
    both = bugs.join(new, F.col("bug_id") == F.col("__i"), "left").withColumn("status", F.coalesce("__s", "status")).drop("__i", "__s")
    return both.filter("status <> 'Remove'")


def search(bugs: DataFrame, text: str) -> DataFrame:
    """Bugs of the interface of that name, or of that number."""
    hit = F.col("api_name") == text
    if text.isdigit():
        hit = hit | (F.col("bug_id") == int(text))
    return bugs.filter(hit)


def steps(bugs: DataFrame, skip: bool = False) -> DataFrame:
    """(version, api_name, previous, following): neighbours in order of names within a version, as store.browsed(); bugs are those found positive."""
    return store.browsed(bugs.groupBy("version", "api_name").agg(F.count_if(F.col("status") == "Positive").alias("bugs")), skip)


def matrix(bugs: DataFrame, types: list[str]) -> DataFrame:
    """(api_name, version, cell): counts of the types in order, separated by slashes."""
    one = bugs.groupBy("api_name", "version").agg(*(F.count_if(F.col("type") == t).alias(f"t{t}") for t in types))
    return one.select("api_name", "version", F.concat_ws("/", *(F.col(f"t{t}").cast("string") for t in types)).alias("cell"))


def first_reports(bugs: DataFrame) -> DataFrame:
    """(version, bug_id): the first bug of each version, by interface."""
    return bugs.groupBy("version").agg(F.min_by("bug_id", F.struct("api_name", "bug_id")).alias("bug_id"))


def average_duration(bugs: DataFrame) -> DataFrame:
    """(version, average): the mean duration, with two digits, as text."""
    return bugs.groupBy("version").agg(F.format_string("%.2f", F.round(F.avg("duration"), 2)).alias("average"))


def above(bugs: DataFrame, limit: float, column: str = "duration", unit: float = 1000) -> DataFrame:
    """(bug_id, column): bugs whose figure, in units, is above the limit: what a memory chart leaves out."""
    return bugs.filter(F.col(column) / unit > limit).select("bug_id", column)


def true_positives(bugs: DataFrame) -> DataFrame:
    """(bug_id, type): bugs found positive that are the first of their kind."""
    return bugs.filter("status = 'Positive'").join(first_corruptions(bugs).select("bug_id"), "bug_id", "left_semi").select("bug_id", "type")


def by_interface(bugs: DataFrame, kind: Column) -> DataFrame:
    """(api_type, apis, bugs): interfaces and bugs of each kind of interface."""
    return bugs.groupBy(kind.alias("api_type")).agg(F.countDistinct("api_name").alias("apis"), F.count("*").alias("bugs"))


def counted(bugs: DataFrame) -> DataFrame:
    """(api_name, n): bugs of each interface, in order of names."""
    return bugs.groupBy("api_name").agg(F.count("*").alias("n")).orderBy("api_name")


def comment_ids(bugs: DataFrame) -> DataFrame:
    """(id, api_name, n): a comment's id, and the interface and number that it is made of."""
    ids = bugs.select(F.concat_ws(":", F.col("version").cast("string"), "api_name", F.col("bug_id").cast("string")).alias("id"))
    return ids.select("id", F.split("id", ":")[1].alias("api_name"), F.split("id", ":")[2].cast("int").alias("n"))


def links(bugs: DataFrame, root: str, line: Column) -> DataFrame:
    """(bug_id, type, link, status): where each bug's line is in a source browser."""
    link = F.concat(F.lit(root), F.col("version").cast("string"), F.lit("/"), "api_name", F.lit("#L"), line.cast("string"))
    return bugs.select("bug_id", "type", link.alias("link"), "status")


def type_counts(bugs: DataFrame) -> DataFrame:
    """(type, n, apis, top): bugs and interfaces of each type, and the largest number."""
    return bugs.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("api_name").alias("apis"), F.max("bug_id").alias("top"))


def memory_census(objects: DataFrame) -> DataFrame:
    """(globals, stack, heap): how many objects (kind) of each sort there are."""
    return objects.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("global", "globals"), ("stack", "stack"), ("heap", "heap"))))


def _documents(s, d):
    return lenses.read(s, d, "documents").select("doc_id", F.col("text").alias("line"), "n_chars")


def _half(s, d):
    e = lenses.read(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.floor("value").alias("x")))).alias("a"))
    return e.select("user_id", scalars.half_average(F.transform("a", lambda p: p["x"])).alias("used"))


def _arrays(s, d):
    o = lenses.psets(s, d).filter("pset % 2 = 0").groupBy("pset").agg(F.sort_array(F.collect_set("obj")).alias("a"))
    b = lenses.psets(s, d).filter("pset % 2 = 1").groupBy(F.expr("pset - 1").alias("p")).agg(F.sort_array(F.collect_set("obj")).alias("b"))
    return o.join(b, F.col("pset") == F.col("p")).select(
        "pset", scalars.path_distance(F.col("a"), F.col("b")).alias("distance"), scalars.common_suffix(F.col("a"), F.col("b")).alias("suffix"), scalars.gcd(F.transform("a", lambda x: x.cast("long"))).alias("gcd"),
        F.arrays_overlap("a", "b").alias("meet"), scalars.subset(F.slice("a", 1, 1), F.col("a")).alias("within"), F.element_at(F.reverse("a"), 1).alias("last"),
    )


TYPES = ["1", "2", "3", "4", "5"]
QUERIES = {
    "q6_versions": lambda s, d: versions_of(lenses.reports(s, d)),
    "q7_sorted_versions": lambda s, d: lenses.reports(s, d).select(F.concat(F.lit("v4."), (F.col("version") % 100).cast("string")).alias("version")).distinct().select("version", scalars.version_key(F.col("version")).alias("k")),
    "q8_overview": lambda s, d: overview(lenses.reports(s, d), TYPES),
    "q9_first_report": lambda s, d: first_reports(lenses.reports(s, d)),
    "q11_slow": lambda s, d: slow(lenses.reports(s, d)),
    "q12_average": lambda s, d: average_duration(lenses.reports(s, d)),
    "q13_memory": lambda s, d: above(lenses.reports(s, d), 200),
    "q14_first_corruptions": lambda s, d: first_corruptions(lenses.reports(s, d)),
    "q15_actual_total": lambda s, d: actual_total(lenses.reports(s, d)),
    "q16_triaged": lambda s, d: triaged(lenses.reports(s, d), lenses.reports(s, d).filter("bug_id % 10 = 0").select("bug_id", F.when(F.col("bug_id") % 20 == 0, "Remove").otherwise("Positive").alias("status"))).groupBy("status").agg(F.count("*").alias("n")),
    "q17_true_positives": lambda s, d: true_positives(lenses.reports(s, d)),
    "q18_search": lambda s, d: search(lenses.reports(s, d), "7").unionByName(search(lenses.reports(s, d), "api_7")).select("bug_id", "api_name").distinct(),
    "q19_steps": lambda s, d: steps(lenses.reports(s, d)),
    "q19_positive_steps": lambda s, d: steps(lenses.reports(s, d), skip=True),
    "q20_split": lambda s, d: by_interface(lenses.reports(s, d), F.when(F.col("bug_id") % 2 == 0, "SYSCALL").otherwise("DRIVER")),
    "q21_sorted": lambda s, d: counted(lenses.reports(s, d)),
    "q22_comments": lambda s, d: comment_ids(lenses.reports(s, d)),
    "q23_matrix": lambda s, d: matrix(lenses.reports(s, d), TYPES),
    "q24_corruptions": lambda s, d: links(lenses.reports(s, d), "https://example.org/", F.col("bug_id") % 1000),
    "a1_counts": lambda s, d: type_counts(lenses.reports(s, d)),
    "a5_half_average": _half,
    "a6_most_waiters": lambda s, d: callgraph.most_called(lenses.calls(s, d)),
    "a8_census": lambda s, d: memory_census(lenses.read(s, d, "part").select(F.when(F.col("p_size") <= 10, "global").when(F.col("p_size") <= 30, "stack").otherwise("heap").alias("kind"))),
    "f_strings": lambda s, d: _documents(s, d).select(
        "doc_id", F.contains("line", F.lit("th")).alias("has"), scalars.base_name(F.col("line")).alias("head"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"),
        scalars.digits(F.col("n_chars")).alias("digits"), F.replace("line", F.lit("th"), F.lit("->")).alias("arrows"), F.regexp_extract("line", r"([a-z]+)\.", 1).alias("dotted"),
    ),
    "f_bits": lambda s, d: lenses.read(s, d, "part").select("p_partkey", scalars.branch_bits(F.col("p_size")).alias("bits"), scalars.bit(F.col("p_size"), 2).alias("bit2"), scalars.field_offset(F.col("p_partkey"), F.lit(7)).alias("off")),
    "f_arrays": _arrays,
    "f_json": lambda s, d: lenses.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
}

ORACLES = {
    "q6_versions": f"WITH {REPORTS} SELECT api_name, string_agg(DISTINCT CAST(version AS VARCHAR), ',' ORDER BY CAST(version AS VARCHAR)) AS versions FROM reports GROUP BY api_name",
    "q7_sorted_versions": f"WITH {REPORTS} SELECT DISTINCT 'v4.' || CAST(version % 100 AS VARCHAR) AS version, 'v4' || lpad(CAST(version % 100 AS VARCHAR), 2, '0') AS k FROM reports",
    "q8_overview": f"WITH {REPORTS} SELECT version, " + ", ".join(f"count(DISTINCT CASE WHEN type = '{t}' THEN api_name || status END) AS t{t}" for t in TYPES) + " FROM reports GROUP BY version",
    "q9_first_report": f"WITH {REPORTS}, r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY api_name, bug_id) AS k FROM reports) SELECT version, bug_id FROM r WHERE k = 1",
    "q11_slow": f"""
WITH {REPORTS}, t AS (SELECT version, api_name, round(sum(duration), 2) AS duration FROM reports GROUP BY ALL), m AS (SELECT version, avg(duration) AS m FROM t GROUP BY version)
SELECT t.version, api_name, duration FROM t JOIN m USING (version) WHERE duration > m""",
    "q12_average": f"WITH {REPORTS} SELECT version, printf('%.2f', round(avg(duration), 2)) AS average FROM reports GROUP BY version",
    "q13_memory": f"WITH {REPORTS} SELECT bug_id, duration FROM reports WHERE duration / 1000 > 200",
    "q14_first_corruptions": f"WITH {REPORTS}, r AS (SELECT *, row_number() OVER (PARTITION BY api_name, type, status ORDER BY version, bug_id) AS k FROM reports WHERE status <> 'Remove') SELECT bug_id, api_name, type FROM r WHERE k = 1",
    "q15_actual_total": f"WITH {REPORTS} SELECT coalesce(type, 'TOTAL') AS type, count(*) FILTER (status = 'Positive') AS actual, count(*) AS total FROM reports GROUP BY ROLLUP (type)",
    "q16_triaged": f"WITH {REPORTS}, t AS (SELECT CASE WHEN bug_id % 20 = 0 THEN 'Remove' WHEN bug_id % 10 = 0 THEN 'Positive' ELSE status END AS status FROM reports) SELECT status, count(*) AS n FROM t WHERE status <> 'Remove' GROUP BY status",
    "q17_true_positives": f"WITH {REPORTS}, r AS (SELECT *, row_number() OVER (PARTITION BY api_name, type, status ORDER BY version, bug_id) AS k FROM reports) SELECT bug_id, type FROM r WHERE k = 1 AND status = 'Positive'",
    "q18_search": f"WITH {REPORTS} SELECT DISTINCT bug_id, api_name FROM reports WHERE bug_id = 7 OR api_name IN ('7', 'api_7')",
    "q19_steps": f"""
WITH {REPORTS}, n AS (SELECT DISTINCT version, api_name FROM reports)
SELECT version, api_name, coalesce(lag(api_name) OVER w, nth_value(api_name, 2) OVER (PARTITION BY version ORDER BY api_name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), api_name) AS previous,
  coalesce(lead(api_name) OVER w, nth_value(api_name, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), api_name) AS following
FROM n WINDOW w AS (PARTITION BY version ORDER BY api_name)""",
    "q19_positive_steps": f"""
WITH {REPORTS}, n AS (SELECT version, api_name, CASE WHEN count(*) FILTER (status = 'Positive') > 0 THEN api_name END AS hit FROM reports GROUP BY 1, 2)
SELECT version, api_name,
  coalesce((SELECT max(hit) FROM n b WHERE b.version = n.version AND b.api_name < n.api_name), nth_value(api_name, 2) OVER (PARTITION BY version ORDER BY api_name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), api_name) AS previous,
  coalesce((SELECT min(hit) FROM n b WHERE b.version = n.version AND b.api_name > n.api_name), nth_value(api_name, 2) OVER (PARTITION BY version ORDER BY api_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), api_name) AS following
FROM n""",
    "q20_split": f"WITH {REPORTS} SELECT CASE WHEN bug_id % 2 = 0 THEN 'SYSCALL' ELSE 'DRIVER' END AS api_type, count(DISTINCT api_name) AS apis, count(*) AS bugs FROM reports GROUP BY 1",
    "q21_sorted": f"WITH {REPORTS} SELECT api_name, count(*) AS n FROM reports GROUP BY api_name ORDER BY api_name",
    "q22_comments": f"WITH {REPORTS} SELECT CAST(version AS VARCHAR) || ':' || api_name || ':' || CAST(bug_id AS VARCHAR) AS id, api_name, CAST(bug_id AS INT) AS n FROM reports",
    "q23_matrix": f"WITH {REPORTS} SELECT api_name, version, " + " || '/' || ".join(f"CAST(count(*) FILTER (type = '{t}') AS VARCHAR)" for t in TYPES) + " AS cell FROM reports GROUP BY api_name, version",
    "q24_corruptions": f"WITH {REPORTS} SELECT bug_id, type, 'https://example.org/' || CAST(version AS VARCHAR) || '/' || api_name || '#L' || CAST(bug_id % 1000 AS VARCHAR) AS link, status FROM reports",
    "a1_counts": f"WITH {REPORTS} SELECT type, count(*) AS n, count(DISTINCT api_name) AS apis, max(bug_id) AS top FROM reports GROUP BY type",
    "a5_half_average": """
WITH e AS (SELECT user_id, list(floor(value) ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)
SELECT user_id, CAST(list_reduce(list_prepend(0::DOUBLE, a), lambda x, y: floor((x + y) / 2)) AS BIGINT) AS used FROM e""",
    "a6_most_waiters": f"WITH {lenses.CALLS}, n AS (SELECT callee, count(*) AS n FROM calls GROUP BY callee) SELECT callee, n FROM n ORDER BY n DESC, callee DESC LIMIT 1",
    "a8_census": "SELECT count(*) FILTER (p_size <= 10) AS globals, count(*) FILTER (p_size > 10 AND p_size <= 30) AS stack, count(*) FILTER (p_size > 30) AS heap FROM part",
    "f_strings": r"""
SELECT doc_id, contains(line, 'th') AS has, split_part(line, '.', 1) AS head, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded, length(CAST(n_chars AS VARCHAR)) AS digits,
  replace(line, 'th', '->') AS arrows, regexp_extract(line, '([a-z]+)\.', 1) AS dotted
FROM (SELECT doc_id, text AS line, n_chars FROM documents)""",
    "f_bits": "SELECT p_partkey, CASE WHEN p_size <= 1 THEN 0 ELSE CAST(ceil(log2(p_size)) AS INT) END AS bits, (p_size >> 2) & 1 AS bit2, p_partkey % 7 AS off FROM part",
    "f_arrays": f"""
WITH {lenses.PSETS}, s AS (SELECT pset, list(obj ORDER BY obj) AS a FROM psets GROUP BY pset),
p AS (SELECT x.pset, x.a, y.a AS b, least(len(x.a), len(y.a)) AS n, list_reverse(x.a) AS ra, list_reverse(y.a) AS rb FROM s x JOIN s y ON y.pset = x.pset + 1 WHERE x.pset % 2 = 0)
SELECT pset, CAST(len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])) + abs(len(a) - len(b)) AS INT) AS distance,
  CAST(coalesce(list_min(list_filter(range(1, n + 1), lambda i: ra[i] <> rb[i])) - 1, n) AS INT) AS suffix,
  list_reduce(a, lambda x, y: gcd(x, y)) AS gcd, list_has_any(a, b) AS meet, list_has_all(a, a[1:1]) AS within, ra[1] AS last
FROM p""",
    "f_json": "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events",
}
