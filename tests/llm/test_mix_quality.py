"""Quality rules and mixing against plain Python, with nulls, empty texts, ties, repeated rows, clashing names."""

import random
import re

from rillgraph.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size int, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], SCHEMA)


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two three " * 30, "a"), (5, " ".join(f"w{i}" for i in range(80)), "b"),
    (6, "x\ny\nx\n \n\nx", "b"), (6, "x\ny\nx\n \n\nx", "b"), (None, "a#b $c", "b"), (8, " ".join(f"w{i % 70}" for i in range(5000)), "c"),
    (9, " wide space " + " ".join(f"v{i}" for i in range(60)), "c"), (10, "a b c a b c d", None),
]


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for x in seen.values() if len(x) > 1 for i in x for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark):
    got = quality.verdicts(table(spark, ROWS)).collect()
    want = sorted(((i, *measures(t)) for i, t, _ in ROWS), key=str)
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_bad_host_loses_clean_documents(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "short", "bad") for i in range(95)] + [(100 + i, clean, "bad") for i in range(5)]
    rows += [(1000 * k + i, clean, f"good{k}") for k in range(1, 6) for i in range(50)]
    got = {r.doc_id: r.kept for r in quality.verdicts(table(spark, rows)).collect()}
    assert not any(got[100 + i] for i in range(5)) and all(got[1000 * k] for k in range(1, 6))
    kept = quality.keep(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "size", "kept"] and kept.count() == 250


def test_empty(spark):
    none = table(spark, ROWS).limit(0)
    assert quality.verdicts(none).count() == quality.keep(none).count() == mixing.mix(none).count() == 0


def test_mix(spark):
    rows = ROWS + [(100 + i, " ".join(["word"] * (i % 90 + 1)), "abcd"[i % 4]) for i in range(800)]
    rows += [(2000 + i, "some words here", "tiny") for i in range(3)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table(spark, rows)).collect()), key=str)
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    taken, target, total = {}, {}, {}
    for r in got:
        assert r.size == sizes[r.doc_id] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        s = source[r.doc_id]
        taken[s], target[s], total[s] = taken.get(s, 0) + r.taken, r.target, r.source_size
    # plain resharing until no target is above three times its source's size
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, rest = {}, set(names), sum(total.values())
    while True:
        share = rest / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * total[s]}
        if not over:
            break
        want |= {s: 3 * total[s] for s in over}
        rest, free = rest - sum(3 * total[s] for s in over), free - over
    want |= {s: share * weight[s] for s in free}
    for s in names:
        assert abs(want[s] - target[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 5000 if s == "c" else abs(taken[s] - target[s]) <= 90


def test_prefix_sums_over_buckets(spark, monkeypatch):
    rows = [(i, " ".join(["word"] * (i % 7 + 1)), "a" if i % 3 else "b") for i in range(500)]
    whole = sorted(map(tuple, mixing.mix(table(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    assert sorted(map(tuple, mixing.mix(table(spark, rows)).collect())) == whole


def test_keep_against_plain_python(spark):
    """The stage keeps what verdicts() keeps, and base_failed is what the rules say, with nulls, empty texts, repeated ids, clashing names."""
    chance = random.Random(6)
    word = lambda: "".join(chance.choice("abcdefg") for _ in range(chance.randint(1, 8)))
    given = []
    for k in range(240):
        n = chance.choice([0, 10, 49, 50, 51, 200])
        text = " ".join(word() for _ in range(n)) if chance.random() < 0.8 else "again and again " * (n // 3)
        given.append((k % 200, text, ["good.example", "mixed.example", None][k % 3] if n > 20 else "bad.example", k))
    given += [(None, None, "good.example", 1), (7, "", None, 2), (7, " \n\t", "good.example", 3)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, n_words long")

    def failed(text):
        words = (text or "").split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = {w for w in windows if windows.count(w) > 1}
        hit = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
        return len(words) < 50 or 100 * len(hit) > 50 * len(words)

    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    judged = quality.verdicts(docs.withColumnRenamed("n_words", "n"))
    assert sorted(r.base_failed for r in judged.collect()) == sorted(failed(t) for _, t, _, _ in given)
    want = sorted((r.doc_id for r in judged.filter("kept").collect()), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want and 60 < len(want) < 200
    assert not {"bad.example"} & {r.source for r in kept.collect()} and quality.keep(docs.limit(0)).count() == 0
