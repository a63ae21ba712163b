"""Substring dedup against plain Python, with nulls, empty texts, ties, repeated rows, clashing names."""

import random
import re

import numpy as np
import pytest

from rillgraph.llm import common, prefix, superkmers

SCHEMA = "doc_id long, text string, spans int, doc string, tie int"


def frame(spark, given):
    return spark.createDataFrame([(i, t, 1, "d", 2) for i, t in given], SCHEMA)


def brute(given, units, window, join):
    """(id, units, units removed, what stays) of each row."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in given})
    seen, gone = set(), {}
    for d in docs:
        own = units(d[2])
        hit = set()
        for k in range(len(own) - window + 1):
            w = join(own[k : k + window])
            if w in seen:
                hit.update(range(k, k + window))
            seen.add(w)
        gone[d] = hit
    out = []
    for i, t in given:
        own, hit = units(t or ""), gone[i is not None, i or 0, t or ""]
        out.append((i, len(own), len(hit), join([x for k, x in enumerate(own) if k not in hit])))
    return sorted(out, key=str)


def some(chance, vocabulary, n, long):
    given = []
    passages = [[chance.choice(vocabulary) for _ in range(chance.randint(25, 120))] for _ in range(8)]
    for i in range(n):
        w = [chance.choice(vocabulary) for _ in range(chance.randint(0, 150))]
        for _ in range(chance.randint(0, 2)):
            k = chance.randint(0, len(w))
            p = chance.choice(passages)
            w[k:k] = p[chance.randint(0, 5) : len(p) - chance.randint(0, 5)]
        given.append((i - 5, chance.choice([" ", "  \n"]).join(w)))
    given += [(1000 + k, given[7][1]) for k in range(12)] + [(2000, "rep " * 90), (2001, " ".join(vocabulary[:19])), (2002, " ".join(vocabulary[:20])), (2003, " ".join(vocabulary[:21]))]
    given += [(3000, None), (3001, ""), (3002, " \n"), (None, given[9][1]), (4000, " ".join(chance.choice(vocabulary) for _ in range(long)))]
    chance.shuffle(given)
    return given


@pytest.mark.parametrize("at_once", [500, 24 << 20])
def test_words(spark, monkeypatch, at_once):
    monkeypatch.setattr(superkmers, "AT_ONCE", at_once)
    monkeypatch.setattr(superkmers, "BUCKET_WINDOWS", 50 if at_once == 500 else 2_000_000)
    chance = random.Random(3)
    given = some(chance, [f"W{k}é" for k in range(40)] + ["a\x1cb", "x y"], 60, 20_000)
    got = superkmers.removed(frame(spark, given).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute(given, re.compile(r"[^\x20\x09-\x0D]+").findall, 20, " ".join)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(50))
    got = superkmers.removed(frame(spark, [(1, text), (1, text), (2, text)]).repartition(3)).collect()
    assert sorted((r.doc, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 50)]
    # of equal ids, each text is a document of its own
    got = superkmers.removed(frame(spark, [(1, text), (1, text + " more")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 50]
    assert superkmers.removed(frame(spark, [(1, "")]).limit(0)).count() == 0


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "rolled", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    words = [f"w{k}" for k in range(30)]
    pieces = [" ".join(words[:20]).encode(), " ".join(words[10:30]).encode(), " ".join(words[:20]).encode()]
    ones = np.ones(3, np.int64)
    doc, _, place = superkmers.repeated(np.array([1, 2, 3]), 0 * ones, 0 * ones, ones, pieces, 20)
    assert doc.tolist() == [3] and place.tolist() == [0]


def test_least_and_runs():
    x = np.random.default_rng(2).integers(0, 50, 300).astype(np.uint64)
    for n in (1, 2, 5, 8, 18):
        assert superkmers.least(x, n).tolist() == [k + int(np.argmin(x[k : k + n])) for k in range(300 - n + 1)]
    start, many, _ = superkmers.runs(x, 20, 3)
    assert many.sum() == 281 and (start == np.cumsum(many) - many).all()


def runs_of(hit):
    return sum(1 for k in hit if k - 1 not in hit)


@pytest.mark.parametrize("at_once", [300, 12 << 20])
def test_bytes(spark, monkeypatch, at_once):
    monkeypatch.setattr(prefix, "AT_ONCE", at_once)
    monkeypatch.setattr(prefix, "SINGLY_AT_ONCE", at_once)
    chance = random.Random(8)
    given = some(chance, [f"v{k}é" for k in range(60)], 50, 3000)
    given += [(5000, "a" * 450), (5001, "ab" * 200), (5002, "x" * 99), (5003, "y" * 100), (5004, "y" * 101), (5005, "z" * 60 + "a" * 100 + "z" * 60)]
    got = prefix.removed(frame(spark, given).repartition(4)).collect()
    want = brute(given, lambda t: t.encode(), 100, bytes)
    assert sorted(((r.doc, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=str) == want


def test_byte_spans(spark):
    p, q = "".join(chr(97 + k % 7) + str(k) for k in range(60)), "".join(chr(107 + k % 5) + str(k * 3) for k in range(60))
    got = prefix.removed(frame(spark, [(1, p), (2, q), (3, f"start {p} middle {q} end"), (3, f"start {p} middle {q} end")])).collect()
    assert sorted((r.doc, r.n_spans, bytes(r.kept).decode()) for r in got) == [(1, 0, p), (2, 0, q), *[(3, 2, "start  middle  end")] * 2]
    assert prefix.removed(frame(spark, [(1, "")]).limit(0)).count() == 0


def test_leads():
    chance = np.random.default_rng(1)
    for top, n in ((3, 5), (1000, 53), (2, 53), (1, 9)):
        x = chance.integers(0, top, 400).astype(np.uint64)
        want = [k + int(np.argmin(x[k : k + n])) for k in range(400 - n + 1)]
        start, lead = prefix.led(x, n)
        assert np.repeat(lead, np.diff(np.append(start, len(want)))).tolist() == want


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_likely_keeps_all_members(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    df = spark.range(20_000)
    got = {r.id for r in common.likely(df, df.id, spark.range(0, 20_000, 10)).collect()}
    assert got >= set(range(0, 20_000, 10)) and len(got) < 5000
    assert common.likely(df, df.id, df.limit(0)).count() == 0


def test_buckets_are_even():
    h = np.random.default_rng(5).integers(0, 1 << 64, 60_000, np.uint64)
    _, _, minimisers = superkmers.runs(h, 20, 3)
    counts = np.bincount([superkmers.bucket_of(m, 50) for m in minimisers.tolist()], minlength=50)
    assert counts.max() < 2 * counts.mean()
