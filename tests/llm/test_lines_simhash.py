"""Line dedup and SimHash against plain Python, with nulls, empty texts, ties, repeated rows, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from rillgraph.llm import components, lines, simhash

SCHEMA = "doc_id long, text string, n_chars long, keep string, doc int, fp string"


def frame(spark, given):
    return spark.createDataFrame([(i, t, len(t or ""), "k", 1, "f") for i, t in given], SCHEMA)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def cut(given, min_docs):
    docs = {}
    for i, t in given:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add((i, t))
    out = []
    for i, t in given:
        own = (t or "").split("\n")
        kept = [x for x in own if not key(x) or len(docs[key(x)]) < min_docs]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def some(n=120, seed=2):
    chance = random.Random(seed)
    pool = [f" Line {k} " for k in range(30)] + ["", " \t", "ÄÖ line", "äö LINE", "always"]
    given = [(i, "\n".join(["ALWAYS\x0b", *(chance.choice(pool) for _ in range(chance.randint(0, 9)))])) for i in range(n)]
    return given + [(n, None), (n + 1, ""), (None, "Line 3\nnull id"), (n + 2, "one\n" * 3000), (5, given[5][1]), (6, "same id\nLine 4")]


@pytest.mark.parametrize("at_once", [1, 200, 1 << 25])
def test_lines_dropped(spark, monkeypatch, at_once):
    monkeypatch.setattr(lines, "AT_ONCE", at_once)
    given = some()
    docs = frame(spark, given).repartition(5)
    rows = lines.applied(docs, lines.bitmaps(docs, min_docs=10)).selectExpr("__row.doc_id", "__n_lines", "__n_dropped", "sha2(__kept, 256) s").collect()
    assert sorted(map(tuple, rows), key=str) == cut(given, 10)


def test_first_occurrences_stay(spark, monkeypatch):
    monkeypatch.setattr(lines, "AT_ONCE", 100)
    given = [(i, t) for i, t in some() if i is not None][:-2]
    docs = frame(spark, given).repartition(4)
    got = {r.doc_id: r.text for r in lines.deduped(docs, first=True).collect()}
    seen = set()
    for i, t in sorted(given):
        kept = []
        for line in (t or "").split("\n"):
            if not key(line) or key(line) not in seen:
                kept.append(line)
            seen.add(key(line))
        assert got[i] == "\n".join(kept)


def test_bitmaps_and_columns(spark):
    docs = frame(spark, some())
    for r in lines.bitmaps(docs).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines)
        assert r.n_lines - bits.sum() == r.n_dropped
    out = lines.deduped(docs)
    assert out.dtypes == docs.dtypes and all(r.n_chars == len(r.text) for r in out.collect())
    assert lines.deduped(docs.limit(0)).count() == 0


def fingerprint(text, n=3):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reachable(given, fps, radius=2):
    x = np.array(fps, np.uint64)
    best = [i if i is not None else float("inf") for i, _ in given]
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    while True:
        new = [min(best[j] for j in np.nonzero(row)[0]) for row in near]
        if new == best:
            return [None if b == float("inf") else b for b in best]
        best = new


def test_simhash_groups(spark):
    chance = random.Random(4)
    base = [" ".join(chance.choice("abcdefghij") * chance.randint(1, 4) for _ in range(200)) for _ in range(40)]
    given = [(100 + i, t) for i, t in enumerate(base)]
    for k in range(150):
        w = chance.choice(base[:12]).split()
        w[chance.randrange(200)] = "CHANGED"
        given.append((1000 - k, " \n".join(w)))
    given += [(3, None), (2, ""), (None, " "), (7, "a b"), (8, "A\tB"), (9, base[0]), (9, base[0]), (10, "x y z " * 4000)]
    chance.shuffle(given)
    fps = [fingerprint(t) for _, t in given]
    got = simhash.grouped(frame(spark, given)).collect()
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(given, fps, reachable(given, fps), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.grouped(frame(spark, given).limit(0)).count() == 0


@pytest.mark.parametrize("spread", [64, 12])
@pytest.mark.parametrize("radius", [2, 4])
def test_tree_loses_no_pair(radius, spread):
    chance = np.random.default_rng(spread)
    x = chance.integers(0, 1 << min(spread, 63), 3000).astype(np.uint64)
    flips = x[:600] ^ (np.uint64(1) << chance.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << chance.integers(0, 64, 600).astype(np.uint64))
    x = np.unique(np.concatenate([x, flips]))
    tree = simhash.Tree(x[::3], 40, radius)
    assert tree.leaves > 8
    shards = {}
    for shard, own, visits in tree.deal(x):
        assert len(set(own.tolist())) == len(own)
        for i, v in zip(own.tolist(), visits.tolist(), strict=True):
            shards.setdefault(shard, ([], []))[v].append(i)
    assert sorted(i for own, _ in shards.values() for i in own) == list(range(len(x)))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    met = np.zeros_like(near)
    for own, visitors in shards.values():
        met[np.ix_(own, own + visitors)] = True
    assert not (near & ~(met | met.T)).any()


def test_components(spark):
    chance = random.Random(9)
    pairs = [(i, i + 1) for i in range(50)] + [(1000, k) for k in range(1001, 1100)] + [(chance.randrange(5000, 5400), chance.randrange(5000, 5400)) for _ in range(300)]
    pairs += [(-5, -9), (-9, -5), (7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_copies_keep_their_lines(spark):
    body = [f"line {k} of a text that is copied" for k in range(8)]
    given = [(k, "\n".join([*body, "shared footer"])) for k in range(12)] + [(100 + k, "\n".join([f"own {k} {j} " * 4 for j in range(5)] + ["shared footer"])) for k in range(5)]
    given += [(200, None), (201, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in given], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in lines.deduped(docs, copies=0.5).collect()}
    assert got == {i: t if i < 12 else (t or "").replace("\nshared footer", "") for i, t in given}
    assert {r.text for r in lines.deduped(docs).filter("doc_id < 12").collect()} == {""}
    assert lines.deduped(docs.limit(0), copies=0.5).count() == 0


def test_large_shards_are_divided(monkeypatch):
    chance = np.random.default_rng(11)
    base = chance.integers(0, 1 << 63, 60, np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in chance.choice(64, chance.integers(0, 4), replace=False))) for b in base for _ in range(25)]
    own = np.unique(np.array(near[:1200], np.uint64))
    visitors = np.setdiff1d(np.unique(np.array(near[1200:], np.uint64)), own)
    monkeypatch.setattr(simhash, "SHARD", 32)

    def roots(u, v):
        up = {int(x): int(x) for x in np.concatenate([own, visitors])}
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            p, q = sorted((find(a), find(b)))
            up[q] = p
        return {x: find(x) for x in up}

    for sample in (1 << 15, 64):
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        assert roots(*simhash.divided(own, visitors, 2)) == roots(*simhash.linked(own, visitors, 2))
