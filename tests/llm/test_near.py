"""Near dedup against all pairs' exact similarities: repeated shingles, similarities around 0.8, groups of copies."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from rillgraph.llm import near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, given):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in given], COLUMNS)


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def one_of_each(given):
    """The ids that stay, from all pairs."""
    given = sorted(given)
    sets = [shingles(t) for _, t in given]
    best = list(range(len(given)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if 10 * common >= 8 * (len(x) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                best[b] = a
    return [given[i][0] for i in range(len(given)) if root(i) == i]


def stay(spark, given):
    return sorted(r.doc_id for r in near.one_of_each(frame(spark, given).repartition(4)).collect())


def words(chance, n):
    return [str(chance.randrange(10**6)) for _ in range(n)]


def test_repeated_shingles_link_nothing(spark):
    """Unrelated texts that all hold a run of 60 equal tokens stay, and so do equal sets' smallest ids."""
    chance = random.Random(1)
    given = [(k, " ".join(words(chance, 470) + ["."] * 60 + words(chance, 470))) for k in range(40)]
    given += [(100, given[3][1].replace(" . ", " . . ", 5)), (101, "again " * 30), (102, "again " * 9)]
    want = one_of_each(given)
    assert want == [*range(40), 101] and stay(spark, given) == want


@pytest.mark.parametrize("growth", [1, 4])
def test_every_pair_at_the_threshold(spark, monkeypatch, growth):
    """Blocks of all sizes replaced: similarities from 0.6 to 1, chains of links, short texts, passages that many share."""
    monkeypatch.setattr(near, "GROWTH", growth)
    chance = random.Random(2)
    given, passage = [], words(chance, 60)
    for k in range(220):
        base = words(chance, chance.choice([4, 5, 9, 14, 30, 200, 400, 1000]))
        if k % 2:
            base = base + passage
        for _ in range(chance.choice([1, 2, 2, 3])):
            given.append((len(given), " ".join(base)))
            a = chance.randrange(len(base))
            if chance.random() < 0.5:
                base = base[:a] + words(chance, chance.randint(1, max(1, len(base) // 7))) + base[a + max(1, len(base) // 8) :]
            else:
                base = base[: len(base) - chance.randint(0, len(base) // 4)]
    start = words(chance, 300)
    for k in range(60):  # one large group, in which most pairs are below 0.8 and links connect some
        x = list(start)
        for p in chance.sample(range(300), 5 + k % 6):
            x[p] = f"new{k}"
        given.append((len(given), " ".join(x)))
    chance.shuffle(given)
    assert stay(spark, given) == one_of_each(given)


def test_large_groups_keep_one_whole(spark, tmp_path):
    """Through run(): of 14 exact copies and of 14 near copies of many lines, the first comes whole to the packing."""
    chance = random.Random(3)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(chance.randint(2, 7)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    given = [(k, "Common line\n" + text(12)) for k in range(40)]
    exact, close = text(20), text(40)
    given += [(100 + k, exact) for k in range(14)] + [(200 + k, close + "\n" + text(1)) for k in range(14)]
    frame(spark, given).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = {r.doc_id: r.text for r in docs.collect()}
    texts = dict(given)
    assert got == {i: re.sub("^Common line\n", "", texts[i]) for i in [*range(40), 100, 200]}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed & {100, 200} and packed <= set(got)


def test_buckets_never_rule_out_what_is_alike():
    chance = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(chance.integers(0, 1 << 63, chance.integers(1, 700), np.uint64))
        y = np.unique(np.concatenate([x[chance.random(len(x)) < chance.choice([0.8, 0.9, 1.0])], chance.integers(0, 1 << 63, chance.integers(0, max(1, len(x) // 6)), np.uint64)]))
        if near.alike(x, y):
            assert near.may_be(len(x), near.odd(x), np.array([len(y)]), [near.odd(y)]).all()
    x, y = (np.unique(chance.integers(0, 1 << 63, 400, np.uint64)) for _ in range(2))
    assert near.may_be(len(x), near.odd(x), np.array([len(y), len(x)]), [near.odd(y), near.odd(x)]).tolist() == [False, True]
    assert near.odd(x[:0]) == bytes(8)


def test_fingerprints_come_first(spark, monkeypatch):
    """Sets whose SimHash is equal or within the radius are connected by the first pairs, links among them need no key, and the exact join finds the others."""
    chance = random.Random(6)
    start = words(chance, 600)
    given = [(k, " ".join(start[: 600 - k % 3] + words(chance, k % 2))) for k in range(12)] + [(20 + k, " ".join(words(chance, 50))) for k in range(30)]
    given += [(60, " ".join(start[:590] + words(chance, 70)))]  # alike, but many bits away
    made = near.fingerprints(frame(spark, given).select(near.F.col("doc_id").alias("id"), "text")).toPandas()
    sims = dict(zip(made["id"], made["sim"].to_numpy().view(np.uint64), strict=True))
    distinct = spark.createDataFrame([(int(i), int(np.uint64(x).view(np.int64))) for i, x in sims.items()], "tag long, sim long")
    best = {i: i for i in sims}

    def root(i):
        return i if best[i] == i else root(best[i])

    for u, v in near._fingerprinted(distinct).collect():
        assert np.bitwise_count(sims[u] ^ sims[v]) <= near.simhash.RADIUS
        best[max(root(u), root(v))] = min(root(u), root(v))
    close = [(i, j) for i in sims for j in sims if i < j and np.bitwise_count(sims[i] ^ sims[j]) <= near.simhash.RADIUS]
    assert close and all(root(i) == root(j) for i, j in close) and len({root(i) for i in sims}) > 30
    seen = []
    monkeypatch.setattr(near.simhash, "links", lambda d, links=near.simhash.links: seen.append(d.columns) or links(d))
    assert stay(spark, given) == one_of_each(given) and seen == [["fp"]]


def test_keys_of_the_same_documents_count_once(spark):
    """A pair that shares 100 keys is one bucket, whatever shards the keys fall in; a third document with some of them makes one more."""
    key = lambda a, b: np.arange(a, b, dtype="<u8").tobytes()
    held = [(1, 500, key(0, 100)), (2, 500, key(0, 100)), (3, 500, key(80, 180)), *((k, 500, key(200, 203)) for k in range(10, 10 + 2 * near.FEW))]
    met = near._meeting(spark.createDataFrame(held, "tag long, n int, keys binary")).collect()
    small = [r for r in met if r.tag < 10]
    assert sorted(r.tag for r in small) == [1, 1, 2, 2, 3] and len({(r.shard, r.bucket) for r in small}) == 2
    large = {}
    for r in met:
        if r.tag >= 10:
            large.setdefault((r.shard, r.bucket), []).append(r.tag)
    assert 1 <= len(large) <= 3 and all(sorted(x) == list(range(10, 10 + 2 * near.FEW)) for x in large.values())
