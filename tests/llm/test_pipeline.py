"""The pipeline's near dedup and mixing stages, and the whole pipeline, on small tables."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rillgraph.llm import encode, mixing, near, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, given):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in given], COLUMNS)


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def copies(seed=1):
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(chance.randint(2, 7)))
    base = [[word() for _ in range(chance.randint(80, 300))] for _ in range(120)]
    given, group = [], {}
    for k, w in enumerate(base):
        given.append((1000 + k, " ".join(w), f"s{k % 3}"))
        group[1000 + k] = k
        for c in range(3 if k < 40 else 0):  # few changes: well above 0.8
            x = list(w)
            for _ in range(max(1, len(x) // 90)):
                x[chance.randrange(len(x))] = word()
            given.append((5000 + 10 * k + c, "  ".join(x).upper() if c else "\n".join(x), f"s{c}"))
            group[5000 + 10 * k + c] = k
    chance.shuffle(given)
    return given, group


@pytest.mark.parametrize("shard", [16, 4096])
def test_one_of_each(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    given, group = copies()
    given += [(1, None, None), (2, "", "x"), (3, given[0][1], "y"), (3, given[0][1], "y"), (None, "quite alone here", "z")]
    docs = frame(spark, given)
    out = near.one_of_each(docs)
    assert out.dtypes == docs.dtypes
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, None} <= set(ids) and 2 not in ids
    kept = [group[i] for i in ids if i in group]
    assert set(kept) | {group[given[0][0]]} == set(range(120))
    assert len(kept) <= 121
    assert near.one_of_each(docs.limit(0)).count() == 0


def test_sampled(spark):
    given, _ = copies()
    given += [(7, None, "s0"), (8, "", None), (None, "null id words", None)]
    docs = frame(spark, given)
    out = mixing.sampled(docs)
    assert out.dtypes == docs.dtypes
    want = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(docs).collect()}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}


def test_run(spark, tmp_path):
    given, group = copies()
    # a text in lines with more copies, exact and near, than make a line common: one stays, whole
    chance = random.Random(5)
    body = [" ".join(f"w{chance.randrange(900)}" for _ in range(12)) for _ in range(12)]
    many = ["\n".join(body)] * 7 + ["\n".join([*body[:k], body[k] + f" own{k}", *body[k + 1 :]]) for k in range(8)]
    given += [(9000 + k, t, "s1") for k, t in enumerate(many)]
    group |= dict.fromkeys(range(9000, 9015), -1)
    given = [(i, "Common line\n" + (t or "").replace("\n", " ") if i < 9000 else t, s) for i, t, s in given] + [(1, None, None), (2, "short", "s1"), (3, "again and again " * 100, "s2")]
    frame(spark, given).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {1, 2, 3} and len({group[i] for i in ids}) == len(ids) > 60
    assert {group[i] for i in ids if i >= 9000} <= {-1}
    library = Tokenizer.from_file(encode.vocabulary())
    texts = {i: t for i, t, _ in given}
    for r in got:
        tokens = library.encode(re.sub(r"^Common line\n", "", texts[r.doc_id]), add_special_tokens=False).ids + [0]
        part = np.array(tokens[r.start : r.start + r.length], "<u4")
        assert (len(part), zlib.crc32(part.tobytes())) == (r.length, r.ids_crc32)
    assert corpus_pipeline.ORACLE_SQL is None
