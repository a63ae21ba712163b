"""Token files and packing against the tokenizers library itself."""

import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rillgraph.llm import encode, packing, tokens

SCHEMA = "doc_id long, text string, start int, piece string"
WORDS = ["the", "Don't", "we'll", "naïve", "ｆｕｌｌ", "a1b22", "ＡＢＣ", "été", "x y", "́z", "ΣΑΣ", "İstanbul", "日本語", "🙂🙂", "...", "#x", "\x1c", "q r", "<|endoftext|>", "'s", "KITTEN'S"]


def texts(n, seed=5):
    chance = random.Random(seed)
    out = [None, "", " \n\t ", "<|endoftext|> a <|startoftext|>b"]
    for _ in range(n):
        words = [chance.choice(WORDS[:-3] if chance.random() < 0.9 else WORDS) for _ in range(chance.randint(1, 40))]
        out.append("".join(w + chance.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", ""]) for w in words))
    return out + [" ".join(chance.choice(WORDS[:17]) for _ in range(9000))]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(encode.vocabulary())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    given = texts(300)
    made = encode.Encoder(encode.vocabulary())
    for part in ([x for x in given if "<|" not in (x or "")], given):
        ids, lens = made.encode(part)
        want = [library(x) for x in part]
        assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert [len(x) for x in made.encode([])] == [0, 0]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    packed = tokens.pack(ids, bits)
    assert len(packed) == -(-1003 * bits // 8)
    assert tokens.unpack(packed, bits, 1003).tolist() == ids.tolist()
    if bits < 32:
        with pytest.raises(ValueError):
            tokens.pack(np.array([1 << bits]), bits)


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(monkeypatch, bits):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    ids = np.random.default_rng(1).integers(0, 1 << bits, 1000).astype(np.uint32)
    out = io.BytesIO()
    writer = tokens.Writer(out, bits)
    for k in range(0, 1000, 100):
        writer.add([k, None], ids[k : k + 100], np.array([30, 70]))
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = tokens.Reader(Source(out.getvalue()))
    assert reader.first.tolist()[:4] == [0, 30, 100, 130] and reader.null.tolist() == [0, 1] * 10
    for a, b in [(0, 1000), (0, 0), (63, 65), (64, 128), (999, 1000), (5, 700)]:
        assert reader.ids(a, b).tolist() == ids[a:b].tolist()


def frame(spark, given):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in given], SCHEMA)


def test_files_of_documents(spark, library):
    given = list(enumerate(texts(60), 3))
    random.Random(1).shuffle(given)
    given += [(5, "again"), (5, "again"), (None, "no id")]
    got = sorted(map(tuple, tokens.read(tokens.write(frame(spark, given))).collect()), key=lambda r: r[1])
    start = 0
    for (doc, text), row in zip(sorted(given, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), got, strict=True):
        ids = library(text) + [2]
        assert row == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_nothing(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert tokens.read(tokens.write(none)).count() == packing.packed(none).count() == 0


def test_best_two():
    count = [0] * 20
    for n in (2, 5, 5, 9):
        count[n] += 1
    free = sum(1 << n for n in range(20) if count[n])
    assert packing.best_two(free, count, 3, 10) == (5, 5)
    assert packing.best_two(free, count, 3, 11) == (9, 2)
    assert packing.best_two(free, count, 11, 13) is None and packing.best_two(free, count, 13, 14) == (9, 5)


def check_bins(lengths, place, offset, capacity):
    for k in set(place.tolist()):
        own = sorted((o, n) for o, n in zip(offset[place == k].tolist(), lengths[place == k].tolist(), strict=True))
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= capacity


def test_best_two_fit_is_tight():
    chance = np.random.default_rng(3)
    for lengths in (chance.integers(1, 2049, 3000), np.full(7, 2048), np.full(10, 1025), chance.integers(1, 30, 500), np.zeros(0, np.int64), chance.lognormal(5.5, 1, 3000).astype(int).clip(1, 2048)):
        place, offset = packing.best_two_fit(lengths)
        check_bins(lengths, place, offset, 2048)
        big = (lengths > 1024).sum()
        assert len(set(place.tolist())) <= max(big, 1.01 * lengths.sum() / 2048 + 1) * 1.02


def test_packed(spark, library):
    given = list(enumerate(texts(80), 3)) + [(5, "again"), (5, "again"), (None, "no id"), (900, "long words here " * 3000)]
    got = packing.packed(frame(spark, given)).collect()
    want = []
    for doc, text in given:
        ids = library(text) + [0]
        for k in range(0, len(ids), 2048):
            want.append((doc, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    check_bins(np.array([r.length for r in got]), np.array([r.sequence_id for r in got]), np.array([r.offset for r in got]), 2048)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 30)
    given = list(enumerate(texts(200)))
    got = packing.packed(frame(spark, given)).collect()
    check_bins(np.array([r.length for r in got]), np.array([r.sequence_id for r in got]), np.array([r.offset for r in got]), 2048)
    assert len({r.sequence_id >> 32 for r in got}) > 3
