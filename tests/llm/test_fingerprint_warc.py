"""Fingerprints and archives against plain Python, with nulls, empty texts, ties, repeated rows, clashing names."""

import hashlib
import io
import random
import unicodedata

import pytest

from rillgraph.llm import fingerprint, warc

SCHEMA = "doc_id long, text string, fingerprint string, id int"


def frame(spark, given):
    return spark.createDataFrame([(i, t, "f", 1) for i, t in given], SCHEMA)


def form(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def test_canonical():
    assert fingerprint.canonical(" Ａé\tSTRASSE x ") == fingerprint.canonical("aé straße  X".replace("ae", "ae")) == form(" Ａé\tSTRASSE x ")
    assert fingerprint.canonical("A  b\n") == "a b" and fingerprint.canonical("") == ""


def some():
    chance = random.Random(6)
    texts = ["".join(chance.choice("ab é🙂\nX") for _ in range(chance.randint(0, 60))) for _ in range(120)]
    given = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    given += [(1000, None), (1001, "SAME text"), (1002, "same  TEXT"), (1003, "ＳＡＭＥ text"), (1004, "long é " * 9000)]
    chance.shuffle(given)
    return given


@pytest.mark.parametrize("digits", [32, 1])
def test_compared(spark, digits):
    given = some()
    got = {r.doc_id: r for r in fingerprint.compared(frame(spark, given).repartition(3), digits=digits).collect()}
    order = sorted(((i, t or "") for i, t in given), reverse=True)
    assert len(got) == len(given)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        other = t[: len(t) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(form(t) == form(other)), float(form(t) == form(following)))
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    forms = {}
    for i, t in given:
        forms.setdefault(form(t or ""), set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in forms.values()) and len({x for s in forms.values() for x in s}) == len(forms)


def test_repeated_rows_and_nulls(spark):
    got = fingerprint.compared(frame(spark, [(2, "abc"), (2, "abc"), (1, "abcdef"), (None, "xyz"), (None, None)])).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got}) == 4
    (one,) = fingerprint.compared(frame(spark, [(5, "abcdef")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    assert fingerprint.compared(frame(spark, [(5, "a")]).limit(0)).count() == 0


def pages(spark, given):
    return spark.createDataFrame([(i, u, t, "r", 3) for i, u, t in given], "page_id long, url string, html string, record string, page int")


def test_archives(spark):
    chance = random.Random(3)
    big = ["<p>é" + "x" * chance.randint(996, 1010) for _ in range(6)] + ["y" * 999, "y" * 1000]
    given = [(i, f"http://h/{i}\nX: y", chance.choice([*big, big[0], big[0], "small", ""])) for i in range(150)]
    given += [(200, None, None), (201, "http://é/", big[0]), (None, "http://n/", big[0]), (202, "u", "long " * 50_000), (203, "u", "HTTP/1.1\r\n\r\nContent-Length: 4 " * 50)]
    files = warc.write(pages(spark, given).repartition(4))
    got = warc.read(files).collect()
    best = {}
    for i, _, t in given:
        if i is not None and len((t or "").encode()) >= 1000:
            best[t] = max(i, best.get(t, i))
    want = []
    for i, _, t in given:
        data = (t or "").encode()
        other = best.get(t) if len(data) >= 1000 and i is not None and best.get(t) != i else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other is not None else "response", other))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = pages(spark, given).limit(0)
    assert warc.read(warc.write(none)).count() == 0


def test_repeated_page(spark):
    got = warc.read(warc.write(pages(spark, [(7, "u", "z" * 2000), (7, "u", "z" * 2000), (3, "v", "z" * 2000)]))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(3, "revisit", 7), (7, "response", None), (7, "response", None)]


def test_records_are_checked():
    data = warc.record(1, "u", b"payload", "2026-01-01T00:00:00Z", None)
    headers, block = warc.parsed(data)
    assert headers["warc-type"] == "response" and block.endswith(b"payload")
    with pytest.raises(ValueError):
        warc._row(headers, block[:-1] + b"?")
    with pytest.raises(ValueError):
        warc.parsed(data[:-3])
    zipped = warc._zipped(data) + warc._zipped(data)
    assert list(warc.members(io.BytesIO(zipped))) == [data, data]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(zipped[:-5])))
