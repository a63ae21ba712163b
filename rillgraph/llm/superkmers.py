"""Substring dedup by super-k-mer partitioning.

The minimiser of a window of k words is its m-word gram with the least hash. Consecutive windows that share one travel
as one string, the super-k-mer, to the bucket of the minimiser's hash; equal windows have equal minimisers, so they meet there. A bucket
enumerates its windows and sorts them by hash, document and place; windows of equal hash are compared word for word.

Equal super-k-mers are settled before the shuffle: of those that a task sees, only the first by document and place
travels, as all windows of the others start earlier in it. So a passage with thousands of copies comes to its bucket a few times for
each task. Super-k-mers travel in compressed blocks, one for each task and bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import spans
from rillgraph.llm.common import partitions, rows, table

WINDOW, GRAM = 20, 3
#: Characters of text that a task looks through at once, about, and words whose hashes a worker remembers.
AT_ONCE, REMEMBERED = 5 << 20, 300_000
#: UTF-8 bytes of text for each bucket, about: buckets follow the input, so no group grows with it.
BUCKET_BYTES = 8 << 20
#: Windows that a bucket has in memory at once, about; more are divided by their minimiser's hash first.
BUCKET_WINDOWS = 500_000

_known: dict[bytes, int] = {}
#: Words of a text; and what str.split() splits at besides.
_WORD, _ODD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x1c-\x1f]")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_known) > REMEMBERED:
        _known.clear()
    for w in set(words):
        if w not in _known:
            _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive of h, put together from hashes of 1, 2, 4 and so on, with wrapping arithmetic."""
    size, at, total = len(h) - n + 1, 0, None
    level, span, power = h, 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while True:
            if n & span:
                part = level[at : at + size]
                total = part.copy() if total is None else total * power + part
                at += span
            if 2 * span > n:
                break
            level = level[: len(level) - span] * power + level[span:]
            span, power = 2 * span, power * power + np.uint64(2)
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        return total ^ (total >> np.uint64(29))


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The place of the least of every n consecutive, the first of equal ones."""
    value, place, size = x, np.arange(len(x)), len(x) - n + 1
    done = 1
    while done < n:
        step = min(done, n - done)
        right = value[step:] < value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        done += step
    return place[:size]


def runs(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows and minimiser's hash of each super-k-mer of a text's word hashes."""
    grams = rolled(h, gram)
    place = least(grams, window - gram + 1)
    first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
    return first, np.diff(np.append(first, len(place))), grams[place[first]]


def bucket_of(minimiser: int, buckets: int) -> int:
    """The bucket of a minimiser's hash. That is the least of several, so it is spread anew: the least crowd in the first ranges."""
    return ((minimiser * 0x9E3779B97F4A7C15 & (1 << 64) - 1) * buckets) >> 64


def _block(group: list[tuple]) -> bytes:
    """(minimiser, doc, tie, first window, windows, words) of super-k-mers, compressed."""
    hashes = np.array([g[0] for g in group], "<u8").tobytes()
    numbers = b"".join(np.array([g[k] for g in group], "<i8").tobytes() for k in (1, 2, 3, 4))
    return zstandard.ZstdCompressor(level=3).compress(len(group).to_bytes(8, "little") + hashes + numbers + b"\n".join(g[5] for g in group))


def _opened(block: bytes) -> tuple:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(data[:8], "little")
    numbers = [np.frombuffer(data, "<i8", n, 8 + 8 * n * k) for k in (1, 2, 3, 4)]
    return np.frombuffer(data, "<u8", n, 8), *numbers, data[8 + 40 * n :].split(b"\n")


def _cut(window: int, gram: int, buckets: int):
    """Of a task's documents (doc, tie, text): blocks for buckets, and, by any bucket, spans (doc, tie, spans) of settled windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches, AT_ONCE):
            first: dict[bytes, tuple] = {}
            settled: dict[tuple, list[tuple[int, int]]] = {}
            for doc, tie, text in sorted(held):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                start, many, minimiser = runs(word_hashes(words), window, gram)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate([[0], ends[:-1] + 1])
                joined = b" ".join(words)
                for a, b, s, n, m in zip(begins[start].tolist(), ends[start + many + window - 2].tolist(), start.tolist(), many.tolist(), minimiser.tolist(), strict=True):
                    own = (m, doc, tie, s, n)
                    if first.setdefault(joined[a:b], own)[1:4] != own[1:4]:  # documents come in order: the one held starts earlier
                        settled.setdefault((doc, tie), []).append((s, s + n))
            groups: dict[int, list[tuple]] = {}
            for piece, own in first.items():
                groups.setdefault(bucket_of(own[0], buckets), []).append((*own, piece))
            out = [(k, _block(g), None, None, None) for k, g in groups.items()]
            out += [(d[0] % buckets, None, *d, np.array(x, "<i8").tobytes()) for d, x in settled.items()]
            yield _rows(out)
        _known.clear()  # idle workers should hold little

    return cut


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * 5
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["bucket", "block", "doc", "tie", "spans"])


def repeated(docs: np.ndarray, ties: np.ndarray, starts: np.ndarray, manys: np.ndarray, pieces: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """doc, tie and place of each window of the super-k-mers whose words start earlier elsewhere in them."""
    words = b" ".join(pieces).split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))  # equal for equal words only
    sizes = manys + window - 1
    at = np.cumsum(sizes) - sizes  # each super-k-mer's first word
    rolls = rolled(word_hashes(list(number))[ids], window)
    of = np.repeat(np.arange(len(pieces)), manys)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(manys) - manys, manys)
    word, place = at[of] + inner, starts[of] + inner
    order = np.lexsort((place, ties[of], docs[of], rolls[word]))
    of, word, place, roll = of[order], word[order], place[order], rolls[word[order]]
    doc, tie = docs[of], ties[of]
    same = np.concatenate([[False], roll[1:] == roll[:-1]])
    # those of equal hash are compared, word for word, with the earliest of them
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    drop, others = np.zeros(len(same), bool), {}
    elsewhere = lambda i, j: (doc[i] != doc[j]) | (tie[i] != tie[j]) | (place[i] != place[j])  # noqa: E731  the same row again isn't earlier
    twice = np.nonzero(same)[0]
    for k in range(0, len(twice), 1 << 16):
        i = twice[k : k + (1 << 16)]
        equal = np.ones(len(i), bool)
        for w in range(window):
            equal &= ids[word[i] + w] == ids[word[heads[i]] + w]
        drop[i] = equal & elsewhere(i, heads[i])
        for x in i[~equal].tolist():  # another sequence of equal hash
            for j in others.setdefault(int(heads[x]), []):
                if (ids[word[x] : word[x] + window] == ids[word[j] : word[j] + window]).all():
                    drop[x] = elsewhere(x, j)
                    break
            else:
                others[int(heads[x])].append(x)
    return doc[drop], tie[drop], place[drop]


def _counted(window: int):
    """Spans of repeated windows (doc, tie, spans) of a bucket's blocks."""

    def counted(group: pa.Table) -> pa.Table:
        settled = group.filter(pc.is_null(group["block"])).select(["doc", "tie", "spans"])
        parts = [_opened(b) for b in group["block"].to_pylist() if b is not None]
        if not parts:
            return settled
        hashes, docs, ties, starts, manys = (np.concatenate([p[k] for p in parts]) for k in range(5))
        pieces = [x for p in parts for x in p[5]]
        del parts
        # in order of minimisers, then documents; of equal super-k-mers the first stays, all windows of the others are repeats
        order = np.lexsort((starts, ties, docs, hashes))
        whole, stay, first, last = [], [], {}, None
        for i, h in zip(order.tolist(), hashes[order].tolist(), strict=True):
            if h != last:
                first, last = {}, h
            j = first.setdefault(pieces[i], i)
            if j == i:
                stay.append(i)
            elif (docs[i], ties[i], starts[i]) != (docs[j], ties[j], starts[j]):
                whole.append(i)
        # a super-k-mer has no window twice, and where no other shares its minimiser, all its windows are new
        order, whole = np.array(stay, np.int64), np.array(whole, np.int64)
        shared = np.zeros(len(order), bool)
        shared[1:] = hashes[order[1:]] == hashes[order[:-1]]
        shared[:-1] |= shared[1:]
        order = order[shared]
        edges = np.append(np.concatenate([[0], np.nonzero(np.diff(hashes[order]))[0] + 1]), len(order))
        load = np.concatenate([[0], np.cumsum(manys[order])])
        of = np.repeat(whole, manys[whole])
        inner = np.arange(len(of)) - np.repeat(np.cumsum(manys[whole]) - manys[whole], manys[whole])
        found = [(docs[of], ties[of], starts[of] + inner)]
        k = 0
        while k < len(edges) - 1 and len(order):  # whole minimisers together, as many as memory allows
            j = max(k + 1, int(np.searchsorted(load[edges], load[edges[k]] + BUCKET_WINDOWS, "right")) - 1)
            own = order[edges[k] : edges[j]]
            found.append(repeated(docs[own], ties[own], starts[own], manys[own], [pieces[i] for i in own.tolist()], window))
            k = j
        _known.clear()
        return pa.concat_tables([settled, spans.of_places(*(np.concatenate(x) for x in zip(*found, strict=True)))])

    return counted


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, tie, spans): for documents with windows that start earlier elsewhere, runs of such windows, which may overlap."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    n = max(6 * partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    cut = spans.identified(docs, id_col, text_col).mapInArrow(_cut(window, gram, n), "bucket int, block binary, doc long, tie long, spans binary")
    return table(cut.groupBy("bucket").applyInArrow(_counted(window), spans.SPANS), "repeats")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row for each document: doc (its id), n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window covers it whose words also start earlier: in a smaller id, or earlier in the same document. Null
    texts and those of fewer words than a window keep all they have. A null id is the smallest. Rows equal in id and text are one
    document; of rows equal in id alone, that with the smaller hash of its text comes first. No rows give no rows. Other columns
    are not read.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches):
            out = []
            for doc, text, found in held:
                words = text.split(None) if text.isascii() and not _ODD.search(text) else _WORD.findall(text)
                stay = spans.staying(found, len(words), window)
                out.append((doc, len(words), int(len(words) - stay.sum()), " ".join(words if stay.all() else [w for w, b in zip(words, stay.tolist(), strict=True) if b])))
            a, b, c, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc", "n_words", "n_removed", "kept"])

    joined = spans.joined(docs, repeats(docs, id_col, text_col, window, gram), id_col, text_col)
    return joined.mapInArrow(kept, "doc long, n_words long, n_removed long, kept string")
