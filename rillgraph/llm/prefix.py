"""Suffix-array dedup by distributed prefix doubling, for repeats of at least LENGTH bytes.

Two positions are in the same group if the strings of LENGTH bytes from them agree. The order of groups does not matter,
so a rank is a digest, equal for equal strings, and doubling joins two ranks of shorter strings to the rank of a longer one. In each
round Spark sorts rows (rank, rank at the round's offset, position), and the sorted rows are streamed: a row whose rank no other has is
unique and goes, rows that agree in the pair agree up to the round's length, and what is left goes to the next round.

1. Ranks of up to GRAM bytes need no shuffle, as they are made in each document. Every string of LENGTH bytes has one leading position, that
   of its least rank of GRAM bytes; neighbouring strings mostly share it, and such a run is one row with the pair (rank at the
   leading position, rank of the whole run). Rows whose first rank is unique are done: no string in them is repeated. Of rows with equal
   pairs the first stays; all strings of the others are repeats.
2. Where different rows share their first rank, positions are ranked singly, by the pair of that rank and the rank of
   LENGTH bytes, itself made of the pair (rank of HALF bytes, rank of HALF bytes at the offset LENGTH - HALF). That is past the
   threshold: rows are sorted again, and all but the first of equal pairs are repeats.

A pair has 128 bits; strings that agree in their leading GRAM bytes are told apart by the 64 of the second rank alone, and bytes are not
compared. Each task settles equal pairs of its own first and hands on the earliest, so that a group of many copies is a few rows for
each task. No group is held: a task keeps one batch of sorted rows and the first row of the group before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillgraph.llm import spans
from rillgraph.llm.common import partitions, rows, table

LENGTH, GRAM, HALF = 100, 48, 64
#: Characters of text that a task looks through at once, about: for runs, and for single positions, which are many more rows.
AT_ONCE, SINGLY_AT_ONCE = 2 << 20, 1 << 20
#: Sorted rows that a task looks through at once, and repeated positions after which it hands on their spans.
ROWS, PLACES = 1 << 16, 1 << 20

_RANKS = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def doubled(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of GRAM = 32 + 16 and of HALF = 2 * 32 bytes from each position, by doubling."""
    with np.errstate(over="ignore"):
        ranks, span, by = _RANKS[np.frombuffer(text, np.uint8)], 1, {}
        while span < 32:
            ranks = _mixed(ranks[: len(ranks) - span] * _ODD + ranks[span:])
            span *= 2
            by[span] = ranks
        gram = by[32][: len(text) - 47] * _ODD + by[16][32:]
        half = by[32][: len(by[32]) - 32] * _ODD + by[32][32:]
        return _mixed(gram), _mixed(half)


def extreme(x: np.ndarray, n: int, of) -> np.ndarray:
    """The least (np.minimum) or largest (np.maximum) of every n consecutive."""
    span = 1
    while span < n:
        step = min(span, n - span)
        x = of(x[: len(x) - step], x[step:])
        span += step
    return x


def led(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of windows of n ranks with the same leading position start, and that position: the first of the least."""
    low = extreme(gram, n, np.minimum)
    padded = np.concatenate([np.zeros(n - 1, np.uint64), low, np.zeros(n - 1, np.uint64)])
    leads = np.nonzero(extreme(padded, n, np.maximum) == gram)[0]
    # a run starts where the least changes, and behind a leading position whose equal comes later
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    behind = leads[leads < len(low) - 1]
    new[behind[gram[behind] == low[behind]] + 1] = True
    start = np.nonzero(new)[0]
    k, value = np.searchsorted(leads, start), low[start]
    while len(wrong := np.nonzero(gram[leads[k]] != value)[0]):
        k[wrong] += 1
    lead = leads[k]
    join = np.concatenate([[True], lead[1:] != lead[:-1]])
    return start[join], lead[join]


def run_rows(text: bytes, singly: bool = False) -> tuple[np.ndarray, ...]:
    """First position, number of positions, and rank pair of each run of a text of LENGTH bytes or more; or of each position."""
    gram, half = doubled(text)
    n = LENGTH - GRAM + 1
    start, lead = led(gram, n)
    many = np.diff(np.append(start, len(gram) - n + 1))
    if singly:
        with np.errstate(over="ignore"):
            whole = _mixed(half[: len(text) - LENGTH + 1] * _ODD + half[LENGTH - HALF :])
        return np.arange(len(whole)), np.ones(len(whole), np.int64), np.repeat(gram[lead], many), whole
    length = many + LENGTH - 1  # less than 3 * HALF
    with np.errstate(over="ignore"):
        whole = _mixed(half[start] * _ODD + half[start + (length - HALF) // 2]) * _ODD + half[start + length - HALF]
        whole = _mixed(whole + (lead - start).astype(np.uint64)) * _ODD + many.astype(np.uint64)
    return start, many, gram[lead], _mixed(whole)


FIELDS = ("a", "b", "doc", "tie", "start", "many")
KINDS = (np.uint64,) * 2 + (np.int64,) * 4
#: What a task hands on: rows with ranks for the partition (by a hash of the first rank) that they are sorted in, and spans of what it settles itself.
SENT = "bucket int, a long, b long, doc long, tie long, start long, many int, spans binary"


def _firsts(parts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of pair and position: which are the first of their pair, and which repeat it elsewhere."""
    a, b, doc, tie, start = (parts[k] for k in FIELDS[:5])
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    repeat = ~first & ((doc != doc[head]) | (tie != tie[head]) | (start != start[head]))  # the same row again isn't earlier
    return first, repeat


def _chosen(parts: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: x[which] for k, x in parts.items()}


def _merged(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in zip(FIELDS, KINDS, strict=True)}


def _spans(parts: dict[str, np.ndarray]) -> pa.Table:
    """Spans of the positions of rows."""
    doc, tie, start, many = (parts[k] for k in FIELDS[2:])
    of = np.repeat(np.arange(len(doc)), many)
    return spans.of_places(doc[of], tie[of], start[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))


def _sent(parts: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """SENT of a task's rows: the first of equal pairs, and spans of the others."""
    parts = _chosen(parts, np.lexsort((parts["start"], parts["tie"], parts["doc"], parts["b"], parts["a"])))
    first, repeat = _firsts(parts)
    stay, settled = _chosen(parts, first), _spans(_chosen(parts, repeat))
    with np.errstate(over="ignore"):  # leading ranks are the least of many, so they are spread anew
        bucket = ((_mixed(stay["a"] * _ODD) >> np.uint64(40)).astype(np.int64) * buckets >> 24).astype(np.int32)
    many = pa.array(stay["many"].astype(np.int32))
    columns = [pa.array(bucket), *(pa.array(stay[k].view(np.int64)) for k in FIELDS[:5]), many, pa.nulls(len(bucket), pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", *FIELDS, "spans"])
    if len(settled):
        doc = settled["doc"].combine_chunks()
        none = pa.nulls(len(doc), pa.int64())
        columns = [pa.array((doc.to_numpy() % buckets).astype(np.int32)), none, none, doc, settled["tie"].combine_chunks(), none, pa.nulls(len(doc), pa.int32()), settled["spans"].combine_chunks()]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *FIELDS, "spans"])


def _runs(buckets: int):
    """SENT of runs from (doc, tie, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches, AT_ONCE):
            parts = []
            for doc, tie, text in held:
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= LENGTH:
                    start, many, a, b = run_rows(data)
                    parts.append({"a": a, "b": b, "doc": np.full(len(start), doc), "tie": np.full(len(start), tie), "start": start, "many": many})
            yield from _sent(_merged(parts), buckets)

    return made


def _singles(buckets: int):
    """SENT of single positions from (doc, tie, text, spans)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches, SINGLY_AT_ONCE):
            parts = []
            for doc, tie, text, found in held:
                start, many, a, b = run_rows(text.encode("utf-8", "surrogatepass"), singly=True)
                at = np.nonzero(~spans.staying(found, len(start), 1))[0]
                parts.append({"a": a[at], "b": b[at], "doc": np.full(len(at), doc), "tie": np.full(len(at), tie), "start": at, "many": many[at]})
            yield from _sent(_merged(parts), buckets)

    return made


def _thick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, several at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: spans of repeats, and spans of the rows that the next round has to tell apart (todo).

    The last row that is the first of its pair is carried on to the next batch, with whether a row before it shares its first rank.
    """
    carried, was_shared = _merged([]), False
    found: dict[bool, list] = {False: [], True: []}

    def out(todo: bool) -> Iterator[pa.RecordBatch]:
        t = _spans(_merged(found[todo]))
        found[todo].clear()
        yield from t.append_column("todo", pa.array([todo] * len(t), pa.bool_())).to_batches()

    for t in _thick(batches):
        settled = t.filter(t["spans"].is_valid()).select(["doc", "tie", "spans"])
        yield from settled.append_column("todo", pa.array([False] * len(settled), pa.bool_())).to_batches()
        t = t.filter(t["spans"].is_null())
        parts = _merged([carried, {k: t[k].to_numpy().astype(np.int64).view(kind) for k, kind in zip(FIELDS, KINDS, strict=True)}])
        if not len(parts["a"]):
            continue
        first, repeat = _firsts(parts)
        found[False].append(_chosen(parts, repeat))
        heads = _chosen(parts, first)
        same = heads["a"][1:] == heads["a"][:-1]
        shared = np.append(was_shared, same)
        shared[:-1] |= same
        carried, was_shared = _chosen(heads, np.s_[-1:]), bool(shared[-1])
        found[True].append(_chosen(heads, np.nonzero(shared[:-1])[0]))
        for todo in found:
            if sum(int(x["many"].sum()) for x in found[todo]) >= PLACES:
                yield from out(todo)
    if was_shared:
        found[True].append(carried)
    for todo in found:
        yield from out(todo)


def _round(sent: DataFrame, buckets: int) -> DataFrame:
    """One round: rows sorted by rank pair and position, those of equal first rank together, and told apart."""
    dealt = sent.repartitionById(buckets, "bucket").drop("bucket")
    return dealt.sortWithinPartitions("a", "b", "doc", "tie", "start").mapInArrow(_reranked, f"{spans.SPANS}, todo boolean")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tie, spans): runs of positions from which LENGTH bytes also start earlier."""
    n = partitions(docs.sparkSession)
    texts = spans.identified(docs, id_col, text_col)
    ranked = table(_round(texts.mapInArrow(_runs(n), SENT), n), "ranked")
    todo = spans.only(texts, ranked.filter("todo").drop("todo"))
    found = _round(todo.mapInArrow(_singles(n), SENT), n).filter("not todo")
    return found.unionByName(ranked.filter("not todo")).drop("todo")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc (its id), n_bytes, n_removed, n_spans (runs removed), kept (the bytes that stay).

    A byte goes if LENGTH bytes that cover it also start earlier: in a smaller id, or earlier in the same document. Null texts
    have no bytes, and shorter texts keep all they have. A null id is the smallest. Rows equal in id and text are one
    document; of rows equal in id alone, that with the smaller hash of its text comes first. No rows give no rows. Other columns
    are not read.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches):
            out = []
            for doc, text, found in held:
                data = text.encode("utf-8", "surrogatepass")
                if found:
                    stay = spans.staying(found, len(data), LENGTH)
                    gone = int(len(data) - stay.sum())
                    cuts = int(np.count_nonzero(np.diff(stay.astype(np.int8), prepend=1) == -1))
                    out.append((doc, len(data), gone, cuts, np.frombuffer(data, np.uint8)[stay].tobytes()))
                else:
                    out.append((doc, len(data), 0, 0, data))
            columns = zip(*out, strict=True)
            kinds = (pa.int64(),) * 4 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = spans.joined(docs, repeats(docs, id_col, text_col), id_col, text_col)
    return joined.mapInArrow(kept, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
