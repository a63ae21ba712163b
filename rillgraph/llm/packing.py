"""Best-fit packing of documents' tokens into sequences, by best-two-fit.

A sequence is filled greedily, always with the longest piece that still fits. Then its smallest piece gives way to
two unpacked pieces that fit the larger gap more tightly, where there are such. Pieces are dealt to shards of a bounded
number of pieces by a hash of their task and row, and each shard is packed on its own: only its last sequences can
be emptier than they need be.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import encode
from rillgraph.llm.common import rows, small_batches, table

CAPACITY = 2048
#: Pieces of a shard, about.
SHARD_PIECES = 20_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two(free: int, count: list[int], above: int, gap: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum in (above, gap]; free has bit n set if count[n] > 0."""
    best, found = above, None
    a = (free & ((1 << gap) - 1)).bit_length() - 1
    while a > 0 and 2 * a > best:
        b = (free & ((1 << (min(a, gap - a) + 1)) - 1)).bit_length() - 1
        if b == a and count[a] < 2:
            b = (free & ((1 << a) - 1)).bit_length() - 1
        if b > 0 and a + b > best:
            best, found = a + b, (a, b)
            if best == gap:
                break
        a = (free & ((1 << a) - 1)).bit_length() - 1
    return found


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; lengths are 1 to capacity."""
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(capacity + 2))
    stacks = [order[edges[n] : edges[n + 1]].tolist() for n in range(capacity + 1)]
    count = [len(x) for x in stacks]
    free = sum(1 << n for n in range(1, capacity + 1) if count[n])
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> None:
        nonlocal free
        count[n] -= 1
        if not count[n]:
            free ^= 1 << n

    k = 0
    while free:
        taken, gap = [], capacity
        while n := (free & ((1 << (gap + 1)) - 1)).bit_length():
            taken.append(n - 1)
            take(n - 1)
            gap -= n - 1
        if gap and free:
            smallest = taken[-1]  # they come longest first
            if two := best_two(free, count, smallest, gap + smallest):
                taken.pop()
                count[smallest] += 1
                free |= 1 << smallest
                for n in two:
                    take(n)
                taken += two
        at = 0
        for n in taken:
            i = stacks[n].pop()
            place[i], offset[i] = k, at
            at += n
        k += 1
    return place, offset


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row (PIECE, and __at, its task's number and its own in it) for each piece of each document."""
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or encode.vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = encode.encoder(vocabulary), TaskContext.get().partitionId() << 40
        for held in rows(batches, encode.AT_ONCE):
            ids, lens = encode.ended(*encoder.encode([t for _, t in held]), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            many = -(-lens // capacity)
            doc = np.repeat(np.arange(len(held)), many)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = number * capacity
            length = np.minimum(lens[doc] - start, capacity)
            first = np.cumsum(length) - length
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            own = pa.array([d for d, _ in held], pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([own, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(at + np.arange(len(doc)))], names=["doc_id", "piece", "start", "length", "ids_crc32", "__at"])
            at += len(doc)
        encoder.rest()

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").alias("t"))
    return texts.mapInArrow(cut, f"{PIECE}, __at long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: PIECE, sequence_id and offset.

    Every document has its end id, so a null or empty text is a piece of one id. Rows of equal or null ids are documents
    of their own. An empty table gives no rows. Other columns are not read.
    """
    cut = table(pieces(docs, id_col, text_col, vocabulary, end_id, capacity), "pieces")
    shards = max(1, -(-cut.count() // SHARD_PIECES))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("__at")
        k, offset = best_two_fit(group["length"].to_numpy(), capacity)
        shard = group["__shard"][0].as_py()
        return group.drop_columns(["__at", "__shard"]).append_column("sequence_id", pa.array((shard << 32) + k)).append_column("offset", pa.array(offset))

    dealt = cut.withColumn("__shard", F.pmod(F.xxhash64("__at"), F.lit(shards)))
    return dealt.groupBy("__shard").applyInArrow(place, f"{PIECE}, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
