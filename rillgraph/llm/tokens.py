"""Token ids in fixed-width bit-packed files.

A file is MAGIC, then blocks of BLOCK ids each (the last may be shorter), then a footer, the footer's length
(8 bytes, little-endian) and MAGIC again. A block holds its ids in the least bits that the vocabulary needs, most significant
bit first, padded to whole bytes. The footer is JSON (bits, ids, blocks' places, documents) followed by the documents'
ids, their null marks and their first ids' places: any range of ids is unpacked from its blocks alone.

Files are written beside Spark's own to the shared folder under names of their own. What a lost or repeated
task wrote is never read: the table of files that Spark commits names the valid ones.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import encode
from rillgraph.llm.common import open_fs, partitions, rows, scratch, small_batches, table

MAGIC = b"RGTOKENS"
#: Ids of a block, a multiple of 8, so that blocks of any width end at a byte.
BLOCK = 1 << 16
#: Ids that a reader holds at once, about.
AT_ONCE = 1 << 21


def width(vocabulary_size: int) -> int:
    """The least bits for ids below vocabulary_size."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, most significant bit first, padded to a byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    one_by_one = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(len(ids), 4), axis=1)
    return np.packbits(one_by_one[:, 32 - bits :]).tobytes()


def unpack(block: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(block, f">u{bits // 8}", n).astype(np.uint32)
    one_by_one = np.unpackbits(np.frombuffer(block, np.uint8), count=n * bits).reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, 32 - bits :] = one_by_one
    return np.packbits(whole, axis=1).view(">u4").reshape(n).astype(np.uint32)


class Writer:
    """Writes documents in order to one file."""

    def __init__(self, stream, bits: int) -> None:
        self.stream, self.bits, self.at, self.blocks = stream, bits, len(MAGIC), []
        self.held, self.n, self.ids, self.null, self.first = np.zeros(0, np.uint32), 0, [], [], []
        stream.write(MAGIC)

    def add(self, docs: list[int | None], ids: np.ndarray, lens: np.ndarray) -> None:
        """Documents whose ids stand one after another."""
        self.ids.append(np.array([d or 0 for d in docs], "<i8"))
        self.null.append(np.array([d is None for d in docs], np.uint8))
        self.first.append((self.n + np.cumsum(lens) - lens).astype("<i8"))
        self.n += len(ids)
        held = np.concatenate([self.held, ids])
        for k in range(0, len(held) - BLOCK + 1, BLOCK):
            self._block(held[k : k + BLOCK])
        self.held = held[len(held) // BLOCK * BLOCK :]

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self.stream.write(data := pack(ids, self.bits))
        self.at += len(data)

    def close(self) -> None:
        """Write what is held and the footer."""
        if len(self.held):
            self._block(self.held)
        docs = [b"".join(x.tobytes() for x in part) for part in (self.ids, self.null, self.first)]
        head = json.dumps({"bits": self.bits, "n": self.n, "blocks": self.blocks, "end": self.at, "docs": len(docs[1])}).encode()
        footer = len(head).to_bytes(8, "little") + head + b"".join(docs)
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads a file's documents and any range of its ids."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a file of token ids")
        n = int.from_bytes(tail[:8], "little")
        footer = self._at(size - 16 - n, n)
        k = 8 + int.from_bytes(footer[:8], "little")
        self.head = json.loads(footer[8:k])
        d = self.head["docs"]
        self.doc_ids = np.frombuffer(footer, "<i8", d, k)
        self.null = np.frombuffer(footer, np.uint8, d, k + 8 * d)
        self.first = np.frombuffer(footer, "<i8", d, k + 9 * d)
        self.edges = np.array([*self.head["blocks"], self.head["end"]], np.int64)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, unpacked from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (end - 1) // BLOCK
        data, base, bits = self._at(int(self.edges[a]), int(self.edges[b + 1] - self.edges[a])), self.edges[a], self.head["bits"]
        out = [unpack(data[int(self.edges[k] - base) : int(self.edges[k + 1] - base)], bits, min(BLOCK, self.head["n"] - k * BLOCK)) for k in range(a, b + 1)]
        return np.concatenate(out)[start - a * BLOCK : end - a * BLOCK]


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode and write all documents in ascending order of their ids, a file for each range of ids.

    Returns a row for each file: part (its place among the files), uri, n_docs, n_tokens. A null text is empty: only
    end_id. Null ids come first, rows of equal ids in order of their texts. Empty tables give files without documents or none.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder, vocabulary = scratch(spark, "tokens"), vocabulary or encode.vocabulary()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encode.encoder(vocabulary), TaskContext.get().partitionId()
        where, path = open_fs(f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok")
        where.create_dir(path.rpartition("/")[0], recursive=True)
        n = 0
        with where.open_output_stream(path) as stream:
            writer = Writer(stream, width(encoder.size))
            for held in rows(batches, encode.AT_ONCE):
                ids, lens = encode.ended(*encoder.encode([t for _, t in held]), end_id)
                writer.add([d for d, _ in held], ids, lens)
                n += len(held)
            writer.close()
        encoder.rest()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "uri": [f"{folder}/{path.rpartition('/')[2]}"], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([writer.n], pa.int64())})

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").alias("t"))
    texts = texts.repartitionByRange(partitions(spark), "d").sortWithinPartitions("d", "t")
    return table(texts.mapInArrow(written, "part long, uri string, n_docs long, n_tokens long"), "token-files")


def read(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document of the files: id, start (the ids of all documents before it), n_tokens, ids_crc32.

    What comes to the driver is a row for each file. Documents are read in pieces of about AT_ONCE ids.
    """
    spark = files.sparkSession
    named, start = [], 0
    for part, uri, n_docs, n in sorted(files.collect()):
        if n_docs:
            named.append((len(named), uri, start))
        start += n

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                where, path = open_fs(uri)
                with where.open_input_file(path) as source:
                    reader = Reader(source)
                    edges = np.append(reader.first, reader.head["n"])
                    crcs = np.fromiter(_crcs(reader, edges), np.int64, len(reader.first))
                ids = pa.array(reader.doc_ids, mask=reader.null.astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + reader.first), pa.array(np.diff(edges)), pa.array(crcs)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    n = max(1, len(named))
    given = spark.createDataFrame(named, "k int, uri string, start long").repartitionById(n, "k")
    return given.select("uri", "start").mapInArrow(digests, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def _crcs(reader: Reader, edges: np.ndarray) -> Iterator[int]:
    k = 0
    while k < len(edges) - 1:
        last = max(k + 1, int(np.searchsorted(edges, edges[k] + AT_ONCE, "right")) - 1)
        if last == k + 1:  # one document, which may be long: in pieces
            crc = 0
            for at in range(int(edges[k]), int(edges[k + 1]), AT_ONCE):
                crc = zlib.crc32(reader.ids(at, min(at + AT_ONCE, int(edges[k + 1]))).astype("<u4").tobytes(), crc)
            yield crc
        else:
            data = memoryview(reader.ids(int(edges[k]), int(edges[last])).astype("<u4").tobytes())
            at = 4 * (edges[k : last + 1] - edges[k])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield zlib.crc32(data[a:b])
        k = last
