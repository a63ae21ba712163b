"""Line dedup: which lines of each document stay, as compressed bitmaps.

A line's key is the line with white space stripped at both ends and A-Z lower-cased, hashed to 128 bits. A task
settles by itself the keys that it has seen in enough documents and hands on one mark for each; all other
occurrences go, one row for each key and document, to the range of hashes that they belong to. There they are
sorted by hash, document and place and streamed. So a line that stands in a third of all documents comes to its range as a
few rows for each task. No text is shuffled until a bitmap is applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import SPACE, partitions, rows, small_batches, table

MIN_DOCS = 10
SETTLED, HELD, DROPPED, LINES = range(4)
ROW = "kind int, high long, low long, doc long, text_hash long, at array<int>, n_lines long"
#: Text that a task looks through at once, in characters, about.
AT_ONCE = 32 << 20


def key(line: bytes) -> bytes:
    """The line as it is compared."""
    return line.strip(SPACE.encode()).lower()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document is its id with its text: rows that agree in both are the same document again."""
    return F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _found(min_docs: int, first: bool):
    """The rows ROW of a task's documents (doc, text_hash, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches, AT_ONCE):
            keys: dict[int, dict[tuple, list[int]]] = {}
            out = []
            for doc, text_hash, text in held:
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                out.append((LINES, None, None, doc, text_hash, None, len(lines)))
                places: dict[int, list[int]] = {}
                for i, line in enumerate(lines):
                    if k := key(line):
                        places.setdefault(xxhash.xxh3_128_intdigest(k), []).append(i)
                for h, at in places.items():
                    keys.setdefault(h, {})[doc, text_hash] = at
            for h, where in keys.items():
                high, low = _signed(h >> 64), _signed(h & (1 << 64) - 1)
                if first:  # all but the first document's first line are repeats already
                    best = min(where, key=lambda x: (x[0] is not None, *(y or 0 for y in x)))
                    for d, at in where.items():
                        if rest := at[1:] if d == best else at:
                            out.append((DROPPED, None, None, *d, rest, None))
                    out.append((HELD, high, low, *best, where[best][:1], None))
                elif len(where) >= min_docs:
                    out.append((SETTLED, high, low, None, None, None, None))
                    out += [(DROPPED, None, None, *d, at, None) for d, at in where.items()]
                else:
                    out += [(HELD, high, low, *d, at, None) for d, at in where.items()]
            yield _batch(out)

    return found


_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])


def _streamed(min_docs: int, first: bool):
    """The rows DROPPED of sorted rows SETTLED and HELD; of a hash, fewer than min_docs documents are held."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, drop, held, docs, last = None, False, [], 0, None
        for batch in batches:
            out = []
            for kind, high, low, doc, text_hash, at, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (high, low) != now:
                    now, drop, held, docs, last = (high, low), False, [], 0, None
                if first:  # the first row of a hash stays, the others go
                    if docs and (doc, text_hash) != last:
                        out.append((DROPPED, None, None, doc, text_hash, at, None))
                    docs, last = 1, last if docs else (doc, text_hash)
                    continue
                if kind == SETTLED:
                    drop = True
                    continue
                docs, last = docs + ((doc, text_hash) != last), (doc, text_hash)
                held.append((DROPPED, None, None, doc, text_hash, at, None))
                if drop or docs >= min_docs:
                    drop = True
                    out += held
                    held = []
            yield _batch(out)

    return streamed


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, first: bool = False) -> DataFrame:
    """A row (doc, text_hash, n_lines, n_dropped, keep) for each document; keep is zlib of a bit for each line, first line in the highest bit.

    With first, a line's first occurrence by document and place stays and its repeats go; else a line found in min_docs
    documents or more goes everywhere. Blank lines always stay. A null or empty text is one empty line. A null id is the
    smallest. Rows equal in id and text are one document. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    doc, text_hash = _identity(docs, id_col, text_col)
    texts = docs.select(doc.alias("doc"), text_hash.alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    found = table(texts.mapInArrow(_found(min_docs, first), ROW), "lines")
    n = partitions(docs.sparkSession)
    # hashes are spread evenly, so equal ranges of them are equal parts
    part = F.least(F.floor(F.shiftrightunsigned("high", 1) / float(1 << 63) * n), F.lit(n - 1)).cast("int")
    ranged = found.filter(F.col("kind") <= HELD).repartitionById(n, part).sortWithinPartitions("high", "low", "kind", "doc", "text_hash")
    dropped = ranged.mapInArrow(_streamed(min_docs, first), ROW).unionByName(found.filter(F.col("kind") > HELD))
    each = dropped.groupBy("doc", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_set("at")).alias("at"))
    return each.mapInArrow(_bits, "doc long, text_hash long, n_lines long, n_dropped long, keep binary")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, keep = [], []
        for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("at").to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[np.array(at, np.int64)] = 0
            dropped.append(int(n - bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], names=["doc", "text_hash", "n_lines", "n_dropped", "keep"])


def applied(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs as struct __row, with __kept, its text without the lines that go, __n_lines and __n_dropped."""
    doc, text_hash = _identity(docs, id_col, text_col)
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), doc.alias("__doc"), text_hash.alias("__hash"))
    joined = given.join(found, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__hash") == F.col("text_hash")))
    # only documents that lose a line go through Python
    cut = F.when(F.col("n_dropped") > 0, _cut()(F.col(f"__row.`{text_col}`"), F.col("keep"))).otherwise(F.coalesce(F.col(f"__row.`{text_col}`"), F.lit("")))
    return joined.select("__row", cut.alias("__kept"), F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"))


def _cut():
    @F.arrow_udf("string")
    def cut(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        out = []
        for text, keep in zip(texts.to_pylist(), keeps.to_pylist(), strict=True):
            lines = (text or "").split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
            out.append("\n".join(x for x, b in zip(lines, bits.tolist(), strict=True) if b))
        return pa.array(out, pa.string())

    return cut


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", min_docs: int = MIN_DOCS, first: bool = False, copies: float | None = None) -> DataFrame:
    """docs with their own columns, texts without the lines that go, and n_chars_col, if there, counted anew.

    With copies, a document that would lose more than that share of its characters keeps all its lines: it is a copy, or near copy, of others, which near
    dedup tells, rather than a text with common lines. Null and empty texts become empty; rows equal in id and text are cut alike; an
    empty table stays empty; texts of any length are read whole. Other columns are kept, whatever their names.
    """
    cut = applied(docs, bitmaps(docs, id_col, text_col, min_docs, first), id_col, text_col)
    kinds = dict(docs.dtypes)
    kept, text = F.col("__kept"), F.coalesce(F.col(f"__row.`{text_col}`"), F.lit(""))
    if copies is not None:
        kept = F.when(F.length(kept) < (1 - copies) * F.length(text), text).otherwise(kept)
    new = {text_col: kept, n_chars_col: F.length(kept)}
    return cut.select(*((new[c] if c in new else F.col(f"__row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns))
