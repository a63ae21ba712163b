"""Near copies: pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them and no others.

Shingles are counted once however often they stand in a text, as 64-bit hashes. First come SimHash and its vantage-point trees, as in
simhash.py: fingerprints of the sets that are equal or within the radius make pairs, of which those are links whose whole sets are alike. What is alike may
differ in more bits than any radius holds, so an exact join finds the rest among sets that no link connects yet. Put in one order for all texts, two sets of
similarity 0.8 or more have one of the first n // 5 + 1 of their n shingles in common, so those are each text's keys and the candidates are
the pairs that share a key. The order may be any; here what a sample of the documents shows to be common comes last, so that few documents
meet by it. Keys that the same few documents share, as many as such documents have in common, count once. A candidate pair in which too many of the sets' buckets differ goes; each other one is decided by its whole sets. Of a key's documents the first few meet the others, round by round,
and those that links connect already need not meet any more, so a large group of copies costs about a pair for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import common, simhash
from rillgraph.llm.common import likely, partitions, rows, small_batches, table
from rillgraph.llm.components import components
from rillgraph.llm.spans import NULL_ID

SHINGLE = 5
#: Documents of the sample that tells common shingles, in how many of them one is common, and how many are told at most.
SAMPLE, COMMON, TOLD = 1 << 13, 4, 1 << 18
#: A round's leaders of each key are so many times those of all rounds before, about.
GROWTH = 4
#: Keys of at most so many documents are compared between shards.
FEW = 64

def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The set of the text's shingles as sorted hashes."""
    return np.unique(simhash.hashes(text, n))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have similarity 0.8 or more; in whole numbers, as 0.8 itself counts."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def odd(h: np.ndarray) -> bytes:
    """A bit for each of at least 2 len(h) buckets: whether an odd number of the set's hashes falls there."""
    n = max(64, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bits (bytes) for fewer buckets, those that fall together by exclusive or."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_be(size: int, bits: bytes, sizes: np.ndarray, others: list[bytes]) -> np.ndarray:
    """Which of several sets (their sizes and bits) can be alike one. A hash that one set has and the other has not changes one bit at most, so as many
    hashes differ as bits do, at least; of sets that are alike a ninth of both sizes differs at most."""
    own, widths = np.frombuffer(bits, np.uint8)[None, :], np.fromiter(map(len, others), np.int64, len(others))
    differ = np.zeros(len(others), np.int64)
    for width in np.unique(widths).tolist():
        at = np.nonzero(widths == width)[0]
        both = min(width, own.shape[1])
        given = np.frombuffer(b"".join(others[k] for k in at.tolist()), np.uint8).reshape(len(at), width)
        differ[at] = np.bitwise_count(folded(given, both) ^ folded(own, both)).sum(axis=1, dtype=np.int64)
    return 9 * differ <= size + sizes


def size_class(n: np.ndarray) -> np.ndarray:
    """A byte for each size; sizes that differ by a quarter at most have classes that differ by 4 at most."""
    return np.minimum(255, 16 * np.log(np.maximum(n, 1))).astype(np.uint8)


def keys(h: np.ndarray, told: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first len(h) // 5 + 1 of a set, the hashes told to be common (sorted, with their rank) after all others."""
    k = len(h) // 5 + 1
    if not len(told):
        return h[:k]
    at = np.minimum(np.searchsorted(told, h), len(told) - 1)
    last = told[at] == h
    few = h[~last][:k]
    return few if len(few) == k else np.concatenate([few, h[last][np.argsort(rank[at[last]])]])[:k]


def _common(given: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that are common in a sample, sorted, and each one's rank, the most common last."""
    share = min(1.0, SAMPLE / max(1, given.count()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches):
            h, n = np.unique(np.concatenate([shingles(t, shingle) for _, t in held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    sample = given.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sample.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    found = found.orderBy(F.desc("n"), "h").limit(TOLD).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], rank[order]


def fingerprints(given: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row (id, fp, n, keys, odd, sim) for each row (id, text): the digest of its set, the set's size, its keys, its buckets' bits, its SimHash."""
    told = given.sparkSession.sparkContext.broadcast(_common(given, shingle))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches):
            sets = [shingles(t, shingle) for _, t in held]
            fp = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            first = [keys(h, *told.value).tobytes() for h in sets]
            columns = [pa.array([d for d, _ in held], pa.int64()), pa.array(fp, pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(first, pa.binary()), pa.array([odd(h) for h in sets], pa.binary())]
            columns.append(pa.array(np.array([simhash.fingerprint(h) for h in sets], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "n", "keys", "odd", "sim"])

    return given.mapInArrow(made, "id long, fp binary, n int, keys binary, odd binary, sim long")


def _fingerprinted(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of tags by SimHash: sets of one fingerprint with the least of them, and the least ones of fingerprints that the vantage-point trees link."""
    least = table(distinct.groupBy("sim").agg(F.min("tag").alias("least")), "sims")
    same = distinct.select("tag", "sim").join(least.withColumnRenamed("sim", "s"), F.col("sim") == F.col("s")).filter("tag <> least").select(F.col("least").alias("u"), F.col("tag").alias("v"))
    linked = simhash.links(least.select(F.col("sim").alias("fp"))).toDF("a", "b")
    linked = linked.join(least.toDF("s", "u"), F.col("a") == F.col("s")).select("b", "u").join(least.toDF("s", "v"), F.col("b") == F.col("s")).select("u", "v")
    return same.unionByName(linked)


def _meeting(distinct: DataFrame) -> DataFrame:
    """Rows (shard, bucket, tag, n): the documents (tag, n, keys) of each key that several have; of keys with the same documents one, or, if they are more than FEW,
    one in each shard.

    To a shard go 32 bits of each key and the size's class, n; keys that clash there are one bucket with more candidates.
    """
    shards = 4 * partitions(distinct.sparkSession)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag, n, held = (batch.column(k) for k in range(3))
            held = [np.frombuffer(x, "<u8") for x in held.to_pylist()]
            many = np.fromiter(map(len, held), np.int64, len(held))
            key = np.concatenate([np.zeros(0, np.uint64), *held])
            with np.errstate(over="ignore"):
                key *= np.uint64(0x9E3779B97F4A7C15)
            at = (key >> np.uint64(33)).astype(np.int64) % shards
            key = (key >> np.uint64(1)).astype("<u4")
            order = np.argsort(at, kind="stable")
            key, tags, sizes, at = key[order], np.repeat(tag.to_numpy(), many)[order], np.repeat(size_class(n.to_numpy()), many)[order], at[order]
            edges = np.append(np.nonzero(np.diff(at, prepend=-1))[0], len(at))
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            parts = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, tags, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]], pa.int32()), *parts], names=["shard", "keys", "tags", "sizes"])

    def met(group: pa.Table) -> pa.Table:
        key, tag, n = (np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("keys", "<u4"), ("tags", "<i8"), ("sizes", np.uint8)))
        order = np.lexsort((tag, key))
        key, tag, n = key[order], tag[order], n[order]
        edges = np.append(np.nonzero(np.diff(key, prepend=~key[:1]))[0], len(key))
        several = np.nonzero(np.diff(edges) > 1)[0]
        known, spans = set(), []
        for a, b in zip(edges[several].tolist(), edges[several + 1].tolist(), strict=True):
            if (held := xxhash.xxh3_128_digest(tag[a:b].tobytes())) not in known:
                known.add(held)
                spans.append((a, b))
        # few documents are known by their digest in all shards, many by their shard and place
        held = [tag[a:b].tobytes() for a, b in spans]
        name = [xxhash.xxh3_128_digest(x) if len(x) <= 8 * FEW else b"%d.%d" % (group["shard"][0].as_py(), k) for k, x in enumerate(held)]
        return pa.table([pa.array(name, pa.binary()), pa.array(held, pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], names=["name", "tags", "sizes"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 12):
                name, tags, sizes = (c.to_pylist() for c in batch.slice(k, 1 << 12).columns)
                many = np.fromiter(map(len, sizes), np.int64, len(sizes))
                h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in name), np.uint64, len(name))
                shard = np.repeat((h % np.uint64(shards)).astype(np.int32), many)
                tag, n = np.frombuffer(b"".join(tags), "<i8"), np.frombuffer(b"".join(sizes), np.uint8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.repeat(h.view(np.int64), many)), pa.array(tag), pa.array(n)], names=["shard", "bucket", "tag", "n"])

    sent = distinct.select("tag", "n", "keys").mapInArrow(dealt, "shard int, keys binary, tags binary, sizes binary")
    buckets = sent.groupBy("shard").applyInArrow(met, "name binary, tags binary, sizes binary").dropDuplicates(["name"])
    return buckets.mapInArrow(spread, "shard int, bucket long, tag long, n int")


def _candidates(meeting: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs (u, v) of _meeting() with roots, sizes and bits: each bucket's documents at places low to high - 1, with those after them that have another root and
    sizes and bits that allow 0.8. Pairs that these rule out are never rows."""

    def paired(group: pa.Table) -> pa.Table:
        bucket, tag, n, root, size = (group[c].to_numpy() for c in ("bucket", "tag", "n", "root", "size"))
        order = np.lexsort((tag, bucket))
        bucket, tag, n, root, size = bucket[order], tag[order], n[order].astype(np.int64), root[order], size[order].astype(np.int64)
        bits = group["odd"].combine_chunks().take(pa.array(order)).to_pylist()
        edges = np.append(np.nonzero(np.diff(bucket, prepend=~bucket[:1]))[0], len(bucket))
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for k in range(a + low, min(a + high, b - 1)):
                rest = slice(k + 1, b)
                fit = k + 1 + np.nonzero((root[rest] != root[k]) & (np.abs(n[rest] - n[k]) <= 4))[0]
                fit = fit[may_be(int(size[k]), bits[k], size[fit], [bits[j] for j in fit.tolist()])]
                v.append(tag[fit])
                u.append(np.full(len(v[-1]), tag[k]))
        both = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
        return pa.table([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["u", "v"])

    return meeting.groupBy("shard").applyInArrow(paired, "u long, v long").distinct()


def links(given: DataFrame, distinct: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links (u, v) between tags, all of similarity 0.8 or more, that connect whatever pairs of that similarity connect."""
    meeting = table(_meeting(distinct), "meeting")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches):
            sets = [shingles(t, shingle).tobytes() for _, t in held]
            tags = [int.from_bytes(xxhash.xxh3_128_digest(x)[:8], "big", signed=True) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(sets, pa.binary())], names=["tag", "held"])

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([alike(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(a, b, strict=True)], pa.bool_())

    ends = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("t")).distinct()
    found, rooted, low, high = [], None, 0, 0
    while True:
        start = list(common.made)
        if rooted is None:
            marked, pairs = None, table(_fingerprinted(distinct), "pairs")
        else:
            marked = rooted.join(distinct.select(F.col("tag").alias("t"), F.col("n").alias("size"), "odd"), F.col("tag") == F.col("t")).drop("t")
            pairs = table(_candidates(marked, low, high), "pairs")
        # only the sets that pairs need are shuffled
        wanted = table(distinct.select("tag", "node").join(ends(pairs), F.col("tag") == F.col("t"), "left_semi").select("node").distinct(), "wanted")
        texts = likely(given, F.col("id"), wanted).join(wanted, F.col("id") == F.col("node"), "left_semi")
        # rows of equal ids and texts give a set twice, and so a link twice
        sets = table(texts.mapInArrow(whole, "tag long, held binary"), "sets")
        both = pairs.join(sets.toDF("t", "a"), F.col("u") == F.col("t")).drop("t").join(sets.toDF("t", "b"), F.col("v") == F.col("t"))
        found.append(table(both.filter(near("a", "b")).select("u", "v"), "near"))
        del marked, pairs, both, wanted, texts, sets
        common.sweep([x for x in common.made[:-1] if x not in start])  # all that led to it
        common.settle(given.sparkSession)
        low, high = high, high + GROWTH * high or 1
        linked_ = reduce(DataFrame.unionByName, found)
        roots = components(linked_)
        # a bucket goes on while it has places that have not led, and several roots
        size = meeting.join(roots, F.col("tag") == F.col("node"), "left").select("shard", "bucket", "tag", "n", F.coalesce("root", "tag").alias("root"))
        open_ = size.groupBy("shard", "bucket").agg(F.count("*").alias("m"), F.min("root").alias("a"), F.max("root").alias("b")).filter((F.col("m") > low + 1) & (F.col("a") != F.col("b")))
        open_ = open_.select(F.col("shard").alias("s"), F.col("bucket").alias("k"))
        rooted = table(size.join(open_, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("k")), "left_semi"), "open")
        if rooted.isEmpty():
            return linked_


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without near copies: of each group that links connect, the document with the smallest id stays.

    Texts without words, null ones among them, are copies of each other. Rows of equal ids are one document, of which the row with the least
    text stays (null first, then by all its columns as JSON); a null id is the smallest. Texts are read whole, a few at a time, however long.
    An empty table stays empty. Other columns are kept, whatever their names.
    """
    small_batches(docs.sparkSession)
    start = len(common.made)
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    given = docs.select(id_.alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = table(fingerprints(given, shingle), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("id").alias("node"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd"), F.first("sim").alias("sim"))
    distinct = table(distinct.withColumn("tag", F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")), "distinct")
    roots = components(links(given, distinct, shingle))
    rooted = distinct.join(roots.toDF("t", "root"), F.col("tag") == F.col("t"), "left").select("node", F.coalesce("root", "tag").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").withColumnRenamed("root", "r")
    far = rooted.join(least, F.col("root") == F.col("r")).filter("node > least").select(F.col("node").alias("id"))
    copies = made.select("id", "fp").join(distinct.filter("node < last").select(F.col("fp").alias("f"), "node"), F.col("fp") == F.col("f")).filter("id > node").select("id")
    several = not made.groupBy("id").count().filter("count > 1").isEmpty()
    gone = table(copies.unionByName(far).distinct(), "gone")
    common.sweep(common.made[start:-1])  # all that led to it
    other = common.unused(docs, "gone")
    kept = docs.join(gone.withColumnRenamed("id", other), id_ == F.col(other), "left_anti")
    if not several:
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = F.min_by(row, F.struct(F.col(f"`{text_col}`"), F.to_json(row)))
    one = kept.groupBy(F.col(f"`{id_col}`").alias(other)).agg(least.alias("row"))
    return one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
