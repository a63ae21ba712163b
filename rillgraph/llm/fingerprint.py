"""Document fingerprints: canonical exact digests, and neighbours in descending order of ids.

A text's canonical form is its NFKC normal form, case-folded, with every run of white space one space and none at the
ends. Its digest is the 128-bit xxhash of that. Documents are grouped by digest; where a group has several, their forms
are compared byte for byte (least and greatest form, partial before the shuffle), and only if they differ get numbers that tell them
apart. So equal fingerprints mean equal forms. The likeness of two texts is 1 if their forms are equal bytes, else 0.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import likely, partitions, rows, table


def canonical(text: str) -> str:
    """The form whose bytes are compared."""
    if not text.isascii():
        # folding may undo the normal form
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def digest(form: str, digits: int = 32) -> str:
    """The form's 128-bit xxhash as hexadecimal digits."""
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))[:digits]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def unlike(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = 32) -> DataFrame:
    """(digest, form, number) for digests that stand for different forms; digests has a row (id, digest) for each document.

    Only texts of documents that share their digest with others are compared: a filter of bounded size finds most of the rest,
    so that few of them are shuffled.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows(batches):
            made = [canonical(t) for _, t in held]
            yield pa.RecordBatch.from_pydict({"digest": [digest(x, digits) for x in made], "form": made})

    # a table of its own, so that a digest with very many documents can be split in the join
    several = table(digests.groupBy("digest").count().filter("count > 1").select(F.col("digest").alias("d")), "several")
    members = digests.join(several, F.col("digest") == F.col("d"), "left_semi").select(F.coalesce("id", F.lit(0)).alias("id")).distinct()
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _text(text_col).alias("text"))
    found = likely(texts, F.coalesce("id", F.lit(0)), table(members, "members")).mapInArrow(forms, "digest string, form string")
    least = found.groupBy("digest").agg(F.min("form").alias("a"), F.max("form").alias("b")).filter("a != b").select(F.col("digest").alias("d"))
    least = table(least, "collisions")
    # as many rows as different forms that collide: none, but for short digests
    apart = found.join(least, F.col("digest") == F.col("d"), "left_semi").distinct().groupBy("digest").agg(F.sort_array(F.collect_list("form")).alias("f"))
    return apart.select("digest", F.posexplode("f").alias("number", "form"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): each document with the text of the next one in descending order of ids, after the last that of the first.

    Ids are cut into ranges; of each range, the first document also goes to the range before it, so one shuffle of the texts is
    all. A range's bounds come from a sample of ids, its first document from an aggregate: a row for each range comes to the driver.
    Null ids come last; rows of equal ids in order of a hash of their texts. The only document is its own next.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _text(text_col).alias("text"))
    n = partitions(spark)
    ids = texts.filter("id is not null").select("id")
    cuts = np.unique(np.array(ids.stat.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n), np.float64).astype(np.int64))

    @F.arrow_udf("int")
    def ranged(i: pa.Array) -> pa.Array:  # range 0 holds the largest ids, the last one the smallest and nulls
        place = len(cuts) - np.searchsorted(cuts, i.fill_null(0).to_numpy(zero_copy_only=False), "left")
        return pa.array(np.where(i.is_null().to_numpy(zero_copy_only=False), len(cuts), place).astype(np.int32))

    placed = texts.select("id", "text", F.xxhash64("text").alias("h"), ranged("id").alias("part"))
    found = placed.groupBy("part").agg(F.max(F.struct("id", "h")).alias("o")).collect()
    heads = sorted((r.part, r.o.id, r.o.h) for r in found)
    before = [heads[k - 1][0] for k in range(len(heads))]
    known = spark.createDataFrame([(*x, to) for x, to in zip(heads, before, strict=True)], "p int, head_id long, head_h long, before int")
    # known has a row for each range
    both = placed.join(F.broadcast(known), F.col("part") == F.col("p"))
    here, there = F.struct(F.col("part").alias("to"), F.lit(False).alias("visits")), F.struct(F.col("before").alias("to"), F.lit(True).alias("visits"))
    first = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    dealt = both.select("id", "text", "h", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("x"))
    dealt = dealt.select("id", "text", "h", "x.to", "x.visits").repartitionById(len(cuts) + 1, "to")
    dealt = dealt.sortWithinPartitions("visits", F.col("id").desc_nulls_last(), F.col("h").desc())

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for held in rows(batches):
            for i, text, visits in held:
                if last is not None:
                    out.append((*last, text))
                last = None if visits else (i, text)
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], names=["id", "text", "next"])
                out = []

    return dealt.select("id", "text", "visits").mapInArrow(paired, "id long, text string, next string")


def edited(text: str, following: str) -> str:
    """The text, its last third's code points replaced by as many first ones of the following text (or all it has)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = 32) -> DataFrame:
    """A row for each document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. Forms that differ but share a digest of that many digits get numbers behind it; an edited text's form
    that shares a digest with another form at hand, but is no document's, gets an x. No rows give no rows. Other columns are not read.
    """
    pairs = neighbours(docs, id_col, text_col)

    def made(numbers: dict[tuple[str, str], int]):
        collide = {d for d, _ in numbers}

        def name(form: str, others: tuple[str, ...] = ()) -> str:
            d = digest(form, digits)
            if (d, form) in numbers:
                return f"{d}-{numbers[d, form]}"
            return d + "-x" * (d in collide or any(o != form and digest(o, digits) == d for o in others))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in rows(batches):
                out = []
                for i, text, following in held:
                    other = edited(text, following)
                    form, form_edited, form_next = canonical(text), canonical(other), canonical(following)
                    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((i, len(text), sha, name(form), name(form_edited, (form, form_next)), float(form == form_edited), float(form == form_next)))
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

        return each

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = table(pairs.mapInArrow(made({}), schema), "fingerprints")
    digests = found.select(F.col(f"`{id_col}`").alias("id"), F.col("fingerprint").alias("digest"))
    numbers = {(r.digest, r.form): r.number for r in unlike(docs, digests, id_col, text_col, digits).collect()}
    return pairs.mapInArrow(made(numbers), schema) if numbers else found
