"""Scalar functions of the analyses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(name: Column) -> Column:
    """What stands before the first dot."""
    return F.substring_index(name, ".", 1)


def last_word(line: Column) -> Column:
    """The last word of a line, null if it has none."""
    return F.nullif(F.element_at(F.split(F.btrim(line, F.lit(" \t\n\r\x0b\x0c")), r"\s+"), -1), F.lit(""))


def digits(n: Column) -> Column:
    """How many digits a number has."""
    return F.length(F.abs(n).cast("long").cast("string"))


def branch_bits(n: Column) -> Column:
    """How many variables tell n successors apart: the logarithm of n to base 2, rounded up."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n.cast("long") - 1)))


def bit(n: Column, k: int) -> Column:
    """Bit k of n."""
    return F.shiftright(n, k).bitwiseAND(1)


def gcd(values: Column) -> Column:
    """The greatest common divisor of an array of strides, 0 if it has none, by 64 steps of Euclid's algorithm for each."""
    step = lambda p: F.struct(F.when(p["b"] == 0, p["a"]).otherwise(p["b"]).alias("a"), F.when(p["b"] == 0, p["b"]).otherwise(F.pmod(p["a"], F.greatest(p["b"], F.lit(1)))).alias("b"))
    pair = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("a"), F.abs(b).cast("long").alias("b")), lambda p, _: step(p))["a"]
    return F.aggregate(values, F.lit(0).cast("long"), pair)


def field_offset(offset: Column, size: Column) -> Column:
    """An offset within an object of a size."""
    return F.pmod(offset, size)


def strided(offset: Column, strides: Column) -> Column:
    """All offsets of a field in arrays: offset and multiples of each stride; strides: array of (num, stride)."""
    grow = lambda acc, s: F.flatten(F.transform(acc, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), s["num"].cast("long") - 1), lambda k: x + k * s["stride"])))
    return F.array_sort(F.array_distinct(F.aggregate(strides, F.array(offset.cast("long")), grow)))


def resolved(ctx: Column, site: Column) -> Column:
    """A context whose unknown sites (0) are the given one; null if that makes two sites equal."""
    known = F.transform(ctx, lambda x: F.when(x == 0, site).otherwise(x))
    return F.when(F.size(F.array_distinct(known)) == F.size(known), known)


def path_distance(a: Column, b: Column) -> Column:
    """In how many places two paths differ, with the difference of their lengths."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x) + F.abs(F.size(a) - F.size(b))


def common_suffix(a: Column, b: Column) -> Column:
    """How many last elements two paths share."""
    same = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def subset(a: Column, b: Column) -> Column:
    """Whether all of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def inverted(pairs: Column) -> Column:
    """A map with keys and values exchanged; the last of equal values wins."""
    return F.aggregate(F.map_entries(pairs), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["value"]), F.create_map(e["value"], e["key"])))


def half_average(samples: Column) -> Column:
    """The running half-average of an array in order: (average + sample) / 2 in whole numbers, from 0."""
    return F.aggregate(samples, F.lit(0).cast("long"), lambda acc, x: F.floor((acc + x) / 2))


def version_key(version: Column) -> Column:
    """What versions are sorted by: the part before the dot and the part behind it, padded to two digits."""
    return F.concat(F.substring_index(version, ".", 1), F.lpad(F.element_at(F.split(version, r"\."), 2), 2, "0"))
