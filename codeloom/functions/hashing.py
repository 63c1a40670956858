"""Hashes and set similarities: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _c


def content_hash(text: str | Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(_c(text), 256)


def short_id(text: str | Column) -> Column:
    """The first 64 bits of the hash, as 16 hex digits (an unsigned number does not fit a LONG)."""
    return F.substring(content_hash(text), 1, 16)


def simhash_bits(features: str | Column) -> Column:
    """64 votes over the low 64 bits of each feature's MD5, counted as often as it occurs; 16 hex digits, zeros for none.

    Kept as two 32-bit halves while voting, so that no signed overflow arises.
    """
    f = F.transform(_c(features), lambda x: F.struct(F.conv(F.substring(F.md5(x), 17, 8), 16, 10).cast("bigint").alias("hi"), F.conv(F.substring(F.md5(x), 25, 8), 16, 10).cast("bigint").alias("lo")))

    def half(fs: Column, part: str) -> Column:
        def bit(i: Column) -> Column:
            votes = F.aggregate(fs, F.lit(0).cast("bigint"), lambda acc, x: acc + F.getbit(x[part], i.cast("int")).cast("bigint") * 2 - 1)
            return F.when(votes > 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

        total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(31)), bit), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.lpad(F.lower(F.hex(total)), 8, "0")

    # bound once as an array's element: the hashes would else be computed anew for every bit
    return F.get(F.transform(F.array(f), lambda fs: F.concat(half(fs, "hi"), half(fs, "lo"))), 0)


def hamming_similarity(a: str | Column, b: str | Column) -> Column:
    """1 minus the share of differing bits of two hashes of 16 hex digits."""

    def part(x: Column, i: int) -> Column:
        return F.conv(F.substring(x, i, 8), 16, 10).cast("bigint")

    x, y = _c(a), _c(b)
    return 1 - (F.bit_count(part(x, 1).bitwiseXOR(part(y, 1))) + F.bit_count(part(x, 9).bitwiseXOR(part(y, 9)))) / F.lit(64.0)


def jaccard(a: str | Column, b: str | Column, empty_value: float = 0.0) -> Column:
    """Common over all elements of two arrays taken as sets; `empty_value` if both are empty."""
    x, y = _c(a), _c(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(empty_value)).otherwise(F.size(F.array_intersect(x, y)) / union)
