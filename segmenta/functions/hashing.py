"""Hashes and seeds that another engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def keyed_seed(key: Column, base: int) -> Column:
    """base plus the first four digest bytes as a little-endian number, modulo 2**32."""
    h = F.sha2(key.cast("binary"), 256)
    flipped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return (F.lit(base) + F.conv(flipped, 16, 10).cast("long")) % 4294967296


def char_sum(c: Column) -> Column:
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda a, x: a + F.ascii(x))


def md5_draw(*parts: Column, below: Column | int) -> Column:
    """A whole number from 0 to below - 1 that only depends on the parts."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % below
