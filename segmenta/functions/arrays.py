"""Array mathematics as column expressions: one segment is one row, so nothing shuffles and nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def energy(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def centered(a: Column) -> Column:
    """The array less its mean. a must be a plain column: it is used in a lambda."""
    m = F.struct(mean(a).alias("m"))
    return F.flatten(F.transform(F.array(m), lambda s: F.transform(a, lambda x: x - s.m)))


def phase(a: Column, bounds: tuple[int, int]) -> Column:
    return F.slice(a, bounds[0] + 1, bounds[1] - bounds[0])


def rms(a: Column) -> Column:
    return F.sqrt(energy(a) / F.size(a))


def power_spectrum(a: Column, n: int) -> Column:
    """|DFT|^2 at bins 0..n/2 by fixed cosine and sine tables; meant for short segments of a fixed length."""
    table = lambda f, k: F.array(*[F.lit(f(2 * math.pi * k * j / n)) for j in range(n)])
    bins = []
    for k in range(n // 2 + 1):
        re, im = dot(a, table(math.cos, k)), dot(a, table(math.sin, k))
        bins.append(re * re + im * im)
    return F.array(*bins)
