"""Ranks and percentiles of groups of any size: from a histogram that is dealt by ranges of values, so that no task sorts or
holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges that the distinct values of a group are cut into.
RANGES = 64


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of the same names, where nulls are equal; the left side's columns stay."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    right = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_on_{k}" for k in keys])


def histogram(df: DataFrame, by: list[str], value: str, key: Column | None = None) -> DataFrame:
    """by, value, n (its rows), below (rows of the group with less) and of (rows of the group); nulls are left out.

    Rows are counted before any shuffle; distinct values are cut at their approximate quantiles, running counts are taken within
    a range, and the counts of the ranges before, at most RANGES to a group, are added. key: a number that rises with the value,
    where that is none itself.
    """
    key = F.col(value) if key is None else key
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)], 1000).alias("_cuts"))
    dealt = joined(counts, cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < key))).drop("_cuts")
    x = dealt.withColumn("below", F.sum("n").over(W.partitionBy(*by, "_range").orderBy(value)) - F.col("n"))
    sums = dealt.groupBy(*by, "_range").agg(F.sum("n").alias("_n"))
    group = W.partitionBy(*by)
    before = sums.select(*by, "_range", (F.sum("_n").over(group.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("of"))
    return joined(x, before, [*by, "_range"]).select(*by, value, "n", (F.col("below") + F.col("_before")).alias("below"), "of")


def numbered(df: DataFrame, by: list[str], order: str, name: str, key: Column | None = None) -> DataFrame:
    """df with each row's number in its group, from 1, in the order of a column; rows of one value are numbered in any order."""
    ranks = histogram(df, by, order, key).select(*by, order, "below")
    ties = F.row_number().over(W.partitionBy(*by, order).orderBy(F.lit(0)))
    return joined(df.withColumn("_tie", ties), ranks, [*by, order]).withColumn(name, F.col("below") + F.col("_tie")).drop("below", "_tie")


def average_ranks(df: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """df and the ranks (from 1, ties averaged) of columns, under the names given; rows without a value go.

    A histogram of few values is broadcast at run time; one of many has no frequent keys to speak of.
    """
    out = df
    for value, name in names.items():
        ranks = histogram(df, by, value).select(*by, value, (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
        out = joined(out, ranks, [*by, value])
    return out


def percentiles(df: DataFrame, by: list[str], values: dict[str, Column], points: list[float]) -> DataFrame:
    """by and an array of the percentiles (interpolated between neighbours) of each value, under its name; of all values of a
    group in one pass. Groups without any value have no row."""
    parts = F.array(*[F.struct(F.lit(k).alias("_name"), c.cast("double").alias("_value")) for k, c in values.items()])
    h = histogram(df.select(*by, F.inline(parts)), [*by, "_name"], "_value")
    place = [F.lit(p) * (F.col("of") - 1) for p in points]
    at = lambda r: F.min(F.when(F.col("below") + F.col("n") > r, F.col("_value")))
    found = h.groupBy(*by, "_name").agg(F.first("of").alias("of"), *[x for k, r in enumerate(place) for x in (at(F.floor(r)).alias(f"_lo{k}"), at(F.ceil(r)).alias(f"_hi{k}"))])

    def between(k: int) -> Column:
        part = place[k] - F.floor(place[k])
        return F.when(part == 0, F.col(f"_lo{k}")).otherwise((1 - part) * F.col(f"_lo{k}") + part * F.col(f"_hi{k}"))

    rows = found.select(*by, "_name", F.array(*[between(k) for k in range(len(points))]).alias("_p"))
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, F.col("_p"))).alias(k) for k in values])


def with_percentiles(grouped: DataFrame, df: DataFrame, by: list[str], values: dict[str, Column], points: list[float]) -> DataFrame:
    """Aggregates of df by the same columns, and the percentiles beside them; null where a group has no value."""
    p = percentiles(df, by, values, points)
    if not by:
        return grouped.join(F.broadcast(p), F.lit(True), "left")  # one row at most
    return joined(grouped, p, by, "left")
