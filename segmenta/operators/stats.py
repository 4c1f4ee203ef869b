"""Rank statistics, cluster bootstraps and small models as DataFrame plans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.functions.hashing import md5_draw
from segmenta.operators.orderstats import average_ranks


def spearman(df: DataFrame, by: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Rank correlation of complete pairs by group; none for fewer than three pairs or a constant side."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = average_ranks(d, by, {x: "_rx", y: "_ry"})
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias(name))
    return g.withColumn(name, F.when((F.col("n") >= 3) & ~F.isnan(name), F.col(name)))


def draws(clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, idx, weight): how often each of the clusters, numbered idx from 0, is drawn in each replicate.

    Draws depend on md5 alone, so any engine and any partitioning gives the same. clusters: one row with its number n.
    """
    reps = clusters.select("n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    each = reps.select("n", F.col("rep").cast("long").alias("rep"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("d"))
    picked = each.select("rep", md5_draw(F.lit(seed), F.col("rep"), F.col("d"), below=F.col("n")).alias("idx"))
    return picked.groupBy("rep", "idx").agg(F.count("*").alias("weight"))


def interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Percentile interval of replicates, and the share that gave no value."""
    g = df.groupBy(*by).agg(F.percentile(value, [0.025, 0.975]).alias("_p"), (1 - F.count(value) / F.count("*")).alias("failure_rate"))
    return g.select(*by, F.round(F.col("_p")[0], 6).alias("low"), F.round(F.col("_p")[1], 6).alias("high"), F.round("failure_rate", 6).alias("failure_rate"))


def corr_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(spread > 1e-12, (n * sxy - sx * sy) / F.sqrt(F.greatest(spread, F.lit(1e-300))))


def mann_whitney(df: DataFrame, by: list[str], is_first: Column, value: str) -> DataFrame:
    """U of the first group, its sizes, and the two-sided normal p with tie and continuity corrections."""
    r = average_ranks(df.select(*by, value, is_first.alias("_f")), by, {value: "_r"})
    ties = r.groupBy(*by, value).agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"))
    g = r.groupBy(*by).agg(F.count_if("_f").alias("n1"), F.count_if(~F.col("_f")).alias("n2"), F.sum(F.when(F.col("_f"), F.col("_r"))).alias("s"))
    g = g.join(ties, by).withColumn("u", F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2)

    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        n = n1 + n2
        var = n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1)).clip(lower=1))
        z = ((u - n1 * n2 / 2.0).abs() - 0.5).clip(lower=0) / np.sqrt(var.clip(lower=1e-12))
        return z.map(lambda x: math.erfc(x / math.sqrt(2)))

    return g.withColumn("p", p("u", "n1", "n2", "ties")).select(*by, "n1", "n2", "u", "p")


def kruskal(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Tie-corrected H over groups, and epsilon squared."""
    r = average_ranks(df.select(*by, group, value), by, {value: "_r"})
    ties = r.groupBy(*by, value).agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"))
    g = r.groupBy(*by, group).agg(F.count("*").alias("m"), F.sum("_r").alias("s")).groupBy(*by).agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return g.join(ties, by).withColumn("h", h).select(*by, "n", "k", "h", F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (n - F.col("k"))).alias("epsilon_squared"))


def complete_linkage(names: list[str], rho: np.ndarray, threshold: float) -> dict[str, int]:
    """Clusters of 1 - |rho| by complete linkage, cut at 1 - threshold; for a fixed small set of features."""
    groups = [[i] for i in range(len(names))]
    far = lambda a, b: max(1 - abs(rho[i, j]) for i in a for j in b)
    while len(groups) > 1:
        d, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > 1 - threshold:
            break
        groups[i] += groups.pop(j)
    return {names[k]: min(g) for g in groups for k in g}
