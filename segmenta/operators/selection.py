"""Ranks, runs, quotas and other selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.operators import orderstats as O


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 with ties averaged."""
    return O.average_ranks(df, by, {value: name})


def holm(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Holm's adjustment within families; tests without a p value keep none."""
    w = W.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), tie)
    m = F.count(p).over(W.partitionBy(*by))
    x = df.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1)))
    return x.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_s")


def true_runs(df: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """Half-open runs of places; places up to ``gap`` apart are one run."""
    w = W.partitionBy(*by).orderBy(at)
    jump = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    x = df.withColumn("_j", jump).withColumn("_run", F.sum("_j").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*by, "_run").agg(F.min(at).alias("run_start"), (F.max(at) + 1).alias("run_end")).drop("_run")


def quartile_labels(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Right-closed bins at the quartiles, the least value included; equal edges fall together."""
    edges = O.percentiles(df, by, {"_q": F.col(value)}, [0.25, 0.5, 0.75])
    v, q = F.col(value), F.col("_q")
    label = F.when(v <= q[0], "Q1").when(v <= q[1], "Q2").when(v <= q[2], "Q3").when(v.isNotNull(), "Q4")
    return O.joined(df, edges, by).withColumn(name, label).drop("_q")


def first_cycles(df: DataFrame, n: int) -> DataFrame:
    """The first n cycles of each recording; 0 takes all."""
    return df.filter(F.col("cycle_index") <= n) if n else df


def greedy_quota(df: DataFrame, strata: list[tuple[str, Column, int]], key: list[str], order: list[Column]) -> DataFrame:
    """Rows for ordered strata: each takes its best rows that no earlier stratum took, less what earlier picks already give it.

    Stratum by stratum with a top-k each; a stratum's picks are at most its quota, so what meets on the driver is the sum of
    the quotas and never a share of the table.
    """
    spark, chosen = df.sparkSession, []
    flags = [c.alias(f"_s{i}") for i, (_, c, _) in enumerate(strata)]
    pool = df.select("*", *flags)
    for i, (name, _, quota) in enumerate(strata):
        missing = quota - sum(bool(r[f"_s{i}"]) for _, r in chosen)
        if missing <= 0:
            continue
        rest = pool.filter(F.col(f"_s{i}"))
        if chosen:
            taken = spark.createDataFrame([tuple(r[k] for k in key) for _, r in chosen], pool.select(*key).schema)
            rest = rest.join(F.broadcast(taken), key, "left_anti")  # at most the sum of the quotas
        chosen += [(name, r) for r in rest.orderBy(*order).limit(missing).collect()]
    rows = [(*(r[k] for k in key), name, n) for n, (name, r) in enumerate(chosen, 1)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema)
    return spark.createDataFrame(rows, f"{kinds}, stratum string, selection_rank int")


def shortfall(df: DataFrame, strata: list[tuple[str, Column, int]]) -> DataFrame:
    """Requested, eligible and selected counts of each stratum, in one pass."""
    counts = df.agg(*[F.count_if(c).alias(name) for name, c, _ in strata])
    parts = F.array(*[F.struct(F.lit(name).alias("stratum"), F.lit(quota).cast("long").alias("requested"), F.col(name).alias("eligible")) for name, _, quota in strata])
    x = counts.select(F.inline(parts))
    return x.select("*", F.least("requested", "eligible").alias("selected"), F.when(F.col("eligible") < F.col("requested"), "insufficient_eligible").alias("reason"))


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """One row of each group in turn until there are n; no group can give more than n."""
    x = df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= n)
    return x.orderBy("_rn", group).limit(n).drop("_rn")


def near_best(df: DataFrame, score: str, within: float, order: list) -> DataFrame:
    best = df.agg(F.max(score).alias("_best"))
    return df.crossJoin(F.broadcast(best)).filter(F.col(score) >= F.col("_best") - within).orderBy(*order).limit(1).drop("_best")  # one row


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
