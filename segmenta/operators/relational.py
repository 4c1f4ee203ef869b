"""Relational operators that the queries share; each maps DataFrames to a DataFrame and stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.operators import orderstats as O


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing at run time where a key repeats; one aggregation by key, which a join by the same key reuses."""
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in rest])
    return once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{', '.join(keys)} isn't unique"))).otherwise(F.lit(True))).filter("_ok").drop("_n", "_ok")


def outer_with_indicator(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.withColumn("_l", F.lit(True)), b.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return left.join(right, keys, "full").withColumn("merge", side).drop("_l", "_r")


def pairing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x = outer_with_indicator(a, b, [key])
    return x.select(key, (F.col("merge") != "right_only").alias("has_audio"), (F.col("merge") != "left_only").alias("has_annotation"))


def pairs_within(df: DataFrame, context: list[str], item: str) -> DataFrame:
    """Each unordered pair of items of a context once, the smaller first; for item sets of a fixed size."""
    a = df.select(*context, *[F.col(c).alias(f"{c}_a") for c in df.columns if c not in context])
    b = df.select(*context, *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in context])
    return a.join(b, context).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))


def not_completed(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: the units that no checkpoint names."""
    return units.join(done, keys, "left_anti")


def boundary_variants(base: DataFrame, grid: DataFrame, start: int, end: int) -> DataFrame:
    """Every perturbation of each (onset, offset) within the phase [start, end); grid is a fixed small table."""
    delta = F.rint(F.col("magnitude") * (end - start)).cast("int")
    x = base.crossJoin(grid).withColumns({"_o": F.col("onset") + delta * F.col("d0"), "_f": F.col("offset") + delta * F.col("d1")})
    held = lambda c: F.greatest(F.lit(start), F.least(F.lit(end), F.col(c)))
    x = x.withColumns({"actual_onset": held("_o"), "actual_offset": held("_f")})
    reason = F.when(F.col("actual_offset") < F.col("actual_onset"), "reversed_interval").when(F.col("actual_offset") == F.col("actual_onset"), "empty_interval")
    return x.withColumns({"clipped": (F.col("_o") != F.col("actual_onset")) | (F.col("_f") != F.col("actual_offset")), "reason": reason}).drop("_o", "_f")


def lookup(df: DataFrame, key: str, codes: dict, name: str) -> DataFrame:
    """Codes by a dictionary; an unknown key fails."""
    c = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col(key))
    return df.withColumn(name, F.coalesce(c, F.raise_error(F.concat(F.lit("no code for "), F.col(key))).cast("int")))


def cliffs_delta(df: DataFrame, by: list[str], is_first: Column, value: str) -> DataFrame:
    """delta of the first group against the rest, from rank sums: no pairs are formed."""
    rows = df.select(*by, value, is_first.alias("_f")).filter("_f is not null")
    g = O.average_ranks(rows, by, {value: "_r"}).groupBy(*by).agg(F.count_if("_f").alias("a"), F.count_if(~F.col("_f")).alias("b"), F.sum(F.when(F.col("_f"), F.col("_r"))).alias("s"))
    u = F.col("s") - F.col("a") * (F.col("a") + 1) / 2
    return g.select(*by, F.try_divide(2 * u, (F.col("a") * F.col("b")).cast("double")).alias("_u")).select(*by, (F.col("_u") - 1).alias("delta")).filter("delta is not null")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points in half-open intervals; intervals is a fixed small table, so each point looks through it once."""
    return points.join(intervals, (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def cycle_contexts(df: DataFrame, by: list[str], at: str, state: str, value: str) -> DataFrame:
    """Rows of state 2 between states 1, 3 and 4, with their neighbours' places."""
    w = W.partitionBy(*by).orderBy(at)
    x = df.withColumns({
        "s1_n": F.lag(at).over(w), "s2_n": F.lead(at).over(w), "dia_n": F.lead(at, 2).over(w), "_p": F.lag(state).over(w), "_q": F.lead(state).over(w), "_r": F.lead(state, 2).over(w), "width": F.lead(value, 2).over(w) - F.lag(value).over(w),
    })
    return x.filter((F.col(state) == 2) & (F.col("_p") == 1) & (F.col("_q") == 3) & (F.col("_r") == 4)).drop("_p", "_q", "_r")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each sorted level but the first."""
    return df.withColumns({x.lower(): (F.col(column) == x).cast("int") for x in sorted(levels)[1:]})


def snapshot_differences(want: DataFrame, got: DataFrame) -> DataFrame:
    """Both differences of two one-column sets; no rows if they are equal."""
    a = want.subtract(got).select(F.lit("missing").alias("side"), *want.columns)
    return a.unionByName(got.subtract(want).select(F.lit("unexpected").alias("side"), *want.columns))


def first_by(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def quantiles(value: str | Column, name: str, points: dict[str, float]) -> list[Column]:
    return [F.percentile(value, q).alias(f"{name}_{k}") for k, q in points.items()]
