"""Named queries with their SQL twins, and the views both are written over."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Phase bounds of a 64-sample segment, half-open.
PHASES = {"s1": (0, 10), "systole": (10, 32), "s2": (32, 42), "diastole": (42, 64)}

VIEWS = {
    "candidates": """SELECT o_custkey AS patient_id, o_orderkey AS recording_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS cycle_index,
        c_mktsegment AS location, CASE WHEN l_linestatus = 'F' THEN 'systole' ELSE 'diastole' END AS murmur_phase,
        CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'fallback' ELSE 'no_candidate' END AS status,
        CASE o_orderstatus WHEN 'F' THEN 'Present' WHEN 'O' THEN 'Absent' ELSE 'Unknown' END AS murmur_label, o_orderpriority AS timing_label,
        l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_discount > 0 AS valid,
        CASE WHEN l_discount > 0 THEN NULL ELSE 'silent_candidate' END AS invalid_reason
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "samples": "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS n, unnest(embedding)::double AS v FROM embeddings",
    "recordings": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, ts, event_id, event_type, value FROM events",
    "phases": "SELECT * FROM (VALUES ('s1', 0, 10), ('systole', 10, 32), ('s2', 32, 42), ('diastole', 42, 64)) AS p(phase, p_start, p_end)",
    "features_long": """SELECT patient_id, recording_id, cycle_index, location, murmur_phase, status, feature, value FROM (
        SELECT *, unnest(['quantity', 'price', 'discount', 'tax']) AS feature, unnest([quantity, price, discount, tax]) AS value FROM candidates)""",
    "patients": "SELECT patient_id, median(quantity) AS quantity, median(price) AS price, median(discount) AS discount, median(tax) AS tax, min(location) AS location, count(*) AS n FROM candidates GROUP BY 1",
    "cohort": "SELECT d.doc_id AS patient_id, l.quality AS label, d.n_chars, d.source, d.lang, length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS n_lines FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
}
_NEEDS = {"features_long": ["candidates"], "patients": ["candidates"]}


def with_views(sql: str) -> str:
    """SQL with the views it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    order = list(dict.fromkeys(x for v in used for x in [*_NEEDS.get(v, []), v]))
    if not order:
        return sql
    head = "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = sql.strip()
    return head + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)


class Tables:
    """The driver's tables and the same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def candidates(self) -> DataFrame:
        joined = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        order = [F.col(f"l_{c}") for c in ("linenumber", "partkey", "suppkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")]
        return joined.select(
            F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("recording_id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("cycle_index"), F.col("c_mktsegment").alias("location"),
            F.when(F.col("l_linestatus") == "F", "systole").otherwise("diastole").alias("murmur_phase"), F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "fallback").otherwise("no_candidate").alias("status"),
            F.when(F.col("o_orderstatus") == "F", "Present").when(F.col("o_orderstatus") == "O", "Absent").otherwise("Unknown").alias("murmur_label"), F.col("o_orderpriority").alias("timing_label"),
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_discount") > 0).alias("valid"),
            F.when(~(F.col("l_discount") > 0), "silent_candidate").alias("invalid_reason"))

    @cached_property
    def segments(self) -> DataFrame:
        return self.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("signal"))

    @cached_property
    def samples(self) -> DataFrame:
        return self.segments.select("vec_id", "label", F.posexplode("signal").alias("n", "v")).withColumn("n", F.col("n").cast("long"))

    @cached_property
    def recordings(self) -> DataFrame:
        return self.events.select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("n"), "ts", "event_id", "event_type", "value")

    @cached_property
    def phases(self) -> DataFrame:
        return self.spark.createDataFrame([(k, *v) for k, v in PHASES.items()], "phase string, p_start int, p_end int")

    @cached_property
    def features_long(self) -> DataFrame:
        return self.candidates.unpivot(["patient_id", "recording_id", "cycle_index", "location", "murmur_phase", "status"], ["quantity", "price", "discount", "tax"], "feature", "value")

    @cached_property
    def patients(self) -> DataFrame:
        return self.candidates.groupBy("patient_id").agg(*[F.percentile(c, 0.5).alias(c) for c in ("quantity", "price", "discount", "tax")], F.min("location").alias("location"), F.count("*").alias("n"))

    @cached_property
    def cohort(self) -> DataFrame:
        return self.labels.join(self.documents, "doc_id").select(F.col("doc_id").alias("patient_id"), F.col("quality").alias("label"), "n_chars", "source", "lang", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with the SQL that must give the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add


def r6(c, digits: int = 6):
    return F.round(c, digits)
