"""Sources, sinks, manifests and restartable runs."""

import pandas as pd
from pyspark.sql import functions as F

from segmenta.functions import arrays as A
from segmenta.functions.guards import SeparationConfig
from segmenta.plans.registry import query
from segmenta.sources import recordings as R
from segmenta.sources.reports import write_packages, write_report
from segmenta.streaming.batches import run_available


def _wav(x: pd.Series) -> pd.Series:
    return x.map(lambda a: R.encode_wav(a))


def _decode(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([R.decode_wav(bytes(c)) for c in x])


@query("wav_roundtrip", "SELECT vec_id, 4000::int AS sample_rate, 64::bigint AS n_frames, true AS near FROM embeddings")
def _(t):
    """Segments become WAV content and are read back; samples agree within half a step of 16 bits."""
    coded = t.segments.withColumn("scaled", F.transform("signal", lambda v: v / 8)).withColumn("content", F.pandas_udf(_wav, "binary")("scaled"))
    back = coded.withColumn("w", F.pandas_udf(_decode, "sample_rate int, channels int, n_frames long, signal array<double>, error string")("content"))
    worst = F.array_max(F.zip_with("scaled", "w.signal", lambda a, b: F.abs(a - b)))
    return back.select("vec_id", "w.sample_rate", "w.n_frames", (worst < 1e-4).alias("near"))


@query("audio_inspection", "SELECT vec_id, vec_id % 3 <> 0 AS readable FROM embeddings")
def _(t):
    coded = t.segments.withColumn("content", F.pandas_udf(_wav, "binary")("signal")).withColumn("content", F.when(F.col("vec_id") % 3 == 0, F.lit(b"RIFF").cast("binary")).otherwise(F.col("content")))
    return coded.withColumn("w", F.pandas_udf(_decode, "sample_rate int, channels int, n_frames long, signal array<double>, error string")("content")).select("vec_id", F.col("w.error").isNull().alias("readable"))


@query("annotation_scan", "SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM recordings GROUP BY 1")
def _(t):
    path = R.scratch(t.spark, "annotations")
    rows = t.recordings.select(F.col("user_id").cast("string").alias("u"), F.format_string("%.6f", "value").alias("a"), F.format_string("%.6f", F.col("value") + 1).alias("b"), (1 + F.col("n") % 4).cast("string").alias("s"))
    rows.select("u", F.concat_ws("\t", "a", "b", "s").alias("value")).repartition("u").write.partitionBy("u").option("compression", "none").text(path)
    back = t.spark.read.schema("start double, end double, state int, u long").option("sep", "\t").csv(path)
    return back.groupBy(F.col("u").alias("user_id")).agg(F.count("*").alias("n"), F.round(F.sum("start"), 3).alias("total"))


@query("metadata_scan", "SELECT c_custkey::varchar AS patient_id, c_mktsegment AS location FROM customer")
def _(t):
    path = R.scratch(t.spark, "metadata")
    t.customer.select(F.col("c_custkey").alias("Patient ID"), F.col("c_mktsegment").alias("Locations")).write.option("header", "true").csv(path)
    m = R.read_metadata(t.spark, path, "`Patient ID` string, `Locations` string")
    return m.select(F.col("Patient ID").alias("patient_id"), F.col("Locations").alias("location"))


@query("file_inventory", "SELECT k::varchar AS recording_id, k % 3 <> 0 AS has_wav, k % 2 = 0 AS has_tsv FROM (SELECT unnest(range(0, 24)) AS k) WHERE k % 3 <> 0 OR k % 2 = 0")
def _(t):
    path = R.scratch(t.spark, "inventory")
    jvm = t.spark._jvm
    for k in range(24):
        for kind in [*(["wav"] if k % 3 else []), *(["tsv"] if k % 2 == 0 else [])]:
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/{k}.{kind}")
            out = p.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(p)
            out.write(bytearray(b"0\t1\t2\n"))
            out.close()
    return R.inventory(t.spark, path).select("recording_id", F.col("wav_bytes").isNotNull().alias("has_wav"), F.col("tsv_bytes").isNotNull().alias("has_tsv"))


@query("pruned_scan", "SELECT l_orderkey, l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 10")
def _(t):
    return t.lineitem.filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_tax")


@query("manifest_verify", "SELECT n_name AS artifact, n_nationkey % 5 <> 0 AS verified FROM nation")
def _(t):
    found = t.nation.select(F.col("n_name").alias("artifact"), F.sha2(F.col("n_name").cast("binary"), 256).alias("sha256"))
    manifest = t.nation.select(F.col("n_name").alias("artifact"), F.when(F.col("n_nationkey") % 5 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2(F.col("n_name").cast("binary"), 256)).alias("sha256"))
    return R.verify_manifest(manifest, found)


@query("validation_report", """SELECT 'orders_without_lines' AS code, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'customers_without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'duplicate_line_keys', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0""")
def _(t):
    """Every check runs before any fails; a strict caller raises on the whole report."""
    report = lambda d, code: d.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    return (
        report(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "orders_without_lines")
        .unionByName(report(t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "customers_without_orders"))
        .unionByName(report(t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k")).filter("k > 1"), "duplicate_line_keys"))
        .unionByName(report(t.customer.filter("c_acctbal < 0"), "negative_balance"))
    )


@query("restartable_batches", "SELECT vec_id, round(sum(v * v), 5) AS energy FROM samples GROUP BY 1")
def _(t):
    """Two runs over a growing folder: the second takes only what the first hasn't seen."""
    base = R.scratch(t.spark, "stream")
    rows = t.segments.select("vec_id", "signal")
    work = lambda b: b.select("vec_id", F.round(F.aggregate(F.transform("signal", lambda v: v * v), F.lit(0.0), lambda a, x: a + x), 5).alias("energy"))
    for part in (rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1")):
        part.coalesce(2).write.mode("append").parquet(f"{base}/in")
        run_available(t.spark, f"{base}/in", "vec_id long, signal array<double>", work, f"{base}/out", f"{base}/checkpoint", ["vec_id"])
    return t.spark.read.schema("vec_id long, energy double").parquet(f"{base}/out")


@query("report_manifest", """SELECT artifact, format, CASE WHEN artifact LIKE 'energy%' THEN (SELECT count(*) FROM embeddings) ELSE (SELECT count(DISTINCT label) FROM embeddings) END AS n_rows
    FROM (VALUES ('energy.csv', 'csv'), ('energy.json', 'json'), ('labels.csv', 'csv'), ('labels.json', 'json')) AS m(artifact, format)""")
def _(t):
    """Two tables as CSV and JSON with their manifest, under a new path."""
    energy = t.segments.select("vec_id", A.energy(F.col("signal")).alias("energy"))
    counts = t.segments.groupBy("label").agg(F.count("*").alias("n"))
    m = write_report({"energy": energy, "labels": counts}, R.scratch(t.spark, "report"), SeparationConfig().to_dict(), t.sf_dir)
    return m.select("artifact", "format", F.col("rows").alias("n_rows"))


@query("track_packages", "SELECT vec_id, track FROM embeddings, (SELECT unnest(['signal', 'envelope']) AS track)")
def _(t):
    """A WAV file for each vector and track; the rows whose files are there with the hash of the manifest."""
    path = R.scratch(t.spark, "tracks")
    manifest = write_packages(t.segments.select("vec_id", "signal", F.transform("signal", F.abs).alias("envelope")), path, ["signal", "envelope"])
    at = R.scratch(t.spark, "tracks-manifest")
    manifest.write.parquet(at)
    there = R.artifact_hashes(t.spark, path).select(F.col("artifact").alias("file"), F.col("sha256").alias("found"))
    return t.spark.read.parquet(at).join(there, "file").filter("sha256 = found").select("vec_id", "track")


@query("segment_package", "SELECT vec_id, 64::bigint AS n FROM embeddings")
def _(t):
    """Packages as partitioned rows with arrays as floats; written and read back."""
    path = R.scratch(t.spark, "packages")
    t.segments.select("vec_id", "label", F.col("signal").cast("array<float>").alias("signal")).write.partitionBy("label").parquet(path)
    return t.spark.read.schema("vec_id long, label int, signal array<float>").parquet(path).select("vec_id", F.size("signal").cast("long").alias("n"))
