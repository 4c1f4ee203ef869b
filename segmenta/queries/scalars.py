"""Scalar functions."""

from pyspark.sql import functions as F

from segmenta.functions import hashing as H
from segmenta.functions import labels as L
from segmenta.plans.registry import query, r6

KEY = ["recording_id", "cycle_index"]


@query("string_id_parse", "SELECT c_custkey, split_part(c_name, '#', 1) AS head, split_part(c_name, '#', 2) AS tail, regexp_extract(c_name, '([0-9]+)$', 1) AS stem FROM customer")
def _(t):
    p = F.split("c_name", "#")
    return t.customer.select("c_custkey", p[0].alias("head"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("tail"), F.regexp_extract("c_name", "([0-9]+)$", 1).alias("stem"))


@query("plus_list_parse", "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(o_orderstatus || ' + ' || o_orderpriority || '+', '+'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS parts FROM orders")
def _(t):
    parts = F.filter(F.transform(F.split(F.concat("o_orderstatus", F.lit(" + "), "o_orderpriority", F.lit("+")), "[+]"), lambda y: F.trim(y)), lambda x: x != "")
    return t.orders.select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(parts)), "|").alias("parts"))


@query("shape_rename", "SELECT DISTINCT o_orderpriority, regexp_replace(o_orderpriority, '^[0-9]-', '') AS bare, replace(o_orderpriority, '-', '_') || CASE WHEN o_orderpriority LIKE '1%' THEN '_systolic' ELSE '_diastolic' END AS renamed FROM orders")
def _(t):
    x = t.orders.select("o_orderpriority").distinct()
    return x.select("o_orderpriority", F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("bare"), F.concat(F.replace("o_orderpriority", F.lit("-"), F.lit("_")), F.when(F.col("o_orderpriority").like("1%"), "_systolic").otherwise("_diastolic")).alias("renamed"))


@query("candidate_id", "SELECT recording_id, cycle_index, patient_id || ':' || recording_id || ':cycle' || cycle_index || ':' || murmur_phase AS candidate_id, lpad(round(tax * 100)::int::varchar, 2, '0') || 'pct' AS pct FROM candidates")
def _(t):
    return t.candidates.select(*KEY, F.format_string("%d:%d:cycle%d:%s", "patient_id", "recording_id", "cycle_index", "murmur_phase").alias("candidate_id"), F.concat(F.lpad(F.round(F.col("tax") * 100).cast("int").cast("string"), 2, "0"), F.lit("pct")).alias("pct"))


@query("bool_coerce", "SELECT o_orderkey, coalesce(lower(trim(x)) IN ('true','1','yes'), false) AS flag FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'no' END AS x FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", L.truthy(F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "no")).alias("flag"))


@query("half_even_round", "SELECT recording_id, cycle_index, greatest(0, least(40, round_even(quantity / 2, 0)))::int AS sample FROM candidates")
def _(t):
    return t.candidates.select(*KEY, L.clamp(F.rint(F.col("quantity") / 2), 0.0, 40.0).cast("int").alias("sample"))


@query("decibel", "SELECT recording_id, cycle_index, round(20 * log10(price), 6) AS db, round(ln(price), 6) AS ln_price, round(ln(1 + tax), 8) AS log1p_tax, CASE WHEN discount > 0 THEN round(10 * log10(discount), 6) END AS db_discount FROM candidates")
def _(t):
    return t.candidates.select(*KEY, r6(20 * F.log10("price")).alias("db"), r6(F.ln("price")).alias("ln_price"), r6(F.log1p("tax"), 8).alias("log1p_tax"), F.when(F.col("discount") > 0, r6(10 * F.log10("discount"))).alias("db_discount"))


@query("is_close", "SELECT recording_id, cycle_index, abs(tax - discount) <= 1e-8 + 0.2::double * abs(discount) AS near FROM candidates")
def _(t):
    return t.candidates.select(*KEY, L.is_close(F.col("tax"), F.col("discount"), 0.2).alias("near"))


@query("finite_guard", "SELECT recording_id, cycle_index, CASE WHEN discount > 0 THEN round(tax / discount, 6) END AS ratio, discount > 0 AS finite FROM candidates")
def _(t):
    return t.candidates.select(*KEY, r6(F.nanvl(F.try_divide("tax", "discount"), F.lit(None))).alias("ratio"), (F.col("discount") > 0).alias("finite"))


@query("sample_time_conversion", "SELECT recording_id, cycle_index, round(quantity * 1000 / 4000, 6) AS ms, round((cycle_index * 3200 + 500 + quantity) / 4000, 6) AS recording_s FROM candidates")
def _(t):
    q = F.col("quantity")
    return t.candidates.select(*KEY, r6(q * 1000 / 4000).alias("ms"), r6((F.col("cycle_index") * 3200 + 500 + q) / 4000).alias("recording_s"))


@query("absolute_timing", "SELECT recording_id, cycle_index, round((quantity) / 4000, 8) AS onset_phase_s, CASE WHEN murmur_phase = 'systole' THEN round(quantity / 4000, 8) END AS onset_systole_s, round((10 + quantity) / 4000, 8) AS onset_cycle_s, round((cycle_index * 64 + 10 + quantity) / 4000, 8) AS onset_recording_s FROM candidates")
def _(t):
    q = F.col("quantity")
    s = lambda c: r6(c / 4000, 8)
    return t.candidates.select(*KEY, s(q).alias("onset_phase_s"), F.when(F.col("murmur_phase") == "systole", s(q)).alias("onset_systole_s"), s(q + 10).alias("onset_cycle_s"), s(F.col("cycle_index") * 64 + 10 + q).alias("onset_recording_s"))


@query("row_hash", "SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS hash FROM nation")
def _(t):
    return t.nation.select("n_nationkey", H.row_hash(["n_nationkey", "n_name"]).alias("hash"))


@query("seed_hash", "SELECT c_custkey, (20260827 + ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint) % 4294967296 AS seed FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer)")
def _(t):
    return t.customer.select("c_custkey", H.keyed_seed(F.col("c_name"), 20260827).alias("seed"))


@query("char_sum_seed", "SELECT c_custkey, list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x)))::bigint AS seed FROM customer")
def _(t):
    return t.customer.select("c_custkey", H.char_sum(F.col("c_name")).alias("seed"))


@query("smooth_gate", "SELECT recording_id, cycle_index, round(least(greatest(0, least(1, (quantity - 5) / 10)), greatest(0, least(1, (45 - quantity) / 10))), 6)::double AS gate FROM candidates")
def _(t):
    q = F.col("quantity")
    return t.candidates.select(*KEY, r6(F.least(L.clamp((q - 5) / 10, 0.0, 1.0), L.clamp((45 - q) / 10, 0.0, 1.0))).alias("gate"))


@query("json_extract", "SELECT event_id, props->>'$.k' AS k, props->>'$.page' AS page FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("null_handling", "SELECT o_orderkey, coalesce(x, 'missing') AS filled, x IS NOT NULL AS present FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS x, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS y FROM orders) WHERE y IS NOT NULL")
def _(t):
    x = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("x"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("y")).na.drop(subset=["y"])
    return x.select("o_orderkey", F.coalesce("x", F.lit("missing")).alias("filled"), F.col("x").isNotNull().alias("present"))


@query("ratio_null", "SELECT location, round(100.0::double * count(*) FILTER (price > 104000) / nullif(count(*) FILTER (quantity > 49.5), 0), 6) AS pct, round((sum(tax) FILTER (quantity > 1000)) / 2, 6) AS nothing FROM candidates GROUP BY 1")
def _(t):
    return t.candidates.groupBy("location").agg(r6(F.try_divide(100.0 * F.count_if(F.col("price") > 104000), F.count_if(F.col("quantity") > 49.5))).alias("pct"), r6(F.sum(F.when(F.col("quantity") > 1000, F.col("tax"))) / 2).alias("nothing"))


@query("array_hash", "SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: floor(x * 1000)::int), ',')) AS hash FROM embeddings")
def _(t):
    return t.segments.select("vec_id", F.md5(F.array_join(F.transform("signal", lambda x: F.floor(x.cast("float") * F.lit(1000).cast("float")).cast("int").cast("string")), ",").cast("binary")).alias("hash"))


@query("data_dictionary")
def _(t):
    rows = [(c, k, "stand-in candidate column") for c, k in t.candidates.dtypes]
    return t.spark.createDataFrame(rows, "column_name string, kind string, meaning string")
