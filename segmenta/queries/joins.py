"""Joins, set operations and reshaping."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.operators import orderstats as O
from segmenta.operators import relational as R
from segmenta.plans.registry import query, r6

KEY = ["recording_id", "cycle_index"]


@query("primary_site_join", "SELECT recording_id, cycle_index, location FROM candidates JOIN customer ON patient_id = c_custkey WHERE location = c_mktsegment AND c_acctbal > 0")
def _(t):
    site = R.assert_unique(t.customer.select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("primary"), "c_acctbal"), "patient_id")
    return t.candidates.join(site, "patient_id").filter((F.col("location") == F.col("primary")) & (F.col("c_acctbal") > 0)).select(*KEY, "location")


@query("left_lookup_join", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def _(t):
    nation = t.nation.join(t.region.filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("outer_indicator_join", "SELECT coalesce(s, c) AS nationkey, CASE WHEN s IS NULL THEN 'right_only' WHEN c IS NULL THEN 'left_only' ELSE 'both' END AS merge FROM (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_acctbal > 5000) FULL JOIN (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_acctbal > 9000) ON s = c")
def _(t):
    a = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")).distinct()
    b = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).distinct()
    return R.outer_with_indicator(a, b, ["nationkey"])


@query("pair_inventory", "SELECT coalesce(a, b) AS id, a IS NOT NULL AS has_audio, b IS NOT NULL AS has_annotation FROM (SELECT DISTINCT o_orderkey AS a FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem WHERE l_tax > 0.04) ON a = b")
def _(t):
    a = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")).distinct()
    b = t.lineitem.filter("l_tax > 0.04").select(F.col("l_orderkey").alias("id")).distinct()
    return R.pairing(a, b, "id")


@query("cluster_pair_selfjoin", """WITH m AS (SELECT DISTINCT location, feature, (rank() OVER (PARTITION BY location ORDER BY med)) // 2 AS cluster FROM (SELECT location, feature, median(value) AS med FROM features_long GROUP BY 1, 2))
    SELECT a.location, a.feature AS feature_a, b.feature AS feature_b, a.cluster = b.cluster AS same FROM m a JOIN m b ON a.location = b.location AND a.feature < b.feature""")
def _(t):
    med = O.percentiles(t.features_long, ["location", "feature"], {"med": F.col("value")}, [0.5]).withColumn("med", F.col("med")[0])
    m = med.select("location", "feature", F.expr("rank() over (partition by location order by med) div 2").alias("cluster"))
    return R.pairs_within(m, ["location"], "feature").select("location", "feature_a", "feature_b", (F.col("cluster_a") == F.col("cluster_b")).alias("same"))


@query("eligible_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 7000)")
def _(t):
    return t.orders.join(t.customer.filter("c_acctbal > 7000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("unpaired_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(t):
    return R.not_completed(t.orders.select("o_orderkey"), t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


FAMILIES = [("shift_earlier", -1, -1), ("shift_later", 1, 1), ("expand", -1, 1), ("contract", 1, -1), ("onset_earlier", -1, 0), ("onset_later", 1, 0), ("offset_earlier", 0, -1), ("offset_later", 0, 1)]
GRID = "SELECT (f.k * 3 + m.k + 1)::bigint AS variant_order, family || '_' || lpad(round(100 * magnitude)::int::varchar, 2, '0') || 'pct' AS perturbation_id, family, magnitude, d0, d1 FROM (VALUES " + ", ".join(f"({k}, '{f}', {a}, {b})" for k, (f, a, b) in enumerate(FAMILIES)) + ") AS f(k, family, d0, d1) CROSS JOIN (VALUES (0, 0.05::double), (1, 0.10::double), (2, 0.20::double)) AS m(k, magnitude)"


def grid(t):
    """Eight families by three magnitudes; a fixed table of 24 rows."""
    rows = [(3 * k + j + 1, f"{f}_{round(100 * m):02d}pct", f, m, a, b) for k, (f, a, b) in enumerate(FAMILIES) for j, m in enumerate((0.05, 0.10, 0.20))]
    return t.spark.createDataFrame(rows, "variant_order long, perturbation_id string, family string, magnitude double, d0 int, d1 int")


@query("perturbation_grid", GRID)
def _(t):
    return grid(t)


@query("boundary_variants", f"""WITH g AS ({GRID}), x AS (SELECT recording_id, cycle_index, perturbation_id, 10 + quantity::int AS onset, 62 + (tax * 100)::int AS "offset", round_even(magnitude * 60, 0)::int * d0 AS di, round_even(magnitude * 60, 0)::int * d1 AS dj FROM candidates CROSS JOIN g WHERE cycle_index = 1),
    y AS (SELECT *, greatest(8, least(68, onset + di)) AS ao, greatest(8, least(68, "offset" + dj)) AS af FROM x)
    SELECT recording_id, perturbation_id, ao AS actual_onset, af AS actual_offset, ao <> onset + di OR af <> "offset" + dj AS clipped, CASE WHEN af < ao THEN 'reversed_interval' WHEN af = ao THEN 'empty_interval' END AS reason FROM y""")
def _(t):
    base = t.candidates.filter("cycle_index = 1").select("recording_id", (10 + F.col("quantity").cast("int")).alias("onset"), (62 + F.rint(F.col("tax") * 100).cast("int")).alias("offset"))
    return R.boundary_variants(base, F.broadcast(grid(t)), 8, 68).select("recording_id", "perturbation_id", "actual_onset", "actual_offset", "clipped", "reason")


@query("dict_lookup", "SELECT o_orderkey, code FROM orders JOIN (VALUES ('F', 1), ('O', 2), ('P', 3)) AS m(k, code) ON o_orderstatus = k")
def _(t):
    return R.lookup(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 1, "O": 2, "P": 3}, "code").select("o_orderkey", "code")


@query("label_consistency", "SELECT recording_id, cycle_index FROM candidates JOIN orders ON recording_id = o_orderkey WHERE murmur_label <> CASE o_orderstatus WHEN 'F' THEN 'Present' WHEN 'O' THEN 'Absent' ELSE 'Unknown' END OR timing_label <> o_orderpriority OR price > o_totalprice")
def _(t):
    o = t.orders
    want = F.when(o.o_orderstatus == "F", "Present").when(o.o_orderstatus == "O", "Absent").otherwise("Unknown")
    return t.candidates.join(o, F.col("recording_id") == o.o_orderkey).filter((F.col("murmur_label") != want) | (F.col("timing_label") != o.o_orderpriority) | (F.col("price") > o.o_totalprice)).select(*KEY)


@query("cliffs_delta", """SELECT murmur_phase, round((sum(CASE WHEN a.price > b.price THEN 1 WHEN a.price < b.price THEN -1 ELSE 0 END)) / count(*)::double, 6) AS delta FROM
    (SELECT murmur_phase, price FROM candidates WHERE status = 'accepted' AND location = 'BUILDING' AND tax > 0.06) a JOIN (SELECT murmur_phase, price FROM candidates WHERE status = 'fallback' AND location = 'BUILDING' AND tax > 0.06) b USING (murmur_phase) GROUP BY 1""")
def _(t):
    x = t.candidates.filter("location = 'BUILDING' and tax > 0.06 and status in ('accepted', 'fallback')")
    return R.cliffs_delta(x, ["murmur_phase"], F.col("status") == "accepted", "price").select("murmur_phase", r6("delta").alias("delta"))


@query("phase_range_join", "SELECT phase, count(*) AS n, round(sum(v * v), 6) AS energy FROM samples JOIN phases ON n >= p_start AND n < p_end GROUP BY 1")
def _(t):
    return R.interval_join(t.samples, F.broadcast(t.phases), "n", "p_start", "p_end").groupBy("phase").agg(F.count("*").alias("n"), r6(F.sum(F.col("v") * F.col("v"))).alias("energy"))


@query("cycle_context", """SELECT user_id, n, s1_n, s2_n, dia_n, round(width, 3) AS width FROM (SELECT user_id, n, 1 + (n % 4) AS state, lag(n) OVER w AS s1_n, lead(n) OVER w AS s2_n, lead(n, 2) OVER w AS dia_n, lag(1 + (n % 4)) OVER w AS p, lead(1 + (n % 4)) OVER w AS q, lead(1 + (n % 4), 2) OVER w AS r,
    lead(value, 2) OVER w - lag(value) OVER w AS width FROM recordings WINDOW w AS (PARTITION BY user_id ORDER BY n)) WHERE state = 2 AND p = 1 AND q = 3 AND r = 4""")
def _(t):
    return R.cycle_contexts(t.recordings.withColumn("state", 1 + F.col("n") % 4), ["user_id"], "n", "state", "value").select("user_id", "n", "s1_n", "s2_n", "dia_n", F.round("width", 3).alias("width"))


@query("union_all", "SELECT c_custkey AS id, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source")).unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source")))


@query("set_difference", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def _(t):
    return t.customer.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).exceptAll(t.customer.limit(0).select(F.col("c_nationkey").alias("k"))).distinct().subtract(t.supplier.filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k")))


@query("set_intersection", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return R.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("duplicate_members", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def _(t):
    return t.lineitem.join(R.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("distinct_pairs", "SELECT DISTINCT location, murmur_phase FROM candidates")
def _(t):
    return t.candidates.select("location", "murmur_phase").distinct()


@query("feature_pivot", "SELECT patient_id, round(median(value) FILTER (feature = 'quantity'), 6) AS quantity, round(median(value) FILTER (feature = 'price'), 6) AS price, round(median(value) FILTER (feature = 'tax'), 6) AS tax, NULL::double AS absent FROM features_long GROUP BY 1")
def _(t):
    x = t.features_long.groupBy("patient_id").pivot("feature", ["quantity", "price", "tax", "absent"]).agg(r6(F.percentile("value", 0.5)))
    return x


@query("feature_unpivot", "SELECT recording_id, cycle_index, feature, value FROM features_long")
def _(t):
    return t.features_long.select(*KEY, "feature", "value")


@query("one_hot", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::int AS building, (c_mktsegment = 'FURNITURE')::int AS furniture, (c_mktsegment = 'HOUSEHOLD')::int AS household, (c_mktsegment = 'MACHINERY')::int AS machinery FROM customer")
def _(t):
    return R.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).select("c_custkey", "building", "furniture", "household", "machinery")


@query("analysis_contexts", """SELECT 'candidate' AS level, murmur_phase, 'all' AS stratum, count(*) AS n, round(avg(quantity), 6) AS mean_value FROM candidates GROUP BY 2
    UNION ALL SELECT 'candidate', murmur_phase, status, count(*), round(avg(quantity), 6) FROM candidates GROUP BY 2, 3
    UNION ALL SELECT 'recording', murmur_phase, 'all', count(*), round(avg(q), 6) FROM (SELECT murmur_phase, recording_id, median(quantity) AS q FROM candidates GROUP BY 1, 2) GROUP BY 2
    UNION ALL SELECT 'patient', murmur_phase, 'all', count(*), round(avg(q), 6) FROM (SELECT murmur_phase, patient_id, median(quantity) AS q FROM candidates GROUP BY 1, 2) GROUP BY 2""")
def _(t):
    def part(rows, level, stratum, value):
        return rows.groupBy("murmur_phase", *([stratum] if stratum != "all" else [])).agg(F.count("*").alias("n"), r6(F.avg(value)).alias("mean_value")).select(F.lit(level).alias("level"), "murmur_phase", (F.col(stratum) if stratum != "all" else F.lit("all")).alias("stratum"), "n", "mean_value")

    c = t.candidates
    median_by = lambda k: c.groupBy("murmur_phase", k).agg(F.percentile("quantity", 0.5).alias("q"))
    return part(c, "candidate", "all", "quantity").unionByName(part(c, "candidate", "status", "quantity")).unionByName(part(median_by("recording_id"), "recording", "all", "q")).unionByName(part(median_by("patient_id"), "patient", "all", "q"))


@query("cache_scope", "SELECT recording_id, cycle_index FROM candidates WHERE status IN ('accepted','fallback') AND murmur_phase = 'systole' AND patient_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(t):
    keep = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("patient_id"))
    return t.candidates.filter(F.col("status").isin("accepted", "fallback") & (F.col("murmur_phase") == "systole")).join(keep, "patient_id", "left_semi").select(*KEY)


@query("segment_concat", "SELECT label, count(*) AS n_segments, round(sum(v * (64 * (rk - 1) + n)), 4) AS moment FROM (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS rk FROM samples) WHERE rk <= 20 AND n = 0 GROUP BY 1")
def _(t):
    w = W.partitionBy("label").orderBy("vec_id")
    long = t.segments.withColumn("rk", F.row_number().over(w)).filter("rk <= 20").groupBy("label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rk", "signal"))), lambda x: x.signal)).alias("signal"))
    moment = F.aggregate(F.filter(F.transform("signal", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x.i % 64 == 0), F.lit(0.0), lambda a, x: a + x.v * x.i)
    return long.select("label", (F.size("signal") / 64).cast("long").alias("n_segments"), F.round(moment, 4).alias("moment"))


@query("snapshot_gate", "SELECT 'missing' AS side, k FROM (VALUES (0), (3), (99)) AS e(k) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) UNION ALL SELECT 'unexpected', n_nationkey FROM nation WHERE n_regionkey = 0 AND n_nationkey NOT IN (0, 3, 99)")
def _(t):
    want = t.spark.createDataFrame([(0,), (3,), (99,)], "k int")
    return R.snapshot_differences(want, t.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))
