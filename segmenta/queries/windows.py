"""Windows, sorts, limits and selections."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.operators import orderstats as O
from segmenta.operators import relational as R
from segmenta.operators import selection as S
from segmenta.plans.registry import query, r6

KEY = ["recording_id", "cycle_index"]
TOTAL = ["recording_id", "cycle_index"]


@query("average_rank", "SELECT recording_id, cycle_index, rank() OVER w + (count(*) OVER (PARTITION BY location, discount) - 1) / 2.0::double AS avg_rank FROM candidates WINDOW w AS (PARTITION BY location ORDER BY discount)")
def _(t):
    # Ranks of distinct values are counted on their histogram, then joined back: no window holds a whole location.
    return S.average_rank(t.candidates.select(*KEY, "location", "discount"), ["location"], "discount", "avg_rank").select(*KEY, "avg_rank")


HOLM = "SELECT family, test, p, round(max(least(1.0::double, p * (m - i + 1))) OVER (PARTITION BY family ORDER BY i ROWS UNBOUNDED PRECEDING), 8) AS adjusted FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i FROM (SELECT c_mktsegment AS family, c_custkey AS test, (abs(c_acctbal) / 200000) AS p FROM customer))"


@query("holm_adjust", HOLM)
def _(t):
    x = t.customer.select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("test"), (F.abs("c_acctbal") / 200000).alias("p"))
    return S.holm(x, ["family"], "p", "test").select("family", "test", "p", F.round("adjusted", 8).alias("adjusted"))


@query("cumulative_energy_quantile", "SELECT vec_id, min(n) FILTER (cum >= 0.05) AS lo, min(n) FILTER (cum >= 0.5) AS mid, min(n) FILTER (cum >= 0.95) AS hi FROM (SELECT vec_id, n, round(sum(v * v) OVER (PARTITION BY vec_id ORDER BY n) / sum(v * v) OVER (PARTITION BY vec_id), 9) AS cum FROM samples) GROUP BY 1")
def _(t):
    e = F.transform("signal", lambda v: v * v)
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    cum = F.aggregate(e, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    x = t.segments.select("vec_id", F.transform(cum, lambda c: F.round(c / total, 9)).alias("cum"))
    first = lambda q: F.array_position(F.transform("cum", lambda c: c >= q), True) - 1
    return x.select("vec_id", first(0.05).alias("lo"), first(0.5).alias("mid"), first(0.95).alias("hi"))


@query("contiguous_intervals", "SELECT user_id, min(n) AS run_start, max(n) + 1 AS run_end FROM (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS island FROM recordings WHERE value > 50) GROUP BY user_id, island")
def _(t):
    return S.true_runs(t.recordings.filter("value > 50"), ["user_id"], "n", 1).select("user_id", "run_start", "run_end")


@query("merged_intervals", "SELECT user_id, min(n) AS run_start, max(n) + 1 AS run_end FROM (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT user_id, n, (n - lag(n) OVER (PARTITION BY user_id ORDER BY n) > 4)::int AS jump FROM recordings WHERE value > 70)) GROUP BY user_id, coalesce(island, 0)")
def _(t):
    return S.true_runs(t.recordings.filter("value > 70"), ["user_id"], "n", 4).select("user_id", "run_start", "run_end")


@query("annotation_overlap", "SELECT user_id, n FROM (SELECT user_id, n, value, lag(value) OVER (PARTITION BY user_id ORDER BY n) AS before FROM recordings) WHERE before - value > 0.001")
def _(t):
    w = W.partitionBy("user_id").orderBy("n")
    return t.recordings.withColumn("before", F.lag("value").over(w)).filter("before - value > 0.001").select("user_id", "n")


@query("zero_crossing_rate", "SELECT vec_id, round(avg(change), 6) AS zcr FROM (SELECT vec_id, ((v < 0) <> (lag(v) OVER (PARTITION BY vec_id ORDER BY n) < 0))::int::double AS change FROM samples) GROUP BY 1")
def _(t):
    s = F.col("signal")
    changes = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0))
    return t.segments.select("vec_id", r6(F.aggregate(changes, F.lit(0.0), lambda a, x: a + x) / (F.size(s) - 1)).alias("zcr"))


@query("first_per_patient", "SELECT patient_id, recording_id, cycle_index, price FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY recording_id, cycle_index) AS rn FROM candidates) WHERE rn = 1")
def _(t):
    return R.first_by(t.candidates, ["patient_id"], [F.col(c) for c in TOTAL]).select("patient_id", *KEY, "price")


@query("dedupe_keep_first", "SELECT patient_id, location, murmur_phase, recording_id, cycle_index FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, murmur_phase ORDER BY recording_id, cycle_index) AS rn FROM candidates) WHERE rn = 1")
def _(t):
    return t.candidates.groupBy("patient_id", "murmur_phase").agg(F.min(F.struct("recording_id", "cycle_index", "location")).alias("x")).select("patient_id", "x.location", "murmur_phase", "x.recording_id", "x.cycle_index")


@query("qa_quartiles", """WITH e AS (SELECT murmur_phase, quantile_cont(quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM candidates GROUP BY 1)
    SELECT quartile, murmur_phase, count(*) AS n, round(median(price), 4) AS med FROM (SELECT murmur_phase, price, CASE WHEN quantity <= q[2] THEN 'Q1' WHEN quantity <= q[3] THEN 'Q2' WHEN quantity <= q[4] THEN 'Q3' ELSE 'Q4' END AS quartile FROM candidates JOIN e USING (murmur_phase)) GROUP BY 1, 2""")
def _(t):
    x = S.quartile_labels(t.candidates.select("murmur_phase", "quantity", "price"), ["murmur_phase"], "quantity", "quartile")
    by = ["quartile", "murmur_phase"]
    return O.with_percentiles(x.groupBy(*by).agg(F.count("*").alias("n")), x, by, {"med": F.col("price")}, [0.5]).withColumn("med", r6(F.col("med")[0], 4))


@query("cycle_index", "SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n) AS cycle_index FROM recordings WHERE n % 4 = 1")
def _(t):
    return t.recordings.filter("n % 4 = 1").select("user_id", "n", F.row_number().over(W.partitionBy("user_id").orderBy("n")).cast("long").alias("cycle_index"))


@query("first_n_cycles", "SELECT recording_id, cycle_index FROM candidates WHERE cycle_index <= 2")
def _(t):
    return S.first_cycles(t.candidates, 2).select(*KEY)


@query("patient_cap_sample", "SELECT patient_id, recording_id, cycle_index FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY md5('7|' || recording_id || '|' || cycle_index)) AS rn FROM candidates) WHERE rn <= 3")
def _(t):
    return R.first_by(t.candidates, ["patient_id"], [F.md5(F.concat_ws("|", F.lit("7"), *[F.col(c).cast("string") for c in KEY]).cast("binary"))], 3).select("patient_id", *KEY)


@query("spectral_flux", "SELECT vec_id, round(avg(abs(v - p)), 6) AS flux, round(max(abs(v - p)), 6) AS top FROM (SELECT vec_id, v, lag(v) OVER (PARTITION BY vec_id ORDER BY n) AS p FROM samples) WHERE p IS NOT NULL GROUP BY 1")
def _(t):
    s = F.col("signal")
    d = F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda a, b: F.abs(a - b))
    return t.segments.select("vec_id", d.alias("d"), F.size(s).alias("k")).select("vec_id", r6(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / (F.col("k") - 1)).alias("flux"), r6(F.array_max("d")).alias("top"))


@query("stable_sort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS rn FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")).cast("long").alias("rn"))


@query("limit_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("qa_extreme_topk", "SELECT recording_id, cycle_index, leak FROM (SELECT recording_id, cycle_index, CASE WHEN valid THEN discount + tax END AS leak FROM candidates) ORDER BY leak DESC NULLS LAST, recording_id, cycle_index LIMIT 20")
def _(t):
    return t.candidates.select(*KEY, F.when(F.col("valid"), F.col("discount") + F.col("tax")).alias("leak")).orderBy(F.desc_nulls_last("leak"), *TOTAL).limit(20)


STRATA = [("extreme", "price > 90000", 8), ("fallback_low", "status = 'fallback' and quantity < 5", 6), ("accepted", "status = 'accepted'", 10), ("silent", "not valid", 4)]


@query("stratified_selection")
def _(t):
    return S.greedy_quota(t.candidates.select("patient_id", *KEY, "status", "quantity", "price", "valid"), [(n, F.expr(c), k) for n, c, k in STRATA], KEY, [F.desc("price"), *[F.col(c) for c in KEY]])


@query("stratum_first_selection", "SELECT recording_id, cycle_index, row_number() OVER (ORDER BY price DESC, recording_id, cycle_index) AS selection_rank FROM (SELECT * FROM candidates WHERE price > 90000 ORDER BY price DESC, recording_id, cycle_index LIMIT 8)")
def _(t):
    x = S.greedy_quota(t.candidates.select("patient_id", *KEY, "status", "quantity", "price", "valid"), [(n, F.expr(c), k) for n, c, k in STRATA[:1]], KEY, [F.desc("price"), *[F.col(c) for c in KEY]])
    return x.select(*KEY, F.col("selection_rank").cast("long").alias("selection_rank"))


@query("selection_shortfall", """WITH s AS (SELECT 'extreme' AS stratum, 8 AS requested, count(*) FILTER (price > 104000) AS eligible FROM candidates UNION ALL SELECT 'huge', 5, count(*) FILTER (price > 1e9) FROM candidates)
    SELECT stratum, requested::bigint AS requested, eligible, least(requested, eligible) AS selected, CASE WHEN eligible < requested THEN 'insufficient_eligible' END AS reason FROM s""")
def _(t):
    return S.shortfall(t.candidates, [("extreme", F.col("price") > 104000, 8), ("huge", F.col("price") > 1e9, 5)])


@query("round_robin_sample", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) ORDER BY rn, c_mktsegment LIMIT 17")
def _(t):
    return S.round_robin(t.customer, "c_mktsegment", [F.col("c_custkey")], 17).select("c_custkey", "c_mktsegment")


@query("representative_rows", "SELECT recording_id, cycle_index, location FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY discount DESC, tax ASC NULLS LAST, price DESC, recording_id, cycle_index) AS rn FROM candidates) WHERE rn = 1")
def _(t):
    # The least of a struct is a map-side aggregate; no location is sorted in one task.
    best = F.min(F.struct((-F.col("discount")).alias("a"), F.col("tax"), (-F.col("price")).alias("b"), "recording_id", "cycle_index")).alias("x")
    return t.candidates.groupBy("location").agg(best).select("x.recording_id", "x.cycle_index", "location")


@query("near_best_selection", """WITH g AS (SELECT location, timing_label, avg(price) / 1000 AS score, avg((status = 'fallback')::int::double) AS fb, count(*) AS n FROM candidates GROUP BY 1, 2) SELECT location, timing_label, round(score, 6) AS score FROM g WHERE score >= (SELECT max(score) FROM g) - 0.5 ORDER BY round(fb, 9), n DESC, location, timing_label LIMIT 1""")
def _(t):
    g = t.candidates.groupBy("location", "timing_label").agg((F.avg("price") / 1000).alias("score"), F.avg((F.col("status") == "fallback").cast("double")).alias("fb"), F.count("*").alias("n"))
    return S.near_best(g, "score", 0.5, [F.round("fb", 9), F.desc("n"), "location", "timing_label"]).select("location", "timing_label", r6("score").alias("score"))


@query("phase_fallback_argmax", "SELECT recording_id, arg_max(cycle_index, (discount, tax, -cycle_index)) AS cycle_index FROM candidates GROUP BY 1")
def _(t):
    return t.candidates.groupBy("recording_id").agg(F.max_by("cycle_index", F.struct("discount", "tax", -F.col("cycle_index"))).alias("cycle_index"))


@query("best_method", "SELECT recording_id, arg_min(status, (tax, status, cycle_index)) AS method, min(tax) AS score FROM candidates GROUP BY 1")
def _(t):
    return t.candidates.groupBy("recording_id").agg(F.min_by("status", F.struct("tax", "status", "cycle_index")).alias("method"), F.min("tax").alias("score"))


@query("array_argmax", "SELECT vec_id, min(n) AS at FROM (SELECT vec_id, n, v, max(v) OVER (PARTITION BY vec_id) AS m FROM samples) WHERE v = m GROUP BY 1")
def _(t):
    return t.segments.select("vec_id", (F.array_position("signal", F.array_max("signal")) - 1).alias("at"))
