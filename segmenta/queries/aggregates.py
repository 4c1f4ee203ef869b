"""Aggregations, roll-ups and summaries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.functions import labels as L
from segmenta.operators import orderstats as O
from segmenta.plans.registry import query, r6

KEY = ["recording_id", "cycle_index"]
PA = "murmur_label = 'Present' AND status = 'accepted'"


@query("quality_group_count", "SELECT status, CASE WHEN location <> 'FURNITURE' THEN location END AS location, count(*) AS n FROM candidates GROUP BY 1, 2")
def _(t):
    return t.candidates.groupBy("status", F.when(F.col("location") != "FURNITURE", F.col("location")).alias("location")).agg(F.count("*").alias("n"))


@query("audit_quality_summary", """SELECT murmur_phase, status, murmur_label, count(*) AS segment_count, round(avg(quantity), 6) AS m1, round(avg(price), 4) AS m2, round(avg(discount), 6) AS m3, round(avg(tax), 6) AS m4 FROM candidates GROUP BY 1, 2, 3""")
def _(t):
    return t.candidates.groupBy("murmur_phase", "status", "murmur_label").agg(F.count("*").alias("segment_count"), r6(F.avg("quantity")).alias("m1"), r6(F.avg("price"), 4).alias("m2"), r6(F.avg("discount")).alias("m3"), r6(F.avg("tax")).alias("m4"))


@query("observation_summary", f"SELECT murmur_phase, timing_label, count(*) AS segment_count, round(avg(quantity), 6) AS quantity_mean, round(median(quantity), 6) AS quantity_median, round(avg(price), 4) AS price_mean, round(median(price), 4) AS price_median, round(avg(tax), 6) AS tax_mean, round(median(tax), 6) AS tax_median FROM candidates WHERE {PA} GROUP BY 1, 2")
def _(t):
    x = t.candidates.filter(PA)
    numeric = [c for c, k in x.dtypes if k == "double" and c in ("quantity", "price", "tax")]
    digits = {"price": 4}
    by = ["murmur_phase", "timing_label"]
    g = x.groupBy(*by).agg(F.count("*").alias("segment_count"), *[r6(F.avg(c), digits.get(c, 6)).alias(f"{c}_mean") for c in numeric])
    g = O.with_percentiles(g, x, by, {f"{c}_median": F.col(c) for c in numeric}, [0.5])
    return g.withColumns({f"{c}_median": r6(F.col(f"{c}_median")[0], digits.get(c, 6)) for c in numeric})


Q = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


@query("robust_quantiles", "SELECT status, " + ", ".join(f"round(quantile_cont(price, {q}), 4) AS {k}" for k, q in Q.items()) + ", round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 4) AS iqr FROM candidates GROUP BY 1")
def _(t):
    g = O.percentiles(t.candidates, ["status"], {"p": F.col("price")}, list(Q.values()))
    return g.select("status", *[r6(F.col("p")[i], 4).alias(k) for i, k in enumerate(Q)], r6(F.col("p")[2] - F.col("p")[0], 4).alias("iqr"))


@query("denominator_flow", """SELECT 'recordings' AS stage, 'all' AS phase, 'all' AS status, count(DISTINCT recording_id) AS n FROM candidates UNION ALL SELECT 'patients', 'all', 'all', count(DISTINCT patient_id) FROM candidates
    UNION ALL SELECT 'cycles', 'all', 'all', count(DISTINCT (recording_id, cycle_index)) FROM candidates UNION ALL SELECT 'rows', 'all', 'all', count(*) FROM candidates
    UNION ALL SELECT 'rows', murmur_phase, status, count(*) FROM candidates GROUP BY 2, 3 UNION ALL SELECT 'valid', murmur_phase, 'all', count(*) FILTER (valid) FROM candidates GROUP BY 2""")
def _(t):
    c = t.candidates
    # Three counts of one pass; the cycle number makes (recording, cycle) unique, so that count needs no distinct of its own.
    one = c.agg(F.count_distinct("recording_id").alias("recordings"), F.count_distinct("patient_id").alias("patients"), F.count("*").alias("rows"))
    cycles = c.select(*KEY).distinct().agg(F.count("*").alias("cycles"))
    totals = one.crossJoin(cycles).unpivot([], ["recordings", "patients", "cycles", "rows"], "stage", "n").select("stage", F.lit("all").alias("phase"), F.lit("all").alias("status"), "n")
    by = c.groupBy("murmur_phase", "status").agg(F.count("*").alias("n")).select(F.lit("rows").alias("stage"), F.col("murmur_phase").alias("phase"), "status", "n")
    ok = c.groupBy("murmur_phase").agg(F.count_if("valid").alias("n")).select(F.lit("valid").alias("stage"), F.col("murmur_phase").alias("phase"), F.lit("all").alias("status"), "n")
    return totals.unionByName(by).unionByName(ok)


@query("validity_transition_counts", "SELECT location, count(*) FILTER (discount > 0.02 AND NOT tax > 0.01) AS lost, count(*) FILTER (NOT discount > 0.02 AND tax > 0.01) AS won, count(*) FILTER (quantity > 45) AS clipped FROM candidates GROUP BY 1")
def _(t):
    a, b = F.col("discount") > 0.02, F.col("tax") > 0.01
    return t.candidates.groupBy("location").agg(F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("won"), F.count_if(F.col("quantity") > 45).alias("clipped"))


@query("agreement_rate", "SELECT location, round(avg(CASE WHEN valid THEN 1.0::double ELSE 0.0::double END), 6) AS rate FROM candidates GROUP BY 1")
def _(t):
    return t.candidates.groupBy("location").agg(r6(F.avg(F.col("valid").cast("double"))).alias("rate"))


@query("median_of_medians", """SELECT patient_id, murmur_phase, round(median(m), 6) AS value, count(*) AS n_recordings FROM (SELECT patient_id, murmur_phase, recording_id, median(quantity) AS m FROM candidates WHERE valid GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    rec = t.candidates.filter("valid").groupBy("patient_id", "murmur_phase", "recording_id").agg(F.percentile("quantity", 0.5).alias("m"))
    return rec.groupBy("patient_id", "murmur_phase").agg(r6(F.percentile("m", 0.5)).alias("value"), F.count("*").alias("n_recordings"))


@query("feature_coverage_rollup", """SELECT coalesce(murmur_phase, 'all') AS phase, coalesce(status, 'all') AS status, count(*) AS attempted, count(*) FILTER (valid) AS n_valid, round(count(*) FILTER (valid) / count(*)::double, 6) AS coverage, round(median(price) FILTER (valid), 4) AS med,
    round(quantile_cont(price, 0.25) FILTER (valid), 4) AS q25, round(quantile_cont(price, 0.75) FILTER (valid), 4) AS q75 FROM candidates GROUP BY ROLLUP (murmur_phase, status)""")
def _(t):
    v = F.when(F.col("valid"), F.col("price"))
    c = t.candidates
    counts = c.groupBy("murmur_phase", "status").agg(F.count("*").alias("attempted"), F.count_if("valid").alias("n_valid"))
    levels = []
    for by in ([], ["murmur_phase"], ["murmur_phase", "status"]):  # upper levels from the counts of the lowest
        g = O.with_percentiles(counts.groupBy(*by).agg(F.sum("attempted").alias("attempted"), F.sum("n_valid").alias("n_valid")), c, by, {"p": v}, [0.25, 0.5, 0.75])
        levels.append(g.select(*[F.col(k) if k in by else F.lit("all").alias(k) for k in ("murmur_phase", "status")], "attempted", "n_valid", "p"))
    g = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return g.select(F.col("murmur_phase").alias("phase"), "status", "attempted", "n_valid", r6(F.col("n_valid") / F.col("attempted")).alias("coverage"), r6(F.col("p")[1], 4).alias("med"), r6(F.col("p")[0], 4).alias("q25"), r6(F.col("p")[2], 4).alias("q75"))


@query("invalid_reason_counts", "SELECT murmur_phase, status, feature, 'zero' AS reason, count(*) AS n FROM (SELECT murmur_phase, status, unnest(['discount','tax']) AS feature, unnest([discount, tax]) AS v FROM candidates) WHERE v = 0 GROUP BY 1, 2, 3")
def _(t):
    x = t.candidates.unpivot(["murmur_phase", "status"], ["discount", "tax"], "feature", "v").filter("v = 0")
    return x.groupBy("murmur_phase", "status", "feature", F.lit("zero").alias("reason")).agg(F.count("*").alias("n"))


@query("category_ratio", f"SELECT murmur_phase, timing_label, dimension, category, n, round(n / (sum(n) OVER (PARTITION BY murmur_phase, timing_label, dimension))::double, 6) AS ratio FROM (SELECT murmur_phase, timing_label, dimension, category, count(*) AS n FROM (SELECT murmur_phase, timing_label, unnest(['location','label']) AS dimension, unnest([location, murmur_label]) AS category FROM candidates WHERE {PA}) GROUP BY ALL)")
def _(t):
    x = t.candidates.filter(PA).select("murmur_phase", "timing_label", "location", F.col("murmur_label").alias("label")).unpivot(["murmur_phase", "timing_label"], ["location", "label"], "dimension", "category")
    g = x.groupBy("murmur_phase", "timing_label", "dimension", F.coalesce("category", F.lit("missing")).alias("category")).agg(F.count("*").alias("n"))
    return g.withColumn("ratio", r6(F.col("n") / F.sum("n").over(W.partitionBy("murmur_phase", "timing_label", "dimension"))))


@query("expert_agreement_summary", f"""WITH s AS (SELECT *, CASE WHEN tax <> 0.02 THEN discount > 0.05 END AS t_ok, CASE WHEN tax <> 0.03 THEN quantity > 25 END AS s_ok FROM candidates WHERE {PA})
    SELECT murmur_phase, 'timing' AS comparison, 'all' AS category, count(*) AS n, count(t_ok) AS scorable, count(*) FILTER (t_ok) AS agreed, round(count(*) FILTER (t_ok) / count(t_ok)::double, 6) AS ratio, NULL::double AS mean_f, NULL::double AS median_f FROM s GROUP BY 1
    UNION ALL SELECT murmur_phase, 'shape', 'all', count(*), count(s_ok), count(*) FILTER (s_ok), round(count(*) FILTER (s_ok) / count(s_ok)::double, 6), NULL, NULL FROM s GROUP BY 1
    UNION ALL SELECT murmur_phase, 'pitch', location, count(*), count(price), NULL, NULL, round(avg(price), 4), round(median(price), 4) FROM s GROUP BY 1, 3""")
def _(t):
    s = t.candidates.filter(PA).withColumns({"t_ok": F.when(F.col("tax") != 0.02, F.col("discount") > 0.05), "s_ok": F.when(F.col("tax") != 0.03, F.col("quantity") > 25)})

    def agreement(name, c):
        return s.groupBy("murmur_phase", F.lit(name).alias("comparison"), F.lit("all").alias("category")).agg(F.count("*").alias("n"), F.count(c).alias("scorable"), F.count_if(c).alias("agreed"), r6(F.try_divide(F.count_if(c).cast("double"), F.count(c))).alias("ratio"), F.lit(None).cast("double").alias("mean_f"), F.lit(None).cast("double").alias("median_f"))

    pitch = s.groupBy("murmur_phase", F.lit("pitch").alias("comparison"), F.col("location").alias("category")).agg(F.count("*").alias("n"), F.count("price").alias("scorable"), F.lit(None).cast("long").alias("agreed"), F.lit(None).cast("double").alias("ratio"), r6(F.avg("price"), 4).alias("mean_f"), r6(F.percentile("price", 0.5), 4).alias("median_f"))
    return agreement("timing", "t_ok").unionByName(agreement("shape", "s_ok")).unionByName(pitch)


@query("worst_case_argmax", "SELECT patient_id, max(discount) AS worst, arg_max(recording_id, (discount, -recording_id, -cycle_index)) AS recording_id FROM candidates GROUP BY 1")
def _(t):
    return t.candidates.groupBy("patient_id").agg(F.max("discount").alias("worst"), F.max_by("recording_id", F.struct("discount", -F.col("recording_id"), -F.col("cycle_index"))).alias("recording_id"))


VAR = "SELECT recording_id, cycle_index, patient_id, murmur_phase, quantity, k, abs(sin(quantity + k) * discount * 10) AS change, (cycle_index + k) % 5 = 0 AS clipped, (recording_id + k) % 7 <> 0 AS ok FROM candidates, (SELECT unnest(range(1, 9)) AS k) WHERE cycle_index <= 2"


def variants(t):
    """A stand-in for the long change table: eight variants of each candidate, within the row."""
    x = t.candidates.filter("cycle_index <= 2").select(*KEY, "patient_id", "murmur_phase", "quantity", "discount", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"))
    return x.withColumns({"change": F.abs(F.sin(F.col("quantity") + F.col("k")) * F.col("discount") * 10), "clipped": (F.col("cycle_index") + F.col("k")) % 5 == 0, "ok": (F.col("recording_id") + F.col("k")) % 7 != 0})


@query("boundary_10pct_summary", f"""WITH v AS ({VAR}), iqr AS (SELECT quantile_cont(quantity, 0.75) - quantile_cont(quantity, 0.25) AS iqr FROM candidates WHERE cycle_index <= 2)
    SELECT recording_id, cycle_index, count(*) AS families, count(*) FILTER (ok AND NOT clipped) AS n_valid, round(median(change) FILTER (ok AND NOT clipped), 6) AS med, round(max(change) FILTER (ok AND NOT clipped), 6) AS top, round(median(change) FILTER (ok AND NOT clipped) / any_value(iqr), 6) AS standardized,
    count(*) FILTER (NOT ok) AS lost, count(*) FILTER (clipped) AS n_clipped, round(median(change) FILTER (ok), 6) AS effective FROM v, iqr GROUP BY 1, 2""")
def _(t):
    v = variants(t)
    iqr = O.percentiles(t.candidates.filter("cycle_index <= 2"), [], {"q": F.col("quantity")}, [0.25, 0.75]).select((F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    primary = F.col("ok") & ~F.col("clipped")
    m = F.percentile(F.when(primary, F.col("change")), 0.5)
    g = v.groupBy(*KEY).agg(F.count("*").alias("families"), F.count_if(primary).alias("n_valid"), m.alias("m"), r6(F.max(F.when(primary, F.col("change")))).alias("top"), F.count_if(~F.col("ok")).alias("lost"), F.count_if("clipped").alias("n_clipped"), r6(F.percentile(F.when(F.col("ok"), F.col("change")), 0.5)).alias("effective"))
    return g.crossJoin(F.broadcast(iqr)).select(*KEY, "families", "n_valid", r6("m").alias("med"), "top", r6(F.col("m") / F.col("iqr")).alias("standardized"), "lost", "n_clipped", "effective")


@query("high_quality_stratum", """WITH m AS (SELECT murmur_phase, median(CASE WHEN valid THEN price END) AS mp, median(quantity) AS mq, median(tax) AS mt, median(discount) AS md FROM candidates GROUP BY 1)
    SELECT recording_id, cycle_index, (coalesce((CASE WHEN valid THEN price END <= mp)::int, 0) + (quantity >= mq)::int + (tax <= mt)::int + (discount <= md)::int)::bigint AS score,
    status = 'accepted' AND (coalesce((CASE WHEN valid THEN price END <= mp)::int, 0) + (quantity >= mq)::int + (tax <= mt)::int + (discount <= md)::int) >= 3 AS high_quality FROM candidates JOIN m USING (murmur_phase)""")
def _(t):
    c = t.candidates.withColumn("p", F.when(F.col("valid"), F.col("price")))
    names = {"mp": "p", "mq": "quantity", "mt": "tax", "md": "discount"}
    m = O.percentiles(c, ["murmur_phase"], {k: F.col(x) for k, x in names.items()}, [0.5]).select("murmur_phase", *[F.col(k)[0].alias(k) for k in names])
    score = L.high_quality_score(F.col("p") <= F.col("mp"), F.col("quantity") >= F.col("mq"), F.col("tax") <= F.col("mt"), F.col("discount") <= F.col("md"))
    return c.join(F.broadcast(m), "murmur_phase").select(*KEY, score.cast("long").alias("score"), ((F.col("status") == "accepted") & (score >= 3)).alias("high_quality"))  # two phases


@query("max_leakage", "SELECT recording_id, cycle_index, greatest(CASE WHEN valid THEN discount END, tax) AS leak FROM candidates")
def _(t):
    return t.candidates.select(*KEY, F.greatest(F.when(F.col("valid"), F.col("discount")), "tax").alias("leak"))


@query("invalid_reason_string", "SELECT recording_id, string_agg(feature || ':zero', ';' ORDER BY feature) AS reasons FROM (SELECT DISTINCT recording_id, feature FROM features_long WHERE value = 0) GROUP BY 1")
def _(t):
    return t.features_long.filter("value = 0").groupBy("recording_id").agg(F.concat_ws(";", F.array_sort(F.collect_set(F.concat("feature", F.lit(":zero"))))).alias("reasons"))


@query("location_distribution", "SELECT status, '{' || string_agg('\"' || location || '\":' || n, ',' ORDER BY location) || '}' AS histogram FROM (SELECT status, location, count(*) AS n FROM candidates GROUP BY 1, 2) GROUP BY 1")
def _(t):
    g = t.candidates.groupBy("status", "location").agg(F.count("*").alias("n"))
    return g.groupBy("status").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("location", "n"))))).alias("histogram"))


@query("cluster_sufficient_stats", "SELECT patient_id, count(*) AS n, round(sum(quantity), 4) AS sx, round(sum(discount), 4) AS sy, round(sum(quantity * quantity), 4) AS sxx, round(sum(discount * discount), 4) AS syy, round(sum(quantity * discount), 4) AS sxy FROM candidates GROUP BY 1")
def _(t):
    x, y = F.col("quantity"), F.col("discount")
    return t.candidates.groupBy("patient_id").agg(F.count("*").alias("n"), *[r6(F.sum(c), 4).alias(k) for k, c in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])


@query("feature_stability_summary", f"""WITH v AS ({VAR}), b AS (SELECT murmur_phase, quantile_cont(quantity, 0.75) - quantile_cont(quantity, 0.25) AS iqr FROM candidates WHERE cycle_index <= 2 GROUP BY 1)
    SELECT murmur_phase, round(median(change), 6) AS med, round(any_value(iqr), 6) AS baseline_iqr, round(median(change) / any_value(iqr), 6) AS standardized FROM v JOIN b USING (murmur_phase) GROUP BY 1""")
def _(t):
    b = O.percentiles(t.candidates.filter("cycle_index <= 2"), ["murmur_phase"], {"q": F.col("quantity")}, [0.25, 0.75]).select("murmur_phase", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    g = O.percentiles(variants(t), ["murmur_phase"], {"m": F.col("change")}, [0.5]).withColumn("m", F.col("m")[0])
    return g.join(b, "murmur_phase").select("murmur_phase", r6("m").alias("med"), r6("iqr").alias("baseline_iqr"), r6(F.col("m") / F.col("iqr")).alias("standardized"))


@query("perturbation_stability", f"SELECT k, count(DISTINCT (recording_id, cycle_index)) AS candidates_n, count(*) AS n_rows, round(median(change), 6) AS med, round(quantile_cont(change, 0.9), 6) AS q90, count(*) FILTER (clipped) AS n_clipped, round(max(change), 6) AS worst FROM ({VAR}) GROUP BY 1")
def _(t):
    g = variants(t).groupBy(F.col("k").cast("long").alias("k")).agg(F.count_distinct(*KEY).alias("candidates_n"), F.count("*").alias("n_rows"), F.count_if("clipped").alias("n_clipped"), r6(F.max("change")).alias("worst"))
    g = O.with_percentiles(g, variants(t).withColumn("k", F.col("k").cast("long")), ["k"], {"p": F.col("change")}, [0.5, 0.9])
    return g.select("k", "candidates_n", "n_rows", r6(F.col("p")[0]).alias("med"), r6(F.col("p")[1]).alias("q90"), "n_clipped", "worst")


@query("grouped_stability", f"""WITH v AS ({VAR}) SELECT dimension, grp, count(*) AS n, round(median(change), 6) AS med FROM (SELECT unnest(['phase','parity']) AS dimension, unnest([murmur_phase, (patient_id % 40)::varchar]) AS grp, change, recording_id, cycle_index FROM v) GROUP BY 1, 2 HAVING count(DISTINCT (recording_id, cycle_index)) >= 2""")
def _(t):
    x = variants(t).select(*KEY, "change", F.col("murmur_phase").alias("phase"), (F.col("patient_id") % 40).cast("string").alias("parity")).unpivot([*KEY, "change"], ["phase", "parity"], "dimension", "grp")
    return x.groupBy("dimension", "grp").agg(F.count("*").alias("n"), r6(F.percentile("change", 0.5)).alias("med"), F.count_distinct(*KEY).alias("c")).filter("c >= 2").drop("c")


@query("tuning_summary", "SELECT location, round(avg(CASE WHEN murmur_label = 'Present' THEN price END), 4) AS present_mean, round(median(CASE WHEN murmur_label = 'Present' THEN price END), 4) AS present_median, round(avg(CASE WHEN murmur_label = 'Absent' THEN (status = 'fallback')::int::double END), 6) AS absent_fallback FROM candidates GROUP BY 1")
def _(t):
    p = F.when(F.col("murmur_label") == "Present", F.col("price"))
    g = t.candidates.groupBy("location").agg(r6(F.avg(p), 4).alias("present_mean"), r6(F.avg(F.when(F.col("murmur_label") == "Absent", (F.col("status") == "fallback").cast("double")))).alias("absent_fallback"))
    return O.with_percentiles(g, t.candidates, ["location"], {"present_median": p}, [0.5]).withColumn("present_median", r6(F.col("present_median")[0], 4))


@query("first_consistent", "SELECT patient_id, min(location) AS location, count(*) AS n FROM candidates GROUP BY 1 HAVING min(location) = max(location)")
def _(t):
    g = t.candidates.groupBy("patient_id").agg(F.min("location").alias("location"), F.max("location").alias("hi"), F.count("*").alias("n"))
    return g.filter(F.col("location") == F.col("hi")).drop("hi")


@query("summaries_by_label", "SELECT timing_label, count(*) AS n, round(median(price), 4) AS med, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.75), 4) AS q75 FROM candidates WHERE timing_label IS NOT NULL GROUP BY 1")
def _(t):
    x = t.candidates.filter("timing_label is not null")
    g = O.with_percentiles(x.groupBy("timing_label").agg(F.count("*").alias("n")), x, ["timing_label"], {"p": F.col("price")}, [0.25, 0.5, 0.75])
    return g.select("timing_label", "n", r6(F.col("p")[1], 4).alias("med"), r6(F.col("p")[0], 4).alias("q25"), r6(F.col("p")[2], 4).alias("q75"))


@query("feature_status", "SELECT status, murmur_phase, count(*) AS n, count(*) FILTER (valid) AS n_valid, count(DISTINCT patient_id) FILTER (valid) AS n_patients, round(quantile_cont(discount, 0.75) FILTER (valid) - quantile_cont(discount, 0.25) FILTER (valid), 6) AS iqr FROM candidates GROUP BY 1, 2")
def _(t):
    v = F.when(F.col("valid"), F.col("discount"))
    by = ["status", "murmur_phase"]
    g = t.candidates.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_distinct(F.when(F.col("valid"), F.col("patient_id"))).alias("n_patients"))
    return O.with_percentiles(g, t.candidates, by, {"p": v}, [0.25, 0.75]).select(*by, "n", "n_valid", "n_patients", r6(F.col("p")[1] - F.col("p")[0]).alias("iqr"))


@query("candidate_prepare", "SELECT recording_id, cycle_index, patient_id || ':' || recording_id || ':cycle' || cycle_index || ':' || murmur_phase AS candidate_id, greatest(discount, tax) AS max_leak, CASE WHEN valid THEN '' ELSE 'discount:silent_candidate' END AS summary FROM candidates")
def _(t):
    cid = F.format_string("%d:%d:cycle%d:%s", "patient_id", "recording_id", "cycle_index", "murmur_phase")
    return t.candidates.select(*KEY, cid.alias("candidate_id"), F.greatest("discount", "tax").alias("max_leak"), F.when(F.col("valid"), "").otherwise("discount:silent_candidate").alias("summary"))

