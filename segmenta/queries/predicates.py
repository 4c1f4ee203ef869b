"""Projections, filters and case expressions."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.functions import labels as L
from segmenta.plans.registry import query, r6

KEY = ["recording_id", "cycle_index"]
OUTCOME = "CASE WHEN location IN ('BUILDING','MACHINERY') THEN 'Normal' WHEN location = 'FURNITURE' THEN NULL ELSE 'Abnormal' END"


def outcome(t):
    return t.candidates.withColumn("outcome", F.when(F.col("location").isin("BUILDING", "MACHINERY"), "Normal").when(F.col("location") != "FURNITURE", "Abnormal"))


@query("present_accepted_filter", "SELECT patient_id, recording_id, cycle_index, quantity FROM candidates WHERE murmur_label = 'Present' AND status IN ('accepted') AND quantity >= 10 AND NOT tax > 0.05")
def _(t):
    c = t.candidates
    return c.filter((c.murmur_label == "Present") & c.status.isin("accepted") & (c.quantity >= 10) & ~(c.tax > 0.05)).select("patient_id", *KEY, "quantity")


@query("feature_table_projection", "SELECT patient_id, recording_id, cycle_index, murmur_phase, quantity AS feature_a, price AS feature_b, NULL::double AS feature_missing FROM candidates")
def _(t):
    return t.candidates.select("patient_id", *KEY, "murmur_phase", F.col("quantity").alias("feature_a"), F.col("price").alias("feature_b"), F.lit(None).cast("double").alias("feature_missing"))


@query("audit_outcome_case", """SELECT recording_id, cycle_index, CASE WHEN murmur_label = 'Present' THEN CASE WHEN status = 'accepted' THEN 'present_candidate_accepted' ELSE 'present_candidate_missed' END
    WHEN murmur_label = 'Absent' THEN CASE WHEN status = 'accepted' THEN 'absent_candidate_flagged' ELSE 'absent_negative_control_clear' END ELSE 'unscored_unknown_label' END AS audit_outcome FROM candidates""")
def _(t):
    return t.candidates.select(*KEY, L.audit_outcome(F.col("murmur_label"), F.col("status")).alias("audit_outcome"))


@query("interpretation_group", f"""SELECT recording_id, cycle_index, CASE WHEN murmur_label <> 'Present' THEN 'not_scored' WHEN outcome = 'Normal' THEN 'present_normal_outcome_innocent_proxy'
    WHEN outcome = 'Abnormal' THEN 'present_abnormal_outcome_pathological_proxy' ELSE 'present_unknown_outcome' END AS grp FROM (SELECT *, {OUTCOME} AS outcome FROM candidates)""")
def _(t):
    return outcome(t).select(*KEY, L.interpretation_group(F.col("murmur_label"), F.col("outcome")).alias("grp"))


@query("location_label", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Absent' WHEN o_orderstatus = 'F' AND list_contains(list_transform(string_split('BUILDING+ MACHINERY', '+'), lambda x: trim(x)), c_mktsegment) THEN 'Present' ELSE 'Unknown' END AS label
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    label = F.when(F.col("o_orderstatus") == "O", "Absent").when(F.col("o_orderstatus") == "F", "Present")
    return x.select("o_orderkey", L.location_label(label, F.col("c_mktsegment"), F.lit("BUILDING+ MACHINERY")).alias("label"))


@query("phase_metadata", """SELECT recording_id, cycle_index, CASE WHEN murmur_label = 'Absent' THEN 'Absent' WHEN murmur_label = 'Present' AND timing IS NOT NULL THEN 'Present' ELSE 'Unknown' END AS phase_label,
    timing AS expert_timing_label, CASE WHEN murmur_phase = 'systole' THEN location END AS systole_shape_label FROM (SELECT *, CASE WHEN timing_label NOT LIKE '4%' THEN timing_label END AS timing FROM candidates)""")
def _(t):
    timing = F.when(~F.col("timing_label").like("4%"), F.col("timing_label"))
    return t.candidates.select(*KEY, L.phase_label(F.col("murmur_label"), timing).alias("phase_label"), timing.alias("expert_timing_label"), F.when(F.col("murmur_phase") == "systole", F.col("location")).alias("systole_shape_label"))


@query("timing_quality_status", """SELECT recording_id, cycle_index, CASE WHEN status <> 'accepted' THEN 'low_confidence_candidate' WHEN valid THEN 'accepted_adaptive' ELSE 'accepted_energy_fallback' END AS timing_quality FROM candidates""")
def _(t):
    return t.candidates.select(*KEY, L.timing_quality(F.col("status"), F.when(F.col("valid"), "adaptive_envelope").otherwise("energy_fallback")).alias("timing_quality"))


TIMING = """SELECT recording_id, cycle_index, murmur_phase, timing_label, onset, "offset", CASE WHEN "offset" - onset >= 0.75 AND onset <= 0.15 AND "offset" >= 0.85 THEN CASE WHEN murmur_phase = 'systole' THEN 'Holosystolic' ELSE 'Holodiastolic' END
    ELSE (CASE WHEN 0.5 * (onset + "offset") < 1.0::double / 3 THEN 'Early' WHEN 0.5 * (onset + "offset") < 2.0::double / 3 THEN 'Mid' ELSE 'Late' END) || '-' || CASE WHEN murmur_phase = 'systole' THEN 'systolic' ELSE 'diastolic' END END AS predicted
    FROM (SELECT *, discount * 2 AS onset, discount * 2 + quantity / 50 AS "offset" FROM candidates)"""


def _timed(t):
    x = t.candidates.withColumns({"onset": F.col("discount") * 2, "offset": F.col("discount") * 2 + F.col("quantity") / 50})
    return x.withColumn("predicted", L.predicted_timing(F.col("onset"), F.col("offset"), F.col("murmur_phase")))


@query("predicted_timing_label", f"SELECT recording_id, cycle_index, predicted FROM ({TIMING})")
def _(t):
    return _timed(t).select(*KEY, "predicted")


EXPERT = "CASE WHEN timing_label LIKE '1%' THEN 'Early-systolic' WHEN timing_label LIKE '2%' THEN 'Mid-systolic' WHEN timing_label LIKE '3%' THEN 'Holosystolic' END"


def expert(c):
    return F.when(c.like("1%"), "Early-systolic").when(c.like("2%"), "Mid-systolic").when(c.like("3%"), "Holosystolic")


@query("expert_agreement", f"SELECT recording_id, cycle_index, predicted = {EXPERT} AS timing_agreement FROM ({TIMING})")
def _(t):
    return _timed(t).select(*KEY, (F.col("predicted") == expert(F.col("timing_label"))).alias("timing_agreement"))


@query("candidate_quality_status", "SELECT recording_id, cycle_index, CASE WHEN NOT quantity > 2 THEN 'not_assessed' WHEN tax > 0.06 THEN 'fallback' WHEN discount = 0 THEN 'no_candidate' ELSE 'accepted' END AS quality FROM candidates")
def _(t):
    return t.candidates.select(*KEY, L.quality_status(F.col("quantity") > 2, F.col("tax") > 0.06, F.when(F.col("discount") == 0, 0).otherwise(1)).alias("quality"))


@query("inference_status", """SELECT location, timing_label, CASE WHEN est IS NULL THEN 'not_estimable' WHEN k < 8 THEN 'descriptive_too_few_independent_patients' WHEN fail > 0.05 THEN 'unstable_bootstrap_over_5pct_failures' ELSE 'estimable' END AS inference
    FROM (SELECT location, timing_label, avg(discount) AS est, count(DISTINCT patient_id) AS k, avg(CASE WHEN tax > 0.075 THEN 1.0::double ELSE 0.0::double END) AS fail FROM candidates GROUP BY 1, 2)""")
def _(t):
    g = t.candidates.groupBy("location", "timing_label").agg(F.avg("discount").alias("est"), F.count_distinct("patient_id").alias("k"), F.avg(F.when(F.col("tax") > 0.075, 1.0).otherwise(0.0)).alias("fail"))
    return g.select("location", "timing_label", L.inference_status(F.col("est"), F.col("k"), F.col("fail")).alias("inference"))


@query("annotation_validity", """WITH a AS (SELECT user_id, n, value AS s, lead(value) OVER w AS e, CASE event_type WHEN 'click' THEN 1.0::double WHEN 'view' THEN 2.0::double WHEN 'signup' THEN 3.0::double WHEN 'purchase' THEN 4.5::double ELSE 7.0::double END AS state,
        lag(value) OVER w AS before FROM recordings WINDOW w AS (PARTITION BY user_id ORDER BY n))
    SELECT user_id, n, CASE WHEN s IS NULL OR e IS NULL THEN 'nonfinite' WHEN state <> floor(state) THEN 'non_integer_state' WHEN s < 0 OR e < 0 THEN 'negative_time' WHEN e = s THEN 'zero_length' WHEN e < s THEN 'reversed'
        WHEN state NOT BETWEEN 0 AND 4 THEN 'state_domain' WHEN before - s > 0.001 THEN 'overlap' ELSE 'valid' END AS verdict FROM a""")
def _(t):
    w = W.partitionBy("user_id").orderBy("n")
    kind = F.col("event_type")
    a = t.recordings.select("user_id", "n", F.col("value").alias("s"), F.lead("value").over(w).alias("e"), F.lag("value").over(w).alias("before"), F.when(kind == "click", 1.0).when(kind == "view", 2.0).when(kind == "signup", 3.0).when(kind == "purchase", 4.5).otherwise(7.0).alias("state"))
    s, e, state = F.col("s"), F.col("e"), F.col("state")
    verdict = (
        F.when(s.isNull() | e.isNull(), "nonfinite").when(state != F.floor(state), "non_integer_state").when((s < 0) | (e < 0), "negative_time").when(e == s, "zero_length")
        .when(e < s, "reversed").when(~state.between(0, 4), "state_domain").when(F.col("before") - s > 0.001, "overlap").otherwise("valid")
    )
    return a.select("user_id", "n", verdict.alias("verdict"))


@query("metadata_references", """SELECT o_orderkey, part AS reference, regexp_replace(part, '_[0-9]+$', '') AS base FROM (SELECT o_orderkey, unnest(list_filter(list_transform(string_split(o_orderpriority || '+' || o_orderstatus || '_AV_1', '+'), lambda x: trim(x)), lambda x: x <> '')) AS part FROM orders)""")
def _(t):
    parts = F.filter(F.transform(F.split(F.concat("o_orderpriority", F.lit("+"), "o_orderstatus", F.lit("_AV_1")), "[+]"), lambda y: F.trim(y)), lambda x: x != "")
    return t.orders.select("o_orderkey", F.explode(parts).alias("reference")).withColumn("base", F.regexp_replace("reference", "_[0-9]+$", ""))


@query("try_cast_numeric", "SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS double) AS prefix, try_cast(o_orderstatus AS double) AS bad FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.expr("try_cast(split_part(o_orderpriority, '-', 1) as double)").alias("prefix"), F.expr("try_cast(o_orderstatus as double)").alias("bad"))


@query("clean_label", "SELECT o_orderkey, CASE WHEN trim(x) <> '' AND lower(trim(x)) <> 'nan' THEN trim(x) END AS label FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '  ' WHEN 'P' THEN ' NaN ' ELSE ' ' || o_orderpriority END AS x FROM orders)")
def _(t):
    x = F.when(F.col("o_orderstatus") == "F", "  ").when(F.col("o_orderstatus") == "P", " NaN ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return t.orders.select("o_orderkey", L.clean_label(x).alias("label"))


@query("masked_feature", "SELECT recording_id, cycle_index, CASE WHEN valid THEN price END AS masked FROM candidates")
def _(t):
    return t.candidates.select(*KEY, F.when(F.col("valid"), F.col("price")).alias("masked"))


@query("output_profile_gate", "SELECT recording_id, cycle_index, location FROM candidates WHERE CASE WHEN location IN ('BUILDING') THEN true WHEN location IN ('FURNITURE','MACHINERY') THEN status = 'accepted' ELSE false END")
def _(t):
    profile = F.when(F.col("location") == "BUILDING", "full").when(F.col("location").isin("FURNITURE", "MACHINERY"), "accepted").otherwise("summary")
    return t.candidates.filter((profile == "full") | ((profile == "accepted") & (F.col("status") == "accepted"))).select(*KEY, "location")


@query("strata_flags", "SELECT recording_id, cycle_index, valid AS all_valid, valid AND status = 'accepted' AS accepted_only, valid AND status = 'accepted' AND tax <= 0.04 AS high_quality FROM candidates")
def _(t):
    ok = F.col("valid") & (F.col("status") == "accepted")
    return t.candidates.select(*KEY, F.col("valid").alias("all_valid"), ok.alias("accepted_only"), (ok & (F.col("tax") <= 0.04)).alias("high_quality"))


@query("feature_change", """SELECT recording_id, cycle_index, CASE WHEN bv AND pv THEN round(tax - discount, 6) END AS signed_change, CASE WHEN bv AND pv THEN round(abs(tax - discount), 6) END AS absolute_change,
    CASE WHEN bv AND pv AND abs(discount) > 1e-12 THEN round(abs(tax - discount) / abs(discount), 6) END AS relative_change, (CASE WHEN bv THEN 'valid' ELSE 'invalid' END) || '_to_' || (CASE WHEN pv THEN 'valid' ELSE 'invalid' END) AS transition
    FROM (SELECT *, discount > 0.02 AS bv, tax > 0.01 AS pv FROM candidates)""")
def _(t):
    c = t.candidates.withColumns({"bv": F.col("discount") > 0.02, "pv": F.col("tax") > 0.01})
    both, d = F.col("bv") & F.col("pv"), F.col("tax") - F.col("discount")
    return c.select(*KEY, F.when(both, r6(d)).alias("signed_change"), F.when(both, r6(F.abs(d))).alias("absolute_change"), F.when(both & (F.abs("discount") > 1e-12), r6(F.try_divide(F.abs(d), F.abs("discount")))).alias("relative_change"), L.feature_transition(F.col("bv"), F.col("pv")).alias("transition"))


@query("interval_clamp", "SELECT recording_id, cycle_index, greatest(10, least(32, coalesce(CASE WHEN valid THEN quantity END, 10)))::double AS onset, greatest(10, least(32, coalesce(CASE WHEN tax > 0.02 THEN quantity + 8 END, 32)))::double AS \"offset\" FROM candidates")
def _(t):
    q = F.col("quantity")
    return t.candidates.select(*KEY, L.clamp(F.coalesce(F.when(F.col("valid"), q), F.lit(10.0)), 10.0, 32.0).alias("onset"), L.clamp(F.coalesce(F.when(F.col("tax") > 0.02, q + 8), F.lit(32.0)), 10.0, 32.0).alias("offset"))


@query("tier_validity", """SELECT recording_id, cycle_index, CASE WHEN quantity <= 1 THEN 'invalid_phase' WHEN quantity >= 50 THEN 'invalid_interval' WHEN tax = 0 THEN 'empty_candidate' WHEN discount <= 1e-12 THEN 'silent_candidate' ELSE 'valid' END AS reason FROM candidates""")
def _(t):
    reason = F.when(F.col("quantity") <= 1, "invalid_phase").when(F.col("quantity") >= 50, "invalid_interval").when(F.col("tax") == 0, "empty_candidate").when(F.col("discount") <= 1e-12, "silent_candidate").otherwise("valid")
    return t.candidates.select(*KEY, reason.alias("reason"))


@query("tier_timing", "SELECT recording_id, cycle_index, CASE WHEN quantity > 4 THEN round((quantity - 4) / 50, 6) END AS duration_fraction, CASE WHEN quantity > 4 THEN round(((4 + quantity) / 2 - 2) / 50, 6) END AS midpoint, CASE WHEN quantity > 4 THEN NULL ELSE 'invalid_interval' END AS reason FROM candidates")
def _(t):
    ok, q = F.col("quantity") > 4, F.col("quantity")
    return t.candidates.select(*KEY, F.when(ok, r6((q - 4) / 50)).alias("duration_fraction"), F.when(ok, r6(((q + 4) / 2 - 2) / 50)).alias("midpoint"), F.when(~ok, "invalid_interval").alias("reason"))


@query("prepare_labels", "SELECT recording_id, cycle_index, timing_label FROM candidates WHERE murmur_label = 'Present' AND timing_label IS NOT NULL AND timing_label <> '5-LOW'")
def _(t):
    return t.candidates.filter((F.col("murmur_label") == "Present") & F.col("timing_label").isNotNull() & (F.col("timing_label") != "5-LOW")).select(*KEY, "timing_label")


@query("diastolic_profiles", "SELECT patient_id, recording_id, cycle_index, quantity FROM candidates WHERE murmur_phase = 'diastole' AND valid ORDER BY patient_id, recording_id, cycle_index")
def _(t):
    return t.candidates.filter((F.col("murmur_phase") == "diastole") & F.col("valid")).select("patient_id", *KEY, "quantity").orderBy("patient_id", *KEY)


@query("phase_fanout", "SELECT recording_id, cycle_index, unnest(CASE WHEN murmur_label = 'Present' THEN (CASE WHEN tax > 0.04 AND discount > 0.05 THEN ['systole','diastole'] WHEN discount > 0.05 THEN ['diastole'] ELSE ['systole'] END) ELSE ['systole','diastole'] END) AS target_phase FROM candidates")
def _(t):
    both = F.array(F.lit("systole"), F.lit("diastole"))
    s, d = F.when(F.col("tax") > 0.04, "t"), F.when(F.col("discount") > 0.05, "t")
    labelled = F.array_compact(F.array(F.when(s.isNotNull(), "systole"), F.when(d.isNotNull(), "diastole")))
    present = F.when(F.size(labelled) == 0, F.array(F.lit("systole"))).otherwise(labelled)
    return t.candidates.select(*KEY, F.explode(F.when(F.col("murmur_label") == "Present", present).otherwise(both)).alias("target_phase"))
