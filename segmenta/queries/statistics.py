"""Statistics over candidates: ranks, bootstraps, contrasts, models and redundancy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from segmenta.operators import orderstats as O
from segmenta.operators import relational as R
from segmenta.operators import stats as T
from segmenta.plans.registry import query, r6

FEATURES = ("quantity", "price", "discount", "tax")
RANK = "rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0::double"


def rank_sql(p, x):
    return RANK.format(p=p, x=x)


@query("spearman_rho", f"SELECT location, count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT location, {rank_sql('location', 'quantity')} AS a, {rank_sql('location', 'price')} AS b FROM candidates) GROUP BY 1")
def _(t):
    return T.spearman(t.candidates, ["location"], "quantity", "price").select("location", "n", r6("rho").alias("rho"))


MATRIX = " UNION ALL ".join(f"SELECT murmur_phase, '{a}' AS feature_a, '{b}' AS feature_b, round(corr(x, y), 6) AS rho FROM (SELECT murmur_phase, {rank_sql('murmur_phase', a)} AS x, {rank_sql('murmur_phase', b)} AS y FROM candidates) GROUP BY 1" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])


def matrix(t):
    """Ranks of every feature once, then all correlations in one aggregation."""
    x = O.average_ranks(t.candidates.select("murmur_phase", *FEATURES), ["murmur_phase"], {f: f"r_{f}" for f in FEATURES})
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
    g = x.groupBy("murmur_phase").agg(*[F.corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    return g.unpivot(["murmur_phase"], [f"{a}|{b}" for a, b in pairs], "pair", "rho").select("murmur_phase", F.split("pair", "[|]")[0].alias("feature_a"), F.split("pair", "[|]")[1].alias("feature_b"), "rho")


@query("spearman_matrix", MATRIX)
def _(t):
    return matrix(t).withColumn("rho", r6("rho"))


CLUSTERS = "c AS (SELECT patient_id % 25 AS idx, count(*) AS n, sum(discount) AS sx, sum(quantity) AS sy, sum(discount * discount) AS sxx, sum(quantity * quantity) AS syy, sum(discount * quantity) AS sxy, count(*) FILTER (valid) AS ok FROM candidates GROUP BY 1)"
DRAWS = "d AS (SELECT rep, ('0x' || substr(md5('11|' || rep || '|' || k), 1, 8))::bigint % 25 AS idx FROM (SELECT unnest(range(0, 100)) AS rep), (SELECT unnest(range(0, 25)) AS k))"


def cluster_sums(t):
    x, y = F.col("discount"), F.col("quantity")
    return t.candidates.groupBy((F.col("patient_id") % 25).alias("idx")).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.count_if("valid").alias("ok"))


def replicated(t):
    """Weighted sums of each replicate; what is resampled are 25 sums, never rows."""
    c = cluster_sums(t)
    d = T.draws(t.spark.range(1).select(F.lit(25).cast("long").alias("n")), 100, 11)
    w = d.join(c, "idx")
    return w.groupBy("rep").agg(*[F.sum(F.col(k) * F.col("weight")).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy", "ok")])


@query("cluster_bootstrap_ci", f"WITH {CLUSTERS}, {DRAWS}, r AS (SELECT rep, sum(sx) / sum(n) AS m FROM d JOIN c USING (idx) GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(1 - count(m) / count(*)::double, 6) AS failure_rate FROM r")
def _(t):
    return T.interval(replicated(t).select((F.col("sx") / F.col("n")).alias("m")), [], "m")


@query("bootstrap_sufficient_corr", f"WITH {CLUSTERS}, {DRAWS}, r AS (SELECT rep, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM d JOIN c USING (idx) GROUP BY 1) SELECT rep, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 5) AS r FROM r")
def _(t):
    return replicated(t).select("rep", F.round(T.corr_from_sums(*[F.col(k).cast("double") for k in ("n", "sx", "sy", "sxx", "syy", "sxy")]), 5).alias("r"))


@query("coverage_bootstrap", f"WITH {CLUSTERS}, {DRAWS}, r AS (SELECT rep, sum(ok) / sum(n)::double AS m FROM d JOIN c USING (idx) GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(1 - count(m) / count(*)::double, 6) AS failure_rate FROM r")
def _(t):
    return T.interval(replicated(t).select((F.col("ok") / F.col("n")).alias("m")), [], "m")


@query("status_contrast", """SELECT murmur_phase, round(median(price) FILTER (status = 'accepted') - median(price) FILTER (status = 'fallback'), 4) AS difference, count(DISTINCT patient_id) FILTER (status = 'accepted') AS n_accepted, count(DISTINCT patient_id) FILTER (status = 'fallback') AS n_fallback FROM candidates WHERE status <> 'no_candidate' GROUP BY 1""")
def _(t):
    a, b = F.col("status") == "accepted", F.col("status") == "fallback"
    x = t.candidates.filter(a | b)
    g = x.groupBy("murmur_phase").agg(F.count_distinct(F.when(a, F.col("patient_id"))).alias("n_accepted"), F.count_distinct(F.when(b, F.col("patient_id"))).alias("n_fallback"))
    g = O.with_percentiles(g, x, ["murmur_phase"], {"a": F.when(a, F.col("price")), "b": F.when(b, F.col("price"))}, [0.5])
    return g.select("murmur_phase", r6(F.col("a")[0] - F.col("b")[0], 4).alias("difference"), "n_accepted", "n_fallback")


@query("mann_whitney_u", f"SELECT location, count(*) FILTER (valid) AS n1, count(*) FILTER (NOT valid) AS n2, round(sum(r) FILTER (valid) - count(*) FILTER (valid) * (count(*) FILTER (valid) + 1) / 2.0::double, 2) AS u FROM (SELECT location, valid, {rank_sql('location', 'quantity')} AS r FROM candidates) GROUP BY 1")
def _(t):
    return T.mann_whitney(t.candidates, ["location"], F.col("valid"), "quantity").select("location", "n1", "n2", F.round("u", 2).alias("u"))


@query("mann_whitney_p")
def _(t):
    return T.mann_whitney(t.candidates, ["location"], F.col("valid"), "quantity")


@query("kruskal_wallis", f"""WITH r AS (SELECT location, status, quantity, {rank_sql('location', 'quantity')} AS r FROM candidates), ti AS (SELECT location, sum(c::double * c * c - c) AS ties FROM (SELECT location, quantity, count(*) AS c FROM candidates GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT location, sum(m)::double AS n, count(*) AS k, sum(s * s / m) AS q FROM (SELECT location, status, count(*) AS m, sum(r) AS s FROM r GROUP BY 1, 2) GROUP BY 1), h AS (SELECT location, n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM g JOIN ti USING (location))
    SELECT location, round(h, 4) AS h, round(exp(-h / 2), 5) AS p, round(greatest(0.0::double, (h - k + 1) / (n - k)), 6) AS epsilon_squared FROM h""")
def _(t):
    return T.kruskal(t.candidates, ["location"], "status", "quantity").select("location", F.round("h", 4).alias("h"), F.round(F.exp(-F.col("h") / 2), 5).alias("p"), r6("epsilon_squared").alias("epsilon_squared"))


LEVEL = "substr(timing_label, 1, 1)::int"


@query("ordered_trend", f"SELECT location, round(corr(a, b), 6) AS rho FROM (SELECT location, {rank_sql('location', 'lvl')} AS a, {rank_sql('location', 'price')} AS b FROM (SELECT *, {LEVEL} AS lvl FROM candidates)) GROUP BY 1")
def _(t):
    x = t.candidates.withColumn("lvl", F.substring("timing_label", 1, 1).cast("int"))
    return T.spearman(x, ["location"], "lvl", "price").select("location", r6("rho").alias("rho"))


@query("planned_contrasts", f"""SELECT 'all_valid' AS stratum, 'trend' AS contrast, round(corr(a, b), 6) AS estimate FROM (SELECT {rank_sql('1', 'lvl')} AS a, {rank_sql('1', 'price')} AS b FROM (SELECT *, {LEVEL} AS lvl FROM candidates WHERE valid))
    UNION ALL SELECT 'accepted_only', 'trend', round(corr(a, b), 6) FROM (SELECT {rank_sql('1', 'lvl')} AS a, {rank_sql('1', 'price')} AS b FROM (SELECT *, {LEVEL} AS lvl FROM candidates WHERE valid AND status = 'accepted'))
    UNION ALL SELECT 'all_valid', 'difference', round(median(price) FILTER (location = 'BUILDING') - median(price) FILTER (location = 'MACHINERY'), 4) FROM candidates WHERE valid""")
def _(t):
    x = t.candidates.filter("valid").withColumn("lvl", F.substring("timing_label", 1, 1).cast("int"))
    trend = lambda d, s: T.spearman(d, [], "lvl", "price").select(F.lit(s).alias("stratum"), F.lit("trend").alias("contrast"), r6("rho").alias("estimate"))
    m = O.percentiles(x, [], {k: F.when(F.col("location") == k, F.col("price")) for k in ("BUILDING", "MACHINERY")}, [0.5])
    diff = m.select(r6(F.col("BUILDING")[0] - F.col("MACHINERY")[0], 4).alias("estimate")).select(F.lit("all_valid").alias("stratum"), F.lit("difference").alias("contrast"), "estimate")
    return trend(x, "all_valid").unionByName(trend(x.filter("status = 'accepted'"), "accepted_only")).unionByName(diff)


@query("pairwise_contrast", """WITH x AS (SELECT * FROM candidates WHERE location IN ('BUILDING', 'MACHINERY') AND tax > 0.06), g AS (SELECT count(*) FILTER (location = 'BUILDING') AS n_left, count(*) FILTER (location = 'MACHINERY') AS n_right, median(price) FILTER (location = 'BUILDING') - median(price) FILTER (location = 'MACHINERY') AS d FROM x),
    p AS (SELECT sum(sign(a.price - b.price))::double / count(*) AS delta FROM x a, x b WHERE a.location = 'BUILDING' AND b.location = 'MACHINERY') SELECT n_left, n_right, round(d, 4) AS difference, round(delta, 6) AS delta FROM g, p""")
def _(t):
    x = t.candidates.filter("location in ('BUILDING', 'MACHINERY') and tax > 0.06").withColumn("one", F.lit(1))
    left = F.col("location") == "BUILDING"
    g = x.groupBy("one").agg(F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"))
    g = O.with_percentiles(g, x, ["one"], {"a": F.when(left, F.col("price")), "b": F.when(~left, F.col("price"))}, [0.5])
    return g.join(R.cliffs_delta(x, ["one"], left, "price"), "one").select("n_left", "n_right", r6(F.col("a")[0] - F.col("b")[0], 4).alias("difference"), r6("delta").alias("delta"))


@query("qa_associations", " UNION ALL ".join(f"SELECT '{q}' AS qa, '{f}' AS feature, round(corr(a, b), 6) AS rho FROM (SELECT {rank_sql('1', q)} AS a, {rank_sql('1', f)} AS b FROM candidates)" for q in ("discount", "tax") for f in ("quantity", "price")))
def _(t):
    x = O.average_ranks(t.candidates.select(*FEATURES), [], {f: f"r_{f}" for f in FEATURES})
    pairs = [(q, f) for q in ("discount", "tax") for f in ("quantity", "price")]
    g = x.agg(*[F.corr(f"r_{q}", f"r_{f}").alias(f"{q}|{f}") for q, f in pairs])
    return g.unpivot([], [f"{q}|{f}" for q, f in pairs], "pair", "rho").select(F.split("pair", "[|]")[0].alias("qa"), F.split("pair", "[|]")[1].alias("feature"), r6("rho").alias("rho"))


@query("ols_cluster_se", """WITH b AS (SELECT location, regr_slope(price, quantity) AS slope, regr_intercept(price, quantity) AS intercept, avg(quantity) AS mx, count(*)::double AS n, sum(quantity * quantity) - count(*) * avg(quantity) * avg(quantity) AS sxx FROM candidates GROUP BY 1),
    u AS (SELECT c.location, patient_id % 25 AS g, sum((price - intercept - slope * quantity) * (quantity - mx)) AS s FROM candidates c JOIN b USING (location) GROUP BY 1, 2), k AS (SELECT location, count(*)::double AS k, sum(s * s) AS m FROM u GROUP BY 1)
    SELECT location, round(slope, 4) AS slope, round(sqrt(k / (k - 1) * (n - 1) / (n - 2) * m) / sxx, 4) AS se FROM b JOIN k USING (location)""")
def _(t):
    c = t.candidates.select("location", "price", "quantity", (F.col("patient_id") % 25).alias("g"))
    x, y = F.col("quantity"), F.col("price")
    b = c.groupBy("location").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("mx"), F.count("*").cast("double").alias("n"), (F.sum(x * x) - F.count("*") * F.avg(x) * F.avg(x)).alias("sxx"))
    score = (y - F.col("intercept") - F.col("slope") * x) * (x - F.col("mx"))
    k = c.join(b, "location").groupBy("location", "g").agg(F.sum(score).alias("s")).groupBy("location").agg(F.count("*").cast("double").alias("k"), F.sum(F.col("s") * F.col("s")).alias("m"))
    n, kk = F.col("n"), F.col("k")
    return b.join(k, "location").select("location", F.round("slope", 4).alias("slope"), F.round(F.sqrt(kk / (kk - 1) * (n - 1) / (n - 2) * F.col("m")) / F.col("sxx"), 4).alias("se"))


def _ols(pdf: pd.DataFrame) -> pd.DataFrame:
    """Solve the normal equations from sums; one small matrix for each group."""
    r = pdf.iloc[0]
    a = np.array([[r.n, r.sx, r.sy], [r.sx, r.sxx, r.sxy], [r.sy, r.sxy, r.syy]])
    beta = np.linalg.lstsq(a, np.array([r.sz, r.sxz, r.syz]), rcond=None)[0]
    return pd.DataFrame({"location": [r.location], "intercept": [beta[0]], "b_quantity": [beta[1]], "b_tax": [beta[2]]})


@query("ols_two_covariates")
def _(t):
    x, y, z = F.col("quantity"), F.col("tax"), F.col("discount")
    sums = t.candidates.groupBy("location").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y), ("sz", z), ("sxz", x * z), ("syz", y * z))])
    return sums.groupBy("location").applyInPandas(_ols, "location string, intercept double, b_quantity double, b_tax double")


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    m = np.eye(len(FEATURES))
    for r in pdf.itertuples():
        i, j = FEATURES.index(r.feature_a), FEATURES.index(r.feature_b)
        m[i, j] = m[j, i] = r.rho
    out = [(pdf.murmur_phase.iloc[0], q, f, c) for q in (0.85, 0.90, 0.95) for f, c in T.complete_linkage(list(FEATURES), m, q).items()]
    return pd.DataFrame(out, columns=["murmur_phase", "threshold", "feature", "cluster"])


@query("linkage_clusters")
def _(t):
    return matrix(t).groupBy("murmur_phase").applyInPandas(_linked, "murmur_phase string, threshold double, feature string, cluster int")


@query("vif_two_feature", "SELECT location, round(1 / (1 - pow(corr(quantity, price), 2)), 5) AS vif, round(sqrt((1 + abs(corr(quantity, price))) / (1 - abs(corr(quantity, price)))), 5) AS condition_index FROM candidates WHERE valid GROUP BY 1")
def _(t):
    r = t.candidates.filter("valid").groupBy("location").agg(F.corr("quantity", "price").alias("r"))
    return r.select("location", F.round(1 / (1 - F.col("r") * F.col("r")), 5).alias("vif"), F.round(F.sqrt((1 + F.abs("r")) / (1 - F.abs("r"))), 5).alias("condition_index"))


@query("decision_log", """WITH reg AS (SELECT * FROM (VALUES ('quantity', 'retain_core'), ('price', 'retain_exploratory'), ('discount', 'drop_unstable'), ('tax', 'drop_redundant')) AS r(feature, decision)), cov AS (SELECT feature, count(*) FILTER (value > 0) / count(*)::double AS coverage, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM features_long WHERE murmur_phase = 'systole' GROUP BY 1)
    SELECT feature, decision, round(coverage, 6) AS coverage, round(iqr, 4) AS iqr, decision IN ('retain_core', 'retain_exploratory') AS eligible FROM reg JOIN cov USING (feature)""")
def _(t):
    reg = t.spark.createDataFrame([("quantity", "retain_core"), ("price", "retain_exploratory"), ("discount", "drop_unstable"), ("tax", "drop_redundant")], "feature string, decision string")
    x = t.features_long.filter("murmur_phase = 'systole'")
    cov = O.with_percentiles(x.groupBy("feature").agg((F.count_if(F.col("value") > 0) / F.count("*")).alias("coverage")), x, ["feature"], {"p": F.col("value")}, [0.25, 0.75])
    return cov.join(F.broadcast(reg), "feature").select("feature", "decision", r6("coverage").alias("coverage"), r6(F.col("p")[1] - F.col("p")[0], 4).alias("iqr"), F.col("decision").isin("retain_core", "retain_exploratory").alias("eligible"))

