"""Array operators that SQL can express."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.functions import arrays as A
from segmenta.plans.registry import PHASES, query, r6

E = "(SELECT vec_id, phase, sum(v * v) AS e, count(*) AS k, max(abs(v)) AS peak FROM samples JOIN phases ON n >= p_start AND n < p_end GROUP BY 1, 2)"
P = ("s1", "systole", "s2", "diastole")
WIDE = f"(SELECT vec_id, " + ", ".join(f"sum(e) FILTER (phase = '{p}') AS e_{p}, sum(e / k) FILTER (phase = '{p}') AS d_{p}" for p in P) + f", sum(e) AS e FROM {E} GROUP BY 1)"
EPS = 1e-12


def phase_energies(t):
    s = F.col("signal")
    x = t.segments.withColumns({f"e_{p}": A.energy(A.phase(s, PHASES[p])) for p in P})
    x = x.withColumns({f"d_{p}": F.col(f"e_{p}") / (PHASES[p][1] - PHASES[p][0]) for p in P})
    return x.withColumn("e", sum((F.col(f"e_{p}") for p in P[1:]), F.col("e_s1")))


@query("phase_energy", f"""SELECT vec_id, phase, round(e / (total + 1e-12), 6) AS fraction, round(e / k, 6) AS density, round((e / k) / (dens + 1e-12), 6) AS focus, round((e / k) / (ref + 1e-12), 6) AS ratio FROM
    (SELECT *, sum(e) OVER w AS total, sum(e / k) OVER w AS dens, sum(CASE WHEN phase IN ('s1', 's2') THEN e / k ELSE 0.0::double END) OVER w AS ref FROM {E} WINDOW w AS (PARTITION BY vec_id))""")
def _(t):
    x = phase_energies(t)
    dens = sum((F.col(f"d_{p}") for p in P[1:]), F.col("d_s1"))
    rows = F.array(*[F.struct(F.lit(p).alias("phase"), r6(F.col(f"e_{p}") / (F.col("e") + EPS)).alias("fraction"), r6(F.col(f"d_{p}")).alias("density"), r6(F.col(f"d_{p}") / (dens + EPS)).alias("focus"), r6(F.col(f"d_{p}") / (F.col("d_s1") + F.col("d_s2") + EPS)).alias("ratio")) for p in P])
    return x.select("vec_id", F.inline(rows))


@query("amplitude_features", "SELECT vec_id, round(sum(v * v), 6) AS energy, round(sqrt(avg(v * v)), 6) AS rms, round(max(abs(v)), 6) AS peak, round(avg(abs(v)), 6) AS mean_abs, round(max(abs(v)) / (sqrt(avg(v * v)) + 1e-12), 6) AS crest FROM samples GROUP BY 1")
def _(t):
    s = F.col("signal")
    x = t.segments.select("vec_id", A.energy(s).alias("e"), A.rms(s).alias("r"), F.transform(s, lambda v: F.abs(v)).alias("a"))
    return x.select("vec_id", r6("e").alias("energy"), r6("r").alias("rms"), r6(F.array_max("a")).alias("peak"), r6(A.mean(F.col("a"))).alias("mean_abs"), r6(F.array_max("a") / (F.col("r") + EPS)).alias("crest"))


@query("kurtosis_score", "SELECT vec_id, round(kurtosis_pop(v), 5) AS kurtosis FROM samples GROUP BY 1")
def _(t):
    x = t.segments.select("vec_id", A.centered(F.col("signal")).alias("c"))
    m2, m4 = A.energy(F.col("c")) / F.size("c"), A.total(F.transform("c", lambda v: v * v * v * v)) / F.size("c")
    return x.select("vec_id", m2.alias("m2"), m4.alias("m4")).select("vec_id", F.round(F.when(F.col("m2") > 1e-24, F.col("m4") / (F.col("m2") * F.col("m2")) - 3).otherwise(0.0), 5).alias("kurtosis"))


@query("reconstruction_error", "SELECT vec_id, round(sqrt(sum((v - w) * (v - w))) / (sqrt(sum(v * v)) + 1e-12), 6) AS err FROM (SELECT vec_id, v, round(v, 1) AS w FROM samples) GROUP BY 1")
def _(t):
    x = t.segments.select("vec_id", "signal", F.transform("signal", lambda v: F.round(v, 1)).alias("w"))
    d = F.zip_with("signal", "w", lambda a, b: a - b)
    return x.select("vec_id", r6(F.sqrt(A.energy(d)) / (F.sqrt(A.energy(F.col("signal"))) + EPS)).alias("err"))


@query("hankel_energy", "SELECT vec_id, round(sum(v * v * least(n + 1, 16, 64 - n)), 6) AS energy FROM samples GROUP BY 1")
def _(t):
    """Energy of the trajectory matrix, from the embedding itself: all lagged windows of 16 samples."""
    windows = F.transform(F.sequence(F.lit(1), F.lit(49)), lambda i: F.slice("signal", i, 16))
    return t.segments.select("vec_id", r6(A.total(F.transform(windows, lambda w: A.energy(w)))).alias("energy"))


@query("phase_leakage", f"SELECT vec_id, round(e_s1 / (e + 1e-12), 6) AS s1_leak, round(e_s2 / (e + 1e-12), 6) AS s2_leak, round(e_systole / (e_systole + e_diastole + 1e-12), 6) AS retention, round((e - e_systole) / (e + 1e-12), 6) AS outside FROM {WIDE}")
def _(t):
    e = F.col
    return phase_energies(t).select("vec_id", r6(e("e_s1") / (e("e") + EPS)).alias("s1_leak"), r6(e("e_s2") / (e("e") + EPS)).alias("s2_leak"), r6(e("e_systole") / (e("e_systole") + e("e_diastole") + EPS)).alias("retention"), r6((e("e") - e("e_systole")) / (e("e") + EPS)).alias("outside"))


@query("noise_rule", f"SELECT vec_id FROM {WIDE} WHERE e_s1 / (e + 1e-12) < 0.05 OR e_diastole / (e + 1e-12) >= 0.45")
def _(t):
    return phase_energies(t).filter((F.col("e_s1") / (F.col("e") + EPS) < 0.05) | (F.col("e_diastole") / (F.col("e") + EPS) >= 0.45)).select("vec_id")


@query("zcr_split", "SELECT vec_id, z <= quantile_cont(z, 0.4) OVER (PARTITION BY label) AS normal FROM (SELECT vec_id, label, round(avg(c), 6) AS z FROM (SELECT vec_id, label, ((v < 0) <> (lag(v) OVER (PARTITION BY vec_id ORDER BY n) < 0))::int::double AS c FROM samples) GROUP BY 1, 2)")
def _(t):
    s = F.col("signal")
    z = t.segments.select("vec_id", "label", r6(A.total(F.zip_with(F.slice(s, 1, 63), F.slice(s, 2, 63), lambda a, b: ((a < 0) != (b < 0)).cast("double"))) / 63).alias("z"))
    cut = z.groupBy("label").agg(F.percentile("z", 0.4).alias("cut"))
    return z.join(cut, "label").select("vec_id", (F.col("z") <= F.col("cut")).alias("normal"))


@query("phase_aware_selection", f"""WITH f AS (SELECT vec_id, round(d_systole / (d_s1 + d_systole + d_s2 + d_diastole + 1e-12), 9) AS focus, round(d_systole / (d_s1 + d_s2 + 1e-12), 9) AS ratio, e FROM {WIDE}), g AS (SELECT f.*, vec_id // 5 AS grp FROM f)
    SELECT vec_id, grp, ok FROM (SELECT *, focus >= 0.26 AND ratio >= 0.5 AS ok, bool_or(focus >= 0.26 AND ratio >= 0.5) OVER (PARTITION BY grp) AS any_ok, row_number() OVER (PARTITION BY grp ORDER BY focus DESC, ratio DESC, vec_id) AS rn FROM g) WHERE ok OR (NOT any_ok AND rn = 1)""")
def _(t):
    d = {p: F.col(f"d_{p}") for p in P}
    f = phase_energies(t).select("vec_id", F.round(d["systole"] / (d["s1"] + d["systole"] + d["s2"] + d["diastole"] + EPS), 9).alias("focus"), F.round(d["systole"] / (d["s1"] + d["s2"] + EPS), 9).alias("ratio"), F.expr("vec_id div 5").alias("grp"))
    w = W.partitionBy("grp")
    x = f.withColumn("ok", (F.col("focus") >= 0.26) & (F.col("ratio") >= 0.5)).withColumns({"any_ok": F.bool_or("ok").over(w), "rn": F.row_number().over(w.orderBy(F.desc("focus"), F.desc("ratio"), "vec_id"))})
    return x.filter("ok or (not any_ok and rn = 1)").select("vec_id", "grp", "ok")


@query("component_sum", "SELECT grp, n, round(sum(v), 6) AS v FROM (SELECT vec_id // 5 AS grp, n, v FROM samples WHERE vec_id % 5 IN (0, 2)) GROUP BY 1, 2")
def _(t):
    x = t.samples.filter("vec_id % 5 in (0, 2)").groupBy(F.expr("vec_id div 5").alias("grp"), "n").agg(r6(F.sum("v")).alias("v"))
    return x


@query("centered_rms", "SELECT vec_id, round(sqrt(var_pop(v)), 6) AS rms FROM samples GROUP BY 1")
def _(t):
    return t.segments.select("vec_id", A.centered(F.col("signal")).alias("c")).select("vec_id", r6(A.rms(F.col("c"))).alias("rms"))


@query("reference_slices", "SELECT vec_id, phase, round(sum(v), 6) AS total, count(*) AS n FROM samples JOIN phases ON n >= p_start AND n < p_end WHERE phase IN ('s1', 's2') GROUP BY 1, 2")
def _(t):
    rows = F.array(*[F.struct(F.lit(p).alias("phase"), r6(A.total(A.phase(F.col("signal"), PHASES[p]))).alias("total"), F.lit(PHASES[p][1] - PHASES[p][0]).cast("long").alias("n")) for p in ("s1", "s2")])
    return t.segments.select("vec_id", F.inline(rows))


@query("systolic_segments", "SELECT vec_id, count(*) AS n, round(sum(v), 6) AS total FROM samples WHERE n >= 10 AND n < 32 GROUP BY 1 HAVING count(*) >= 20")
def _(t):
    s = A.phase(F.col("signal"), PHASES["systole"])
    return t.segments.select("vec_id", F.size(s).cast("long").alias("n"), r6(A.total(s)).alias("total")).filter("n >= 20")


@query("frame_signal", "SELECT vec_id, 48::bigint AS n, round(sum(v) FILTER (n >= 8 AND n < 56), 6) AS cropped, round(sum(v * n), 4) AS padded_moment FROM samples GROUP BY 1")
def _(t):
    """Center crop to 48 samples, and right zero-padding to 100: the pad adds nothing to a moment."""
    padded = F.concat("signal", F.array_repeat(F.lit(0.0), 36))
    moment = F.aggregate(F.transform(padded, lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x)
    return t.segments.select("vec_id", F.size(F.slice("signal", 9, 48)).cast("long").alias("n"), r6(A.total(F.slice("signal", 9, 48))).alias("cropped"), F.round(moment, 4).alias("padded_moment"))


@query("array_primitives", "SELECT vec_id, round(sum(v) FILTER (n < 5), 6) AS head, round(sum(d * d), 6) AS diff_energy, round(max(cum), 6) AS top_cum FROM (SELECT vec_id, n, v, v - lag(v) OVER w AS d, sum(v) OVER w AS cum FROM samples WINDOW w AS (PARTITION BY vec_id ORDER BY n)) GROUP BY 1")
def _(t):
    s = F.col("signal")
    d = F.zip_with(F.slice(s, 2, 63), F.slice(s, 1, 63), lambda a, b: a - b)
    top = F.aggregate(s, F.struct(F.lit(0.0).alias("c"), F.lit(-1e300).alias("m")), lambda a, x: F.struct((a.c + x).alias("c"), F.greatest(a.m, a.c + x).alias("m")), lambda a: a.m)
    return t.segments.select("vec_id", r6(A.total(F.slice(s, 1, 5))).alias("head"), r6(A.energy(d)).alias("diff_energy"), r6(top).alias("top_cum"))


@query("safe_correlation", "SELECT label, round(coalesce(corr(a, b), 0.0::double), 6) AS r FROM (SELECT label, vec_id, max(v) FILTER (n = 3) AS a, max(v) FILTER (n = 7) AS b FROM samples GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return t.segments.select("label", F.get("signal", F.lit(3)).alias("a"), F.get("signal", F.lit(7)).alias("b")).groupBy("label").agg(r6(F.coalesce(F.corr("a", "b"), F.lit(0.0))).alias("r"))


PAIR = "(SELECT a.vec_id, a.n, a.v AS r, round(a.v, 1) AS e FROM samples a)"


def pair(t):
    return t.segments.select("vec_id", F.col("signal").alias("r"), F.transform("signal", lambda v: F.round(v, 1)).alias("e"))


@query("si_sdr", f"WITH x AS (SELECT vec_id, sum(e * r) / (sum(r * r) + 1e-12) AS s FROM {PAIR} GROUP BY 1) SELECT vec_id, round(10 * log10((sum(s * r * s * r) + 1e-12) / (sum((e - s * r) * (e - s * r)) + 1e-12)), 5) AS si_sdr FROM {PAIR} JOIN x USING (vec_id) GROUP BY 1")
def _(t):
    er, rr, ee = A.dot(F.col("e"), F.col("r")), A.energy(F.col("r")), A.energy(F.col("e"))
    x = pair(t).select("vec_id", "r", "e", (er / (rr + EPS)).alias("s"))
    target = F.transform("r", lambda v: v * F.col("s"))
    return x.select("vec_id", "e", target.alias("t")).select("vec_id", F.round(10 * F.log10((A.energy(F.col("t")) + EPS) / (A.energy(F.zip_with("e", "t", lambda a, b: a - b)) + EPS)), 5).alias("si_sdr"))


@query("sdr", f"SELECT vec_id, round(10 * log10((sum(r * r) + 1e-12) / (sum((r - e) * (r - e)) + 1e-12)), 5) AS sdr FROM {PAIR} GROUP BY 1")
def _(t):
    return pair(t).select("vec_id", F.round(10 * F.log10((A.energy(F.col("r")) + EPS) / (A.energy(F.zip_with("r", "e", lambda a, b: a - b)) + EPS)), 5).alias("sdr"))


@query("projection_leakage", f"SELECT vec_id, round(abs(sum(r * e)) / (sqrt(sum(r * r) * sum(e * e)) + 1e-12), 6) AS leak FROM {PAIR} GROUP BY 1")
def _(t):
    return pair(t).select("vec_id", r6(F.abs(A.dot(F.col("r"), F.col("e"))) / (F.sqrt(A.energy(F.col("r")) * A.energy(F.col("e"))) + EPS)).alias("leak"))


@query("theil_sen_slope", "SELECT a.vec_id, round(median((b.v - a.v) / (b.n - a.n)), 6) AS slope FROM samples a JOIN samples b ON a.vec_id = b.vec_id AND a.n < b.n WHERE a.n < 24 AND b.n < 24 GROUP BY 1")
def _(t):
    from segmenta.operators.dsp import theil_sen_column

    return t.segments.select("vec_id", r6(theil_sen_column(F.slice("signal", 1, 24))).alias("slope"))


DFT = "(SELECT vec_id, k, pow(sum(v * cos(2 * pi() * k * n / 64)), 2) + pow(sum(v * sin(2 * pi() * k * n / 64)), 2) AS p FROM samples, (SELECT unnest(range(0, 33)) AS k) GROUP BY 1, 2)"


@query("spectral_features", f"""WITH d AS (SELECT vec_id, k * 62.5::double AS f, p, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-12) AS w FROM {DFT}), c AS (SELECT vec_id, sum(f * w) AS centroid FROM d GROUP BY 1)
    SELECT vec_id, round(any_value(centroid), 4) AS centroid, round(sqrt(sum(w * pow(f - centroid, 2))), 4) AS bandwidth, round(-sum(CASE WHEN w > 0 THEN w * log2(w) ELSE 0 END) / log2(33), 6) AS entropy FROM d JOIN c USING (vec_id) GROUP BY 1""")
def _(t):
    from segmenta.operators.dsp import spectral_column

    return t.segments.select("vec_id", spectral_column("signal").alias("s")).select("vec_id", F.round("s.centroid", 4).alias("centroid"), F.round("s.bandwidth", 4).alias("bandwidth"), r6("s.entropy").alias("entropy"))


@query("band_ratios", f"SELECT vec_id, round(sum(p) FILTER (f < 100) / (sum(p) + 1e-12), 6) AS low, round(sum(p) FILTER (f >= 200 AND f < 400) / (sum(p) + 1e-12), 6) AS mid, round(sum(p) FILTER (f >= 1000) / (sum(p) + 1e-12), 6) AS high FROM (SELECT *, k * 62.5::double AS f FROM {DFT}) GROUP BY 1")
def _(t):
    p = t.segments.select("vec_id", A.power_spectrum(F.col("signal"), 64).alias("p"))
    whole = A.total(F.col("p")) + EPS
    part = lambda lo, hi: A.total(F.slice("p", lo + 1, hi - lo)) / whole
    return p.select("vec_id", r6(part(0, 2)).alias("low"), r6(part(4, 7)).alias("mid"), r6(part(16, 33)).alias("high"))


@query("spectral_distance", f"WITH a AS {DFT}, b AS (SELECT vec_id, k, pow(sum(round(v, 1) * cos(2 * pi() * k * n / 64)), 2) + pow(sum(round(v, 1) * sin(2 * pi() * k * n / 64)), 2) AS p FROM samples, (SELECT unnest(range(0, 33)) AS k) GROUP BY 1, 2) SELECT vec_id, round(sqrt(avg(pow(ln(1 + sqrt(a.p)) - ln(1 + sqrt(b.p)), 2))), 5) AS distance FROM a JOIN b USING (vec_id, k) GROUP BY 1")
def _(t):
    x = pair(t).select("vec_id", A.power_spectrum(F.col("r"), 64).alias("p"), A.power_spectrum(F.col("e"), 64).alias("q"))
    d = F.zip_with("p", "q", lambda a, b: F.pow(F.log1p(F.sqrt(a)) - F.log1p(F.sqrt(b)), F.lit(2.0)))
    return x.select("vec_id", F.round(F.sqrt(A.mean(d)), 5).alias("distance"))


HANN = "(0.5 - 0.5 * cos(2 * pi() * n / 64))"


@query("welch_psd", f"""WITH c AS (SELECT vec_id, n, (v - avg(v) OVER (PARTITION BY vec_id)) * {HANN} AS v FROM samples), d AS (SELECT vec_id, k, pow(sum(v * cos(2 * pi() * k * n / 64)), 2) + pow(sum(v * sin(2 * pi() * k * n / 64)), 2) AS p FROM c, (SELECT unnest(range(0, 33)) AS k) GROUP BY 1, 2)
    SELECT vec_id, k::int AS bin, round(1e6 * p * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / (4000 * 24.0), 5)::double AS density FROM d""")
def _(t):
    from segmenta.operators.dsp import welch_column

    return t.segments.select("vec_id", F.posexplode(welch_column("signal")).alias("bin", "d")).select("vec_id", "bin", F.round(1e6 * F.col("d"), 5).alias("density"))


@query("hilbert_envelope", """WITH d AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * n / 64)) AS re, -sum(v * sin(2 * pi() * k * n / 64)) AS im FROM samples, (SELECT unnest(range(0, 33)) AS k) GROUP BY 1, 2),
    h AS (SELECT vec_id, m, sum(w * (re * cos(2 * pi() * k * m / 64) - im * sin(2 * pi() * k * m / 64))) / 64 AS a, sum(w * (re * sin(2 * pi() * k * m / 64) + im * cos(2 * pi() * k * m / 64))) / 64 AS b FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS w FROM d), (SELECT unnest(range(0, 64)) AS m) GROUP BY 1, 2)
    SELECT vec_id, round(sum(sqrt(a * a + b * b)), 5) AS total, round(max(sqrt(a * a + b * b)), 5) AS peak FROM h GROUP BY 1""")
def _(t):
    from segmenta.operators.dsp import envelope_column

    return t.segments.select("vec_id", envelope_column("signal", smooth=False).alias("e")).select("vec_id", F.round(A.total(F.col("e")), 5).alias("total"), F.round(F.array_max("e"), 5).alias("peak"))


@query("ridge_morphology", """WITH r AS (SELECT vec_id, regr_slope(v, n) AS slope, avg((abs(v - p) <= 0.2)::int::double) AS continuity FROM (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY n) AS p FROM samples) GROUP BY 1)
    SELECT vec_id, round(slope, 7) AS slope, CASE WHEN slope * 63 > 0.05 THEN 'rising' WHEN slope * 63 < -0.05 THEN 'falling' ELSE 'stable' END AS direction, round(continuity, 6) AS continuity FROM r""")
def _(t):
    s = F.col("signal")
    moment = A.total(F.transform(s, lambda v, i: v * (i - 31.5)))
    slope = moment / F.lit(sum((i - 31.5) ** 2 for i in range(64)))
    jumps = F.zip_with(F.slice(s, 2, 63), F.slice(s, 1, 63), lambda a, b: (F.abs(a - b) <= 0.2).cast("double"))
    x = t.segments.select("vec_id", slope.alias("slope"), A.mean(jumps).alias("continuity"))
    d = F.col("slope") * 63
    return x.select("vec_id", F.round("slope", 7).alias("slope"), F.when(d > 0.05, "rising").when(d < -0.05, "falling").otherwise("stable").alias("direction"), r6("continuity").alias("continuity"))


@query("activity_energy_fallback", "WITH c AS (SELECT vec_id, n, round(sum(v * v) OVER (PARTITION BY vec_id ORDER BY n) / sum(v * v) OVER (PARTITION BY vec_id), 9) AS cum FROM samples) SELECT vec_id, (count(*) FILTER (cum < 0.05))::bigint AS onset, least(64, count(*) FILTER (cum < 0.95) + 1)::bigint AS \"offset\" FROM c GROUP BY 1")
def _(t):
    whole = F.struct(A.energy(F.col("signal")).alias("e"))
    cum = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.round(A.energy(F.slice("signal", 1, i)) / F.col("w.e"), 9))
    x = t.segments.select("vec_id", "signal", whole.alias("w")).select("vec_id", cum.alias("cum"))
    below = lambda q: F.size(F.filter("cum", lambda c: c < q))
    return x.select("vec_id", below(0.05).cast("long").alias("onset"), F.least(F.lit(64), below(0.95) + 1).cast("long").alias("offset"))


@query("tier_amplitude_db", "SELECT vec_id, round(20 * log10(c / sqrt((a * a + b * b) / 2)), 5) AS db FROM (SELECT vec_id, sqrt(var_pop(v) FILTER (n >= 10 AND n < 32)) AS c, sqrt(var_pop(v) FILTER (n < 10)) AS a, sqrt(var_pop(v) FILTER (n >= 32 AND n < 42)) AS b FROM samples GROUP BY 1) WHERE c > 1e-12")
def _(t):
    x = t.segments.select("vec_id", *[A.phase(F.col("signal"), PHASES[p]).alias(p) for p in ("s1", "systole", "s2")])
    x = x.select("vec_id", *[A.centered(F.col(p)).alias(p) for p in ("s1", "systole", "s2")]).select("vec_id", *[A.rms(F.col(p)).alias(p) for p in ("s1", "systole", "s2")])
    ref = F.sqrt((F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")) / 2)
    return x.filter("systole > 1e-12").select("vec_id", F.round(20 * F.log10(F.col("systole") / ref), 5).alias("db"))


@query("tier_psd", f"""WITH d AS (SELECT vec_id, k * 62.5::double AS f, p FROM {DFT} WHERE k * 62.5 BETWEEN 25 AND 800), c AS (SELECT vec_id, f, p, round(sum(p) OVER (PARTITION BY vec_id ORDER BY f) / sum(p) OVER (PARTITION BY vec_id), 9) AS cum FROM d)
    SELECT vec_id, min(f) FILTER (cum >= 0.5) AS median_f, min(f) FILTER (cum >= 0.975) - min(f) FILTER (cum >= 0.025) AS width95, round(coalesce(sum(p) FILTER (f > 200), 0) / sum(p), 6) AS above200 FROM c GROUP BY 1""")
def _(t):
    p = t.segments.select("vec_id", F.slice(A.power_spectrum(F.col("signal"), 64), 2, 12).alias("p")).withColumn("w", F.struct(A.total(F.col("p")).alias("s")))
    cum = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.round(A.total(F.slice("p", 1, i)) / F.col("w.s"), 9))
    at = lambda q: (F.array_position(F.transform("cum", lambda c: c >= q), True)) * 62.5
    return p.withColumn("cum", cum).select("vec_id", at(0.5).alias("median_f"), (at(0.975) - at(0.025)).alias("width95"), r6(A.total(F.slice("p", 4, 9)) / F.col("w.s")).alias("above200"))


@query("energy_profile", "SELECT vec_id, bin, round(sqrt(avg(v * v)), 6) AS rms FROM (SELECT vec_id, least(n // 6, 9)::int AS bin, v FROM samples) GROUP BY 1, 2")
def _(t):
    bins = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: A.rms(F.slice("signal", b * 6 + 1, F.when(b == 9, 10).otherwise(6))))
    return t.segments.select("vec_id", F.posexplode(bins).alias("bin", "r")).select("vec_id", "bin", r6("r").alias("rms"))


@query("synthetic_phase_masks", "SELECT k * 100 AS samples, round_even(0.15::double * k * 100, 0)::int AS s1_end, round_even(0.5::double * k * 100, 0)::int AS systole_end, round_even(0.65::double * k * 100, 0)::int AS s2_end FROM (SELECT unnest(range(1, 33))::int AS k)")
def _(t):
    n = t.spark.range(1, 33).select((F.col("id") * 100).cast("int").alias("samples"))
    return n.select("samples", *[F.rint(F.lit(q) * F.col("samples")).cast("int").alias(k) for k, q in (("s1_end", 0.15), ("systole_end", 0.5), ("s2_end", 0.65))])

