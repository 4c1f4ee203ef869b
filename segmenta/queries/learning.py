"""Cohorts, folds, fold-safe features, models and metrics."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.operators import orderstats as O
from segmenta.plans.registry import query, r6

FOLD = "(row_number() OVER (PARTITION BY label ORDER BY md5('3|' || patient_id)) - 1) % 5"
FOLDED = f"(SELECT *, {FOLD} AS fold FROM cohort)"


def folded(t):
    """Stratified folds: within each label, patients in the order of a keyed md5 are dealt to five folds."""
    return dealt(t.cohort, "3").withColumn("fold", ((F.col("rn") - 1) % 5).cast("long")).drop("rn")


def dealt(rows, seed: str):
    """rows with rn, their number within the label in the order of a keyed md5."""
    x = rows.withColumn("_md5", F.md5(F.concat_ws("|", F.lit(seed), F.col("patient_id").cast("string")).cast("binary")))
    return O.numbered(x, ["label"], "_md5", "rn", F.conv(F.substring("_md5", 1, 12), 16, 10).cast("long")).drop("_md5")


@query("eligible_labels", "SELECT patient_id, label FROM cohort WHERE label IN (0, 1)")
def _(t):
    domain = F.when(F.col("label").isin(0, 1), True).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("boolean"))
    return t.cohort.filter(domain).select("patient_id", "label")


@query("stratified_folds", f"SELECT patient_id, label, fold FROM {FOLDED}")
def _(t):
    return folded(t).select("patient_id", "label", "fold")


@query("inner_validation", f"SELECT patient_id, label FROM (SELECT patient_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('5|' || patient_id)) AS rn, greatest(1, round_even(0.2::double * count(*) OVER (PARTITION BY label), 0)) AS k FROM {FOLDED} WHERE fold <> 0) WHERE rn <= k")
def _(t):
    f = folded(t).filter("fold <> 0")
    most = f.groupBy("label").agg(F.greatest(F.lit(1.0), F.rint(0.2 * F.count("*"))).alias("k"))
    return O.joined(dealt(f, "5"), most, ["label"]).filter("rn <= k").select("patient_id", "label")


@query("fold_disjoint", f"SELECT patient_id FROM {FOLDED} WHERE fold = 0 INTERSECT SELECT patient_id FROM {FOLDED} WHERE fold <> 0")
def _(t):
    f = folded(t)
    return f.filter("fold = 0").select("patient_id").intersect(f.filter("fold <> 0").select("patient_id"))


IMPUTED = f"""f AS (SELECT patient_id, label, fold, CASE WHEN n_lines > 1 THEN n_chars END AS x FROM {FOLDED}), k AS (SELECT unnest(range(0, 5)) AS k), m AS (SELECT k, median(x) AS med FROM f JOIN k ON fold <> k GROUP BY 1),
    s AS (SELECT k.k, avg(coalesce(x, med)) AS mu, stddev_pop(coalesce(x, med)) AS sd FROM f JOIN k ON fold <> k.k JOIN m ON m.k = k.k GROUP BY 1)"""


@query("fold_impute_scale", f"WITH {IMPUTED} SELECT patient_id, fold, round((coalesce(x, med) - mu) / sd, 6) AS z FROM f JOIN m ON m.k = fold JOIN s ON s.k = fold")
def _(t):
    return scaled(t).select("patient_id", "fold", r6("z").alias("z"))


def scaled(t, fit: str = "others"):
    """Median, mean and deviation from the other folds only; each row is exploded to the four folds it trains."""
    f = folded(t).select("patient_id", "label", "fold", F.when(F.col("n_lines") > 1, F.col("n_chars").cast("double")).alias("x"))
    train = f.select("x", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda k: k != F.col("fold"))).alias("k"))
    med = O.percentiles(train, ["k"], {"med": F.col("x")}, [0.5]).withColumn("med", F.col("med")[0])
    sd = train.join(F.broadcast(med), "k").withColumn("v", F.coalesce("x", "med")).groupBy("k").agg(F.first("med").alias("med"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))  # five rows
    return f.join(F.broadcast(sd), F.col("fold") == F.col("k")).withColumn("z", (F.coalesce("x", "med") - F.col("mu")) / F.col("sd"))


@query("logistic_oof")
def _(t):
    """Out-of-fold probabilities of a balanced logistic regression; each model sees the other four folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=["z"], outputCol="features").transform(scaled(t).withColumn("label", F.col("label").cast("double")))
    x = x.withColumn("w", F.when(F.col("label") == 1, 0.5).otherwise(3.0))
    out = None
    for k in range(5):
        train = x.filter(F.col("fold") != k)
        model = LogisticRegression(weightCol="w", regParam=1e-3, elasticNetParam=0.0, standardization=False, maxIter=50).fit(train)
        part = model.transform(x.filter(F.col("fold") == k)).select("patient_id", "fold", "label", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@query("dummy_prior", f"WITH f AS {FOLDED} SELECT patient_id, round((SELECT avg(label) FROM f g WHERE g.fold <> f.fold), 6) AS p FROM f")
def _(t):
    f = folded(t)
    per = f.groupBy("fold").agg(F.sum("label").alias("s"), F.count("*").alias("c"))
    prior = per.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc")).crossJoin(per).select("fold", r6((F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c"))).alias("p"))
    return f.join(F.broadcast(prior), "fold").select("patient_id", "p")


@query("aggregate_probabilities", "SELECT patient_id, round(avg(discount * 10), 6) AS probability, count(*) AS n_cycles, avg(discount * 10) >= 0.5 AS predicted FROM candidates GROUP BY 1")
def _(t):
    """Lines are summed in the order they are stored, as a threshold at just 0.5 turns on the last bit of a sum."""
    lines = t.lineitem.select("l_orderkey", (F.col("l_discount") * 10).alias("x"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    rows = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("patient_id"), "x", "place")
    so_far = F.sum("x").over(W.partitionBy("patient_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    p = F.try_divide(F.max_by("total", "place"), F.count("x"))
    return rows.withColumn("total", so_far).groupBy("patient_id").agg(r6(p).alias("probability"), F.count("*").alias("n_cycles"), (p >= 0.5).alias("predicted"))


SCORED = "(SELECT patient_id, label, (n_chars % 101) / 100.0::double AS score FROM cohort)"


def scored(t):
    return t.cohort.select("patient_id", "label", ((F.col("n_chars") % 101) / 100.0).alias("score"))


COUNTS = f"(SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM {SCORED})"


@query("classification_metrics", f"SELECT tp, fp, tn, fn, round(tp / (tp + fn)::double, 6) AS sensitivity, round(tn / (tn + fp)::double, 6) AS specificity, round((tp / (tp + fn)::double + tn / (tn + fp)::double) / 2, 6) AS balanced_accuracy, round((2 * tp / (2 * tp + fp + fn)::double + 2 * tn / (2 * tn + fp + fn)::double) / 2, 6) AS macro_f1 FROM {COUNTS}")
def _(t):
    pos, hit = F.col("label") == 1, F.col("score") >= 0.5
    c = scored(t).agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"))
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    se, sp = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return c.select("tp", "fp", "tn", "fn", r6(se).alias("sensitivity"), r6(sp).alias("specificity"), r6((se + sp) / 2).alias("balanced_accuracy"), r6((F.try_divide(2 * tp, 2 * tp + fp + fn) + F.try_divide(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"))


@query("auroc", f"SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::double) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auroc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS r FROM {SCORED})")
def _(t):
    r = O.average_ranks(scored(t), [], {"score": "r"})
    n1, n0 = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return r.agg(r6((F.sum(F.when(F.col("label") == 1, F.col("r"))) - n1 * (n1 + 1) / 2.0) / (n1 * n0)).alias("auroc"))


METRICS = ("balanced_accuracy", "macro_f1", "sensitivity", "specificity")


def _drawn(n1: pd.Series, tp: pd.Series, n0: pd.Series, tn: pd.Series, rep: pd.Series) -> pd.DataFrame:
    """Metrics of one replicate each; rep -1 is the sample itself."""
    out = []
    for a, h, b, k, r in zip(n1, tp, n0, tn, rep, strict=True):
        rng = np.random.default_rng([20260827, max(0, int(r))])
        x, y = (h, k) if r < 0 else (rng.binomial(a, h / a if a else 0.0), rng.binomial(b, k / b if b else 0.0))
        se, sp = x / a if a else np.nan, y / b if b else np.nan
        f1 = (2 * x / max(1, a + x + b - y) + 2 * y / max(1, b + y + a - x)) / 2
        out.append(((se + sp) / 2, f1, se, sp))
    return pd.DataFrame(out, columns=list(METRICS))


@query("metric_bootstrap")
def _(t):
    """Intervals of 2000 bootstraps stratified by label. How many of n patients drawn with replacement are hits is binomial, so a
    replicate is drawn from the four counts, whatever their size, and no row is."""
    pos, hit = F.col("label") == 1, F.col("score") >= 0.5
    c = scored(t).agg(F.count_if(pos).alias("n1"), F.count_if(pos & hit).alias("tp"), F.count_if(~pos).alias("n0"), F.count_if(~pos & ~hit).alias("tn"))
    reps = c.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(1999))))
    drawn = F.pandas_udf(_drawn, ", ".join(f"{m} double" for m in METRICS))("n1", "tp", "n0", "tn", "rep")
    x = reps.select("rep", drawn.alias("m")).select("rep", "m.*").unpivot(["rep"], list(METRICS), "metric", "value")
    g = x.groupBy("metric").agg(r6(F.max(F.when(F.col("rep") < 0, F.col("value")))).alias("estimate"), F.percentile(F.when(F.col("rep") >= 0, F.col("value")), [0.025, 0.975]).alias("p"), F.count_if(F.col("rep") >= 0).alias("replicates"))  # 2000 values each
    return g.select("metric", "estimate", r6(F.col("p")[0]).alias("low"), r6(F.col("p")[1]).alias("high"), "replicates")


@query("class_weights", "SELECT label, round(2 * (1.0::double / n) / sum(1.0::double / n) OVER (), 6) AS weight FROM (SELECT label, count(*) AS n FROM cohort GROUP BY 1)")
def _(t):
    g = t.cohort.groupBy("label").agg(F.count("*").alias("n"))
    whole = g.agg(F.sum(1.0 / F.col("n")).alias("s"))
    return g.crossJoin(F.broadcast(whole)).select("label", r6(2 * (1.0 / F.col("n")) / F.col("s")).alias("weight"))  # a row per class


@query("waveform_norm", "SELECT round(sum(v) / count(*), 6) AS mean, round(sqrt(greatest(sum(v * v) / count(*) - pow(sum(v) / count(*), 2), 1e-12)), 6) AS std FROM samples WHERE vec_id % 5 <> 0")
def _(t):
    v = F.col("v")
    m = F.sum(v) / F.count("*")
    return t.samples.filter("vec_id % 5 <> 0").agg(r6(m).alias("mean"), r6(F.sqrt(F.greatest(F.sum(v * v) / F.count("*") - m * m, F.lit(1e-12)))).alias("std"))


@query("patient_log_loss", f"SELECT round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS loss FROM (SELECT label, greatest(1e-7, least(1 - 1e-7, score)) AS p FROM {SCORED})")
def _(t):
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("score")))
    return scored(t).agg(r6(-F.avg(F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("loss"))


@query("group_shuffle_split", "SELECT split, count(DISTINCT patient_id) FILTER (test) AS test_patients, count(*) FILTER (test) AS test_rows, count(*) FILTER (NOT test) AS train_rows FROM (SELECT split, patient_id, ('0x' || substr(md5(split || '|' || patient_id), 1, 8))::bigint % 100 < 20 AS test FROM candidates, (SELECT unnest(range(0, 10)) AS split)) GROUP BY 1")
def _(t):
    per = t.candidates.groupBy("patient_id").agg(F.count("*").alias("n")).select("patient_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("split"))
    test = F.conv(F.substring(F.md5(F.concat_ws("|", "split", "patient_id").cast("binary")), 1, 8), 16, 10).cast("long") % 100 < 20
    return per.withColumn("test", test).groupBy("split").agg(F.count_if("test").alias("test_patients"), F.coalesce(F.sum(F.when(F.col("test"), F.col("n"))), F.lit(0)).cast("long").alias("test_rows"), F.coalesce(F.sum(F.when(~F.col("test"), F.col("n"))), F.lit(0)).cast("long").alias("train_rows"))


@query("random_forest_oof")
def _(t):
    """A tree ensemble on hash-split patients, the counterpart of the margin and forest classifiers."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=["n_chars", "n_lines"], outputCol="features").transform(folded(t).withColumn("label", F.col("label").cast("double")))
    model = RandomForestClassifier(numTrees=20, maxDepth=4, seed=7).fit(x.filter("fold <> 0"))
    return model.transform(x.filter("fold = 0")).select("patient_id", "label", vector_to_array("probability")[1].alias("p"))
