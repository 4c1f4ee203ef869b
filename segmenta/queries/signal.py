"""Kernels that SQL can't express, and the invariants that it can check."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from segmenta.functions import arrays as A
from segmenta.functions import guards, rich, synthesis
from segmenta.functions import kernels as K
from segmenta.operators import orderstats as O
from segmenta.operators.dsp import array_column, described, envelope_column, struct_column
from segmenta.plans.registry import PHASES, query, r6


def _udf(kind):
    return lambda f: F.pandas_udf(f, kind)


@query("ssa_reconstruction", "SELECT vec_id, n, round(v, 5) AS v FROM samples")
def _(t):
    back = _udf("array<double>")(_ssa_sum)
    return t.segments.select("vec_id", F.posexplode(back("signal")).alias("n", "v")).select("vec_id", F.col("n").cast("long").alias("n"), (F.round("v", 5) + 0.0).alias("v"))


def _ssa_sum(x: pd.Series) -> pd.Series:
    return pd.Series([parts.sum(0) for _, parts in K.decomposed(x.tolist(), 16)])


def _ssa_energy(x: pd.Series) -> pd.Series:
    return pd.Series([float((s**2).sum()) for s, _ in K.decomposed(x.tolist(), 16)])


def _ssa_active(x: pd.Series) -> pd.Series:
    return pd.Series([K.active_count(s) for s, _ in K.decomposed(x.tolist(), 16)])


@query("ssa_singular_energy", "SELECT vec_id, round(sum(v * v * least(n + 1, 16, 64 - n)), 5) AS energy FROM samples GROUP BY 1")
def _(t):
    return t.segments.select("vec_id", F.round(_udf("double")(_ssa_energy)("signal"), 5).alias("energy"))


@query("ssa_active_count")
def _(t):
    return t.segments.select("vec_id", _udf("int")(_ssa_active)("signal").alias("active"))


def _diagonal(x: pd.Series) -> pd.Series:
    return x.map(lambda a: K.diagonal_average(K.hankel(a, 16)))


@query("diagonal_average", "SELECT vec_id, n, round(v, 6) AS v FROM samples")
def _(t):
    return t.segments.select("vec_id", F.posexplode(_udf("array<double>")(_diagonal)("signal")).alias("n", "v")).select("vec_id", F.col("n").cast("long").alias("n"), (r6("v") + 0.0).alias("v"))


COMPONENT = "component int, active boolean, relative_energy double, zcr double, kurtosis double, centroid double, bandwidth double, dominant double, low double, mid double, high double, impulsiveness double, s1_focus double, systole_focus double, s2_focus double, diastole_focus double, s1_ratio double, systole_ratio double, s2_ratio double, diastole_ratio double"


def _components(x: pd.Series) -> pd.Series:
    return pd.Series([K.component_table(a, found=d) for a, d in _decomposed(x)])


def component_rows(t):
    kind = "array<struct<" + ", ".join(c.replace(" ", ":") for c in COMPONENT.split(", ")) + ">>"
    return t.segments.select("vec_id", F.inline(_udf(kind)(_components)("signal")))


@query("component_table")
def _(t):
    return component_rows(t)


@query("component_energy_total", "SELECT vec_id, 1.0::double AS total FROM embeddings")
def _(t):
    return component_rows(t).groupBy("vec_id").agg(F.round(F.sum("relative_energy"), 6).alias("total"))


SEPARATION = "normal array<double>, candidate array<double>, noise array<double>, status string, score double, method string"


def _decomposed(x: pd.Series):
    signals = x.tolist()
    return zip(signals, K.decomposed(signals), strict=True)


def _separated(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([K.separate(a, found=d) for a, d in _decomposed(x)])


def _best(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{k: v for k, v in K.best_separation(a, d).items() if k in ("status", "score", "method")} for a, d in _decomposed(x)])


def _genetic(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{k: v for k, v in K.separate(a, "kurtosis", found=d).items() if k in ("status", "score")} for a, d in _decomposed(x)])


@query("separation", "SELECT vec_id, n, round(v, 5) AS v FROM samples")
def _(t):
    s = t.segments.select("vec_id", _udf(SEPARATION)(_separated)("signal").alias("s"))
    whole = F.zip_with(F.zip_with("s.normal", "s.candidate", lambda a, b: a + b), "s.noise", lambda a, b: a + b)
    return s.select("vec_id", F.posexplode(whole).alias("n", "v")).select("vec_id", F.col("n").cast("long").alias("n"), (F.round("v", 5) + 0.0).alias("v"))


@query("separation_method_choice")
def _(t):
    return t.segments.select("vec_id", _udf("status string, score double, method string")(_best)("signal").alias("s")).select("vec_id", "s.*")


@query("kurtosis_ga")
def _(t):
    return t.segments.select("vec_id", _udf("status string, score double")(_genetic)("signal").alias("s")).select("vec_id", "s.*")


@query("dwt_refine")
def _(t):
    return t.segments.select("vec_id", array_column("dwt_refine")("signal").alias("refined"))


def _identity(x: pd.Series) -> pd.Series:
    return x.map(lambda a: K.dwt_refine(a, scale=0.0))


@query("dwt_identity", "SELECT vec_id, n, round(v, 5) AS v FROM samples")
def _(t):
    return t.segments.select("vec_id", F.posexplode(_udf("array<double>")(_identity)("signal")).alias("n", "v")).select("vec_id", F.col("n").cast("long").alias("n"), (F.round("v", 5) + 0.0).alias("v"))


@query("smoothed_envelope")
def _(t):
    return t.segments.select("vec_id", envelope_column("signal").alias("envelope"))


@query("envelope_morphology")
def _(t):
    return t.segments.select("vec_id", described("envelope_morphology")("signal").alias("m")).select("vec_id", "m.*")


@query("psd_morphology")
def _(t):
    return t.segments.select("vec_id", described("psd_morphology")("signal").alias("m")).select("vec_id", "m.*")


@query("activity_interval")
def _(t):
    return t.segments.select("vec_id", described("activity_interval")("signal").alias("m")).select("vec_id", "m.*")


@query("boundary_robustness")
def _(t):
    return t.segments.select("vec_id", described("boundary_robustness")("signal").alias("m")).select("vec_id", "m.*")


@query("wavelet_features")
def _(t):
    return t.segments.select("vec_id", described("wavelet_features")("signal").alias("m")).select("vec_id", "m.*")


@query("ridge")
def _(t):
    return long_segments(t).select("label", "part", struct_column("ridge", "times array<double>, frequencies array<double>")("signal").alias("m")).select("label", "part", "m.*")


def long_segments(t):
    """All vectors of each label, twenty in a row: part 0, 1, ... of at most 1 280 samples each."""
    least = F.coalesce(F.col("vec_id"), F.lit(-(2**63)))  # nulls are first
    x = O.numbered(t.segments.withColumn("at", least), ["label"], "at", "rk").withColumn("part", F.floor((F.col("rk") - 1) / 20))
    return x.groupBy("label", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rk", "signal"))), lambda s: s.signal)).alias("signal"))


def _spectrogram(x: pd.Series) -> pd.Series:
    return x.map(lambda a: [r.tolist() for r in K.spectrogram(a)[2]])


@query("spectrogram")
def _(t):
    return long_segments(t).select("label", "part", _udf("array<array<double>>")(_spectrogram)("signal").alias("density"))


@query("tier_envelope")
def _(t):
    return t.segments.select("vec_id", struct_column("tier_envelope", "peak_position double, rise_slope double, decay_slope double, fullness double, reason string")("signal").alias("m")).select("vec_id", "m.*")


@query("tier_ridge")
def _(t):
    return long_segments(t).select("label", "part", struct_column("tier_ridge", "slope double, variability double, reason string")("signal").alias("m")).select("label", "part", "m.*")


@query("observation_features")
def _(t):
    return long_segments(t).select("label", "part", described("observations")("signal").alias("m")).select("label", "part", "m.*")


#: Images sent at a time, of 600 kB each.
IMAGES = 8


def _mel(batches):
    for batch in batches:
        keys, signals = batch.select(["label", "part"]), batch.column("signal")
        for k in range(0, batch.num_rows, IMAGES):
            x = np.stack([rich.image(a) for a in signals.slice(k, IMAGES).to_pandas()]).astype(np.float32)
            out = pa.array(x.ravel())
            for size in x.shape[:0:-1]:
                out = pa.ListArray.from_arrays(np.arange(0, len(out) + 1, size, dtype=np.int32), out)
            yield pa.RecordBatch.from_arrays([*keys.slice(k, IMAGES).columns, out], ["label", "part", "image"])


@query("mel_spectrogram")
def _(t):
    """Three channels of 224 x 224 for each part, as image models take them."""
    x = long_segments(t)
    return x.mapInArrow(_mel, ", ".join(f"{k} {v}" for k, v in x.dtypes if k != "signal") + ", image array<array<array<float>>>")


def _rich(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rich.features(a) for a in x], columns=rich.NAMES)


@query("rich_features")
def _(t):
    f = _udf(", ".join(f"{k} double" for k in rich.NAMES))(_rich)
    return long_segments(t).select("label", "part", f("signal").alias("m")).select("label", "part", *[F.nanvl(F.col("m")[k], F.lit(None)).alias(k) for k in rich.NAMES])


@query("phase_mask_check", """SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN 's2:empty' WHEN 2 THEN 'overlap' WHEN 3 THEN 'systole:wrong_length' WHEN 4 THEN 'diastole:missing' END AS fault FROM embeddings""")
def _(t):
    """The fault of each vector's phase masks; of every five one is whole and four have one fault each."""
    k, n = F.col("vec_id") % 5, F.size("signal")
    mask = lambda lo, hi: F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i.between(lo, hi - 1)).cast("int"))
    m = {p: mask(*b) for p, b in PHASES.items()}
    m["s2"] = F.when(k == 1, mask(0, 0)).otherwise(m["s2"])
    m["s1"] = F.when(k == 2, mask(0, PHASES["s1"][1] + 1)).otherwise(m["s1"])
    m["systole"] = F.when(k == 3, F.slice(m["systole"], 1, 20)).otherwise(m["systole"])
    m["diastole"] = F.when(k != 4, m["diastole"])
    return t.segments.select("vec_id", guards.mask_fault_column(n, **m).alias("fault"))


@query("mfcc")
def _(t):
    return long_segments(t).select("label", "part", array_column("mfcc")("signal").alias("mfcc"))


def _mixture(seed: pd.Series, shape: pd.Series) -> pd.DataFrame:
    rows = [synthesis.mixture(int(a), b) for a, b in zip(seed, shape, strict=True)]
    return pd.DataFrame([{k: r[k].tolist() for k in ("normal", "candidate", "noise", "mixture")} for r in rows])


def _evaluated(seed: pd.Series, shape: pd.Series) -> pd.DataFrame:
    rows = [synthesis.evaluation(a, b) for a, b in zip(seed, shape, strict=True)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in synthesis.KIND.split(", ")])


def synthetic_grid(t, shapes):
    return t.spark.range(4).select(F.col("id").alias("seed"), F.explode(F.array(*[F.lit(s) for s in shapes])).alias("shape"))


@query("synthetic_mixture", "SELECT seed::bigint AS seed, shape, 0.0::double AS residual FROM (SELECT unnest(range(0, 4)) AS seed), (SELECT unnest(['plateau','crescendo','decrescendo','diamond','absent']) AS shape)")
def _(t):
    """The stems of each mixture sum to it."""
    grid = synthetic_grid(t, ("plateau", "crescendo", "decrescendo", "diamond", "absent"))
    named = F.when(F.col("shape") == "diamond", "crescendo_decrescendo").otherwise(F.col("shape"))
    m = grid.withColumn("m", _udf("normal array<double>, candidate array<double>, noise array<double>, mixture array<double>")(_mixture)("seed", named))
    stems = F.zip_with(F.zip_with("m.normal", "m.candidate", lambda a, b: a + b), "m.noise", lambda a, b: a + b)
    return m.select("seed", "shape", (r6(A.energy(F.zip_with(stems, "m.mixture", lambda a, b: a - b))) + 0.0).alias("residual"))


@query("synthetic_evaluation")
def _(t):
    return synthetic_grid(t, synthesis.SHAPES).withColumn("m", _udf(synthesis.KIND)(_evaluated)("seed", "shape")).select("seed", "shape", "m.*")
