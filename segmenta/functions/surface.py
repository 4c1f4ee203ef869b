"""The kernels as SQL functions of a session: ``register(spark)``, then ``SELECT spectral_entropy(signal) ...``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from segmenta.functions import kernels as K
from segmenta.functions import observation as O
from segmenta.functions import rich
from segmenta.operators.dsp import _mapped, _structs

COMPONENT = "component int, active boolean, relative_energy double, zcr double, kurtosis double, centroid double, bandwidth double, dominant double, low double, mid double, high double, impulsiveness double, s1_focus double, systole_focus double, s2_focus double, diastole_focus double, s1_ratio double, systole_ratio double, s2_ratio double, diastole_ratio double"

#: Functions of one array of samples, by their SQL names.
ARRAYS = {
    "smoothed_envelope": (K.smoothed_envelope, "array<double>"), "signal_envelope": (K.envelope, "array<double>"), "welch_density": (lambda a: K.welch(a)[1], "array<double>"), "dwt_refined": (K.dwt_refine, "array<double>"),
    "excess_kurtosis": (K.excess_kurtosis, "double"), "zero_crossing_rate": (K.zero_crossings, "double"), "theil_sen": (K.theil_sen, "double"),
}
STRUCTS = {
    **{k: (getattr(O, k), kind) for k, kind in O.KINDS.items()}, "spectral_features": (K.spectral_features, "centroid double, bandwidth double, entropy double, dominant double"),
    "rich_features": (rich.features, ", ".join(f"{k} double" for k in rich.NAMES)), "separated": (K.separate, "normal array<double>, candidate array<double>, noise array<double>, status string, score double, method string"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all of them, vectorised, and the table function ``components``; their names."""
    for name, (f, kind) in ARRAYS.items():
        spark.udf.register(name, _mapped(f, kind))
    for name, (f, kind) in STRUCTS.items():
        spark.udf.register(name, _structs(f, kind))
    spark.udtf.register("components", F.udtf(Components, returnType=COMPONENT))
    return sorted([*ARRAYS, *STRUCTS, "components"])


class Components:
    """SELECT * FROM components(ARRAY(...)), or with LATERAL: a row per component of a signal."""

    def eval(self, signal):
        for row in K.component_table(signal):
            yield tuple(row.values())
