"""Arrow-batched column functions over the numpy kernels; a column of segments in, arrays or structs out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from segmenta.functions import kernels as K
from segmenta.functions import observation as O


def _mapped(f, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run


def _structs(f, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(a) for a in x])

    return run


def theil_sen_column(c) -> Column:
    return _mapped(lambda a: K.theil_sen(a), "double")(c)


def spectral_column(c) -> Column:
    return _structs(lambda a: K.spectral_features(a), "centroid double, bandwidth double, entropy double, dominant double")(c)


def welch_column(c) -> Column:
    return _mapped(lambda a: K.welch(a)[1], "array<double>")(c)


def envelope_column(c, smooth: bool = True) -> Column:
    return _mapped(lambda a: K.smoothed_envelope(a) if smooth else K.envelope(a), "array<double>")(c)


def array_column(name: str, kind: str = "array<double>"):
    """A kernel by name as a column function."""
    f = getattr(K, name)
    return _mapped(lambda a: f(a), kind)


def struct_column(name: str, kind: str):
    f = getattr(K, name)
    return _structs(lambda a: f(a), kind)


def described(name: str):
    """A descriptor of ``functions.observation`` by name as a column function."""
    f = getattr(O, name)
    return _structs(lambda a: f(a), O.KINDS[name])
