"""Signal queries without SQL give rows for every vector."""

import pytest

import __spark_entry__ as entry
from tests.test_oracle import SF


@pytest.mark.parametrize("name", ["separation_method_choice", "kurtosis_ga"])
def test_every_vector_has_a_row(spark, name):
    assert entry.queries()[name](spark, SF).select("vec_id").count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_every_vector_is_in_a_long_segment(spark):
    from segmenta.plans.registry import Tables
    from segmenta.queries.signal import long_segments

    n = sum(len(r.signal) for r in long_segments(Tables(spark, SF)).collect())
    assert n == 64 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


@pytest.mark.parametrize("name", ["ridge", "spectrogram", "tier_ridge", "observation_features", "mel_spectrogram", "mfcc"])
def test_every_long_segment_has_a_row(spark, name):
    rows = entry.queries()[name](spark, SF)
    sizes = [r["count"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()]
    assert rows.select("label", "part").distinct().count() == sum(-(-n // 20) for n in sizes)


def test_images_leave_a_worker_a_few_at_a_time():
    import numpy as np
    import pyarrow as pa

    from segmenta.functions import rich
    from segmenta.queries import signal

    x = np.random.default_rng(1).standard_normal((20, 320))
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 20), pa.array(range(20)), pa.array(x.tolist())], ["label", "part", "signal"])
    out = list(signal._mel(iter([batch])))
    assert max(b.num_rows for b in out) <= 8
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["part"] for r in rows] == list(range(20))
    for r, a in zip(rows, x, strict=True):
        assert np.array_equal(np.array(r["image"], np.float32), rich.image(a).astype(np.float32))
