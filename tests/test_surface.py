"""SQL functions of a session, and WAV files at other rates and with damaged headers."""

import numpy as np
import pytest

from segmenta.functions import surface
from segmenta.sources import recordings as R


def test_registered_functions(spark):
    names = surface.register(spark)
    assert {"welch_density", "observations", "separated", "components"} <= set(names)
    spark.range(3).selectExpr("id", "transform(sequence(0, 199), x -> sin(x * (id + 1) / 5.0)) AS signal").createOrReplaceTempView("surface_segments")
    rows = spark.sql("SELECT id, zero_crossing_rate(signal) AS z, observations(signal) AS o, size(welch_density(signal)) AS n, separated(signal).status AS status FROM surface_segments ORDER BY id").collect()
    assert [r.z for r in rows] == sorted(r.z for r in rows) and all(r.n == 101 and r.o.amplitude_rms > 0.5 and r.status for r in rows)
    found = spark.sql("SELECT id, count(*) AS n, sum(c.relative_energy) AS e FROM surface_segments, LATERAL components(signal) AS c GROUP BY id").collect()
    assert all(r.n == 50 and abs(r.e - 1) < 1e-6 for r in found)


@pytest.mark.parametrize("rate, target", [(8000, 4000), (8000, 11025), (4000, 8000), (44100, 4000), (4000, 4000)])
def test_resampling_keeps_a_tone(rate, target):
    x = np.sin(2 * np.pi * 50 * np.arange(rate) / rate)
    y = R.resampled(x, rate, target)
    assert len(y) == -(-rate * target // rate) and np.abs(y - np.sin(2 * np.pi * 50 * np.arange(len(y)) / target))[200:-200].max() < 2e-3


def test_headers(spark):
    good = R.encode_wav(np.zeros(100), 8000)
    assert R.inspect_wav(good[:64], len(good)) == {"sample_rate": 8000, "channels": 1, "n_frames": 100, "error": None}
    for bad, error in ((b"RIFF", "not_wav"), (b"", "not_wav"), (good[:30], "no_data"), (R.encode_wav([], 8000), "empty")):
        assert R.inspect_wav(bad, len(bad))["error"] == error
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"x")), (3, bytearray(good[:150]))], "id int, content binary")
    got = {r.id: r.w for r in df.select("id", R.inspected("content").alias("w")).collect()}
    assert got[1].n_frames == 100 and got[2].error == "not_wav" and got[3].error == "truncated"


def test_scan_at_another_rate(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(R.encode_wav(np.sin(np.arange(800) / 10) / 2, 8000))
    row = R.read_wav(spark, str(tmp_path), rate=4000).first()
    assert row.sample_rate == 4000 and len(row.signal) == 400 and row.n_frames == 800
