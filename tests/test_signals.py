"""Descriptors of signals whose shape, pitch and timing are known; invariants of the kernels; guards and configurations."""

import numpy as np
import pytest

from segmenta.functions import guards, rich, synthesis
from segmenta.functions import kernels as K
from segmenta.functions import observation as O
from segmenta.operators import orderstats

RATE = 4000
T = np.arange(800) / RATE
U = np.linspace(0, 1, 400)


@pytest.mark.parametrize("shape, e", [
    ("constant", np.full(400, 2.0)),
    ("constant", 1 + 0.05 * np.sin(40 * U)),
    ("crescendo", 0.1 + U),
    ("crescendo", U**2),
    ("decrescendo", 1.1 - U),
    ("crescendo_decrescendo", np.sin(np.pi * U)),
    ("crescendo_decrescendo", np.exp(-(((U - 0.45) / 0.15) ** 2))),
    ("multi_peak", np.exp(-(((U - 0.25) / 0.05) ** 2)) + np.exp(-(((U - 0.75) / 0.05) ** 2))),
    ("insufficient", np.ones(4)),
    ("insufficient", np.zeros(100)),
])
def test_envelope_shapes(shape, e):
    out = O.envelope_shape(np.asarray(e, float), RATE)
    assert out["envelope_shape"] == shape
    assert 0 <= out["envelope_time_to_peak_ratio"] <= 1 and 0 <= out["envelope_symmetry"] <= 1 and 0 <= out["longest_burst_ratio"] <= out["active_time_ratio"] <= 1


def test_envelope_measures():
    out = O.envelope_shape(np.sin(np.pi * U), RATE)
    assert abs(out["envelope_time_to_peak_ratio"] - 0.5) < 0.01 and out["envelope_symmetry"] > 0.98
    assert out["active_burst_count"] == 0  # the level lies above so broad a hump
    assert out["envelope_rising_slope_normalized"] > 1 and out["envelope_falling_slope_normalized"] < -1
    assert abs(out["envelope_rise_time_seconds"] + out["envelope_decay_time_seconds"] - 399 / RATE) < 1e-9
    two = O.envelope_shape(np.exp(-(((U - 0.25) / 0.05) ** 2)) + np.exp(-(((U - 0.75) / 0.05) ** 2)), RATE)
    assert two["active_burst_count"] == 2 and two["envelope_prominent_peak_count"] == 2


@pytest.mark.parametrize("label, x", [
    ("narrow_single_peak", np.sin(2 * np.pi * 300 * T)),
    ("narrow_single_peak", np.sin(2 * np.pi * 150 * T) + 0.01 * np.sin(2 * np.pi * 700 * T)),
    ("double_peak", np.sin(2 * np.pi * 200 * T) + 0.8 * np.sin(2 * np.pi * 500 * T)),
    ("multi_peak", sum(np.sin(2 * np.pi * f * T) for f in (150, 400, 800))),
    ("insufficient", np.zeros(800)),
])
def test_spectrum_shapes(label, x):
    assert O.psd_morphology(x, RATE)["psd_morphology"] == label


def test_spectrum_measures():
    out = O.psd_morphology(np.sin(2 * np.pi * 200 * T) + 0.8 * np.sin(2 * np.pi * 500 * T), RATE)
    step = RATE / 512
    assert abs(out["psd_primary_peak_frequency_hz"] - 200) <= step and abs(out["psd_secondary_peak_frequency_hz"] - 500) <= step
    assert abs(out["psd_peak_separation_hz"] - 300) <= 2 * step and 0.4 < out["psd_secondary_to_primary_ratio"] < 0.9
    assert out["psd_low_frequency_limit_95_hz"] <= 200 <= 500 <= out["psd_high_frequency_limit_95_hz"] + step


@pytest.mark.parametrize("direction, f0, f1", [("rising", 100, 700), ("falling", 700, 100), ("stable", 300, 300)])
def test_ridges(direction, f0, f1):
    x = np.sin(2 * np.pi * (f0 * T + (f1 - f0) * T**2 / (2 * T[-1])))
    assert O.observations(x, RATE)["time_frequency_ridge_direction"] == direction


def test_activity_of_a_burst():
    x = np.zeros(800)
    x[300:500] = np.sin(2 * np.pi * 180 * T[300:500])
    out = O.activity_interval(x, RATE)
    assert out["activity_detection_method"] == "adaptive_envelope" and abs(out["onset_sample"] - 300) <= 60 and abs(out["offset_sample"] - 500) <= 60
    assert out["duration_samples"] == out["offset_sample"] - out["onset_sample"] and abs(out["temporal_energy_centroid"] - 0.5) < 0.02
    assert O.activity_interval(np.zeros(800))["activity_detection_method"] == "silent_or_invalid"
    assert O.activity_interval([1.0, np.nan])["onset_sample"] is None
    short = np.zeros(800)
    short[400] = 1.0
    assert O.activity_interval(short, RATE)["activity_detection_method"] in ("adaptive_envelope", "energy_quantile_fallback")


def test_boundary_variants():
    out = O.boundary_robustness(np.sin(2 * np.pi * 180 * T) * np.hanning(800), RATE)
    assert out["boundary_variant_count"] == 7 and out["boundary_stability_status"] in ("robust", "sensitive")
    steady = O.boundary_robustness(np.concatenate([np.zeros(200), np.sin(2 * np.pi * 200 * np.arange(1600) / RATE), np.zeros(200)]), RATE)
    assert steady["boundary_amplitude_rms_relative_range"] < 0.25 and steady["boundary_psd_peak_frequency_range_hz"] <= 50
    assert O.boundary_robustness(np.zeros(800))["boundary_stability_status"] == "insufficient"


def test_fields_are_the_same_for_silence():
    full, none = O.observations(np.sin(2 * np.pi * 180 * T)), O.observations([])
    assert set(full) == set(none) and len(full) == 61 and none["wavelet_status"] == "insufficient"
    assert abs(sum(full[k] for k in list(O.BANDS)[:6]) - 1) < 1e-6


def test_decompositions():
    rng = np.random.default_rng(1)
    xs = [rng.standard_normal(n) for n in (64, 100, 64, 64)]
    for x, (s, parts) in zip(xs, K.decomposed(xs), strict=True):
        one_s, one = K.ssa(x)
        assert np.allclose(parts.sum(0), x) and np.allclose(parts, one) and np.allclose(s, one_s)
        slow = [K.excess_kurtosis(p) for p in parts]
        assert np.allclose([r["kurtosis"] for r in K.component_table(x, found=(s, parts))], slow)
        for method in ("zcr", "kurtosis"):
            out = K.separate(x, method, found=(s, parts))
            assert np.allclose(np.add(np.add(out["normal"], out["candidate"]), out["noise"]), x)


@pytest.mark.parametrize("shape", synthesis.SHAPES)
def test_mixtures_have_their_levels_and_times(shape):
    m = synthesis.mixture(3, shape, 1000)
    ratio = lambda a, b: 10 * np.log10(synthesis.energy(a) / synthesis.energy(b))
    assert abs(ratio(m["normal"] + m["candidate"], m["noise"]) - 20) < 0.01
    assert m["present"] == (shape != "absent") and (not m["present"] or abs(ratio(m["candidate"], m["normal"]) + 3) < 0.01)
    a, b = K.phase_bounds(800)["systole"]
    assert not np.any(m["candidate"][:a]) and not np.any(m["candidate"][b:])
    out = synthesis.evaluation(3, shape)
    assert set(out) == {c.split()[0] for c in synthesis.KIND.split(", ")} and (out["onset_error_ms"] is None or out["onset_error_ms"] >= 0)
    assert synthesis.si_sdr(m["normal"], 2 * m["normal"]) > 100 and synthesis.leakage(m["normal"], m["normal"]) == pytest.approx(1)


def test_rich_features():
    x = np.sin(2 * np.pi * 180 * T)
    f = rich.features(x)
    assert len(f) == 187 and abs(f["spec_centroid_mean"] - 180) < 60 and np.allclose([f[f"energy_seg_{k}"] for k in range(10)], 0.5**0.5, atol=0.03)
    assert np.allclose(rich.from_mel(rich.to_mel([0, 500, 1000, 1800])), [0, 500, 1000, 1800])
    line = np.arange(12.0)[None] * np.array([[1.0], [-2.0]])
    assert np.allclose(rich.deltas(line), [[1] * 12, [-2] * 12])
    image = rich.image(x)
    assert image.shape == (3, 224, 224) and np.allclose(image[0] * 0.229 + 0.485, image[2] * 0.225 + 0.406)


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1)], f"{guards.CORE_INPUTS[0]} double, other double, patient_id int")
    assert guards.model_inputs(df, guards.CORE_INPUTS[:1]).columns == guards.CORE_INPUTS[:1]
    for bad in (["patient_id"], ["other"]):
        with pytest.raises(ValueError):
            guards.model_inputs(df, bad)
    assert guards.without_descriptors(df, ["other", "other"]).columns == ["other"]
    with pytest.raises(ValueError):
        guards.without_descriptors(df.withColumn("systole_pitch_hz", df.other), ["systole_pitch_hz"])
    assert guards.isolated("/data/in", "/data/out") == "/data/out" and guards.isolated("/data/in", "s3a://b/data/in/x")
    for a, b in (("/data", "/data/out"), ("/data/out", "file:///data"), ("/data/x/../in", "/data/in")):
        with pytest.raises(ValueError):
            guards.isolated(a, b)
    masks = {k: np.arange(8) // 2 == i for i, k in enumerate(guards.PHASES)}
    assert set(guards.phase_masks(masks, 8)) == set(guards.PHASES)
    for fault in ({"s1": np.ones(8, bool)}, {"s2": np.zeros(8, bool)}, {"systole": np.ones(7, bool)}):
        with pytest.raises(ValueError):
            guards.phase_masks(masks | fault, 8)
    with pytest.raises(ValueError):
        guards.phase_masks({"s1": masks["s1"]}, 8)
    assert len(guards.SeparationConfig().hash()) == 64 and guards.SeparationConfig().hash() != guards.SeparationConfig(window=50).hash()
    for bad in ({"window": 1}, {"method": "x"}, {"phase_focus": 2.0}, {"target_phase": "s1"}):
        with pytest.raises(ValueError):
            guards.SeparationConfig(**bad)


def test_order_statistics_match_numpy(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(g, None if rng.random() < 0.1 else float(v)) for g, n in (("a", 900), ("b", 7), (None, 40), ("one", 1)) for v in np.round(rng.standard_normal(n), 1 if g == "a" else 6)]
    df = spark.createDataFrame(rows + [("none", None)], "g string, v double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.p for r in orderstats.percentiles(df, ["g"], {"p": F.col("v")}, points).collect()}
    for g in ("a", "b", None, "one"):
        x = [v for k, v in rows if k == g and v is not None]
        assert (not x and g not in got) or np.allclose(got[g], np.quantile(x, points))
    assert "none" not in got
    ranks = orderstats.average_ranks(df.filter("g = 'a'"), ["g"], {"v": "r"}).collect()
    x = np.array([r.v for r in ranks])
    assert np.allclose([r.r for r in ranks], [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    numbers = sorted((r.v, r.k) for r in orderstats.numbered(df.filter("g = 'a' and v is not null"), ["g"], "v", "k").collect())
    assert [k for _, k in sorted(numbers, key=lambda r: r[1])] == list(range(1, len(numbers) + 1)) and [v for v, _ in numbers] == [v for v, _ in sorted(numbers, key=lambda r: r[1])]
