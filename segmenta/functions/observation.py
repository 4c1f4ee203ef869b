"""Descriptors of one active segment: amplitude, envelope shape, spectrum, time-frequency ridge and wavelet.

Every function gives a dict with the same fields for any input; what a silent or short segment can't tell is 0 and its status
says so. Names, limits and labels are fixed values of the data model.
"""

from __future__ import annotations

import numpy as np

from segmenta.functions import kernels as K

EPS = K.EPS

#: Fields of each group, in the order of the tables.
ENVELOPE_FIELDS = [
    "envelope_time_to_peak_ratio", "envelope_rise_time_seconds", "envelope_decay_time_seconds", "envelope_rising_slope_normalized", "envelope_falling_slope_normalized",
    "envelope_variation_coefficient", "envelope_area_normalized", "envelope_symmetry", "envelope_prominent_peak_count", "active_burst_count", "active_time_ratio", "longest_burst_ratio",
]
PSD_FIELDS = [
    "psd_primary_peak_frequency_hz", "psd_prominent_peak_count", "psd_primary_peak_width_hz", "psd_primary_peak_prominence_ratio", "psd_secondary_peak_frequency_hz", "psd_secondary_to_primary_ratio",
    "psd_peak_separation_hz", "psd_primary_q_factor", "psd_energy_concentration", "psd_low_frequency_limit_95_hz", "psd_high_frequency_limit_95_hz",
]
RIDGE_FIELDS = ["time_frequency_ridge_start_hz", "time_frequency_ridge_end_hz", "time_frequency_ridge_slope_hz_per_second", "time_frequency_ridge_variability_hz", "time_frequency_ridge_continuity"]
AMPLITUDE_FIELDS = ["amplitude_peak_abs", "amplitude_rms", "amplitude_mean_abs", "amplitude_envelope_peak", "amplitude_envelope_mean", "amplitude_crest_factor"]
SPECTRUM_FIELDS = ["psd_peak_frequency_hz", "psd_peak_power", "psd_frequency_resolution_hz"]
#: Bands of the spectrum in Hz, the last two open.
BANDS = {"psd_0_100_hz_ratio": (0, 100), "psd_100_200_hz_ratio": (100, 200), "psd_200_400_hz_ratio": (200, 400), "psd_400_800_hz_ratio": (400, 800), "psd_800_1000_hz_ratio": (800, 1000), "psd_above_1000_hz_ratio": (1000, np.inf), "psd_above_200_hz_ratio": (200, np.inf)}
FRAME_FIELDS = [
    "time_frequency_peak_hz", "time_frequency_peak_seconds", "time_frequency_frame_count", "time_frequency_frequency_resolution_hz", "time_frequency_window_seconds", "time_frequency_entropy", "time_frequency_spectral_flux",
]
WAVELET_FIELDS = ["wavelet_peak_frequency_hz", "wavelet_peak_seconds", "wavelet_frequency_centroid_hz", "wavelet_frequency_spread_hz", "wavelet_entropy", "wavelet_peak_scale_energy_ratio"]
ROBUSTNESS_FIELDS = [
    "boundary_jitter_ms", "boundary_variant_count", "boundary_amplitude_rms_relative_range", "boundary_psd_peak_frequency_range_hz", "boundary_envelope_time_to_peak_ratio_range", "boundary_psd_width_relative_range",
    "boundary_envelope_shape_agreement_ratio",
]
ACTIVITY_FIELDS = [
    "onset_sample", "offset_sample", "duration_samples", "onset_seconds", "offset_seconds", "duration_seconds", "onset_normalized", "offset_normalized", "duration_ratio", "temporal_energy_centroid", "peak_position",
    "activity_threshold",
]
#: What makes a boundary robust, as the most each range may be.
ROBUST = {"boundary_amplitude_rms_relative_range": 0.25, "boundary_envelope_time_to_peak_ratio_range": 0.25, "boundary_psd_width_relative_range": 0.50}


def _entropy(mass: np.ndarray) -> float:
    """Entropy of a table of masses, as a part of the most it can have."""
    w = mass / (mass.sum() + EPS)
    return float(-(w * np.log2(w + EPS)).sum() / np.log2(max(2, w.size)))


def _fields(names: list[str], values, **more) -> dict:
    return more | {k: float(v) for k, v in zip(names, values, strict=True)}


def _zeros(names: list[str], **more) -> dict:
    return _fields(names, [0.0] * len(names), **more)


def _slope(y: np.ndarray, x: np.ndarray) -> float:
    """Least-squares slope, 0 for fewer than three points."""
    if len(y) < 3:
        return 0.0
    dx = x - x.mean()
    return float((dx * (y - y.mean())).sum() / (dx**2).sum())


def envelope_shape(e: np.ndarray, rate: int = K.RATE) -> dict:
    """Shape label, peak, slopes and bursts of an envelope."""
    n = len(e)
    if n < 5 or e.max(initial=0) <= EPS:
        return _zeros(ENVELOPE_FIELDS, envelope_shape="insufficient")
    rim = min(max(1, round(0.04 * n)), max(1, n // 4))  # smoothing is worst at the ends
    peak = rim + int(e[rim : max(rim + 1, n - rim)].argmax())
    level, t = e / (e[peak] + EPS), np.linspace(0, 1, n)
    fifth = max(1, n // 5)
    centre = max(0, n // 2 - fifth // 2)
    first, middle, last = (float(level[a : a + fifth].mean()) for a in (0, centre, n - fifth))
    variation, at = float(e.std() / (e.mean() + EPS)), peak / max(1, n - 1)
    spread = float(np.subtract(*np.percentile(level, [90, 10])))
    n_peaks = len(K.find_peaks(level, max(1, round(0.08 * n)), 0.12))
    # The first rule that holds names the shape.
    shapes = {
        "constant": variation < 0.12 or spread < 0.20,
        "crescendo": last - first > 0.25 and last >= 0.90 * middle,
        "decrescendo": first - last > 0.25 and first >= 0.90 * middle,
        "crescendo_decrescendo": 0.18 <= at <= 0.82 and middle > 1.20 * max(first, last),
        "multi_peak": n_peaks >= 2,
        "irregular": True,
    }
    base = np.percentile(e, 20)
    cut = base + max(2 * 1.4826 * np.median(np.abs(e - base)), 0.20 * (e.max() - base))
    shortest = max(1, min(round(0.005 * rate), n // 10))
    bursts = np.array([b - a for a, b in K.true_runs(e >= cut) if b - a >= shortest], int)
    values = [
        at, peak / rate, (n - 1 - peak) / rate, _slope(level[: peak + 1], t[: peak + 1]), _slope(level[peak:], t[peak:]), variation, level.mean(), max(0.0, 1 - abs(2 * at - 1)), n_peaks,
        len(bursts), bursts.sum() / n, bursts.max(initial=0) / n,
    ]
    return _fields(ENVELOPE_FIELDS, values, envelope_shape=next(k for k, holds in shapes.items() if holds))


def envelope_morphology(a, rate: int = K.RATE) -> dict:
    return envelope_shape(K.smoothed_envelope(a, rate), rate)


def _crossing(y: np.ndarray, top: int, level: float, step: int) -> float:
    """Where y falls to the level on one side of a peak, between samples."""
    i = top
    while 0 <= i + step < len(y) and y[i] > level:
        i += step
    return i - step * (level - y[i]) / (y[i - step] - y[i]) if y[i] < level else float(i)


def spectrum_shape(f: np.ndarray, p: np.ndarray) -> dict:
    """Label, main and second peak of a power spectrum between 20 Hz and 1 kHz."""
    step = float(f[1] - f[0]) if len(f) > 1 else 0.0
    band = (f >= 20) & (f <= 1000)
    f, p = f[band], p[band]
    if len(p) < 3 or p.max() <= EPS:
        return _zeros(PSD_FIELDS, psd_morphology="insufficient")
    y = p / (p.max() + EPS)
    found = sorted(K.find_peaks(y, max(1, round(40 / max(step, EPS))), 0.10), key=lambda x: (y[x[0]], x[0]), reverse=True)
    main, strength = found[0] if found else (int(y.argmax()), 0.0)
    lo = hi = float(main)
    width = step
    if found:
        lo, hi = (_crossing(y, main, y[main] - strength / 2, side) for side in (-1, 1))
        width = max(step, (hi - lo) * step)
    inside = slice(max(0, int(np.floor(lo))), int(np.ceil(hi)) + 1)
    total = p.sum() + EPS
    share = np.cumsum(p) / total
    limits = f[np.minimum(np.searchsorted(share, [0.025, 0.975]), len(f) - 1)]
    second = found[1][0] if len(found) > 1 else None
    ratio = float(y[second] / (y[main] + EPS)) if second is not None else 0.0
    high = sum(y[k] >= 0.15 for k in ([k for k, _ in found] or [main]))
    q = f[main] / (width + EPS)
    if strength < 0.10:
        label = "no_clear_peak"
    else:
        label = "multi_peak" if high >= 3 else "double_peak" if high == 2 and ratio >= 0.25 else f"{'narrow' if q >= 4 else 'broad'}_single_peak"
    values = [f[main], high, width, strength, f[second] if second is not None else 0.0, ratio, abs(f[second] - f[main]) if second is not None else 0.0, q, p[inside].sum() / total, *limits]
    return _fields(PSD_FIELDS, values, psd_morphology=label)


def psd_morphology(a, rate: int = K.RATE) -> dict:
    return spectrum_shape(*K.welch(a, rate)) if len(K._x(a)) else _zeros(PSD_FIELDS, psd_morphology="insufficient")


def ridge_shape(times: np.ndarray, hz: np.ndarray, resolution: float) -> dict:
    """Direction, slope and continuity of a dominant-frequency track."""
    if len(times) < 3 or len(hz) != len(times):
        return _zeros(RIDGE_FIELDS, time_frequency_ridge_direction="insufficient")
    slope = _slope(hz, times)
    rest = hz - hz.mean() - slope * (times - times.mean())
    change, least = slope * (times[-1] - times[0]), max(2 * resolution, 50.0)
    values = [np.median(hz[:2]), np.median(hz[-2:]), slope, rest.std(), (np.abs(np.diff(hz)) <= max(2 * resolution, 100.0)).mean()]
    return _fields(RIDGE_FIELDS, values, time_frequency_ridge_direction="rising" if change > least else "falling" if change < -least else "stable")


def wavelet_features(a, rate: int = K.RATE) -> dict:
    """Where the power of a Morlet scalogram lies."""
    x = K._x(a)
    power = K.morlet_scalogram(x, rate) if len(x) >= 8 and (x**2).sum() > EPS and rate > 40 else None
    if power is None:
        return _zeros(WAVELET_FIELDS, wavelet_status="insufficient")
    hz = np.geomspace(20, min(1000, rate / 2), len(power))
    i, j = np.unravel_index(int(power.argmax()), power.shape)
    by_hz = power.sum(1) / (power.sum() + EPS)
    centre = float((hz * by_hz).sum())
    return _fields(WAVELET_FIELDS, [hz[i], j / rate, centre, np.sqrt(((hz - centre) ** 2 * by_hz).sum()), _entropy(power), by_hz.max()], wavelet_status="available")


def observations(a, rate: int = K.RATE) -> dict:
    """All descriptors of a segment in one dict."""
    x = K._x(a)
    if not len(x) or not np.isfinite(x).all() or (x**2).sum() <= EPS:
        none = np.zeros(0)
        plain = _zeros([*AMPLITUDE_FIELDS, *SPECTRUM_FIELDS, *BANDS, *FRAME_FIELDS])
        return plain | wavelet_features(none, rate) | envelope_shape(none, rate) | spectrum_shape(none, none) | ridge_shape(none, none, 0.0)
    raw, peak, rms = K.envelope(x), float(np.abs(x).max()), float(np.sqrt((x**2).mean()))
    f, p = K.welch(x, rate)
    total = p.sum() + EPS
    size = min(128, len(x))
    g, t, s = K.spectrogram(x, rate, size, K.tukey)
    i, j = np.unravel_index(int(s.argmax()), s.shape)
    frames = s / (s.sum(0, keepdims=True) + EPS)
    flux = float(np.linalg.norm(np.diff(frames, axis=1), axis=0).mean()) if s.shape[1] > 1 else 0.0
    track = K.ridge(x, rate) if len(x) >= 4 else {"times": [], "frequencies": []}
    out = _fields(AMPLITUDE_FIELDS, [peak, rms, np.abs(x).mean(), raw.max(), raw.mean(), peak / (rms + EPS)])
    out |= _fields(SPECTRUM_FIELDS, [f[int(p.argmax())], p.max(), rate / min(512, len(x))])
    out |= {k: float(p[(f >= lo) & (f < hi)].sum() / total) for k, (lo, hi) in BANDS.items()}
    out |= _fields(FRAME_FIELDS, [g[i], t[j], s.shape[1], rate / size, size / rate, _entropy(s), flux])
    return out | wavelet_features(x, rate) | envelope_morphology(x, rate) | spectrum_shape(f, p) | ridge_shape(np.array(track["times"]), np.array(track["frequencies"]), rate / size)


def activity_interval(a, rate: int = K.RATE, mads: float = 3.0, least_ms: float = 30.0, gap_ms: float = 20.0) -> dict:
    """Onset and offset by an adaptive threshold on the smoothed envelope, else the 5 to 95 % energy range."""
    x = K._x(a)
    n = len(x)
    if not n or not np.isfinite(x).all() or (x**2).sum() <= EPS:
        return dict.fromkeys(ACTIVITY_FIELDS) | {"activity_detection_method": "silent_or_invalid"}
    width = min(n, max(1, min(round(0.005 * rate), n // 10)))
    e = np.convolve(K.envelope(x) if n > 2 else np.abs(x), np.full(width, 1 / width), "same")
    base = np.percentile(e, 20)
    cut = base + min(mads * 1.4826 * np.median(np.abs(e - base)), 0.60 * (e.max() - base))
    gap = min(max(0, round(gap_ms * rate / 1000)), max(1, n // 10))
    least = min(max(1, round(least_ms * rate / 1000)), max(2, round(0.15 * n)))
    merged: list[list[int]] = []
    for a0, b0 in K.true_runs(e >= cut):
        if merged and a0 - merged[-1][1] <= gap:
            merged[-1][1] = b0
        else:
            merged.append([a0, b0])
    kept = [r for r in merged if r[1] - r[0] >= least]
    power = x**2
    if kept:
        how, onset, offset = "adaptive_envelope", kept[0][0], kept[-1][1]
    else:
        share = np.cumsum(power) / power.sum()
        how, onset, offset = "energy_quantile_fallback", int(np.searchsorted(share, 0.05)), min(n, int(np.searchsorted(share, 0.95)) + 1)
    last = max(1, n - 1)
    lengths = [onset, offset, offset - onset]
    values = [*lengths, *(v / rate for v in lengths), *(v / n for v in lengths), float((np.arange(n) / last * power).sum() / (power.sum() + EPS)), int(e.argmax()) / last, float(cut)]
    return dict(zip(ACTIVITY_FIELDS, values, strict=True)) | {"activity_detection_method": how}


def boundary_robustness(a, rate: int = K.RATE, jitter_ms: float = 10.0) -> dict:
    """How far measures of the active interval move when its ends move by the jitter."""
    x, act = K._x(a), activity_interval(a, rate)
    none = _zeros(ROBUSTNESS_FIELDS, boundary_stability_status="insufficient") | {"boundary_jitter_ms": float(jitter_ms)}
    if act["onset_sample"] is None or len(x) < 8:
        return none
    d = max(1, round(jitter_ms * rate / 1000))
    # As found, one end moved, then both apart and both together.
    moves = [(0, 0), (-d, 0), (d, 0), (0, -d), (0, d), (-d, d), (d, -d)]
    ends = dict.fromkeys((max(0, act["onset_sample"] + i), min(len(x), act["offset_sample"] + j)) for i, j in moves)
    parts = [x[i:j] for i, j in ends if j - i >= 8]
    if not parts:
        return none
    spectra = [psd_morphology(p, rate) for p in parts]
    envelopes = [envelope_morphology(p, rate) for p in parts]
    shapes = [e["envelope_shape"] for e in envelopes]
    ptp = lambda v: float(np.ptp(np.asarray(v, float)))
    rms = [float(np.sqrt((p**2).mean())) for p in parts]
    width = [s["psd_primary_peak_width_hz"] for s in spectra]
    values = [
        jitter_ms, len(parts), ptp(rms) / (rms[0] + EPS), ptp([s["psd_primary_peak_frequency_hz"] for s in spectra]),
        0.0 if set(shapes) == {"constant"} else ptp([e["envelope_time_to_peak_ratio"] for e in envelopes]), ptp(width) / (width[0] + EPS), np.mean([s == shapes[0] for s in shapes]),
    ]
    out = _fields(ROBUSTNESS_FIELDS, values)
    robust = all(out[k] <= most for k, most in ROBUST.items()) and out["boundary_psd_peak_frequency_range_hz"] <= max(50.0, 2 * rate / min(512, len(parts[0]))) and out["boundary_envelope_shape_agreement_ratio"] >= 0.70
    return out | {"boundary_stability_status": "robust" if robust else "sensitive"}


def _ddl(texts: list[str], numbers: list[str]) -> str:
    return ", ".join([*(f"{k} string" for k in texts), *(f"{k} double" for k in numbers)])


KINDS = {
    "envelope_morphology": _ddl(["envelope_shape"], ENVELOPE_FIELDS),
    "psd_morphology": _ddl(["psd_morphology"], PSD_FIELDS),
    "wavelet_features": _ddl(["wavelet_status"], WAVELET_FIELDS),
    "boundary_robustness": _ddl(["boundary_stability_status"], ROBUSTNESS_FIELDS),
    "activity_interval": _ddl(["activity_detection_method"], ACTIVITY_FIELDS[3:]) + ", " + ", ".join(f"{k} int" for k in ACTIVITY_FIELDS[:3]),
}
KINDS["observations"] = ", ".join([_ddl([], [*AMPLITUDE_FIELDS, *SPECTRUM_FIELDS, *BANDS, *FRAME_FIELDS]), KINDS["wavelet_features"], KINDS["envelope_morphology"], KINDS["psd_morphology"], _ddl(["time_frequency_ridge_direction"], RIDGE_FIELDS)])
