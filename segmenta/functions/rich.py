"""A wide vector of audio features: cepstra and their deltas, an energy profile, spectral measures and onsets, 187 in all; and the
image of a segment's mel spectrogram."""

from __future__ import annotations

import numpy as np

from segmenta.functions import kernels as K

EPS = K.EPS
#: Transform size, step, mel bands, cepstra and energy segments.
SIZE, STEP, MELS, CEPSTRA, PARTS = 2048, 512, 128, 40, 10
#: Channel means and deviations of image models.
CHANNEL_MEAN, CHANNEL_STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]
STATISTICS = ["energy_centroid", "energy_half_ratio", "energy_skew", "energy_kurtosis", "energy_max_pos", "energy_std"]
SPECTRAL = ["spec_centroid", "spec_rolloff", "spec_bandwidth", "zcr"]
NAMES = [
    *(f"mfcc_{s}_{i}" for i in range(CEPSTRA) for s in ("mean", "std")), *(f"delta_{s}_{i}" for i in range(CEPSTRA) for s in ("mean", "std")), *(f"energy_seg_{i}" for i in range(PARTS)), *STATISTICS,
    *(f"{x}_{s}" for x in SPECTRAL for s in ("mean", "std")), "onset_mean", "onset_max", "onset_time_max",
]


def to_mel(hz):
    """Linear up to 1 kHz (15 mel), logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1000) / 1000) * 27 / np.log(6.4))


def from_mel(mel):
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def bank(n: int, size: int, rate: int) -> np.ndarray:
    """Triangles of equal area."""
    f, edge = np.fft.rfftfreq(size, 1 / rate), from_mel(np.linspace(to_mel(0), to_mel(rate / 2), n + 2))
    rise, fall = (f - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - f) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def framed(x: np.ndarray, size: int, step: int, mode: str = "constant") -> np.ndarray:
    return K.frames(np.pad(x, size // 2, mode=mode), size, step)


def magnitudes(x: np.ndarray, size: int = SIZE, step: int = STEP) -> np.ndarray:
    """[frequency, frame] of centred, windowed frames."""
    return np.abs(np.fft.rfft(framed(x, size, step) * K.hann(size), axis=1)).T


def decibels(power: np.ndarray, reference: float = 1.0, span: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, 1e-10) / max(reference, 1e-10))
    return np.maximum(db, db.max() - span)


def cepstra(mel_db: np.ndarray, n: int = CEPSTRA) -> np.ndarray:
    k = len(mel_db)
    basis = np.sqrt(2 / k) * np.cos(np.pi / k * np.outer(np.arange(n), np.arange(k) + 0.5))
    basis[0] /= np.sqrt(2)
    return basis @ mel_db


def deltas(c: np.ndarray) -> np.ndarray:
    """Slopes over up to nine frames; the ends take those of the first and last whole window."""
    n = c.shape[1]
    if n < 3:
        return np.zeros((len(c), 1))
    width = max(3, min(9, n if n % 2 else n - 1))
    t = np.arange(width) - width // 2
    slope = np.lib.stride_tricks.sliding_window_view(c, width, axis=1) @ (t / (t**2).sum())
    return np.concatenate([np.repeat(slope[:, :1], width // 2, 1), slope, np.repeat(slope[:, -1:], width // 2, 1)], 1)


def _moments(x: np.ndarray) -> tuple[float, float]:
    d = x - x.mean()
    v = (d**2).mean()
    return (float((d**3).mean() / v**1.5), float((d**4).mean() / v**2 - 3)) if v > 1e-24 else (np.nan, np.nan)


def features(a, rate: int = K.RATE) -> dict:
    """Every feature by its name; NaN where one isn't defined."""
    x = K._x(a)
    if not len(x):
        return dict.fromkeys(NAMES, float("nan"))
    mag = magnitudes(x)
    db = decibels(bank(MELS, SIZE, rate) @ mag**2)
    c = cepstra(db)
    d = deltas(c)
    step = max(1, len(x) // PARTS)
    parts = [x[i * step : (i + 1) * step] for i in range(PARTS)]
    e = np.array([np.sqrt((p**2).mean()) if len(p) else 0.0 for p in parts])
    half = e[PARTS // 2 :].sum() + 1e-8
    f = np.fft.rfftfreq(SIZE, 1 / rate)[:, None]
    share = mag / np.maximum(mag.sum(0), 1e-30)
    centroid = (f * share).sum(0)
    cum = np.cumsum(mag, 0)
    rolloff = f[:, 0][(cum >= 0.85 * cum[-1]).argmax(0)]
    sign = np.signbit(framed(x, SIZE, STEP, "edge"))
    per_frame = [centroid, rolloff, np.sqrt((share * (f - centroid) ** 2).sum(0)), (sign[:, 1:] != sign[:, :-1]).sum(1) / SIZE]
    rise = np.maximum(0, np.diff(db, axis=1)).mean(0) if db.shape[1] > 1 else np.zeros(0)
    onset = np.concatenate([np.zeros(1 + SIZE // (2 * STEP)), rise])[: db.shape[1]]
    values = [v for row in zip(c.mean(1), c.std(1), strict=True) for v in row] + [v for row in zip(d.mean(1), d.std(1), strict=True) for v in row] + e.tolist()
    values += [(np.arange(PARTS) * e).sum() / (e.sum() + 1e-8), e[: PARTS // 2].sum() / half, *_moments(e), e.argmax(), e.std()]
    values += [v for y in per_frame for v in (y.mean(), y.std())] + [onset.mean(), onset.max(), onset.argmax() / (len(onset) + 1e-8)]
    return dict(zip(NAMES, map(float, values), strict=True))


def image(a, rate: int = K.RATE, side: int = 224, mels: int = 128, size: int = 512, step: int = 128) -> np.ndarray:
    """[3, side, side]: a mel spectrogram in decibels, brought to 0..1 in steps of 1/255, resized, and scaled by channel."""
    x = np.nan_to_num(K._x(a), posinf=0.0, neginf=0.0)
    size = max(2, min(size, len(x)) // 2 * 2)
    power = bank(mels, size, rate) @ magnitudes(x, size, max(1, min(step, size // 2))) ** 2
    m = decibels(power, float(power.max()))
    span = float(np.ptp(m))
    m = np.floor((m - m.min()) / span * 255) / 255 if span >= 1e-6 else np.zeros_like(m)
    for axis in (0, 1):
        n = m.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, n - 1)
        w = (at - lo)[:, None] if axis == 0 else at - lo
        m = np.take(m, lo, axis) * (1 - w) + np.take(m, hi, axis) * w
    return (m[None] - np.array(CHANNEL_MEAN)[:, None, None]) / np.array(CHANNEL_STD)[:, None, None]
