"""Checks that stop a plan before it runs: model inputs, descriptors, output paths, phase masks, configurations."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features a model may see, and columns it must never see.
CORE_INPUTS = ["tier_a_relative_murmur_duration", "tier_a_temporal_midpoint_normalized", "tier_a_murmur_rms_relative_s1_s2_db"]
EXPLORATORY_INPUTS = [
    "tier_a_envelope_peak_position_normalized", "tier_a_envelope_rise_slope_robust", "tier_a_envelope_fullness", "tier_a_psd_dominant_frequency_hz", "tier_a_psd_bandwidth_95_hz", "tier_a_psd_entropy_normalized",
]
PROHIBITED_INPUTS = [
    "Outcome", "clinical_outcome", "patient_id", "Patient ID", "recording_id", "location", "murmur_locations", "Murmur locations", "most_audible_location", "Most audible location", "candidate_quality_status",
    "phase_selection_used_fallback", "candidate_status", "config_hash", "reconstruction_error", "s1_leakage_ratio", "s2_leakage_ratio", "outside_murmur_energy_ratio", "murmur_region_energy_retention",
]
#: What an expert wrote down, by the beginnings of its columns.
DESCRIPTORS = ("expert_", *(f"{phase}_{what}" for phase in ("systole", "diastole") for what in ("timing", "shape", "pitch", "grading", "quality")))
PHASES = ("s1", "systole", "s2", "diastole")


def model_inputs(df: DataFrame, columns: list[str], allowed: list[str] | None = None) -> DataFrame:
    """The columns of df that a model is given; fails for one that it must not see or that isn't among the allowed."""
    allowed = CORE_INPUTS + EXPLORATORY_INPUTS if allowed is None else allowed
    if bad := sorted({*columns} & {*PROHIBITED_INPUTS}):
        raise ValueError(f"a model must not see {bad}")
    if unknown := sorted({*columns} - {*allowed}):
        raise ValueError(f"not among the frozen inputs: {unknown}")
    return df.select(*columns)


def without_descriptors(df: DataFrame, columns: list[str]) -> DataFrame:
    """A projection (each column once) that fails if it would hold a descriptor."""
    columns = list(dict.fromkeys(columns))
    if leaked := [c for c in columns if c.startswith(DESCRIPTORS)]:
        raise ValueError(f"descriptor columns would leak: {leaked}")
    return df.select(*columns)


def _parts(uri: str) -> tuple[str, list[str]]:
    x = urlsplit(uri)
    out: list[str] = []
    for p in x.path.split("/"):
        if p == "..":
            out = out[:-1]
        elif p not in ("", "."):
            out.append(p)
    return f"{x.scheme or 'file'}://{x.netloc}", out


def isolated(source: str, target: str) -> str:
    """The target, unless one of the two paths lies within the other."""
    (a, x), (b, y) = _parts(source), _parts(target)
    if a == b and x[: len(y)] == y[: len(x)]:
        raise ValueError(f"source and target overlap: {source}, {target}")
    return target


def phase_masks(masks: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """The four masks as booleans; fails where one is missing, of another length or empty, or where two overlap."""
    fault = mask_fault({k: np.asarray(masks[k], bool) for k in PHASES if k in masks}, n)
    if fault:
        raise ValueError(fault)
    return {k: np.asarray(masks[k], bool) for k in PHASES}


def mask_fault(masks: dict[str, np.ndarray], n: int) -> str | None:
    for k in PHASES:
        if k not in masks:
            return f"{k}:missing"
        if masks[k].shape != (n,):
            return f"{k}:wrong_length"
        if not masks[k].any():
            return f"{k}:empty"
    return "overlap" if sum(m.astype(int) for m in masks.values()).max() > 1 else None


def mask_fault_column(n: Column, **masks: Column) -> Column:
    """The same over columns of 0/1 arrays: the first fault, null if there is none."""
    out = F.lit(None).cast("string")
    total = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x.cast("int"))
    both = None
    for m in masks.values():
        both = m if both is None else F.zip_with(both, m, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    out = F.when(F.array_max(both) > 1, "overlap")
    for k in reversed(PHASES):
        if k not in masks:
            out = F.lit(f"{k}:missing")
            continue
        m = masks[k]
        out = F.when(m.isNull(), f"{k}:missing").when(F.size(m) != n, f"{k}:wrong_length").when(total(m) == 0, f"{k}:empty").otherwise(out)
    return out


@dataclass(frozen=True)
class SeparationConfig:
    """Limits of a separation; checked when made, hashed by their canonical JSON."""

    window: int = 100
    method: str = "zcr"
    noise_energy: float = 1e-5
    high_frequency: float = 0.80
    phase_focus: float = 0.12
    phase_ratio: float = 0.20
    energy_share: float = 0.99
    target_phase: str = "systole"
    seed: int = 42

    def __post_init__(self):
        shares = ("noise_energy", "high_frequency", "phase_focus", "energy_share")
        faults = [k for k in shares if not 0 <= getattr(self, k) <= 1]
        faults += ["window"] * (self.window < 2) + ["method"] * (self.method not in ("zcr", "kurtosis", "compare")) + ["target_phase"] * (self.target_phase not in ("systole", "diastole")) + ["phase_ratio"] * (self.phase_ratio < 0)
        if faults:
            raise ValueError(f"out of their domain: {faults}")

    def to_dict(self) -> dict:
        return asdict(self)

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
