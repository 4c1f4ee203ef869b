"""Labels and outcome codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def audit_outcome(label: Column, status: Column) -> Column:
    ok = status == "accepted"
    return (
        F.when(label == "Present", F.when(ok, "present_candidate_accepted").otherwise("present_candidate_missed"))
        .when(label == "Absent", F.when(ok, "absent_candidate_flagged").otherwise("absent_negative_control_clear"))
        .otherwise("unscored_unknown_label")
    )


def interpretation_group(label: Column, outcome: Column) -> Column:
    return (
        F.when(label.isNull() | (label != "Present"), "not_scored")
        .when(outcome == "Normal", "present_normal_outcome_innocent_proxy")
        .when(outcome == "Abnormal", "present_abnormal_outcome_pathological_proxy")
        .otherwise("present_unknown_outcome")
    )


def location_label(label: Column, location: Column, murmur_locations: Column) -> Column:
    """Present holds only where the murmur is heard; Absent holds everywhere."""
    heard = F.array_contains(F.transform(F.split(murmur_locations, "[+]"), lambda x: F.trim(x)), location)
    return F.when(label == "Absent", "Absent").when((label == "Present") & heard, "Present").otherwise("Unknown")


def phase_label(label: Column, timing: Column) -> Column:
    return F.when(label == "Absent", "Absent").when((label == "Present") & timing.isNotNull(), "Present").otherwise("Unknown")


def timing_quality(status: Column, method: Column) -> Column:
    return F.when(status != "accepted", "low_confidence_candidate").when(method == "adaptive_envelope", "accepted_adaptive").otherwise("accepted_energy_fallback")


def predicted_timing(onset: Column, offset: Column, phase: Column) -> Column:
    middle = (onset + offset) * 0.5
    systole = phase == "systole"
    place = F.when(middle < 1 / 3, "Early").when(middle < 2 / 3, "Mid").otherwise("Late")
    whole = (offset - onset >= 0.75) & (onset <= 0.15) & (offset >= 0.85)
    adjective = F.when(systole, "systolic").otherwise("diastolic")
    return F.when(onset.isNull() | offset.isNull(), None).when(whole, F.concat(F.lit("Holo"), adjective)).otherwise(F.concat_ws("-", place, adjective))


def quality_status(assessed: Column, used_fallback: Column, n_selected: Column) -> Column:
    return F.when(~assessed, "not_assessed").when(used_fallback, "fallback").when(n_selected == 0, "no_candidate").otherwise("accepted")


def inference_status(estimate: Column, clusters: Column, failure_rate: Column) -> Column:
    return (
        F.when(estimate.isNull() | F.isnan(estimate), "not_estimable").when(clusters < 8, "descriptive_too_few_independent_patients")
        .when(failure_rate > 0.05, "unstable_bootstrap_over_5pct_failures").otherwise("estimable")
    )


def clean_label(c: Column) -> Column:
    x = F.trim(c)
    return F.when((x != "") & (F.lower(x) != "nan"), x)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def feature_transition(before: Column, after: Column) -> Column:
    word = lambda c: F.when(c, "valid").otherwise("invalid")
    return F.concat_ws("_to_", word(before), word(after))


def high_quality_score(*conditions: Column) -> Column:
    """How many conditions hold; an unknown one doesn't."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    return total


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
