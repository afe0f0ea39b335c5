"""Ordered quality gates: the first condition that holds names the state.

The thresholds in the conditions are fixed values, as they tell the states.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import known_state
from .spectral import CANONICAL, nearest_canonical


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def inadequacies(c: dict[str, Column]) -> Column:
    """Why one power law does not describe a spectrum; an empty array if it does.

    c: beta, rmse_db, smooth_db, smooth_mad_db, normalized_flatness, occupancy,
    of the plain hinge delta, improvement, relative, evidence, and the same of
    the one adjusted for a smooth curve with abrupt_ before them.
    """
    colored = (c["rmse_db"] > 2.2) | (c["smooth_db"] > 6)
    abrupt = (c["abrupt_delta"] >= 0.6) & (c["abrupt_improvement"] >= 0.04) & (c["abrupt_relative"] >= 0.35) & (c["abrupt_evidence"] >= 0.8)
    subtle = (c["smooth_db"] <= 5.5) & (c["delta"] >= 0.55) & (c["improvement"] >= 0.012) & (c["relative"] >= 0.18) & (c["evidence"] >= 0.2) & (c["abrupt_delta"] >= 0.35)
    irregular = (c["smooth_rmse_db"] > 1.5) & (c["smooth_mad_db"] > 1.1) & (c["rmse_db"] > 3.8)
    rules = {
        "exponent out of range": ~c["beta"].between(-2.8, 2.8), "poor fit": c["rmse_db"] > 5.8, "slope change": abrupt | subtle, "curved": c["smooth_db"] > 22,
        "irregular": irregular, "narrow band": colored & ((c["normalized_flatness"] < 0.18) | (c["occupancy"] < 0.65)),
    }
    return F.array_compact(F.array(*[F.when(_true(x), name) for name, x in rules.items()]))


def is_tonal(prominence: Column, ratio: Column, flat: Column, harmonic: Column, evidence: Column, peaks: Column, occupancy: Column) -> Column:
    rungs = [
        (prominence >= 18) & (ratio >= 0.3) & (flat < 0.72), (prominence >= 22) & (ratio >= 0.15) & (flat < 0.9), (prominence >= 30) & (ratio >= 0.025),
        (harmonic >= 3) & (evidence >= 0.55) & (ratio >= 0.02), (peaks >= 4) & (ratio >= 0.06) & (flat < 0.72), (flat < 0.08) & (occupancy < 0.55),
    ]
    out = F.lit(False)
    for r in rungs:
        out = out | _true(r)
    return out


def quality_gate(c: dict[str, Column]) -> Column:
    """struct(state, confidence, reliable) from durations, levels, tonality, fit and stability (columns in c).

    A missing deviation counts as 0. Only the five colors are reliable.
    """
    sd = F.coalesce(c["temporal_sd"], F.lit(0.0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    reasons = inadequacies(c)
    state = (
        F.when(bad(c["duration"]) | (c["duration"] < 0) | (c["non_finite"] > 0) | bad(c["rms"]), "invalid")
        .when(c["duration"] < 1.5, "insufficient").when(c["dbfs"] < -58, "silence")
        .when(_true((c["clipping"] > 0.001) | (c["near_clipping"] > 0.01) | (c["peak"] >= 0.9999) | c["limiting"]), "clipping")
        .when(is_tonal(c["prominence_db"], c["tonal_ratio"], c["normalized_flatness"], c["harmonic_peaks"], c["harmonic_evidence"], c["peaks"], c["occupancy"]), "tonal")
        .when(bad(c["beta"]) | (F.size(reasons) > 0), "mixed").when(sd > 0.55, "unstable").otherwise(nearest_canonical(c["beta"]))
    )
    distance = F.array_min(F.array(*[F.abs(c["beta"] - b) for _, b in CANONICAL]))
    colored = (c["rmse_db"] > 2.2) | (c["smooth_db"] > 6)
    grade = F.when(~colored & (distance <= 0.3) & (sd <= 0.16), "High").when((c["rmse_db"] <= 4.6) & (distance <= 0.55) & (sd <= 0.35), "Moderate").otherwise("Low")
    reliable = state.isin([name for name, _ in CANONICAL])
    return F.struct(state.alias("state"), F.when(reliable, grade).alias("confidence"), reliable.alias("reliable"), reasons.alias("reasons"))


def activity_state(samples: Column, non_finite: Column, dbfs: Column, clipped: Column, fallback: Column) -> Column:
    """The state of a short frame: what its level says, else the nearest observation's, "insufficient" for one that isn't known."""
    return (
        F.when((samples == 0) | (non_finite > 0), "invalid").when(dbfs < -58, "silence").when(_true(clipped), "clipping")
        .when(fallback.isNull(), "insufficient").when(fallback == "silence", "mixed").otherwise(known_state(fallback))
    )


def recording_state(state: Column, reliable: Column, temporal_sd: Column, rejected_percent: Column, top_rejected: Column) -> Column:
    """A recording's state once its windows are known: unstable, or what a fifth of it was rejected for."""
    return F.when(_true(temporal_sd > 0.55), "unstable").when(_true(reliable & (rejected_percent >= 20)), top_rejected).otherwise(state)
