"""Scalar formulas of energy, emissions and job measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joules of a kWh, floor of the bounded slowdown in seconds.
JOULES_PER_KWH = 3_600_000.0
SLOWDOWN_FLOOR_S = 10.0


def finite(value: Column, what: str) -> Column:
    """The value; an overflow to infinity or NaN raises instead of passing on."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{what} is outside the range of doubles")).cast("double")).otherwise(value)


def energy_kwh(watts: Column, seconds: Column) -> Column:
    """Energy of constant power. Negative or non-finite input raises."""
    bad = (watts < 0) | (seconds < 0) | F.isnan(watts) | F.isnan(seconds)
    checked = F.when(bad, F.raise_error(F.lit("power and duration must be non-negative")).cast("double")).otherwise(watts * seconds / JOULES_PER_KWH)
    return finite(checked, "energy")


def scheduling_run_s() -> Column:
    """What planning may know of a runtime: the prediction, else the actual one."""
    return F.coalesce(F.col("pred_run_s"), F.col("run_s"))


def scheduling_avg_w() -> Column:
    return F.coalesce(F.col("pred_avg_w"), F.col("avg_w"))


def estimate_s(source: str) -> Column:
    """Planning estimate: 'time_limit' (scheduling runtime where there is none) or 'scheduling'."""
    if source == "time_limit":
        return F.coalesce(F.col("limit_s"), scheduling_run_s())
    if source == "scheduling":
        return scheduling_run_s()
    raise ValueError(f"unknown runtime estimate: {source}")


def bounded_slowdown(wait_s: Column, run_s: Column, floor_s: float = SLOWDOWN_FLOOR_S) -> Column:
    return F.greatest(F.lit(1.0), (wait_s + run_s) / F.greatest(run_s, F.lit(float(floor_s))))


def tonnes(grams: Column) -> Column:
    return grams / 1e6


def megawatt_hours(kwh: Column) -> Column:
    return kwh / 1e3


def megawatts(watts: Column) -> Column:
    return watts / 1e6


def slug(text: Column) -> Column:
    """Lower-case file name part: runs of other characters than letters and digits become one underscore."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]", "_"), F.lit("_"))
