"""Energy and emissions of jobs: a power profile integrated against the carbon signal.

A job's runtime is cut into segments of its sampling interval; a segment's energy is its power times its
length, its carbon intensity that of the bucket its start lies in. Segments are summed per bucket within the row, so
what is exploded is one narrow row per bucket a job overlaps, never per segment, and no profile leaves its row: one hash
join on the bucket and one grouped sum with map-side combination; energy needs no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError, CoverageError
from ..functions.constraints import require_empty
from ..functions.physics import JOULES_PER_KWH, energy_kwh, finite
from ..functions.timegrid import seconds_us
from ..schemas import BUCKET_US
from . import signal as sig

MODELS = ("average", "measured")


def segment_count(run_s: Column | None = None, interval_s: Column | None = None) -> Column:
    """Segments that cover a runtime: the quotient if it is whole within 1e-12, else its ceiling; one at least."""
    run, iv = F.col("run_s") if run_s is None else run_s, F.col("interval_s") if interval_s is None else interval_s
    q = run / iv
    near = F.rint(q)
    close = F.abs(q - near) <= F.greatest(F.lit(1e-12) * F.greatest(F.abs(q), F.abs(near)), F.lit(1e-12))
    return F.greatest(F.lit(1), F.when(close, near).otherwise(F.ceil(q)).cast("int"))


def coverage_ok() -> Column:
    """A profile covers its runtime within one interval."""
    slack = F.col("interval_s") + F.greatest(F.lit(1e-9), F.col("interval_s") * 1e-12)
    return F.abs(F.size("profile_w") * F.col("interval_s") - F.col("run_s")) <= slack


def _held(i: Column) -> Column:
    """Power of segment i: excess samples are never reached, missing ones hold the last."""
    return F.get(F.col("profile_w"), F.least(i, F.size("profile_w") - 1))


def _folded(scale: Column | float = 1.0) -> Column:
    """Sum of power times length over all segments, power divided by scale: one plain fold over the profile.

    All segments but the last are one interval long; what the profile lacks before it is its last sample held.
    """
    n, size = segment_count(), F.size("profile_w")
    whole = F.aggregate(F.slice("profile_w", F.lit(1), F.least(n - 1, size)), F.lit(0.0), lambda a, x: a + x / scale)
    held = F.greatest(n - 1 - size, F.lit(0)) * (F.get(F.col("profile_w"), size - 1) / scale)
    last = (_held(n - 1) / scale) * (F.col("run_s") - (n - 1) * F.col("interval_s"))
    return (whole + held) * F.col("interval_s") + last


def weighted_mean_power() -> Column:
    """Duration-weighted mean of a profile, scaled by its largest used sample and clamped to it."""
    used = F.array_max(F.slice("profile_w", F.lit(1), F.least(segment_count(), F.size("profile_w"))))
    # The largest sample is bound once per row, as the one element of an array.
    mean = F.transform(F.array(used), lambda top: F.when(top == 0, F.lit(0.0)).otherwise(top * F.least(_folded(top) / F.col("run_s"), F.lit(1.0))))
    return F.when(F.col("profile_w").isNull(), F.col("avg_w")).otherwise(F.get(mean, F.lit(0)))


def measured_energy() -> Column:
    """Energy of the measured profile within the row, without an explode."""
    return finite(_folded() / JOULES_PER_KWH, "energy")


def segments(jobs: DataFrame, model: str = "measured") -> DataFrame:
    """Jobs with seg, offset_s, length_s, power_w and kwh of each segment. measured: a profile with a gap raises."""
    if model not in MODELS:
        raise ValueError(f"unknown power model: {model}")
    n = segment_count()
    rows = jobs.withColumn("__n", n).withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    offset = F.col("seg") * F.col("interval_s")
    end = F.when(F.col("seg") == F.col("__n") - 1, F.col("run_s")).otherwise((F.col("seg") + 1) * F.col("interval_s"))
    if model == "average":
        power = F.col("avg_w")
    else:
        gap = F.raise_error(F.lit("a profile and its runtime differ by more than one interval")).cast("double")
        power = F.when(F.col("profile_w").isNull(), F.col("avg_w")).when(coverage_ok(), _held(F.col("seg"))).otherwise(gap)
    rows = rows.withColumn("offset_s", offset).withColumn("length_s", end - offset).withColumn("power_w", power)
    return rows.withColumn("kwh", F.col("power_w") * F.col("length_s") / JOULES_PER_KWH).drop("__n")


def _at(start: str) -> Column:
    """Start of a segment in microseconds: elapsed time in UTC, so no clock change shifts it."""
    return F.col(start) + seconds_us(F.col("offset_s"))


def _per_bucket(start: str, grid_us: int, model: str) -> str:
    """SQL array of (bucket_us, kwh, kwh_avg), one per bucket in which segments of the row start, for a run from `start` on.

    Reads run_s, interval_s, avg_w, profile_w and __n, the number of segments. Segment i starts rint(1e6 i interval_s)
    after the run. measured: a profile with a gap raises; missing samples hold the last one.
    """
    at = lambda i: f"cast(rint(({i}) * interval_s * 1e6D) as bigint)"
    floor = lambda x: f"(({x}) - pmod({x}, {grid_us}L))"
    first, last = floor(start), floor(f"{start} + {at('__n - 1')}")
    # The first segment that starts at or after a bucket; the quotient may be off by a rounded microsecond.
    guess = f"cast(ceil((b - {start}) / (interval_s * 1e6D)) as int)"
    lo = f"CASE WHEN b <= {start} THEN 0 ELSE transform(array({guess}), i -> CASE WHEN i > 0 AND {at('i - 1')} >= b - {start} THEN i - 1 WHEN {at('i')} >= b - {start} THEN i ELSE i + 1 END)[0] END"
    cuts = f"transform(sequence({first}, {last}, {grid_us}L), b -> {lo})"
    hi = "CASE WHEN k + 1 < size(los) THEN los[k + 1] ELSE __n END"
    whole = "(least(x.hi, __n - 1) - x.lo)"
    tail = "CASE WHEN x.hi = __n THEN run_s - (__n - 1) * interval_s ELSE 0D END"
    average = f"avg_w * ({whole} * interval_s + {tail}) / {JOULES_PER_KWH}D"
    size = "size(profile_w)"
    summed = f"aggregate(slice(profile_w, x.lo + 1, greatest(0, least(x.hi, __n - 1, {size}) - x.lo)), 0D, (a, y) -> a + y)"
    held = f"greatest(0, least(x.hi, __n - 1) - greatest(x.lo, {size})) * profile_w[{size} - 1]"
    measured = f"(({summed} + {held}) * interval_s + CASE WHEN x.hi = __n THEN profile_w[least(__n, {size}) - 1] * ({tail}) ELSE 0D END) / {JOULES_PER_KWH}D"
    power = average if model == "average" else f"CASE WHEN profile_w IS NULL THEN {average} ELSE {measured} END"
    spans = f"filter(transform(array({cuts}), los -> transform(los, (lo, k) -> named_struct('bucket_us', {first} + k * {grid_us}L, 'lo', lo, 'hi', {hi})))[0], x -> x.hi > x.lo)"
    return f"transform({spans}, x -> named_struct('bucket_us', x.bucket_us, 'kwh', {power}, 'kwh_avg', {average}))"


def _checked(jobs: DataFrame, model: str) -> DataFrame:
    """jobs with __n, the number of their segments; a measured profile that doesn't cover its runtime raises."""
    if model not in MODELS:
        raise ValueError(f"unknown power model: {model}")
    n = segment_count()
    if model == "measured":
        gap = F.raise_error(F.lit("a profile and its runtime differ by more than one interval")).cast("int")
        n = F.when(F.col("profile_w").isNull() | coverage_ok(), n).otherwise(gap)
    return jobs.withColumn("__n", n)


def account(jobs: DataFrame, signal: DataFrame | float, start: str = "start_us", model: str = "measured", grid_us: int = BUCKET_US, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """keys, start_us, end_us, kwh, gco2e per job started at `start`; signal: a series, or one constant intensity."""
    run_us = seconds_us(F.col("run_s"))
    average = energy_kwh(F.col("avg_w"), F.col("run_s"))
    if isinstance(signal, (int, float)):
        if not 0 <= signal < float("inf"):
            raise ValueError("a constant intensity must be finite and not negative")
        kwh = average if model == "average" else F.when(F.col("profile_w").isNull(), average).otherwise(measured_energy())
        return jobs.select(*keys, F.col(start).alias("start_us"), (F.col(start) + run_us).alias("end_us"), kwh.alias("kwh"), finite(kwh * float(signal), "emissions").alias("gco2e"))
    own = jobs.withColumn("profile_w", F.lit(None).cast("array<double>")) if model == "average" else jobs
    rows = _checked(own, model).select(*keys, F.col(start).alias("__start"), (F.col(start) + run_us).alias("__end"), average.alias("__avg"), F.expr(_per_bucket(f"`{start}`", grid_us, model)).alias("__parts"))
    rows = sig.lookup(rows.select(*keys, "__start", "__end", "__avg", F.inline("__parts")), "bucket_us", signal, grid_us)
    total = rows.groupBy(*keys).agg(
        F.first("__start").alias("start_us"), F.first("__end").alias("end_us"), F.sum("kwh").alias("__kwh"), F.first("__avg").alias("__avg"), F.sum(F.col("kwh") * F.col("ci")).alias("gco2e"),
    )
    # Average energy is that of the whole runtime; only emissions need its buckets.
    return total.select(*keys, "start_us", "end_us", finite(F.col("__avg" if model == "average" else "__kwh"), "energy").alias("kwh"), finite(F.col("gco2e"), "emissions").alias("gco2e"))


def check_coverage(runs: DataFrame, signal: DataFrame, grid_us: int = BUCKET_US) -> None:
    """Raise if a schedule leaves the signal's coverage, before any accounting."""
    span = runs.agg(F.min("start_us").alias("a"), F.max("end_us").alias("b")).first()
    ends = sig.coverage(signal, grid_us).first()
    if span["a"] is not None and (ends[0] is None or span["a"] < ends[0] or span["b"] > ends[1]):
        raise CoverageError(f"the schedule spans {span['a']} to {span['b']}, outside the signal's {ends[0]} to {ends[1]}")


def account_runs(runs: DataFrame, jobs: DataFrame, signal: DataFrame, grid_us: int = BUCKET_US) -> DataFrame:
    """runs with kwh, gco2e, kwh_avg_model and gco2e_avg_model per (scenario, job), both models in one pass.

    Jobs of a run that aren't in jobs raise. A job's runs are gathered first (one start per scenario), so each profile is
    shuffled once, however many scenarios there are.
    """
    require_empty(runs.select("job_id").distinct().join(jobs.select("job_id"), "job_id", "left_anti"), "no job for a run", ConstraintError)
    check_coverage(runs, signal, grid_us)
    starts = runs.groupBy("job_id").agg(F.collect_list(F.struct("scenario_id", "start_us")).alias("__runs"))
    rows = _checked(jobs.select("job_id", "run_s", "interval_s", "avg_w", "profile_w").join(starts, "job_id"), "measured")
    per_run = f"transform(__runs, s -> transform({_per_bucket('s.start_us', grid_us, 'measured')}, p -> named_struct('scenario_id', s.scenario_id, 'bucket_us', p.bucket_us, 'kwh', p.kwh, 'kwh_avg', p.kwh_avg)))"
    rows = rows.select("job_id", (F.col("avg_w") * F.col("run_s") / JOULES_PER_KWH).alias("__avg"), F.col("profile_w").isNull().alias("__plain"), F.inline(F.flatten(F.expr(per_run))))
    rows = sig.lookup(rows, "bucket_us", signal, grid_us)
    total = rows.groupBy("scenario_id", "job_id").agg(
        F.sum("kwh").alias("__kwh"), F.sum(F.col("kwh") * F.col("ci")).alias("gco2e"), F.first("__avg").alias("kwh_avg_model"),
        F.sum(F.col("kwh_avg") * F.col("ci")).alias("gco2e_avg_model"), F.first("__plain").alias("__plain"),
    )
    total = total.withColumn("kwh", F.when(F.col("__plain"), F.col("kwh_avg_model")).otherwise(F.col("__kwh"))).drop("__kwh", "__plain")
    return runs.join(total, ["scenario_id", "job_id"])


def totals(accounted: DataFrame) -> DataFrame:
    """scenario_id, kwh, gco2e over all jobs; nulls don't count."""
    return accounted.groupBy("scenario_id").agg(F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("kwh"), F.coalesce(F.sum("gco2e"), F.lit(0.0)).alias("gco2e"))
