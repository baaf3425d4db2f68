"""Carbon-signal operators: validated series, lookups, prefix integrals, best start times.

The signal is piecewise constant on half-open buckets of a grid. As-of lookups are equi-joins on
the bucket, and any window's mean is two lookups in a running integral, never a range join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..errors import ForecastError, MissingBucketError, SignalError
from ..functions.constraints import duplicates, require_empty, signal_rules, small, violations
from ..functions.physics import energy_kwh, scheduling_avg_w, scheduling_run_s
from ..functions.timegrid import bucket_floor, seconds_us
from ..schemas import BUCKET_US


def build_series(samples: DataFrame, grid_us: int = BUCKET_US) -> DataFrame:
    """The samples in time order, after checking grid, values and uniqueness."""
    if grid_us <= 0:
        raise ValueError("granularity must be positive")
    if samples.isEmpty():
        raise SignalError("a signal needs at least one sample")
    require_empty(violations(samples, signal_rules(grid_us), "bucket_us"), "invalid samples", SignalError)
    require_empty(duplicates(samples, "bucket_us"), "repeated buckets", SignalError)
    return samples.orderBy("bucket_us")


def merge_samples(samples: DataFrame) -> DataFrame:
    """Samples of several sources as one: equal repeats collapse, conflicting ones raise."""
    merged = samples.dropDuplicates()
    require_empty(duplicates(merged, "bucket_us"), "conflicting values for a bucket", SignalError)
    return merged


def missing_buckets(signal: DataFrame, start_us: int, end_us: int, grid_us: int = BUCKET_US) -> DataFrame:
    """Buckets of [start, end) that the signal lacks."""
    spark = signal.sparkSession
    first, count = start_us - start_us % grid_us, -(-(end_us - (start_us - start_us % grid_us)) // grid_us)
    grid = spark.range(count).select((F.col("id") * grid_us + first).alias("bucket_us"))
    return grid.join(signal.select("bucket_us"), "bucket_us", "left_anti")


def coverage(signal: DataFrame, grid_us: int = BUCKET_US) -> DataFrame:
    """One row: coverage_start_us, coverage_end_us (exclusive)."""
    return signal.agg(F.min("bucket_us").alias("coverage_start_us"), (F.max("bucket_us") + grid_us).alias("coverage_end_us"))


def _or_raise(value: Column, at: Column) -> Column:
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("no carbon intensity for bucket "), at.cast("string"))).cast("double")).otherwise(value)


def lookup(df: DataFrame, at_us: str, signal: DataFrame, grid_us: int = BUCKET_US, into: str = "ci", strict: bool = True) -> DataFrame:
    """df with the signal's value at each instant; with strict an absent bucket raises when it is read."""
    side = small(signal.select(F.col("bucket_us").alias("__bucket"), F.col("ci").alias("__ci")))
    joined = df.join(side, bucket_floor(F.col(at_us), grid_us) == F.col("__bucket"), "left")
    value = _or_raise(F.col("__ci"), bucket_floor(F.col(at_us), grid_us)) if strict else F.col("__ci")
    return joined.withColumn(into, value).drop("__bucket", "__ci")


def range_lookup(df: DataFrame, start_us: str, end_us: str, signal: DataFrame, grid_us: int = BUCKET_US) -> DataFrame:
    """One row per row of df and bucket that overlaps its [start, end). An empty range or absent bucket raises."""
    bad = F.col(end_us) <= F.col(start_us)
    first = F.when(bad, F.raise_error(F.lit("a range must end after it starts")).cast("long")).otherwise(bucket_floor(F.col(start_us), grid_us))
    grid = F.sequence(first, F.greatest(bucket_floor(F.col(start_us), grid_us), F.col(end_us) - 1), F.lit(grid_us))
    return lookup(df.withColumn("bucket_us", F.explode(grid)), "bucket_us", signal, grid_us)


def with_integral(signal: DataFrame, grid_us: int = BUCKET_US) -> DataFrame:
    """bucket_us, ci, cum: the integral of the signal (per second) from its first bucket to this one's start. Gaps raise."""
    order = Window.orderBy("bucket_us")  # one bounded series
    before = F.lag("bucket_us").over(order)
    ci = F.when(F.col("bucket_us") - before != grid_us, F.raise_error(F.lit("the signal has a gap")).cast("double")).otherwise(F.col("ci"))
    total = F.sum(F.col("ci") * (grid_us / 1e6)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return signal.select("bucket_us", ci.alias("ci"), F.coalesce(total, F.lit(0.0)).alias("cum"))


def _integral_to(df: DataFrame, at_us: str, into: str, integral: DataFrame, first: int, last: int, grid_us: int) -> DataFrame:
    """Adds the integral up to an instant; the end of coverage belongs to the last bucket."""
    bucket = F.least(bucket_floor(F.col(at_us), grid_us), F.lit(last))
    side = small(integral.select(F.col("bucket_us").alias("__b"), F.col("ci").alias("__c"), F.col("cum").alias("__s")))
    outside = (F.col(at_us) < first) | (F.col(at_us) > last + grid_us)
    value = F.when(outside | F.col("__s").isNull(), F.raise_error(F.lit("a window leaves the signal's coverage")).cast("double")).otherwise(
        F.col("__s") + (F.col(at_us) - F.col("__b")) / 1e6 * F.col("__c")
    )
    return df.join(side, bucket == F.col("__b"), "left").withColumn(into, value).drop("__b", "__c", "__s")


def mean_intensity(df: DataFrame, start_us: str, end_us: str, signal: DataFrame, grid_us: int = BUCKET_US, into: str = "mean_ci") -> DataFrame:
    """df with the signal's time-weighted mean over [start, end): two lookups in the running integral."""
    bounds = signal.agg(F.min("bucket_us").alias("a"), F.max("bucket_us").alias("b")).first()
    if bounds["a"] is None:
        raise SignalError("the signal is empty")
    integral = with_integral(signal, grid_us)
    out = _integral_to(df, start_us, "__from", integral, bounds["a"], bounds["b"], grid_us)
    out = _integral_to(out, end_us, "__to", integral, bounds["a"], bounds["b"], grid_us)
    return out.withColumn(into, (F.col("__to") - F.col("__from")) / ((F.col(end_us) - F.col(start_us)) / 1e6)).drop("__from", "__to")


def candidate_starts(jobs: DataFrame, max_delay_us: int, grid_us: int = BUCKET_US) -> DataFrame:
    """Jobs with start_us: the release, then each grid point after it up to release + delay, inclusive."""
    if max_delay_us < 0 or grid_us <= 0:
        raise ValueError("the delay must not be negative and the grid must be positive")
    rel = F.col("release_us")
    first, last = bucket_floor(rel, grid_us) + grid_us, rel + max_delay_us
    # A sequence whose start lies after its end raises, so it is only built where there is a grid point.
    points = F.when(first <= last, F.sequence(F.least(first, last), last, F.lit(grid_us))).otherwise(F.array().cast("array<bigint>"))
    return jobs.withColumn("start_us", F.explode(F.concat(F.array(rel), points)))


def candidate_costs(jobs: DataFrame, signal: DataFrame, max_delay_us: int, decision_grid_us: int = BUCKET_US, grid_us: int = BUCKET_US, *more: str) -> DataFrame:
    """job_id, further columns, start_us, cost_g of each candidate: planned energy times the mean intensity of its window."""
    plan = jobs.select("job_id", "release_us", scheduling_run_s().alias("plan_s"), energy_kwh(scheduling_avg_w(), scheduling_run_s()).alias("kwh"))
    each = candidate_starts(plan, max_delay_us, decision_grid_us).withColumn("end_us", F.col("start_us") + seconds_us(F.col("plan_s")))
    return mean_intensity(each, "start_us", "end_us", signal, grid_us).select("job_id", *more, "start_us", (F.col("kwh") * F.col("mean_ci")).alias("cost_g"))


def best_starts(jobs: DataFrame, signal: DataFrame, max_delay_us: int, decision_grid_us: int = BUCKET_US, grid_us: int = BUCKET_US) -> DataFrame:
    """job_id, target_us, cost_g: the cheapest candidate, ties to the earliest."""
    costs = candidate_costs(jobs, signal, max_delay_us, decision_grid_us, grid_us)
    best = costs.groupBy("job_id").agg(F.min(F.struct("cost_g", "start_us")).alias("b"))
    return best.select("job_id", F.col("b.start_us").alias("target_us"), F.col("b.cost_g").alias("cost_g"))


def with_targets(jobs: DataFrame, signal: DataFrame, rules: list[tuple[int, int]], grid_us: int = BUCKET_US) -> DataFrame:
    """jobs (release_us, plan_us, kwh, and others) with targets, an array of best_starts() by each rule (delay, grid).

    The costs of a batch's candidates are one matrix, computed as candidate_costs() does, step by step; candidates are no rows.
    Rules of one grid share the candidates of their longest delay.
    """
    series = with_integral(signal, grid_us).orderBy("bucket_us").collect()  # one bounded series
    if not series:
        raise SignalError("the signal is empty")
    first, last = series[0]["bucket_us"], series[-1]["bucket_us"]
    ci, cum = (np.array([r[c] for r in series], dtype=float) for c in ("ci", "cum"))
    if any(d < 0 or g <= 0 for d, g in rules):
        raise ValueError("the delay must not be negative and the grid must be positive")
    longest = {g: max(d for d, x in rules if x == g) for _, g in rules}

    def integral(at: np.ndarray, used: np.ndarray) -> np.ndarray:
        if (used & ((at < first) | (at > last + grid_us))).any():
            raise SignalError("a window leaves the signal's coverage")
        bucket = np.clip(at - at % grid_us, first, last)
        i = (bucket - first) // grid_us
        return cum[i] + (at - bucket) / 1e6 * ci[i]

    def best(release: np.ndarray, plan: np.ndarray, kwh: np.ndarray) -> np.ndarray:
        found = np.empty((len(release), len(rules)), dtype=np.int64)
        for grid, delay in longest.items():
            points = release - release % grid + grid
            starts = np.concatenate([release[:, None], points[:, None] + np.arange(delay // grid + 1) * grid], axis=1)
            wait = starts - release[:, None]
            used = wait <= delay
            ends = starts + plan[:, None]
            mean = (integral(ends, used) - integral(starts, used)) / ((ends - starts) / 1e6)
            costs = kwh[:, None] * mean
            costs[np.isnan(costs)] = np.inf
            for at, (d, g) in enumerate(rules):
                if g == grid:
                    n = d // grid + 2
                    lowest = np.argmin(np.where(wait[:, :n] <= d, costs[:, :n], np.inf), axis=1)
                    found[:, at] = starts[np.arange(len(starts)), lowest]
        return found

    rows_at_once = max(1, 250_000 // max(d // g + 2 for g, d in longest.items()))
    plain = [c for c in jobs.columns if c != "kwh"]

    def add(batches):
        for batch in batches:
            release, plan, kwh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("release_us", "plan_us", "kwh"))
            if (plan <= 0).any():
                raise SignalError("a window must end after it starts")
            parts = [best(release[i:i + rows_at_once], plan[i:i + rows_at_once], kwh[i:i + rows_at_once]) for i in range(0, len(release), rows_at_once)]
            flat = np.concatenate(parts).ravel() if parts else np.empty(0, dtype=np.int64)
            offsets = np.arange(len(release) + 1, dtype=np.int32) * len(rules)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), lists], names=[*plain, "targets"])

    schema = StructType([*(jobs.schema[c] for c in plain), StructField("targets", ArrayType(LongType()))])
    return jobs.mapInArrow(add, schema)


def forecast(forecasts: DataFrame | None, issue_us: int, horizon_us: int, grid_us: int = BUCKET_US) -> DataFrame:
    """The latest forecast known at an instant, up to a horizon: rows of (issue_us, bucket_us, ci). None raises."""
    if forecasts is None:
        raise ForecastError("no forecast table is given")
    known = forecasts.where(F.col("issue_us") <= issue_us)
    last = known.agg(F.max("issue_us").alias("m")).first()["m"]
    if last is None:
        raise ForecastError("no forecast was issued by then")
    rows = known.where((F.col("issue_us") == last) & (F.col("bucket_us") >= issue_us - issue_us % grid_us) & (F.col("bucket_us") < issue_us + horizon_us))
    return build_series(rows.select("bucket_us", "ci"), grid_us)


def require_complete(signal: DataFrame, start_us: int, end_us: int, grid_us: int = BUCKET_US) -> None:
    require_empty(missing_buckets(signal, start_us, end_us, grid_us), "missing buckets", MissingBucketError)
