"""Measures of finished runs: waiting, slowdown, peaks, utilisation, and one row of metrics per scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CapacityError
from ..functions.constraints import require_empty
from ..functions.physics import SLOWDOWN_FLOOR_S, bounded_slowdown
from ..functions.stats import distributions

#: Width of the time cells that a sweep's running sum is cut into.
CELL_US = 3_600_000_000
REFERENCES = {"release": "release_us", "submit": "submit_us"}


def _origin(reference: str) -> Column:
    if reference not in REFERENCES:
        raise ValueError(f"unknown time reference: {reference}")
    return F.col(REFERENCES[reference])


def record_measures(runs: DataFrame) -> DataFrame:
    """runs (with the jobs' times) plus runtime, waits, turnarounds and delay against the trace, in seconds."""
    s = lambda a, b: (F.col(b) - F.col(a)) / F.lit(1e6)
    return runs.withColumns({
        "runtime_s": s("start_us", "end_us"), "waiting_s": s("release_us", "start_us"), "waiting_from_submit_s": s("submit_us", "start_us"),
        "turnaround_s": s("release_us", "end_us"), "turnaround_from_submit_s": s("submit_us", "end_us"), "delay_vs_trace_s": s("trace_start_us", "start_us"),
    })


def with_slowdown(runs: DataFrame, reference: str = "release", floor_s: float = SLOWDOWN_FLOOR_S) -> DataFrame:
    wait = (F.col("start_us") - _origin(reference)) / F.lit(1e6)
    return runs.withColumn("bounded_slowdown", bounded_slowdown(wait, (F.col("end_us") - F.col("start_us")) / F.lit(1e6), floor_s))


def sweep(runs: DataFrame, amount: Column, *keys: str) -> DataFrame:
    """keys, at_us, level after every event of a schedule; what ends at an instant ends before what starts.

    The running sum is a prefix over time cells, of which there are few, plus a running sum within each cell. So no
    task sorts a whole schedule.
    """
    amounts = runs.withColumn("__x", amount.cast("double"))
    events = amounts.select(*keys, F.col("start_us").alias("at_us"), F.lit(1).alias("__o"), F.col("__x").alias("d")).unionByName(
        amounts.select(*keys, F.col("end_us").alias("at_us"), F.lit(0).alias("__o"), (-F.col("__x")).alias("d"))
    )
    # Equal events of an instant are one; only the order of ends before starts matters.
    events = events.groupBy(*keys, "at_us", "__o").agg(F.sum("d").alias("d")).withColumn("__cell", F.floor(F.col("at_us") / CELL_US))
    cells = events.groupBy(*keys, "__cell").agg(F.sum("d").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__cell").orderBy("at_us", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.join(cells, [*keys, "__cell"]).select(*keys, "at_us", "__o", (F.col("__base") + F.sum("d").over(inside)).alias("level"))


def peak(runs: DataFrame, amount: Column, *keys: str, into: str = "peak") -> DataFrame:
    """The highest level per keys, zero at least."""
    return sweep(runs, amount, *keys).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("level")).alias(into))


def places(rows: DataFrame, at: str, *order: str) -> DataFrame:
    """rows plus place, from 1, in the order of the instant at, then of the other columns.

    Like sweep(): rows before a time cell are counted over the few cells, rows within it by a window of that cell.
    """
    celled = rows.withColumn("__cell", F.floor(F.col(at) / CELL_US))
    cells = celled.groupBy("__cell").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(at, *order))
    return celled.join(cells, F.col("__cell").eqNullSafe(F.col("__c"))).withColumn("place", F.col("__base") + inside).drop("__cell", "__c", "__base")


def mean_watts() -> Column:
    """Power as drawn: accounted energy over the runtime."""
    seconds = (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    return F.when(seconds > 0, F.coalesce(F.col("kwh"), F.lit(0.0)) * 3.6e6 / seconds).otherwise(F.lit(0.0))


def check_capacity(runs: DataFrame, total_nodes: int, *keys: str) -> None:
    """Raise if a schedule ever uses more nodes than there are."""
    require_empty(sweep(runs, F.col("nodes"), *keys).where(F.col("level") > total_nodes), f"more than {total_nodes} nodes in use", CapacityError)


def schedule_metrics(accounted: DataFrame, scenarios: DataFrame, reference: str = "release", floor_s: float = SLOWDOWN_FLOOR_S) -> DataFrame:
    """One row of metrics per scenario.

    accounted: runs with jobs' times, nodes and accounting. scenarios: scenario_id, policy, total_nodes, and
    last_event_us where a run's last event is later than its last completion. Null accounting counts as zero,
    also in the mean, which is over all jobs. A null delay doesn't count. No rows: no metrics.
    """
    rows = with_slowdown(accounted, reference, floor_s)
    rows = rows.withColumn("__wait", (F.col("start_us") - _origin(reference)) / F.lit(1e6)).withColumn("__turn", (F.col("end_us") - _origin(reference)) / F.lit(1e6))
    rows = rows.withColumn("__delay", (F.col("start_us") - F.col("trace_start_us")) / F.lit(1e6))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    agg = rows.groupBy("scenario_id").agg(
        F.count("*").alias("jobs"), F.sum(zero("gco2e")).alias("total_emissions_gco2e"), F.avg(zero("gco2e")).alias("mean_emissions_gco2e"),
        F.sum(zero("gco2e_avg_model")).alias("total_emissions_gco2e_average_model"), F.sum(zero("kwh")).alias("total_energy_kwh"),
        F.min("release_us").alias("__first"), F.max("end_us").alias("__last"),
        F.sum(F.col("nodes") * (F.col("end_us") - F.col("start_us")) / F.lit(1e6)).alias("busy_node_seconds"),
        F.min("start_us").alias("schedule_start_us"), F.max("end_us").alias("schedule_end_us"),
    )
    agg = agg.join(distributions(rows, "scenario_id", {"waiting": "__wait", "turnaround": "__turn", "slowdown": "bounded_slowdown", "delay": "__delay"}), "scenario_id")
    agg = agg.join(peak(rows, mean_watts(), "scenario_id", into="peak_power_watts"), "scenario_id")
    agg = agg.join(peak(rows, F.col("nodes"), "scenario_id", into="peak_busy_nodes"), "scenario_id")
    extra = [] if "last_event_us" in scenarios.columns else [F.lit(None).cast("long").alias("last_event_us")]
    agg = agg.join(scenarios.select("scenario_id", "policy", "total_nodes", *(["last_event_us"] if not extra else extra)), "scenario_id")
    makespan = (F.greatest(F.col("__last"), F.col("last_event_us")) - F.col("__first")) / F.lit(1e6)
    agg = agg.withColumn("makespan_seconds", makespan)
    room = F.col("total_nodes") * F.col("makespan_seconds")
    measured, average = F.col("total_emissions_gco2e"), F.col("total_emissions_gco2e_average_model")
    return agg.select(
        "scenario_id", "policy", "jobs", "total_emissions_gco2e", "mean_emissions_gco2e", "total_emissions_gco2e_average_model", "total_energy_kwh", "peak_power_watts",
        (measured / 1e6).alias("total_emissions_tco2e"), (F.col("total_energy_kwh") / 1e3).alias("total_energy_mwh"), (F.col("peak_power_watts") / 1e6).alias("peak_power_mw"),
        F.when(measured != 0, (average - measured) / measured).otherwise(F.lit(0.0)).alias("average_model_gap"),
        "waiting", "turnaround", "slowdown", "delay", "total_nodes", F.col("peak_busy_nodes").cast("long").alias("peak_busy_nodes"),
        F.when(room > 0, F.col("busy_node_seconds") / F.when(room > 0, room)).otherwise(F.lit(0.0)).alias("utilisation"), "makespan_seconds", "busy_node_seconds",
        F.when(F.col("makespan_seconds") > 0, F.col("jobs") / F.when(F.col("makespan_seconds") > 0, F.col("makespan_seconds") / 3600.0)).otherwise(F.lit(0.0)).alias("throughput_jobs_per_hour"),
        "schedule_start_us", "schedule_end_us",
    )


def flat_row(metrics: DataFrame) -> DataFrame:
    """The 25 columns of a comparison table; the last two are null where no job has a trace start."""
    pick = lambda c, *names: [F.col(f"{c}.{n}") for n in names]
    w, t, b, d = (pick(c, "mean", "median", "p95", "p99", "max") for c in ("waiting", "turnaround", "slowdown", "delay"))
    return metrics.select(
        F.col("policy").alias("scheduler"), "jobs", "total_emissions_tco2e", "mean_emissions_gco2e", "total_energy_mwh", "peak_power_mw", "average_model_gap",
        w[0].alias("waiting_mean_s"), w[1].alias("waiting_median_s"), w[2].alias("waiting_p95_s"), w[3].alias("waiting_p99_s"), w[4].alias("waiting_max_s"),
        t[0].alias("turnaround_mean_s"), t[1].alias("turnaround_median_s"), b[0].alias("bounded_slowdown_mean"), b[1].alias("bounded_slowdown_median"),
        b[2].alias("bounded_slowdown_p95"), b[4].alias("bounded_slowdown_max"), "total_nodes", "peak_busy_nodes", "utilisation",
        (F.col("makespan_seconds") / 86400.0).alias("makespan_days"), "throughput_jobs_per_hour", d[0].alias("delay_vs_trace_mean_s"), d[4].alias("delay_vs_trace_max_s"),
    )


def saved_fraction(metrics: DataFrame, reference: DataFrame) -> DataFrame:
    """metrics with saved: the share of the one reference row's emissions that a scenario avoids (0 without any)."""
    base = F.broadcast(reference.agg(F.first("total_emissions_gco2e").alias("__ref")))  # one row
    saved = F.when(F.col("__ref") != 0, (F.col("__ref") - F.col("total_emissions_gco2e")) / F.when(F.col("__ref") != 0, F.col("__ref"))).otherwise(F.lit(0.0))
    return metrics.join(base).withColumn("saved", saved).drop("__ref")
