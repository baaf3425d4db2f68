"""Job traces: column-pruned scans and the mapping of clean rows to canonical jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintError
from ..functions.timegrid import to_us
from ..operators.accounting import weighted_mean_power
from ..schemas import SAMPLE_SECONDS

#: The columns of a clean trace that a job needs; nothing else is read.
CLEAN_COLUMNS = ["job_id", "submit_time", "release_time", "start_time", "run_time", "time_limit", "num_nodes_alloc", "node_power_consumption", "node_power_mean_W"]


def release_window(df: DataFrame, start=None, before=None, column: str = "release_time") -> DataFrame:
    """Rows with start <= release < before; either end may be open. Plain comparisons, so the scan gets them."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if before is None else df.where(F.col(column) < F.lit(before))


def prefix(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first limit rows in a total order (a top-k, never a bare limit)."""
    if limit is None:
        return df
    if limit <= 0:
        raise ValueError("limit must be positive")
    return df.orderBy(*order).limit(limit)


def to_jobs(rows: DataFrame, average: str = "weighted") -> DataFrame:
    """Clean trace rows as canonical jobs. average: 'weighted' by duration (default) or the 'stored' mean."""
    if average not in ("weighted", "stored"):
        raise ValueError(f"unknown average power source: {average}")
    limit = F.col("time_limit").cast("double")
    jobs = rows.select(
        F.col("job_id").cast("long").alias("job_id"), F.col("job_id").cast("string").alias("order_key"),
        to_us("submit_time").alias("submit_us"), to_us("release_time").alias("release_us"), F.col("num_nodes_alloc").cast("int").alias("nodes"),
        F.col("run_time").cast("double").alias("run_s"), F.when(limit > 0, limit * 60.0).alias("limit_s"), to_us("start_time").alias("trace_start_us"),
        F.col("node_power_consumption").cast("array<double>").alias("profile_w"), F.lit(SAMPLE_SECONDS).alias("interval_s"),
        F.col("node_power_mean_W").cast("double").alias("avg_w"), F.lit(None).cast("double").alias("pred_run_s"), F.lit(None).cast("double").alias("pred_avg_w"),
    )
    return jobs.withColumn("avg_w", weighted_mean_power()) if average == "weighted" else jobs


def load_jobs(spark: SparkSession, path: str, limit: int | None = None, released_from=None, released_before=None, average: str = "weighted") -> DataFrame:
    """Canonical jobs of a clean Parquet trace: window first, then the prefix by (submit, id). None left raises."""
    rows = spark.read.parquet(path).select(*CLEAN_COLUMNS)
    rows = prefix(release_window(rows, released_from, released_before), limit, "submit_time", "job_id")
    if rows.isEmpty():
        raise ConstraintError(f"no job of {path} is left after the filters")
    return to_jobs(rows, average)
