"""Streaming accounting: completed jobs joined with the static signal, summed per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import from_us
from ..operators.accounting import _at, segments
from ..schemas import BUCKET_US
from ..functions.timegrid import bucket_floor


def windowed_emissions(completed: DataFrame, signal: DataFrame, window: str = "1 hour", late: str = "30 minutes", model: str = "measured") -> DataFrame:
    """kwh, gco2e and segments per tumbling window of completion time; rows later than `late` are dropped by the watermark.

    completed: a stream of canonical jobs with start_us and end_ts (timestamp). The join is stream-static, so only
    the window sums are state. Segments without a bucket of the signal raise.
    """
    rows = segments(completed, model).withColumn("__bucket", bucket_floor(_at("start_us"), BUCKET_US))
    side = signal.select(F.col("bucket_us").alias("__b"), "ci")
    joined = rows.join(side, F.col("__bucket") == F.col("__b"), "left")
    ci = F.when(F.col("ci").isNull(), F.raise_error(F.lit("no carbon intensity for a segment")).cast("double")).otherwise(F.col("ci"))
    return (
        joined.withColumn("g", F.col("kwh") * ci).withWatermark("end_ts", late).groupBy(F.window("end_ts", window))
        .agg(F.sum("kwh").alias("kwh"), F.sum("g").alias("gco2e"), F.count("*").alias("segments"))
        .select(F.col("window.start").alias("window_start"), "kwh", "gco2e", "segments")
    )


def completion_stream(jobs: DataFrame) -> DataFrame:
    """Adds end_ts, the completion as a timestamp, to jobs with start_us."""
    return jobs.withColumn("end_ts", from_us(F.col("start_us") + F.rint(F.col("run_s") * 1e6).cast("long")).cast("timestamp"))
