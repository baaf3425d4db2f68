"""Views over the test tables, once as DataFrames and once as SQL, from the same integer formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import to_us
from ..schemas import BUCKET_US
from ..scratch import kept

FIRST_US = 1_704_067_200_000_000  # 2024-01-01T00:00Z
BUCKETS = 3648
#: Jobs of a task that makes profiles, and so of a file of a stored table: the events of many jobs fit one file, which one task would read.
TASK_JOBS = 20_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_id").alias("job_id"), to_us(F.date_trunc("second", F.col("ts").cast("timestamp_ntz"))).alias("submit_us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def _dealt(e: DataFrame) -> DataFrame:
    """The narrow events over all cores, before their profiles are made."""
    return e.repartition(max(e.sparkSession.sparkContext.defaultParallelism, -(-e.count() // TASK_JOBS)), "job_id")


def jobs(spark: SparkSession, sf_dir: str, profile: str | None = "exact") -> DataFrame:
    """Canonical jobs. profile: 'exact', 'held' (some end a sample early or late), or None. With one, the trace is a stored table."""
    if profile is None:
        return _jobs(spark, sf_dir, None)
    return kept(spark, ("jobs", sf_dir, profile), lambda: _jobs(spark, sf_dir, profile))


def raw_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw trace with planted defects by modulus, as a stored table."""
    return kept(spark, ("raw", sf_dir), lambda: _raw_trace(spark, sf_dir))


def _jobs(spark: SparkSession, sf_dir: str, profile: str | None) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = (e if profile is None else _dealt(e)).selectExpr(
        "job_id", "cast(job_id as string) AS order_key", "submit_us", "submit_us + 60000000L * (job_id % 5) AS release_us", "cast(1 + k % 16 as int) AS nodes",
        "cast(60 + (job_id * 7919) % 7200 as double) AS run_s",
        "CASE WHEN job_id % 11 <> 0 THEN cast(60 * ((60 + (job_id * 7919) % 7200 + 59) div 60) * (1 + job_id % 4) as double) END AS limit_s",
        "submit_us + 60000000L * (job_id % 5) + 30000000L * (job_id % 3) AS trace_start_us", "20.0D AS interval_s", "cast((1 + k % 16) * (200 + job_id % 150) as double) AS avg_w",
        "cast(null as double) AS pred_run_s", "cast(null as double) AS pred_avg_w",
    )
    if profile is None:
        return rows.withColumn("profile_w", F.lit(None).cast("array<double>"))
    last = "cast(ceil(run_s / 20.0D) as bigint) - 1"
    if profile == "held":
        last = f"greatest(0L, {last} + CASE WHEN job_id % 10 = 1 THEN -1 WHEN job_id % 10 = 2 AND run_s % 20 = 0 THEN 1 ELSE 0 END)"
    return rows.withColumn("profile_w", F.expr(f"transform(sequence(0L, {last}), i -> cast(nodes * (200 + (job_id + i * 37) % 150) as double))"))


def signal(spark: SparkSession) -> DataFrame:
    b = F.col("id")
    return spark.range(BUCKETS).select((b * BUCKET_US + FIRST_US).alias("bucket_us"), (150 + (b * 37) % 200).cast("double").alias("ci"), (b % 7 == 0).alias("is_estimated"), F.when(b % 7 == 0, F.lit("MODEL")).alias("estimation_method"))


def _raw_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _dealt(_events(spark, sf_dir))
    ts = lambda us: f"timestampadd(MICROSECOND, {us}, timestamp_ntz'1970-01-01 00:00:00')"
    run = "60 + (job_id * 7919) % 7200"
    release = "submit_us + 60000000L * (job_id % 5)"
    start = f"({release} + 30000000L * (job_id % 3))"
    # A lambda is evaluated as it stands for each sample, so what a job's samples share is made before.
    e = e.selectExpr("*", "1 + k % 16 AS w", f"cast(ceil(({run}) / 20.0D) as bigint) AS n").withColumn("m", F.expr("n - CASE WHEN job_id % 43 = 0 THEN 2 ELSE 0 END"))
    e = e.withColumn("p", F.expr("transform(sequence(job_id, job_id + 37 * (m - 1), 37L), x -> w * (200 + x % 150))"))
    return e.selectExpr(
        "job_id", "element_at(array('COMPLETED', 'FAILED', 'CANCELLED', 'TIMEOUT'), cast(CASE WHEN job_id % 7 = 0 THEN 2 + job_id % 3 ELSE 1 END as int)) AS job_state",
        "CASE WHEN job_id % 13 = 0 THEN '2' ELSE '1' END AS partition", f"{ts('submit_us')} AS submit_time",
        f"CASE WHEN job_id % 53 = 0 THEN NULL WHEN job_id % 101 = 0 THEN {ts('submit_us - 60000000L')} ELSE {ts(release)} END AS eligible_time", f"{ts(start)} AS start_time",
        f"{ts(f'({start} + 1000000L * ({run}))')} AS end_time", f"{run} AS run_time", f"((({run}) + 59) div 60) * (1 + job_id % 4) AS time_limit",
        "1 + k % 16 + CASE WHEN job_id % 37 = 0 THEN 1 ELSE 0 END AS num_nodes_req", "1 + k % 16 AS num_nodes_alloc",
        "sequence(20 + (job_id * 13) % 860, 20 + (job_id * 13) % 860 + k % 16) AS nodes",
        "CASE WHEN job_id % 41 = 0 THEN concat(array(0L), slice(p, 2, cast(m - 1 as int))) ELSE p END AS node_power_consumption",
        "CASE WHEN job_id % 17 = 0 THEN NULL ELSE transform(sequence(job_id, job_id + n - 1), x -> w * (100 + x % 50)) END AS cpu_power_consumption",
        "CASE WHEN job_id % 19 = 0 THEN cast(array() as array<bigint>) ELSE array(10L, job_id % 5 - 1, 30L) END AS mem_power_consumption",
    )


EV = """ev AS (SELECT event_id AS job_id, epoch_us(date_trunc('second', ts)) AS submit_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
JOBS = EV + """,
jobs AS (SELECT job_id, CAST(job_id AS VARCHAR) AS order_key, submit_us, submit_us + 60000000 * (job_id % 5) AS release_us, 1 + k % 16 AS nodes,
    CAST(60 + (job_id * 7919) % 7200 AS DOUBLE) AS run_s,
    CASE WHEN job_id % 11 <> 0 THEN CAST(60 * ((60 + (job_id * 7919) % 7200 + 59) // 60) * (1 + job_id % 4) AS DOUBLE) END AS limit_s,
    submit_us + 60000000 * (job_id % 5) + 30000000 * (job_id % 3) AS trace_start_us, CAST((1 + k % 16) * (200 + job_id % 150) AS DOUBLE) AS avg_w,
    CAST(60 + (job_id * 7919) % 7200 AS BIGINT) AS run_n FROM ev)"""
#: Segments of the exact profile: i, power, length and start offset.
SEGS = """segs AS (SELECT j.*, i, CAST(j.nodes * (200 + (j.job_id + i * 37) % 150) AS DOUBLE) AS w, CAST(least(20, run_n - 20 * i) AS DOUBLE) AS len_s
    FROM (SELECT *, unnest(range((run_n + 19) // 20)) AS i FROM jobs) j)"""
HELD = """held AS (SELECT j.*, i, CAST(least(20, run_n - 20 * i) AS DOUBLE) AS len_s, CAST(j.nodes * (200 + (j.job_id + least(i, last) * 37) % 150) AS DOUBLE) AS w
    FROM (SELECT *, greatest(0, (run_n + 19) // 20 - 1 + CASE WHEN job_id % 10 = 1 THEN -1 WHEN job_id % 10 = 2 AND run_n % 20 = 0 THEN 1 ELSE 0 END) AS last,
        unnest(range((run_n + 19) // 20)) AS i FROM jobs) j)"""
SIGNAL = f"""sig AS (SELECT b * {BUCKET_US} + {FIRST_US} AS bucket_us, CAST(150 + (b * 37) % 200 AS DOUBLE) AS ci, b % 7 = 0 AS is_estimated,
    CASE WHEN b % 7 = 0 THEN 'MODEL' END AS estimation_method FROM range({BUCKETS}) r(b)),
cum AS (SELECT bucket_us, ci, coalesce(sum(ci * 900) OVER (ORDER BY bucket_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM sig)"""
_TS = lambda us: f"make_timestamp({us})"
RAW = EV + f""",
raw AS (SELECT job_id, CASE WHEN job_id % 7 <> 0 THEN 'COMPLETED' WHEN job_id % 3 = 0 THEN 'FAILED' WHEN job_id % 3 = 1 THEN 'CANCELLED' ELSE 'TIMEOUT' END AS job_state,
    CASE WHEN job_id % 13 = 0 THEN '2' ELSE '1' END AS partition, submit_us, {_TS('submit_us')} AS submit_time, k,
    CASE WHEN job_id % 53 = 0 THEN NULL WHEN job_id % 101 = 0 THEN {_TS('submit_us - 60000000')} ELSE {_TS('submit_us + 60000000 * (job_id % 5)')} END AS eligible_time,
    {_TS('submit_us + 60000000 * (job_id % 5) + 30000000 * (job_id % 3)')} AS start_time,
    {_TS('submit_us + 60000000 * (job_id % 5) + 30000000 * (job_id % 3) + 1000000 * (60 + (job_id * 7919) % 7200)')} AS end_time,
    60 + (job_id * 7919) % 7200 AS run_time, ((60 + (job_id * 7919) % 7200 + 59) // 60) * (1 + job_id % 4) AS time_limit,
    1 + k % 16 + CASE WHEN job_id % 37 = 0 THEN 1 ELSE 0 END AS num_nodes_req, 1 + k % 16 AS num_nodes_alloc,
    range(20 + (job_id * 13) % 860, 20 + (job_id * 13) % 860 + k % 16 + 1) AS nodes,
    list_transform(range((60 + (job_id * 7919) % 7200 + 19) // 20 - CASE WHEN job_id % 43 = 0 THEN 2 ELSE 0 END), lambda i: CASE WHEN job_id % 41 = 0 AND i = 0 THEN 0 ELSE (1 + k % 16) * (200 + (job_id + i * 37) % 150) END) AS node_power_consumption,
    CASE WHEN job_id % 17 = 0 THEN NULL ELSE list_transform(range((60 + (job_id * 7919) % 7200 + 19) // 20), lambda i: (1 + k % 16) * (100 + (job_id + i) % 50)) END AS cpu_power_consumption,
    CASE WHEN job_id % 19 = 0 THEN CAST([] AS BIGINT[]) ELSE [10, job_id % 5 - 1, 30] END AS mem_power_consumption FROM ev)"""
OVER = """iv AS (SELECT job_id, start_time, end_time, unnest(nodes) AS node FROM raw),
ord AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY start_time, end_time, job_id) AS rn FROM iv),
run AS (SELECT *, max(end_time) OVER w AS mx, arg_max(job_id, (end_time, -rn)) OVER w AS own FROM ord
    WINDOW w AS (PARTITION BY node ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hits AS (SELECT node, job_id, own AS other_job_id FROM run WHERE start_time < mx),
overlap_ids AS (SELECT job_id FROM hits UNION SELECT other_job_id FROM hits)"""
DERIVED = RAW + ", " + OVER + """,
derived AS (SELECT r.*, CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000) AS BIGINT) AS elapsed, len(nodes) AS nodes_count, len(list_distinct(nodes)) AS unique_nodes,
    len(node_power_consumption) AS samples, 20 * len(node_power_consumption) - run_time AS delta, list_min(node_power_consumption) AS min_w,
    o.job_id IS NOT NULL AS overlap FROM raw r LEFT JOIN overlap_ids o ON r.job_id = o.job_id),
ruled AS (SELECT *, coalesce(job_state = 'COMPLETED', false) AS r1, partition = '1' AS r2,
    coalesce(submit_time <= eligible_time AND eligible_time <= start_time AND start_time <= end_time, false) AS r3, run_time > 0 AND run_time = elapsed AS r4,
    num_nodes_req > 0 AND num_nodes_alloc > 0 AND num_nodes_alloc = nodes_count AND nodes_count = unique_nodes AS r5, num_nodes_req = num_nodes_alloc AS r6,
    coalesce(samples > 0 AND min_w > 0, false) AS r7, abs(delta) <= 20 AS r8, NOT overlap AS r9 FROM derived)"""


def with_sql(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " + select
