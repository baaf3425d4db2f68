"""The query catalogue: one entry per operator of the inventory, with its SQL where SQL can express it.

Keys begin with the inventory ids. Times are microseconds since the epoch; sums are rounded, because the order of a
floating-point sum isn't fixed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics, stats, timegrid
from ..operators import accounting, cleaning, metrics, placement, signal as sig
from ..schemas import BUCKET_US
from ..scratch import place, stored
from ..sources import grid_api, jobs as job_source, signal_cache, sinks
from ..streaming import completed_jobs
from . import events_sql, experiments, fixtures as fx
from .fixtures import DERIVED, EV, HELD, JOBS, OVER, RAW, SEGS, SIGNAL, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _shifted(sql)
        return f

    return add


#: Rounded values are moved by a share of a unit first: many are exact ties, which the last bit of a sum would decide.
_SHIFT = 0.017


def _shifted(sql: str) -> str:
    """SQL with the same shift in each round(x, digits)."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, i = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        if m := re.search(r", (\d+)\)$", sql[at:i]):
            end = at + m.start()
            sql = f"{sql[:at]}round(({sql[at + 6:end]}) + {_SHIFT}e-{m[1]}{sql[end:]}"
        at += 6
    return sql


def _r(column, digits: int = 6):
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + float(f"{_SHIFT}e-{digits}"), digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _nodes(jobs: DataFrame) -> int:
    """A capacity that leaves some queueing at every scale of the test tables."""
    return max(24, round(jobs.count() / 71.4))


def _runs(spark, sf, profile="exact") -> DataFrame:
    """Every job at its trace start, as runs of one scenario, with the jobs' columns."""
    j = fx.jobs(spark, sf, profile)
    return placement.replay(j, 1_000_000, "trace", check=False).select("scenario_id", "job_id", "start_us", "end_us")


def _accounted(spark, sf) -> DataFrame:
    j = fx.jobs(spark, sf)
    done = accounting.account_runs(_runs(spark, sf), j, fx.signal(spark))
    return done.join(j.select("job_id", "order_key", "submit_us", "release_us", "trace_start_us", "nodes"), "job_id")


def _one(sf_nodes: int, spark) -> DataFrame:
    return spark.createDataFrame([("trace", "replay", sf_nodes)], "scenario_id string, policy string, total_nodes int")


ACC = """acc AS (SELECT job_id, any_value(submit_us) AS submit_us, any_value(release_us) AS release_us, any_value(trace_start_us) AS start_us,
    any_value(trace_start_us + 1000000 * run_n) AS end_us, any_value(nodes) AS nodes, any_value(run_s) AS run_s, sum(w * len_s / 3600000.0) AS kwh, sum(w * len_s / 3600000.0 * ci) AS g,
    any_value(avg_w * run_s / 3600000.0) AS kwh_avg, sum(avg_w * len_s / 3600000.0 * ci) AS g_avg
    FROM (SELECT *, trace_start_us + 20000000 * i AS at_us FROM segs) s JOIN sig ON sig.bucket_us = at_us - at_us % 900000000 GROUP BY job_id)"""
_ACC = (JOBS, SEGS, SIGNAL, ACC)


# ---- sources -------------------------------------------------------------------------------------------------

def _as_clean(spark, sf) -> DataFrame:
    """The raw fixture under the columns of a clean trace."""
    return cleaning.with_derived(fx.raw_trace(spark, sf)).where("release_time is not null")


@query("S1_scan_pruned", with_sql(RAW, select="SELECT job_id, epoch_us(submit_time) AS submit_us, CAST(run_time AS DOUBLE) AS run_s, num_nodes_alloc AS nodes FROM raw"))
def _(spark, sf):
    return job_source.to_jobs(_as_clean(spark, sf), "stored").select("job_id", "submit_us", "run_s", F.col("nodes").cast("long").alias("nodes"))


@query("S2_release_window", with_sql(JOBS, select="SELECT job_id, release_us FROM jobs WHERE release_us >= 1704499200000000 AND release_us < 1705363200000000"))
def _(spark, sf):
    return job_source.release_window(fx.jobs(spark, sf, None), 1704499200000000, 1705363200000000, "release_us").select("job_id", "release_us")


@query("S3_prefix_after_filter", with_sql(JOBS, select="SELECT job_id, submit_us FROM jobs WHERE release_us >= 1704499200000000 ORDER BY submit_us, job_id LIMIT 500"))
def _(spark, sf):
    return job_source.prefix(job_source.release_window(fx.jobs(spark, sf, None), 1704499200000000, None, "release_us"), 500, "submit_us", "job_id").select("job_id", "submit_us")


@query("S4_empty_check", with_sql(JOBS, select="SELECT count(*) = 0 AS empty FROM jobs WHERE release_us < 0"))
def _(spark, sf):
    left = job_source.release_window(fx.jobs(spark, sf, None), None, 0, "release_us")
    return left.agg((F.count("*") == 0).alias("empty"))


@query("S5_job_mapping", with_sql(JOBS, SEGS, select="""SELECT j.job_id, j.limit_s, round(max(s.mx) * least(sum((s.w / s.mx) * (s.len_s / s.run_s)), 1.0), 6) AS avg_w
    FROM jobs j JOIN (SELECT *, max(w) OVER (PARTITION BY job_id) AS mx FROM segs) s USING (job_id) GROUP BY j.job_id, j.limit_s"""))
def _(spark, sf):
    return fx.jobs(spark, sf).select("job_id", "limit_s", _r(accounting.weighted_mean_power()).alias("avg_w"))


@query("S6_signal_cache", with_sql(SIGNAL, select="SELECT bucket_us, ci, is_estimated, estimation_method FROM sig"))
def _(spark, sf):
    path = place(spark, "signal")
    payload = spark.createDataFrame([(_cache_text(spark),)], "value string").coalesce(1)
    payload.write.mode("overwrite").text(path)
    return signal_cache.load_signal(spark, path)[0]


def _cache_text(spark) -> str:
    rows = fx.signal(spark).select(timegrid.iso_utc(F.col("bucket_us")).alias("timestamp"), F.col("ci").alias("intensity_gco2e_per_kwh"), "is_estimated", "estimation_method").collect()
    return json.dumps({"schema_version": 1, "granularity_seconds": 900, "metadata": {"zone": "TEST"}, "samples": [r.asDict() for r in rows]})


class FakeService:
    """Answers requests with the test signal; picklable."""

    def __call__(self, url: str, headers: dict) -> dict:
        import urllib.parse

        q = urllib.parse.parse_qs(urllib.parse.urlparse(url).query)
        a, b = (grid_api._us(q[k][0]) for k in ("start", "end"))
        rows = []
        for us in range(a, b, BUCKET_US):
            n = (us - fx.FIRST_US) // BUCKET_US
            rows.append({"zone": q["zone"][0], "datetime": grid_api.iso(us), "carbonIntensity": 150 + (n * 37) % 200, "isEstimated": n % 7 == 0, "estimationMethod": "MODEL" if n % 7 == 0 else None})
        return {"zone": q["zone"][0], "unit": "gCO2eq/kWh", "temporalGranularity": "15_minutes", "data": rows}


def _fetch(spark, days=fx.BUCKETS // 96):
    return grid_api.fetch_signal(spark, FakeService(), url="http://grid.invalid/v1", zone="TEST", start_us=fx.FIRST_US + 60_000_000, end_us=fx.FIRST_US + days * 24 * HOUR - 60_000_000, token="x")


@query("S7_S9_S10_S11_S12_grid_api", with_sql(SIGNAL, select="SELECT bucket_us, ci, is_estimated, estimation_method FROM sig"))
def _(spark, sf):
    return _fetch(spark)


@query("S8_chunk_planner", f"""SELECT {fx.FIRST_US} + i * 172800000000 AS start_us, least({fx.FIRST_US} + (i + 1) * 172800000000, {fx.FIRST_US + 37 * 24 * HOUR}) AS end_us FROM range(19) r(i)""")
def _(spark, sf):
    parts = grid_api.chunks(fx.FIRST_US + 1, fx.FIRST_US + 37 * 24 * HOUR - 1)
    return spark.createDataFrame(parts, "start_us long, end_us long")


@query("S13_merge_samples", with_sql(SIGNAL, select="SELECT bucket_us, ci FROM sig"))
def _(spark, sf):
    s = fx.signal(spark).select("bucket_us", "ci")
    return sig.merge_samples(s.union(s.where("bucket_us % 7 = 0")))


@query("S14_missing_buckets", with_sql(SIGNAL, select="SELECT bucket_us FROM sig WHERE (bucket_us // 900000000) % 50 = 0"))
def _(spark, sf):
    holed = fx.signal(spark).where(F.col("bucket_us") / BUCKET_US % 50 != 0)
    return sig.missing_buckets(holed, fx.FIRST_US, fx.FIRST_US + fx.BUCKETS * BUCKET_US)


_SCALARS = "job_id job_state partition submit_time eligible_time start_time end_time run_time time_limit num_nodes_req num_nodes_alloc".split()
_LISTS = ["nodes", *cleaning.PROFILES]


@query("S15_raw_scan", with_sql(RAW, select=f"SELECT {', '.join(_SCALARS)}, {', '.join(f'array_to_string({c}, {chr(39)},{chr(39)}) AS {c}' for c in _LISTS)} FROM raw"))
def _(spark, sf):
    """All columns; lists as text, so that any comparison can hash them."""
    return fx.raw_trace(spark, sf).select(*_SCALARS, *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in _LISTS])


@query("S16_token_lookup", "SELECT 'N_' || n_nationkey AS name, n_name AS token FROM nation")
def _(spark, sf):
    """A file of NAME=value lines, one per nation; each token looked up by its name."""
    import tempfile

    rows = [(f"N_{r['n_nationkey']}", r["n_name"]) for r in spark.read.parquet(f"{sf}/nation.parquet").collect()]  # 25 rows
    with tempfile.NamedTemporaryFile("w", suffix=".env") as lines:
        lines.writelines(f"export {k} = '{v}'\n" if i % 2 else f"{k}={v}\n" for i, (k, v) in enumerate(rows))
        lines.flush()
        return spark.createDataFrame([(k, grid_api.read_token(lines.name, k)) for k, _ in rows], "name string, token string")


# ---- sinks ---------------------------------------------------------------------------------------------------

_BSLD = "greatest(1.0, ((start_us - release_us) / 1e6 + run_s) / greatest(run_s, 10.0))"


@query("K1_records", with_sql(*_ACC, select=f"""SELECT job_id, nodes AS nodes_required, make_timestamp(submit_us) AS submit_time, make_timestamp(release_us) AS release_time, make_timestamp(start_us) AS start_time,
    make_timestamp(end_us) AS end_time, make_timestamp(start_us) AS trace_start_time, run_s AS runtime_s, (start_us - release_us) / 1e6 AS waiting_s, (start_us - submit_us) / 1e6 AS waiting_from_submit_s,
    (end_us - release_us) / 1e6 AS turnaround_s, (end_us - submit_us) / 1e6 AS turnaround_from_submit_s, (start_us - start_us) / 1e6 AS delay_vs_trace_s, round({_BSLD}, 9) AS bounded_slowdown,
    round(kwh, 6) AS energy_kwh, round(g, 6) AS emissions_gco2e, round(kwh_avg, 6) AS energy_kwh_average_model, round(g_avg, 6) AS emissions_gco2e_average_model FROM acc"""))
def _(spark, sf):
    """All columns of the record file, written and read back."""
    got = spark.read.parquet(sinks.write_records(_accounted(spark, sf), place(spark, "records")))
    return got.select(*[(_r(c, 9 if c == "bounded_slowdown" else 6).alias(c) if re.match("bounded|energy|emissions", c) else F.col(c).cast("long").alias(c) if c == "nodes_required" else F.col(c)) for c in got.columns])


_DIST = lambda c, p: f"avg({c}) AS {p}_mean, median({c}) AS {p}_median, percentile_disc(0.95) WITHIN GROUP (ORDER BY {c}) AS {p}_p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY {c}) AS {p}_p99, max({c}) AS {p}_max"
_M = f"""m AS (SELECT *, (start_us - release_us) / 1e6 AS wait_s, (end_us - release_us) / 1e6 AS turn_s, {_BSLD} AS bsld FROM acc),
ev2 AS (SELECT start_us AS at_us, 1 AS o, kwh * 3600000.0 / run_s AS w, nodes AS n FROM acc UNION ALL SELECT end_us, 0, -kwh * 3600000.0 / run_s, -nodes FROM acc),
lv AS (SELECT sum(w) OVER (ORDER BY at_us, o ROWS UNBOUNDED PRECEDING) AS w, sum(n) OVER (ORDER BY at_us, o ROWS UNBOUNDED PRECEDING) AS n FROM ev2),
pk AS (SELECT greatest(0, max(w)) AS peak_w, greatest(0, max(n)) AS peak_n FROM lv)"""


@query("K2_G9_P22_P23_P24_metrics_row", with_sql(*_ACC, _M, select=f"""SELECT 'replay' AS scheduler, count(*) AS jobs, round(sum(g) / 1e6, 9) AS total_emissions_tco2e, round(avg(g), 6) AS mean_emissions_gco2e,
    round(sum(kwh) / 1e3, 9) AS total_energy_mwh, round((SELECT peak_w FROM pk) / 1e6, 9) AS peak_power_mw, round((sum(g_avg) - sum(g)) / sum(g), 9) AS average_model_gap,
    round(avg(wait_s), 6) AS waiting_mean_s, round(median(wait_s), 9) AS waiting_median_s, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY wait_s), 9) AS waiting_p95_s, round(percentile_disc(0.99) WITHIN GROUP (ORDER BY wait_s), 9) AS waiting_p99_s, round(max(wait_s), 9) AS waiting_max_s,
    round(avg(turn_s), 6) AS turnaround_mean_s, round(median(turn_s), 9) AS turnaround_median_s, round(avg(bsld), 9) AS bounded_slowdown_mean, round(median(bsld), 9) AS bounded_slowdown_median,
    round(percentile_disc(0.95) WITHIN GROUP (ORDER BY bsld), 9) AS bounded_slowdown_p95, round(max(bsld), 9) AS bounded_slowdown_max, CAST(2000 AS INTEGER) AS total_nodes, CAST((SELECT peak_n FROM pk) AS BIGINT) AS peak_busy_nodes,
    round(sum(nodes * run_s) / (2000 * ((max(end_us) - min(release_us)) / 1e6)), 9) AS utilisation, round((max(end_us) - min(release_us)) / 1e6 / 86400.0, 9) AS makespan_days,
    round(count(*) / ((max(end_us) - min(release_us)) / 1e6 / 3600.0), 9) AS throughput_jobs_per_hour, round(0.0, 9) AS delay_vs_trace_mean_s, round(0.0, 9) AS delay_vs_trace_max_s FROM m"""))
def _(spark, sf):
    """The comparison table as CSV, written and read back."""
    made = metrics.schedule_metrics(_accounted(spark, sf), _one(2000, spark))
    got = spark.read.schema(metrics.flat_row(made).schema).option("header", True).csv(sinks.write_metrics(made, place(spark, "metrics")))
    six = {"mean_emissions_gco2e", "waiting_mean_s", "turnaround_mean_s"}
    return got.select(*[_r(c, 6 if c in six else 9).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


@query("K4_T15_iso_timestamps", with_sql(SIGNAL, select="SELECT bucket_us, strftime(make_timestamp(bucket_us), '%Y-%m-%dT%H:%M:%SZ') AS iso, bucket_us AS parsed_us FROM sig"))
def _(spark, sf):
    rows = fx.signal(spark).select("bucket_us", timegrid.iso_utc(F.col("bucket_us")).alias("iso"))
    return rows.withColumn("parsed_us", timegrid.parse_iso(F.col("iso")))


@query("K4_cache_written", with_sql(SIGNAL, select="SELECT bucket_us, ci, is_estimated, estimation_method FROM sig"))
def _(spark, sf):
    """The signal through the JSON cache: written, read back and checked."""
    return signal_cache.load_signal(spark, signal_cache.save_signal(fx.signal(spark), place(spark, "cache") + ".json", BUCKET_US, {"zone": "TEST"}))[0]


@query("T16_metadata_round_trip", with_sql(SIGNAL, select="""SELECT unnest(['buckets', 'first', 'flags', 'missing', 'zone']) AS key,
    unnest([(SELECT CAST(count(*) AS VARCHAR) FROM sig), (SELECT '{"us": ' || min(bucket_us) || '}' FROM sig), '[true, null, 1.5]', 'null', '"é \\"x\\""']) AS value"""))
def _(spark, sf):
    """Nested metadata of every JSON kind after a round trip through the cache."""
    s = fx.signal(spark)
    ends = s.agg(F.count("*").alias("n"), F.min("bucket_us").alias("a")).first()
    meta = {"zone": 'é "x"', "buckets": ends["n"], "first": {"us": ends["a"]}, "flags": [True, None, 1.5], "missing": None}
    got = signal_cache.load_signal(spark, signal_cache.save_signal(s, place(spark, "cache") + ".json", BUCKET_US, meta))[2]
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in sorted(got.items())], "key string, value string")


@query("K7_slug", "SELECT n_nationkey AS id, trim(regexp_replace(lower(trim(n_name || '-' || n_nationkey || ' X/')), '[^a-z0-9]', '_', 'g'), '_') AS slug FROM nation")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("id"), physics.slug(F.concat("n_name", F.lit("-"), F.col("n_nationkey").cast("string"), F.lit(" X/"))).alias("slug"))


# ---- cleaning ------------------------------------------------------------------------------------------------

@query("P1_runtime_columns", with_sql(DERIVED, select="SELECT job_id, elapsed AS elapsed_runtime_s, run_time - elapsed AS runtime_residual_s FROM derived"))
def _(spark, sf):
    return cleaning.with_runtime(fx.raw_trace(spark, sf)).select("job_id", "elapsed_runtime_s", "runtime_residual_s")


@query("P2_timestamp_checks", with_sql(DERIVED, select="""SELECT 'missing_timestamp' AS "check", count(*) FILTER (eligible_time IS NULL) AS failures FROM derived UNION ALL SELECT 'submit_after_eligible', count(*) FILTER (submit_time > eligible_time) FROM derived
    UNION ALL SELECT 'eligible_after_start', count(*) FILTER (eligible_time > start_time) FROM derived UNION ALL SELECT 'start_after_end', count(*) FILTER (start_time > end_time) FROM derived
    UNION ALL SELECT 'nonpositive_execution_interval', count(*) FILTER (elapsed <= 0) FROM derived"""))
def _(spark, sf):
    return cleaning.timestamp_checks(fx.raw_trace(spark, sf))


@query("P3_O7_offenders", with_sql(DERIVED, select="SELECT job_id, job_state, run_time FROM derived WHERE eligible_time IS NULL OR submit_time > eligible_time OR eligible_time > start_time ORDER BY job_id LIMIT 12"))
def _(spark, sf):
    return cleaning.timestamp_offenders(fx.raw_trace(spark, sf)).select("job_id", "job_state", "run_time")


@query("P4_P7_profile_columns", with_sql(DERIVED, select="SELECT job_id, delta AS node_profile_delta_s, abs(delta) <= 20 AS node_profile_aligned, nodes_count, unique_nodes AS unique_nodes_count FROM derived"))
def _(spark, sf):
    d = cleaning.with_node_counts(cleaning.with_profile_columns(fx.raw_trace(spark, sf)))
    return d.select("job_id", F.col("node_profile_delta_s").cast("long").alias("node_profile_delta_s"), "node_profile_aligned", F.col("nodes_count").cast("long").alias("nodes_count"), F.col("unique_nodes_count").cast("long").alias("unique_nodes_count"))


@query("P5_cadence", with_sql(DERIVED, select="SELECT count(*) AS jobs, count(*) FILTER (samples = (run_time + 19) // 20) AS exact_ceil_sample_count, count(*) FILTER (abs(delta) <= 20) AS within_one_interval, count(*) FILTER (abs(delta) > 20) AS larger_gap_or_excess FROM derived"))
def _(spark, sf):
    return cleaning.cadence(fx.raw_trace(spark, sf))


@query("P6_profile_stats", with_sql(RAW, select="SELECT job_id, round(list_avg(node_power_consumption), 6) AS node_power_mean_W, list_min(node_power_consumption) AS node_power_min_W, list_max(node_power_consumption) AS node_power_max_W FROM raw"))
def _(spark, sf):
    return cleaning.with_profile_columns(fx.raw_trace(spark, sf)).select("job_id", _r("node_power_mean_W").alias("node_power_mean_W"), "node_power_min_W", "node_power_max_W")


@query("P8_resource_checks", with_sql(DERIVED, select="""SELECT 'empty nodes list' AS "check", count(*) FILTER (nodes_count = 0) AS failures FROM derived UNION ALL SELECT 'duplicate node IDs within a job', count(*) FILTER (nodes_count <> unique_nodes) FROM derived
    UNION ALL SELECT 'allocated nodes != len(nodes)', count(*) FILTER (num_nodes_alloc <> nodes_count) FROM derived UNION ALL SELECT 'requested nodes != allocated nodes', count(*) FILTER (num_nodes_req <> num_nodes_alloc) FROM derived
    UNION ALL SELECT 'nonpositive requested nodes', count(*) FILTER (num_nodes_req <= 0) FROM derived UNION ALL SELECT 'nonpositive allocated nodes', count(*) FILTER (num_nodes_alloc <= 0) FROM derived"""))
def _(spark, sf):
    return cleaning.resource_checks(fx.raw_trace(spark, sf))


@query("P9_P10_release_and_flags", with_sql(RAW, select="""SELECT job_id, coalesce(eligible_time, submit_time) AS release_time, eligible_time IS NULL AS eligible_time_fallback_used,
    coalesce(len(cpu_power_consumption) > 0, false) AND len(mem_power_consumption) > 0 AS component_profiles_available FROM raw"""))
def _(spark, sf):
    return cleaning.with_derived(fx.raw_trace(spark, sf)).select("job_id", "release_time", "eligible_time_fallback_used", "component_profiles_available")


@query("P11_cleaning_rules", with_sql(DERIVED, select="SELECT job_id, r1 AS completed, r2 AS selected_partition, r3 AS timestamps_ordered, r4 AS runtime_exact_positive, r5 AS node_structure_valid, r6 AS requested_nodes_match_allocation, r7 AS node_power_valid, r8 AS node_profile_within_one_sample, r9 AS no_observed_node_time_overlap FROM ruled"))
def _(spark, sf):
    return cleaning.with_derived(fx.raw_trace(spark, sf)).select("job_id", *[v.alias(k) for k, v in cleaning.rules().items()])


_ALL = "r1 AND r2 AND r3 AND r4 AND r5 AND r6 AND r7 AND r8 AND r9"


@query("P12_clean", with_sql(DERIVED, select=f"SELECT job_id, run_time, num_nodes_alloc FROM ruled WHERE {_ALL}"))
def _(spark, sf):
    return cleaning.clean(cleaning.with_derived(fx.raw_trace(spark, sf))).select("job_id", "run_time", "num_nodes_alloc")


_STAGES = ["raw", "completed", "selected_partition", "timestamps_ordered", "runtime_exact_positive", "node_structure_valid", "requested_nodes_match_allocation", "node_power_valid", "node_profile_within_one_sample", "no_observed_node_time_overlap"]


_LEDGER = with_sql(DERIVED, "st AS (" + " UNION ALL ".join(f"SELECT {i} AS no, '{s}' AS stage, count(*) FILTER ({' AND '.join(['true', *(f'r{k}' for k in range(1, i + 1))])}) AS n FROM ruled" for i, s in enumerate(_STAGES)) + ")",
    select="SELECT CAST(no AS INTEGER) AS no, stage, n AS rows_remaining, coalesce(lag(n) OVER (ORDER BY no) - n, 0) AS rows_removed_at_stage FROM st")


@query("P13_W6_filter_ledger", _LEDGER)
def _(spark, sf):
    return cleaning.ledger(cleaning.with_derived(fx.raw_trace(spark, sf)))


@query("K5_clean_outputs", _LEDGER)
def _(spark, sf):
    out = sinks.write_clean_outputs(fx.raw_trace(spark, sf), place(spark, "outputs"))
    return spark.read.schema("no int, stage string, rows_remaining long, rows_removed_at_stage long").option("header", True).csv(out["ledger"])


@query("K5_written_tables", with_sql(DERIVED, f"ok AS (SELECT * FROM ruled WHERE {_ALL})", f"deb AS (SELECT * FROM ok ORDER BY submit_time, job_id LIMIT 5000)", select="""SELECT 'clean' AS output, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS ids, CAST(sum(run_time) AS BIGINT) AS seconds FROM ok
    UNION ALL SELECT 'debug', count(*), CAST(sum(job_id) AS BIGINT), CAST(sum(run_time) AS BIGINT) FROM deb UNION ALL SELECT 'catalogue', 15, 1, 1
    UNION ALL SELECT 'manifest', (SELECT count(*) FROM raw), (SELECT count(*) FROM ok), (SELECT count(*) FROM deb)"""))
def _(spark, sf):
    """Clean and debug Parquet, catalogue and manifest, read back: rows, ids and run times; for the manifest its three row counts."""
    out = sinks.write_clean_outputs(fx.raw_trace(spark, sf), place(spark, "outputs"))
    total = lambda name: spark.read.parquet(out[name]).agg(F.lit(name).alias("output"), F.count("*").alias("n"), F.sum("job_id").alias("ids"), F.sum("run_time").alias("seconds"))
    listed = spark.read.option("header", True).csv(out["catalogue"]).agg(F.lit("catalogue").alias("output"), F.count("*").alias("n"), F.count_if(F.col("field") == "job_id").alias("ids"), F.count_if(F.col("unit_or_note") == "seconds").alias("seconds"))
    whole = lambda path: F.get_json_object("value", path).cast("long")
    manifest = spark.read.text(out["manifest"]).select(F.lit("manifest").alias("output"), whole("$.source.rows").alias("n"), whole("$.outputs.clean_rows").alias("ids"), whole("$.outputs.debug_rows").alias("seconds"))
    return total("clean").union(total("debug")).union(listed).union(manifest)


_FACTS = {
    "nonempty": "count(*) > 0", "unique_job_id": "count(DISTINCT job_id) = count(job_id)", "completed_only": "bool_and(job_state = 'COMPLETED')", "partition_1_only": "bool_and(partition = '1')",
    "positive_runtime": "bool_and(run_time > 0)", "runtime_exact": "bool_and(run_time = elapsed)", "node_request_matches_allocation": "bool_and(num_nodes_req = num_nodes_alloc)",
    "allocated_nodes_match_list": "bool_and(num_nodes_alloc = nodes_count)", "unique_nodes_within_job": "bool_and(nodes_count = unique_nodes)", "usable_node_power": "bool_and(coalesce(min_w > 0, false))",
    "profile_within_one_sample": "bool_and(coalesce(abs(delta) <= 20, false))", "no_observed_node_sharing": "bool_and(NOT overlap)",
}


@query("P14_postconditions", with_sql(DERIVED, select=" UNION ALL ".join(f"SELECT '{t}' AS rows, '{k}' AS assertion, {v} AS passed FROM ruled{w}" for t, w in (("clean", f" WHERE {_ALL}"), ("raw", "")) for k, v in _FACTS.items())))
def _(spark, sf):
    """The facts of the clean table, and of the raw one, where most don't hold."""
    derived = cleaning.with_derived(fx.raw_trace(spark, sf))
    told = lambda rows, name: cleaning.postconditions(rows).select(F.lit(name).alias("rows"), "assertion", "passed")
    return told(cleaning.clean(derived), "clean").union(told(derived, "raw"))


_LISTED = "count/category/identifier as documented"
_W = "W, nominal 20 s samples"


@query("P15_feature_catalogue", f"""SELECT * FROM (VALUES ('job_id', 'bigint', '{_LISTED}', 'submission', 'identifier only'), ('job_state', 'string', '{_LISTED}', 'completion/outcome', 'quality control / validation'),
    ('partition', 'string', '{_LISTED}', 'submission', 'candidate predictor / scheduler input'), ('submit_time', 'timestamp_ntz', '{_LISTED}', 'submission', 'candidate predictor / scheduler input'),
    ('eligible_time', 'timestamp_ntz', '{_LISTED}', 'release/eligibility', 'scheduler release time'), ('start_time', 'timestamp_ntz', '{_LISTED}', 'completion/outcome', 'quality control / validation'),
    ('end_time', 'timestamp_ntz', '{_LISTED}', 'completion/outcome', 'quality control / validation'), ('run_time', 'bigint', 'seconds', 'execution outcome', 'oracle target / diagnostic'),
    ('time_limit', 'bigint', 'minutes', 'submission', 'candidate predictor / scheduler input'), ('num_nodes_req', 'bigint', '{_LISTED}', 'submission', 'candidate predictor / scheduler input'),
    ('num_nodes_alloc', 'bigint', '{_LISTED}', 'post-allocation', 'oracle validation'), ('nodes', 'array<bigint>', '{_LISTED}', 'post-allocation', 'oracle validation'),
    ('node_power_consumption', 'array<bigint>', 'whole-job {_W}', 'execution outcome', 'oracle target / diagnostic'), ('cpu_power_consumption', 'array<bigint>', 'component {_W}', 'execution outcome', 'oracle target / diagnostic'),
    ('mem_power_consumption', 'array<bigint>', 'component {_W}', 'execution outcome', 'oracle target / diagnostic')) v(field, dtype, unit_or_note, available_when, initial_role)""")
def _(spark, sf):
    return cleaning.feature_catalogue(fx.raw_trace(spark, sf))


@query("P16_state_policy", with_sql(RAW, select="""SELECT job_state, count(*) AS jobs, CASE job_state WHEN 'COMPLETED' THEN 'include when all other checks pass' ELSE 'ignore' END AS decision,
    CASE job_state WHEN 'COMPLETED' THEN 'uncensored successful runtime and power target' WHEN 'FAILED' THEN 'failed execution; runtime/power may be partial or abnormal' WHEN 'CANCELLED' THEN 'user/system cancellation produces a censored execution'
    WHEN 'TIMEOUT' THEN 'wall-time censoring; useful only in a later censored model' END AS reason FROM raw GROUP BY job_state"""))
def _(spark, sf):
    return cleaning.state_policy(fx.raw_trace(spark, sf))


@query("P17_P18_estimates", with_sql(JOBS, select="SELECT job_id, run_s AS scheduling_run_s, avg_w AS scheduling_avg_w, coalesce(limit_s, run_s) AS estimate_s, nodes * run_s AS node_seconds FROM jobs"))
def _(spark, sf):
    return fx.jobs(spark, sf, None).select("job_id", physics.scheduling_run_s().alias("scheduling_run_s"), physics.scheduling_avg_w().alias("scheduling_avg_w"), physics.estimate_s("time_limit").alias("estimate_s"), (F.col("nodes") * F.col("run_s")).alias("node_seconds"))


@query("P19_P20_P21_record_measures", with_sql(JOBS, select="""SELECT job_id, (trace_start_us - release_us) / 1e6 AS waiting_s, (trace_start_us - submit_us) / 1e6 AS waiting_from_submit_s, (trace_start_us - release_us) / 1e6 + run_s AS turnaround_s,
    (trace_start_us - submit_us) / 1e6 + run_s AS turnaround_from_submit_s, 0.0 AS delay_vs_trace_s, round(greatest(1.0, ((trace_start_us - submit_us) / 1e6 + run_s) / greatest(run_s, 10.0)), 9) AS bounded_slowdown FROM jobs"""))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    rows = metrics.with_slowdown(metrics.record_measures(_runs(spark, sf, None).join(j.select("job_id", "submit_us", "release_us", "trace_start_us"), "job_id")), "submit")
    return rows.select("job_id", "waiting_s", "waiting_from_submit_s", "turnaround_s", "turnaround_from_submit_s", "delay_vs_trace_s", _r("bounded_slowdown", 9).alias("bounded_slowdown"))


@query("P25_O1_debug_subset", with_sql(DERIVED, f"deb AS (SELECT * FROM ruled WHERE {_ALL} ORDER BY submit_time, job_id LIMIT 5000)", select="SELECT count(*) AS jobs, min(submit_time) AS first_submit, max(submit_time) AS last_submit, CAST(sum(samples) AS BIGINT) AS node_power_samples, max(num_nodes_req) AS maximum_requested_nodes FROM deb"))
def _(spark, sf):
    return cleaning.debug_summary(cleaning.debug_subset(cleaning.clean(cleaning.with_derived(fx.raw_trace(spark, sf)))))


# ---- signal --------------------------------------------------------------------------------------------------

@query("T1_T2_buckets", "WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events) SELECT event_id, us - us % 900000000 AS floor_us, us + (900000000 - us % 900000000) % 900000000 AS ceil_us, us - us % 420000000 AS floor7_us FROM e")
def _(spark, sf):
    us = timegrid.to_us("ts")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", timegrid.bucket_floor(us).alias("floor_us"), timegrid.bucket_ceil(us).alias("ceil_us"), timegrid.bucket_floor(us, 420_000_000).alias("floor7_us"))


@query("T3_O9_series", with_sql(SIGNAL, select="SELECT bucket_us, ci FROM sig ORDER BY bucket_us"))
def _(spark, sf):
    return sig.build_series(fx.signal(spark)).select("bucket_us", "ci")


@query("T4_J2_point_lookup", with_sql(JOBS, SIGNAL, select="SELECT job_id, ci FROM jobs JOIN sig ON bucket_us = release_us - release_us % 900000000"))
def _(spark, sf):
    return sig.lookup(fx.jobs(spark, sf, None), "release_us", fx.signal(spark)).select("job_id", "ci")


@query("T5_range_lookup", with_sql(JOBS, SIGNAL, select="SELECT job_id, bucket_us, ci FROM jobs JOIN sig ON bucket_us >= release_us - release_us % 900000000 AND bucket_us < release_us + 1000000 * run_n"))
def _(spark, sf):
    j = fx.jobs(spark, sf, None).select("job_id", "release_us", (F.col("release_us") + timegrid.seconds_us(F.col("run_s"))).alias("end_us"))
    return sig.range_lookup(j, "release_us", "end_us", fx.signal(spark)).select("job_id", "bucket_us", "ci")


@query("T6_coverage", with_sql(SIGNAL, select="SELECT min(bucket_us) AS coverage_start_us, max(bucket_us) + 900000000 AS coverage_end_us FROM sig"))
def _(spark, sf):
    return sig.coverage(fx.signal(spark))


@query("T7_W4_prefix_integral", with_sql(SIGNAL, select="SELECT bucket_us, ci, cum FROM cum"))
def _(spark, sf):
    return sig.with_integral(fx.signal(spark))


_MEAN = lambda a, b: f"((cb.cum + ({b} - cb.bucket_us) / 1e6 * cb.ci) - (ca.cum + ({a} - ca.bucket_us) / 1e6 * ca.ci)) / (({b} - {a}) / 1e6)"


@query("T8_T9_J3_mean_intensity", with_sql(JOBS, SIGNAL, select=f"""SELECT job_id, round({_MEAN('release_us', '(release_us + 1000000 * run_n)')}, 9) AS mean_ci FROM jobs
    JOIN cum ca ON ca.bucket_us = release_us - release_us % 900000000 JOIN cum cb ON cb.bucket_us = (release_us + 1000000 * run_n) - (release_us + 1000000 * run_n) % 900000000"""))
def _(spark, sf):
    j = fx.jobs(spark, sf, None).select("job_id", "release_us", (F.col("release_us") + timegrid.seconds_us(F.col("run_s"))).alias("end_us"))
    return sig.mean_intensity(j, "release_us", "end_us", fx.signal(spark)).select("job_id", _r("mean_ci", 9).alias("mean_ci"))


CAND = f"""pts AS (SELECT job_id, run_n, avg_w, run_s, release_us AS start_us FROM jobs UNION ALL SELECT job_id, run_n, avg_w, run_s, unnest(range(release_us - release_us % 900000000 + 900000000, release_us + {6 * HOUR} + 1, 900000000)) FROM jobs),
cost AS (SELECT job_id, start_us, (avg_w * run_s / 3600000.0) * ({_MEAN('start_us', '(start_us + 1000000 * run_n)')}) AS cost_g FROM pts
    JOIN cum ca ON ca.bucket_us = start_us - start_us % 900000000 JOIN cum cb ON cb.bucket_us = (start_us + 1000000 * run_n) - (start_us + 1000000 * run_n) % 900000000)"""


@query("T10_candidates", with_sql(JOBS, SIGNAL, CAND, select="SELECT job_id, count(*) AS n, min(start_us) AS first_us, max(start_us) AS last_us FROM pts GROUP BY job_id"))
def _(spark, sf):
    c = sig.candidate_starts(fx.jobs(spark, sf, None).select("job_id", "release_us"), 6 * HOUR)
    return c.groupBy("job_id").agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))


@query("T11_candidate_costs", with_sql(JOBS, SIGNAL, CAND, select="SELECT job_id, start_us, round(cost_g, 6) AS cost_g FROM cost"))
def _(spark, sf):
    return sig.candidate_costs(fx.jobs(spark, sf, None), fx.signal(spark), 6 * HOUR).select("job_id", "start_us", _r("cost_g").alias("cost_g"))


@query("T12_O8_best_start", with_sql(JOBS, SIGNAL, CAND, "rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cost_g, start_us) AS rn FROM cost)", select="SELECT job_id, start_us AS target_us, round(cost_g, 6) AS cost_g FROM rk WHERE rn = 1"))
def _(spark, sf):
    return sig.best_starts(fx.jobs(spark, sf, None), fx.signal(spark), 6 * HOUR).select("job_id", "target_us", _r("cost_g").alias("cost_g"))


@query("T13_T14_forecast", with_sql(SIGNAL, select=f"SELECT bucket_us, ci + 2 AS ci FROM sig WHERE bucket_us >= {fx.FIRST_US + 48 * HOUR} AND bucket_us < {fx.FIRST_US + 72 * HOUR}"))
def _(spark, sf):
    issues = spark.range(5).select((F.col("id") * 24 * HOUR + fx.FIRST_US).alias("issue_us"), F.col("id").alias("k"))
    rows = F.broadcast(issues).crossJoin(fx.signal(spark)).where("bucket_us >= issue_us").select("issue_us", "bucket_us", (F.col("ci") + F.col("k")).alias("ci"))
    return sig.forecast(rows, fx.FIRST_US + 48 * HOUR + 1, 24 * HOUR - 1)


# ---- accounting ----------------------------------------------------------------------------------------------

@query("A1_A2_constant_energy", with_sql(JOBS, select="SELECT job_id, round(avg_w * run_s / 3600000.0, 9) AS kwh FROM jobs"))
def _(spark, sf):
    return fx.jobs(spark, sf, None).select("job_id", _r(physics.energy_kwh(F.col("avg_w"), F.col("run_s")), 9).alias("kwh"))


@query("A3_A4_segments", with_sql(JOBS, SEGS, select="SELECT job_id, CAST(i AS BIGINT) AS seg, 20.0 * i AS offset_s, len_s AS length_s, avg_w AS power_w FROM segs"))
def _(spark, sf):
    rows = accounting.segments(fx.jobs(spark, sf, None), "average")
    return rows.select("job_id", F.col("seg").cast("long").alias("seg"), "offset_s", "length_s", "power_w")


@query("A5_coverage_rule", with_sql(JOBS, select="SELECT job_id, abs(20.0 * ((run_n + 19) // 20 - CASE WHEN job_id % 10 = 1 THEN 1 ELSE 0 END + CASE WHEN job_id % 10 = 2 AND run_n % 20 = 0 THEN 1 ELSE 0 END) - run_s) <= 20.00000002 AS covered FROM jobs WHERE run_n > 20"))
def _(spark, sf):
    return fx.jobs(spark, sf, "held").where("run_s > 20").select("job_id", accounting.coverage_ok().alias("covered"))


@query("A6_A8_measured_energy_held", with_sql(JOBS, HELD, select="SELECT job_id, round(sum(w * len_s / 3600000.0), 9) AS kwh FROM held GROUP BY job_id"))
def _(spark, sf):
    rows = accounting.segments(fx.jobs(spark, sf, "held"), "measured")
    return rows.groupBy("job_id").agg(_r(F.sum("kwh"), 9).alias("kwh"))


@query("A7_weighted_mean_power", with_sql(JOBS, HELD, select="SELECT job_id, round(any_value(mx) * least(sum((w / mx) * (len_s / run_s)), 1.0), 6) AS avg_w FROM (SELECT *, max(w) OVER (PARTITION BY job_id) AS mx FROM held) GROUP BY job_id"))
def _(spark, sf):
    return fx.jobs(spark, sf, "held").select("job_id", _r(accounting.weighted_mean_power()).alias("avg_w"))


@query("A8_in_row_energy", with_sql(JOBS, SEGS, select="SELECT job_id, round(sum(w * len_s / 3600000.0), 9) AS kwh FROM segs GROUP BY job_id"))
def _(spark, sf):
    return fx.jobs(spark, sf).select("job_id", _r(accounting.measured_energy(), 9).alias("kwh"))


@query("A9_constant_emissions", with_sql(JOBS, SEGS, select="SELECT job_id, any_value(release_us) AS start_us, any_value(release_us + 1000000 * run_n) AS end_us, round(sum(w * len_s / 3600000.0), 9) AS kwh, round(sum(w * len_s / 3600000.0) * 250.0, 6) AS gco2e FROM segs GROUP BY job_id"))
def _(spark, sf):
    rows = accounting.account(fx.jobs(spark, sf), 250.0, "release_us")
    return rows.select("job_id", "start_us", "end_us", _r("kwh", 9).alias("kwh"), _r("gco2e").alias("gco2e"))


_EMIT = "FROM (SELECT *, release_us + 20000000 * i AS at_us FROM segs) s JOIN sig ON sig.bucket_us = at_us - at_us % 900000000 GROUP BY job_id"


@query("accounting_measured", with_sql(JOBS, SEGS, SIGNAL, select=f"SELECT job_id, any_value(release_us) AS start_us, any_value(release_us + 1000000 * run_n) AS end_us, round(sum(w * len_s / 3600000.0), 9) AS kwh, round(sum(w * len_s / 3600000.0 * ci), 6) AS gco2e {_EMIT}"))
def _(spark, sf):
    """A8, A10, A11, J2: the flagship."""
    rows = accounting.account(fx.jobs(spark, sf), fx.signal(spark), "release_us")
    return rows.select("job_id", "start_us", "end_us", _r("kwh", 9).alias("kwh"), _r("gco2e").alias("gco2e"))


@query("A10_A13_A14_average_model", with_sql(JOBS, SEGS, SIGNAL, select=f"SELECT job_id, any_value(release_us) AS start_us, any_value(release_us + 1000000 * run_n) AS end_us, round(any_value(avg_w * run_s / 3600000.0), 9) AS kwh, round(sum(avg_w * len_s / 3600000.0 * ci), 6) AS gco2e {_EMIT}"))
def _(spark, sf):
    rows = accounting.account(fx.jobs(spark, sf), fx.signal(spark), "release_us", "average")
    return rows.select("job_id", "start_us", "end_us", _r("kwh", 9).alias("kwh"), _r("gco2e").alias("gco2e"))


@query("A12_emissions_only", with_sql(JOBS, SEGS, SIGNAL, select=f"SELECT job_id, round(sum(w * len_s / 3600000.0 * ci), 6) AS gco2e {_EMIT}"))
def _(spark, sf):
    return accounting.account(fx.jobs(spark, sf), fx.signal(spark), "release_us").select("job_id", _r("gco2e").alias("gco2e"))


@query("A15_J1_account_runs", with_sql(*_ACC, select="SELECT job_id, start_us, end_us, round(kwh, 9) AS kwh, round(g, 6) AS gco2e, round(kwh_avg, 9) AS kwh_avg_model, round(g_avg, 6) AS gco2e_avg_model FROM acc"))
def _(spark, sf):
    rows = accounting.account_runs(_runs(spark, sf), fx.jobs(spark, sf), fx.signal(spark))
    return rows.select("job_id", "start_us", "end_us", _r("kwh", 9).alias("kwh"), _r("gco2e").alias("gco2e"), _r("kwh_avg_model", 9).alias("kwh_avg_model"), _r("gco2e_avg_model").alias("gco2e_avg_model"))


@query("A16_coverage_guard", with_sql(JOBS, SIGNAL, select="SELECT min(trace_start_us) >= (SELECT min(bucket_us) FROM sig) AND max(trace_start_us + 1000000 * run_n) <= (SELECT max(bucket_us) + 900000000 FROM sig) AS covered FROM jobs"))
def _(spark, sf):
    ends = F.broadcast(sig.coverage(fx.signal(spark)))  # one row
    span = _runs(spark, sf, None).agg(F.min("start_us").alias("a"), F.max("end_us").alias("b"))
    return span.join(ends).select(((F.col("a") >= F.col("coverage_start_us")) & (F.col("b") <= F.col("coverage_end_us"))).alias("covered"))


@query("A17_totals", with_sql(*_ACC, select="SELECT 'trace' AS scenario_id, round(sum(kwh), 4) AS kwh, round(sum(g), 2) AS gco2e FROM acc"))
def _(spark, sf):
    return accounting.totals(_accounted(spark, sf)).select("scenario_id", _r("kwh", 4).alias("kwh"), _r("gco2e", 2).alias("gco2e"))


_AUDIT = lambda p: f"SELECT '{p}' AS profile, count(*) FILTER ({p} IS NULL) AS null_lists, count(*) FILTER (len({p}) = 0) AS empty_lists, CAST(sum(len({p})) AS BIGINT) AS total_samples, CAST(sum(len(list_filter({p}, lambda x: x < 0))) AS BIGINT) AS negative_samples, CAST(sum(len(list_filter({p}, lambda x: x = 0))) AS BIGINT) AS zero_samples, min(list_min({p})) AS \"minimum_W\", median(len({p})) AS median_length, quantile_cont(len({p}), 0.95) AS p95_length, max(list_max({p})) AS \"maximum_W\" FROM raw"


@query("A18_profile_audit", with_sql(RAW, select=" UNION ALL ".join(map(_AUDIT, cleaning.PROFILES))))
def _(spark, sf):
    return cleaning.profile_audit(fx.raw_trace(spark, sf))


# ---- joins ---------------------------------------------------------------------------------------------------

@query("J4_overlap_membership", with_sql(RAW, OVER, select="SELECT job_id, start_time FROM raw SEMI JOIN overlap_ids USING (job_id)"))
def _(spark, sf):
    raw = fx.raw_trace(spark, sf)
    return raw.join(cleaning.overlap_jobs(raw), "job_id", "left_semi").select("job_id", "start_time")


@query("J5_W2_node_overlaps", with_sql(RAW, OVER, select="SELECT node, job_id, other_job_id FROM hits"))
def _(spark, sf):
    return cleaning.node_overlaps(fx.raw_trace(spark, sf))


@query("J7_held_targets", with_sql(JOBS, SIGNAL, CAND, "rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cost_g, start_us) AS rn FROM cost)", select="SELECT j.job_id, j.release_us, start_us AS target_us, start_us > j.release_us AS held FROM jobs j JOIN rk USING (job_id) WHERE rn = 1"))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    return j.join(sig.best_starts(j, fx.signal(spark), 6 * HOUR), "job_id").select("job_id", "release_us", "target_us", (F.col("target_us") > F.col("release_us")).alias("held"))


@query("J8_scenario_product", with_sql(JOBS, select="SELECT s AS scenario_id, count(*) AS jobs, CAST(sum(nodes) AS BIGINT) AS nodes FROM jobs, (VALUES ('a'), ('b'), ('c')) v(s) GROUP BY s"))
def _(spark, sf):
    table = spark.createDataFrame([("a",), ("b",), ("c",)], "scenario_id string")
    rows = F.broadcast(table).crossJoin(fx.jobs(spark, sf, None).select("job_id", "nodes"))
    return rows.groupBy("scenario_id").agg(F.count("*").alias("jobs"), F.sum("nodes").alias("nodes"))


# ---- aggregates ----------------------------------------------------------------------------------------------

@query("G1_value_counts", with_sql(RAW, select="SELECT job_state, count(*) AS jobs FROM raw GROUP BY job_state"))
def _(spark, sf):
    return cleaning.value_counts(fx.raw_trace(spark, sf), "job_state")


_DTYPES = {c: "timestamp_ntz" if c.endswith("_time") and c != "run_time" else "string" if c in ("job_state", "partition") else "bigint" for c in _SCALARS} | dict.fromkeys(_LISTS, "array<bigint>")


@query("G2_overview", with_sql(RAW, select=" UNION ALL ".join(f"SELECT '{c}' AS field, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS missing, {f'count(*) FILTER (len({c}) = 0)' if c in _LISTS else 'CAST(-1 AS BIGINT)'} AS empty_lists, {'CAST(-1 AS BIGINT)' if c in _LISTS else f'count(DISTINCT {c})'} AS distinct_non_null FROM raw" for c, t in _DTYPES.items())))
def _(spark, sf):
    return cleaning.overview(fx.raw_trace(spark, sf)).na.fill(-1, ["empty_lists", "distinct_non_null"])


@query("G3_duplicate_ids", "SELECT user_id, count(*) AS count FROM events GROUP BY user_id HAVING count(*) > 1")
def _(spark, sf):
    from ..functions.constraints import duplicates

    return duplicates(spark.read.parquet(f"{sf}/events.parquet"), "user_id")


@query("G4_runtime_by_state", with_sql(DERIVED, select="SELECT job_state, count(*) AS jobs, count(*) FILTER (run_time = elapsed) AS exact_end_minus_start, count(*) FILTER (run_time > 0) AS positive_runtime, min(run_time) AS min_runtime_s, median(run_time) AS median_runtime_s, max(run_time) AS max_runtime_s FROM derived GROUP BY job_state"))
def _(spark, sf):
    return cleaning.runtime_by_state(fx.raw_trace(spark, sf))


@query("G5_power_scaling", with_sql(RAW, select="SELECT num_nodes_alloc, count(*) AS jobs, round(median(list_avg(node_power_consumption)), 6) AS \"median_whole_job_W\", round(median(list_avg(node_power_consumption)) / num_nodes_alloc, 6) AS \"median_W_per_allocated_node\" FROM raw GROUP BY num_nodes_alloc ORDER BY num_nodes_alloc LIMIT 20"))
def _(spark, sf):
    return _rounded(cleaning.power_scaling(fx.raw_trace(spark, sf)))


@query("G6_describe", with_sql(DERIVED, select="SELECT count(delta) AS count, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, CAST(min(delta) AS DOUBLE) AS min, " + ", ".join(f"round(quantile_cont(delta, {q}), 6) AS p{round(100 * q):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + ", CAST(max(delta) AS DOUBLE) AS max FROM derived"))
def _(spark, sf):
    return _rounded(cleaning.coverage_distribution(fx.raw_trace(spark, sf)))


@query("G7_timestamp_summary", with_sql(RAW, select=" UNION ALL ".join(f"SELECT '{t}' AS field, count(*) FILTER ({t} IS NULL) AS missing, min({t}) AS minimum, max({t}) AS maximum FROM raw" for t in cleaning.TIMES)))
def _(spark, sf):
    return cleaning.timestamp_summary(fx.raw_trace(spark, sf))


@query("G8_distribution", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, max(value) AS max FROM events GROUP BY event_type")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(stats.distribution("value").alias("d")).select("event_type", "d.*")
    return rows.withColumn("mean", _r("mean")).withColumn("median", _r("median"))


_PART = "p AS (SELECT *, CASE WHEN job_id % 3 <> 0 THEN g END AS g0, CASE WHEN job_id % 5 <> 0 THEN start_us - release_us END AS d0 FROM acc)"


@query("G10_G11_null_accounting", with_sql(*_ACC, _PART, select="SELECT 'trace' AS scenario_id, round(sum(coalesce(g0, 0)), 2) AS total_emissions_gco2e, round(avg(coalesce(g0, 0)), 4) AS mean_emissions_gco2e, round(avg(d0) / 1e6, 6) AS delay_mean, CAST(max(d0) / 1e6 AS DOUBLE) AS delay_max FROM p"))
def _(spark, sf):
    rows = _accounted(spark, sf).withColumn("gco2e", F.when(F.col("job_id") % 3 != 0, F.col("gco2e"))).withColumn("trace_start_us", F.when(F.col("job_id") % 5 != 0, F.col("release_us")))
    m = metrics.schedule_metrics(rows, _one(2000, spark))
    return m.select("scenario_id", _r("total_emissions_gco2e", 2).alias("total_emissions_gco2e"), _r("mean_emissions_gco2e", 4).alias("mean_emissions_gco2e"), _r("delay.mean").alias("delay_mean"), F.col("delay.max").alias("delay_max"))


@query("G12_G13_G14_G15_run_figures", with_sql(*_ACC, select="""SELECT (max(end_us) - min(release_us)) / 1e6 AS makespan_seconds, min(start_us) AS schedule_start_us, max(end_us) AS schedule_end_us, round(sum(nodes * run_s) / (2000 * ((max(end_us) - min(release_us)) / 1e6)), 9) AS utilisation,
    round(count(*) / ((max(end_us) - min(release_us)) / 1e6 / 3600.0), 9) AS throughput_jobs_per_hour, round((sum(g_avg) - sum(g)) / sum(g), 9) AS average_model_gap FROM acc"""))
def _(spark, sf):
    m = metrics.schedule_metrics(_accounted(spark, sf), _one(2000, spark))
    return m.select("makespan_seconds", "schedule_start_us", "schedule_end_us", _r("utilisation", 9).alias("utilisation"), _r("throughput_jobs_per_hour", 9).alias("throughput_jobs_per_hour"), _r("average_model_gap", 9).alias("average_model_gap"))


@query("G16_saved_fraction", with_sql(JOBS, SEGS, SIGNAL, ACC, """late AS (SELECT sum(w * len_s / 3600000.0 * ci) AS g FROM (SELECT *, trace_start_us + 21600000000 + 20000000 * i AS at_us FROM segs) s JOIN sig ON sig.bucket_us = at_us - at_us % 900000000)""",
    select="SELECT 'late' AS scenario_id, round(((SELECT sum(g) FROM acc) - g) / (SELECT sum(g) FROM acc), 9) AS saved FROM late UNION ALL SELECT 'trace', round(0.0, 9)"))
def _(spark, sf):
    j, s = fx.jobs(spark, sf), fx.signal(spark)
    first = _runs(spark, sf)
    late = first.select(F.lit("late").alias("scenario_id"), "job_id", (F.col("start_us") + 6 * HOUR).alias("start_us"), (F.col("end_us") + 6 * HOUR).alias("end_us"))
    total = accounting.totals(accounting.account_runs(first.union(late), j, s)).withColumnRenamed("gco2e", "total_emissions_gco2e")
    return metrics.saved_fraction(total, total.where("scenario_id = 'trace'")).select("scenario_id", _r("saved", 9).alias("saved"))


@query("G17_power_cap", with_sql(*_ACC, _M, select="SELECT round(0.8 * peak_w, 3) AS cap_w FROM pk"))
def _(spark, sf):
    return metrics.peak(_accounted(spark, sf), metrics.mean_watts(), "scenario_id").select(_r(F.col("peak") * experiments.CAP_FRACTION, 3).alias("cap_w"))


# ---- windows and orders --------------------------------------------------------------------------------------

@query("W1_peak_power", with_sql(*_ACC, _M, select="SELECT 'trace' AS scenario_id, round(peak_w, 3) AS peak FROM pk"))
def _(spark, sf):
    return _rounded(metrics.peak(_accounted(spark, sf), metrics.mean_watts(), "scenario_id"), 3)


@query("W3_peak_nodes", with_sql(JOBS, """e AS (SELECT trace_start_us AS t, 1 AS o, nodes AS d FROM jobs UNION ALL SELECT trace_start_us + 1000000 * run_n, 0, -nodes FROM jobs), l AS (SELECT sum(d) OVER (ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS v FROM e)""", select="SELECT CAST(max(v) AS BIGINT) AS peak_busy_nodes, (SELECT sum(nodes * run_s) FROM jobs) AS busy_node_seconds FROM l"))
def _(spark, sf):
    rows = _runs(spark, sf, None).join(fx.jobs(spark, sf, None).select("job_id", "nodes", "run_s"), "job_id")
    busy = rows.agg(F.sum(F.col("nodes") * F.col("run_s")).alias("busy_node_seconds"))
    return metrics.peak(rows, F.col("nodes"), "scenario_id").select(F.col("peak").cast("long").alias("peak_busy_nodes")).join(F.broadcast(busy))


@query("W5_rank_percentile", with_sql(JOBS, "r AS (SELECT run_s, row_number() OVER (ORDER BY run_s, job_id) AS rn, count(*) OVER () AS n FROM jobs)", select="SELECT max(run_s) FILTER (rn = greatest(1, least(n, CAST(ceil(0.95 * n) AS BIGINT)))) AS p95, max(run_s) FILTER (rn = greatest(1, least(n, CAST(ceil(0.99 * n) AS BIGINT)))) AS p99 FROM r"))
def _(spark, sf):
    return fx.jobs(spark, sf, None).agg(stats.nearest_rank("run_s", 0.95).alias("p95"), stats.nearest_rank("run_s", 0.99).alias("p99"))


@query("W7_capacity_check", with_sql(JOBS, """e AS (SELECT trace_start_us AS t, 1 AS o, nodes AS d FROM jobs UNION ALL SELECT trace_start_us + 1000000 * run_n, 0, -nodes FROM jobs), s AS (SELECT t, o, sum(d) AS d FROM e GROUP BY t, o), l AS (SELECT t, o, sum(d) OVER (ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS v FROM s)""", select="SELECT t AS at_us, CAST(v AS DOUBLE) AS level FROM l WHERE v > 100"))
def _(spark, sf):
    rows = _runs(spark, sf, None).join(fx.jobs(spark, sf, None).select("job_id", "nodes"), "job_id")
    return metrics.sweep(rows, F.col("nodes"), "scenario_id").where("level > 100").select("at_us", "level")


@query("O2_queue_order", with_sql(JOBS, select="SELECT job_id, row_number() OVER (ORDER BY release_us, order_key) AS place FROM jobs"))
def _(spark, sf):
    return metrics.places(fx.jobs(spark, sf, None), "release_us", "order_key").select("job_id", "place")


@query("O3_record_order", with_sql(JOBS, select="SELECT job_id, trace_start_us, row_number() OVER (ORDER BY trace_start_us, order_key) AS place FROM jobs"))
def _(spark, sf):
    return metrics.places(fx.jobs(spark, sf, None), "trace_start_us", "order_key").select("job_id", "trace_start_us", "place")


# ---- placement -----------------------------------------------------------------------------------------------

FCFS = """q AS (SELECT job_id, nodes, release_us, 1000000 * run_n AS run_us, row_number() OVER (ORDER BY release_us, order_key) AS rn FROM jobs),
cap AS (SELECT greatest(24, CAST(round(count(*) / 71.4) AS BIGINT)) AS c FROM jobs),
f AS (SELECT 0 AS rn, CAST(0 AS BIGINT) AS job_id, CAST(0 AS BIGINT) AS start_us, CAST([] AS STRUCT(e BIGINT, n BIGINT)[]) AS active
    UNION ALL
    SELECT q.rn, q.job_id, t.t, list_append(list_filter(f.active, lambda a: a.e > t.t), {'e': t.t + q.run_us, 'n': q.nodes})
    FROM f JOIN q ON q.rn = f.rn + 1, cap, LATERAL (SELECT list_min(list_filter(list_append(list_transform(list_filter(f.active, lambda a: a.e > greatest(q.release_us, f.start_us)), lambda a: a.e), greatest(q.release_us, f.start_us)),
        lambda x: coalesce(list_sum(list_transform(list_filter(f.active, lambda a: a.e > x), lambda a: a.n)), 0) + q.nodes <= cap.c)) AS t) t)"""
_FCFS = with_sql(JOBS, FCFS, select="SELECT job_id, start_us FROM f WHERE rn > 0", recursive=True)


def _scenario(spark, rows):
    return experiments.scenarios(spark, rows)


@query("X2_fcfs_fold", _FCFS)
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    return placement.fcfs_fold(j, _nodes(j))


@query("X1_X8_X9_fcfs_simulated", _FCFS)
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    return placement.simulate(j, _scenario(spark, [experiments.scenario("fcfs", "fcfs", _nodes(j))])).select("job_id", "start_us")


_CAP = "(SELECT greatest(24, CAST(round(count(*) / 71.4) AS BIGINT)) FROM jobs)"


def _scen(*rows: tuple, name: str = "scen") -> str:
    """A table of scenarios for events_sql: sid, nodes, cap, window, estimate, backfills, delay, boundary grid."""
    values = ", ".join(f"('{i}', CAST({c} AS BIGINT), CAST({cap} AS DOUBLE), {win}, '{est}', {bf}, CAST({delay} AS BIGINT), CAST({grid} AS BIGINT))" for i, c, cap, win, est, bf, delay, grid in rows)
    return f"{name} AS (SELECT * FROM (VALUES {values}) v(sid, c, cap, win, est, bf, delay, grid))"


def _easy(sid: str, c: str = _CAP, cap: str = "'inf'", win: int = 0, est: str = "time_limit", bf: str = "true", delay="NULL", grid: int = 0) -> tuple:
    return sid, c, cap, win, est, bf, delay, grid


def _targets(delays) -> str:
    """Cheapest starts of every job within each delay, from candidates up to the longest."""
    longest = max(delays)
    points = CAND.replace(str(6 * HOUR), str(longest))
    return points + f""", targets AS (SELECT job_id, d.delay, arg_min(start_us, (cost_g, start_us)) AS target_us FROM (SELECT c.*, j.release_us FROM cost c JOIN jobs j USING (job_id)) c
        JOIN (VALUES {', '.join(f'(CAST({d} AS BIGINT))' for d in delays)}) d(delay) ON start_us <= release_us + d.delay GROUP BY job_id, d.delay)"""


_DELAYS = [h * HOUR for h in experiments.DELAY_HOURS]
_OUT = "scenario_id, job_id, start_us, end_us, backfilled, coalesce(first_reservation_us, -1) AS first_reservation_us, coalesce(target_us, -1) AS target_us, last_event_us"


def _placed(runs: DataFrame) -> DataFrame:
    """A simulation's result with -1 for no reservation and no target."""
    return runs.na.fill(-1, ["first_reservation_us", "target_us"])


_FIRST = _scen(_easy("easy"), _easy("easy-w10", win=10), _easy("fcfs", bf="false"))


@query("X3_X4_X13_easy", with_sql(JOBS, _scen(_easy("easy"), _easy("easy-w10", win=10)), *events_sql.schedules("runs", "scen"), select=f"SELECT {_OUT} FROM runs", recursive=True))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    return _placed(placement.simulate(j, _scenario(spark, [experiments.scenario("easy", "easy", _nodes(j)), experiments.scenario("easy-w10", "easy", _nodes(j), window=10)])))


@query("X18_J6_O4_O5_O6_run_invariants", with_sql(JOBS, _FIRST, *events_sql.schedules("runs", "scen"), """rj AS (SELECT r.*, release_us, run_n, nodes FROM runs r JOIN jobs USING (job_id))""",
    "e AS (SELECT scenario_id, start_us AS t, 1 AS o, nodes AS d FROM rj UNION ALL SELECT scenario_id, end_us, 0, -nodes FROM rj), g AS (SELECT scenario_id, t, o, sum(d) AS d FROM e GROUP BY ALL), l AS (SELECT scenario_id, sum(d) OVER (PARTITION BY scenario_id ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS v FROM g)",
    select=f"""SELECT scenario_id, count(DISTINCT job_id) AS placed, count(*) FILTER (start_us < release_us) AS early, count(*) FILTER (end_us <> start_us + 1000000 * run_n) AS wrong_end, any_value(over_capacity) AS over_capacity, any_value(peak_nodes) AS peak_nodes
    FROM rj JOIN (SELECT scenario_id, count(*) FILTER (v > {_CAP}) AS over_capacity, CAST(max(v) AS BIGINT) AS peak_nodes FROM l GROUP BY scenario_id) USING (scenario_id) GROUP BY scenario_id""", recursive=True))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    n = _nodes(j)
    runs = stored(placement.simulate(j, _scenario(spark, [experiments.scenario("fcfs", "fcfs", n), experiments.scenario("easy", "easy", n), experiments.scenario("easy-w10", "easy", n, window=10)])), "runs")
    both = runs.select("scenario_id", "job_id", "start_us", "end_us").join(j.select("job_id", "release_us", "run_s", "nodes"), "job_id")
    over = metrics.sweep(both, F.col("nodes"), "scenario_id").groupBy("scenario_id").agg(F.count_if(F.col("level") > n).alias("over_capacity"), F.max("level").cast("long").alias("peak_nodes"))
    sound = both.groupBy("scenario_id").agg(
        F.countDistinct("job_id").alias("placed"), F.count_if(F.col("start_us") < F.col("release_us")).alias("early"),
        F.count_if(F.col("end_us") != F.col("start_us") + timegrid.seconds_us(F.col("run_s"))).alias("wrong_end"),
    )
    return sound.join(over, "scenario_id")


_WATTS = "4 * (0.5 * (SELECT sum(avg_w * run_s) FROM jobs) / (30 * 86400) + 2 * (SELECT max(avg_w) FROM jobs))"


@query("X5_power_capped", with_sql(JOBS, _scen(_easy("power-cap", f"10 * {_CAP}", _WATTS)), *events_sql.schedules("runs", "scen"), select=f"SELECT {_OUT} FROM runs", recursive=True))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    cap = 0.5 * j.agg(F.sum(F.col("avg_w") * F.col("run_s"))).first()[0] / (30 * 86400) + 2 * j.agg(F.max("avg_w")).first()[0]
    return _placed(placement.simulate(j, _scenario(spark, [experiments.scenario("power-cap", "power-cap", 10 * _nodes(j), cap_w=4 * cap)])))


_HELD_ROWS = [_easy(f"carbon-{h}h", est="scheduling", delay=h * HOUR) for h in experiments.DELAY_HOURS]


@query("X6_X11_carbon_aware", with_sql(JOBS, SIGNAL, _targets(_DELAYS), _scen(*_HELD_ROWS), *events_sql.schedules("runs", "scen", _DELAYS), select=f"SELECT {_OUT} FROM runs", recursive=True))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    rows = [experiments.scenario(f"carbon-{h}h", "carbon-aware", _nodes(j), max_delay_us=h * HOUR) for h in experiments.DELAY_HOURS]
    return _placed(placement.simulate(j, _scenario(spark, rows), fx.signal(spark)))


@query("X7_replay", with_sql(JOBS, select="SELECT job_id, trace_start_us AS start_us, trace_start_us + 1000000 * run_n AS end_us FROM jobs"))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    return placement.replay(j, 100 * _nodes(j)).select("job_id", "start_us", "end_us")


@query("X10_oversized", with_sql(JOBS, select="SELECT job_id, CAST(nodes AS INTEGER) AS nodes FROM jobs WHERE nodes > 12"))
def _(spark, sf):
    return placement.oversized(fx.jobs(spark, sf, None), 12).select("job_id", "nodes")


@query("X12_carbon_boundaries", with_sql(JOBS, _scen(_easy("watch", grid=BUCKET_US)), *events_sql.schedules("runs", "scen"), select=f"SELECT {_OUT} FROM runs", recursive=True))
def _(spark, sf):
    j = fx.jobs(spark, sf, None)
    return _placed(placement.simulate(j, _scenario(spark, [("watch", "watch", _nodes(j), None, None, None, None, None)]), custom={"watch": _boundary_policy()}))


def _boundary_policy() -> placement.Policy:
    policy = placement.Policy()
    policy.boundary_us = BUCKET_US
    return policy


def _flat(runs: str, nodes: str) -> list[str]:
    """CTEs whose last, flat, is the metric row of every scenario of a table of runs, with plain values."""
    dist = lambda c, p, *names: ", ".join({"mean": f"avg({c})", "median": f"median({c})", "p95": f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})", "p99": f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {c})", "max": f"CAST(max({c}) AS DOUBLE)"}[n] + f" AS {p}_{n}_s".replace("slowdown_" + n + "_s", "slowdown_" + n) for n in names)
    return [
        f"""em AS (SELECT scenario_id, job_id, sum(w * len_s / 3600000.0) AS kwh, sum(w * len_s / 3600000.0 * ci) AS g, sum(avg_w * len_s / 3600000.0 * ci) AS g_avg
            FROM (SELECT r.scenario_id, s.job_id, w, len_s, avg_w, r.start_us + 20000000 * i AS at_us FROM {runs} r JOIN segs s USING (job_id)) JOIN sig ON sig.bucket_us = at_us - at_us % 900000000 GROUP BY ALL)""",
        f"""mm AS (SELECT r.scenario_id, r.job_id, r.start_us, r.end_us, r.last_event_us, j.release_us, j.nodes, j.run_s, em.kwh, em.g, em.g_avg, (r.start_us - j.release_us) / 1e6 AS wait_s, (r.end_us - j.release_us) / 1e6 AS turn_s,
            greatest(1.0, ((r.start_us - j.release_us) / 1e6 + j.run_s) / greatest(j.run_s, 10.0)) AS bsld, (r.start_us - j.trace_start_us) / 1e6 AS late_s FROM {runs} r JOIN jobs j USING (job_id) JOIN em USING (scenario_id, job_id))""",
        "me AS (SELECT scenario_id, start_us AS at_us, 1 AS o, kwh * 3600000.0 / run_s AS w, nodes AS n FROM mm UNION ALL SELECT scenario_id, end_us, 0, -kwh * 3600000.0 / run_s, -nodes FROM mm)",
        "ml AS (SELECT scenario_id, sum(w) OVER p AS w, sum(n) OVER p AS n FROM me WINDOW p AS (PARTITION BY scenario_id ORDER BY at_us, o ROWS UNBOUNDED PRECEDING))",
        "mp AS (SELECT scenario_id, greatest(0, max(w)) AS peak_w, CAST(greatest(0, max(n)) AS BIGINT) AS peak_n FROM ml GROUP BY scenario_id)",
        f"""flat AS (SELECT scenario_id AS scheduler, count(*) AS jobs, sum(g) / 1e6 AS total_emissions_tco2e, avg(g) AS mean_emissions_gco2e, sum(kwh) / 1e3 AS total_energy_mwh, any_value(peak_w) / 1e6 AS peak_power_mw, (sum(g_avg) - sum(g)) / sum(g) AS average_model_gap,
            {dist("wait_s", "waiting", "mean", "median", "p95", "p99", "max")}, {dist("turn_s", "turnaround", "mean", "median")}, {dist("bsld", "bounded_slowdown", "mean", "median", "p95", "max")}, CAST({nodes} AS INTEGER) AS total_nodes, any_value(peak_n) AS peak_busy_nodes,
            sum(nodes * run_s) / ({nodes} * any_value(span)) AS utilisation, any_value(span) / 86400.0 AS makespan_days, count(*) / (any_value(span) / 3600.0) AS throughput_jobs_per_hour, {dist("late_s", "delay_vs_trace", "mean", "max")}
            FROM mm JOIN mp USING (scenario_id) JOIN (SELECT scenario_id, (greatest(max(end_us), max(last_event_us)) - min(release_us)) / 1e6 AS span FROM mm GROUP BY scenario_id) USING (scenario_id) GROUP BY scenario_id)""",
    ]


_FLAT = [
    "total_emissions_tco2e", "mean_emissions_gco2e", "total_energy_mwh", "peak_power_mw", "average_model_gap", "waiting_mean_s", "waiting_median_s", "waiting_p95_s", "waiting_p99_s", "waiting_max_s", "turnaround_mean_s", "turnaround_median_s",
    "bounded_slowdown_mean", "bounded_slowdown_median", "bounded_slowdown_p95", "bounded_slowdown_max", "utilisation", "makespan_days", "throughput_jobs_per_hour", "delay_vs_trace_mean_s", "delay_vs_trace_max_s",
]
_FLAT_SQL = "jobs, total_nodes, peak_busy_nodes, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FLAT)
_PLAIN_PEAK = """fk AS (SELECT job_id, sum(w * len_s / 3600000.0) AS kwh FROM segs GROUP BY job_id),
fe AS (SELECT start_us AS at_us, 1 AS o, kwh * 3600000.0 / run_s AS w FROM runs JOIN fk USING (job_id) JOIN jobs USING (job_id) WHERE scenario_id = 'fcfs' UNION ALL SELECT end_us, 0, -kwh * 3600000.0 / run_s FROM runs JOIN fk USING (job_id) JOIN jobs USING (job_id) WHERE scenario_id = 'fcfs'),
fp AS (SELECT max(v) AS peak_w FROM (SELECT sum(w) OVER (ORDER BY at_us, o ROWS UNBOUNDED PRECEDING) AS v FROM fe))"""


@query("X15_compare_baselines", with_sql(JOBS, SEGS, SIGNAL, _scen(_easy("fcfs", f"4 * {_CAP}", bf="false"), _easy("easy", f"4 * {_CAP}")), *events_sql.schedules("runs", "scen"), _PLAIN_PEAK,
    _scen(_easy("power-cap", f"4 * {_CAP}", f"{experiments.CAP_FRACTION} * (SELECT peak_w FROM fp)"), name="scen2"), *events_sql.schedules("capped", "scen2"),
    "every AS (SELECT scenario_id, job_id, start_us, end_us, last_event_us FROM runs UNION ALL SELECT scenario_id, job_id, start_us, end_us, last_event_us FROM capped UNION ALL SELECT 'replay', job_id, trace_start_us, trace_start_us + 1000000 * run_n, trace_start_us + 1000000 * run_n FROM jobs)",
    *_flat("every", f"(4 * {_CAP})"), select=f"SELECT scheduler, {_FLAT_SQL} FROM flat", recursive=True))
def _(spark, sf):
    j = fx.jobs(spark, sf)
    return _rounded(metrics.flat_row(experiments.compare_baselines(j, fx.signal(spark), 4 * _nodes(j))))


_SWEEP = _scen(_easy("fcfs", f"2 * {_CAP}", est="scheduling", bf="false"), _easy("easy", f"2 * {_CAP}", est="scheduling"), *[_easy(f"carbon-{h}h-15min", f"2 * {_CAP}", est="scheduling", delay=h * HOUR) for h in experiments.DELAY_HOURS])


@query("X14_X16_K3_carbon_sweep", with_sql(JOBS, SEGS, SIGNAL, _targets(_DELAYS), _SWEEP, *events_sql.schedules("runs", "scen", _DELAYS), *_flat("runs", f"(2 * {_CAP})"), select=f"""SELECT delay / 3.6e9 AS max_delay_hours, CASE WHEN delay IS NOT NULL THEN 15.0 END AS granularity_minutes,
    round(((SELECT total_emissions_tco2e FROM flat WHERE scheduler = 'easy') - total_emissions_tco2e) / (SELECT total_emissions_tco2e FROM flat WHERE scheduler = 'easy'), 6) AS saved_fraction, {_FLAT_SQL} FROM flat JOIN scen ON sid = scheduler""", recursive=True))
def _(spark, sf):
    """The sweep over all budgets, through its CSV file."""
    j = fx.jobs(spark, sf)
    points = experiments.carbon_sweep(j, fx.signal(spark), 2 * _nodes(j))
    return _rounded(spark.read.schema(sinks.sweep_rows(points).schema).option("header", True).csv(sinks.write_sweep(points, place(spark, "sweep"))))


_SINGLE = (JOBS, SEGS, SIGNAL, _scen(_easy("easy")), *events_sql.schedules("runs", "scen"), *_flat("runs", _CAP))


@query("X17_single_run", with_sql(*_SINGLE, select=f"SELECT scheduler, {_FLAT_SQL} FROM flat", recursive=True))
def _(spark, sf):
    j = fx.jobs(spark, sf)
    return _rounded(metrics.flat_row(experiments.single_run(j, fx.signal(spark), experiments.scenario("easy", "easy", _nodes(j)))[1]))


@query("K6_console_table", with_sql(*_ACC, "runs AS (SELECT 'replay' AS scenario_id, job_id, start_us, end_us, end_us AS last_event_us FROM acc)", *_flat("runs", "2000"), f"""named AS (SELECT CAST(jobs AS DOUBLE) AS jobs, CAST(total_nodes AS DOUBLE) AS total_nodes, CAST(peak_busy_nodes AS DOUBLE) AS peak_busy_nodes, {", ".join(_FLAT)} FROM flat)""",
    select="SELECT metric, CAST(CAST(v AS DECIMAL(28, 3)) AS DOUBLE) AS replay FROM named UNPIVOT INCLUDE NULLS (v FOR metric IN (*))"))
def _(spark, sf):
    """The printed table: one text of three digits per metric, read back as a number."""
    told = sinks.console_table(metrics.schedule_metrics(_accounted(spark, sf), _one(2000, spark)))
    return told.select("metric", F.regexp_replace("replay", ",", "").cast("double").alias("replay"))


# ---- streaming -----------------------------------------------------------------------------------------------

@query("stream_windowed_emissions", with_sql(JOBS, SEGS, SIGNAL, select="""SELECT end_us - end_us % 3600000000 AS window_us, round(sum(kwh), 6) AS kwh, round(sum(kwh * ci), 4) AS gco2e, count(*) AS segments
    FROM (SELECT release_us + 1000000 * run_n AS end_us, release_us + 20000000 * i AS at_us, w * len_s / 3600000.0 AS kwh FROM segs) s JOIN sig ON sig.bucket_us = at_us - at_us % 900000000 GROUP BY 1"""))
def _(spark, sf):
    """All jobs as a stream that ends; every batch replaces the table of window sums."""
    stored_jobs = fx.jobs(spark, sf)
    table = place(spark, "windows")
    source = spark.readStream.schema(stored_jobs.schema).parquet(stored_jobs.inputFiles()[0].rsplit("/", 1)[0])
    sums = completed_jobs.windowed_emissions(completed_jobs.completion_stream(source.withColumn("start_us", F.col("release_us"))), fx.signal(spark))
    run = sums.writeStream.outputMode("complete").option("checkpointLocation", place(spark, "stream")).trigger(availableNow=True)
    run.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(table)).start().awaitTermination()
    return spark.read.parquet(table).select(F.unix_micros("window_start").alias("window_us"), _r("kwh").alias("kwh"), _r("gco2e", 4).alias("gco2e"), "segments")
