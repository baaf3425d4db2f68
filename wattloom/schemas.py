"""Canonical schemas. Times are microseconds since the epoch, UTC, as long: exact and free of session zones."""

JOBS = (
    "job_id long, order_key string, submit_us long, release_us long, nodes int, run_s double, limit_s double,"
    " trace_start_us long, profile_w array<double>, interval_s double, avg_w double, pred_run_s double, pred_avg_w double"
)
SIGNAL = "bucket_us long, ci double, is_estimated boolean, estimation_method string"
SCENARIOS = "scenario_id string, policy string, total_nodes int, estimate string, window int, cap_w double, max_delay_us long, grid_us long"
RUNS = "scenario_id string, job_id long, start_us long, end_us long, backfilled boolean, first_reservation_us long"
SAMPLE_SECONDS = 20.0
BUCKET_US = 15 * 60 * 1_000_000
