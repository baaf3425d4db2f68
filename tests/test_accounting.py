import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, S, job, jobs, signal
from wattloom.errors import ConstraintError, CoverageError
from wattloom.functions import physics, stats
from wattloom.operators import accounting, metrics


def one(spark, j, s, model="measured"):
    return accounting.account(jobs(spark, j), s, "release_us", model).first()


def test_time_shift_keeps_energy(spark):
    s = signal(spark, [100] * 4 + [400] * 8)
    a, b = one(spark, job(1, 0, 3600), s, "average"), one(spark, job(1, 3600, 3600), s, "average")
    assert (a["gco2e"], b["gco2e"]) == (pytest.approx(100), pytest.approx(400)) and a["kwh"] == b["kwh"] == 1


def test_shape_trim_hold_and_gap(spark):
    s = signal(spark, [100] + [500] * 9, grid=20 * S)
    shape = job(1, 0, 40, avg_w=1500, profile=[1000.0, 2000.0])
    for model, g in (("average", 5.0), ("measured", 55 / 9)):
        got = accounting.account(jobs(spark, shape), s, "release_us", model, 20 * S).first()
        assert got["kwh"] == pytest.approx(1 / 60) and got["gco2e"] == pytest.approx(g)
    trim = jobs(spark, job(1, 0, 30, profile=[1000.0, 2000.0]))
    assert trim.select(accounting.measured_energy()).first()[0] == pytest.approx(40000 / 3.6e6)
    assert trim.select(accounting.weighted_mean_power()).first()[0] == pytest.approx(4000 / 3)
    hold = jobs(spark, job(1, 0, 30, profile=[1000.0]))
    assert hold.select(accounting.measured_energy()).first()[0] == pytest.approx(30000 / 3.6e6)
    with pytest.raises(Exception, match="more than one interval"):
        accounting.account(jobs(spark, job(1, 0, 41, profile=[1000.0])), s, "release_us", grid_us=20 * S).collect()


def test_fractional_intervals_have_exact_segments(spark):
    rows = accounting.segments(jobs(spark, job(1, 0, 1.0, interval=0.2)), "average").orderBy("seg").collect()
    assert len(rows) == 5 and rows[-1]["offset_s"] == pytest.approx(0.8) and sum(r["length_s"] for r in rows) == pytest.approx(1.0)


def test_constant_signal_and_buckets(spark):
    got = accounting.account(jobs(spark, job(1, 0, 1800)), 100.0, "release_us", "average").first()
    assert got["gco2e"] == pytest.approx(50)
    assert one(spark, job(1, 0, 1800), signal(spark, [100, 300]), "average")["gco2e"] == pytest.approx(100)
    with pytest.raises(Exception, match="no carbon intensity"):
        accounting.account(jobs(spark, job(1, 0, 1801)), signal(spark, [100, 300]), "release_us", "average").collect()
    with pytest.raises(ValueError):
        accounting.account(jobs(spark, job(1)), -1.0)


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="outside the range"):
        jobs(spark, job(1, 0, 1e300, avg_w=1e300)).select(physics.energy_kwh(F.col("avg_w"), F.col("run_s"))).collect()


def _runs(spark, rows, at=0):
    return spark.createDataFrame([("s", r[0], r[3] + at * S, r[3] + at * S + round(r[5] * S)) for r in rows], "scenario_id string, job_id long, start_us long, end_us long")


def test_account_runs(spark):
    rows = [job(1, 0, 1800, avg_w=2000), job(2, 0, 30, profile=[1000.0, 2000.0], avg_w=4000 / 3)]
    s = signal(spark, [100, 500])
    got = {r["job_id"]: r for r in accounting.account_runs(_runs(spark, rows), jobs(spark, *rows), s).collect()}
    assert got[1]["kwh"] == got[1]["kwh_avg_model"] == pytest.approx(1) and got[1]["gco2e"] == pytest.approx(300)
    assert got[2]["kwh"] == pytest.approx(got[2]["kwh_avg_model"])
    with pytest.raises(CoverageError):
        accounting.account_runs(_runs(spark, rows, 10_000), jobs(spark, *rows), s)
    with pytest.raises(ConstraintError):
        accounting.account_runs(_runs(spark, rows), jobs(spark, rows[0]), s)


def _scored(spark, rows, starts, nodes=1, **options):
    data = [("s", r[0], BASE + int(a * S), BASE + int((a + r[5]) * S), 1.0, 100.0, 1.0, 100.0, r[2], r[3], r[7], r[4]) for r, a in zip(rows, starts)]
    df = spark.createDataFrame(data, "scenario_id string, job_id long, start_us long, end_us long, kwh double, gco2e double, kwh_avg_model double, gco2e_avg_model double, submit_us long, release_us long, trace_start_us long, nodes int")
    return metrics.schedule_metrics(df, spark.createDataFrame([("s", "fcfs", nodes)], "scenario_id string, policy string, total_nodes int"), **options).first()


def test_slowdown_and_references(spark):
    rows = [job(1, 0, 100), job(2, 0, 100), job(3, 0, 1)]
    got = _scored(spark, rows, [0, 100, 100])
    assert got["slowdown"]["max"] == pytest.approx(101 / 10) and got["makespan_seconds"] == 200
    early = [job(1, 30, 10, submit=0)]
    assert _scored(spark, early, [30])["waiting"]["max"] == 0 and _scored(spark, early, [30], reference="submit")["waiting"]["max"] == 30
    assert _scored(spark, early, [30])["delay"]["mean"] is None
    with pytest.raises(ValueError):
        _scored(spark, early, [30], reference="start")


def test_distribution_is_nearest_rank(spark):
    d = spark.range(1, 101).select(F.col("id").cast("double").alias("x")).agg(stats.distribution("x").alias("d")).first()["d"]
    assert (d["median"], d["p95"], d["p99"], d["max"]) == (50.5, 95, 99, 100)


def test_distributions_equal_the_aggregate_without_its_maps(spark):
    rnd = random.Random(5)
    values = [("a", rnd.choice([-3.5, 0.0, 2.0, rnd.uniform(-1e6, 1e6), rnd.uniform(1, 1.002)]), None) for _ in range(3001)]
    values += [("b", rnd.uniform(1, 1.0005), float(rnd.randrange(4))) for _ in range(2000)] + [("b", None, 7.0), ("c", 1.5, None), ("d", None, None)] + [("e", float(i), 1e300) for i in range(20)]
    rows = spark.createDataFrame(values, "k string, x double, y double")
    want = rows.groupBy("k").agg(stats.distribution("x").alias("x"), stats.distribution("y").alias("y"))
    flat = lambda df: {r["k"]: [r[c][q] for c in "xy" for q in ("median", "p95", "p99", "max", "mean")] for r in df.collect()}
    got, want = flat(stats.distributions(rows, "k", {"x": "x", "y": "y"})), flat(want)
    for k in want:
        assert got[k][:4] == want[k][:4] and got[k][5:9] == want[k][5:9] and got[k] == pytest.approx(want[k])
    table = spark.createDataFrame([("s", "fcfs", 9)], "scenario_id string, policy string, total_nodes int")
    runs = spark.createDataFrame([], "scenario_id string, job_id long, start_us long, end_us long, kwh double, gco2e double, kwh_avg_model double, gco2e_avg_model double, submit_us long, release_us long, trace_start_us long, nodes int")
    plan = metrics.schedule_metrics(runs, table)._jdf.queryExecution().analyzed().toString()
    assert "percentile" not in plan and "median(" not in plan  # such an aggregate holds a scenario's values in one task


def test_sweep_ends_before_it_starts(spark):
    runs = spark.createDataFrame([("s", 0, 10, 2.0), ("s", 10, 20, 2.0), ("s", 10, 3_600_000_010, 1.0)], "k string, start_us long, end_us long, n double")
    assert metrics.peak(runs, F.col("n"), "k").first()["peak"] == 3
