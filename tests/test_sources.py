import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, S, job, jobs, signal
from wattloom.errors import ConstraintError, ForecastError, GridSourceError, SignalError
from wattloom.functions import constraints, timegrid
from wattloom.operators import cleaning, signal as sig
from wattloom.plans import catalog, fixtures
from wattloom.sources import grid_api, jobs as job_source, signal_cache, sinks

HOUR = 3600 * S


def test_lookup_edges(spark):
    s = signal(spark, [100, 300, 200], start=BASE)
    ask = lambda *us: [r["ci"] for r in sig.lookup(spark.createDataFrame([(BASE + x,) for x in us], "at long"), "at", s, strict=False).orderBy("at").collect()]
    assert ask(900 * S - 1, 900 * S) == [100, 300] and ask(-1) == [None] and ask(2700 * S) == [None]
    n = lambda a, b: sig.range_lookup(spark.createDataFrame([(BASE + a * S, BASE + b * S)], "a long, b long"), "a", "b", s).count()
    assert n(420, 1800) == 2 and n(420, 1801) == 3
    with pytest.raises(Exception, match="must end after"):
        sig.range_lookup(spark.createDataFrame([(BASE, BASE)], "a long, b long"), "a", "b", s).collect()


def test_series_is_validated(spark):
    for rows in ([(BASE + 1, 1.0)], [(BASE, -1.0)], [(BASE, 1.0), (BASE, 1.0)], []):
        with pytest.raises(SignalError):
            sig.build_series(spark.createDataFrame(rows, "bucket_us long, ci double"))
    with pytest.raises(SignalError):
        sig.merge_samples(spark.createDataFrame([(BASE, 1.0), (BASE, 2.0)], "bucket_us long, ci double"))
    with pytest.raises(Exception, match="gap"):
        sig.with_integral(signal(spark, [1, 2, 3]).where(F.col("ci") != 2)).collect()
    with pytest.raises(ForecastError):
        sig.forecast(None, 0, 1)


def test_mean_intensity_reaches_the_end_of_coverage(spark):
    df = spark.createDataFrame([(BASE, BASE + 1800 * S), (BASE + 450 * S, BASE + 1350 * S)], "a long, b long")
    assert [r["mean_ci"] for r in sig.mean_intensity(df, "a", "b", signal(spark, [100, 300])).orderBy("a").collect()] == [200, 200]
    with pytest.raises(Exception, match="coverage"):
        sig.mean_intensity(df, "a", "b", signal(spark, [100])).collect()


def test_candidates(spark):
    n = lambda rel, delay: [(r["start_us"] - BASE) // S for r in sig.candidate_starts(jobs(spark, job(1, rel)), delay * S).collect()]
    assert n(10, 60) == [10] and n(10, 890) == [10, 900] and n(0, 1800) == [0, 900, 1800]


def test_times(spark):
    df = spark.createDataFrame([("2020-05-06T02:00:00+02:00",), ("2020-05-06T00:00:00Z",)], "t string")
    assert {r[0] for r in df.select(timegrid.parse_iso(F.col("t"))).collect()} == {BASE}
    with pytest.raises(Exception, match="without a zone"):
        spark.createDataFrame([("2020-05-06T02:00:00",)], "t string").select(timegrid.parse_iso(F.col("t"))).collect()


def test_cache_round_trip_and_corruption(spark, tmp_path):
    path = str(tmp_path / "s.json")
    signal_cache.save_signal(signal(spark, [1, 2.5]), path, 900 * S, {"zone": "X", "n": [1, None]})
    got, grid, meta = signal_cache.load_signal(spark, path)
    assert grid == 900 * S and meta == {"zone": "X", "n": [1, None]} and [r["ci"] for r in got.collect()] == [1, 2.5]
    good = json.load(open(path))
    for change in ({"schema_version": True}, {"schema_version": 2}, {"granularity_seconds": "900"}, {"granularity_seconds": -1}, {"samples": {}}, {"metadata": []}, {"samples": [{"timestamp": "2020-05-06T00:00:00Z"}]}):
        (tmp_path / "bad.json").write_text(json.dumps(good | change))
        with pytest.raises(SignalError):
            signal_cache.load_signal(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        signal_cache.checked_metadata({"x": float("nan")})


def test_chunks():
    us = lambda *d: int((datetime(*d) - datetime(1970, 1, 1)).total_seconds()) * S
    parts = grid_api.chunks(us(2020, 4, 30), us(2020, 11, 2))
    assert len(parts) == 93 and (parts[-1][1] - parts[0][0]) // (900 * S) == 17856
    with pytest.raises(ValueError):
        grid_api.chunks(0, 1, 5)


class Wrong(catalog.FakeService):
    def __init__(self, change):
        self.change = change

    def __call__(self, url, headers):
        payload = super().__call__(url, headers)
        assert headers == {"auth-token": "t"}
        return self.change(payload)


def test_grid_source(spark):
    options = {"url": "http://grid.invalid", "zone": "Z", "start_us": fixtures.FIRST_US, "end_us": fixtures.FIRST_US + 50 * HOUR, "token": "t"}
    assert grid_api.fetch_signal(spark, Wrong(lambda p: p), **options).count() == 200
    for change in (lambda p: p | {"zone": "Y"}, lambda p: p | {"unit": "kg"}, lambda p: p | {"data": None}, lambda p: p | {"data": p["data"][1:]}, lambda p: p | {"data": [p["data"][0] | {"carbonIntensity": -1}]}):
        with pytest.raises(Exception):
            grid_api.fetch_signal(spark, Wrong(change), **options)
    with pytest.raises(Exception, match="estimated"):
        grid_api.fetch_signal(spark, Wrong(lambda p: p), include_estimated=False, **options)


def test_token(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("A=1\nTOKEN='abc'\n")
    assert grid_api.read_token(str(tmp_path / "env"), "TOKEN") == "abc"
    monkeypatch.setenv("TOKEN", "own")
    assert grid_api.read_token(None, "TOKEN") == "own"
    with pytest.raises(GridSourceError):
        grid_api.read_token(None, "NONE_SUCH")


def test_job_scan(spark, tmp_path, sf_dir):
    clean = cleaning.clean(cleaning.with_derived(fixtures.raw_trace(spark, sf_dir)))
    clean.write.parquet(str(tmp_path / "clean"))
    got = job_source.load_jobs(spark, str(tmp_path / "clean"), limit=10)
    assert got.count() == 10 and constraints.violations(got, constraints.job_rules(), "job_id").isEmpty()
    with pytest.raises(ValueError):
        job_source.load_jobs(spark, str(tmp_path / "clean"), limit=0)
    with pytest.raises(ValueError):
        job_source.load_jobs(spark, str(tmp_path / "clean"), released_from=datetime(2030, 1, 1))


def test_violations_name_the_rule(spark):
    bad = jobs(spark, job(1, 0, -1.0), job(2, 0, 10, nodes=0), job(3, 0, 10, profile=[]))
    assert {(r["job_id"], r["rule"]) for r in constraints.violations(bad, constraints.job_rules(), "job_id").collect()} == {(1, "runtime_positive_finite"), (2, "nodes_positive"), (3, "profile_non_empty_non_negative")}


def test_clean_outputs(spark, tmp_path, sf_dir):
    out = sinks.write_clean_outputs(fixtures.raw_trace(spark, sf_dir), str(tmp_path), 50)
    assert spark.read.parquet(out["debug"]).count() == 50
    ledger = spark.read.option("header", True).csv(out["ledger"]).collect()
    assert ledger[0]["stage"] == "raw" and int(ledger[-1]["rows_remaining"]) == spark.read.parquet(out["clean"]).count()
    manifest = json.loads("".join(r[0] for r in spark.read.text(out["manifest"]).collect()))
    assert manifest["outputs"]["debug_rows"] == 50 and sinks.default_name("Sweep", "IT-NO 1") == "Sweep_it_no_1"


def test_facts_about_no_rows_are_null(spark, sf_dir):
    none = cleaning.with_derived(fixtures.raw_trace(spark, sf_dir)).where("job_id < 0")
    told = {r["assertion"]: r["passed"] for r in cleaning.postconditions(none).collect()}
    assert told.pop("nonempty") is False and told.pop("unique_job_id") is True and set(told.values()) == {None} and len(told) == 10
    with pytest.raises(ConstraintError, match="nonempty"):
        cleaning.require_clean(none)


def test_outputs_of_a_trace_without_clean_rows(spark, tmp_path, sf_dir):
    raw = fixtures.raw_trace(spark, sf_dir).withColumn("job_state", F.lit("FAILED"))
    out = sinks.write_clean_outputs(raw, str(tmp_path))
    assert spark.read.parquet(out["clean"]).count() == 0 and spark.read.parquet(out["debug"]).count() == 0
    ledger = {r["stage"]: int(r["rows_remaining"]) for r in spark.read.option("header", True).csv(out["ledger"]).collect()}
    assert ledger["raw"] == raw.count() and ledger["completed"] == 0
    manifest = json.loads("".join(r[0] for r in spark.read.text(out["manifest"]).collect()))
    assert manifest["status"] == "empty" and manifest["outputs"]["clean_rows"] == 0


def test_written_tables_of_a_trace_without_clean_rows(spark, tmp_path):
    """All jobs within a minute, so that every job shares a node with another."""
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") % 60 * 1_000_000).cast("timestamp_ntz")
    spark.range(2_000).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit('{"k": 5}').alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["output"]: tuple(r)[1:] for r in catalog.QUERIES["K5_written_tables"](spark, str(tmp_path)).collect()}
    assert got == {"clean": (0, None, None), "debug": (0, None, None), "catalogue": (15, 1, 1), "manifest": (2_000, 0, 0)}


def test_overlaps_are_found_in_one_pass(spark, sf_dir):
    assert cleaning.overlap_jobs(fixtures.raw_trace(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


@pytest.mark.parametrize("few", [True, False])
def test_clean_rows_from_marks(spark, sf_dir, monkeypatch, few):
    """Also with null ids, and a clean id that another row repeats with a broken rule of its own."""
    raw = fixtures.raw_trace(spark, sf_dir)
    bad = raw.where("job_id < 200").withColumn("job_state", F.lit("FAILED")).withColumn("nodes", F.array(F.col("job_id") + 10_000))
    raw = raw.withColumn("job_id", F.when(F.col("job_id") % 100 != 9, F.col("job_id"))).union(bad)
    if not few:
        monkeypatch.setattr(cleaning, "small", lambda df: df)
    derived = cleaning.with_derived(raw)
    got, want = cleaning.clean_of(raw, cleaning.marked(derived)), cleaning.clean(derived)
    assert got.schema == want.schema and got.count() == want.count() > 100 and got.where("job_id is null").count() > 0
    assert got.exceptAll(want).isEmpty()
    if few:  # the rows meet the ids without a shuffle
        assert [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftSemi" in x and "rightHint=(strategy=broadcast)" in x]


def test_streamed_emissions_equal_the_batch(spark, sf_dir, tmp_path):
    from wattloom.streaming.completed_jobs import completion_stream, windowed_emissions

    j = completion_stream(fixtures.jobs(spark, sf_dir).withColumn("start_us", F.col("release_us")))
    j.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(j.schema).parquet(str(tmp_path / "in"))
    q = windowed_emissions(stream, fixtures.signal(spark), "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("emissions").start()
    q.processAllAvailable()
    q.stop()
    want = windowed_emissions(j, fixtures.signal(spark), "1 day")
    assert spark.sql("select sum(gco2e), sum(segments) from emissions").first()[0] == pytest.approx(want.agg(F.sum("gco2e")).first()[0])
