import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.helpers import BASE, S, job, jobs, random_jobs, signal, starts
from wattloom.errors import CapacityError, PlacementError
from wattloom.operators import placement
from wattloom.operators.placement import Capped, Held, Job, Machine, Policy, Strict
from wattloom.plans import experiments


def run(spark, rows, nodes, policy, signal=None, **options):
    return placement.simulate(jobs(spark, *rows), experiments.scenarios(spark, [experiments.scenario("s", policy, nodes, **options)]), signal)


HOLD = [job(1, 0, 100, 3), job(2, 1, 10, 4), job(3, 2, 10, 1)]


def test_fcfs_hand_cases(spark):
    assert starts(run(spark, [job(1, 0, 100, 2), job(2, 0, 50), job(3, 0, 50)], 2, "fcfs")) == {1: 0, 2: 100, 3: 100}
    assert starts(run(spark, [job(1, 0, 100), job(2, 100, 10)], 1, "fcfs")) == {1: 0, 2: 100}
    assert starts(run(spark, HOLD, 4, "fcfs")) == {1: 0, 2: 100, 3: 110}
    assert starts(placement.fcfs_fold(jobs(spark, *HOLD), 4)) == {1: 0, 2: 100, 3: 110}


def test_queue_ties_are_ordered_by_id_as_text(spark):
    assert starts(run(spark, [job(2, 0, 10), job(10, 0, 10)], 1, "fcfs")) == {10: 0, 2: 10}


def test_easy_hand_cases(spark):
    rows = {r["job_id"]: r for r in run(spark, HOLD, 4, "easy", estimate="scheduling").collect()}
    assert [(rows[i]["start_us"] - BASE) / S for i in (1, 2, 3)] == [0, 100, 2]
    assert rows[3]["backfilled"] and not rows[2]["backfilled"] and rows[2]["first_reservation_us"] == BASE + 100 * S
    long = [*HOLD[:2], job(3, 2, 500, 1)]
    assert starts(run(spark, long, 4, "easy", estimate="scheduling")) == {1: 0, 2: 100, 3: 110}
    assert starts(run(spark, long, 5, "easy", estimate="scheduling")) == {1: 0, 2: 100, 3: 2}
    limits = [job(1, 0, 100, 3, limit=100), job(2, 1, 10, 4, limit=10), job(3, 2, 10, 1, limit=900)]
    assert not any(r["backfilled"] for r in run(spark, limits, 4, "easy").collect())


def test_power_cap(spark):
    rows = [job(i, 0, 60, 1, 1000) for i in range(4)]
    assert sorted(starts(run(spark, rows, 4, "power-cap", cap_w=2500.0)).values()) == [0, 0, 60, 60]
    with pytest.raises(Exception, match="above the cap"):
        run(spark, [job(1, 0, 60, 1, 9000)], 4, "power-cap", cap_w=2500.0).collect()
    with pytest.raises(ValueError):
        Capped(0.0)


def test_replay(spark):
    late = jobs(spark, job(1, 0, 10, trace=500), job(2, 0, 10, trace=100))
    assert starts(placement.replay(late, 1)) == {1: 500, 2: 100}
    with pytest.raises(CapacityError):
        placement.replay(jobs(spark, job(1, 0, 100, trace=0), job(2, 0, 100, trace=0)), 1)
    with pytest.raises(Exception, match="no trace start"):
        placement.replay(jobs(spark, job(1)), 1, check=False).collect()


def test_oversized_and_repeated_jobs_are_rejected(spark):
    with pytest.raises(CapacityError):
        placement.reject_oversized(jobs(spark, job(1, nodes=9)), 8)
    with pytest.raises(Exception, match="need more than 8 nodes"):
        run(spark, [job(1, nodes=9)], 8, "fcfs").collect()
    with pytest.raises(PlacementError):
        run(spark, [job(1), job(1)], 8, "fcfs")


def test_zero_delay_budget_equals_easy_and_targets_keep_their_budget(spark):
    rows, s = random_jobs(5, 60), signal(spark, [(i * 37) % 200 + 100 for i in range(96)])
    assert starts(run(spark, rows, 16, "carbon-aware", s, max_delay_us=0, estimate="scheduling")) == starts(run(spark, rows, 16, "easy", estimate="scheduling"))
    release = {r[0]: r[3] for r in rows}
    for r in run(spark, rows, 64, "carbon-aware", s, max_delay_us=3600 * S).collect():
        assert release[r["job_id"]] <= r["target_us"] <= release[r["job_id"]] + 3600 * S and r["start_us"] >= r["target_us"]


def test_custom_policy_and_boundaries(spark):
    policy = Policy()
    policy.boundary_us = 900 * S
    table = spark.createDataFrame([("w", "watch", 4, None, None, None, None, None)], "scenario_id string, policy string, total_nodes int, estimate string, window int, cap_w double, max_delay_us long, grid_us long")
    rows = placement.simulate(jobs(spark, *HOLD), table, custom={"watch": policy}).collect()
    assert {r["last_event_us"] for r in rows} == {BASE + 900 * S}


def _machine(work, nodes, policy):
    m = Machine([Job(*w) for w in work], nodes, policy)
    m.run()
    return m


workloads = st.lists(st.tuples(st.integers(0, 400), st.integers(1, 8), st.integers(1, 90), st.integers(0, 60), st.integers(1, 50)), min_size=1, max_size=25)


@settings(max_examples=150, deadline=None)
@given(workloads)
def test_placement_properties(rows):
    work = [(i, str(i), rel, nodes, run, run + over, watts, rel + over) for i, (rel, nodes, run, over, watts) in enumerate(rows)]
    exact = [(*w[:5], w[4], *w[6:]) for w in work]
    for policy, jobs_ in ((Strict(), work), (Policy(), work), (Policy(), exact), (Policy(2), work), (Capped(60.0), work), (Held(), exact)):
        m = _machine(jobs_, 8, policy)
        for t in {j.start for j in m.jobs}:
            running = [j for j in m.jobs if j.start <= t < j.start + j.run]
            assert sum(j.nodes for j in running) <= 8
            if isinstance(policy, Capped):
                assert sum(j.watts for j in running) <= 60
        assert all(j.start >= j.release for j in m.jobs)
        if isinstance(policy, Strict):
            order = sorted(m.jobs)
            assert all(a.start <= b.start for a, b in zip(order, order[1:]))
        if isinstance(policy, Held):
            assert all(j.start >= j.target for j in m.jobs)
        if type(policy) is Policy and policy.window is None and jobs_ is exact:
            by_id = {j.id: j for j in m.jobs}
            assert all(by_id[i].start <= when for i, when in m.first_reservation.items())


def test_wake_up_in_the_past_raises():
    class Bad(Policy):
        def on_release(self, job, now):
            return now - 1

    with pytest.raises(PlacementError):
        _machine([(1, "1", 5, 1, 1, 1, 1.0)], 1, Bad())


def test_comparison_and_sweep(spark):
    rows = [(*r[:7], r[3], *r[8:]) for r in random_jobs(7, 40)]
    j, s = jobs(spark, *rows), signal(spark, [(i * 53) % 300 + 50 for i in range(200)])
    got = {r["policy"]: r for r in experiments.compare_baselines(j, s, 10_000, "scheduling").collect()}
    assert set(got) == {"replay", "fcfs", "easy", "power-cap"}
    assert max(r["total_energy_kwh"] for r in got.values()) == pytest.approx(min(r["total_energy_kwh"] for r in got.values()))
    assert got["power-cap"]["peak_power_watts"] <= 0.8 * got["fcfs"]["peak_power_watts"] + 1e-6
    points = {r["scenario_id"]: r["saved"] for r in experiments.carbon_sweep(j, s, 64, (0, 1, 6)).collect()}
    assert points["easy"] == 0 and points["carbon-0h-15min"] == pytest.approx(0)


class Walked(Policy):
    """Not one of the built-in types, so that its queue is walked job by job."""


class WalkedCapped(Capped):
    """The same under a cap."""


def _told(m):
    return {j.id: (j.start, j.id in m.backfilled, m.first_reservation.get(j.id)) for j in m.jobs}


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 400))
def test_indexed_queue_starts_what_a_walk_starts(rnd, n):
    """Deep queues: all jobs come within a short time."""
    work = [(i, str(i), rnd.randrange(60), rnd.randint(1, 6), run := rnd.randint(1, 60), run + rnd.randrange(40), float(rnd.randint(1, 50))) for i in range(n)]
    for indexed, walked in ((Policy(), Walked()), (Capped(70.0), WalkedCapped(70.0))):
        a, b = _machine(work, 8, indexed), _machine(work, 8, walked)
        assert a.indexed and not b.indexed and _told(a) == _told(b)


def test_jobs_are_read_as_they_are_released():
    """A machine with a sink holds what waits and runs, not all jobs; the results are those of a list."""
    work = [(i, f"{i:05}", 10 * i, 1 + i % 3, 25, 30, 1.0) for i in range(5_000)]
    read, held, got = [], [], {}

    def stream():
        for w in work:
            read.append(w[0])
            held.append(len(read) - len(got))
            yield Job(*w)

    Machine(stream(), 6, Policy(), lambda job, filled, reserved: got.update({job.id: (job.start, filled, reserved)})).run()
    assert max(held) < 50 and got == _told(_machine(work, 6, Policy()))
    with pytest.raises(PlacementError, match="in order"):
        Machine(iter([Job(*work[1]), Job(*work[0])]), 6, Policy(), lambda *_: None).run()
    with pytest.raises(CapacityError, match="3333 job.s. need more than 1"):
        Machine(stream(), 1, Policy(), lambda *_: None).run()


def test_targets_of_all_rules_equal_the_best_starts(spark):
    from pyspark.sql import functions as F

    from wattloom.functions import physics
    from wattloom.operators import signal as sig

    rows, s = jobs(spark, *random_jobs(9, 300)), signal(spark, [(i * 37) % 11 + 100 for i in range(120)])
    narrow = rows.select("job_id", "release_us", (physics.scheduling_run_s() * S).cast("long").alias("plan_us"), physics.energy_kwh(physics.scheduling_avg_w(), physics.scheduling_run_s()).alias("kwh"))
    rules = [(0, 900 * S), (3600 * S, 900 * S), (24 * 3600 * S, 900 * S), (7200 * S, 600 * S)]
    got = {r["job_id"]: r["targets"] for r in sig.with_targets(narrow, s, rules).collect()}
    for at, (delay, grid) in enumerate(rules):
        assert {i: t[at] for i, t in got.items()} == {r["job_id"]: r["target_us"] for r in sig.best_starts(rows, s, delay, grid).collect()}
    with pytest.raises(Exception, match="coverage"):
        sig.with_targets(narrow.withColumn("release_us", F.lit(BASE + 119 * 900 * S)), s, rules).collect()
