"""Placement of jobs on nodes: replay and strict order as relations, backfilling as a grouped map.

A run is sequential within a scenario and independent across scenarios, so scenarios are the
parallel axis: every (policy, budget, grid, capacity) is one group of a grouped map over the narrow job
columns. Profiles never enter a group. Spark sorts a group by release and id, and the machine reads it as a
stream: it holds the jobs that wait or run, never the whole group. Targets of the carbon-aware policy don't
depend on the schedule, so they are computed for all jobs in parallel before placement.
"""

from __future__ import annotations

import heapq
import tempfile
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CapacityError, PlacementError
from ..functions.constraints import duplicates, require_empty
from ..functions.physics import energy_kwh, scheduling_avg_w, scheduling_run_s
from ..functions.timegrid import seconds_us
from ..schemas import RUNS, SCENARIOS
from .metrics import check_capacity
from .signal import with_targets

POLICIES = ("fcfs", "easy", "power-cap", "carbon-aware")
#: Jobs that fcfs_fold() takes: one row holds them all, and each step copies what was placed before.
FOLD_JOBS = 20_000


class Job:
    """What placement knows of a job. Completion uses run_us; planning uses plan_us and watts."""

    __slots__ = ("id", "key", "release", "nodes", "run", "plan", "watts", "target", "start", "estimate_end", "rank")

    def __init__(self, id, order_key, release, nodes, run, plan, watts, target=None):
        self.id, self.key, self.release, self.nodes, self.run, self.plan, self.watts = id, (release, order_key), release, nodes, run, plan, watts
        self.target = release if target is None else target
        self.start = self.estimate_end = None

    def __lt__(self, other):
        return self.key < other.key


class Policy:
    """Seams of a placement policy; a subclass may change any. Instances travel to executors."""

    backfills = True
    #: Whether a job can't be ready before the instant that on_release() gives, so that it needn't stand in the queue until then.
    until_wake = False
    #: Ask for an event at every boundary of this grid while work is left; no built-in policy does.
    boundary_us: int | None = None

    def __init__(self, window: int | None = None):
        if window is not None and window <= 0:
            raise ValueError("the backfill window must be positive")
        self.window = window

    def on_release(self, job: Job, now: int) -> int | None:
        """Called as a job is released; may raise, and may ask for a wake-up at a later instant."""

    def on_boundary(self, now: int) -> None:
        """Called at a boundary event."""

    def ready(self, job: Job, now: int) -> bool:
        """False withholds a job by choice: it is neither started nor protected by a reservation."""
        return True

    def budget(self) -> float:
        """Watts that running jobs may draw together."""
        return float("inf")

    def admits(self, job: Job, nodes: int, watts: float) -> bool:
        return job.nodes <= nodes and job.watts <= watts


class Strict(Policy):
    """First come, first served: stop at the first job that doesn't fit."""

    backfills = False

    def admits(self, job, nodes, watts):
        return job.nodes <= nodes


class Capped(Policy):
    """Backfilling under a power cap; nodes and power are both reserved for the first blocked job."""

    def __init__(self, cap_w: float, window: int | None = None):
        super().__init__(window)
        if not 0 < cap_w < float("inf"):
            raise ValueError("the power cap must be positive and finite")
        self.cap_w = cap_w

    def on_release(self, job, now):
        if job.watts > self.cap_w:
            raise PlacementError(f"job {job.id} draws {job.watts:,.0f} W, above the cap of {self.cap_w:,.0f} W")

    def budget(self):
        return self.cap_w


class Held(Policy):
    """Backfilling over jobs whose target instant has come."""

    until_wake = True

    def on_release(self, job, now):
        return job.target if job.target > now else None

    def ready(self, job, now):
        return job.target <= now


class Alike:
    """Waiting jobs of one node count by rank, in blocks that know their least plan and watts."""

    SIZE = 64
    __slots__ = ("blocks", "heads", "plans", "watts", "least_plan", "least_watts")

    def __init__(self):
        self.blocks, self.heads, self.plans, self.watts = [], [], [], []
        self.least_plan = self.least_watts = None

    def _told(self, i: int) -> None:
        block = self.blocks[i]
        self.heads[i], self.plans[i], self.watts[i] = block[0][0], min(e[1] for e in block), min(e[2] for e in block)

    def add(self, job: Job) -> None:
        entry = (job.rank, job.plan, job.watts, job)
        if not self.blocks:
            self.blocks, self.heads, self.plans, self.watts = [[entry]], [job.rank], [job.plan], [job.watts]
            self.least_plan, self.least_watts = job.plan, job.watts
            return
        i = max(0, bisect_right(self.heads, job.rank) - 1)
        block = self.blocks[i]
        insort(block, entry)
        self.heads[i], self.plans[i], self.watts[i] = block[0][0], min(self.plans[i], job.plan), min(self.watts[i], job.watts)
        self.least_plan, self.least_watts = min(self.least_plan, job.plan), min(self.least_watts, job.watts)
        if len(block) > 2 * self.SIZE:
            self.blocks.insert(i + 1, block[self.SIZE:])
            del block[self.SIZE:]
            for values in (self.heads, self.plans, self.watts):
                values.insert(i + 1, None)
            self._told(i)
            self._told(i + 1)

    def take(self, i: int, k: int) -> Job:
        _, plan, watts, job = self.blocks[i].pop(k)
        if not self.blocks[i]:
            for values in (self.blocks, self.heads, self.plans, self.watts):
                del values[i]
        elif plan == self.plans[i] or watts == self.watts[i]:
            self._told(i)
        else:
            self.heads[i] = self.blocks[i][0][0]
        if self.blocks:
            if plan == self.least_plan:
                self.least_plan = min(self.plans)
            if watts == self.least_watts:
                self.least_watts = min(self.watts)
        return job

    def find(self, watts: float, room: int, spare_watts: float) -> tuple[int, int] | None:
        """Place of the first job within watts that ends within room or draws at most spare_watts."""
        for i, least in enumerate(self.watts):
            if least <= watts and (self.plans[i] <= room or least <= spare_watts):
                for k, (_, plan, draws, _) in enumerate(self.blocks[i]):
                    if draws <= watts and (plan <= room or draws <= spare_watts):
                        return i, k
        return None


class Waiting:
    """The queue of a backfilling policy, by node count: its first job, and the first that meets limits, without a walk over all."""

    def __init__(self):
        self.alike: dict[int, Alike] = {}
        self.counts: list[int] = []  # node counts that wait, in order
        self.size = 0

    def __len__(self):
        return self.size

    def add(self, job: Job) -> None:
        if (alike := self.alike.get(job.nodes)) is None:
            alike = self.alike[job.nodes] = Alike()
        if not alike.blocks:
            insort(self.counts, job.nodes)
        alike.add(job)
        self.size += 1

    def _first(self) -> int:
        """Node count of the first job."""
        rank, first, alike = None, 0, self.alike
        for n in self.counts:
            head = alike[n].heads[0]
            if rank is None or head < rank:
                rank, first = head, n
        return first

    def _take(self, nodes: int, i: int, k: int) -> Job:
        alike = self.alike[nodes]
        job = alike.take(i, k)
        if not alike.blocks:
            self.counts.remove(nodes)
        self.size -= 1
        return job

    def first(self) -> Job:
        return self.alike[self._first()].blocks[0][0][3]

    def take_first(self, nodes: int) -> Job:
        """Takes the first job, which is one of that node count."""
        return self._take(nodes, 0, 0)

    def take(self, nodes: int, watts: float, room: int, spare_nodes: int, spare_watts: float) -> Job | None:
        """The first job within nodes and watts that ends within room or needs no more than the spare nodes and watts."""
        best = None
        for n in self.counts:
            if n > nodes:
                break
            alike = self.alike[n]
            spare = spare_watts if n <= spare_nodes else float("-inf")
            if alike.least_watts > watts or (alike.least_plan > room and alike.least_watts > spare) or (best is not None and alike.heads[0] > best[0]):
                continue
            if (at := alike.find(watts, room, spare)) is not None and (best is None or alike.blocks[at[0]][at[1]][0] < best[0]):
                best = alike.blocks[at[0]][at[1]][0], n, *at
        return None if best is None else self._take(*best[1:])


class Machine:
    """One scenario: an event clock over releases, completions, wake-ups and grid boundaries."""

    def __init__(self, jobs: Iterable[Job], total_nodes: int, policy: Policy, sink: Callable | None = None):
        """With a sink, jobs come in order of release and key, with no id twice; none is kept after sink(job, backfilled, first reservation)."""
        if total_nodes <= 0:
            raise ValueError("a machine needs at least one node")
        self.total = total_nodes
        if sink is None:
            self._reject(j for j in sorted(jobs, key=lambda j: j.key) if j.nodes > total_nodes)
            if len({j.id for j in jobs}) != len(jobs):
                raise PlacementError("job ids must be unique")
        self.jobs, self.policy, self.sink = jobs, policy, sink
        # Jobs wait by their needs where the first that fits is all that a policy asks for, else in one list.
        self.indexed = type(policy) in (Policy, Capped, Held) and policy.window is None and not {"ready", "admits"} & vars(policy).keys()
        self.free, self.queue, self.running = total_nodes, Waiting() if self.indexed else [], {}
        self.watts = 0.0  # that running jobs draw
        self.ends: list[tuple] = []  # (planned end, rank, job) of running jobs, in order
        self.first_reservation: dict = {}
        self.backfilled: set = set()
        self.now = self.last_event = None

    def _reject(self, big: Iterable[Job]) -> None:
        count, first = 0, []
        for job in big:
            count += 1
            first += [str(job.id)] if count <= 5 else []
        if count:
            raise CapacityError(f"{count} job(s) need more than {self.total} nodes, first " + ", ".join(first))

    def _arrivals(self) -> Iterator[Job]:
        """All jobs in order, ranked."""
        rank, last = 0, None
        jobs = iter(sorted(self.jobs, key=lambda j: j.key) if self.sink is None else self.jobs)
        for job in jobs:
            if job.nodes > self.total:
                self._reject([job, *(j for j in jobs if j.nodes > self.total)])
            if last is not None and job.release < last:
                raise PlacementError("jobs must come in order of their release")
            job.rank, last = rank, job.release
            rank += 1
            yield job

    def wake_at(self, when: int) -> None:
        if when < self.now:
            raise PlacementError("a wake-up lies in the past")
        if when > self.now:
            heapq.heappush(self._events, (when, 2, 0, None))

    def run(self) -> None:
        policy, boundary, asks = self.policy, self.policy.boundary_us, type(self.policy).on_release is not Policy.on_release or "on_release" in vars(self.policy)
        arrivals = self._arrivals()
        coming = next(arrivals, None)
        events, serial, pending = [], 0, False
        self._events = events
        if boundary and coming is not None:
            heapq.heappush(events, (coming.release - coming.release % boundary + boundary, 3, 0, None))
            pending = True
        while events or coming is not None:
            now = events[0][0] if events and (coming is None or events[0][0] <= coming.release) else coming.release
            self.now = self.last_event = now
            woken = []
            while events and events[0][0] == now:
                _, kind, _, job = heapq.heappop(events)
                if kind == 0:
                    self.free += job.nodes
                    del self.running[job.id]
                    self.watts = self.watts - job.watts if self.running else 0.0
                    if policy.backfills:
                        del self.ends[bisect_left(self.ends, (job.estimate_end, job.rank))]
                elif kind == 2 and job is not None:
                    woken.append(job)
                elif kind == 3:
                    pending = False
                    policy.on_boundary(now)
            while coming is not None and coming.release == now:
                job, coming = coming, next(arrivals, None)
                when = policy.on_release(job, now) if asks else None
                if when is not None and when > now and policy.until_wake:
                    serial += 1
                    heapq.heappush(events, (when, 2, serial, job))
                    continue
                if when is not None:
                    self.wake_at(when)
                woken.append(job)
            for job in woken:
                if self.indexed:
                    self.queue.add(job)
                else:
                    insort(self.queue, (job.rank, job))
            for job in (self._first_fits() if self.indexed else self._scan()) if self.queue else ():
                if job.nodes > self.free:
                    raise CapacityError(f"job {job.id} was started without room")
                self.free -= job.nodes
                job.start, job.estimate_end = now, now + job.plan
                self.running[job.id] = job
                self.watts += job.watts
                if policy.backfills:
                    insort(self.ends, (job.estimate_end, job.rank, job))
                serial += 1
                heapq.heappush(events, (now + job.run, 0, serial, job))
                if self.sink is not None:
                    filled = job.id in self.backfilled
                    self.backfilled.discard(job.id)
                    self.sink(job, filled, self.first_reservation.pop(job.id, None))
            if boundary and not pending and (self.queue or self.running):
                heapq.heappush(events, (now - now % boundary + boundary, 3, 0, None))
                pending = True
        if self.queue:
            raise PlacementError(f"{len(self.queue)} job(s) never started, first {(self.queue.first() if self.indexed else self.queue[0][1]).id}")

    def _left(self) -> tuple[int, float]:
        """Nodes and watts that are free now."""
        budget = self.policy.budget()
        return self.free, budget - self.watts if budget != float("inf") else budget

    def _first_fits(self) -> list[Job]:
        """What starts now, taken from the waiting jobs: the head of the line, then always the first job that may pass the blocked one.

        Room only shrinks meanwhile, so a job that was passed over stays so, and the search may begin anew for each.
        """
        (nodes, watts), line, started = self._left(), self.queue, []
        while line:
            pivot = line.first()
            if pivot.nodes > nodes or pivot.watts > watts:
                break
            line.take_first(pivot.nodes)
            started.append(pivot)
            nodes -= pivot.nodes
            watts -= pivot.watts
        else:
            return started
        when, spare_nodes, spare_watts = self._reserve(pivot, nodes, watts, started)
        self.first_reservation.setdefault(pivot.id, when)
        room = when - self.now
        if room <= 0:
            spare_nodes, spare_watts = 0, 0.0
        while nodes > 0 and (job := line.take(nodes, watts, room, spare_nodes, spare_watts)) is not None:
            started.append(job)
            self.backfilled.add(job.id)
            nodes -= job.nodes
            watts -= job.watts
            if job.plan > room:
                spare_nodes -= job.nodes
                spare_watts -= job.watts
        return started

    def _scan(self) -> list[Job]:
        """What starts now, for policies that look at one job after the other."""
        started = self._choose()
        for job in started:
            del self.queue[bisect_left(self.queue, (job.rank,))]
        return started

    def _choose(self) -> list[Job]:
        policy, now = self.policy, self.now
        nodes, watts = self._left()
        started: list[Job] = []
        line = (job for _, job in self.queue)
        pivot = None
        for job in line:
            if not policy.ready(job, now):
                continue
            if not policy.admits(job, nodes, watts):
                pivot = job
                break
            started.append(job)
            nodes -= job.nodes
            watts -= job.watts
        if pivot is None or not policy.backfills:
            return started
        when, spare_nodes, spare_watts = self._reserve(pivot, nodes, watts, started)
        self.first_reservation.setdefault(pivot.id, when)
        if when <= now:
            spare_nodes, spare_watts = 0, 0.0
        seen = 0
        for job in line:
            if nodes == 0:
                break  # every job needs a node
            if not policy.ready(job, now):
                continue
            seen += 1
            if policy.admits(job, nodes, watts):
                fits = now + job.plan <= when
                if fits or (job.nodes <= spare_nodes and job.watts <= spare_watts):
                    started.append(job)
                    self.backfilled.add(job.id)
                    nodes -= job.nodes
                    watts -= job.watts
                    if not fits:
                        spare_nodes -= job.nodes
                        spare_watts -= job.watts
            if policy.window is not None and seen >= policy.window:
                break
        return started

    def _reserve(self, pivot: Job, nodes: int, watts: float, started: list[Job]) -> tuple[int, int, float]:
        """Earliest planned instant at which the pivot fits, and what it leaves free then."""
        now, ends, fresh = self.now, self.ends, sorted(((self.now + j.plan, j) for j in started), key=lambda e: e[0])
        when, fits, i, k = now, False, 0, 0
        while i < len(ends) or k < len(fresh):  # all that ends at an instant counts there
            if k < len(fresh) and (i == len(ends) or fresh[k][0] < max(now, ends[i][0])):
                end, job = fresh[k]
                k += 1
            else:
                end, job = max(now, ends[i][0]), ends[i][2]
                i += 1
            if fits and end != when:
                break
            when = end
            nodes += job.nodes
            watts += job.watts
            fits = fits or (nodes >= pivot.nodes and watts >= pivot.watts)
        if fits:
            return when, max(0, nodes - pivot.nodes), max(0.0, watts - pivot.watts)
        raise PlacementError(f"job {pivot.id} needs {pivot.nodes} nodes and {pivot.watts:,.0f} W, which are never free at once")


def policy_of(name: str, window=None, cap_w=None) -> Policy:
    if name == "fcfs":
        return Strict()
    if name == "easy":
        return Policy(window)
    if name == "power-cap":
        return Capped(float("nan") if cap_w is None else float(cap_w), window)
    if name == "carbon-aware":
        return Held(window)
    raise ValueError(f"unknown policy: {name}")


def _narrow(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id", "order_key", "release_us", F.col("nodes").cast("int").alias("nodes"), seconds_us(F.col("run_s")).alias("run_us"),
        seconds_us(scheduling_run_s()).alias("plan_us"), seconds_us(F.coalesce(F.col("limit_s"), scheduling_run_s())).alias("limit_us"), scheduling_avg_w().alias("watts"),
        energy_kwh(scheduling_avg_w(), scheduling_run_s()).alias("kwh"),
    )


def _slots(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a shuffle into n partitions deals to one partition each, so that no two scenarios share a task."""
    rows = spark.range(50 * n).groupBy(F.pmod(F.hash("id"), F.lit(max(1, n))).alias("p")).agg(F.min("id").alias("id")).collect()
    found = sorted(r["id"] for r in rows)
    return found + list(range(50 * n, 51 * n - len(found)))


def simulate(jobs: DataFrame, scenarios: DataFrame, signal: DataFrame | None = None, custom: dict[str, Policy] | None = None) -> DataFrame:
    """Runs of every scenario: RUNS columns plus target_us and last_event_us.

    scenarios: SCENARIOS columns. Policies: POLICIES, or names of `custom`. 'time_limit' estimates are the default but for
    carbon-aware, whose default is 'scheduling'. Oversized jobs, repeated ids, jobs over a cap and
    stalled queues raise. Carbon-aware scenarios need the signal.
    """
    narrow = _narrow(jobs)
    require_empty(duplicates(narrow, "job_id"), "repeated job ids", PlacementError)
    table = {r["scenario_id"]: r.asDict() for r in scenarios.collect()}  # a table of runs that someone asked for
    rules = sorted({(r["max_delay_us"], r["grid_us"]) for r in table.values() if r["policy"] == "carbon-aware"})
    if rules and signal is None:
        raise PlacementError("a carbon-aware scenario needs a signal")
    slots = dict(zip(_slots(jobs.sparkSession, len(table)), table))
    own = dict(custom or {})
    estimates = {i: r["estimate"] or ("scheduling" if r["policy"] == "carbon-aware" else "time_limit") for i, r in table.items()}
    if rules:  # in parallel, however few the files are
        narrow = with_targets(narrow.repartition("job_id"), signal, rules)
    own_rows = [
        F.struct(
            F.lit(slot).cast("long").alias("slot"), F.col("limit_us" if estimates[i] == "time_limit" else "plan_us").alias("plan_us"),
            (F.col("targets")[rules.index((table[i]["max_delay_us"], table[i]["grid_us"]))] if table[i]["policy"] == "carbon-aware" else F.lit(None).cast("long")).alias("target_us"),
        )
        for slot, i in slots.items()
    ]
    columns = ["job_id", "release_us", "nodes", "run_us", "plan_us", "watts", "target_us"]
    # Every scenario sees the same workload, sorted outside of Python's memory.
    rows = narrow.select("job_id", "order_key", "release_us", "nodes", "run_us", "watts", F.inline(F.array(*own_rows))).repartition(max(1, len(slots)), "slot")
    rows = rows.sortWithinPartitions("slot", "release_us", "order_key").select("slot", *columns)
    out = pa.schema([("scenario_id", pa.string()), ("job_id", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("backfilled", pa.bool_()), ("first_reservation_us", pa.int64()), ("target_us", pa.int64()), ("last_event_us", pa.int64())])

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scenario_id = slots[key[0].as_py()]
        head, estimate = table[scenario_id], estimates[scenario_id]
        name = head["policy"]
        policy = own[name] if name in own else policy_of(name, head["window"], head["cap_w"])
        if estimate not in ("time_limit", "scheduling"):
            raise ValueError(f"unknown runtime estimate: {estimate}")
        held = name == "carbon-aware"
        work = (Job(i, None, release, *rest) for batch in batches for i, release, *rest in zip(*(batch.column(c).to_pylist() for c in columns)))
        part = out.remove(7).remove(0)
        done: list[tuple] = []
        # The last event is known at the end only, so what is placed waits on disk.
        with tempfile.TemporaryFile() as file:
            with pa.ipc.new_stream(pa.PythonFile(file, mode="w"), part, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:

                def flush():
                    if done:
                        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*done), part)], schema=part))
                        done.clear()

                def started(job: Job, filled: bool, reserved: int | None) -> None:
                    done.append((job.id, job.start, job.start + job.run, filled, reserved, job.target if held else None))
                    if len(done) >= 10_000:
                        flush()

                machine = Machine(work, head["total_nodes"], policy, started)
                machine.run()
                flush()
            file.seek(0)
            for batch in pa.ipc.open_stream(pa.PythonFile(file, mode="r")):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([scenario_id] * n, pa.string()), *batch.columns, pa.array([machine.last_event] * n, pa.int64())], schema=out)

    return rows.groupBy("slot").applyInArrow(place, RUNS + ", target_us long, last_event_us long")


def replay(jobs: DataFrame, total_nodes: int, scenario_id: str = "replay", check: bool = True) -> DataFrame:
    """The recorded schedule: every job at its trace start. A null start or too small a machine raises."""
    start = F.when(F.col("trace_start_us").isNull(), F.raise_error(F.concat(F.lit("no trace start for job "), F.col("order_key"))).cast("long")).otherwise(F.col("trace_start_us"))
    runs = jobs.select(
        F.lit(scenario_id).alias("scenario_id"), "job_id", "nodes", start.alias("start_us"), (F.col("trace_start_us") + seconds_us(F.col("run_s"))).alias("end_us"),
        F.lit(False).alias("backfilled"), F.lit(None).cast("long").alias("first_reservation_us"),
    )
    if check:
        check_capacity(runs, total_nodes)
    return runs.drop("nodes")


def oversized(jobs: DataFrame, total_nodes: int) -> DataFrame:
    """Jobs that could never run, in queue order."""
    return jobs.where(F.col("nodes") > total_nodes).orderBy("release_us", "order_key")


def reject_oversized(jobs: DataFrame, total_nodes: int) -> None:
    require_empty(oversized(jobs, total_nodes).select("job_id", "nodes"), f"jobs need more than {total_nodes} nodes", CapacityError)


def fcfs_fold(jobs: DataFrame, total_nodes: int) -> DataFrame:
    """Strict order as one relational fold: job_id, start_us. For at most FOLD_JOBS jobs; more are placed by simulate().

    start_i = the first instant t of max(release_i, start_(i-1)) and the completions after it with busy(t) + nodes_i <= total.
    """
    item = F.struct("release_us", "order_key", "job_id", F.col("nodes").cast("int").alias("nodes"), seconds_us(F.col("run_s")).alias("run_us"))
    fold = f"""aggregate(array_sort(items),
        named_struct('last', -9223372036854775808L, 'active', cast(array() as array<struct<e: bigint, n: int>>), 'out', cast(array() as array<struct<job_id: bigint, start_us: bigint>>)),
        (s, x) -> transform(array(transform(array(greatest(s.last, x.release_us)), at ->
            array_min(filter(concat(array(at), transform(filter(s.active, a -> a.e > at), a -> a.e)),
                t -> aggregate(filter(s.active, a -> a.e > t), 0, (b, a) -> b + a.n) + x.nodes <= {int(total_nodes)})))[0]), t ->
            named_struct('last', t, 'active', concat(filter(s.active, a -> a.e > t), array(named_struct('e', t + x.run_us, 'n', x.nodes))),
                'out', concat(s.out, array(named_struct('job_id', x.job_id, 'start_us', t)))))[0],
        s -> s.out)"""
    if jobs.limit(FOLD_JOBS + 1).count() > FOLD_JOBS:
        one = jobs.sparkSession.createDataFrame([("fcfs", "fcfs", int(total_nodes), None, None, None, None, None)], SCENARIOS)
        return simulate(jobs, one).select("job_id", "start_us")
    return jobs.agg(F.collect_list(item).alias("items")).select(F.explode(F.expr(fold)).alias("r")).select("r.job_id", "r.start_us")
