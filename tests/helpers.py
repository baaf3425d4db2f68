import random

from wattloom.schemas import JOBS

BASE = 1_588_723_200_000_000  # 2020-05-06T00:00Z
S = 1_000_000


def job(job_id, release=0, run=60.0, nodes=1, avg_w=1000.0, submit=None, limit=None, trace=None, profile=None, interval=20.0, pred=None):
    at = lambda x: None if x is None else BASE + round(x * S)
    return (job_id, str(job_id), at(release if submit is None else submit), at(release), nodes, float(run), None if limit is None else float(limit), at(trace), profile, interval, float(avg_w), pred, None)


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), JOBS)


def signal(spark, values, grid=900 * S, start=BASE):
    return spark.createDataFrame([(start + i * grid, float(v), False, None) for i, v in enumerate(values)], "bucket_us long, ci double, is_estimated boolean, estimation_method string")


def starts(runs):
    return {r["job_id"]: (r["start_us"] - BASE) / S for r in runs.collect()}


def random_jobs(seed, n, nodes=16):
    rnd = random.Random(seed)
    return [job(i, rnd.randrange(4000), rnd.randrange(10, 900), rnd.randint(1, nodes), rnd.randrange(200, 2000), limit=rnd.randrange(900, 2000)) for i in range(n)]
