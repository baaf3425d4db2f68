"""Declared rules as data: a rule set gives the violating rows, or raises on the first action."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError


def _bad(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def job_rules(with_profile: bool = True) -> dict[str, Column]:
    """Rule name to condition that must hold; a null condition counts as broken."""
    c = F.col
    optional = lambda x: c(x).isNull() | ((c(x) > 0) & ~_bad(c(x)))
    rules = {
        "submit_not_after_release": c("submit_us") <= c("release_us"),
        "nodes_positive": c("nodes") > 0,
        "runtime_positive_finite": (c("run_s") > 0) & ~_bad(c("run_s")),
        "average_power_non_negative": (c("avg_w") >= 0) & ~_bad(c("avg_w")),
        "interval_positive": (c("interval_s") > 0) & ~_bad(c("interval_s")),
        "trace_start_not_before_release": c("trace_start_us").isNull() | (c("trace_start_us") >= c("release_us")),
        "time_limit_positive": optional("limit_s"),
        "predicted_runtime_positive": optional("pred_run_s"),
        "predicted_power_positive": optional("pred_avg_w"),
    }
    if with_profile:
        whole = F.forall("profile_w", lambda x: x.isNotNull() & (x >= 0) & ~_bad(x))
        rules["profile_non_empty_non_negative"] = c("profile_w").isNull() | ((F.size("profile_w") > 0) & whole)
    return rules


def signal_rules(grid_us: int) -> dict[str, Column]:
    c = F.col
    return {
        "intensity_finite_non_negative": (c("ci") >= 0) & ~_bad(c("ci")),
        "bucket_on_grid": F.pmod(c("bucket_us"), F.lit(grid_us)) == 0,
    }


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for every broken rule of every row, in one pass."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.col(key), F.explode(F.array_compact(broken)).alias("rule"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).count().where("count > 1")


def require_empty(found: DataFrame, message: str, error: type[Exception] = ConstraintError) -> None:
    """Raise with the first five rows if there are any; one small action."""
    rows = found.limit(5).collect()
    if rows:
        raise error(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))


def every(conditions) -> Column:
    """AND of conditions, null counted as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(False)) for x in conditions])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in conditions])


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
