"""Tables in the folder that the cluster shares, and small files beside them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[tuple, DataFrame] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own temporary folder in local mode; a cluster without one raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="wattloom-"))


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, for results that several branches of a plan need."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a stored table, written once per application and key."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        df, path = make(), place(spark, str(key[1]))
        df.write.parquet(path)
        _KEPT[key] = spark.read.schema(df.schema).parquet(path)
    return _KEPT[key]
