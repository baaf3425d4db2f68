"""The carbon signal's JSON cache: strict reading and atomic writing."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SignalError
from ..functions.timegrid import iso_utc, parse_iso
from ..operators.signal import build_series

VERSION = 1
_SAMPLE = "array<struct<timestamp: string, intensity_gco2e_per_kwh: double, is_estimated: boolean, estimation_method: string>>"


def checked_metadata(value, path: str = "metadata"):
    """Strict JSON: text keys, finite numbers; anything else raises."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{path} holds a number that JSON can't")
        return value
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError(f"{path} holds a key that is no text")
        return {k: checked_metadata(v, f"{path}.{k}") for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [checked_metadata(v, f"{path}[{i}]") for i, v in enumerate(value)]
    raise ValueError(f"{path} holds a {type(value).__name__}")


def load_signal(spark: SparkSession, path: str) -> tuple[DataFrame, int, dict]:
    """(signal, grid in microseconds, metadata) of a cache; every rule of the format is checked again.

    The file is read by Spark, so it may lie in any store. Version, granularity and shape are checked on
    variants of the raw document, samples on their rows.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = lambda p: F.expr(f"schema_of_variant(variant_get(v, '$.{p}'))")
    head = raw.select(
        F.expr("schema_of_variant(v)").alias("root"), kind("schema_version").alias("version_type"), F.expr("try_variant_get(v, '$.schema_version', 'long')").alias("version"),
        kind("granularity_seconds").alias("grid_type"), F.expr("try_variant_get(v, '$.granularity_seconds', 'double')").alias("grid"),
        kind("samples").alias("samples_type"), kind("metadata").alias("metadata_type"), F.expr("to_json(variant_get(v, '$.metadata'))").alias("metadata"),
    ).collect()
    if len(head) != 1 or not (head[0]["root"] or "").startswith("OBJECT"):
        raise SignalError(f"invalid signal cache: {path}")
    h = head[0]
    if h["version_type"] != "BIGINT" or h["version"] != VERSION:
        raise SignalError("unsupported version of the signal cache")
    if not (h["grid_type"] or "").startswith(("BIGINT", "DECIMAL", "DOUBLE")) or not h["grid"] or h["grid"] <= 0 or not math.isfinite(h["grid"]):
        raise SignalError("the granularity must be a positive number")
    if not (h["samples_type"] or "").startswith("ARRAY"):
        raise SignalError("samples must be a list")
    if h["metadata_type"] is not None and not h["metadata_type"].startswith("OBJECT"):
        raise SignalError("metadata must be an object")
    samples = raw.select(F.explode(F.expr("variant_get(v, '$.samples', 'array<variant>')")).alias("s")).select(
        F.expr("try_variant_get(s, '$.timestamp', 'string')").alias("timestamp"),
        F.expr("schema_of_variant(variant_get(s, '$.intensity_gco2e_per_kwh'))").alias("ci_type"),
        F.expr("try_variant_get(s, '$.intensity_gco2e_per_kwh', 'double')").alias("ci"),
        F.expr("try_variant_get(s, '$.is_estimated', 'boolean')").alias("is_estimated"), F.expr("try_variant_get(s, '$.estimation_method', 'string')").alias("estimation_method"),
    )
    if not samples.where("timestamp is null or ci is null or ci_type = 'STRING' or ci_type = 'BOOLEAN'").isEmpty():
        raise SignalError("a cached sample lacks its timestamp or a numeric intensity")
    grid_us = round(h["grid"] * 1e6)
    rows = samples.select(parse_iso(F.col("timestamp")).alias("bucket_us"), "ci", "is_estimated", "estimation_method")
    return build_series(rows, grid_us), grid_us, json.loads(h["metadata"] or "{}")


def save_signal(signal: DataFrame, path: str, grid_us: int, metadata: dict | None = None) -> str:
    """One normalised JSON file in any store, written beside its place and then renamed over it. The signal is a bounded series."""
    rows = signal.select(iso_utc(F.col("bucket_us")).alias("timestamp"), F.col("ci").alias("intensity_gco2e_per_kwh"), "is_estimated", "estimation_method").orderBy("bucket_us")
    payload = {"schema_version": VERSION, "granularity_seconds": grid_us / 1e6, "metadata": checked_metadata(metadata or {}), "samples": [r.asDict() for r in rows.collect()]}
    context = signal.sparkSession.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    place = fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(fs.Path(path))
    files = fs.FileContext.getFileContext(place.toUri(), context._jsc.hadoopConfiguration())
    store = place.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(place.getParent())
    temporary = fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}.tmp")
    try:
        out = store.create(temporary, True)
        out.write(bytearray((json.dumps(payload, indent=2, sort_keys=True, allow_nan=False) + "\n").encode("utf-8")))
        out.close()
        over = context._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        over[0] = getattr(fs, "Options$Rename").OVERWRITE
        files.rename(temporary, place, over)
    except BaseException:
        store.delete(temporary, False)
        raise
    return path
