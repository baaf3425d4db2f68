"""A batch data source for grid carbon intensity from an HTTP service, one partition per request chunk.

The transport is injectable: any picklable callable (url, headers) -> parsed JSON. Base URL and token come as options.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import GridSourceError
from ..operators.signal import build_series, merge_samples, require_complete
from ..schemas import BUCKET_US, SIGNAL
from ..scratch import stored

#: Fixed values of the service's format.
GRANULARITY, UNIT, FACTORS = "15_minutes", "gco2eq/kwh", ("lifecycle", "direct")
MOST_CHUNK_US = 2 * 86_400_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def chunks(start_us: int, end_us: int, chunk_us: int = MOST_CHUNK_US) -> list[tuple[int, int]]:
    """Adjacent, end-exclusive request ranges over all buckets that overlap [start, end)."""
    if end_us <= start_us:
        raise ValueError("the end must be later than the start")
    if not BUCKET_US <= chunk_us <= MOST_CHUNK_US or chunk_us % BUCKET_US:
        raise ValueError("a chunk must be whole buckets, and two days at most")
    first, last = start_us - start_us % BUCKET_US, end_us + -end_us % BUCKET_US
    return [(a, min(a + chunk_us, last)) for a in range(first, last, chunk_us)]


def iso(us: int) -> str:
    return (_EPOCH + timedelta(microseconds=us)).isoformat().replace("+00:00", "Z")


def _us(text) -> int:
    try:
        when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except (AttributeError, ValueError) as error:
        raise GridSourceError("a sample has no valid timestamp") from error
    if when.tzinfo is None:
        raise GridSourceError("a sample's timestamp has no zone")
    return (when - _EPOCH) // timedelta(microseconds=1)


def request_url(base: str, start_us: int, end_us: int, zone: str, factor: str, flow_traced: bool, estimated: bool) -> str:
    flag = lambda x: str(bool(x)).lower()
    query = {"zone": zone, "start": iso(start_us), "end": iso(end_us), "temporalGranularity": GRANULARITY, "emissionFactorType": factor, "flowTraced": flag(flow_traced), "disableEstimations": flag(not estimated)}
    return f"{base.rstrip('/')}/carbon-intensity/past-range?{urllib.parse.urlencode(query)}"


class _Refuse(urllib.request.HTTPRedirectHandler):
    """A redirect could carry the token elsewhere, so none is followed."""

    def redirect_request(self, *args, **kwargs):
        return None


def http_json(url: str, headers: dict[str, str], timeout_s: float = 30.0) -> dict:
    """GET a JSON object; every failure becomes a GridSourceError without the token in it."""
    try:
        with urllib.request.build_opener(_Refuse).open(urllib.request.Request(url, headers=headers), timeout=timeout_s) as answer:
            payload = json.loads(answer.read().decode("utf-8"))
    except urllib.error.HTTPError as error:
        raise GridSourceError(f"the service answered with status {error.code}") from None
    except (urllib.error.URLError, TimeoutError, OSError) as error:
        raise GridSourceError(f"the service can't be reached: {error}") from None
    except (UnicodeDecodeError, json.JSONDecodeError):
        raise GridSourceError("the service's answer is no JSON") from None
    if not isinstance(payload, dict):
        raise GridSourceError("the service's answer is no object")
    return payload


def samples(payload: dict, zone: str, factor: str) -> list[tuple]:
    """(bucket_us, ci, is_estimated, estimation_method) of an answer, after checking zone, grid, factor type and unit."""
    for key, want in (("zone", zone), ("temporalGranularity", GRANULARITY), ("emissionFactorType", factor)):
        if payload.get(key) not in (None, want):
            raise GridSourceError(f"expected {key} {want}, received {payload[key]}")
    if payload.get("unit") is not None and str(payload["unit"]).lower() != UNIT:
        raise GridSourceError(f"unexpected unit: {payload['unit']}")
    if not isinstance(payload.get("data"), list):
        raise GridSourceError("the answer has no data list")
    out = []
    for one in payload["data"]:
        if not isinstance(one, dict):
            raise GridSourceError("a sample is no object")
        if one.get("zone", zone) != zone or one.get("emissionFactorType") not in (None, factor):
            raise GridSourceError("a sample has another zone or factor type")
        key = next((k for k in ("carbonIntensity", "value") if k in one), None)
        ci, est, how = one.get(key) if key else None, one.get("isEstimated"), one.get("estimationMethod")
        if isinstance(ci, bool) or not isinstance(ci, (int, float)) or not 0 <= ci < float("inf"):
            raise GridSourceError("a sample has no valid intensity")
        if not isinstance(est, (bool, type(None))) or not isinstance(how, (str, type(None))):
            raise GridSourceError("a sample's estimation fields are invalid")
        out.append((_us(one.get("datetime")), float(ci), est, how))
    return out


class Chunk(InputPartition):
    def __init__(self, start_us: int, end_us: int):
        self.start_us, self.end_us = start_us, end_us


class GridReader(DataSourceReader):
    def __init__(self, options: dict, transport):
        get = lambda k, d=None: options.get(k, d)
        self.base, self.zone, self.factor = get("url"), (get("zone") or "").strip(), get("factor", "lifecycle")
        self.token, self.transport = get("token", ""), transport
        if not self.base or not self.zone:
            raise ValueError("options url and zone are needed")
        if self.factor not in FACTORS:
            raise ValueError("factor must be lifecycle or direct")
        self.flow, self.estimated = (str(get(k, "true")).lower() == "true" for k in ("flow_traced", "include_estimated"))
        self.parts = chunks(int(get("start_us")), int(get("end_us")), int(get("chunk_us", MOST_CHUNK_US)))

    def partitions(self):
        return [Chunk(a, b) for a, b in self.parts]

    def read(self, part: Chunk):
        url = request_url(self.base, part.start_us, part.end_us, self.zone, self.factor, self.flow, self.estimated)
        for row in samples(self.transport(url, {"auth-token": self.token}), self.zone, self.factor):
            if not part.start_us <= row[0] < part.end_us:
                raise GridSourceError("a sample lies outside its request")
            if not self.estimated and row[2] is not False:
                raise GridSourceError("an estimated or unlabelled sample came though estimates are off")
            yield row


def source_class(transport=http_json) -> type[DataSource]:
    """The data source 'grid_intensity' over a transport."""

    class GridSource(DataSource):
        @classmethod
        def name(cls):
            return "grid_intensity"

        def schema(self):
            return SIGNAL

        def reader(self, schema):
            return GridReader(dict(self.options), transport)

    return GridSource


def fetch_signal(spark: SparkSession, transport=http_json, **options) -> DataFrame:
    """The complete series of [start_us, end_us): chunks read in parallel, merged, checked for conflicts and gaps."""
    spark.dataSource.register(source_class(transport))
    reader = spark.read.format("grid_intensity")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    got = stored(reader.load(), "signal")  # so that each chunk is asked once
    if got.isEmpty():
        raise GridSourceError("the service returned no samples")
    signal = build_series(merge_samples(got))
    parts = chunks(int(options["start_us"]), int(options["end_us"]), int(options.get("chunk_us", MOST_CHUNK_US)))
    require_complete(signal, parts[0][0], parts[-1][1])
    return signal


def read_token(env_file: str | None, name: str) -> str:
    """A token from the environment, else from a NAME=value file; it is never written anywhere."""
    value = os.environ.get(name, "").strip()
    if not value and env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as lines:
            for line in lines:
                key, eq, rest = line.strip().removeprefix("export ").partition("=")
                if eq and key.strip() == name:
                    value = rest.strip().strip("'\"")
    if not value:
        raise GridSourceError(f"{name} is set neither in the environment nor in a file")
    return value
