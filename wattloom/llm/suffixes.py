"""Repeated byte strings by a depth-limited radix sort of suffixes.

Wanted are all DEPTH-byte strings that start at two or more places; equal groups of suffixes sorted
to that depth are exactly those. The sort goes most significant digit first, and a group of one
drops out after each pass. To move few suffixes, a DEPTH-byte window is filed under its anchor, the
least-hashed GRAM-byte string in it: equal windows have equal anchors at equal offsets, and neighbouring
windows share an anchor, so one row stands for a run of windows (about 1.3 % of the positions).

Pass 1, digit = the anchor's hash: counted with map-side combination, anchors met once drop out.
Pass 2, digit = the hash of the run's whole region (two independent 64-bit hashes): equal regions are repeated as a whole.
Pass 3, only regions that stand alone beside others with their anchor: their windows are sorted digit by digit to full
depth, a window that is alone drops out after each digit, and the groups that are left are compared byte by byte. In
memory where an anchor has at most GROUP regions, else as rows of a further distributed pass under two hashes of the whole window.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, DID, written

#: Bytes of a repeated string and of an anchor; window starts hashed at a time; regions sorted in memory.
DEPTH, GRAM, PIECE, GROUP = 200, 48, (1 << 18) - 512, 2048
SPAN = DEPTH - GRAM + 1  # anchor positions in a window
#: Bytes of a digit of pass 3.
DIGIT = 100
_LOW = np.uint64((1 << 20) - 1)
#: Key of a document row beside its id.
ROW = "__row"


def _stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers from a counter through a mixing function."""
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Rolling:
    """Hashes of substrings from prefix sums: sum of code[b_i] * base^i, shifted back by base^-start."""

    def __init__(self, seed: int, base: int, size: int):
        self.code, self.up = _stream(seed, 256), _powers(base, size)
        self.down = _powers(pow(base, -1, 1 << 64), size)

    def sums(self, data: np.ndarray) -> np.ndarray:
        terms = self.code[data] * self.up[: data.shape[-1]]
        out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
        np.cumsum(terms, axis=-1, out=out[..., 1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


_TABLES: dict[str, _Rolling] = {}


def _tables() -> tuple[_Rolling, _Rolling, _Rolling]:
    """Independent hashes: of anchors and regions; of regions and windows; of windows."""
    if not _TABLES:
        size = PIECE + DEPTH
        _TABLES["anchor"] = _Rolling(1, 0x2545F4914F6CDD1D, size)
        _TABLES["one"] = _Rolling(2, 0x5851F42D4C957F2D, size)
        _TABLES["two"] = _Rolling(3, 0x369DEA0F31A53F85, 2 * DEPTH)
    return _TABLES["anchor"], _TABLES["one"], _TABLES["two"]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: bytes):
    """Runs of windows that share an anchor: arrays (anchor hash, two region hashes, first start, anchor offset, windows)."""
    rolling, second, _ = _tables()
    for at in range(0, max(0, len(data) - DEPTH + 1), PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + DEPTH - 1, len(data) - at), at)
        sums = rolling.sums(part)
        n = len(part) - GRAM + 1
        grams = _mix((sums[GRAM:] - sums[:n]) * rolling.down[:n])
        low = _sliding_min((grams & ~_LOW) | np.arange(n, dtype=np.uint64), SPAN)
        anchor = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        windows = np.diff(np.r_[first, len(anchor)])
        own = anchor[first]
        off = own - first
        end = first + windows - 1 + DEPTH
        shape = (off * (2 * DEPTH) + windows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        region = _mix(rolling.of(sums, first, end) + shape), _mix(second.of(second.sums(part), first, end) + shape)
        yield grams[own], *region, first + at, off, windows


def _anchored(batches):
    kinds = [("did", pa.int64()), (ROW, pa.int32()), ("anchor", pa.int64()), ("region", pa.int64()), ("region2", pa.int64()), ("start", pa.int64()), ("off", pa.int16()), ("windows", pa.int16())]
    for batch in batches:
        dids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[list] = [[] for _ in kinds]
        held = 0
        for i, x in enumerate(batch.column(2)):
            for got in runs((x.as_py() or "").encode("utf-8", "surrogatepass")):
                n = len(got[0])
                for column, values in zip(out, (np.full(n, dids[i]), np.full(n, rows[i]), *(x.view(np.int64) for x in got[:3]), *got[3:])):
                    column.append(values)
                held += n
            if held > 200_000:
                yield _batch(kinds, out)
                out, held = [[] for _ in kinds], 0
        if held:
            yield _batch(kinds, out)


def _batch(kinds: list, columns: list) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(c).astype(t.to_pandas_dtype()) if c else [], t) for c, (_, t) in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(kinds))


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body, ident = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(doc_id).cast("long")
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, F.xxhash64(body)).alias(DID), F.hash(ident, body).alias(ROW), body.alias("text"))


_MEMBER = f"anchor long, did long, {ROW} int, start long, off int, windows int, alone boolean, region_bytes binary, hot boolean"


def _regions(batches):
    """Bytes of the regions that a document's row lists."""
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for did, row, body, members in zip(*(batch.column(i).to_pylist() for i in range(4))):
            data = body.encode("utf-8", "surrogatepass")
            for m in members:
                end = m["start"] + m["windows"] - 1 + DEPTH
                for c, v in zip(out, (m["anchor"], did, row, m["start"], m["off"], m["windows"], m["alone"], data[m["start"] : end], m["hot"])):
                    c.append(v)
        names = ["anchor", "did", ROW, "start", "off", "windows", "alone", "region_bytes", "hot"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _grid(off: np.ndarray, windows: np.ndarray, regions: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions of one anchor as rows of bytes whose columns align the anchors; row and column of each window."""
    grid = np.zeros((len(regions), SPAN - 1 + DEPTH), np.uint8)
    for i, (o, r) in enumerate(zip(off, regions)):
        grid[i, SPAN - 1 - o : SPAN - 1 - o + len(r)] = np.frombuffer(r, np.uint8)
    who = np.repeat(np.arange(len(regions)), windows)
    col = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(SPAN - 1 - off, windows)
    return grid, who, col


def _windows(off: np.ndarray, windows: np.ndarray, regions: list[bytes]):
    """All windows of some regions of one anchor: (region no, column, hash, hash)."""
    grid, who, col = _grid(off, windows, regions)
    hashes = []
    for rolling in _tables()[1:]:
        sums = rolling.sums(grid)
        hashes.append((sums[who, col + DEPTH] - sums[who, col]) * rolling.down[col])
    return who, col, *hashes


def _repeated(off: np.ndarray, windows: np.ndarray, regions: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(region no, column) of windows that another region of the anchor has at the same offset.

    Windows of a column are sorted by one digit after the other, most significant first; only groups of two or more
    go on. A digit is compared by its hash, so the last groups are compared byte by byte.
    """
    grid, who, col = _grid(off, windows, regions)
    sums = _tables()[1].sums(grid)  # equal windows stand in equal columns, so sums need no shift
    group = col
    for at in range(0, DEPTH, DIGIT):
        digit = sums[who, col + at + DIGIT] - sums[who, col + at]
        order = np.lexsort((digit, group))
        new = np.r_[True, (group[order][1:] != group[order][:-1]) | (digit[order][1:] != digit[order][:-1])]
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1
        who, col, group = who[order][many], col[order][many], number[many]
        if not len(who):
            return who, col
    first = np.r_[True, group[1:] != group[:-1]]
    model = np.flatnonzero(first)[np.cumsum(first) - 1]
    views, equal = np.lib.stride_tricks.sliding_window_view(grid, DEPTH, axis=1), np.empty(len(who), bool)
    for at in range(0, len(who), 4096):
        part, like = slice(at, at + 4096), model[at : at + 4096]
        equal[part] = (views[who[part], col[part]] == views[who[like], col[like]]).all(axis=1)
    if not equal.all():  # equal hashes of different bytes: those groups by their bytes
        for g in np.unique(group[~equal]):
            own = np.flatnonzero(group == g)
            texts = [grid[w, c : c + DEPTH].tobytes() for w, c in zip(who[own], col[own])]
            count = Counter(texts)
            equal[own] = [count[t] > 1 for t in texts]
    order = np.lexsort((col[equal], who[equal]))
    return who[equal][order], col[equal][order]


_COVER = f"did long, {ROW} int, from long, to long"


def _sorted_groups(batches):
    """Pass 3 over members sorted by anchor, of which each has a bounded number: covered byte ranges."""
    held: list = []
    key = None

    def close(out):
        off, windows = np.array([m[4] for m in held]), np.array([m[5] for m in held])
        who, col = _repeated(off, windows, [m[7] for m in held]) if len(held) > 1 else ((), ())
        if len(who):
            cut = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (col[1:] != col[:-1] + 1), True])
            for a, b in zip(cut[:-1], cut[1:]):
                m = held[who[a]]
                if m[6]:
                    start = m[3] + col[a] - (SPAN - 1 - m[4])
                    out.append((m[1], m[2], int(start), int(start + b - a - 1 + DEPTH)))
        held.clear()

    def emit(out):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _COVER.split(", ")])

    for batch in batches:
        out: list = []
        for m in zip(*(c.to_pylist() for c in batch.columns)):
            if m[0] != key:
                close(out)
                key = m[0]
            held.append(m)
        if out:
            yield emit(out)
    out = []
    close(out)
    if out:
        yield emit(out)


def _window_rows(batches):
    """Each window of each region as a row, for anchors too large for memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off, windows = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        who, col, one, two = _windows(off, windows, batch.column(7).to_pylist())
        pick = lambda i: batch.column(i).to_numpy()[who]
        start = pick(3) + col - (SPAN - 1 - off[who])
        yield pa.RecordBatch.from_arrays(
            [pa.array(pick(1)), pa.array(pick(2)), pa.array(start), pa.array(pick(0)), pa.array(col.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
            names=["did", ROW, "from", "anchor", "col", "one", "two"],
        )


def covered(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """(did, row, from, to): byte ranges covered by repeated windows; ranges may overlap. rows: from _rows()."""
    anchored = bounded_batches(rows.select(DID, ROW, "text")).mapInArrow(_anchored, f"did long, {ROW} int, anchor long, region long, region2 long, start long, off short, windows short")
    anchored = written(anchored, "anchors")
    # Stored, so that both sides of the join are plain exchanges and a hot anchor's rows can be split among tasks.
    often = written(anchored.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    again = written(anchored.join(often, "anchor"), "again", anchored, often)

    first = F.min(F.struct("did", ROW, "start", "off", "windows")).alias("m")
    regions = written(again.groupBy("anchor", "region", "region2").agg(F.count("*").alias("same"), first), "regions")
    # A region that stands alone is left out by its own place, not by its hash, so no key of this join is hot.
    single = regions.where("same = 1").select(F.col("m.did").alias("s_did"), F.col(f"m.{ROW}").alias("s_row"), F.col("m.start").alias("s_start"))
    whole = again.join(single, (F.col("did") == F.col("s_did")) & (F.col(ROW) == F.col("s_row")) & (F.col("start") == F.col("s_start")), "left_anti").select(
        "did", ROW, F.col("start").alias("from"), (F.col("start") + F.col("windows") - 1 + DEPTH).alias("to")
    )

    several = written(regions.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    members = regions.join(several, "anchor").select("anchor", "m.*", (F.col("same") == 1).alias("alone"), (F.col("n") > group).alias("hot"))
    # The texts are shuffled once, for the regions of all anchors.
    dealt = written(_with_bytes(rows, members), "dealt", several)
    part = dealt.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_groups, _COVER)
    # Anchors with many regions never meet in a task: each of their windows is a row.
    hot = dealt.where("hot")
    if not hot.isEmpty():
        each = written(hot.mapInArrow(_window_rows, f"did long, {ROW} int, from long, anchor long, col int, one long, two long"), "windows")
        equal = ["anchor", "col", "one", "two"]
        twice = each.groupBy(*equal).agg(F.count("*").alias("n")).where("n > 1").select(*equal)
        part = part.union(each.join(twice, equal).select("did", ROW, "from", (F.col("from") + DEPTH).alias("to")))
    part = written(part, "covered", dealt)
    return whole.union(part)


def _with_bytes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """members (anchor, did, row, start, off, windows, alone, hot) with their regions' bytes, read from their documents."""
    listed = members.groupBy("did", ROW).agg(F.collect_list(F.struct("anchor", "start", "off", "windows", "alone", "hot")).alias("members"))
    # Rows that share a key have no region that stands alone, so meeting a row of them twice adds nothing.
    body = rows.select(F.col(DID).alias("did"), ROW, "text").join(listed, ["did", ROW]).select("did", ROW, "text", "members")
    return body.mapInArrow(_regions, _MEMBER)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches):
    for batch in batches:
        out: list[tuple] = []
        for body, starts, ends in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            data = body.as_py().encode("utf-8", "surrogatepass")
            spans = _merged(zip(starts, ends)) if starts else []
            kept = hashlib.sha256()
            at = 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: int = GROUP) -> DataFrame:
    """One row per document row: doc_id, row key, text, and starts and ends of covered byte ranges (null: none).

    Null text counts as empty. Two rows with equal texts cover each other, also when their ids are equal or
    null. Texts shorter than DEPTH bytes have no windows; longer ones count whole. Only the named columns are read. An
    empty table gives an empty one. group: regions of an anchor that are sorted in memory.
    """
    rows = _rows(docs, text, doc_id)
    spans = covered(rows, group).distinct().groupBy("did", ROW).agg(F.collect_list(F.struct("from", "to")).alias("s"))
    spans = spans.select(F.col("did").alias("s_did"), F.col(ROW).alias("s_row"), F.col("s.from").alias("starts"), F.col("s.to").alias("ends"))
    return rows.join(spans, (rows[DID] == F.col("s_did")) & (rows[ROW] == F.col("s_row")), "left").select("doc_id", DID, ROW, "text", "starts", "ends")


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after cutting repeated bytes; cases as in repeated_spans()."""
    rows = repeated_spans(docs, text, doc_id, group).select("doc_id", "text", "starts", "ends")
    return bounded_batches(rows).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
