"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints within three bits have one
segment within one bit, so they share at least one of that segment's 32 one-wildcard variants.
The variants are the index: an equality key that brings candidates together, which are then
verified on all 64 bits. Only distinct fingerprints are indexed, so exact copies cost nothing.

Candidates of one key are never expanded into pairs: a key's fingerprints stream by in sorted
order and leave a spanning forest (fewer links than members). Keys with more than BLOCK
fingerprints go through a second pass over pairs of blocks, which is exact and bounds memory.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import THASH, bounded_batches, held, kept_rows, keyed, written
from .components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Fingerprints that one in-memory comparison takes; larger keys are dealt out in blocks of it.
BLOCK = 4096
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def _word_lists(data: bytes):
    """The words of data in order, in lists of bounded size."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's three-word shingles; zero without words."""
    ones, n, last, whole = np.zeros(64, np.int64), 0, [], True
    for words in _word_lists((text or "").encode("utf-8", "surrogatepass").lower()):
        words = last + words
        if len(words) < SHINGLE:
            last = words
            continue
        whole = False
        grams = map(b" ".join, zip(words, words[1:], words[2:]))
        ones, n = _add(ones, grams), n + len(words) - SHINGLE + 1
        last = words[1 - SHINGLE :]
    if whole:
        if not last:
            return 0
        ones, n = _add(ones, [b" ".join(last)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _add(ones: np.ndarray, grams) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones = ones + bits.sum(axis=0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row key, fp): one row per document row; a null or word-free text has fp 0."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", THASH, "fp"])

    return bounded_batches(keyed(docs, text=text, doc_id=doc_id).select("doc_id", THASH, "text")).mapInArrow(run, f"doc_id long, {THASH} long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of each fingerprint."""
    key = """transform(sequence(0, 63), i ->
        (cast(i as bigint) << 32) |
        ((CASE WHEN i < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)
         & ~(1L << (i % 32)) & 4294967295L))"""
    return fps.select(F.explode(F.expr(key)).alias("key"), "fp")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over fingerprints that differ in at most DISTANCE bits."""
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    near = [
        np.nonzero(np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= DISTANCE)
        for at in range(0, n, 256)
    ] if n <= 512 else None
    label = np.arange(n)
    while True:
        old = label.copy()
        for k, at in enumerate(range(0, n, 256)):
            if near is not None:
                i, j = near[k]
                np.minimum.at(label, i + at, old[j])
            else:
                close = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= DISTANCE
                label[at : at + 256] = np.where(close, old[None, :], n).min(axis=1)
        label = np.minimum(label, label[label])
        if (label == old).all():
            break
    rest = label != np.arange(n)
    return fps[rest], fps[label[rest]]


_LINKS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("block", pa.int32())])


def _links_of(keys: list, a: list, b: list, block: list) -> pa.RecordBatch:
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(cat(keys, np.int64)), pa.array(cat(a, np.int64)), pa.array(cat(b, np.int64)), pa.array(cat(block, np.int32))],
        schema=_LINKS,
    )


def _scan(batches):
    """From rows sorted by key: links of each key's forest (block -1), and rows of large keys.

    At most BLOCK rows of a key are held; the rest of it is passed on as (key, fp, block).
    """
    key, held, passed = None, [], 0

    def close(out):
        nonlocal held, passed
        if held and not passed:
            fps = np.concatenate(held)
            if len(fps) > 1:
                put(out, *_forest(fps))
        elif held:
            spill(out, np.concatenate(held))
        held, passed = [], 0

    def put(out, x, y):
        if len(x):
            out[0].append(np.full(len(x), key))
            out[1].append(x.view(np.int64))
            out[2].append(y.view(np.int64))
            out[3].append(np.full(len(x), -1))

    def spill(out, fps):
        nonlocal passed
        out[0].append(np.full(len(fps), key))
        out[1].append(fps.view(np.int64))
        out[2].append(fps.view(np.int64))
        out[3].append((passed + np.arange(len(fps))) // BLOCK)
        passed += len(fps)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        out = ([], [], [], [])
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, len(keys)])
        if keys[0] != key:
            close(out)
        # Inner groups that begin and end in this batch and have two members: all at once.
        inner = np.arange(len(start)) > 0
        inner[-1] = False
        two = start[inner & (size == 2)]
        ok = np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE
        two = two[ok]
        if len(two):
            for part, values in zip(out, (keys[two], fps[two + 1].view(np.int64), fps[two].view(np.int64), np.full(len(two), -1))):
                part.append(values)
        for g in np.flatnonzero(~inner | (size > 2)):
            own = fps[start[g] : start[g] + size[g]]
            if keys[start[g]] != key:
                close(out)
                key = keys[start[g]]
            held.append(own)
            while sum(map(len, held)) > BLOCK:
                every = np.concatenate(held)
                spill(out, every[:BLOCK])
                held = [every[BLOCK:]]
        if out[0]:
            yield _links_of(*out)
    out = ([], [], [], [])
    close(out)
    if out[0]:
        yield _links_of(*out)


def _block_pair(table: pa.Table) -> pa.Table:
    a, b = _forest(np.unique(table.column("a").to_numpy().view(np.uint64)))
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints whose closure is that of 'within DISTANCE bits'."""
    dealt = variants(fps).repartition("key").sortWithinPartitions("key", "fp")
    found = held(dealt.mapInArrow(_scan, "key long, a long, b long, block int"))
    plain = found.where("block < 0").select("a", "b")
    large = found.where("block >= 0")
    if large.isEmpty():
        return plain
    blocks = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    cells = large.join(blocks, "key").select(
        "key", "a", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("key", "a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return plain.union(cells.groupBy("key", "i", "j").applyInArrow(_block_pair, "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: doc_id, row key, fp (long), root (of its class), component_id (smallest doc_id reachable).

    Null and word-free texts have fingerprint zero and are linked like any other. Null ids never
    become a component_id unless the component has none but null ids. Repeated rows each get a row.
    """
    prints = held(fingerprints(docs, text, doc_id))
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").select(F.col("fp").alias("class_fp"), "root", "component_id")
    return prints.join(classes, prints.fp == classes.class_fp, "left").select("doc_id", THASH, "fp", "root", "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest doc_id (null last), once.

    Null, empty and word-free texts are one class. Ties of repeated rows leave one of them; a text of any length counts
    whole; columns may have any name; an empty table gives an empty one.
    """
    rows = near_duplicates(docs, text, doc_id)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", THASH)).alias("m"))
    return kept_rows(docs, first.select(F.col("m.doc_id").alias("doc_id"), f"m.{THASH}"), text, doc_id)
