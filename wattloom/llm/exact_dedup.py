"""Exact deduplication by composable polynomial fingerprints and streaming comparison.

A text's UTF-8 bytes have a polynomial hash over two prime fields, and hashes of neighbouring parts combine by
length-shifted arithmetic: h(xy) = h(x) * B^len(y) + h(y). Texts above HUGE bytes are cut into chunks that are hashed by
many tasks; each chunk brings its hash and B^len, and a fold over them in order gives the hash of the whole.

Rows with equal fingerprint and length form a group, counted with map-side combination. Then each member is compared with
its group's first text, chunk by chunk, in salted slices, so one hot group of copies is spread over many tasks. Members
that differ form a group of their own, which is compared again, until no member differs. So equality is decided by the
texts; the SHA-256 in the result is output only.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, DID, THASH, bounded_batches, kept_rows, keyed, written

#: Prime fields and the base of the polynomial.
PRIMES, BASE = (2147483647, 2147483629), 1000003
#: Bytes hashed at a time, and code points of a chunk of a huge text or of a comparison.
CHUNK, COMPARE = 1 << 16, 1 << 16
#: Bytes of a text above which its chunks are dealt to many tasks.
HUGE = 1 << 22
#: Members compared in one slice of a group.
SLICE = 64


@functools.cache
def _powers(p: int) -> np.ndarray:
    """BASE^(CHUNK-1) ... BASE^0 mod p, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:
        out = np.concatenate([out, out * np.uint64(pow(BASE, len(out), p)) % np.uint64(p)])
    return out[:CHUNK][::-1].copy()


def chunk_hash(chunk: bytes, primes=PRIMES) -> tuple[int, int, int]:
    """(h1, h2, length) of at most CHUNK bytes. A digit is a byte plus one, so leading zeros count."""
    digits = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(digits)
    # A product is below 2^40, so a sum of CHUNK of them stays below 2^56.
    return *(int((digits * _powers(p)[CHUNK - n :]).sum() % np.uint64(p)) for p in primes), n


def combine(x: tuple[int, int, int], y: tuple[int, int, int], primes=PRIMES) -> tuple[int, int, int]:
    """Hash of a text from the hashes of its left and right part."""
    h = [(x[i] * pow(BASE, y[2], p) + y[i]) % p for i, p in enumerate(primes)]
    return h[0], h[1], x[2] + y[2]


def text_hash(data: bytes, primes=PRIMES) -> tuple[int, int, int]:
    """(h1, h2, length) of whole data."""
    total = (0, 0, 0)
    for at in range(0, len(data), CHUNK):
        total = combine(total, chunk_hash(data[at : at + CHUNK], primes), primes)
    return total


def _chunks(body: str, size: int = COMPARE) -> F.Column:
    return F.expr(f"transform(sequence(0, greatest(0, cast((length({body}) - 1) div {size} as int))), i -> substring({body}, i * {size} + 1, {size}))")


def hashed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """(doc_id, row key, fp, n_bytes, text_sha256) per document row; null counts as empty."""
    rows = keyed(docs, text, doc_id)

    def run(batches):
        for batch in batches:
            fp, size, sha = [], [], []
            for x in batch.column(3):
                data = x.as_py().encode("utf-8", "surrogatepass")
                h = text_hash(data, primes)
                fp.append(h[0] << 31 | h[1])
                size.append(h[2])
                sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", DID, THASH, "fp", "n_bytes", "text_sha256"]
            )

    def parts(batches):
        for batch in batches:
            got = [text_hash(x.as_py().encode("utf-8", "surrogatepass"), primes) for x in batch.column(3)]
            cols = [[g[0] for g in got], [g[1] for g in got], [pow(BASE, g[2], primes[0]) for g in got], [pow(BASE, g[2], primes[1]) for g in got], [g[2] for g in got]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in cols)], names=[DID, THASH, "no", "h1", "h2", "b1", "b2", "n"])

    key = f"doc_id long, {DID} long, {THASH} long"
    plain = bounded_batches(rows.where(F.octet_length("text") <= huge).select("doc_id", DID, THASH, "text")).mapInArrow(run, f"{key}, fp long, n_bytes long, text_sha256 string")
    large = rows.where(F.octet_length("text") > huge)
    cut = large.dropDuplicates([DID, THASH]).select(DID, THASH, F.posexplode(_chunks("text")).alias("no", "chunk")).repartition(DID, THASH, "no")
    each = cut.mapInArrow(parts, f"{DID} long, {THASH} long, no int, h1 long, h2 long, b1 long, b2 long, n long")
    fold = f"""aggregate(array_sort(parts), named_struct('x', 0L, 'y', 0L, 'n', 0L), (a, c) -> named_struct(
        'x', (a.x * c.b1 + c.h1) % {primes[0]}L, 'y', (a.y * c.b2 + c.h2) % {primes[1]}L, 'n', a.n + c.n))"""
    whole = each.groupBy(DID, THASH).agg(F.collect_list(F.struct("no", "h1", "h2", "b1", "b2", "n")).alias("parts")).select(DID, THASH, F.expr(fold).alias("h"))
    whole = whole.select(DID, THASH, (F.shiftleft("h.x", 31).bitwiseOR(F.col("h.y"))).alias("fp"), F.col("h.n").alias("n_bytes"))
    return plain.unionByName(large.select("doc_id", DID, THASH, F.sha2("text", 256).alias("text_sha256")).join(whole, [DID, THASH]))


_GROUP = ["fp", "n_bytes", "round"]


def _differing(docs: DataFrame, rows: DataFrame, groups: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Row keys of members whose text isn't that of their group's model, found chunk by chunk."""
    multi = groups.where("members > 1").withColumn("slices", F.ceil(F.col("members") / SLICE).cast("int"))
    own = rows.select(DID, THASH, *_GROUP).join(multi.select(*_GROUP, "slices", "model"), _GROUP).withColumn("is_model", F.col("model") == F.struct(DID, THASH)).drop("model")
    body = keyed(docs, text, doc_id).select(DID, THASH, "text")
    # Most texts are in no group; a Bloom filter of the members' keys drops them before the shuffle.
    member = body.join(own, [DID, THASH]).select(DID, THASH, *_GROUP, "slices", "is_model", F.posexplode(_chunks("text")).alias("no", "chunk"))
    member = written(member, "members", conf=BLOOM)
    salt = F.pmod(F.xxhash64(DID, THASH), F.col("slices")).cast("int")
    others = member.where("not is_model").select(DID, THASH, *_GROUP, "no", "chunk", salt.alias("salt"))
    first = member.where("is_model").select(*_GROUP, "no", F.col("chunk").alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("salt"))
    both = others.join(first.dropDuplicates([*_GROUP, "no", "salt"]), [*_GROUP, "no", "salt"], "left")
    return both.where("own is null or chunk <> own").select(DID, THASH).distinct()


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """(doc_id, row key, copies, fp, text_sha256, keep_id, group_size) per distinct row; rows of a class have equal texts.

    copies: rows that repeat both id and text. Every round closes the classes of its models; texts that only share a
    fingerprint go to the next, so there are as many rounds as different texts share one, and one as a rule.
    """
    rows = hashed(docs, text, doc_id, primes, huge).groupBy("doc_id", DID, THASH, "fp", "n_bytes", "text_sha256").agg(F.count("*").alias("copies"))
    # A written table has as many files as its bytes ask for; a kept one would have a task per shuffle partition in each of its uses.
    rows = written(rows.withColumn("round", F.lit(0)), "rows")
    while True:
        groups = rows.groupBy(*_GROUP).agg(F.count("*").alias("members"), F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.max(F.struct(DID, THASH)).alias("model"))
        groups = written(groups, "groups")
        last = rows.agg(F.max("round")).first()[0] or 0
        odd = written(_differing(docs, rows.where(F.col("round") == last), groups.where(F.col("round") == last), text, doc_id), "odd")
        if odd.isEmpty():
            return rows.join(groups.drop("members", "model"), _GROUP).drop("round")
        moved = odd.withColumn("odd", F.lit(True))
        rows = written(rows.join(moved, [DID, THASH], "left").withColumn("round", F.col("round") + F.coalesce("odd", F.lit(False)).cast("int")).drop("odd"), "rows")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256, fp.

    Null text counts as empty. Of equal texts the largest doc_id stays (null ids are smallest). Of
    rows that repeat both id and text, exactly one is kept. A text of any length counts whole, only the named columns
    are read, and an empty table gives an empty one.
    """
    rows = classes(docs, text, doc_id, primes, huge).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "fp")


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest doc_id, once.

    Null text counts as empty; of repeated rows one stays; columns may have any name; a text of any length counts
    whole; an empty table gives an empty one.
    """
    stay = classes(docs, text, doc_id).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return kept_rows(docs, stay.select("doc_id", THASH), text, doc_id)
