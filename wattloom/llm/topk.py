"""Exact top-k inner products: norm-sorted vectors, rotated partial sums, Cauchy-Schwarz pruning.

Vectors are dealt out in chunks by descending length. In a task a chunk's vectors meet one block of
queries, a slice at a time, longest first. A slice whose longest vector can't reach a query's k-th score
is skipped. In a slice the first HEAD coordinates after a rotation by the right singular vectors of a
bounded sample give partial sums; what the rest can add is at most the product of residual lengths. Only pairs
whose bound reaches the k-th score are scored exactly, in integers.

Every query starts with a k-th score from the SEEDS longest vectors, so chunks prune alone: queries are dealt in
blocks by the length that their answers need, and only chunks that are as long meet a block at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

SCALE, K, HEAD = 1024, 10, 16
#: Vectors collected to fit the rotation and the first k-th scores; rows of a chunk, a query block and a slice.
SEEDS, CHUNK, QUERIES, SLICE = 1024, 32768, 2048, 1024
#: Sums below this are exact in doubles.
_EXACT = float(2**52)


def quantised(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) as doubles. Rows with a null id, a null vector, or null or non-finite components drop out."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # rint keeps a double whole where floor() would make a long of it, which can't hold all doubles
    down = F.transform("x", lambda e: F.rint(e * float(scale)) - F.when(F.rint(e * float(scale)) > e * float(scale), 1.0).otherwise(0.0))
    return rows.where(fine).select("vec_id", down.alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))  # a shorter vector counts as padded with zeros
    for i, n in enumerate(sizes):
        out[i, :n] = flat[ends[i] : ends[i] + n]
    return out


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as Python-size integers in an int64 (or object) array."""
    if len(q) and len(x) and np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(e) for e in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.kth, self.rows = k, floor.astype(np.float64).copy(), [[] for _ in range(n)]

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray):
        own = sorted([*self.rows[i], *zip((-scores).tolist(), ids.tolist())])[: self.k]
        self.rows[i] = own
        if len(own) == self.k:
            self.kth[i] = max(self.kth[i], np.nextafter(float(-own[-1][0]), -np.inf))  # never above the whole number


def _search(width: int, rotation: np.ndarray, k: int):
    def run(key, chunk: pa.Table, queries: pa.Table) -> pa.Table:
        if not chunk.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        x, ids = _matrix(chunk.column("v"), width), chunk.column("vec_id").to_numpy()
        q, qids = _matrix(queries.column("v"), width), queries.column("vec_id").to_numpy()
        norm = np.sqrt((x * x).sum(axis=1))
        order = np.lexsort((ids, -norm))
        x, ids, norm = x[order], ids[order], norm[order]
        xr, qr = x @ rotation, q @ rotation
        h = min(HEAD, width)
        x_rest, q_rest = np.sqrt((xr[:, h:] ** 2).sum(axis=1)), np.sqrt((qr[:, h:] ** 2).sum(axis=1))
        q_norm = np.sqrt((q * q).sum(axis=1))
        best = _Best(len(q), k, queries.column("floor").to_numpy())
        for at in range(0, len(x), SLICE):
            part = slice(at, at + SLICE)
            slack = 1e-9 * q_norm * norm[at] + 1e-3
            live = np.flatnonzero(q_norm * norm[at] + slack >= best.kth)
            if not len(live):
                break  # lengths only fall from here
            bound = qr[live, :h] @ xr[part, :h].T + q_rest[live, None] * x_rest[None, part] + slack[live, None]
            close = bound >= best.kth[live, None]
            keep = np.flatnonzero(close.any(axis=0))
            if not len(keep):
                continue
            scores = _dots(q[live], x[part][keep])
            for row, i in enumerate(live):
                # ties with the k-th score stay: the smaller vec_id decides
                hit = close[row, keep] & (scores[row] >= best.kth[i]) & (ids[part][keep] != qids[i])
                if hit.any():
                    best.offer(i, scores[row][hit], ids[part][keep][hit])
        rows = [(int(qids[i]), v, -s) for i, own in enumerate(best.rows) for s, v in own]
        return pa.table({n: pa.array([r[j] for r in rows], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, queries, vec: str = "embedding", vec_id: str = "vec_id", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to smaller vec_id.

    queries: condition on vec_id that picks the queries; a query is never its own answer. Vectors that are null
    or hold null or non-finite components take no part; shorter ones count as zero-padded. Repeated rows of
    a vec_id are each an answer, except to a query of that id; repeated query rows count once. Empty in, empty out.
    """
    rows = written(quantised(vectors, vec, vec_id), "vectors")
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = head["n"], head["width"] or 0
    if not n or not width:
        empty = rows.where("false")
        return empty.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    length = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    rows = rows.withColumn("len2", length)
    seeds = rows.orderBy(F.desc("len2"), "vec_id").limit(SEEDS).toArrow()  # bounded by SEEDS
    seed_x, seed_ids = _matrix(seeds.column("v"), width), seeds.column("vec_id").to_numpy()
    rotation = np.linalg.svd(seed_x, full_matrices=True)[2].T if np.isfinite(seed_x @ seed_x.T).all() else np.eye(width)

    def floors(batches):
        for batch in batches:
            q, ids = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            scores = _dots(q, seed_x).astype(np.float64)
            scores[ids[:, None] == seed_ids[None, :]] = -np.inf
            low = np.nextafter(np.sort(scores, axis=1)[:, -k], -np.inf) if scores.shape[1] >= k else np.full(len(q), -np.inf)
            norm = np.sqrt((q * q).sum(axis=1))
            # The length that a vector needs at least to reach the query's floor; the same slack as in the search.
            need = np.where(norm > 0, (low - 1e-3) / (np.maximum(norm, 1e-300) * (1 + 1e-9)), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low), pa.array(need)], names=["vec_id", "v", "floor", "need"])

    # Chunks: ranges of the length, longest first; blocks: ranges of the length that queries need. Their numbers follow from the rows.
    chunks = max(-(-n // CHUNK), min(64, -(-n // 256)))
    blocks = max(1, -(-n // (100 * QUERIES)))
    dealt = rows.repartitionByRange(chunks, F.desc("len2"), "vec_id").withColumn("chunk", F.spark_partition_id())
    dealt = written(dealt.select("vec_id", "v", "len2", "chunk"), "chunks")
    asked = rows.where(queries).dropDuplicates(["vec_id"]).select("vec_id", "v").mapInArrow(floors, "vec_id long, v array<double>, floor double, need double")
    asked = written(asked, "queries")
    # Block borders are quantiles of the need, of one number per block; where borders fall together, a hash decides.
    borders = F.lit(sorted(asked.approxQuantile("need", [i / blocks for i in range(1, blocks)], 0.01))).cast("array<double>") if blocks > 1 else F.expr("cast(array() as array<double>)")
    below, up_to = F.size(F.filter(borders, lambda b: b < F.col("need"))), F.size(F.filter(borders, lambda b: b <= F.col("need")))
    asked = asked.withColumn("block", (below + F.pmod(F.xxhash64("vec_id"), up_to - below + 1)).cast("int"))
    pairs = written(_reached(dealt, asked), "pairs")
    left = dealt.select("vec_id", "v", "chunk").join(small(pairs), "chunk").groupBy("chunk", "block")
    right = asked.join(small(pairs), "block").groupBy("chunk", "block")
    found = left.cogroup(right).applyInArrow(_search(width, rotation, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reached(dealt: DataFrame, asked: DataFrame) -> DataFrame:
    """(chunk, block): only where the chunk's longest vector is as long as some query of the block needs.

    The blocks' needs are one array, of one number per 100 * QUERIES rows; no vector is in this plan.
    """
    needs = asked.groupBy("block").agg(F.min("need").alias("need")).agg(F.collect_list(F.struct("block", "need")).alias("blocks"))
    longest = dealt.groupBy("chunk").agg(F.sqrt(F.max("len2")).alias("longest"))
    both = longest.join(F.broadcast(needs))  # one row
    # sqrt() rounds, so a length may be too small by its last bit.
    hit = F.filter("blocks", lambda b: F.col("longest") * (1 + 1e-12) >= b["need"])
    return both.select("chunk", F.explode(F.transform(hit, lambda b: b["block"])).alias("block"))
