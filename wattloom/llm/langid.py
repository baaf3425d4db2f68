"""Language identification by rank-order profiles and out-of-place distance.

Words are runs of letters, lower-cased and padded with a blank on both sides; n-grams of one to
three characters that hold a letter are counted. A profile is the TOP most frequent n-grams in rank order.
A document's distance to a language is the sum over its own top n-grams of how far their rank
is out of place there (absent: TOP). The nearest language wins, ties to the smaller name.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, small

#: Ranks in a profile, and documents per language that a profile is fitted on (a bounded sample,
#: the first by a hash of their id).
TOP, FIT_DOCS = 400, 1500
#: Characters of a text that are counted at a time.
PIECE = 1 << 18
_SHIFT = np.uint64(21)


@functools.cache
def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, or 0 for anything that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in [*range(0x0000, 0xD800), *range(0xE000, 0x33480)]:
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def _grams(codes: np.ndarray) -> np.ndarray:
    """Keys of the n-grams of one blank-padded letter sequence (0: blank)."""
    c = codes.astype(np.uint64)
    one, two = c[c > 0], (c[:-1] << _SHIFT) | c[1:]
    three = (two[:-1] << _SHIFT) | c[2:]
    return np.concatenate([one, two[(c[:-1] > 0) | (c[1:] > 0)] | np.uint64(1 << 42), three[c[1:-1] > 0] | np.uint64(1 << 63)])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, counts) of a whole text; keys ascend."""
    table, parts, at = _letters(), [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        codes = table[np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = codes > 0
        keep[1:] |= keep[:-1].copy()  # of blanks, the first after a letter stays
        parts.append(np.unique(_grams(np.concatenate([[0], codes[keep], [0]]).astype(np.uint32)), return_counts=True))
        at = end
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def ranked(keys: np.ndarray, n: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    if len(keys) > 4 * top:
        keep = n >= np.partition(n, -top)[-top]
        keys, n = keys[keep], n[keep]
    return keys[np.lexsort((keys, -n))][:top]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", fit_docs: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """Profiles per language from at most fit_docs labelled rows each (the smallest id hashes).

    Rows with null label or text don't count. Only the profiles reach the driver: TOP numbers per language. The sampled ids
    are broadcast if they are few.
    """
    from pyspark.sql import Window

    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("label"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id)).alias("h")
    )
    # A share of the hashes that holds fit_docs rows but for a chance of a few standard deviations; all of a rare language.
    share = rows.groupBy("label").agg((F.lit(1.5 * fit_docs + 40) / F.count("*")).alias("share"))
    below = (F.col("share") >= 1) | (F.col("h").cast("double") <= (F.col("share") - 0.5) * 2.0**64)
    pick = rows.join(small(share), "label").where(below)
    first = pick.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).where(F.col("nth") <= fit_docs)
    ids = first.select("label", "doc_id").distinct()
    chosen = docs.select(F.col(label).alias("label"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    got = chosen.join(small(ids), ["label", "doc_id"])

    def run(batches):
        for batch in batches:
            found: dict[str, list] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(2)):
                if body.as_py():
                    found.setdefault(name, []).append(counts(body.as_py()))
            for name, parts in found.items():
                k, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], names=["label", "k", "n"])

    grams = bounded_batches(got.select("label", "doc_id", "text")).mapInArrow(run, "label string, k long, n long").groupBy("label", "k").agg(F.sum("n").alias("n"))
    best = grams.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "k"))).where(F.col("r") <= TOP)
    rows_of: dict[str, list] = {}
    for r in best.collect():  # languages times TOP rows
        rows_of.setdefault(r["label"], []).append((r["r"], r["k"]))
    return {name: np.array([k for _, k in sorted(v)], np.int64).view(np.uint64) for name, v in sorted(rows_of.items())}


class Ranker:
    """Profiles as one table: n-gram by language, its rank."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.keys = np.unique(np.concatenate([profiles[x] for x in self.names])) if self.names else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for j, x in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, profiles[x]), j] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): 'und' and 0 for a text that is null or has no letter."""
        keys, n = counts(text) if text else (np.empty(0, np.uint64), np.empty(0, np.int64))
        if not len(keys) or not self.names:
            return "und", 0.0
        own = ranked(keys, n)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != own] = len(self.keys)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, TOP, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.names[best], float(1.0 - far[best] / (TOP * len(own)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) per document row; whole texts of any length, no other input column is read.

    A text that is null or empty, or has no letter, is 'und' with score 0. Of equally near languages the smaller name wins.
    Repeated rows each keep their row; an empty table gives an empty one, and without profiles all is 'und'.
    """

    def run(batches):
        ranker = Ranker(profiles)
        for batch in batches:
            got = [ranker.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return bounded_batches(source).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows that learning never sees: crc32 of the id as text is divisible by five (null ids aren't)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fit on rows that aren't held out, predict all; cases as in identify()."""
    profiles = fit(docs.where(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.05) -> DataFrame:
    """The rows of docs whose language is known: a letter at all, and a score of min_score or more.

    A null or empty text is dropped; a text of any length counts whole; repeated rows are judged alike and each stays;
    columns may have any name; an empty table gives an empty one.
    """
    profiles = fit(docs.where(~held_out()))
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        ranker = Ranker(profiles)
        for batch in batches:
            keep = [s >= min_score and x != "und" for x, s in (ranker.predict(t.as_py()) for t in batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(plain).mapInArrow(run, plain.schema).toDF(*names)
