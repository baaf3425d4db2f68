"""Token packing by online sum-of-squares placement.

Each partition packs its own stream of documents. Whole windows are cut off a long document;
its remainder goes to the fill level that minimises the sum of squared counts of partially filled
windows. A level is GRAIN tokens: with c[h] windows at level h, moving one from h to k changes the sum by
2 (c[k] - c[h]) + 2, opening one at k changes it by 2 c[k] + 1, and filling one up frees c[h]. The
counts live in a level array, so a placement is one vector operation over the levels. A window in which less than
GRAIN tokens are missing takes them from the head of the next document, so every window is filled to the last token.

Windows still open at the end of a stream (or when OPEN of them are) are joined by cutting, and
the last one is cut into powers of two, which need no padding. Memory is OPEN windows at most.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WINDOW, END_ID, OPEN, GRAIN = 4096, 2, 1024, 32
#: Words whose ids a worker remembers.
CACHE = 800_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A word that is letters, then closing marks: two pre-tokens, whose ids don't depend on each other. The letters are
#: composed ones whose lower case is one letter, so normalising changes nothing else.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,;:!?|$%&*#]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: itself if printable, else the next ones from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The rules under which a text's ids are those of its words (see WordIds); other files are asked for whole texts.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_words(tokenizer) -> bool:
    """Whether a tokenizer follows the rules that WordIds knows."""
    rules = json.loads(tokenizer.to_str())
    model, added = rules["model"], rules.get("added_tokens") or []
    return (
        (rules.get("normalizer") or {}).get("normalizers") == _NORMAL and (rules.get("pre_tokenizer") or {}).get("pretokenizers") == _SPLIT
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
    )


class WordIds:
    """Ids of whole texts from ids of their white-space-delimited words.

    A file with other rules than _NORMAL and _SPLIT is asked for whole texts instead.

    ASCII white space separates the tokenizer's pre-tokens and is dropped by it, so the ids of a
    text are those of its words in order; a round-trip test holds this against whole texts. Words are
    remembered in two generations of at most CACHE / 2 each; the older is forgotten when the newer is full.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = by_words(self.tokenizer)
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, text: str) -> bytes:
        """Ids of one pre-token in lower case."""
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= CACHE // 2:
                self.parts.clear()
            coded = [t.id for t in self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.letters))] if text else []
            got = self.parts[text] = struct.pack(f"<{len(coded)}I", *coded)
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain:
            return self._part(plain[1].lower()) + self._part(plain[2])
        coded = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(coded)}I", *coded)

    def ids(self, text: str) -> np.ndarray:
        if not self.words:
            text = text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        words = text.encode("utf-8", "surrogatepass").split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE // 2:
            self.old, self.known = self.known, {}
            new = set(words)
        known, old = self.known, self.old
        for w in new:
            known[w] = old.get(w) or self._word(w)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")


class Packer:
    """Sum-of-squares packing of one stream; add() and finish() yield rows of SCHEMA."""

    def __init__(self, first_sequence: int, window: int = WINDOW, grain: int = GRAIN):
        self.window, self.grain, self.next = window, grain, first_sequence
        self.full = -(-window // grain)  # the level of a full window
        self.count = np.zeros(self.full + 1, np.int64)  # of open windows at each fill level
        self.top = np.zeros(self.full + 1, np.int64)  # tokens in the window of each level that is next in turn
        self.open: list[list] = [[] for _ in range(self.full + 1)]  # windows: (tokens, pieces as (doc_id, start, total, ids))
        self.short: list[tuple[int, list]] = []  # windows that lack less than a level
        self.n_open = self.placed = 0  # placed: tokens of windows that placement filled

    def add(self, doc_id, ids: np.ndarray):
        total, cut = len(ids), len(ids) // self.window * self.window
        for at in range(0, cut, self.window):
            self.placed += self.window
            yield from self._close([(doc_id, at, total, ids[at : at + self.window])])
        if self.short and cut < total:
            fill, held = self.short.pop()
            take = ids[cut : cut + self.window - fill]
            held.append((doc_id, cut, total, take))
            cut += len(take)
            yield from self._keep(fill + len(take), held)
        size = total - cut
        if not size:
            return
        c, top, levels = self.count, self.top, np.arange(self.full)
        own = -(-size // self.grain)
        best, level = (2 * c[own] + 1 if own < self.full else 0), 0
        at = np.flatnonzero((c[:-1] > 0) & (top[:-1] + size <= self.window))  # levels with a window that has room
        if len(at):
            to = -(-(top[at] + size) // self.grain)
            change = np.where(to == self.full, 1 - 2 * c[at], np.where(to == levels[at], 0, 2 * (c[to] - c[at]) + 2))
            k = len(at) - 1 - int(change[::-1].argmin())  # of equal ones the fullest
            if change[k] <= best:
                level = int(at[k])
        fill, held = (self._take(level)) if level else (0, [])
        held.append((doc_id, cut, total, ids[cut:].copy()))
        yield from self._keep(fill + size, held)
        if self.n_open > OPEN:
            yield from self._drain(last=False)

    def _take(self, level: int) -> tuple[int, list]:
        fill, held = self.open[level].pop()
        self.count[level] -= 1
        self.n_open -= 1
        self.top[level] = self.open[level][-1][0] if self.open[level] else 0
        return fill, held

    def _keep(self, fill: int, held: list):
        """Close a full window; file another one under its level."""
        level = -(-fill // self.grain)
        if fill == self.window:
            self.placed += fill
            yield from self._close(held)
        elif level == self.full:
            self.short.append((fill, held))
        else:
            self.open[level].append((fill, held))
            self.count[level] += 1
            self.top[level] = fill
            self.n_open += 1

    def finish(self):
        yield from self._drain(last=True)

    def _drain(self, last: bool):
        """Join the open windows, fullest first, by cutting; the last one stays open or ends the stream."""
        left = self.short + [one for level in reversed(self.open) for one in reversed(level)]
        self.short, self.n_open = [], 0
        self.count[:] = self.top[:] = 0
        for level in self.open:
            level.clear()
        held: list = []
        fill = 0
        for _, pieces in left:
            for doc_id, start, total, ids in pieces:
                while len(ids):
                    take = ids[: self.window - fill]
                    held.append((doc_id, start, total, take))
                    fill, start, ids = fill + len(take), start + len(take), ids[len(take) :]
                    if fill == self.window:
                        yield from self._close(held)
                        held, fill = [], 0
        if not fill:
            return
        if not last:
            yield from self._keep(fill, held)
            return
        parts = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
        now: list = []
        for doc_id, start, total, ids in held:
            while len(ids):
                take = ids[: parts[0]]
                now.append((doc_id, start, total, take))
                parts[0] -= len(take)
                start, ids = start + len(take), ids[len(take) :]
                if not parts[0]:
                    yield from self._close(now)
                    now, parts = [], parts[1:]

    def _close(self, pieces: list):
        offset = 0
        for doc_id, start, total, ids in pieces:
            yield doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, self.next, offset
            offset += len(ids)
        self.next += 1


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and is its end id alone. Repeated rows are packed each, ids may be
    null, no row is dropped; a text of any length is cut into windows as it comes, and an empty table gives an empty one.
    Only the two named columns are read. Sequence ids are unique: the partition's number, then a counter.
    tokenizer: path of a tokenizers file, readable on every executor. Ids come from words where by_words() holds for
    it, else from whole texts.
    """

    def run(batches):
        words = WordIds(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], "<u4")

        def batch_of(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in SCHEMA.split(", ")])

        rows: list = []
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += packer.add(key, np.concatenate([words.ids(body.as_py() or ""), end]))
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield batch_of(rows)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return bounded_batches(source).mapInArrow(run, SCHEMA)
