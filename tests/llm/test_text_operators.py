import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import collected, no_documents, odd_documents, plain_words, texts, words
from wattloom.llm import components, exact_dedup, langid, mixing, packing, pii, queries, simhash, suffixes

DETECT = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in DETECT for m in re.finditer(p, text) if valid(k, m[0]))


TRICKY = [
    "a@b.c_d@e.f x@y a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.2.3", "4539 1488 0343 6467, 4539-1488-0343-6467 4539  1488 0343 6467", "+1((((( +1 (2) 3", "💡 é a.b@c.de 10.0.0.1\n+49 30 1234567-89",
    "1" * 5000, "a" * 5000 + "@", "+1" + "(" * 5000, "1.2.3." * 300, " ".join(f"u{i}@h.io" for i in range(700)),
]


def test_pii_equals_plain_patterns(spark, sf_dir):
    docs = texts(spark, sf_dir) | {10**6 + i: t for i, t in enumerate(TRICKY)}
    got = collected(pii.digest(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))
    assert len(got) == len(docs)
    for r in got:
        want = base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)
        assert [r[f"n_{k}"] for k, _ in DETECT] == [want.count(f"{k}:") for k, _ in DETECT]


def told_by_force(docs):
    """{id: sorted (action, start, end)} of {id: text}, from sets of documents."""
    import math

    import regex

    term = regex.compile(pii.TERM)
    holds, with_term, pairs = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in docs.items():
        for m in term.finditer(text.lower()):
            with_term[m[0]].add(i)
        for k, p in DETECT:
            for m in re.finditer(p, text):
                if not valid(k, m[0]):
                    continue
                entity = k, m[0].lower()
                holds[entity].add(i)
                before, after = text[max(0, m.start() - pii.CONTEXT) : m.start()], text[m.end() : m.end() + pii.CONTEXT]
                if m.start() > pii.CONTEXT:
                    before = re.sub(r"^[^ \t\n\x0b\f\r]+", "", before)
                if len(text) - m.end() > pii.CONTEXT:
                    after = re.sub(r"[^ \t\n\x0b\f\r]+$", "", after)
                for side in (before, after):
                    for t in term.finditer(side):
                        pairs[entity, t[0].lower()].add(i)
    n, told = len(docs), defaultdict(dict)
    for (entity, t), met in pairs.items():
        ic = math.log2(n / len(holds[entity]))
        share = math.log2(n * len(met) / (len(holds[entity]) * len(with_term[t]))) / ic if ic > 0 and with_term[t] else 0
        if share >= pii.GENERALISE:
            for i in holds[entity]:
                told[i][t] = max("remove" if share >= pii.REMOVE else "generalise", told[i].get(t, ""))
    return {i: sorted((told[i][m[0].lower()], m.start(), m.end()) for m in term.finditer(text) if m[0].lower() in told[i]) for i, text in docs.items()}


def test_term_spans_equal_a_plain_version(spark, sf_dir):
    docs = texts(spark, sf_dir)
    docs |= {10**6 + i: f"{' '.join(words(i, 3).split())} Maria's well-known (R2D2) friend, mail a{i % 3}@x.org or 10.0.0.{i % 2}; co-author \u201cOtto\u201d no. 7 at web.site/page" for i in range(12)}
    want = told_by_force(docs)
    got = {r["doc_id"]: r for r in collected(pii.digest(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))}
    found = 0
    for i, text in docs.items():
        spans = base(text)
        terms = ",".join(f"{k}:{a}:{b}" for k, a, b in want[i])
        assert got[i]["spans"] == ",".join(x for x in (spans, terms) if x), i
        found += len(want[i])
    assert found > 100


def test_disclosing_terms_and_redaction(spark):
    rows = [(i, f"call Zebrafish or B52 at a{i % 2}@x.org today" if i else "call solo, the one at b@y.org today") for i in range(5)] + [(10 + i, f"nothing to call or see here today, the {'one' if i < 2 else 'other'} at all") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r for r in collected(pii.sanitised_spans(docs))}
    terms = lambda i: [(rows[i][1][t["start"] : t["end"]], t["kind"], t["class"]) for t in by[i]["terms"]]
    # "solo" stands in one document of 65 (share 1), "one" in three (1 - log 3 / log 65 = 0.74), the rest in many.
    assert terms(0) == [("solo", "remove", "word")] and by[10]["terms"] == []
    # In four documents, two of them of the entity: PMI log2(65 * 2 / (2 * 4)) over IC log2(65 / 2).
    assert terms(1) == [("Zebrafish", "generalise", "name"), ("B52", "generalise", "code")]
    red = {r["doc_id"]: r["sanitised"] for r in collected(pii.redact(docs))}
    assert red[1] == "call [name] or [code] at [EMAIL] today" and red[0] == "call , the one at [EMAIL] today" and red[10] == rows[5][1]


def test_context_goes_past_other_numbers_and_all_places_are_marked(spark):
    told = "Zebrafish born 1990 card 4111 1111 1111 1111 paid. " + "nothing to see in here " * 8 + "ask zebrafish again"
    rows = [(i, told) for i in range(2)] + [(10 + i, "nothing to see in here, born again and paid by card, ask") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r for r in collected(pii.sanitised_spans(docs))}
    assert [told[t["start"] : t["end"]] for t in by[0]["terms"]] == ["Zebrafish", "zebrafish"] and by[10]["terms"] == []
    red = {r["doc_id"]: r["sanitised"] for r in collected(pii.redact(docs))}
    assert "zebrafish" not in red[1].lower() and "[CARD]" in red[1]


def fp(text):
    w = plain_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items):
    """Smallest id per class of (id, fingerprint) under three differing bits, by comparing all pairs."""
    ids = sorted(items)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (items[a] ^ items[b]).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_all_pairs(spark, sf_dir, monkeypatch):
    docs = texts(spark, sf_dir)
    prints = {i: fp(t) for i, t in docs.items()}
    want = classes(prints)
    got = collected(queries.op2_simhash(spark, sf_dir))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("block", [4096, 4])
def test_links_of_dense_fingerprints(spark, monkeypatch, block):
    """Chains and balls of fingerprints, also where a key is larger than one in-memory block."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = np.random.default_rng(3)
    fps = {0, 1, 3, 7, 15, 31, 63, 2**63, 2**63 | 2**40}
    for start in rnd.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        x = start
        for _ in range(10):
            x ^= (1 << int(rnd.integers(64))) | (1 << int(rnd.integers(64))) | (1 << int(rnd.integers(64)))
            fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(df) if block == 4096 else _links_with_block(df, block)
    roots = {r["node"]: r["root"] for r in collected(components.components(found))}
    got, want = defaultdict(set), defaultdict(set)
    for x in signed:
        got[roots.get(x, x)].add(x)
    for x, top in classes({s: s % 2**64 for s in signed}).items():
        want[top].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def _links_with_block(df, block):
    """links() with a block size that workers see too: the two passes over local rows."""
    rows = sorted((r["key"], r["fp"]) for r in simhash.variants(df).collect())
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + 50]], pa.int64()), pa.array([f for _, f in rows[a : a + 50]], pa.int64())], names=["key", "fp"]) for a in range(0, len(rows), 50)]
    out, large = [], defaultdict(list)
    for batch in simhash._scan(iter(batches)):
        for key, a, b, blk in zip(*(c.to_pylist() for c in batch.columns)):
            (large[key].append((a, blk)) if blk >= 0 else out.append((a, b)))
    assert large
    for members in large.values():
        n = max(b for _, b in members) + 1
        for i in range(n):
            for j in range(i, n):
                t = simhash._block_pair(pa.table({"a": pa.array([f for f, b in members if b in (i, j)], pa.int64())}))
                out += zip(t.column("a").to_pylist(), t.column("b").to_pylist())
    return df.sparkSession.createDataFrame(out, "a long, b long")


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (None, 1), (6, 5)]
    got = {r["node"]: r["root"] for r in collected(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(6, 40)}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 400))
def test_fingerprints_compose(data, cut):
    cut = min(cut, len(data))
    parts = [exact_dedup.chunk_hash(p) if p else (0, 0, 0) for p in (data[:cut], data[cut:])]
    assert exact_dedup.combine(*parts) == exact_dedup.text_hash(data)
    value = 0
    for byte in data:
        value = value * exact_dedup.BASE + byte + 1
    assert exact_dedup.text_hash(data)[:2] == tuple(value % p for p in exact_dedup.PRIMES)


def test_exact_keeps_no_table_by_shuffle_partition(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    got = exact_dedup.classes(rows)
    assert "InMemory" not in got._jdf.queryExecution().withCachedData().toString()
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size").collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def test_exact_duplicates(spark, sf_dir):
    docs = texts(spark, sf_dir)
    by = defaultdict(list)
    for i, t in docs.items():
        by[t].append(i)
    for r in collected(queries.op8_exact(spark, sf_dir)):
        t = docs[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(by[t]), len(by[t]), r["doc_id"] == max(by[t]), hashlib.sha256(t.encode()).hexdigest())


def test_equal_fingerprints_of_different_texts_are_told_apart(spark):
    """Tiny prime fields make many texts of a length collide; texts of several chunks are hashed in parallel."""
    long = words(6, 30_000)
    rows = [(i, f"text {chr(97 + i % 9)}") for i in range(40)] + [(100 + i, long + "abc"[i % 3]) for i in range(7)] + [(None, "text a"), (5, "text f"), (200, long.replace("a", "b", 1) + "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(-1 if i is None else i)
    for primes in ((3, 2), exact_dedup.PRIMES):
        got = collected(exact_dedup.exact_duplicates(df, primes=primes, huge=1 << 16))
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(by)
        if primes == (3, 2):
            assert len({r["fp"] for r in got}) < len(by)
        texts_of = defaultdict(list)
        for i, t in rows:
            texts_of[i].append(t)
        for r in got:
            assert any((r["keep_id"], r["group_size"], r["text_sha256"]) == (max(by[t]), len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for t in texts_of[r["doc_id"]])
        plain = {t: exact_dedup.text_hash(t.encode(), primes) for t in by}
        assert {(r["text_sha256"], r["fp"]) for r in got} == {(hashlib.sha256(t.encode()).hexdigest(), h[0] << 31 | h[1]) for t, h in plain.items()}


def removed_by_force(docs):
    seen = Counter()
    for _, b in docs:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] += 1
    out = []
    for i, b in docs:
        hit = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                hit[k : k + 200] = b"\1" * 200
        out.append((i, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [2048, 1])
def test_repeated_bytes_equal_brute_force(spark, group):
    """With a group of one region, every anchor goes through the distributed pass of windows."""
    rnd = np.random.default_rng(7)
    passage = words(3, 120)
    rows = [(i, words(100 + i, 60) + passage[: int(rnd.integers(150, 700))] + words(200 + i, 40)) for i in range(8)]
    rows += [(20, passage), (21, passage), (22, passage[5:]), (23, "ab" * 400), (24, "é" * 150 + words(9, 30)), (25, "x" + "é" * 150), (26, ""), (27, words(4, 50) * 2), (28, passage[:199]), (None, passage[50:]), (None, words(11, 90)), (20, passage)]
    docs = [(i, t.encode()) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(suffixes.removed(df, group=group))), key=str)
    assert got == removed_by_force(docs)


@pytest.mark.parametrize("collide", [False, True])
def test_windows_of_an_anchor_are_compared_by_bytes(monkeypatch, collide):
    """Digit passes against plain bytes, also where all digits have one hash."""
    if collide:
        monkeypatch.setattr(suffixes._tables()[1], "sums", lambda grid: np.zeros((*grid.shape[:-1], grid.shape[-1] + 1), np.uint64))
    rnd = np.random.default_rng(2)
    anchor = rnd.integers(0, 9, suffixes.GRAM, dtype=np.uint8)
    off = rnd.integers(100, 153, 40)
    windows = np.minimum(off + 1, rnd.integers(1, 150, 40))
    regions = []
    for o, w in zip(off, windows):
        text = rnd.integers(0, 2, 600, dtype=np.uint8) if rnd.random() < 0.3 else np.zeros(600, np.uint8)
        text[300 : 300 + suffixes.GRAM] = anchor
        regions.append(text[300 - o : 300 - o + w - 1 + suffixes.DEPTH].tobytes())
    seen = Counter((152 - o + k, r[k : k + 200]) for o, w, r in zip(off, windows, regions) for k in range(w))
    want = [(i, 152 - o + k) for i, (o, w, r) in enumerate(zip(off, windows, regions)) for k in range(w) if seen[152 - o + k, r[k : k + 200]] > 1]
    assert list(zip(*(x.tolist() for x in suffixes._repeated(off, windows, regions)))) == want and want


def test_language_profiles(spark, sf_dir):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = collected(queries.op4_langid(spark, sf_dir))
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == labels[r["doc_id"]] for r in held]) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_distance_equals_a_plain_version():
    def plain(text, n=400):
        counted = Counter()
        for word in re.findall(r"[^\W\d_]+", text):
            w = [0, *(ord(c.lower()[0]) for c in word), 0]
            for k in (1, 2, 3):
                counted.update((k, *w[i : i + k]) for i in range(len(w) - k + 1) if any(w[i : i + k]) and (k < 3 or w[i + 1]))
        return counted

    text = "The quick brown Fox, and the äöü DOG 12 times; été! " * 3
    keys, n = langid.counts(text)
    assert sorted(n.tolist()) == sorted(plain(text).values())
    big = words(5, 80_000)
    a, b = langid.counts(big), langid.counts(big[: len(big)])
    assert (a[0] == b[0]).all() and a[1].sum() == sum(plain(big).values())


def test_ranks_and_out_of_place_distance_equal_a_plain_version(spark):
    """Profiles, ranks, distances and scores from plain counters."""

    def plain(text):
        counted = Counter()
        for word in re.findall(r"[^\W\d_]+", text):
            w = [0, *(ord(c.lower()[0]) for c in word), 0]
            counted.update(c for c in w if c)
            counted.update(a << 21 | b | 1 << 42 for a, b in zip(w, w[1:]) if a or b)
            counted.update((a << 42 | b << 21 | c) & (1 << 64) - 1 | 1 << 63 for a, b, c in zip(w, w[1:], w[2:]) if b)
        return counted

    top = lambda c: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][: langid.TOP]
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "éèêàçùab"}
    rnd = np.random.default_rng(9)
    make = lambda of, n: " ".join("".join(rnd.choice(list(of), int(rnd.integers(1, 8)))) for _ in range(n))
    rows = [(i, make(letters[name], 60), name) for i, name in enumerate(list(letters) * 12)]
    profiles = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # Keys are compared as signed numbers where counts are equal, as Spark orders them.
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    for name in letters:
        whole = sum((plain(t) for _, t, x in rows if x == name), Counter())
        assert profiles[name].tolist() == [k for k, _ in sorted(whole.items(), key=lambda x: (-x[1], signed(x[0])))][: langid.TOP]
    ranker = langid.Ranker(profiles)
    for text in [make(x, 15) for x in letters.values()] + ["a", "zzz xyz", make("abeé", 400)]:
        own = top(plain(text))
        far = {x: sum(abs(profiles[x].tolist().index(k) - r) if k in set(profiles[x].tolist()) else langid.TOP for r, k in enumerate(own)) for x in letters}
        name = min(sorted(far), key=far.get)
        assert ranker.predict(text) == (name, pytest.approx(1 - far[name] / (langid.TOP * len(own))))


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    docs = texts(spark, sf_dir) | {10**6: "don't STOP I'll we're é́ ﬁ x\u0085y z 漢字💡 İ ß <|endoftext|> x<|startoftext|>y a1b2 \x1c end...,", 10**6 + 1: words(3, 9000), 10**6 + 2: ""}
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in docs.items()}
    rows = collected(packing.pack(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), queries.tokenizer_path()))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        whole = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(whole)
        assert zlib.crc32(np.array(whole[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts, most in [*((p, None) for p in pieces.values()), *((s, 4096) for s in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        if most:
            assert at <= most
            padding += 0 if at & (at - 1) == 0 else most - at
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_packer_with_many_open_windows(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 3)
    packer = packing.Packer(0, 64, 4)
    rows = [r for i, n in enumerate([40, 41, 42, 43, 44, 50, 24, 64, 130, 1]) for r in packer.add(i, np.arange(n, dtype="<u4"))] + list(packer.finish())
    by = Counter()
    for doc, start, length, *_ in rows:
        by[doc] += length
    assert list(sorted(by.values())) == sorted([40, 41, 42, 43, 44, 50, 24, 64, 130, 1])


def test_placement_minimises_the_sum_of_squares():
    """Every placement against all levels, and most tokens in windows that placement filled."""
    rnd = np.random.default_rng(4)
    packer, sizes = packing.Packer(0), np.minimum(rnd.lognormal(6.2, 1.1, 1000).astype(int) + 1, 4095)
    for i, n in enumerate(sizes.tolist()):
        if not packer.short:
            before, tops = packer.count.copy(), packer.top.copy()
            squares = lambda c: int((c * c).sum())
            best = []
            for level in [0, *np.flatnonzero(before)]:
                if tops[level] + n <= 4096:
                    after = before.copy()
                    after[level] -= level > 0
                    to = -(-(tops[level] + n) // packing.GRAIN)
                    after[to] += to < packer.full
                    best.append(squares(after))
            list(packer.add(i, np.zeros(n, "<u4")))
            assert squares(packer.count) == min(best)
        else:
            list(packer.add(i, np.zeros(n, "<u4")))
    assert packer.placed >= 0.9 * sizes.sum()


def test_ids_of_another_tokenizer_file(spark):
    """A file with other rules gives the ids of whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    known, other = packing.WordIds(queries.tokenizer_path()), packing.WordIds(path)
    assert known.words and not other.words
    text = "Some  Words,\nand more\u00a0<|endoftext|> x"
    assert other.ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def target_by_rounds(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    fixed, free, total = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = (total - sum(fixed.values())) / sum(weight[k] for k in free)
        over = [k for k in free if share * weight[k] > 2 * sizes[k]]
        if not over:
            return fixed | {k: share * weight[k] for k in free}
        for k in over:
            fixed[k] = 2.0 * sizes[k]
            free.discard(k)
    return fixed


def rates_by_rounds(size, target):
    """Expected copies per document of a source: growing with the size class, 2 at most, words times copies on target."""
    weight = {i: 2.0 ** (mixing.TILT * (max(1, n).bit_length() - 1)) for i, n in size.items()}
    rate, free = {}, set(size)
    while free:
        room = sum(size[i] * weight[i] for i in free)
        scale = max(0.0, target - sum(2 * size[i] for i in rate)) / room if room else 0.0
        over = {i for i in free if scale * weight[i] >= 2}
        if not over:
            return rate | {i: scale * weight[i] for i in free}
        heaviest = max(weight[i] for i in over)
        for i in over:
            if weight[i] == heaviest:
                rate[i] = 2.0
                free.discard(i)
    return rate


def test_each_document_has_its_own_probability(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = mixing.ranks(docs).withColumn("rows", F.lit(1))
    classes_of = base.groupBy("source", "class").agg(F.sum("size").alias("words"))
    for share in (0.3, 1.0, 1.9, 2.0):
        plan = base.groupBy("source").agg((F.sum("size") * share).alias("target"))
        rate = {(r["source"], r["class"]): r["rate"] for r in collected(mixing.copies(classes_of, plan))}
        rows = collected(base.select("doc_id", "source", "size", "class"))
        for source in {r["source"] for r in rows}:
            own = {r["doc_id"]: r for r in rows if r["source"] == source}
            want = rates_by_rounds({i: r["size"] for i, r in own.items()}, share * sum(r["size"] for r in own.values()))
            assert all(rate[source, own[i]["class"]] == pytest.approx(x) for i, x in want.items())
            assert sum(x * own[i]["size"] for i, x in want.items()) == pytest.approx(share * sum(r["size"] for r in own.values()))
        assert share == 2.0 or len(set(rate.values())) > 3


def test_mixing_targets_and_amounts(spark, sf_dir):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = {i: len(plain_words(t)) for i, t in texts(spark, sf_dir).items()}
    totals, taken = Counter(), Counter()
    for i, n in size.items():
        totals[source[i]] += n
    want = target_by_rounds(totals)
    rows = collected(queries.op7_mixing(spark, sf_dir))
    for r in rows:
        k = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], totals[k]) and r["target"] == pytest.approx(want[k]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[k] += r["taken"]
    assert all(abs(taken[k] - want[k]) <= 1 for k in want) and len(rows) == len(size)
    again = collected(queries.op7_mixing(spark, sf_dir))
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_rows_hold_the_words_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in collected(queries.op7_mixing(spark, sf_dir)) if r["taken"]}
    got = Counter()
    for r in collected(mixing.mixed(docs)):
        got[r["doc_id"]] += len(plain_words(r["text"]))
    assert got == taken


OPERATORS = {
    "pii": pii.digest, "redact": pii.redact, "simhash": simhash.near_duplicates, "exact": exact_dedup.exact_duplicates, "suffixes": suffixes.removed, "langid": langid.predicted,
    "packing": lambda d: packing.pack(d, queries.tokenizer_path()), "mixing": mixing.mix, "licences": lambda d: __import__("wattloom.llm.licences", fromlist=["x"]).licences(d.withColumn("path", F.col("source"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    docs = odd_documents(spark)
    got = collected(OPERATORS[name](docs))
    ids = Counter(r["doc_id"] for r in got)
    if name == "packing":
        assert set(ids) == {r["doc_id"] for r in docs.collect()}
    else:
        assert ids == Counter(r["doc_id"] for r in docs.collect())
    if name == "exact":
        assert sum(r["kept"] for r in got) == len({r["text"] or "" for r in docs.collect()})
        assert {r["keep_id"] for r in got if r["doc_id"] == 5} == {12}
    if name == "simhash":
        assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 9)} == {1}
    if name == "langid":
        assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 9, 11)} == {"und"}
    if name == "suffixes":
        assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] in (12, 5))
    empty = OPERATORS[name](no_documents(spark))
    assert empty.collect() == [] and len(empty.columns) > 1


@pytest.mark.parametrize("stage", [langid.accepted, exact_dedup.survivors, simhash.representatives, mixing.mixed])
def test_stages_keep_the_columns(spark, stage):
    docs = odd_documents(spark)
    got = stage(docs)
    assert got.columns == docs.columns and stage(no_documents(spark)).collect() == []
    rows = collected(got)
    if stage is langid.accepted:
        assert {r["doc_id"] for r in rows} == {3, None, 5, 6, 7, 8, 10, 12}
    if stage is exact_dedup.survivors:
        assert sorted(Counter(r["text"] or "" for r in rows).values()) == [1] * len({r["text"] or "" for r in docs.collect()})
