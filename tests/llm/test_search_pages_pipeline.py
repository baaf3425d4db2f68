import json
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import collected, plain_words, texts
from tests.llm.test_text_operators import classes, fp, rates_by_rounds, target_by_rounds
from wattloom.llm import common, langid, licences, packing, queries, topk, wrappers


def best(rows, k=10):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i % 100 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "uneven", "ties", "huge", "few"])
def test_top_k_equals_brute_force(spark, kind):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(700, 24))
    if kind == "uneven":
        x *= rnd.pareto(1.0, size=(700, 1)) + 0.01
    if kind == "ties":
        x = rnd.integers(-1, 2, size=(700, 24)).astype(float)
    if kind == "huge":
        x *= 1e5
    rows = [(i, v) for i, v in enumerate(x.tolist())][: 6 if kind == "few" else 700]
    rows += [(None, x[0].tolist()), (800, None), (900, [float("nan")] * 24), (901, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collected(topk.top_k(df, F.col("vec_id") % 100 == 0)))
    assert got == best(rows)


def test_chunks_that_no_query_can_reach_stay_away(spark, monkeypatch):
    """Vectors of falling length: few (chunk, block) pairs are left before any vector is copied, and no answer is lost."""
    monkeypatch.setattr(topk, "QUERIES", 1)
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(6000, 16))
    x *= (100.0 * 0.999 ** np.arange(6000)[:, None]) / np.linalg.norm(x, axis=1)[:, None]
    rows = list(enumerate(x.tolist()))
    made = []
    reached = topk._reached
    monkeypatch.setattr(topk, "_reached", lambda dealt, asked: made.append((reached(dealt, asked).count(), dealt.select("chunk").distinct().count() * asked.select("block").distinct().count())) or reached(dealt, asked))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collected(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)))
    assert got == best(rows) and made[0][0] < 0.7 * made[0][1]


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 100 == 0).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">Cookies!</div><aside id="sidebar">Side</aside><article><h1>Head &amp; line</h1><p><b>First   part<br>more.<p>Second <i>para</i>&nbsp;graph.</p><ul><li>one<li>two</ul>
<form><input name=q>Search</form><div class="ad">Buy</div><!-- <p>gone</p> --><table><tr><td>a<td>b</table></article><section class="comments"><p>Nice!</p></section><footer>&copy; x</footer></body></html>"""


def infer(pages):
    """The wrapper of pages aligned one by one."""
    every = [wrappers.stream(p) for p in pages]
    nodes = wrappers.parse(*every[0])
    for one in every[1:]:
        nodes = wrappers.align(nodes, wrappers.parse(*one))
    return wrappers.Wrapper(nodes, pages=wrappers.signs(*(wrappers.sign(one[1]) for one in every)))


def test_main_text_of_a_rich_page():
    assert wrappers.main_text(PAGE) == "Head & line\nFirst part more.\nSecond para graph.\none\ntwo\na\nb"
    assert wrappers.main_text("") == "" and wrappers.main_text("plain &lt;text") == "plain <text" and wrappers.main_text("<p>cut <b") == "cut"
    host = infer([f"<body><div>Menu</div><p>{t}</p></body>" for t in ("Story", "Other", "Third")])
    assert wrappers.main_text("<body><div>Menu</div><p>Story</p></body>", host) == "Story"


def bare(nodes):
    """Nodes without the statistics of their slots."""
    return [x if isinstance(x, str) else (*x[:3], len(x[3])) if x[0] == "#" else (x[0], bare(x[1])) for x in nodes]


def test_alignment_finds_optionals_repeats_and_slots():
    e = lambda page: wrappers.parse(*wrappers.stream(page))
    a, b = e("<div>T<p>xx</p><p>y</p></div>"), e("<div>T<h2>q</h2><p>zz</p></div>")
    assert bare(wrappers.align(a, b)) == ["<div", ("#", "o", "T", 2), ("?", ["<h2", ("#", "o", "q", 1), ">h2"]), ("+", ["<p", ("#", "o", None, 2), ">p"]), ">div"]


def random_page(rnd, depth=0):
    """Nested blocks, unclosed and stray tags, inline markup and repeats."""
    out = []
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.random()
        if kind < 0.3 or depth > 3:
            out.append(rnd.choice(["Aa", "Bb &amp; c", " ", "Aa <b>x</b> y", "l<br>m", "<i>open", "</section>", "<img src=x>"]))
        else:
            tag, times = rnd.choice(["p", "div", "li", "article", "nav", 'div class="ad"', "td"]), rnd.randint(1, 3)
            for _ in range(times):
                out.append(f"<{tag}>{random_page(rnd, depth + 1)}" + (f"</{tag.split()[0]}>" if rnd.random() < 0.8 else ""))
    return "".join(out)


def test_wrappers_accept_the_pages_they_come_from():
    """Bound slots are as many as the page has and of their kinds, in order."""
    for seed in range(150):
        rnd = random.Random(seed)
        pages = [random_page(rnd) for _ in range(rnd.randint(1, 8))]
        host = infer(pages)
        for page in pages:
            labels, pieces = wrappers.stream(page)
            bound = host.bind(labels)
            assert bound is not None and len(bound) == len(labels)
            for label, p in zip(labels, bound):
                node = host.nodes[p]
                assert label == (node if isinstance(node, str) else "#" + node[1])


def test_pages_of_the_test_table_bind(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["host"]: r for r in wrappers.wrappers(rows).collect()}
    assert sum(r["n"] for r in found.values()) == rows.count()
    for r in rows.select(wrappers._host("url").alias("host"), "html").collect():
        w = found[r["host"]]
        assert wrappers.Wrapper([wrappers._unpack(x) for x in json.loads(w["expression"])]).bind(wrappers.stream(r["html"])[0]) is not None


def prose(seed, n=40):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n)).capitalize() + "."


def labelled_host(kind, n=6):
    """(pages, their true main texts) of one host."""
    pages, truth = [], []
    for i in range(n):
        head, body = prose(100 * i, 6), [prose(100 * i + k) for k in range(1, 3 + i % 4)]
        story = f"<h1>{head}</h1>" + "".join(f"<p>{x}</p>" for x in body)
        menu = "<div class=x1>" + "".join(f"<a href=/{k}>{prose(900 + k, 2)}</a> " for k in range(5 + i % 2)) + "</div>"
        if kind == "article":  # template and labels inside the article; names that only look like boilerplate
            page = f"<body>{menu}<article><h1>{head}</h1><div class='promo-free reading'>" + "".join(f"<p>{x}</p>" for x in body) + f"</div><p>Sign up for our daily letter, it is free.</p><div class=ad>{prose(500 + i, 12)}</div></article><footer>{prose(7)}</footer></body>"
        elif kind == "plain":  # no article, no telling names: siblings of the body
            page = f"<body><div>Home About {i}</div>{story}<div>Read next: item {i + 1}</div><p>All rights reserved by the site, two thousand and ten.</p></body>"
        else:  # the story in one of several unnamed blocks
            page = f"<body><div>{menu}</div><div><div>{story}</div><div>By nobody, {i} days ago</div></div><div><div>{prose(600 + i, 9)}</div><div>{prose(700 + i, 9)}</div></div></body>"
        pages.append(page)
        truth.append("\n".join([head, *body]))
    return pages, truth


@pytest.mark.parametrize("kind", ["article", "plain", "nested"])
def test_main_text_against_labelled_pages(spark, kind):
    pages, truth = labelled_host(kind)
    df = spark.createDataFrame([(i, f"http://{kind}.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in collected(wrappers.extract(df))} == dict(enumerate(truth))


def test_the_wrapper_changes_the_text():
    """The same page alone and with its host: template text inside the article goes only when the host shows that it is one."""
    pages, truth = labelled_host("article")
    host = infer(pages)
    alone = [wrappers.main_text(p) for p in pages]
    assert all("daily letter" in x for x in alone) and [wrappers.main_text(p, host) for p in pages] == truth


def test_copies_of_one_article_keep_their_text():
    page = labelled_host("article")[0][0]
    near = page.replace("</h1>", " again</h1>").replace(".</p>", " and on.</p>")
    assert wrappers.main_text(page, infer([page, near, page, near, page])) == wrappers.main_text(page)
    other = labelled_host("plain")[0][0]
    assert wrappers.main_text(other, infer([other] * 4)) == wrappers.main_text(other)


def test_long_blocks_fold_and_far_common_nodes_align():
    item = "<li>" + "".join(f"<h{k % 6 + 1}>a{k}</h{k % 6 + 1}>" for k in range(13)) + "</li>"
    for copies in (2, 5):
        nodes = wrappers.parse(*wrappers.stream("<ul>" + item * copies + "</ul>"))
        assert len(nodes) == 3 and nodes[1][0] == "+"
    two = "<dl>" + "<dt>a</dt><dd>b<p>c</p></dd>" * 4 + "</dl>"
    assert [x if isinstance(x, str) else x[0] for x in wrappers.parse(*wrappers.stream(two))] == ["<dl", "+", ">dl"]
    some = lambda seed: "".join(f"<x{seed}{k}></x{seed}{k}>" for k in range(300))
    tail = "<p>common tail</p><table><tr><td>z</table>"
    a, b = (wrappers.parse(*wrappers.stream(f"<body>{some(k)}{tail}</body>")) for k in "ab")
    joined = wrappers.align(a, b)
    assert [x[0] for x in joined if not isinstance(x, str) and x[0] in "?+"] == ["?", "?"] and joined[-1] == ">body" and "<table" in joined


def test_wrappers_drop_template_texts(spark):
    pages = [(i, f"http://h.example/{i}", f"<div>Welcome to the site</div><div>Story {i} of many</div><div>All rights reserved</div>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in collected(wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert got == {i: f"Story {i} of many" for i in range(5)}


def test_pages_with_nulls_repeats_and_none(spark, sf_dir):
    rows = [(1, None, PAGE), (1, None, PAGE), (None, "x", None), (2, "http://a/", ""), (3, "not a url", "<article><p>" + "long " * 50_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit(2))
    got = collected(wrappers.extract(df))
    assert len(got) == 5 and sorted(r["n_chars"] for r in got)[-1] == 5 * 50_000 - 1
    assert wrappers.extract(df.where("false")).collect() == []
    for r in collected(queries.op10_wrappers(spark, sf_dir)):
        assert r["text"] and r["n_chars"] == len(r["text"]) and "track(" not in r["text"]


def test_licences_and_inheritance(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License.\n" + "More of it. " * 30), (2, "p/a.py", "code here"), (3, "p/sub/b.py", "# Licensed under the Apache License, Version 2.0\ncode"), (4, "p/sub/deep/c.py", "code"),
        (5, "q/d.py", "code"), (6, "p/sub/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, None, "code"), (8, "p/e.py", None), (8, "p/e.py", None), (9, "p/n.md", "the license of the public work is free software"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in collected(licences.licences(df))}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "p"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "GPL-3.0", "p/sub"), 5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", None),
        7: (None, None, None), 8: (None, "MIT", "p"), 9: (None, "MIT", "p"),
    }


def plain_score(text, templates, idf, unknown):
    """The best (score, name) of a text by a plain version, without a gate."""
    tf = Counter(licences._tokens(text))
    size = math.sqrt(sum(((1 + math.log(n)) * idf.get(t, unknown)) ** 2 for t, n in tf.items()))
    scores = [(sum(w * (1 + math.log(tf[t])) * idf[t] for t, w in v.items() if t in tf) / size, name) for name, _, v in templates if len(set(tf).intersection(v)) >= licences.SHARED]
    return max(scores, default=(0, ""))


def test_licence_gates_drop_nothing(spark, sf_dir):
    """Every line, sentence, paragraph, header and whole file of the table, and of licence texts with other text around them."""
    templates, idf, unknown = licences.model()
    lines, full = [t for t in templates if t[1] == "line"], [t for t in templates if t[1] == "full"]
    docs = texts(spark, sf_dir)
    rnd = random.Random(3)
    own = [f.read_text() for f in sorted((Path(licences.__file__).parent / "licence_texts").glob("*.txt"))]
    for n, text in enumerate(own):
        rows = text.split("\n")
        for k, share in enumerate((0.3, 0.5, 0.8)):
            docs[10**6 + 10 * n + k] = "\n".join(x if rnd.random() < share else "other words of a file" for x in rows)
    got = {r["doc_id"]: r for r in collected(licences.licences(spark.createDataFrame([(i, t, f"{i}/x") for i, t in docs.items()], "doc_id long, text string, path string")))}
    for i, text in docs.items():
        low = text.lower()
        units = [(y, lines) for x in re.split(r"[\n\r]+", low) for y in [x, *(z for z in re.split(r"(?<=[.;:!?])\s+", x) if len(licences._tokens(z)) > 2)]]
        blocks, all_lines = re.split(r"(?:\r\n?|\n)[^a-z0-9\r\n]*(?:\r\n?|\n)", low), re.split(r"\r\n?|\n", low)
        blocks += ["\n".join(all_lines[:n]) for n in (4, 8, 16, 32) if len(all_lines) > n]
        units += [(x, [t for t in templates if t[1] != "line"]) for x in blocks] + [(low, full)]
        score, name = max((plain_score(x, of, idf, unknown) for x, of in units if x), default=(0, ""))
        assert got[i]["own_licence"] == (name if score >= licences.THRESHOLD else None) or abs(score - got[i]["score"]) < 1e-9, (i, score, name, got[i])


def test_licence_lines_between_the_thresholds(spark):
    """Lines that score 0.6 to 0.8, as long as they are and among long lines of common words."""
    lines = {"MIT License": "MIT", "This software is released under the MIT License.": "MIT", "This text is licensed under CC BY 4.0.": "CC-BY-4.0", "Text available under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Apache License": "Apache-2.0",
             "GNU GENERAL PUBLIC LICENSE": "GPL-3.0", "SPDX-License-Identifier: MIT": "MIT", "The MIT License (MIT)": "MIT"}
    rows = [(i, f"d{i}/x", f"{'the work of any person is free to use ' * 50}word\n{line}\nend", line) for i, line in enumerate(lines)]
    got = collected(licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string, line string")))
    assert {r["doc_id"]: r["own_licence"] for r in got} == {i: lines[line] for i, _, _, line in rows}
    assert all(r["score"] >= 0.6 for r in got) and sum(r["score"] < 0.85 for r in got) >= 3
    german = spark.createDataFrame([(1, "a/b", "Mit\nmit\nDas Haus mit\n4.0")], "doc_id long, path string, text string")
    assert [r["own_licence"] for r in collected(licences.licences(german))] == [None]


def test_licence_blocks_and_whole_files(spark):
    """Wrapped notices, full texts under any name, and notices inside a longer line."""
    full = {f.stem: f.read_text() for f in (Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    gpl = "# Copyright (C) 2020 Foo\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os\n"
    rows = [(i, f"{name}/{i}", text) for i, (name, text) in enumerate(sorted(full.items()))]
    want = {i: path.split("/")[0] for i, path, _ in rows}
    rows += [(100, "n/a.py", gpl + "x = 1\n" * 50), (101, "n/b.c", "Copyright (c) 2019 Foo. Licensed under the MIT License. All other words of this long line say something else.\nint x;"), (102, "n/c.txt", "the use of any work in this or other terms " * 400), (103, "MIT/other.c", "int x;")]
    got = {r["doc_id"]: r for r in collected(licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")))}
    assert {i: got[i]["own_licence"] for i in got} == want | {100: "GPL-3.0", 101: "MIT", 102: None, 103: None}
    assert all(got[i]["is_file"] for i in want) and not got[100]["is_file"] and got[103]["licence"] == "MIT"


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    profiles = langid.fit(docs.where(~langid.held_out()))
    ranker = langid.Ranker(profiles)
    kept = {i: r for i, r in rows.items() if ranker.predict(r["text"])[0] != "und" and ranker.predict(r["text"])[1] >= 0.05}
    last = {}
    for i in sorted(kept):
        last[kept[i]["text"]] = i
    kept = {i: kept[i] for i in last.values()}
    lows = set(classes({i: fp(r["text"]) for i, r in kept.items()}).values())
    kept = {i: r for i, r in kept.items() if i in lows}
    stages = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        stages[name] = now.count()
        if name == "near":
            assert {r["doc_id"] for r in now.select("doc_id").collect()} == set(kept)
        if name != "pack":
            assert now.columns == docs.columns
    sizes: dict = {}
    for r in kept.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(plain_words(r["text"]))
    words = packing.WordIds(queries.tokenizer_path())
    want = Counter()  # of (doc_id, ids of one copy)
    for i, copies in mixed_by_force(kept, target_by_rounds(sizes), sizes).items():
        for text in copies:
            want[i, (*words.ids(text).tolist(), packing.END_ID)] += 1
    pieces = collected(corpus_pipeline.run(spark, sf_dir))
    assert len(pieces) == stages["pack"]
    fits: dict = {}
    for i, ids in want:
        fits.setdefault((i, len(ids)), []).append(ids)
    covered = Counter()
    windows: dict = {}
    for r in pieces:
        whole = fits[r["doc_id"], r["doc_tokens"]]
        part = [ids[r["start"] : r["start"] + r["length"]] for ids in whole]
        assert r["ids_crc32"] in {zlib.crc32(np.array(ids, "<u4")) for ids in part}
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == Counter({(i, n): n * sum(want[i, ids] for ids in of) for (i, n), of in fits.items()})
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def mixed_by_force(docs, target, sizes):
    """Texts of each document in the mix, source by source: whole copies, then in rank order until the words are spent."""
    xxh = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    out = {}
    for source in sizes:
        own = {i: plain_words(r["text"]) for i, r in docs.items() if r["source"] == source}
        rate = rates_by_rounds({i: len(w) for i, w in own.items()}, target[source])
        copies = {i: math.floor(x + 1e-12) for i, x in rate.items()}
        rest = max(0, math.floor(target[source] - sum(copies[i] * len(own[i]) for i in own) + 0.5))
        ranks = []
        for i in own:
            row = xxh(docs[i]["text"].encode(), xxh(struct.pack("<q", i)))
            h = xxh(struct.pack("<Q", row), xxh(struct.pack("<q", i), xxh(b"mix")))
            u, p = ((h >> 11) + 0.5) / 2**53, max(0.0, rate[i] - copies[i])
            out[i] = [docs[i]["text"]] * copies[i]
            ranks.append(((u / (1 - u)) / (p / (1 - p)) if p > 0 else math.inf, i))
        for _, i in sorted(ranks):
            if rest > 0 and own[i]:
                out[i] = out[i] + [" ".join(own[i][:rest])]
                rest -= min(rest, len(own[i]))
    return {i: copies for i, copies in out.items() if plain_words(docs[i]["text"])}


def test_a_scratch_table_leaves_no_garbage_on_the_driver(spark):
    """Stages write many scratch tables; what each leaves in the driver's heap goes before the next."""
    beans = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = beans()
    assert common.written(spark.range(3).toDF("id"), "few").count() == 3
    assert beans() > before
