"""Licence detection by sparse TF-IDF cosine to templates, with directory inheritance.

Each line of a file and each sentence of a line is compared with licence notices, titles and identifiers as a TF-IDF
vector; blocks of lines are compared with standard notices and full licence texts: each paragraph (lines up to one
without a letter or digit), the first 4, 8, 16 and 32 lines, and the file as a whole. A token counts 1 + ln(tf) times,
and document frequencies are over all templates, since common words would decide else. A file of which most lines are
licence lines, or which as a whole is like a full text, is its directory's licence file. A file without a
licence of its own takes that of the nearest ancestor directory that has one.

A text's tokens are found once. Lines and blocks are looked at where the whole text, and scored where they
themselves, hold enough of a template: the part that is missing bounds the cosine. So the gates drop nothing, and all
scoring happens in the row, without a shuffle. Inheritance joins each file's few ancestor directories with the
directories that have a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DID, THASH, keyed, written

THRESHOLD = 0.6
#: Identifiers with a notice or the opening words of the licence text.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
#: Standard notices, which wrap over several lines; full texts are the files of licence_texts.
NOTICES = {
    "GPL-3.0": [_GNU.format("")],
    "LGPL-3.0": [_GNU.format("Lesser ")],
    "AGPL-3.0": [_GNU.format("Affero ")],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD 3-Clause license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."],
    "CC-BY-SA-4.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/."],
    "CC-BY-NC-4.0": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/."],
}
#: Titles of licence texts and machine-readable identifiers, as lines.
TITLES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-3.0": "GNU General Public License, version 3", "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3", "BSD-3-Clause": "BSD 3-Clause License", "MPL-2.0": "Mozilla Public License Version 2.0", "CC-BY-4.0": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International", "CC0-1.0": "CC0 1.0 Universal", "Unlicense": "The Unlicense",
}
#: Tokens that a line must share with a template: one word, such as the German "mit", says nothing.
SHARED = 2
#: Parts that a directory's files are dealt to when they inherit.
SALTS = 64
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_NONE = "cast(array() as array<struct<score: double, name: string>>)"


def _tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def model(templates: dict[str, list[str]] | None = None) -> tuple[list, dict[str, float], float]:
    """(templates as (name, kind, weights), idf, idf of an unknown token); kind: line, notice or full.

    templates: other lines instead of the own lines and titles.
    """
    texts = [(name, "line", t) for name, ts in (templates or TEMPLATES).items() for t in ts]
    if not templates:
        texts += [(name, "line", t) for name, title in TITLES.items() for t in (title, f"SPDX-License-Identifier: {name}")]
    texts += [(name, "notice", t) for name, ts in NOTICES.items() for t in ts]
    texts += [(f.stem, "full", f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    counted = [(name, kind, Counter(_tokens(t))) for name, kind, t in texts]
    seen = Counter(t for _, _, tf in counted for t in tf)
    idf = {t: 1 + math.log(len(texts) / n) for t, n in seen.items()}
    out = []
    for name, kind, tf in counted:
        w = {t: (1 + math.log(n)) * idf[t] for t, n in tf.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        out.append((name, kind, {t: x / size for t, x in w.items()}))
    return out, idf, 1 + math.log(len(texts))


def _least(w: dict[str, float]) -> int:
    """The least number of a template's tokens that THRESHOLD needs: a cosine is at most the length of the part that is there."""
    mass, least = 0.0, 0
    for x in sorted(w.values(), reverse=True):
        if mass >= (THRESHOLD - 1e-9) ** 2:
            break
        mass, least = mass + x * x, least + 1
    return max(SHARED, least)


def _words(of) -> str:
    return f"array({', '.join(map(repr, sorted(of)))})"


def _map(of: dict[str, float]) -> str:
    return f"map_from_arrays({_words(of)}, array({', '.join(f'{of[t]!r}D' for t in sorted(of))}))"


def _gate(known: str, w: dict[str, float]) -> str:
    """SQL condition that holds if a text with these known tokens, or a part of it, may reach a template."""
    mass = f"aggregate(array_intersect({known}, {_words(w)}), 0D, (a, t) -> a + element_at({_map({t: x * x for t, x in w.items()})}, t))"
    return f"(size({known}) >= {_least(w)} AND size(array_intersect({known}, {_words(w)})) >= {_least(w)} AND {mass} >= {(THRESHOLD - 1e-9) ** 2!r}D)"


def _any(known: str, templates: list) -> str:
    return " OR ".join(_gate(known, w) for _, _, w in templates)


def _hits(tokens: str, templates: list, idf: dict[str, float], unknown: float) -> str:
    """SQL array of (score, name) of a token array: the templates that it reaches.

    Equal tokens are counted as runs of the sorted tokens, so a long text costs n log n.
    """
    runs = f"regexp_extract_all(array_join(array_sort({tokens}), ' '), r'(?<!\\S)(\\S++)(?: \\1(?!\\S))*+', 0)"
    run = f"transform({runs}, r -> transform(array(substring_index(r, ' ', 1)), t -> named_struct('t', t, 'f', 1 + ln((length(r) + 1) div (length(t) + 1))))[0])"
    known = _words(set().union(*(w for _, _, w in templates)))
    of = _map(idf)
    scores = []
    for name, _, w in templates:
        dot = f"aggregate(xs, 0D, (a, x) -> a + x.f * coalesce(element_at({_map({t: x * idf[t] for t, x in w.items()})}, x.t), 0D))"
        scores.append(f"named_struct('score', CASE WHEN {_gate('ks', w)} THEN {dot} / len ELSE 0D END, 'name', {name!r})")
    hits = f"filter(array({', '.join(scores)}), h -> h.score >= {THRESHOLD}D)"
    length = f"sqrt(aggregate(cs, 0D, (a, c) -> a + power(c.f * CASE WHEN array_contains(all_known, c.t) THEN element_at({of}, c.t) ELSE {unknown!r}D END, 2)))"
    scored = f"flatten(transform(array({run}), cs -> flatten(transform(array(array_intersect({_words(idf)}, {tokens})), all_known -> flatten(transform(array({length}), len -> flatten(transform(array(filter(cs, c -> array_contains(ks, c.t))), xs -> {hits}))))))))"
    return f"flatten(transform(array(array_intersect({known}, {tokens})), ks -> CASE WHEN {_any('ks', templates)} THEN {scored} ELSE {_NONE} END))"


_BEST = "(l, r) -> CASE WHEN l.score > r.score THEN -1 WHEN l.score < r.score THEN 1 WHEN l.name < r.name THEN -1 WHEN l.name > r.name THEN 1 ELSE 0 END"


def own_licences(files: DataFrame, text: str = "text", path: str = "path", doc_id: str = "doc_id", templates=None) -> DataFrame:
    """Per file row: doc_id, row key, path, licence, score, n_lines (licence lines), is_file (mostly licence text, or named so)."""
    every, idf, unknown = model(templates)
    lines, blocks, full = ([t for t in every if t[1] in kinds] for kinds in (("line",), ("notice", "full"), ("full",)))
    rows = keyed(files, text, doc_id, path=path).withColumn("path", F.col("path").cast("string"))
    tokens = lambda x: F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0))
    # The known tokens of the whole text decide what of it is looked at: no token spans a line or a sentence.
    low = rows.withColumn("low", F.lower("text")).withColumn("whole", tokens(F.col("low")))
    low = low.withColumn("known", F.expr(f"array_intersect({_words(idf)}, whole)"))
    low = low.withColumn("has_lines", F.expr(_any("known", lines))).withColumn("has_blocks", F.expr(_any("known", blocks)))

    split = F.when(F.col("has_lines"), F.split("low", r"[\n\r]+")).otherwise(F.array().cast("array<string>"))
    # A line and its sentences of three tokens or more (fewer say little): the best counts for the line.
    parts = F.transform(split, lambda x: F.array_distinct(F.concat(F.array(x), F.split(x, r"(?<=[.;:!?])\s+"))))
    low = low.withColumn("lines", F.transform(parts, lambda ps: F.filter(F.transform(ps, tokens), lambda toks, i: (i == 0) | (F.size(toks) > 2))))
    low = low.withColumn("hits", F.expr(f"transform(filter(transform(lines, ps -> flatten(transform(ps, toks -> {_hits('toks', lines, idf, unknown)}))), hs -> size(hs) > 0), hs -> array_sort(hs, {_BEST})[0])"))

    paragraphs = F.split("low", r"(?:\r\n?+|\n)[^a-z0-9\r\n]*+(?:\r\n?+|\n)")
    all_lines = F.split("low", r"\r\n?|\n")
    heads = [F.when(F.size(all_lines) > n, F.array_join(F.slice(all_lines, 1, n), "\n")) for n in (4, 8, 16, 32)]
    units = F.filter(F.array_distinct(F.concat(paragraphs, F.array(*heads))), lambda x: x.isNotNull())
    low = low.withColumn("units", F.when(F.col("has_blocks"), F.transform(units, tokens)).otherwise(F.expr("cast(array() as array<array<string>>)")))
    low = low.withColumn("file_hits", F.when(F.col("has_blocks"), F.expr(_hits("whole", full, idf, unknown))).otherwise(F.expr(_NONE)))
    low = low.withColumn("block_hits", F.expr(f"flatten(transform(units, toks -> {_hits('toks', blocks, idf, unknown)}))"))
    low = low.withColumn("best", F.expr(f"array_sort(concat(hits, block_hits, file_hits), {_BEST})"))
    share = F.expr("size(hits)") * 2 > F.expr("size(filter(split(low, r'[\\n\\r]+'), x -> length(trim(x)) > 0))")
    named = F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).rlike(r"^(?:licen[sc]e|copying|unlicense)(?:[.\-].*)?$")
    hit = F.size("best") > 0
    return low.select(
        "doc_id", DID, THASH, "path",
        F.when(hit, F.col("best")[0]["name"]).alias("licence"), F.when(hit, F.col("best")[0]["score"]).alias("score"),
        F.size("hits").cast("long").alias("n_lines"), (hit & (named | share | (F.size("file_hits") > 0))).alias("is_file"),
    )


_UP = r"/[^/]*$"


def licences(files: DataFrame, text: str = "text", path: str = "path", doc_id: str = "doc_id", templates=None) -> DataFrame:
    """One row per file row: doc_id, path, own_licence, score, n_lines, is_file, licence, inherited_from.

    licence is the file's own, else that of the nearest ancestor directory with a licence file (the best
    score there, ties to the smaller name), else null. A null text counts as empty; a null path has no
    directory and neither gives nor inherits. Repeated rows each keep their row.
    """
    own = written(own_licences(files, text, path, doc_id, templates), "licences")  # three uses, one pass over the texts
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", _UP, "")).otherwise(F.lit(""))
    given = own.where("is_file and path is not null").select(folder.alias("dir"), "licence", "score")
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("m")).select(F.col("dir").alias("g_dir"), F.col("m.licence").alias("g_licence"))
    ask = own.where("licence is null and path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    climbs = ask.select("dir", F.explode(F.array_distinct(ups)).alias("up"))
    near = climbs.join(given, F.col("up") == F.col("g_dir")).groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "g_licence")).alias("m"))
    # A directory may hold a third of all files: its row is dealt to SALTS tasks.
    near = near.select(F.col("dir").alias("n_dir"), F.col("m.up").alias("from_dir"), F.col("m.g_licence").alias("from_licence"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("n_salt"))
    rows = own.withColumn("dir", F.when(F.col("licence").isNull(), folder)).withColumn("salt", F.pmod(F.xxhash64(DID, THASH), F.lit(SALTS)).cast("int"))
    rows = rows.join(near, (F.col("dir") == F.col("n_dir")) & (F.col("salt") == F.col("n_salt")), "left")
    return rows.select(
        "doc_id", "path", F.col("licence").alias("own_licence"), "score", "n_lines", "is_file",
        F.coalesce("licence", "from_licence").alias("licence"), F.col("from_dir").alias("inherited_from"),
    )
