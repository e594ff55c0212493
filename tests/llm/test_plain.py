"""Queries without SQL against plain Python: licence scan, quotation linking, the pipeline's documents."""

import math
import random
import re
import time
from collections import Counter

import corpus_pipeline
from curbmeter.llm import licenses, quotations
from curbmeter.llm.queries import document_paths
from curbmeter.llm.shared import table
from tests.llm.test_texts import classes, contaminated


def words(text):
    return re.findall(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*", text.lower())


# What stands at the top of real files, with the licence that it means.
HEADERS = (
    ("MIT", "// SPDX-License-Identifier: MIT\nint main() {}\n"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport os\n"),
    ("GPL-3.0", "/* SPDX-License-Identifier: GPL-3.0-or-later */\n"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\n"),
    ("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0\n"),
    ("(MIT OR BSD-3-Clause) AND ISC", "// SPDX-License-Identifier: (MIT OR BSD-3-Clause) AND ISC\n"),
    ("LGPL-2.1", "<!-- SPDX-License-Identifier: LGPL-2.1+ -->\n"),
    ("MIT", "It is licensed under the MIT license. See LICENSE."),
    ("GPL-2.0", "/*\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */\n"),
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"),
    ("LGPL-3.0", "// This library is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Lesser General Public License as\n// published by the Free Software Foundation, either version 3 of the\n// License, or (at your option) any later version.\n"),
    ("Apache-2.0", "# Copyright 2020 Example Authors\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"),
    ("BSD-3-Clause", "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are\n// met:\n"),
    ("ISC", " * Permission to use, copy, modify, and distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n"),
    ("Unlicense", "-- This is free and unencumbered software released into the\n-- public domain.\n"),
    ("CC0-1.0", "% To the extent possible under law, the author has waived all copyright and\n% related rights; CC0 1.0 Universal public domain dedication.\n"),
    ("MIT", ";; Permission is hereby granted, free of charge, to any person obtaining\n;; a copy of this software and associated documentation files (the\n;; \"Software\"), to deal in the Software without restriction\n"),
    (None, "Copyright 2020 Example Authors. All rights reserved.\nint x;\n"),
    (None, "We talked about a fishing licence all day and redistributed the bait.\n"),
)


def plain_spdx(text):
    """``(cosine, name)`` of every identifier line that is followed by an expression."""
    for line in text.splitlines():
        at = line.lower().find("spdx-license-identifier:")
        if at < 0:
            continue
        tokens, wanted = [], True
        for token in line[at:].split(":", 1)[1].split():
            if wanted == (token.lower() in ("and", "or", "with")) or wanted and not re.fullmatch(r"\(*[A-Za-z0-9.+-]+\)*", token):
                break
            if not wanted and token.lower() not in ("and", "or", "with"):
                break
            tokens.append(token)
            wanted = not wanted
        if tokens and tokens[-1].lower() in ("and", "or", "with"):
            tokens.pop()
        for i in range(len(tokens) - 2, 0, -2):
            if tokens[i].lower() == "with":
                del tokens[i : i + 2]
        tokens = [re.sub(r"(-only|-or-later|\+)(\)*)$", r"\2", t) for t in tokens]
        if tokens:
            yield (-1.0, " ".join(tokens) if len(tokens) > 1 else tokens[0].strip("()"))


def plain_licenses(files, templates):
    marker = re.compile("licen[cs]e|copyright|permission|redistribut|public domain|creative commons|spdx|free software", re.I)
    holder = re.compile(r"(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$", re.I)
    short = [(name, words(t)) for name, t, form in templates if form == "line"]
    df = Counter(w for _, ws in short for w in set(ws))
    anchors = {}
    for _, ws in short:
        for w in sorted(set(ws), key=lambda w: (df[w], ws.index(w)))[:2]:
            anchors.setdefault(w, set()).add((ws.index(w), len(ws)))

    def vector(ws, logs=False):
        v = {w: (1 + math.log(n) if logs else n) * (math.log((1 + len(short)) / (1 + df[w])) + 1) for w, n in Counter(ws).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    known = [(name, vector(ws)) for name, ws in short]
    full = [(name, vector(words(t), True)) for name, t, form in templates if form == "text"]

    def best(text, whole):
        if not (whole or marker.search(text)):
            return None
        found = list(plain_spdx(text))
        ws = words(text)
        passages = {tuple(words(x)) for x in re.split(r"\r\n|\n|\r", text) if marker.search(x)}
        passages |= {tuple(ws)} if whole else set()
        for i, w in enumerate(ws):
            passages |= {tuple(ws[max(0, i - offset) : i - offset + size]) for offset, size in anchors.get(w, ())}
        for passage in passages:
            v = vector(passage)
            cosines = [(sum(x * other.get(w, 0) for w, x in v.items()), name) for name, other in known]
            found += [(-round(c, 6), name) for c, name in cosines if c >= 0.6]
        if whole:
            v = vector(ws, True)
            cosines = [(sum(x * other.get(w, 0) for w, x in v.items()), name) for name, other in full]
            found += [(-round(c, 6), name) for c, name in cosines if c >= 0.9]
        return min(found, default=None)

    own = [best(text or "", bool(holder.search(path))) for path, text in files]
    granted = {}
    for (path, _), b in zip(files, own):
        if b and holder.search(path):
            folder = path.rpartition("/")[0]
            granted[folder] = min(granted.get(folder, b), b)
    out = []
    for (path, _), b in zip(files, own):
        folder = path.rpartition("/")[0]
        while not b and folder and folder not in granted:
            folder = folder.rpartition("/")[0]
        if b:
            out.append((path, b[1], -b[0], "own", None))
        elif folder in granted:
            out.append((path, granted[folder][1], -granted[folder][0], "inherited", folder))
        else:
            out.append((path, None, None, None, None))
    return out


def test_licenses_are_those_of_plain_python(spark, sf_dir):
    docs = document_paths(table(spark, sf_dir, "documents")).where("length(text) < 4000").select("path", "text")
    rows = [tuple(r) for r in docs.collect()]
    prose = "Some notes. " * 30
    rows += [(f"k/{n}/COPYING", prose + "\n" + t[:50] + "\n" + t[50:] + prose) for n, t in licenses.TITLES[:8] + licenses.TEMPLATES[:4]]
    rows += [(f"h/{i}.c", text) for i, (_, text) in enumerate(HEADERS)]
    rows += [("k/MIT/x/y.txt", "nothing"), ("k/z.txt", None), ("m/LICENSE", prose), ("m/n/NOTICE", "Licensed under CC BY 4.0.")]
    templates = licenses.templates_frame(spark)
    got = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string"), templates)
    got = [tuple(r) for r in got.select("path", "license", "cosine", "origin", "license_dir").collect()]
    want = plain_licenses(rows, [(r["license"], r["text"], r["form"]) for r in templates.collect()])
    assert sum(w[3] == "inherited" for w in want) > 0
    flat = lambda x: sorted([(p, n, o, d) for p, n, _, o, d in x], key=str)
    assert flat(got) == flat(want)
    assert all(abs((a[2] or 0) - (b[2] or 0)) < 2e-6 for a, b in zip(sorted(got, key=str), sorted(want, key=str)))


def test_headers_of_real_files(spark):
    code = "int f(int a) { return a + 1; }\n" * 50
    rows = [(f"src/{i}.c", text + code) for i, (_, text) in enumerate(HEADERS)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string"), licenses.templates_frame(spark))
    got = {r["path"]: r["license"] for r in got.collect()}
    assert [got[f"src/{i}.c"] for i in range(len(HEADERS))] == [name for name, _ in HEADERS]


def test_long_files_take_linear_time(spark):
    words_ = ["license" if i % 5 == 0 else f"word{i % 997}" for i in range(200_000)]
    rows = [("a/NOTICE", " ".join(words_)), ("b/x.txt", "mit apache " * 100_000), ("c/LICENSE", "license " * 250_000), ("c/y.c", "x")]
    start = time.time()
    got = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string"), licenses.templates_frame(spark)).collect()
    assert len(got) == 4 and time.time() - start < 60


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip()


def plain_parents(turns):
    """``turn: parent`` of one conversation, ``turns`` in order."""
    own, parents = {}, {}
    for turn, text in turns:
        runs = []
        for line in text.split("\n"):
            marks = re.match(r"(?:[ \t]*>)+", line)
            level = marks.group().count(">") if marks else 0
            line = re.sub(r"^(?:[ \t]*>)+ ?", "", line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        runs = [(level, "\n".join(x)) for level, x in runs]
        answers = [x for level, x in runs if level == 0]
        body = "\n".join(answers).strip(" ")
        mine = [body, *body.split("\n"), *answers]
        mine += [p for x in (body, *answers) for p in re.split(r"\n\s*\n", x)]
        links = []
        for level, text in runs:
            if level == 0 or not norm(text):
                continue

            def latest(needed):
                return max((t for t in own if needed <= own[t]), default=None)

            para = {norm(x) for x in re.split(r"\n\s*\n", text)} - {""}
            line = {norm(x) for x in text.split("\n")} - {""}
            length, found = len(norm(text)), latest({norm(text)})
            for some in (para, line):
                found = latest(some) if found is None else found
            for some in (para, line):
                if found is None:
                    length, found = max(((len(x), latest({x})) for x in some if latest({x}) is not None), default=(0, None))
            if found is not None:
                links.append((-level, length, found))
        parents[turn] = max(links)[2] if links else None
        own[turn] = {norm(x) for x in mine} - {""}
    return parents


def test_parents_are_those_of_plain_python(spark):
    rng, rows = random.Random(5), []
    for conv in range(12):
        texts = []
        for turn in range(14):
            lines = []
            for _ in range(rng.randint(0, 3) if texts else 0):
                source = rng.choice(texts).split("\n")
                a = rng.randrange(len(source))
                part = source[a : a + rng.randint(1, 6)]
                lines += ["> " + x for x in part if rng.random() < 0.85]
                lines += [rng.choice(["Ja.", "Line a b", f"own {conv} {turn}", ""])] * rng.randint(0, 1)
            lines += [f"{rng.choice('abcd')} line {rng.randint(0, 30)}" if rng.random() < 0.75 else "" for _ in range(rng.randint(1, 6))]
            texts.append("\n".join(lines))
            rows.append((conv, turn * 700, "user", texts[-1]))
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotations.conversations_by_reply(messages).collect()}
    want = {(c, t): p for c in range(12) for t, p in plain_parents([(r[1], r[3]) for r in rows if r[0] == c]).items()}
    assert got == want and sum(p is not None for p in want.values()) > 50


def test_pipeline_keeps_the_documents_of_brute_force(spark, sf_dir):
    scored = corpus_pipeline.quality(spark, table(spark, sf_dir, "documents"), sf_dir)
    rows = [tuple(r) for r in scored.select("doc_id", "text").collect()]
    first = {c for _, c, _ in classes(rows)}
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    want = {r[0] for r in contaminated([r for r in rows if r[0] in first], items) if not r[-1]}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    assert got == want and 0 < len(want) < len(rows)
