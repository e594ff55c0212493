"""Licences of files: TF-IDF cosine to templates, then the nearest directory above.

A file's passages are its lines that name a licence, and the words around the
rarest words of each template: every such word proposes the run of words in
which it has the place that it has in the template. Line breaks and comment
marks are no words, so a wrapped header is one passage, and a text has at most
two passages per template and word. Passages and templates are sparse TF-IDF
vectors, and a file takes the template of the largest cosine if that is large
enough. An SPDX identifier is read as such and counts as a cosine of 1. Files
named ``LICENSE``, ``COPYING`` or ``NOTICE`` are compared as a whole as well,
also with full licence texts. A file without a licence of its own inherits that
of the licence file in the nearest directory above it. All of it is DataFrame
work.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbmeter.llm.shared import free_name, store
from curbmeter.session import broadcast_if_small

# Names of licences and wording by which they are known.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal public domain dedication."),
)
# Titles of full texts, and headers that differ in few words.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)
# Licences whose full texts lie in ``license_texts``.
TEXTS = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
# What a line must hold to be looked at; the lines of every template do.
MARKER = r"(?i)licen[cs]e|copyright|permission|redistribut|public domain|creative commons|spdx|free software"
# An SPDX expression: identifiers, joined by AND, OR and WITH.
_ID = r"\(*[A-Za-z0-9.+-]+\)*"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
# Of each template so many of its rarest words propose passages.
ANCHORS = 2
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$"
LEAST_COSINE = 0.6
# Long texts share their common words: with logarithms of counts, other licences reach 0.89 of a full text.
LEAST_TEXT_COSINE = 0.9


def templates_frame(spark: SparkSession, templates=TEMPLATES + TITLES, texts=TEXTS) -> DataFrame:
    """``template, license, text, form``; the form is ``line`` for passages, or ``text`` for whole licence files."""
    full = [(n, pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode(), "text") for n in texts]
    rows = [(n, t, "line") for n, t in templates] + full
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], "template int, license string, text string, form string"
    )


def _terms(text):
    """Words, and numbers with their dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[0-9]+(?:\.[0-9]+)*)"), F.lit(1))


def _vectors(passages: DataFrame, keys: list[str], idf: DataFrame, unknown, logs: bool = False) -> DataFrame:
    """``keys, term, weight`` with vectors of length 1; ``logs`` takes 1 + log of a term's count."""
    terms = passages.select(*keys, F.explode(_terms(F.col("text"))).alias("term")).groupBy(*keys, "term")
    count = F.count(F.lit(1))
    weighed = terms.agg((1 + F.log(count) if logs else count).alias("tf")).join(broadcast_if_small(idf), "term", "left")
    weighed = weighed.withColumn("weight", F.col("tf") * F.coalesce("idf", unknown))
    lengths = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return weighed.join(lengths, keys).select(*keys, "term", (F.col("weight") / F.col("length")).alias("weight"))


def _anchors(short: DataFrame) -> DataFrame:
    """One row with a map from a word to the ``(offset, size)`` of the templates that have it as one of their rarest."""
    placed = short.select("template", F.size(_terms(F.col("text"))).alias("size"), F.posexplode(_terms(F.col("text"))).alias("offset", "term"))
    first = placed.groupBy("template", "size", "term").agg(F.min("offset").alias("offset"))
    common = first.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("template").orderBy("df", "offset"))
    chosen = first.join(broadcast_if_small(common), "term").withColumn("n", rarest).where(F.col("n") <= ANCHORS)
    places = chosen.groupBy("term").agg(F.collect_set(F.struct("offset", "size")).alias("places"))
    return places.agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("anchors"))


def _runs(files: DataFrame, short: DataFrame) -> DataFrame:
    """``key, whole, text``: the runs of words that the rarest words of the templates propose, cut at the text's ends."""
    words = store(files.select("key", "whole", _terms(F.col("text")).alias("terms")), "words")
    words = words.crossJoin(F.broadcast(store(_anchors(short), "anchors")))  # one row
    here = F.transform("terms", lambda t, i: F.struct(i.alias("at"), F.try_element_at(F.col("anchors"), t).alias("places")))
    hits = F.filter(here, lambda h: h["places"].isNotNull())
    starts = F.flatten(
        F.transform(hits, lambda h: F.transform(h["places"], lambda p: F.struct((h["at"] - p["offset"]).alias("start"), p["size"].alias("size"))))
    )
    # The starts are an attribute of their own, so that they are worked out once.
    words = store(words.select("key", "whole", "terms", F.array_distinct(starts).alias("starts")).where(F.size("starts") > 0), "starts")
    last = F.size("terms") - 1

    def run(s):
        # Words are picked one by one: a slice copies the whole array.
        at = F.sequence(F.greatest(s["start"], F.lit(0)), F.least(s["start"] + s["size"] - 1, last))
        return F.array_join(F.transform(at, lambda i: F.get("terms", i)), " ")

    return words.select("key", "whole", F.explode(F.array_distinct(F.transform("starts", run))).alias("text"))


def spdx_licenses(text):
    """The SPDX expressions of a text, without exceptions and without ``-only``, ``-or-later`` and ``+``."""

    def plain(e):
        e = F.regexp_replace(e, r"(?i)[ \t]+WITH[ \t]+[^ \t()]+", "")
        e = F.regexp_replace(e, r"(?i)(-only|-or-later|\+)(?=[ \t)]|$)", "")
        e = F.regexp_replace(F.regexp_replace(e, r"[ \t]+", " "), r"(?i) (and|or) ", " $1 ")
        single = ~F.contains(e, F.lit(" "))
        return F.when(single, F.translate(e, "()", "")).otherwise(e)

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), plain))


def own_licenses(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``key, whole, license, cosine`` for texts with a licence, from ``key, whole, text``; one row per key and form."""
    if "form" not in templates.columns:
        templates = templates.withColumn("form", F.lit("line"))
    templates = store(templates, "templates")
    short, full = templates.where("form = 'line'"), templates.where("form = 'text'")
    n = short.count()
    documents = short.select("template", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    counted = documents.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = store(counted.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    unknown = F.log(F.lit(1.0 + n)) + 1
    known = store(_vectors(short, ["template"], idf, unknown), "known")
    names = broadcast_if_small(templates.select("template", "license"))
    lines = F.filter(F.split("text", "\r\n|\n|\r"), lambda line: line.rlike(MARKER))
    lines = F.when(F.col("whole"), F.concat(F.array("text"), lines)).otherwise(lines)
    # The same line of many files is one passage.
    passages = files.select("key", "whole", F.explode(F.array_distinct(lines)).alias("text")).unionByName(_runs(files, short))
    passages = store(passages.select("*", F.xxhash64("text").alias("passage")).distinct(), "passages")
    texts = passages.groupBy("passage").agg(F.first("text").alias("text"))
    vectors = _vectors(texts, ["passage"], idf, unknown)

    def products(of: DataFrame, key: str, templates: DataFrame, least: float) -> DataFrame:
        pairs = of.join(broadcast_if_small(templates.withColumnRenamed("weight", "other")), "term").groupBy(key, "template")
        cosines = pairs.agg(F.sum(F.col("weight") * F.col("other")).alias("cosine")).where(F.col("cosine") >= least)
        # The largest cosine, then the smaller name; six digits settle the order of summation.
        named = cosines.join(names, "template")
        return named.groupBy(key).agg(F.min(F.struct((-F.round("cosine", 6)).alias("minus"), "license")).alias("best"))

    of_passage = store(products(vectors, "passage", known, least), "best")
    chosen = passages.select("key", "whole", "passage").join(broadcast_if_small(of_passage), "passage").select("key", "whole", "best")
    known_texts = store(_vectors(full, ["template"], idf, unknown, True), "known_texts")
    whole = _vectors(files.where("whole").select("key", "text"), ["key"], idf, unknown, True)
    of_text = products(whole, "key", known_texts, max(least, LEAST_TEXT_COSINE))
    of_text = of_text.select("key", F.lit(True).alias("whole"), "best")
    stated = files.select("key", "whole", F.explode(spdx_licenses(F.col("text"))).alias("license"))
    stated = stated.select("key", "whole", F.struct(F.lit(-1.0).alias("minus"), "license").alias("best"))
    every = chosen.unionByName(of_text).unionByName(stated)
    return every.groupBy("key", "whole").agg(F.min("best").alias("best")).select(
        "key", "whole", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine")
    )


def directory(path):
    """The directory of a path, '' for the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licenses(
    files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST_COSINE
) -> DataFrame:
    """``files``, all columns, with ``license, cosine, origin, license_dir``.

    ``origin`` is ``own``, ``inherited`` (then ``license_dir`` is the directory
    whose licence file gave it) or null. Of several licence files in one
    directory the largest cosine holds, then the smaller name. Null texts have
    no licence of their own, null paths inherit none. Repeated rows are scanned
    alike; an empty table stays empty; without templates nothing is found.
    Columns of ``files`` named like a new one keep the name, and the new one
    gets an underscore.
    """
    names = {w: free_name(files, w) for w in ("license", "cosine", "origin", "license_dir", "key", "whole", "dir")}
    key, whole, folder = names["key"], names["whole"], names["dir"]
    path, text = F.col(path_col), F.coalesce(F.col(text_col), F.lit(""))
    keyed = files.withColumns(
        {
            key: F.xxhash64(text),
            whole: F.coalesce(path.rlike(LICENSE_FILE), F.lit(False)),
            folder: directory(path),
        }
    )
    marked = (
        files.select(F.xxhash64(text).alias("key"), F.coalesce(path.rlike(LICENSE_FILE), F.lit(False)).alias("whole"), text.alias("text"))
        .where(F.col("whole") | F.col("text").rlike(MARKER))
        .groupBy("key", "whole")
        .agg(F.first("text").alias("text"))
    )
    # Lines, runs and identifiers are looked for in it; whole texts are read for it once.
    marked = store(marked, "marked")
    own = store(own_licenses(marked, templates, least), "own")
    mine = broadcast_if_small(
        own.select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("license").alias("_license"), F.col("cosine").alias("_cosine"))
    )
    found = keyed.join(mine, [key, whole], "left")

    holders = files.select(directory(path).alias("dir"), F.xxhash64(text).alias("key"), path.alias("path")).where(
        F.col("path").rlike(LICENSE_FILE)
    )
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best")
    granted = holders.join(own.where("whole").drop("whole"), "key").groupBy("dir").agg(best)
    granted = store(granted.select("dir", "best"), "granted")
    # Each directory once, with itself and all directories above it.
    folders = files.select(directory(path).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    levels = folders.select("dir", F.posexplode(above).alias("depth", "above"))
    near = levels.join(broadcast_if_small(granted.withColumnRenamed("dir", "above")), "above").groupBy("dir")
    near = near.agg(F.max_by(F.struct("above", "best"), "depth").alias("near"))
    inherited = store(
        near.select(F.col("dir").alias(folder), F.col("near.above").alias("_above"), F.col("near.best.license").alias("_theirs"), (-F.col("near.best.minus")).alias("_their_cosine")),
        "inherited",
    )
    found = found.join(broadcast_if_small(inherited), folder, "left")
    has = F.col("_license").isNotNull()
    return found.withColumns(
        {
            names["license"]: F.coalesce("_license", "_theirs"),
            names["cosine"]: F.coalesce("_cosine", "_their_cosine"),
            names["origin"]: F.when(has, "own").when(F.col("_theirs").isNotNull(), "inherited"),
            names["license_dir"]: F.when(~has, F.col("_above")),
        }
    ).drop("_license", "_cosine", "_theirs", "_their_cosine", "_above", key, whole, folder)
