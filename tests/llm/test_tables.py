"""Neighbours, shards, URLs, archives, replies and licences against brute force, and the registered queries."""

import gzip
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences, duckdb_tables
from curbmeter.llm import forest, licenses, quotations, sharding, shared, url_rules, warc
from curbmeter.llm.oracle import ORACLE
from curbmeter.llm.queries import QUERIES
from curbmeter.llm.shared import table


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), duckdb_tables(sf_dir), ORACLE[name]) == ""


def test_neighbours_reach_the_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = forest.nearest(vectors, vectors.where("vec_id % 20 = 0"), candidates=512, shard=1024).collect()
    data = vectors.collect()
    ids, v = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], float)
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q, got in found.items():
        products = v @ v[ids == q][0]
        products[ids == q] = -9
        hits += len(set(ids[np.argsort(-products)[:20]]) & set(got))
    assert len(found) == 100 and hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("lengths", ["outlier", "lognormal"])
def test_recall_for_mixed_lengths_at_production_settings(spark, lengths):
    random = np.random.default_rng(3)
    v = random.normal(size=(12_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v *= random.lognormal(0, 0.2, len(v))[:, None] if lengths == "lognormal" else 1
    v[7] *= 3
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = forest.nearest(vectors, vectors.where("vec_id % 200 = 0")).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        products = v @ v[q]
        products[q] = -99
        hits += len(set(np.argsort(-products)[:20].tolist()) & got)
    assert len(found) == 60 and hits >= 0.9 * 20 * 60, hits / 1200


def test_candidates_are_different_rows():
    random = np.random.default_rng(4)
    v = random.normal(size=(1500, 16))
    found = list(forest.Forest(v, np.linalg.norm(v, axis=1).max()).candidates(v[:40], 700))
    assert all(700 <= len(set(rows.tolist())) == len(rows) for rows in found)


def test_shards_are_of_one_band_or_searched_whole():
    plan = forest.shard_plan({-3: 1, 0: 9000, 1: 30, 2: 2000, 5: 2040, 9: 8, 10: 5000}, 4096, 2048)
    assert plan == [(-3, 0, 1), (0, 1, 3), (1, 4, 1), (2, 4, 1), (5, 5, 1), (9, 5, 1), (10, 6, 2)]


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [math.nan, 1.0]), (100, [1.0]), (5, [3.0, -1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0]), (7, [None, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = forest.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 6, 5.0), (0, 2, 20, 5.0), (0, 3, 5, 1.0), (20, 1, 0, 5.0), (20, 2, 6, 5.0), (20, 3, 5, 1.0)]
    assert forest.nearest(vectors.limit(0), vectors).count() == 0


def test_many_copies_do_not_hide_neighbours(spark):
    rows = [(i, [1.0, 0.0]) for i in range(500)] + [(1000 + i, [1.0, 0.001 * i]) for i in range(1, 30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(vectors, vectors.where("vec_id = 1029"), k=40).collect()
    assert len(got) == 40 and got[0]["vec_id"] == 1028


@pytest.mark.parametrize("limit", [1 << 20, 50_000])
def test_shards_split_only_where_needed(spark, limit):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("shard", F.lit(9))
    rows = sharding.assign_shards(docs, limit).select("doc_id", "shard_", "n_bytes", "shard_bytes").collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r["shard_"]] = sizes.get(r["shard_"], 0) + r["n_bytes"]
    parents = {}
    for r in rows:
        bits = bin(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(r["shard_"]) and r["shard_bytes"] == sizes[r["shard_"]] <= limit
        for n in range(len(r["shard_"])):
            parents[bits[:n]] = parents.get(bits[:n], 0) + r["n_bytes"]
    assert all(size > limit for size in parents.values())


def test_one_repeated_id_is_split_as_well(spark):
    same = table(spark, "/root/testdata/sf0.001", "documents").limit(20).withColumn("doc_id", F.lit(5))
    rows = sharding.assign_shards(same.union(same), 8000).groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 40 and all(r["b"] <= 8000 or r["n"] == 1 for r in rows)
    assert sharding.assign_shards(same.limit(0)).count() == 0


def test_two_repeated_ids_split_each_by_its_own_size(spark):
    texts = [(i, f"{i} text {n} " + "x" * 900) for i in (5, 6, 7) for n in range(20)] + [(i, "y" * 300) for i in range(100, 130)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.assign_shards(docs, 8000).collect()
    sizes, ids, parents = {}, {}, {}
    for r in rows:
        bits = "".join(
            bin(int(hashlib.md5(x.encode()).hexdigest()[:15], 16))[2:].zfill(60)
            for x in (str(r["doc_id"]), f"{r['doc_id']} {hashlib.md5(r['text'].encode()).hexdigest()}")
        )
        assert bits.startswith(r["shard"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
        ids.setdefault(r["shard"], set()).add(r["doc_id"])
        for n in range(len(r["shard"])):
            parents[bits[:n]] = parents.get(bits[:n], 0) + r["n_bytes"]
    assert len(rows) == 90 and all(r["shard_bytes"] == sizes[r["shard"]] <= 8000 for r in rows)
    assert all(size > 8000 for size in parents.values())
    assert all(len(ids[s]) == 1 for s in ids if len(s) > 60)


@pytest.mark.parametrize("map_rules", [256, -1])
def test_urls(spark, map_rules):
    urls = [(None, None), (1, "x"), (1, "HTTP://A.Example.ORG/es/?x"), (2, "a://org"), (3, "a://my-org/x"), (4, "a://example.org/en/19\n#x"), (5, "://x.com/de/"), (6, "b://com/fr/a"), (7, "b://net/fr/a")]
    rules = spark.createDataFrame(list(url_rules.RULES), "rule string, verdict string")
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit(1))
    got = url_rules.judge_urls(pages, rules, map_rules=map_rules).select("page_id", "rule", "verdict").collect()
    want = [(None, None, "allow"), (1, None, "allow"), (1, "example.org/es/", "block"), (2, None, "allow"), (3, None, "allow"), (4, "example.org/en/1", "block"), (5, "com/de/", "block"), (6, "com/fr/", "allow"), (7, None, "allow")]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.limit(0), map_rules=map_rules).collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), rules, map_rules=map_rules).count() == 0


def test_archives_round_trip_and_skip(spark, tmp_path):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", big), (2, None, big), (2, "u", big), (3, "http://c/", "<p>"), (4, "http://d/", "<p>"), (None, "n", None), (None, "m", big)], "page_id long, url string, html string")
    got = warc.round_trip(pages.withColumn("digest", F.lit(1))).collect()
    sha = hashlib.sha1(big.encode()).hexdigest()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["payload_digest"] == sha)
    assert kinds == [("1", "revisit", 2, 1200), ("2", "response", None, 1200), ("2", "response", None, 1200), ("None", "revisit", 2, 1200)]
    assert sum(r["record_type"] == "response" for r in got) == 5
    path = str(tmp_path / "w")
    warc.write_pages(pages.coalesce(1), path)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    plain = tmp_path / "p" / "x.warc"
    plain.parent.mkdir()
    plain.write_bytes(b"".join(gzip.decompress(f.read_bytes()) for f in files))
    others = tmp_path / "g" / "x.warc.gz"
    others.parent.mkdir()
    record = plain.read_bytes().split(b"WARC/1.1")[1:]
    others.write_bytes(b"".join(gzip.compress(b"WARC/1.1" + r) for r in record))
    want = sorted(str(r) for r in warc.read_warc(spark, path).collect())
    assert len(want) == 8
    for folder in ("p", "g"):
        assert sorted(str(r) for r in warc.read_warc(spark, str(tmp_path / folder)).collect()) == want
    few = warc.read_warc(spark, path, payload=False).where("record_type = 'response' and target_uri like 'http%'")
    assert " Filter (" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["target_uri"] for r in few.collect()) == ["http://c/", "http://d/"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_replies(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "a", "> Hello there.\n> How are you?\nfine\n\nthanks a lot"), (1, 2, "user", "> > How   are you?\n> FINE\n> \n> thanks a lot\nok"), (1, 3, "b", ">> fine\n>thanks a lot\nwell"), (1, 4, None, None), (1, 5, "z", "> nothing known\nhi"), (None, None, None, "> Hello there."), (1, 9000, "q", "> ok\n> \nyes"), (2, 1, "x", "> ok")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1))
    got = {(r["conv_id"], r["turn"]): (r["body"], r["parent_turn"], r["thread_turn"], r["depth"]) for r in quotations.conversations_by_reply(messages).collect()}
    assert got == {(1, 0): ("Hello there.\nHow are you?", None, 0, 0), (1, 1): ("fine\n\nthanks a lot", 0, 0, 1), (1, 2): ("ok", 1, 0, 2), (1, 3): ("well", 1, 0, 2), (1, 4): ("", None, 4, 0), (1, 5): ("hi", None, 5, 0), (None, None): ("", None, None, 0), (1, 9000): ("yes", 2, 0, 3), (2, 1): ("", None, 1, 0)}
    assert quotations.conversations_by_reply(messages.limit(0)).count() == 0


def test_replies_to_excerpts(spark):
    rows = [
        (1, 0, "One line.\nTwo lines.\nThree lines."),
        (1, 1, "First part\nof it.\n\nSecond part.\n\nThird part."),
        (1, 2, "> One line.\nanswer a1\n> Two lines.\nanswer a2\nand more\n\nlast words"),
        (1, 3, "Two lines."),
        (1, 4, "> One line.\n> Two lines.\nyes"),  # two lines of three: 0 has both, 3 only one
        (1, 5, "> First part\n> of it.\n> \n> Third part.\nno"),  # two paragraphs of three
        (1, 6, "> > One line.\n> answer a1\n> > Two lines.\n> answer a2\n> and more\n> \n> last words\nhm"),  # inline answers in full
        (1, 7, "> answer a2\n> and more\nok"),
        (1, 8, "> something else\n> Third part.\n> no\nwell"),  # the longest line that is known
        (1, 9, "> no such\n> lines\nwell"),
        (2, 1, "> One line.\n> Two lines."),
    ]
    messages = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotations.conversations_by_reply(messages).collect()}
    want = [None, None, 0, None, 0, 1, 2, 2, 1, None]
    assert got == {(2, 1): None} | {(1, t): parent for t, parent in enumerate(want)}


def test_licenses(spark):
    rows = [("a/b/c.txt", "hello\nReleased under the MIT License.\n"), ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/d.txt", None), ("a/x/y/z.py", "nothing"), ("q.txt", "none here, a licence"), (None, "Licensed under CC BY-NC 4.0."), ("a/x/COPYING", "random words only")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit(1))
    got = {r["path"]: (r["license_"], r["origin"], r["license_dir"]) for r in licenses.scan_licenses(files, licenses.templates_frame(spark)).collect()}
    theirs = ("Apache-2.0", "inherited", "a")
    assert got == {"a/b/c.txt": ("MIT", "own", None), "a/LICENSE": ("Apache-2.0", "own", None), "a/b/d.txt": theirs, "a/x/y/z.py": theirs, "q.txt": (None, None, None), None: ("CC-BY-NC-4.0", "own", None), "a/x/COPYING": theirs}
    assert licenses.scan_licenses(files.limit(0), licenses.templates_frame(spark)).count() == 0


def test_full_license_texts(spark):
    def full(name):
        with open(os.path.join(os.path.dirname(licenses.__file__), "license_texts", name + ".txt")) as file:
            return file.read()

    prose = "Notes of the maintainers about nothing in particular. " * 60
    rows = [(n + "/LICENSE", full(n).replace("<year>", "2021").replace("<copyright holders>", "Ada Example and others")) for n in licenses.TEXTS]
    apache = "you may not use this file except\nin compliance with the License. You may obtain a copy of the License\nat http://www.apache.org/licenses/LICENSE-2.0\n"
    rows += [("p/NOTICE", prose + apache + prose), ("l/COPYING", prose + "\nLicensed under CC BY-NC 4.0.\n" + prose), ("none/LICENSE", prose)]
    rows += [("sa/LICENSE", "Creative Commons\nAttribution-ShareAlike 4.0 International Public License\n\n" + prose), ("sa/b/c.txt", "")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(files, licenses.templates_frame(spark)).collect()}
    assert {p: got[p] for p in got if p.split("/")[0] in licenses.TEXTS} == {n + "/LICENSE": (n, "own") for n in licenses.TEXTS}
    assert got["p/NOTICE"] == ("Apache-2.0", "own") and got["l/COPYING"] == ("CC-BY-NC-4.0", "own") and got["none/LICENSE"] == (None, None)
    assert got["sa/LICENSE"] == ("CC-BY-SA-4.0", "own") and got["sa/b/c.txt"] == ("CC-BY-SA-4.0", "inherited")


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert 0 < docs.count() < 200
    assert corpus_pipeline.run(spark, sf_dir).select(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_shards_read_the_texts_twice(spark, monkeypatch):
    sources = []

    def store(df, name="table"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sources.append((name, plan.count("text#")))
        return shared.store(df, name)

    monkeypatch.setattr(sharding, "store", store)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.assign_shards(docs, 50_000)
    assert [name for name, _ in sources] == ["sizes", "sums", "directory"]
    assert all(n == 0 for name, n in sources if name != "sizes")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("text#") > 0


def test_shards_of_nulls_and_many_copies(spark):
    rows = [(None, None)] * 3 + [(None, "a b")] * 40 + [(7, "z" * 90)] * 30 + [(8, None)] * 5 + [(9, "q" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    got = sharding.assign_shards(docs, 100).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
    assert len(got) == len(rows) and sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, rows))
    assert all(r["shard_bytes"] == sizes[r["shard"]] for r in got)
    assert all(size <= 100 or name.startswith("own-") for name, size in sizes.items())
    assert sum(r["shard"].startswith("own-") for r in got) == 1


def test_urls_are_one_row_and_not_shuffled(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rules = spark.createDataFrame(list(url_rules.RULES), "rule string, verdict string")
    plan = url_rules.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_urls_by_300_000_rules(spark, monkeypatch):
    """Rules of one host each, some for all hosts of a domain, one that every URL fetches; the hot token is dealt to shares."""
    monkeypatch.setattr(url_rules, "SHARE", 500)
    n = 300_000
    host = F.concat(F.lit("h"), F.col("id"), F.lit(".example.com"))
    rules = spark.range(n).select(
        F.when(F.col("id") == 0, F.lit("com/")).when(F.col("id") == 1, F.lit("/pri")).otherwise(F.concat(host, F.lit("/a/"))).alias("rule"),
        F.when(F.col("id") % 2 == 0, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
    pages = spark.range(6000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s://www.h"), F.col("id"), F.lit(".example.com/a/x")))
        .when(F.col("id") % 3 == 1, F.lit("s://Else.com/q"))
        .otherwise(F.concat(F.lit("s://h"), F.col("id"), F.lit(".net/private"))).alias("url"),
    )
    rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()}
    want = {i: (f"h{i}.example.com/a/", "allow" if i % 2 else "block") if i % 3 == 0 else ("com/", "block") if i % 3 == 1 else ("/pri", "allow") for i in range(6000)}
    want[0] = ("com/", "block")
    assert rows == want
