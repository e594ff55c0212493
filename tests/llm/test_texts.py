"""Contamination, near duplicates, quality and packing against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curbmeter.llm import dart_minhash, decontaminate, packing, quality
from curbmeter.llm.shared import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contaminated(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((doc, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def test_contamination_is_that_of_brute_force(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    odd = spark.createDataFrame([(None, None), (7, ""), (7, "Und, THE!"), (None, "zz qq")], "doc_id long, text string")
    short = spark.createDataFrame([(1000, "The"), (1001, "und the"), (1002, None), (1003, "")], "item_id long, text string")
    docs, bench = docs.union(odd), bench.union(short)
    got = decontaminate.find_contamination(docs.withColumn("n_hit", F.lit(1)), bench).collect()
    want = contaminated([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = decontaminate.decontaminate(docs.withColumn("digest", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "digest"]
    assert kept.count() == sum(not r[-1] for r in want)


def test_contamination_of_empty_tables(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                above[max(top(i), top(j))] = min(top(i), top(j))
    out = {}
    for i, (doc, _) in enumerate(rows):
        out.setdefault(top(i), []).append(doc)
    return sorted(
        (doc, min(out[top(i)]), len(out[top(i)])) for i, (doc, _) in enumerate(rows)
    )


def test_near_duplicates_are_the_components_of_all_links(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A chain of edits: neighbours are close, ends are not.
    base = [f"w{i}" for i in range(120)]
    chain = [(10_000 + k, " ".join(base[: 115 - 2 * k] + [f"x{k}{i}" for i in range(5 + 2 * k)])) for k in range(8)]
    docs = docs.union(spark.createDataFrame(chain, docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    got = dart_minhash.near_duplicates(docs).select("doc_id", "class_id", "class_size").collect()
    assert sorted(tuple(r) for r in got) == classes(rows)
    kept = {r["doc_id"] for r in dart_minhash.drop_near_duplicates(docs).collect()}
    assert kept == {c for _, c, _ in classes(rows)}


def test_near_duplicates_of_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (2, text), (2, text), (None, text.upper()), (3, None), (4, ""), (5, "!!"), (None, None), (9, "x y"), (10, "X, y!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tk", F.lit(1)).withColumn("text_key", F.lit(2))
    got = dart_minhash.near_duplicates(docs).select("doc_id", "class_id", "class_size").collect()
    want = [(1, 1, 4), (2, 1, 4), (2, 1, 4), (None, 1, 4), (3, 3, 1), (4, 4, 1), (5, 5, 1), (None, None, 1), (9, 9, 2), (10, 9, 2)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    kept = dart_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "9", "None"]
    assert dart_minhash.drop_near_duplicates(docs.limit(0)).count() == 0
    once = spark.createDataFrame([(1, text, "p"), (1, text, "q")], "doc_id long, text string, extra string")
    assert dart_minhash.drop_near_duplicates(once).count() == 1


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(1, 2**63, 60).astype(np.uint64)])
    rows = np.repeat([0, 1], 300)
    s = dart_minhash.signatures(np.concatenate([a, b]), rows, 2, 4096)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.04


def test_quality_on_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    scored = quality.score_documents(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows) > 50


def test_quality_of_odd_rows(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, " \n", 1), (2, "a" * 50_000, 3)], "doc_id long, text string, score int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert {r["score"] for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(odd.limit(0), labels).count() == 0


def test_packing_is_an_exact_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    odd = spark.createDataFrame([(None, None), (5, ""), (5, ""), (6, "a <|endoftext|> b"), (7, "word " * 9000)], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(odd)
    exact = Tokenizer.from_file(packing.public_file("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], tuple([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 1]))] += 1
    rows = packing.pack(docs.withColumn("start", F.lit(0))).collect()
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    # Rows of one id are told apart by their tokens.
    for r in rows:
        documents.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
    tokens = Counter()
    for (doc, _), pieces in documents.items():
        for piece in pieces:
            tokens[doc] += len(piece[1])
    exact_tokens = Counter()
    for (doc, ids), n in want.items():
        exact_tokens[doc] += n * len(ids)
    assert tokens == exact_tokens
    single = {doc for (doc, _), n in want.items() if n == 1 and doc not in (None, 5)}
    for (doc, _), pieces in documents.items():
        if doc in single:
            assert want[(doc, tuple(i for _, ids in sorted(pieces) for i in ids))] == 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_differencing_evens_out_and_respects_the_capacity():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        lengths = [int(x) for x in rng.integers(1, 513, n)]
        windows = packing.deal(lengths, 2048)
        assert sorted(i for w in windows for i in w) == list(range(n))
        sums = [sum(lengths[i] for i in w) for w in windows]
        assert max(sums) <= 2048
    assert max(sums) - min(sums) <= 64


def test_long_documents_are_learned_whole(spark):
    words = [f"word{i}" for i in range(100 * quality.PASSAGE)]
    bags = quality._encoded_bags(pa.array([" ".join(words), "short"]))
    assert [len(b) // quality.N_FEATURES for b in bags.to_pylist()] == [100, 1]
    assert quality.whole_documents([(1, 5), (2, 100), (3, 4), (4, 2)], 10) == {1, 3}
    # Of the ids that are not held out, the long document is left out whole, or taken whole.
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, " ".join(words) if i == ids[0] else f"{'good text' if n % 2 else 'BAD!! 77'} {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    few, rest = quality.learn(docs, labels, passages=50), quality.learn(docs.where(F.col("doc_id") != ids[0]), labels.where(F.col("doc_id") != ids[0]))
    every = quality.learn(docs, labels)
    assert np.allclose(few.weights["shift"], rest.weights["shift"])
    assert not np.allclose(every.weights["shift"], rest.weights["shift"])
