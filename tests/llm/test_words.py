"""Periodic runs, spelling variants and perplexity rules against brute force, and their edge cases."""

import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import differences, duckdb_tables
from curbmeter.llm import periodic, perplexity, spelling
from curbmeter.llm.oracle import ORACLE
from curbmeter.llm.queries import QUERIES
from curbmeter.llm.shared import table


def plain_runs(words):
    """Every lag in turn; of the lags of one stretch the smallest."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(6, 4 * q):
                found.setdefault((first - q, i - first + q), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_runs_are_those_of_every_lag(letters):
    r = random.Random(letters)
    for _ in range(400):
        n = r.choice([0, 5, 6, 7, 20, 60, 250])
        words = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randrange(4)):
            start, period = r.randrange(n + 1), r.randrange(1, max(2, n // 5))
            for i in range(start + period, min(n, start + int(period * r.uniform(2, 9)))):
                words[i] = words[i - period]
        assert periodic.runs_of(periodic.word_numbers(words)) == plain_runs(words), words


def test_runs_of_strings_that_repeat_on_all_scales():
    fibonacci, following = [0], [0, 1]
    while len(following) < 1500:
        fibonacci, following = following, following + fibonacci
    thue_morse = [i.bit_count() % 2 for i in range(1500)]
    block = [r * r % 97 for r in range(150)]
    for words in (following, thue_morse, block * 9, (block[:40] * 5 + block) * 5):
        assert periodic.runs_of(periodic.word_numbers(words)) == plain_runs(words)


@pytest.mark.parametrize("words", [[7] * 300_000, [1, 2, 3] * 100_000, [i.bit_count() % 2 for i in range(200_000)]])
def test_repetitive_texts_take_no_quadratic_time(words):
    start = time.time()
    runs = periodic.runs_of(periodic.word_numbers(words))
    assert time.time() - start < 20
    assert runs in ([(0, 300_000, 1)], [(0, 300_000, 3)], [])


def test_run_columns_and_odd_rows(spark):
    rows = [
        (1, "a b c a b c\ta b c\na b c d", 0),
        (1, "a b c a b c\ta b c\na b c d", 0),
        (2, None, 0),
        (None, " \t\n", 0),
        (3, "x x x x x x y y y y y y", 0),
        (4, "no break x x x x x", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int")
    got = periodic.find_runs(docs).withColumn("best", periodic.longest_run()).withColumn("lines", periodic.written_runs())
    got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "collapsed", "lines", "best").collect()), key=str)
    abc = (1, 13, "a b c d", "0,12,3\n", (0, 12, 3))
    # Equal lengths: the smaller start.
    assert got == sorted(
        [abc, abc, (2, 0, "", "", None), (None, 0, "", "", None), (3, 12, "x y", "0,6,1\n6,6,1\n", (0, 6, 1)),
         (4, 5, "no break x x x x x", "", None)],
        key=str,
    )
    assert periodic.find_runs(docs.limit(0)).count() == 0


def plain_variants(counts, ratio=5):
    near = {w: set() for w in counts}
    for w in counts:
        for other in counts:
            short, long = sorted((w, other), key=len)
            if w != other and len(long) - len(short) <= 1:
                p = next((i for i, (a, b) in enumerate(zip(short, long)) if a != b), len(short))
                if short[p + (len(short) == len(long)) :] == long[p + 1 :]:
                    near[w].add(other)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


@pytest.mark.parametrize("tile_words, tile_cells", [(256, 1 << 18), (3, 1 << 18), (256, 40)])
def test_variants_are_those_of_all_pairs(spark, tile_words, tile_cells):
    r = random.Random(5)
    counts = {}
    for _ in range(700):
        word = "".join(r.choice("abé中") for _ in range(r.choice([6, 6, 7, 8, 15])))
        counts[word] = r.choice([5, 25, 26, 125, 700])
    # A hot prefix, ties, and words of one letter.
    counts |= {"prefix" + a + b: 30 for a in "abcdefgh" for b in "abcdefgh"} | {"aaaaaa": 5, "aaaaaaa": 5, "a" * 8: 25}
    rows = list(counts.items()) + [(None, 9), ("short", 900), ("rareword", 4), ("twiceÿ", 2), ("twiceÿ", 3)]
    counts["twiceÿ"] = 5
    words = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, size string")
    got = spelling.group_variants(words, tile_words=tile_words, tile_cells=tile_cells)
    got = got.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(x) for x in got} == plain_variants(counts) and len(got) == len(counts)


def test_forms_end_in_one_root(spark):
    chain = [("abcdef" + "x" * i, 5 ** (i + 1)) for i in range(9)]
    got = spelling.group_variants(spark.createDataFrame(chain, "word string, n long"), least_count=1).collect()
    assert {r["root"] for r in got} == {"abcdef" + "x" * 8}
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_counted_words(spark):
    rows = [(1, "Straße straße ABCDEF abc’defghi Ābcdefg", 1), (2, None, 1), (None, "abcdef ×÷×÷×÷", 1), (1, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, word int")
    got = {r["word"]: r["n"] for r in spelling.count_words(docs).collect()}
    assert got == {"straße": 2, "abcdef": 2, "defghi": 1, "bcdefg": 1, "×÷×÷×÷": 1}


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    often = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return (
        len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


ODD_TEXTS = [
    None, "", " \n\t", "one", "\x00 a\x00b", "é \U0001f600   x", "a b\na b\n\na b \n a b\n \n",
    "x y z x y z w x y", "中文 " * 60, "w " * 30_000, "| a | b | c\n" * 20, "￿\U00010000" * 30,
]


def test_base_counts_are_those_of_plain_python(spark, sf_dir):
    texts = ODD_TEXTS + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    import pyarrow as pa

    got = perplexity.base_counts(pa.array(texts, pa.string()))
    assert list(zip(*[got[c].tolist() for c in perplexity.BASE_COLUMNS])) == [plain_base(t) for t in texts]


def plain_kneser_ney(texts, order=4):
    """log-probability per code point of every text, by dictionaries of strings."""
    pad = "\x00" * (order - 1)
    grams = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        for i in range(len(t or "")):
            grams[order][(pad + t)[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])
    p = {"": 1 / (len(grams[1]) + 1)}
    for k in range(1, order + 1):
        n = [sum(1 for c in grams[k].values() if c == i) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if min(n) else 0
        cut = [max(0, i - (i + 1) * y * n[i] / n[i - 1]) for i in (1, 2, 3)] if min(n) else [0.5, 1, 1.5]
        total, mass = collections.Counter(), collections.Counter()
        for g, c in grams[k].items():
            total[g[:-1]] += c
            mass[g[:-1]] += cut[min(c, 3) - 1]
        p |= {g: (c - cut[min(c, 3) - 1]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, c in grams[k].items()}
    return [np.mean([np.log(p[(pad + t)[i : i + order]]) for i in range(len(t))]) if t else None for t in texts]


def test_perplexity_is_that_of_plain_kneser_ney_by_arrays_and_by_joins(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("abc deé中\n") for _ in range(r.choice([1, 3, 200, 700]))) for _ in range(60)]
    texts += [None, "", "a" * 600]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else "l%d" % (i % 2), "x") for i, t in enumerate(texts)], "doc_id int, text string, lang string, row string")
    want = plain_kneser_ney(texts)
    model = perplexity.train(docs)
    for rows in (perplexity.MODEL_ROWS, 0):
        got = {x["doc_id"]: x for x in perplexity.judge(docs, model, model_rows=rows).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want):
            assert got[i]["perplexity"] is None if w is None else abs(np.log(got[i]["perplexity"]) + w) < 1e-8
    # Unknown code points and contexts back off.
    other = spark.createDataFrame([(1, "zz ab zz", "l0"), (2, "\U0001f600", "l9")], "doc_id int, text string, lang string")
    a, b = (sorted(perplexity.judge(other, model, model_rows=rows).collect()) for rows in (perplexity.MODEL_ROWS, 0))
    assert [round(x["perplexity"], 6) for x in a] == [round(x["perplexity"], 6) for x in b]


def test_long_texts_score_alike_in_pieces(spark, monkeypatch):
    text = "some words é and more " * 400
    flats = list(perplexity._flats([text, "b"]))
    monkeypatch.setattr(perplexity, "PIECE", 1000)
    monkeypatch.setattr(perplexity, "FLAT", 1500)
    pieces = list(perplexity._flats([text, "b"]))
    assert len(pieces) > 3
    assert np.array_equal(np.concatenate([k for _, k in flats]), np.concatenate([k for _, k in pieces]))


def test_odd_rows_are_judged(spark):
    prose = "the quick brown fox jumps over a lazy dog while %d birds sing in some old tree near that river bank "
    texts = ODD_TEXTS + [" ".join(prose % (i * 7 + j) + "abcdefgh"[j] * 3 for j in range(3)) for i in range(40)]
    docs = spark.createDataFrame([(None if i == 3 else i % 30, t, "en", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, log double")
    got = perplexity.judge(docs).collect()
    assert len(got) == len(texts) and not any(r["kept"] and r["base_failed"] for r in got)
    assert perplexity.judge(docs.limit(0)).count() == 0


def test_bands_leave_clean_documents_alone(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = perplexity.judge(table(spark, sf_dir, "documents")).where("not base_failed")
    rows = judged.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in rows.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.7


def test_long_texts_of_twenty_megabytes(spark):
    text = ("lorem ipsum dolor sit amet consectetur " * 40 + "\n") * 12_000
    docs = spark.createDataFrame([(1, text[: 20 << 20], "en")], "doc_id long, text string, lang string")
    run = periodic.find_runs(docs).select("n_words", F.size("runs").alias("n"), periodic.longest_run()["period"].alias("p")).first()
    assert run["n"] == 1 and run["p"] == 6
    assert perplexity.judge(docs).first()["base_failed"]
    words = {r["word"]: r["n"] for r in spelling.count_words(docs, least_length=5).collect()}
    assert words["lorem"] > 400_000


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_spelling_variants", "op13_perplexity_rules"])
def test_same_rows_as_sql_at_the_larger_size(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, sf_dir), duckdb_tables(sf_dir), ORACLE[name]) == ""
