"""Quality rules with bands of n-gram perplexity per language.

The language model has four code points per gram and is counted over all
documents. Spark adds up the counts; modified Kneser-Ney discounts, interpolated
from one code point upwards, follow by grouping and joining these tables. A gram
is its code points packed in 64 bits, a hash without collisions, and the model
is a table of such keys with logarithms of probabilities and of back-off
weights. All languages share it: three code points tell them apart, and a text
that quotes another language is no junk. The bands are per language.

To score, the table is sorted into one array of keys per order and looked up by
binary search. It is sent to the tasks only if its rows are under a bound;
beyond that the grams of the documents are joined to it instead, with the same
scores.

A document is rejected if its logarithm of perplexity is too far from the median
of its language, below or above: text that repeats itself is too easy, symbols
and other junk too hard. Medians are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbmeter.llm.shared import store
from curbmeter.llm.words import BASE, _runs, give_back_memory, gram_hashes, room_after, run_hashes, text_chunks
from curbmeter.operators.quantiles import exact_quantiles
from curbmeter.session import broadcast_if_small

ORDER = 4
BITS = 16
# Half of a band: so many robust standard deviations, and at least this share of the median.
DEVIATIONS, LEAST_SHARE = 4.0, 0.05
# Discounts of counts 1, 2 and more for tables too small to estimate them from.
FALLBACK = (0.5, 1.0, 1.5)
# Rows of a model that tasks hold as arrays, 16 bytes each; a larger one is joined.
MODEL_ROWS = 4_000_000
# Code points that are worked on at once, and grams that a task counts before it hands them on.
PIECE = 1 << 18
FLAT = 1 << 20
HELD_GRAMS = 1 << 20

SYMBOLS = "#*$%&|<>"
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value occurred before in its row, and whether it occurs there more than once."""
    keys = hashes + rows.astype(np.uint64) * np.uint64(BASE)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return again, twice


def base_counts(texts: pa.Array) -> dict:
    """The columns of ``BASE_COLUMNS`` for an array of texts; lines and windows of words are compared as 64-bit hashes."""
    out = {c: [np.zeros(0, np.int64)] for c in BASE_COLUMNS}
    for data, offsets in text_chunks(texts):
        n_rows = len(offsets) - 1

        def per_row(marks: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(marks) + 1, np.int32)
            np.cumsum(marks, out=sums[1:], dtype=np.int32)
            return np.diff(sums[offsets]).astype(np.int64)

        inside = _WORD[data]
        starts, ends = _runs(inside, offsets)
        at = np.searchsorted(starts, offsets)
        out["n_words"].append(np.diff(at))
        # In UTF-8 every code point has one byte that does not continue another.
        out["word_chars"].append(per_row(inside & ((data & 0xC0) != 0x80)))
        out["n_symbols"].append(per_row(_SYMBOL[data]))

        codes = data.astype(np.uint16) + np.uint16(1)
        first, past = _runs(data != 0x0A, offsets)
        worded = np.searchsorted(starts, past) > np.searchsorted(starts, first)
        first, past = first[worded], past[worded]
        line_row = np.searchsorted(offsets, first, "right") - 1
        again, _ = _repeats(run_hashes(codes, first, past), line_row)
        out["n_dup_lines"].append(np.bincount(line_row[again], minlength=n_rows))

        grams = gram_hashes(run_hashes(codes, starts, ends), 3)
        window = np.flatnonzero(room_after(at)[: len(grams)] >= 3)
        word_row = np.repeat(np.arange(n_rows), np.diff(at))
        _, twice = _repeats(grams[window], word_row[window])
        change = np.zeros(len(starts) + 3, np.int64)
        np.add.at(change, window[twice], 1)
        np.add.at(change, window[twice] + 3, -1)
        covered = np.cumsum(change)[: len(starts)] > 0
        out["n_repeat_words"].append(np.bincount(word_row[covered], minlength=n_rows))
    return {c: np.concatenate(v).astype(np.int64) for c, v in out.items()}


def _packed(parts: list) -> np.ndarray:
    """Keys of the grams that end at every code point but the first ``ORDER - 1`` of each part."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # Beyond 16 bits, code points share codes.
    codes = np.where(codes >> np.uint64(BITS) > 0, codes % np.uint64(0xFFFF) + np.uint64(1), codes)
    keys = np.zeros(len(codes), np.uint64)
    for i in range(ORDER):
        keys[ORDER - 1 :] |= codes[ORDER - 1 - i : len(codes) - i] << np.uint64(BITS * i)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    lead = (ends - sizes)[:, None] + np.arange(ORDER - 1)
    keep = np.ones(len(codes), bool)
    keep[lead.ravel()] = False
    return keys[keep]


def _flats(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, keys)`` of the grams of all texts, some at a time; a long text comes in pieces at fixed places."""
    pad = "\0" * (ORDER - 1)
    parts, rows, size = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        # U+0000 marks what is before a text's start.
        text = pad + text.replace("\0", "\uffff")
        for start in range(0, len(text) - len(pad), PIECE):
            parts.append(text[start : start + PIECE + len(pad)])
            rows.append((row, len(parts[-1]) - len(pad)))
            size += len(parts[-1])
            if size >= FLAT:
                yield np.repeat(*np.array(rows).T), _packed(parts)
                parts, rows, size = [], [], 0
    if parts:
        yield np.repeat(*np.array(rows).T), _packed(parts)


def _count_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, inverse, np.concatenate([n for _, n in held]))
        return keys, n

    def batch() -> pa.RecordBatch:
        keys, n = merged()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

    for part in parts:
        for _, keys in _flats(part.column(0).to_pylist()):
            held.append(np.unique(keys, return_counts=True))
            if len(held) > 8:
                held[:] = [merged()]
                if len(held[0][0]) > HELD_GRAMS:
                    yield batch()
    if held:
        yield batch()
    give_back_memory()


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.col(text_col).alias("text"),
        F.col(id_col).alias("id"),
    )


def _suffix(key: Column, order: int) -> Column:
    """The last ``order`` code points of a key."""
    return key if order == ORDER else key.bitwiseAND(F.lit((1 << (BITS * order)) - 1).cast("long"))


def _context(key: Column) -> Column:
    """All code points of a key but the last."""
    return F.shiftrightunsigned(key, BITS)


def _cut(grams: DataFrame) -> Column:
    """The modified Kneser-Ney discount of a gram by its count ``n``, from how many grams occur once to four times."""
    n1, n2, n3, n4 = grams.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
    cuts = FALLBACK
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        cuts = [max(0.0, i - (i + 1) * y * more / here) for i, here, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    one, two, more = map(float, cuts)
    return F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)


def train(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The model ``kind, key, value`` of all texts.

    ``value`` is the logarithm of a probability for ``kind`` 1 to 4 (the order
    of the gram ``key``; 0 for a code point that does not occur), and of a
    back-off weight for ``kind`` -1 to -4 (minus the order; ``key`` is the
    context). Texts that are null or empty add nothing; without any other text
    the model has one row, of kind 0.
    """
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_grams, "gram long, n long")
    level = store(counted.groupBy(F.col("gram").alias("key")).agg(F.sum("n").alias("n")), "grams")
    levels = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):
        # How many different code points stand before a gram.
        level = store(level.groupBy(_suffix(F.col("key"), order).alias("key")).agg(F.count(F.lit(1)).alias("n")), "grams")
        levels[order] = level
    lower = levels[1].agg((1 / (F.count(F.lit(1)) + 1).cast("double")).alias("p")).select(F.lit(0).cast("long").alias("key"), "p")
    model = [lower.select(F.lit(0).alias("kind"), "key", F.log("p").alias("value"))]
    for order in range(1, ORDER + 1):
        # A context is followed by at most as many grams as there are codes, 65,536.
        group = Window.partitionBy("context")
        total = F.sum("n").over(group)
        grams = levels[order].withColumn("context", _context(F.col("key"))).withColumn("cut", _cut(levels[order]))
        grams = grams.withColumn("own", (F.col("n") - F.col("cut")) / total).withColumn("weight", F.sum("cut").over(group) / total)
        below = lower.select(F.col("key").alias("suffix"), F.col("p").alias("below"))
        grams = grams.withColumn("suffix", _suffix(F.col("key"), order - 1)).join(below, "suffix")
        grams = store(grams.select("key", "context", (F.col("own") + F.col("weight") * F.col("below")).alias("p"), "weight"), "level")
        lower = grams.select("key", "p")
        weights = grams.groupBy(F.col("context").alias("key")).agg(F.max("weight").alias("weight"))
        model.append(grams.select(F.lit(order).alias("kind"), "key", F.log("p").alias("value")))
        model.append(weights.select(F.lit(-order).alias("kind"), "key", F.log("weight").alias("value")))
    return store(reduce(DataFrame.unionAll, model), "model")


class Arrays:
    """Per kind the sorted keys of a model and their values."""

    def __init__(self, model: DataFrame):
        rows = model.toArrow()
        kinds, keys, values = rows["kind"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()
        order = np.lexsort((keys, kinds))
        kinds, keys, values = kinds[order], keys[order], values[order]
        self.found = {}
        for kind in range(-ORDER, ORDER + 1):
            part = slice(*np.searchsorted(kinds, (kind, kind + 1)))
            self.found[kind] = (keys[part], values[part])

    def value(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The value of every key, NaN where there is none."""
        known, values = self.found[kind]
        out = np.full(len(keys), np.nan)
        at = np.searchsorted(known, keys)
        here = at < len(known)
        here[here] = known[at[here]] == keys[here]
        out[here] = values[at[here]]
        return out

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Of each key's last code point after the others, backing off to shorter contexts where a gram is unknown."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            at = keys[left] & np.uint64((1 << (BITS * order)) - 1)
            found = self.value(order, at)
            known = ~np.isnan(found)
            out[left[known]] += found[known]
            left, at = left[~known], at[~known]
            weight = self.value(-order, at >> np.uint64(BITS))
            out[left] += np.where(np.isnan(weight), 0.0, weight)
        out[left] += self.found[0][1][0]
        return out


SCORED = ", ".join(f"{c} long" for c in BASE_COLUMNS) + ", n_chars long"


def _score(arrays):
    """Batches ``lang, text, id`` to base counts and either mean log-probabilities or the counted grams."""

    def lists(texts: list) -> pa.Array:
        keys, counts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for text in texts:
            pieces = [np.unique(k, return_counts=True) for _, k in _flats([text])]
            keys += [k for k, _ in pieces]
            counts += [n for _, n in pieces]
            sizes.append(sum(len(k) for k, _ in pieces))
        values = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], ["gram", "n"]
        )
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            base = base_counts(part.column(1))
            texts = part.column(1).to_pylist()
            n_chars = np.array([len(t or "") for t in texts], np.int64)
            if arrays is None:
                last = lists(texts)
            else:
                sums = np.zeros(len(texts))
                for row, keys in _flats(texts):
                    distinct, inverse = np.unique(keys, return_inverse=True)
                    sums += np.bincount(row, arrays.value.log_probability(distinct)[inverse], len(texts))
                last = pa.array(-sums / np.maximum(n_chars, 1), mask=n_chars == 0)
            columns = [part.column(2), part.column(0), *[pa.array(base[c]) for c in BASE_COLUMNS], pa.array(n_chars), last]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", *BASE_COLUMNS, "n_chars", "last"])
        give_back_memory()

    return score


def _joined_scores(rows: DataFrame, model: DataFrame, id_type: str) -> DataFrame:
    """As with arrays, by joins of every document's grams with the model."""
    grams = "array<struct<gram: long, n: long>>"
    counted = rows.mapInArrow(_score(None), f"id {id_type}, lang string, {SCORED}, last {grams}")
    # Row numbers are fixed by being written.
    counted = store(counted.withColumn("row", F.monotonically_increasing_id()), "counted")
    each = counted.select("row", F.explode("last").alias("g")).select("row", "g.gram", "g.n")
    found = each.select("gram").distinct().withColumn("log", F.lit(0.0)).withColumn("open", F.lit(True))
    for order in range(ORDER, 0, -1):
        for kind, key in ((order, _suffix(F.col("gram"), order)), (-order, _context(_suffix(F.col("gram"), order)))):
            part = model.where(F.col("kind") == kind).select(F.col("key").alias("at"), "value")
            found = found.withColumn("at", key).join(part, "at", "left")
            found = found.withColumn("log", F.col("log") + F.when(F.col("open"), F.coalesce("value", F.lit(0.0))).otherwise(0.0))
            closed = F.col("value").isNotNull() & F.lit(kind > 0)
            found = found.withColumn("open", F.col("open") & ~closed).drop("at", "value")
    none = model.where("kind = 0").first()["value"]
    found = found.select("gram", (F.col("log") + F.when(F.col("open"), none).otherwise(0.0)).alias("log"))
    sums = each.join(found, "gram").groupBy("row").agg(F.sum(F.col("log") * F.col("n")).alias("log"))
    scored = counted.join(sums, "row", "left").withColumn("last", -F.col("log") / F.col("n_chars"))
    return scored.select("id", "lang", *BASE_COLUMNS, "n_chars", "last")


def judge(
    docs: DataFrame,
    model: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    model_rows: int = MODEL_ROWS,
) -> DataFrame:
    """One row per document: ``id_col``, base counts, ``base_failed, perplexity, lower, upper, kept``.

    Words are what lies between ASCII blanks. ``word_chars`` are the code points
    in words, ``n_symbols`` the characters of ``#*$%&|<>``, ``n_dup_lines`` the
    lines with a word that equal an earlier one, ``n_repeat_words`` the words in
    windows of three that occur twice or more in the text. A document fails the
    base rules with under 50 words, or if over half of its words repeat so.

    ``perplexity`` is per code point, under ``model`` (:func:`train` of these
    documents, if none is given). ``lower`` and ``upper`` are the band of the
    language, from the documents that pass the base rules: the median of the
    logarithm, less and plus four robust standard deviations (1.4826 times the
    median distance) or a twentieth of itself, whichever is more. Kept are
    documents that pass the base rules inside their band.

    Null, empty and blank texts have no words and fail; the first two have no
    perplexity. A null language is the language ''. Rows with null or repeated
    ids are rows like any other. An empty table gives no rows. Other columns are
    not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    model = train(docs, text_col) if model is None else model
    rows = _rows(docs, id_col, text_col, lang_col)
    if model.count() <= model_rows:
        arrays = docs.sparkSession.sparkContext.broadcast(Arrays(model))
        scored = rows.mapInArrow(_score(arrays), f"id {id_type}, lang string, {SCORED}, last double")
    else:
        scored = _joined_scores(rows, model, id_type)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Rounded, so that the order of summation does not decide.
    scored = scored.withColumn("base_failed", failed).withColumn("log", F.round("last", 9))
    scored = store(scored.drop("last", "n_chars"), "scored")
    passed = scored.where("not base_failed")
    middle = store(exact_quantiles(passed, ["log"], [0.5], by=["lang"]).select("lang", F.col("value").alias("middle")), "middle")
    away = passed.join(broadcast_if_small(middle), "lang").select("lang", F.abs(F.col("log") - F.col("middle")).alias("away"))
    spread = store(exact_quantiles(away, ["away"], [0.5], by=["lang"]).select("lang", F.col("value").alias("spread")), "spread")
    half = F.greatest(F.lit(DEVIATIONS * 1.4826) * F.col("spread"), F.lit(LEAST_SHARE) * F.col("middle"))
    bands = middle.join(spread, "lang").select("lang", (F.col("middle") - half).alias("low"), (F.col("middle") + half).alias("high"))
    judged = scored.join(broadcast_if_small(store(bands, "bands")), "lang", "left")
    return judged.select(
        F.col("id").alias(id_col),
        *BASE_COLUMNS,
        "base_failed",
        F.exp("log").alias("perplexity"),
        F.exp("low").alias("lower"),
        F.exp("high").alias("upper"),
        (~F.col("base_failed") & F.coalesce(F.col("log").between(F.col("low"), F.col("high")), F.lit(False))).alias("kept"),
    )
