"""Words that differ by one edit, found by dense tiles of code points.

Two words are near if one inserted, deleted or replaced code point makes one of
the other. That is so exactly if their common prefix and common suffix together
reach the longer length less one, which tiles of padded code-point matrices
test for block against block: one matrix with the words aligned left, one with
them aligned right.

Only words that can be near meet in a tile. The place of the edit lies in one of
two halves of the longer word, and everything outside that half is equal. So a
word of ``l`` code points goes to the tiles of longer lengths ``l`` and
``l + 1``, once per half, keyed by what is outside. A tile over its bound deals
its words to tiles of half the window, again and again if need be; a window of
one code point holds at most one word per letter of the alphabet and longer
length. A pair is counted only in the window that holds its first difference,
which every deal leaves in exactly one tile: no pair is lost or counted twice,
and no task holds a group that grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.llm.shared import store
from curbmeter.llm.words import give_back_memory
from curbmeter.session import broadcast_if_small

# A word's least length and occurrences, and how much commoner its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
# Words and code points of a tile; beyond either it is dealt to smaller windows.
TILE_WORDS = 256
TILE_CELLS = 1 << 18
# Code points of the matrices that a task works on at once, besides a tile that is larger itself.
BLOCK_CELLS = 1 << 19
# Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000

# Every letter as itself, in lower case if it is ASCII, everything else as a blank; one byte per code point.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0xC0 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
COUNTED = "word string, n long"
NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _counter(least_length: int, drop_every: int | None):
    """Batches of ids and texts to batches of words and counts."""

    def batches(counts: dict) -> Iterator[pa.RecordBatch]:
        words, numbers = list(counts), list(counts.values())
        for i in range(0, len(words), 50_000):
            part = [w.decode("latin-1") for w in words[i : i + 50_000]]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(numbers[i : i + 50_000], pa.int64())], ["word", "n"])

    def changed(word: bytes, salt: int) -> bytes:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), salt)
        if h % drop_every:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for part in parts:
            for name, value in zip(part.column(0), part.column(1)):
                text = value.as_py()
                if not text:
                    continue
                # Code points beyond U+00FF become question marks, which are no letters.
                words = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                salt = zlib.crc32(f"{name.as_py() or ''}:".encode()) if drop_every else 0
                for word, n in words.items():
                    if drop_every and len(word) >= least_length:
                        word = changed(word, salt)
                    if len(word) >= least_length:
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD_WORDS:
                    yield from batches(total)
                    total = {}
        yield from batches(total)
        give_back_memory()

    return count


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    drop_every: int | None = None,
) -> DataFrame:
    """``word, n``: the occurrences of every word of at least ``least_length`` code points in all texts.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. With
    ``drop_every`` a word of a document loses one code point if the CRC-32 of
    ``<id>:<word>`` is divisible by it, that at the checksum modulo its length:
    misspellings at known places, to measure recovery with. Null texts have no
    words; a null id counts as an empty one. Tasks count before the shuffle.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counter(least_length, drop_every), COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(words: DataFrame, windows: Column) -> DataFrame:
    """``words`` once per window ``(u, v)`` of the array, with the key of what lies outside it."""
    rows = words.withColumn("window", F.explode(windows))
    rows = rows.withColumn("u", F.col("window.u")).withColumn("v", F.col("window.v")).drop("window")
    # In the shorter word everything after the edit lies one place earlier.
    after = F.expr("substring(word, v + 1 - (size - length(word)))")
    return rows.withColumn("key", F.xxhash64("size", "u", "v", F.expr("substring(word, 1, u)"), after))


def _window(u: Column, v: Column) -> Column:
    return F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"))


def _halves(u: Column, v: Column) -> Column:
    middle = F.floor((u + v) / 2)
    return F.array(_window(u, middle), _window(middle, v))


def tiles(vocabulary: DataFrame, tile_words: int = TILE_WORDS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """``word, n, size, u, v, key``: every word in all the tiles where it can have near words."""
    length = F.length("word")
    words = vocabulary.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    level = _dealt(words, _halves(F.lit(0), F.col("size")))
    kept = []
    while True:
        large = store(
            level.where("v - u > 1")
            .groupBy("key")
            .agg(F.count(F.lit(1)).alias("words"), F.sum("size").alias("cells"))
            .where((F.col("words") > tile_words) | (F.col("cells") > tile_cells))
            .select("key"),
            "large",
        )
        if large.isEmpty():
            kept.append(level)
            return reduce(DataFrame.unionAll, kept)
        large = broadcast_if_small(large)
        kept.append(level.join(large, "key", "left_anti").select(*level.columns))
        over = store(level.join(large, "key", "left_semi").drop("key").withColumnsRenamed({"u": "from", "v": "to"}), "over")
        # Windows of one code point can only be here by a hash collision, and stay as they are.
        windows = F.when(F.col("to") - F.col("from") > 1, _halves(F.col("from"), F.col("to"))).otherwise(
            F.array(_window(F.col("from"), F.col("to")))
        )
        level = _dealt(over, windows).drop("from", "to").select("word", "n", "size", "u", "v", "key")


def _matrices(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and aligned right, padded with 0, and the lengths."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    kind = np.uint8 if codes.max() < 256 else np.uint16 if codes.max() < 1 << 16 else np.uint32
    column = np.arange(lengths.max())
    left = np.zeros((len(words), lengths.max()), kind)
    right = np.zeros_like(left)
    left[column < lengths[:, None]] = codes
    # Reversed, so that the common suffix is a common prefix here.
    right[column >= lengths.max() - lengths[:, None]] = codes
    return left, right[:, ::-1], lengths


def near_in_tiles(words: list, n: np.ndarray, key: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple:
    """Near words of each word in its tile: how many, and the row of the commonest one, -1 if none.

    Rows of a tile follow each other. Ties go to the smaller word.
    """
    left, right, lengths = _matrices(words)
    rows = len(words)
    order = sorted(range(rows), key=words.__getitem__)
    rank = np.empty(rows, np.int64)
    rank[order] = np.arange(rows)
    ranked = np.lexsort((-rank, n))
    worth = np.empty(rows, np.int64)
    worth[ranked] = np.arange(rows)
    near, best = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
    for apart in range(1, rows):
        same = (key[apart:] == key[:-apart]) & (size[apart:] == size[:-apart]) & (u[apart:] == u[:-apart])
        same &= v[apart:] == v[:-apart]
        a = np.flatnonzero(same)
        if not len(a):
            if not (key[apart:] == key[:-apart]).any():
                break
            continue
        b = a + apart
        a, b = (x[np.maximum(lengths[a], lengths[b]) == size[a]] for x in (a, b))
        prefix = (left[a] != left[b]).argmax(axis=1)
        inside = (u[a] <= prefix) & (prefix < v[a])
        a, b, prefix = a[inside], b[inside], prefix[inside]
        suffix = (right[a] != right[b]).argmax(axis=1)
        close = prefix + suffix >= size[a] - 1
        a, b = a[close], b[close]
        for one, other in ((a, b), (b, a)):
            near[one] += 1  # a row occurs at most once on each side of one distance
            best[one] = np.maximum(best[one], worth[other])
    return near, np.where(best >= 0, ranked[best], -1)


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of tiles, sorted by key, to the near words of every word in each tile."""

    def done(table: pa.Table) -> pa.RecordBatch:
        words = table["word"].to_pylist()
        n, key, size, u, v = (table[c].to_numpy() for c in ("n", "key", "size", "u", "v"))
        near, best = near_in_tiles(words, n, key, size, u, v)
        at = np.flatnonzero(near)
        chosen = best[at]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[i] for i in at], pa.string()),
                pa.array(near[at]),
                pa.array(n[chosen]),
                pa.array([words[i] for i in chosen], pa.string()),
            ],
            schema=NEAR,
        )

    held, cells = [], 0
    for part in parts:
        held.append(part)
        cells += int(np.sum(part.column("size").to_numpy(zero_copy_only=False)))
        if cells < BLOCK_CELLS:
            continue
        table = pa.Table.from_batches(held)
        key = table["key"].to_numpy()
        past = int(np.searchsorted(key, key[-1]))
        if past:
            yield done(table.slice(0, past))
            table = table.slice(past)
        held, cells = table.combine_chunks().to_batches(), int(np.sum(table["size"].to_numpy()))
    if held:
        yield done(pa.Table.from_batches(held))


def near_words(vocabulary: DataFrame, tile_words: int = TILE_WORDS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """``word, n_near, near, near_n`` for every word that has near words: how many, and the commonest (ties: the smallest)."""
    dealt = tiles(vocabulary, tile_words, tile_cells).repartition("key").sortWithinPartitions("key", "size", "u", "v")
    found = dealt.mapInArrow(_compare, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return (
        found.groupBy("word")
        .agg(F.sum("near").alias("n_near"), best.alias("b"))
        .select("word", "n_near", F.col("b.best").alias("near"), (-F.col("b.less")).alias("near_n"))
    )


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the end of each chain, whose steps double every round."""
    roots = links.select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = store(roots.join(further, "root", "left"), "roots")
        if stepped.where("further is not null").isEmpty():
            return stepped.select("word", "root")
        roots = stepped.select("word", F.coalesce("further", "root").alias("root"))


def group_variants(
    words: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    tile_words: int = TILE_WORDS,
    tile_cells: int = TILE_CELLS,
) -> DataFrame:
    """Rows ``word, n`` to ``word, n, n_near, form, form_n, root``.

    Kept are words of at least ``least_length`` code points and ``least_count``
    occurrences; rows of one word are added up, null words left out, other
    columns not read. ``n_near`` counts the kept words that differ by exactly
    one inserted, deleted or replaced code point. ``form`` is the one of largest
    ``n`` (ties: the smallest by code points) if that is at least ``ratio``
    times the word's own, else null; ``ratio`` must be over 1. ``root`` is where
    the forms end, the word itself if it has none. An empty table gives no rows.
    """
    vocabulary = store(
        words.where(F.length("word") >= least_length)
        .groupBy("word")
        .agg(F.sum("n").cast("long").alias("n"))
        .where(F.col("n") >= least_count),
        "vocabulary",
    )
    near = near_words(vocabulary, tile_words, tile_cells)
    common = F.col("near_n") >= ratio * F.col("n")
    formed = store(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(common, F.col("near")).alias("form"),
            F.when(common, F.col("near_n")).alias("form_n"),
        ),
        "formed",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
