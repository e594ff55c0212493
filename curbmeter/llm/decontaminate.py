"""Find benchmark passages in documents by winnowing.

Both sides keep, of every window of six consecutive 5-word grams, the smallest
gram hash. Any ten words that two texts share hold the same six grams, so both
keep the same hash for them: a join of the kept hashes finds every shared span
of ten words. Hits are then extended: the ten words around a kept hash are
compared, and hit windows that overlap join to longer spans.

Words are compared as 64-bit hashes, ten words as one such hash; two different
windows agree with probability 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.llm.shared import free_name, store
from curbmeter.llm.words import gram_hashes, list_array, room_after, text_chunks, word_hashes
from curbmeter.session import broadcast_if_small

SPAN = 10
GRAM = 5
# Bits of the fixed-size filter that lets tasks skip most fingerprints before the join: 2 MB.
FILTER_BITS = 1 << 24

WINDOWS = pa.struct(
    [("start", pa.int32()), ("n", pa.int32()), ("fingerprint", pa.int64()), ("span", pa.int64())]
)
SCANNED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "windows",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.IntegerType()),
                        T.StructField("n", T.IntegerType()),
                        T.StructField("fingerprint", T.LongType()),
                        T.StructField("span", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def winnow(words: np.ndarray, room: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``span`` words start, and the smallest gram hash in each such window."""
    grams = gram_hashes(words, gram)
    size = len(words) - span + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:size].copy()
    for i in range(1, span - gram + 1):
        np.minimum(least, grams[i : i + size], out=least)
    at = np.flatnonzero(room[:size] >= span)
    return at, least[at]


def _scan(span: int, gram: int, short: tuple[int, ...], passes, whole_short: bool):
    """An Arrow function from texts to their word counts and windows.

    ``passes`` is the filter's bits or None for every window; ``short`` are the
    lengths under ``span`` to look for; ``whole_short`` gives texts shorter than
    ``span`` as one window, as benchmark items are.
    """

    def wanted(hashes: np.ndarray) -> np.ndarray:
        if passes is None:
            return np.ones(len(hashes), bool)
        bits = np.frombuffer(passes.value, np.uint8)
        bit = hashes & np.uint64(FILTER_BITS - 1)
        return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def run(texts: pa.Array) -> pa.Array:
        counts, lists = [], []
        for data, offsets in text_chunks(texts):
            words, at = word_hashes(data, offsets)
            room = room_after(at)
            n_words = np.diff(at)
            row = np.repeat(np.arange(len(n_words)), n_words)
            found = []
            start, least = winnow(words, room, span, gram)
            keep = wanted(least)
            start, least = start[keep], least[keep]
            if len(start):
                found.append((start, np.full(len(start), span), least, gram_hashes(words, span)[start]))
            for n in short:
                hashes = gram_hashes(words, n)
                here = np.flatnonzero(room[: len(hashes)] >= n)
                if whole_short:
                    here = here[(n_words[row[here]] == n)]
                here = here[wanted(hashes[here])]
                found.append((here, np.full(len(here), n), hashes[here], hashes[here]))
            start, n, least, whole = (
                np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)
            )
            rows = row[start]
            order = np.argsort(rows, kind="stable")
            start, rows = start[order], rows[order]
            values = pa.StructArray.from_arrays(
                [
                    pa.array((start - at[rows]).astype(np.int32)),
                    pa.array(n[order].astype(np.int32)),
                    pa.array(least[order].astype(np.uint64).view(np.int64)),
                    pa.array(whole[order].astype(np.uint64).view(np.int64)),
                ],
                fields=list(WINDOWS),
            )
            counts.append(n_words.astype(np.int64))
            lists.append(list_array(rows, len(n_words), values))
        if not lists:
            return pa.array([], pa.struct([("n_words", pa.int64()), ("windows", pa.list_(WINDOWS))]))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts)), pa.concat_arrays(lists)], names=["n_words", "windows"]
        )

    def scan(texts: pa.Array) -> pa.Array:
        return run(texts)

    return F.arrow_udf(scan, SCANNED)


def _filter_bits(fingerprints: DataFrame):
    """The fixed-size filter over all test fingerprints, broadcast; at most 2 MB reach the driver."""
    bit = F.col("fingerprint").bitwiseAND(FILTER_BITS - 1)
    words = (
        fingerprints.select(F.shiftright(bit, 5).alias("word"), F.expr("shiftleft(1L, cast(%s as int))" % "fingerprint & 31").alias("bits"))
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return fingerprints.sparkSession.sparkContext.broadcast(bits.tobytes())


class Benchmark:
    """Windows and fingerprints of the benchmark, written once and used by every scan."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
        scan = _scan(SPAN, GRAM, tuple(range(1, SPAN)), None, whole_short=True)
        items = benchmark.select(
            F.col(id_col).cast("string").alias("item"), scan(F.col(text_col)).alias("scanned")
        )
        # Benchmark rows that repeat, and windows that repeat in an item, count once.
        self.windows = store(
            items.select("item", F.explode("scanned.windows").alias("w"))
            .select("item", F.col("w.n").alias("n"), F.col("w.fingerprint").alias("fingerprint"), F.col("w.span").alias("span"))
            .distinct(),
            "benchmark",
        )
        self.fingerprints = self.windows.select("fingerprint").distinct()
        # At most SPAN - 1 values.
        self.short = tuple(sorted(r["n"] for r in self.windows.where(F.col("n") < SPAN).select("n").distinct().collect()))
        self.bits = _filter_bits(self.fingerprints)
        self.scan = _scan(SPAN, GRAM, self.short, self.bits, whole_short=False)

    def hits(self, scanned: DataFrame, key: str) -> DataFrame:
        """``key, start, n, span`` for every window of ``scanned`` that is in some item."""
        kept = scanned.select(key, F.explode("windows").alias("w")).select(key, "w.*")
        matched = kept.join(broadcast_if_small(self.fingerprints), "fingerprint", "left_semi")
        spans = self.windows.select("n", "span").distinct()
        return matched.join(broadcast_if_small(spans), ["n", "span"], "left_semi")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, n_items, items, contaminated``.

    ``n_hit`` counts words inside any occurrence of a window; ``items`` are the
    ids, as sorted strings, of the items that have such a window. Null and
    wordless texts have no words and no hits. Every row of a repeated document
    is returned; rows with a null id too. An item with a null id counts for
    ``n_hit`` alone. An empty benchmark contaminates nothing; an empty table
    gives no rows. Other columns are not read.
    """
    test = Benchmark(benchmark, item_col, item_text_col)
    scanned = store(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), test.scan(F.col(text_col)).alias("s")
        ).select("row", "id", "s.n_words", "s.windows"),
        "scanned",
    )
    hits = store(test.hits(scanned, "row"), "hits")
    covered = (
        hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word"))
        .distinct()
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = (
        hits.select("row", "n", "span")
        .distinct()
        .join(broadcast_if_small(test.windows.select("n", "span", "item")), ["n", "span"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    counted = covered.join(items, "row", "left")
    none = F.array().cast("array<string>")
    return (
        scanned.select("row", "id", "n_words")
        .join(counted, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", none).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of any benchmark item.

    Contaminated texts are known by their MD5, so every copy goes. Null and
    wordless texts stay. Names of other columns do not matter.
    """
    test = Benchmark(benchmark, item_col, item_text_col)
    digest = F.unhex(F.md5(F.col(text_col).cast("binary")))
    scanned = docs.select(digest.alias("digest"), test.scan(F.col(text_col)).alias("s")).select("digest", "s.windows")
    caught = store(test.hits(scanned.where(F.size("windows") > 0), "digest").select("digest").distinct(), "caught")
    name = free_name(docs, "digest")
    dirty = broadcast_if_small(caught.withColumnRenamed("digest", name))
    return docs.withColumn(name, digest).join(dirty, name, "left_anti").select(*[docs[c] for c in docs.columns])
