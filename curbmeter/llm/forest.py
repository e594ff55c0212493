"""Nearest neighbours by hash-prefix forests (LSH forests) over shards of the index.

A tree hashes every vector to a long string of bits, each the side of a random
hyperplane, and keeps the strings sorted; vectors with a common prefix are then
neighbours in the array. A query descends every tree to its longest matching
prefixes, and ascends all trees together, one bit at a time, until the prefix
ranges hold enough different rows. Those are compared by their exact inner product.

The index is cut into shards of bounded size, each with a forest of its own,
and every shard meets the queries in blocks of bounded size; a shard returns
the best few per query. One group of (shard, query block) is a task's unit of
memory. Vectors that occur more than once are one vector with its smallest ids,
which is exact: no answer can hold more of them.

For inner products of vectors of any length, each indexed vector gets one more
coordinate, sqrt(M² - |x|²) with M the greatest length; a query gets 0 there.
Then the nearest by angle is the nearest by inner product. A large coordinate
blunts the hashes, so a shard holds vectors of one band of lengths and takes
their own greatest; bands that are small together are one shard, searched whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from curbmeter.llm.shared import store

TREES = 48
BITS = 16
SHARD = 4096
QUERY_BLOCK = 4096
# Prefix ranges of a shard are widened until they hold so many different rows.
CANDIDATES = 2048
# Lengths of a band differ by this factor at most.
BAND = 1.05
SEED = 11


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``len(vectors)`` × TREES strings of BITS bits, as numbers whose order is that of the strings."""
    sides = (vectors @ planes > 0).reshape(len(vectors), -1, BITS)
    return (sides * (1 << np.arange(BITS - 1, -1, -1))).sum(axis=2)


class Forest:
    """Sorted hash strings per tree of one shard."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, seed: int = SEED):
        self.vectors = vectors
        missing = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * BITS))
        strings = hash_strings(np.column_stack([vectors, missing]), self.planes)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows in its prefix ranges, at the deepest level where all trees together hold enough different ones."""
        if len(self.vectors) <= enough:
            for _ in range(len(queries)):
                yield np.arange(len(self.vectors))
            return
        strings = hash_strings(np.column_stack([queries, np.zeros(len(queries))]), self.planes)
        trees = range(strings.shape[1])
        low = np.zeros(strings.shape, np.int64)
        high = np.zeros(strings.shape, np.int64)
        found = np.zeros((len(queries), len(self.vectors)), bool)
        climbing = np.arange(len(queries))
        for rest in range(BITS + 1):
            prefix = strings[climbing] >> rest
            for t in trees:
                low[climbing, t] = np.searchsorted(self.sorted[:, t], prefix[:, t] << rest)
                high[climbing, t] = np.searchsorted(self.sorted[:, t], (prefix[:, t] + 1) << rest)
            # Trees that find the same rows add up to more than there are, never to fewer.
            many = (high[climbing] - low[climbing]).sum(axis=1) >= enough
            short = ~many
            for i in np.flatnonzero(many):
                q = climbing[i]
                for t in trees:
                    found[q, self.order[low[q, t] : high[q, t], t]] = True
                short[i] = np.count_nonzero(found[q]) < enough
            climbing = climbing[short]
            if len(climbing) == 0:
                break
        for row in found:
            yield np.flatnonzero(row)


def _best(products: np.ndarray, rows: np.ndarray, smallest: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest products, ties to the smaller id."""
    if len(products) > k:
        edge = np.partition(products, len(products) - k)[len(products) - k]
        keep = np.flatnonzero(products >= edge)
    else:
        keep = np.arange(len(products))
    return keep[np.lexsort((smallest[rows[keep]], -products[keep]))][:k]


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimension: int | None) -> DataFrame:
    """``id, vector`` of doubles, without null, zero, non-finite or odd-sized ones and without null ids."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    out = out.where(F.col("id").isNotNull() & v.isNotNull() & fine & some)
    return out if dimension is None else out.where(F.size("vector") == dimension)


def shard_plan(counts: dict[int, int], shard: int, candidates: int) -> list[tuple[int, int, int]]:
    """``band, first shard, shards`` for each band of lengths and its number of vectors.

    Neighbouring bands of at most ``candidates`` vectors together are one
    shard, as all of it is compared; any other band has shards of its own.
    """
    plan, at, held = [], 0, 0
    for band, n in sorted(counts.items()):
        if held and held + n > candidates:
            at, held = at + 1, 0
        shards = -(-n // shard) if n > candidates else 1
        plan.append((band, at, shards))
        if n > candidates:
            at += shards
        else:
            held += n
    return plan


RESULT = T.StructType(
    [
        T.StructField("class", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("score", T.DoubleType()),
    ]
)


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    query_block: int = QUERY_BLOCK,
    candidates: int = CANDIDATES,
    trees: int = TREES,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: per query the ``k`` largest inner products found, without its own id.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do null ids and vectors whose size is not the commonest one of
    the index. Ties go to the smaller id. Rows that repeat an id and vector
    count once. Empty tables give no rows; other columns are not read.
    """
    spark = index.sparkSession
    rows = usable(index, id_col, vector_col, None)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if not sizes:
        return empty
    d = sizes[0]["d"]
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))

    def distinct_vectors(df: DataFrame, ids: int | None) -> DataFrame:
        """``vector, ids``: each vector once, with its smallest ids; Spark keeps few rows per group before the shuffle."""
        by = W.Window.partitionBy("vector").orderBy("id")
        few = df.distinct().withColumn("place", F.row_number().over(by)).where(F.col("place") <= ids)
        return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    once = distinct_vectors(usable(index, id_col, vector_col, d), k + 1)
    # The logarithm of a length that is too small for a double is null.
    band = F.coalesce(F.floor(F.log(length) / F.log(F.lit(BAND))), F.lit(-(1 << 20))).cast("long")
    base = store(once.select("vector", "ids", band.alias("band"), F.xxhash64("vector").alias("class")), "index")
    # Doubles have fewer than 30,000 such bands.
    counts = {r["band"]: r["n"] for r in base.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = store(usable(queries, id_col, vector_col, d).distinct().select("id", "vector", F.xxhash64("vector").alias("class")), "asked")
    blocks = asked.groupBy("class", "vector").agg(F.lit(0).alias("x")).drop("x")
    n_queries = blocks.count()
    if n_queries == 0 or not counts:
        return empty
    plan = shard_plan(counts, shard, candidates)
    shards, query_blocks = max(first + n for _, first, n in plan), -(-n_queries // query_block)
    places = F.broadcast(spark.createDataFrame(plan, "band long, first int, shards int"))
    # Every shard meets every block of queries; a band's rows are dealt by hash, so both stay near their bounds.
    left = base.join(places, "band").select(
        (F.col("first") + F.pmod(F.xxhash64("class", F.lit(1)), F.col("shards"))).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(int(query_blocks) - 1))).alias("block"),
        "ids",
        "vector",
    )
    right = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1))).alias("shard"),
        F.pmod(F.xxhash64("class", F.lit(2)), F.lit(query_blocks)).cast("int").alias("block"),
        "class",
        "vector",
    )

    def search(indexed: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if len(indexed) == 0 or len(wanted) == 0:
            return pd.DataFrame({"class": [], "ids": [], "score": []})
        vectors = np.stack(indexed["vector"].to_numpy())
        ids = indexed["ids"].to_numpy()
        smallest = np.array([i[0] for i in ids])
        asked_for = np.stack(wanted["vector"].to_numpy())
        forest = Forest(vectors, np.sqrt((vectors**2).sum(axis=1).max()), trees)
        out_class, out_ids, out_score = [], [], []
        for q, found in enumerate(forest.candidates(asked_for, candidates)):
            products = vectors[found] @ asked_for[q]
            best = _best(products, found, smallest, k + 1)
            out_class += [wanted["class"].iloc[q]] * len(best)
            out_ids += [ids[r] for r in found[best]]
            out_score += products[best].tolist()
        return pd.DataFrame({"class": out_class, "ids": out_ids, "score": out_score})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, RESULT)
    pairs = found.select("class", "score", F.explode("ids").alias("other"))
    # A query's own id is among the first k + 1 at most once.
    by = W.Window.partitionBy("class").orderBy(F.desc("score"), "other")
    top = pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1)
    top = store(top.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "other", "score"))).alias("found")), "top")
    answers = asked.select("id", "class").join(top, "class")
    others = F.slice(F.filter("found", lambda x: x["other"] != F.col("id")), 1, k)
    return answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "x")).select(
        "query_id",
        (F.col("rank") + 1).cast("int").alias("rank"),
        F.col("x.other").alias(id_col),
        F.col("x.score").alias("score"),
    )
