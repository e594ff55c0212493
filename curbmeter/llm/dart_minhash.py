"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text is a weighted set: its shingles of five words with their counts. Every
unit of weight of a shingle is a region at which darts are thrown; where they
land is a hash of the shingle and the unit, so equal regions of two texts get
equal darts. A dart has a time and one of K coordinates, and a signature keeps
the earliest dart of each coordinate. Two signatures agree in a coordinate with
a probability equal to the weighted Jaccard similarity. Only darts before a
time that grows as a text gets smaller are thrown, about K ln K + 2 K of them
however long the text is; a text with an empty coordinate is thrown again with
twice the time.

Texts that agree in a band of coordinates share a bucket. No bucket lists its
pairs. Its members are first compared with one pivot; that links the bulk of a
large group of copies with as many comparisons as it has members. Only members
that are still outside the largest class of their bucket are then compared
with all of its members, in blocks inside tasks that give back the links that
join classes. After that every pair that shares a bucket is either compared or
in one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.llm.components import connected_components
from curbmeter.llm.shared import free_name, store
from curbmeter.llm.words import BASE, give_back_memory, gram_hashes, list_array, mix, room_after, text_chunks, word_hashes
from curbmeter.session import broadcast_if_small

SHINGLE = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 shares none of 32 bands of 6 with probability 6e-5; one of 0.3 shares one with 2 %.
BANDS = 32
ROWS = 6
# Of 192 one-bit sketches a pair of similarity 0.8 differs in 19 on average (deviation 4.2).
MOST_DIFFERENT_BITS = 38
# Cells that a task compares at once (4 MB), and numbers in one of its matrices.
BLOCK_CELLS = 1 << 19
MATRIX = 1 << 20
SIGNED = "cid bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>"
_GOLD = np.uint64(BASE)


def cells(words: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit regions of each text's shingles as hashes, and the text of each.

    The i-th occurrence of a shingle is its i-th unit of weight. A text of
    fewer than five words, but not none, is one shingle.
    """
    counts = np.diff(word_offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    room = room_after(word_offsets)
    grams = gram_hashes(words, SHINGLE)
    at = np.flatnonzero(room[: len(grams)] >= SHINGLE)
    hashes, rows = [grams[at]], [row[at]]
    for n in range(1, SHINGLE):
        few = word_offsets[:-1][counts == n]
        if len(few):
            short = gram_hashes(words, n)
            hashes.append(short[few])
            rows.append(row[few])
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if len(hashes) == 0:
        return hashes, rows
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    unit = (np.arange(len(hashes)) - start).astype(np.uint64)
    return mix(hashes + unit * _GOLD), rows


def _throw(regions, rows, limit, k, times, darts) -> None:
    """Throw darts at regions until ``limit`` of their text; lower ``times`` and set ``darts`` where earlier.

    Arrivals at a region are a Poisson process of rate 1 whose steps are hashes
    of the region and the arrival's number.
    """
    now = np.zeros(len(regions))
    number = 0
    least = limit.min(initial=np.inf)
    while len(regions):
        # Several arrivals at once where each region gets many.
        block = int(max(1, min(least if number == 0 else least / 3, 1024, (1 << 19) // len(regions))))
        numbers = np.arange(number + 1, number + 1 + block, dtype=np.uint64) * _GOLD
        dart = mix(regions[:, None] ^ mix(numbers)[None, :])
        step = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        when = now[:, None] + np.cumsum(step, axis=1)
        i, j = np.nonzero(when < limit[:, None])
        thrown, at = dart[i, j], when[i, j]
        name = mix(thrown + np.uint64(1))
        place = rows[i] * k + ((name >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(times, place, at)
        won = times[place] == at
        darts[place[won]] = name[won]
        now = when[:, -1]
        go = now < limit
        regions, rows, limit, now = regions[go], rows[go], limit[go], now[go]
        number += block


def signatures(regions: np.ndarray, rows: np.ndarray, n_rows: int, k: int = BANDS * ROWS) -> np.ndarray:
    """``n_rows`` × ``k`` earliest darts; rows without regions are 0."""
    times = np.full(n_rows * k, np.inf)
    darts = np.zeros(n_rows * k, np.uint64)
    weight = np.bincount(rows, minlength=n_rows)
    expected = k * np.log(k) + 2 * k
    todo = weight > 0
    while todo.any():
        # Texts of like size have like limits, so they take like numbers of rounds.
        size = np.frexp(np.maximum(weight, 1))[1]
        for s in np.unique(size[todo]):
            pick = (todo & (size == s))[rows]
            _throw(regions[pick], rows[pick], expected / weight[rows[pick]], k, times, darts)
        todo &= ~np.isfinite(times).reshape(n_rows, k).all(axis=1)
        expected *= 2
    return darts.reshape(n_rows, k)


def _sign_texts(texts: pa.Array) -> pa.Array:
    columns = [[], [], [], [], []]
    for data, offsets in text_chunks(texts):
        words, at = word_hashes(data, offsets)
        n, counts = len(at) - 1, np.diff(at)
        some = counts > 0
        regions, rows = cells(words, at)
        darts = signatures(regions, rows, n)
        # The text's identity: all its words in order.
        place = (np.arange(len(words)) - np.repeat(at[:-1], counts)).astype(np.uint64)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + place * _GOLD), out=sums[1:])
        cid = mix(sums[at[1:]] - sums[at[:-1]] + counts.astype(np.uint64)).view(np.int64)
        bits = np.packbits((darts & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
        band = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :]
        split = darts.reshape(n, BANDS, ROWS)
        for i in range(ROWS):
            band = mix(band * _GOLD + split[:, :, i])
        columns[0].append(pa.array(cid, mask=~some))
        for i in range(3):
            columns[1 + i].append(pa.array(np.ascontiguousarray(bits[:, i])))
        keys = pa.array(band[some].reshape(-1).view(np.int64))
        columns[4].append(list_array(np.repeat(np.flatnonzero(some), BANDS), n, keys))
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    arrays = [pa.concat_arrays(c) if c else pa.array([], t) for c, t in zip(columns, types)]
    return pa.StructArray.from_arrays(arrays, names=["cid", "s1", "s2", "s3", "bands"])


def _cells_of_texts(texts: pa.Array) -> pa.Array:
    out = []
    for data, offsets in text_chunks(texts):
        regions, rows = cells(*word_hashes(data, offsets))
        out.append(list_array(rows, len(offsets) - 1, pa.array(regions.view(np.int64))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def _arrow(function, kind):
    def run(texts: pa.Array) -> pa.Array:
        return function(texts)

    return F.arrow_udf(run, kind)


def text_key(text_col: str):
    """A key of the exact text; a null is an empty text."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _differing_bits(a: str, b: str):
    return sum(F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in (1, 2, 3))


def _cells_of(needed: DataFrame, signed: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``cid, cells`` for the text ids in ``needed(cid)``, from their texts in ``docs``."""
    # One of the texts with this id will do: they have the same words.
    texts = signed.join(broadcast_if_small(store(needed, "needed")), "cid", "left_semi").groupBy("cid").agg(F.min("tk").alias("tk"))
    found = (
        docs.select(text_key(text_col).alias("tk"), F.col(text_col).alias("text"))
        .join(broadcast_if_small(store(texts, "texts")), "tk")
        .groupBy("cid")
        .agg(F.first("text").alias("text"))
    )
    return store(found.select("cid", _arrow(_cells_of_texts, "array<bigint>")("text").alias("cells")), "cells")


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs ``a, b`` of text ids whose weighted Jaccard similarity is at least 0.8."""
    pairs = store(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    sets = _cells_of(needed, signed, docs, text_col)
    both = (
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("cells").alias("ca")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("cells").alias("cb")), "b")
        .withColumn("shared", F.size(F.array_intersect("ca", "cb")))
    )
    total = F.size("ca") + F.size("cb") - F.col("shared")
    return store(both.where(F.col("shared") >= SIMILARITY * total).select("a", "b"), "verified")


def shared_cells(values: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many cells each of the texts ``left`` shares with each of ``right``; exact."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1  # a cell of one text is shared with none
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    shared = np.zeros((len(left), len(right)), np.float32)
    width = max(1, MATRIX // max(n, 1))
    for low in range(0, int(column.max(initial=-1)) + 1, width):
        here = slice(*np.searchsorted(column, [low, low + width]))
        matrix = np.zeros((n, width), np.float32)
        matrix[owner[here], column[here] - low] = 1
        shared += matrix[left] @ matrix[right].T
    return shared


def _compare_block(block: pa.Table) -> pa.Table:
    """Links that join classes, ``a, b``, between the asked and the other texts of each bucket in the block."""
    block = block.combine_chunks()
    key, cid, component = (block[c].to_numpy() for c in ("key", "cid", "component"))
    asked = block["asked"].to_numpy(zero_copy_only=False)
    lists = block["cells"].chunk(0) if block.num_rows else pa.array([], pa.list_(pa.int64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    weight = np.diff(offsets)
    above: dict = {}

    def top(x):
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    out = []
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        left, right = np.flatnonzero(asked[rows]), np.flatnonzero(~asked[rows])
        if len(left) == 0 or len(right) == 0:
            continue
        taken = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), weight[rows])
        shared = shared_cells(values[taken], owner, len(rows), left, right)
        total = weight[rows[left]][:, None] + weight[rows[right]][None, :] - shared
        near = (shared >= SIMILARITY * total) & (component[rows[left]][:, None] != component[rows[right]][None, :])
        for i, j in zip(*np.nonzero(near)):
            x, y = rows[left[i]], rows[right[j]]
            a, b = top(component[x]), top(component[y])
            if a != b:
                above[max(a, b)] = min(a, b)
                out.append((cid[x], cid[y]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _links_between_classes(mixed: DataFrame, signed: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Links of similarity 0.8 or more that join classes, from ``mixed(key, cid, component, main)``.

    Members outside a bucket's main class are asked; each is compared with all
    members of its bucket, exactly and inside a task, which gives back only as
    many links as join classes. A block of a task holds a bounded number of
    cells: small buckets share a block, large ones are cut into blocks of asked
    and of all members, and every block of the one meets every block of the other.
    """
    sets = _cells_of(mixed.select("cid").distinct(), signed, docs, text_col)
    weights = mixed.join(sets.select("cid", F.size("cells").alias("n")), "cid")
    outside = F.col("component") != F.col("main")
    totals = store(
        weights.groupBy("key").agg(F.sum("n").alias("cells"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("asked_cells")),
        "totals",
    )
    everything = totals.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
    bundles = everything // BLOCK_CELLS + 1
    parts = totals.select(
        "key",
        F.ceil(F.col("cells") / BLOCK_CELLS).cast("int").alias("parts"),
        F.ceil(F.col("asked_cells") / BLOCK_CELLS).cast("int").alias("asked_parts"),
    )
    placed = mixed.join(parts, "key")
    bundle = F.pmod(F.xxhash64("key"), F.lit(bundles)).alias("bundle")

    def part(of: str):
        return F.pmod(F.xxhash64("cid", "key"), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    columns = ["key", "cid", "component"]
    members = placed.select(*columns, bundle, part("parts").alias("part"), every("asked_parts").alias("asked_part"), F.lit(False).alias("asked"))
    asked = placed.where(outside).select(*columns, bundle, every("parts").alias("part"), part("asked_parts").alias("asked_part"), F.lit(True).alias("asked"))
    rows = members.unionByName(asked).join(sets, "cid")

    def compare(block: pa.Table) -> pa.Table:
        links = _compare_block(block)
        give_back_memory()
        return links

    return rows.groupBy("bundle", "part", "asked_part").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, class_id, class_size, tk``.

    Two texts are linked when the weighted Jaccard similarity of their 5-word
    shingles is at least 0.8; classes are the components of the links.
    ``class_id`` is the smallest id of the class, ``class_size`` its rows,
    ``tk`` the key of the exact text. Copies with the same words are one text
    from the start. Texts without words, null ones too, take no part: each such
    row is its own class. A null id is smaller than none: a class of only null
    ids has a null ``class_id``. Repeated rows are copies. Empty tables give no
    rows; other columns are not read.
    """
    sign = _arrow(_sign_texts, SIGNED)
    signed = store(
        docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), sign(F.col(text_col)).alias("s")).select(
            "id", "tk", "s.*"
        ),
        "signed",
    )
    names = ["cid", "s1", "s2", "s3"]
    texts = signed.where("cid is not null").groupBy("cid").agg(
        *[F.min(s).alias(s) for s in names[1:]], F.first("bands").alias("bands")
    )
    texts = store(texts, "texts")
    rows = texts.select(F.explode("bands").alias("key"), "cid")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("pivot")).where("n > 1").drop("n")
    members = store(rows.join(shared, "key").select("key", "cid", "pivot"), "members")
    sketches = texts.select(*names)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches differ in few enough bits."""
        return (
            pairs.alias("p")
            .join(sketches.alias("x"), F.col("p.a") == F.col("x.cid"))
            .join(sketches.alias("y"), (F.col("p.b") == F.col("y.cid")) & (_differing_bits("x", "y") <= MOST_DIFFERENT_BITS))
            .select("p.a", "p.b")
        )

    stars = members.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    links = _verified(near(stars), signed, docs, text_col)
    classes = connected_components(links)

    # Members outside the largest class of their bucket meet those of other classes.
    named = members.select("key", "cid").join(classes.withColumnRenamed("node", "cid"), "cid", "left")
    named = store(named.select("key", "cid", F.coalesce("component", "cid").alias("component")), "named")
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("classes")
    )
    mixed = store(named.join(largest.where("classes > 1").drop("classes"), "key"), "mixed")
    more = store(_links_between_classes(mixed, signed, docs, text_col), "more")
    if not more.isEmpty():
        classes = connected_components(links.union(more))

    placed = signed.select("id", "tk", "cid").join(classes.withColumnRenamed("node", "cid"), "cid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "cid"))
    known = placed.where("component is not null").groupBy("component").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )
    return placed.join(known, "component", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.col("component").alias("component"),
        "tk",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicates`, that of the smallest id; all columns.

    Of rows that agree in id and text one is kept. Texts without words stay.
    """
    classed = store(near_duplicates(docs, id_col, text_col).where("class_size > 1"), "classed")
    row = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "tk")
    keepers = classed.groupBy("component").agg(F.min(row).alias("kept"))
    place = classed.groupBy("component", F.col(id_col).alias("id"), "tk").agg(F.count(F.lit(1)).alias("n"))
    judged = store(
        place.join(keepers, "component").select(
            "id", "tk", "n", (F.col("kept.id").eqNullSafe(F.col("id")) & (F.col("kept.tk") == F.col("tk"))).alias("keep")
        ),
        "judged",
    )
    mark = free_name(docs, "text_key")
    keyed = docs.withColumn(mark, text_key(text_col))

    def meets(other: DataFrame, how: str, left: DataFrame) -> DataFrame:
        ids = broadcast_if_small(other.select(F.col("id").alias("_id"), F.col("tk").alias("_tk")))
        return left.join(ids, (F.col("_tk") == left[mark]) & F.col("_id").eqNullSafe(left[id_col]), how)

    left = meets(judged.where("not keep"), "left_anti", keyed)
    repeated = judged.where("keep and n > 1")
    if not repeated.isEmpty():
        once = meets(repeated, "left_semi", left).dropDuplicates([id_col, mark])
        left = meets(repeated, "left_anti", left).unionByName(once)
    return left.drop(mark)
