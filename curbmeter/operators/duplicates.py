"""Exact duplicates of whole rows in two phases.

All rows are compared by fingerprints of 64 bits, which is all that the first
shuffle carries. A row whose fingerprint occurs once has no copy. Only rows
whose fingerprint occurs again - copies, and rows that share it by chance - are
compared in full, so the result is exact whatever the fingerprints are.

Few repeated fingerprints are sent to every task as they are. Many are sent as a
bit map of bounded size: a row whose bit is not set has no copy, the others are
compared in full. So whole rows are shuffled only about as often as rows repeat.

The fingerprints cost scans to save a shuffle of whole rows. Where the plan's
size estimate says that this shuffle is small, it is taken instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.functions.values import is_float
from curbmeter.session import BROADCAST_BYTES, BROADCAST_ROWS, cut_lineage, estimated_bytes

# Inputs up to this estimated size are shuffled whole; an estimate is of compressed files, rows in a shuffle are larger.
WHOLE_BYTES = 64 << 20
MARK = "_mark0"
# Bits of the map for each repeated fingerprint: one other row in 32 at most is compared in full by chance.
BITS_PER_MARK = 32
# Words of 64 bits in one row of the map.
BLOCK_WORDS = 512


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def fingerprints(df: DataFrame, bits: int = 64) -> Column:
    """A hash of the whole row; equal rows have equal ones.

    Adding 0 makes one zero of the two that compare as equal. A hash skips
    nulls, so it also takes which columns are null. ``bits`` under 64 shortens
    it, for tests.
    """
    values = [F.col(f"`{c}`") + F.lit(0.0) if is_float(df, c) else F.col(f"`{c}`") for c in df.columns]
    mark = F.xxhash64(*[v.isNull() for v in values], *values)
    return (F.pmod(mark, F.lit(1 << min(bits, 62))) if bits < 64 else mark).alias(MARK)


def _marked(df: DataFrame, bits: int) -> DataFrame:
    return df.select("*", fingerprints(df, bits))


def _stored_marks(df: DataFrame, bits: int) -> DataFrame | None:
    """The fingerprints that occur more than once, stored; None if rows cannot be hashed.

    Runs a job: its shuffle has a fingerprint and a count per row, after copies
    in one task were folded.
    """
    if not all(_hashable(f.dataType) for f in df.schema):
        return None
    counts = df.select(fingerprints(df, bits)).groupBy(MARK).agg(F.count("*").alias("n"))
    return cut_lineage(counts.where("n > 1").select(MARK))


def repeated_marks(df: DataFrame, bits: int = 64) -> DataFrame | None:
    """The fingerprints that occur more than once; None if they are too many to send to every task, or rows cannot be hashed."""
    marks = _stored_marks(df, bits)
    return marks if marks is not None and marks.count() <= BROADCAST_ROWS else None


def _bit_map(marks: DataFrame, slots: int) -> DataFrame:
    """``(_block, _bits)``: the bits ``mark mod slots`` of all marks, every block of words in full."""
    zeros = marks.sparkSession.range(slots // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    slot = F.col(MARK).bitwiseAND(F.lit(slots - 1))
    ones = marks.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({MARK} & 63 AS int))").alias("bits"))
    words = zeros.unionAll(ones).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return words.groupBy(F.floor(F.col("word") / BLOCK_WORDS).alias("_block")).agg(
        F.transform(in_order, lambda w: w["bits"]).alias("_bits")
    )


def _parted(df: DataFrame, bits: int, whole_bytes: int) -> tuple | None:
    """Rows that have no copy and rows that may have one; None if all rows are to be compared in full."""
    if estimated_bytes(df) <= whole_bytes:
        return None
    marks = _stored_marks(df, bits)
    if marks is None:
        return None
    marked, many = _marked(df, bits), marks.count()

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(*[marked[f"`{c}`"] for c in df.columns])

    if many <= BROADCAST_ROWS:
        small = F.broadcast(marks)
        return plain(marked.join(small, MARK, "left_anti")), plain(marked.join(small, MARK, "left_semi"))
    # A power of two, at most as many bits as may be broadcast.
    slots = min(1 << max(many * BITS_PER_MARK - 1, BLOCK_WORDS * 64 - 1).bit_length(), BROADCAST_BYTES * 8)
    blocks = F.broadcast(cut_lineage(_bit_map(marks, slots)))
    slot = F.col(MARK).bitwiseAND(F.lit(slots - 1))
    word = F.shiftright(slot, 6)
    looked = marked.withColumn("_block", F.floor(word / BLOCK_WORDS)).join(blocks, "_block")
    bit = F.getbit(F.get("_bits", (word % BLOCK_WORDS).cast("int")), (slot % 64).cast("int"))
    return plain(looked.where(bit == 0)), plain(looked.where(bit == 1))


def distinct_rows(df: DataFrame, bits: int = 64, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One of each group of equal rows; nulls are equal, and so are NaNs.

    An input of at most ``whole_bytes`` by the plan's estimate, and one with a
    column that has no hash, is shuffled in full, with the same result.
    """
    parts = _parted(df, bits, whole_bytes)
    if parts is None:
        return df.dropDuplicates()
    single, several = parts
    return single.unionAll(several.dropDuplicates())


def extra_rows(df: DataFrame, bits: int = 64, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One row ``duplicates``: the rows beyond the first of each group of equal rows."""
    parts = _parted(df, bits, whole_bytes)
    rows = df if parts is None else parts[1]
    names = [F.col(f"`{c}`") for c in df.columns]
    groups = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0).cast("long")).alias("duplicates"))
