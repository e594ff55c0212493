"""Deal rows to shards of bounded bytes by extendible hashing.

Rows hash to 60 bits. The directory starts with one bucket; a bucket over the
limit, and only that, splits on its next bit. Sizes are summed per prefix of
the hash, 15 bits at a time, so the whole directory comes from few aggregations
and its tables are bounded by the number of shards, not of rows. The directory
is made from hashes and sizes alone, which one read of the texts writes to a
table; a second read deals the rows.

Rows whose first hashes are equal throughout (one id that is repeated very
often) go on with a hash of their text, then of the row's number, each such
bucket by itself. Rows are numbered in a written table, so that the numbers
stay the same when an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.llm.shared import free_name, store
from curbmeter.session import broadcast_if_small

LIMIT = 16 << 20
BITS = 60
STEP = 15


def _bits(column):
    """The first 60 bits of the MD5 of a string column."""
    return F.conv(F.substring(F.md5(F.coalesce(column, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(name: str, n: int):
    return F.shiftright(F.col(name), BITS - n)


def directory_step(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """``before, prefix, depth, shard_bytes`` for every bucket ``before`` and prefix of ``base + 15`` bits among ``rows(before, hash, bytes)``.

    ``depth`` is the least number of bits from ``base`` on at which the bucket
    fits; null where it does not fit with all of them.
    """
    end = base + STEP
    sums = store(rows.groupBy("before", _prefix("hash", end).alias("prefix")).agg(F.sum("bytes").alias("bytes")), "sums")
    # One row for each prefix of each length: at most 16 times as many as full prefixes.
    levels = sums.select("before", "prefix", "bytes", F.explode(F.sequence(F.lit(base), F.lit(end))).alias("depth"))
    bucket = F.expr(f"shiftright(prefix, {end} - depth)")
    totals = levels.groupBy("before", "depth", bucket.alias("bucket")).agg(F.sum("bytes").alias("total"))
    fits = levels.withColumn("bucket", bucket).join(totals.where(F.col("total") <= limit), ["before", "depth", "bucket"])
    least = fits.groupBy("before", "prefix").agg(F.min(F.struct("depth", "total")).alias("x"))
    return sums.select("before", "prefix").join(least, ["before", "prefix"], "left").select(
        "before", "prefix", F.col("x.depth").alias("depth"), F.col("x.total").alias("shard_bytes")
    )


def still_open(rows: DataFrame, step: DataFrame, base: int) -> DataFrame:
    """Those of ``rows(before, hash, bytes)`` whose bucket fits at no depth of ``step``, with the bucket's name so far."""
    full = broadcast_if_small(step.where("depth is null").select("before", "prefix"))
    bits = F.lpad(F.bin(F.expr(f"prefix % {1 << STEP}")), STEP, "0")
    rows = rows.withColumn("prefix", _prefix("hash", base + STEP)).join(full, ["before", "prefix"])
    return rows.select(F.concat("before", bits).alias("before"), "hash", "bytes")


def assign_shards(
    docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs``, all columns, with ``shard``, ``n_bytes`` and ``shard_bytes``.

    A shard is named by its bits, '' if one holds everything; its texts have at
    most ``limit`` bytes. A text that is larger alone has a shard of its own,
    named ``own-`` and its hash. Null ids hash as '', null texts have 0 bytes;
    repeated rows stay rows; an empty table stays empty. Columns of ``docs``
    that have a new column's name keep it, and the new one gets an underscore.
    """
    names = {}
    for wanted in ("shard", "n_bytes", "shard_bytes", "row", "hash", "found", "prefix"):
        names[wanted] = free_name(docs, wanted)
    shard, n_bytes, total, row, hash_, found, prefix = names.values()
    out = docs.withColumn(n_bytes, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    out = out.withColumn(shard, F.lit("")).withColumn(total, F.lit(None).cast("long"))
    out = out.withColumn(found, F.col(n_bytes) > limit)
    keys = [
        F.col(id_col).cast("string"),
        F.concat_ws(" ", F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary"))),
        F.col(row).cast("string"),
    ]
    finished, dealt = False, []
    for key in keys:
        if key is keys[-1]:
            # Copies of one text beyond the limit: only these rows are written, with their numbers.
            dealt.append(out.where(found).drop(hash_))
            out = store(out.where(~F.col(found)).withColumn(row, F.monotonically_increasing_id()), "copies")
        out = out.withColumn(hash_, _bits(key))
        rows = store(
            out.where(~F.col(found)).select(
                F.col(shard).alias("before"), F.col(hash_).alias("hash"), F.col(n_bytes).alias("bytes")
            ),
            "sizes",
        )
        for base in range(0, BITS, STEP):
            step = store(directory_step(rows, base, limit), "directory")
            here = broadcast_if_small(step.select(F.col("before").alias(shard), F.col("prefix").alias(prefix), "depth", F.col("shard_bytes").alias("fit")))
            out = out.withColumn(prefix, F.when(~F.col(found), _prefix(hash_, base + STEP)))
            out = out.join(here, [shard, prefix], "left")
            # All bits from base on, or as many as the bucket needs.
            end = F.coalesce("depth", F.lit(base + STEP))
            bits = F.lpad(F.bin(F.expr(f"shiftright(`{prefix}`, {base + STEP} - cast(coalesce(depth, {base + STEP}) as int))")), end.cast("int"), "0")
            bits = F.substring(bits, F.lit(base + 1), end.cast("int") - base)
            is_open = ~F.col(found)
            out = (
                out.withColumn(shard, F.when(is_open & (end > base), F.concat(shard, bits)).otherwise(F.col(shard)))
                .withColumn(total, F.when(is_open, F.col("fit")).otherwise(F.col(total)))
                .withColumn(found, F.col(found) | F.col("depth").isNotNull())
                .drop("depth", "fit", prefix)
            )
            if step.where("depth is null").isEmpty():
                finished = True
                break
            rows = still_open(rows, step, base)
        if finished:
            break
    for part in dealt:
        out = out.drop(row, hash_).unionByName(part)
    alone = F.col(n_bytes) > limit
    number = F.monotonically_increasing_id().cast("string").cast("binary")
    out = out.withColumn(shard, F.when(alone, F.concat(F.lit("own-"), F.md5(number))).otherwise(F.col(shard)))
    out = out.withColumn(total, F.when(alone, F.col(n_bytes)).otherwise(F.col(total)))
    return out.select(*docs.columns, shard, n_bytes, total)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet with one folder per shard; a shard is one task's work."""
    sharded = assign_shards(docs, limit, id_col, text_col)
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
