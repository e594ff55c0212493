"""The most frequent of an unbounded number of keys, proven from counts of hash buckets.

A plain count shuffles a row per key and task. Here a first scan counts rows per
bucket of the key's hash, whose number is fixed. A key has at most as many rows
as its bucket, so keys are counted only in the largest buckets: the last of the
best ``top`` keys found there has ``t`` rows, and every key with ``t`` rows or
more lies in a bucket with ``t`` or more. If all such buckets were counted, the
answer is proven; if not, they are counted in one more scan, which proves it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.session import cut_lineage

# At most this many rows per task are shuffled by the first scan, and come to the driver.
BUCKETS = 1 << 16
# Buckets that the second scan counts per wanted key.
WIDTH = 4
# Longer lists of buckets become a table instead of a list in the filter.
LISTED = 1000


def _in_buckets(df: DataFrame, wanted: list) -> DataFrame:
    """Rows whose ``bucket`` is one of the list; the list has at most ``BUCKETS`` entries."""
    if len(wanted) <= LISTED:
        return df.where(F.col("bucket").isin(wanted))
    some = df.sparkSession.createDataFrame([(int(b),) for b in wanted], "bucket long")
    return df.join(F.broadcast(some), "bucket", "left_semi")


def top_keys(df: DataFrame, *keys: str, top: int = 10, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """``(*keys, trips)``: the ``top`` keys with the most rows, ties to the smaller key, as by ``top_groups``.

    Rows with a null in a key are left out; fewer keys than ``top`` are all
    returned. Takes two scans, at the call, where the last wanted key has more
    rows than the largest bucket that was left out, and three otherwise. Where
    keys are so even that no bucket can be left out, the third counts them all.
    """
    known = reduce(lambda rows, key: rows.where(F.col(key).isNotNull()), keys, df)
    # Scans read the keys only.
    rows = known.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"))
    counted = rows.groupBy("bucket").agg(F.count("*").alias("n")).toArrow()
    ids, n = (np.array(counted[c], np.int64) for c in ("bucket", "n"))
    order = np.argsort(-n, kind="stable")
    ids, n = ids[order], n[order]

    def best(count: int) -> DataFrame:
        """The best keys of the ``count`` largest buckets."""
        chosen = _in_buckets(rows, ids[:count].tolist()).groupBy(*keys).agg(F.count("*").alias("trips"))
        # At most ``top`` rows are kept.
        return cut_lineage(chosen.orderBy(F.desc("trips"), *keys).limit(top))

    taken = min(max(width * top, 1), len(ids))
    found = best(taken)
    sizes = [row["trips"] for row in found.select("trips").collect()]
    least = min(sizes) if len(sizes) == top else 1
    needed = int(np.count_nonzero(n >= least))
    return found if needed <= taken else best(needed)
