"""The most frequent keys against a plain count, with even keys, ties, nulls and few buckets."""

import pytest
from pyspark.sql import functions as F

from curbmeter.operators import heavy
from curbmeter.operators.demand import top_groups


def both(df, *keys, **options):
    want = [tuple(r) for r in top_groups(df, *keys, top=options["top"]).collect()]
    return [tuple(r) for r in heavy.top_keys(df, *keys, **options).collect()], want


def skewed(spark, rows=60_000):
    """Key k has about rows / k**2 rows, and half of all rows have keys of their own."""
    x = F.col("id")
    key = F.when(x % 2 == 0, F.floor(F.sqrt(F.lit(rows) / (x / 2 + 1)))).otherwise(-x).cast("long")
    return spark.range(rows).select(key.alias("a"), (key % 3).alias("b"))


@pytest.mark.parametrize("buckets", [1, 64, 1 << 16])
@pytest.mark.parametrize("top", [1, 10, 300])
def test_equal_to_a_plain_count(spark, buckets, top):
    got, want = both(skewed(spark), "a", "b", top=top, buckets=buckets)
    assert got == want


def test_two_scans_where_the_counts_prove_it_and_three_otherwise(spark, monkeypatch):
    scans = []
    monkeypatch.setattr(heavy, "cut_lineage", lambda df: scans.append(df) or df)
    hot = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5).otherwise(F.col("id")).alias("a"))
    got, want = both(hot, "a", top=5, buckets=4096)
    assert got == want and len(scans) == 1
    even = spark.range(50_000).select((F.col("id") % 10_000).alias("a"))
    got, want = both(even, "a", top=5, buckets=4096)
    assert got == want and len(scans) == 3


def test_few_keys_shuffle_of_many(spark):
    """The keys that are counted are a small part of all."""
    rows = skewed(spark, 400_000)
    kept = []
    plain = heavy._in_buckets
    heavy._in_buckets = lambda df, wanted: kept.append(plain(df, wanted)) or kept[-1]
    try:
        got, want = both(rows, "a", top=10)
    finally:
        heavy._in_buckets = plain
    assert got == want and len(kept) == 1
    assert kept[0].select("a").distinct().count() < 0.01 * rows.select("a").distinct().count()


def test_nulls_ties_texts_and_empty_tables(spark):
    rows = [(None, "x"), (None, "x"), ("b", None), ("b", "x"), ("a", "x"), ("", "é"), ("", "é")]
    df = spark.createDataFrame(rows, "k string, trips string")
    got, want = both(df.withColumnRenamed("trips", "v"), "k", "v", top=2)
    assert got == want == [("", "é", 2), ("a", "x", 1)]
    assert heavy.top_keys(df, "k", top=9).count() == 3
    assert heavy.top_keys(df.limit(0), "k", top=9).collect() == []
