"""One mergeable state per column and group: moments, quantiles and ranges from two scans.

The first scan counts values in monotone buckets about 0.8 % wide and keeps
count, mean, squared deviations, least and largest value of each. States of
parts of a table merge by bucket, and a group and column has at most 191,000 of
them however many rows there are, so they are added up on the driver. They tell
the moments exactly, and for every rank and every value in which bucket it lies.

What depends on the values within a bucket - a quantile, the rows up to a cut -
needs that bucket only. All buckets that a report may need are known from the
state, the brackets of limits that follow from quantiles included, and the
second scan reads just these, as literals that reach the reader, and counts
them per value. These counts stay distributed: a rank is looked up in them by
even cells, 4096 per step, until a cell has one value.

This is for few groups, stated by a fixed list; for any number of groups there
is :func:`curbmeter.operators.quantiles.exact_quantiles`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from curbmeter.session import cut_lineage

STEPS = 128  # buckets per factor e
# Natural logarithms of doubles lie between -745 and 710.
LARGEST_LOG = 710.0
OFFSET = 746 * STEPS
CELLS = 4096
OPEN = math.inf


def bucket_of(value: Column) -> Column:
    magnitude = (
        F.floor(F.least(F.ln(F.abs(value)), F.lit(LARGEST_LOG)) * STEPS).cast("int") + OFFSET
    )
    return F.when(value == 0, 0).when(value > 0, magnitude).otherwise(-magnitude)


def tall(df: DataFrame, columns, by=()) -> DataFrame:
    """One row ``(*by, column, value)`` per row of ``df`` and named column, nulls included."""
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    if len(columns) == 1:
        return df.select(*by, F.lit(columns[0]).alias("column"), values[0].alias("value"))
    prepared = df.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(by)], *values)
    keys = [f"_key{i}" for i in range(len(by))]
    return prepared.unpivot(keys, list(columns), "column", "value").select(
        *[F.col(f"_key{i}").alias(k) for i, k in enumerate(by)], "column", "value"
    )


def without_null_keys(df: DataFrame, by) -> DataFrame:
    """Rows whose group is known; a null is no group in any of the forms."""
    for key in by:
        df = df.where(F.col(key).isNotNull())
    return df


def tall_values(df: DataFrame, columns, by) -> DataFrame:
    return tall(df, columns, by).where(F.col("value").isNotNull() & ~F.isnan("value"))


def within_column(df: DataFrame, column: str, low: float, high: float) -> Column:
    """``low <= column <= high``, as a comparison that the reader can push down where that is exact."""
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    whole = isinstance(kind, T.IntegralType)
    if isinstance(kind, (T.FloatType, T.DoubleType)) or whole and max(abs(low), abs(high)) < 2**53:
        ends = [F.lit(int(x) if whole else x).cast(kind) for x in (low, high)]
        return value.between(*ends)
    return value.cast("double").between(low, high)


def local_table(spark, rows: list, schema: T.StructType) -> DataFrame:
    """A few rows as a local table of the plan; from Arrow they take no job."""
    columns = zip(*rows) if rows else [()] * len(schema)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(name, kind()) for name, kind in kinds.items()])


SINGLE = _fields(part=T.IntegerType, value=T.DoubleType, n=T.LongType)
ASKED = _fields(ask=T.IntegerType, part=T.IntegerType, low=T.DoubleType, high=T.DoubleType)


@dataclass
class Buckets:
    """The buckets of one group and column, in ascending order of their ids."""

    id: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def count(self) -> int:
        return int(self.n.sum())


def merged(parts: list) -> Buckets:
    """The state of several parts together."""
    ids = np.concatenate([p.id for p in parts] or [np.zeros(0, np.int64)])
    id_, at = np.unique(ids, return_inverse=True)
    n, mean, m2, lo, hi = (np.concatenate([getattr(p, f) for p in parts] or [np.zeros(0)]) for f in ("n", "mean", "m2", "lo", "hi"))
    total = np.zeros(len(id_), np.int64)
    np.add.at(total, at, n.astype(np.int64))
    centre = np.bincount(at, n * mean, len(id_)) / np.maximum(total, 1)
    spread = np.bincount(at, m2 + n * (mean - centre[at]) ** 2, len(id_))
    low, high = np.full(len(id_), np.inf), np.full(len(id_), -np.inf)
    np.minimum.at(low, at, lo)
    np.maximum.at(high, at, hi)
    return Buckets(id_, total, centre, spread, low, high)


def moments(part: Buckets) -> tuple:
    """Count, mean, sample deviation, least and largest value."""
    n = part.count
    if n == 0:
        return 0, None, None, None, None
    mean = float((part.n * part.mean).sum() / n)
    m2 = float((part.m2 + part.n * (part.mean - mean) ** 2).sum())
    return n, mean, math.sqrt(m2 / (n - 1)) if n > 1 else None, float(part.lo[0]), float(part.hi[-1])


def bucket_state(values: DataFrame, keys: list) -> DataFrame:
    """``(*keys, bucket, n, mean, m2, lo, hi)`` of rows ``(*keys, value)``."""
    return values.withColumn("bucket", bucket_of(F.col("value"))).groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("*")).alias("m2"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )


def merged_state(states: DataFrame, keys: list) -> DataFrame:
    """One state of the states of any number of parts, in the same form, added up by Spark."""
    n, one_value = F.sum("n"), F.min("lo") == F.max("hi")
    squares = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    total = F.sum(F.col("n") * F.col("mean"))
    return states.groupBy(*keys, "bucket").agg(
        n.alias("n"),
        F.when(one_value, F.min("lo")).otherwise(total / n).alias("mean"),
        F.when(one_value, 0.0).otherwise(F.greatest(squares - total * total / n, F.lit(0.0))).alias("m2"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )


class Distribution:
    """Exact numbers about a few columns, in total or for a few groups.

    Ask for the buckets that will be needed (``want_rank``, ``want_range``),
    ``read`` them, then look up (``quantiles``, ``within``). Groups with a null
    key are left out; so are nulls and NaN.
    """

    def __init__(self, df: DataFrame, columns, by=(), state: DataFrame | None = None):
        """``state``, as by :func:`bucket_state`, is passed where it was made before; then the first scan is saved."""
        self.df, self.columns, self.by = without_null_keys(df, by), list(columns), list(by)
        self.keys = [*self.by, "column"]
        state = bucket_state(tall_values(self.df, self.columns, self.by), self.keys) if state is None else state
        rows = state.toArrow().to_pydict()
        found: dict = {}
        for i, key in enumerate(zip(*(rows[k] for k in self.keys))):
            found.setdefault(key, []).append(i)
        fields = {f: np.array(rows[f], np.int64 if f in ("bucket", "n") else float) for f in ("bucket", "n", "mean", "m2", "lo", "hi")}
        self.parts: dict = {}
        for key in sorted(found, key=str):
            at = np.array(found[key])
            at = at[np.argsort(fields["bucket"][at])]
            self.parts[key] = Buckets(*[fields[f][at] for f in fields])
        self.number = {key: i for i, key in enumerate(self.parts)}
        self.wanted = {c: set() for c in self.columns}
        self.fine: DataFrame | None = None

    def groups(self, column: str) -> list:
        return [key for key in self.parts if key[-1] == column]

    def state(self, keys: list) -> Buckets:
        return self.parts[keys[0]] if len(keys) == 1 else merged([self.parts[k] for k in keys])

    @staticmethod
    def ranks(n: int, p: float) -> tuple:
        """The two ranks that a quantile lies between, and how far beyond the first one."""
        at = float(p) * (n - 1)
        return math.floor(at), math.ceil(at), at - math.floor(at)

    def _bucket_at(self, state: Buckets, rank: int) -> tuple:
        past = np.cumsum(state.n)
        i = int(np.searchsorted(past, rank, "right"))
        return i, rank - int(past[i] - state.n[i])

    def want_rank(self, keys: list, first: int, last: int | None = None) -> tuple:
        """Read the buckets from one rank to another; returns the least and largest value that these ranks can have."""
        state = self.state(keys)
        i, j = (self._bucket_at(state, rank)[0] for rank in (first, first if last is None else last))
        self.wanted[keys[0][-1]].update(state.id[i : j + 1].tolist())
        return float(state.lo[i]), float(state.hi[j])

    def want_quantile(self, keys: list, p: float) -> tuple:
        low, high, _ = self.ranks(self.state(keys).count, p)
        return self.want_rank(keys, low, high)

    def want_range(self, keys: list, low: float, high: float) -> None:
        """Read the buckets that have values between two numbers."""
        state = self.state(keys)
        self.wanted[keys[0][-1]].update(state.id[(state.hi >= low) & (state.lo <= high)].tolist())

    def read(self) -> None:
        """The second scan: count the values of all wanted buckets that have more than one; none if there are no such."""
        spark = self.df.sparkSession
        single, ranges = [], []
        for column, ids in self.wanted.items():
            whole = self.state(self.groups(column)) if self.groups(column) else None
            ends = []
            for i in np.flatnonzero(np.isin(whole.id, list(ids))) if ids else []:
                if whole.lo[i] == whole.hi[i]:
                    for key in self.groups(column):
                        part = self.parts[key]
                        here = np.flatnonzero(part.id == whole.id[i])
                        single += [(self.number[key], float(part.lo[k]), int(part.n[k])) for k in here]
                # Buckets that follow each other are one range.
                elif ends and ends[-1][2] == i - 1:
                    ends[-1][1:] = [float(whole.hi[i]), i]
                else:
                    ends.append([float(whole.lo[i]), float(whole.hi[i]), i])
            ranges += [(column, low, high) for low, high, _ in ends]
        known = local_table(spark, single, SINGLE)
        if not ranges:
            self.fine = known
            return
        inside = reduce(Column.__or__, [within_column(self.df, *r) for r in ranges])
        rows = tall_values(self.df.where(inside), self.columns, self.by)
        exact = reduce(Column.__or__, [(F.col("column") == c) & F.col("value").between(low, high) for c, low, high in ranges])
        counted = rows.where(exact).groupBy(*self.keys, "value").agg(F.count("*").alias("n"))
        fields = [*[self.df.schema[k] for k in self.by], T.StructField("column", T.StringType()), T.StructField("part", T.IntegerType())]
        numbers = local_table(spark, [(*key, i) for key, i in self.number.items()], T.StructType(fields))
        # One row per group and column.
        counted = counted.join(F.broadcast(numbers), self.keys).select("part", "value", "n")
        self.fine = cut_lineage(counted.unionAll(known))

    def _asked(self, intervals: list) -> DataFrame:
        """The counted values in each of the intervals ``(keys, low, high)``, with its number ``ask``."""
        rows = [(i, self.number[key], low, high) for i, (keys, low, high) in enumerate(intervals) for key in keys]
        asked = local_table(self.df.sparkSession, rows, ASKED)
        return self.fine.join(F.broadcast(asked), "part").where(F.col("value").between(F.col("low"), F.col("high")))

    def at_ranks(self, requests: list) -> list:
        """The value at each ``(keys, rank)``; its bucket must have been read."""
        states = [self.state(keys) for keys, _ in requests]
        places = [self._bucket_at(state, rank) for state, (_, rank) in zip(states, requests)]
        ends = [[float(state.lo[i]), float(state.hi[i])] for state, (i, _) in zip(states, places)]
        left = [rank for _, rank in places]
        while open_ := [i for i, (low, high) in enumerate(ends) if low < high]:
            # Least and largest value are in different cells, infinite ones too, so every step narrows.
            share = F.nanvl((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.5))
            share = F.when(F.col("value") <= F.col("low"), 0.0).when(F.col("value") >= F.col("high"), 1.0).otherwise(share)
            cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("cell")
            rows = self._asked([(requests[i][0], *ends[i]) for i in open_]).groupBy("ask", cell)
            rows = rows.agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).toArrow().to_pydict()
            ask, cells, n, lo, hi = (np.array(rows[c]) for c in ("ask", "cell", "n", "lo", "hi"))
            for k, i in enumerate(open_):
                here = np.flatnonzero(ask == k)
                here = here[np.argsort(cells[here])]
                past = np.cumsum(n[here])
                j = int(np.searchsorted(past, left[i], "right"))
                left[i] -= int(past[j] - n[here[j]])
                ends[i] = [float(lo[here[j]]), float(hi[here[j]])]
        return [low for low, _ in ends]

    def quantiles(self, requests: list) -> list:
        """The quantile of each ``(keys, p, n)`` among its first ``n`` values (all if None), interpolated."""
        places = [self.ranks(self.state(keys).count if n is None else n, p) for keys, p, n in requests]
        found = self.at_ranks([(keys, rank) for (keys, _, _), at in zip(requests, places) for rank in at[:2]])
        pairs = zip(found[::2], found[1::2], places)
        return [low if low == high else low + (high - low) * at[2] for low, high, at in pairs]

    def within(self, intervals: list) -> list:
        """Count, sum, least and largest value in each ``(keys, low, high)``; buckets that an end cuts must have been read."""
        out, cuts = [], []
        for i, (keys, low, high) in enumerate(intervals):
            state = self.state(keys)
            whole = (state.lo >= low) & (state.hi <= high)
            touched = ~whole & (state.hi >= low) & (state.lo <= high)
            lo, hi = state.lo[whole], state.hi[whole]
            out.append([int(state.n[whole].sum()), float((state.n * state.mean)[whole].sum()), *((lo[0], hi[-1]) if len(lo) else (OPEN, -OPEN))])
            cuts += [(i, keys, max(low, float(state.lo[k])), min(high, float(state.hi[k]))) for k in np.flatnonzero(touched)]
        if cuts:
            rows = self._asked([cut[1:] for cut in cuts]).groupBy("ask")
            rows = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            for row in rows.collect():
                one = out[cuts[row["ask"]][0]]
                one[:] = [one[0] + row["n"], one[1] + row["s"], min(one[2], row["lo"]), max(one[3], row["hi"])]
        return [tuple(o) for o in out]


def below(x: float) -> float:
    """The largest number under ``x``."""
    return math.nextafter(x, -math.inf)


def above(x: float) -> float:
    """The smallest number over ``x``."""
    return math.nextafter(x, math.inf)


def fence_brackets(q1: tuple, q3: tuple) -> tuple:
    """Between which numbers the fences 1.5 interquartile ranges beyond the quartiles lie, from brackets of the quartiles."""
    widest, least = q3[1] - q1[0], max(0.0, q3[0] - q1[1])
    return (q1[0] - 1.5 * widest, q1[1] - 1.5 * least), (q3[0] + 1.5 * least, q3[1] + 1.5 * widest)


def fences(q1: float, q3: float) -> tuple:
    """Interquartile range and the fences."""
    spread = q3 - q1
    return spread, q1 - 1.5 * spread, q3 + 1.5 * spread
