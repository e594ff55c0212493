"""Fares and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.functions.timing import with_clock
from curbmeter.functions.values import mean, payment_label, percent, ratio_percent
from curbmeter.operators.buckets import OPEN, Distribution, fence_brackets, fences, local_table, moments
from curbmeter.operators.demand import hour_grid, with_key
from curbmeter.operators.profile import quartile_table
from curbmeter.operators.quantiles import quantile_limits
from curbmeter.operators.sampling import fixed_sample
from curbmeter.schema import (
    DISTANCE,
    DROPOFF_TIME,
    DROPOFF_ZONE,
    FARE,
    PASSENGERS,
    PAYMENT,
    PICKUP_TIME,
    PICKUP_ZONE,
    TIP,
    TOLLS,
    TOTAL,
)

CARD, CASH = 1, 2


def clip_points(
    df: DataFrame, distance: str = DISTANCE, fare: str = FARE, p: float = 0.99, exact: bool = True
) -> DataFrame:
    """Trips with a positive distance, neither distance nor fare beyond its quantile."""
    limits = quantile_limits(df, [distance, fare], p, exact)
    return df.where(
        (F.col(distance) > 0)
        & (F.col(distance) <= F.lit(limits[distance]).cast("double"))
        & (F.col(fare) <= F.lit(limits[fare]).cast("double"))
    )


def distance_fare_points(
    df: DataFrame,
    distance: str = DISTANCE,
    fare: str = FARE,
    colour: str = PASSENGERS,
    sample: int | None = None,
    key: Column | None = None,
    identity=(PICKUP_TIME, DROPOFF_TIME, PICKUP_ZONE, DROPOFF_ZONE),
    exact: bool = True,
) -> DataFrame:
    """The points of the distance and fare chart, all or a sample of fixed size.

    ``identity`` names the columns that tell trips with the same point apart,
    so that the sample is drawn from trips and not from points.
    """
    points = clip_points(df, distance, fare, exact=exact)
    if sample is not None:
        points = fixed_sample(points.select(distance, fare, colour, *identity), sample, key)
    return points.select(distance, fare, colour)


BOXES = T.StructType(
    [T.StructField("trips", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("avg_fare", "q1", "median", "q3", "whisker_low", "whisker_high")]
    + [T.StructField("fliers", T.LongType())]
)


def fare_by_passengers(
    df: DataFrame,
    passengers: str = PASSENGERS,
    fare: str = FARE,
    counts=(1, 2, 3, 4, 5, 6),
    p: float = 0.99,
) -> DataFrame:
    """Mean and box-plot numbers of the fare per number of passengers, fares up to their ``p`` quantile (A10).

    The whiskers end at the last values within 1.5 interquartile ranges of the
    quartiles; values beyond them are counted as fliers. Two scans, at the call:
    the bucket states of all groups together tell where the cut lies, each of
    them where its quartiles and fences under the cut can lie, and the second
    scan reads these buckets.
    """
    number = F.col(passengers).cast("double")
    # ``counts`` bounds the number of groups; all other trips are one.
    group = F.coalesce(F.when(number.isin(*map(float, counts)), number), F.lit(-1.0))
    known = Distribution(df.select(group.alias("_group"), fare), [fare], ["_group"])
    every = known.groups(fare)
    if not every:
        return _boxes(df, passengers, [])
    cut = known.want_quantile(every, p)
    quartiles = (0.25, 0.5, 0.75)
    least = {}
    for key in [key for key in every if key[0] >= 0]:
        state = known.parts[key]
        # How many fares of the group are under the cut is known but for the bucket of the cut.
        few, many = (int(state.n[which].sum()) for which in (state.hi <= cut[0], state.lo <= cut[1]))
        if many == 0:
            continue
        least[key] = few
        ends = [known.want_rank([key], known.ranks(max(few, 1), q)[0], known.ranks(many, q)[1]) for q in quartiles]
        for bracket in fence_brackets(ends[0], ends[2]):
            known.want_range([key], *bracket)
    known.read()
    limit = known.quantiles([(every, p, None)])[0]
    under = dict(zip(least, known.within([([key], -OPEN, limit) for key in least])))
    keys = [key for key in least if under[key][0]]
    found = iter(known.quantiles([([key], q, under[key][0]) for key in keys for q in quartiles]))
    boxes = {key: (next(found), next(found), next(found)) for key in keys}
    bounds = {key: fences(boxes[key][0], boxes[key][2]) for key in keys}
    inside = known.within([([key], bounds[key][1], min(bounds[key][2], limit)) for key in keys])
    rows = [
        (key[0], n, total / n, *boxes[key], low, high, n - held)
        for key, (held, _, low, high) in zip(keys, inside)
        for n, total in [under[key][:2]]
    ]
    return _boxes(df, passengers, rows)


def _boxes(df: DataFrame, passengers: str, rows: list) -> DataFrame:
    found = local_table(df.sparkSession, rows, T.StructType([T.StructField(passengers, T.DoubleType()), *BOXES]))
    return found.withColumn(passengers, F.col(passengers).cast(df.schema[passengers].dataType))


def with_tip_rate(
    df: DataFrame, tip: str = TIP, fare: str = FARE, cap: float = 100.0
) -> DataFrame:
    """Add the tip in percent of the fare, keep rates up to ``cap``.

    A fare of 0 has no rate; the row goes with the rates beyond the cap.
    """
    return df.withColumn("tip_rate", ratio_percent(tip, fare)).where(F.col("tip_rate") <= cap)


def tip_rates(
    df: DataFrame,
    payment: str = PAYMENT,
    types=(CARD, CASH),
    tip: str = TIP,
    fare: str = FARE,
    exact: bool = True,
) -> DataFrame:
    """Quartiles and mean of the tip rate per payment type."""
    rates = with_tip_rate(df.where(F.col(payment).isin(*types)), tip, fare).select(
        payment, "tip_rate"
    )
    if exact:
        # The bucket state has the moments too.
        known = Distribution(rates, ["tip_rate"], [payment])
        quartiles = (0.25, 0.5, 0.75)
        for key in known.parts:
            for p in quartiles:
                known.want_quantile([key], p)
        known.read()
        found = iter(known.quantiles([([key], p, None) for key in known.parts for p in quartiles]))
        rows = [(key[0], *moments(part)[:2], next(found), next(found), next(found)) for key, part in known.parts.items()]
        kinds = [("trips", T.LongType()), *[(c, T.DoubleType()) for c in ("avg_rate", "q1", "median", "q3")]]
        fields = [rates.schema[payment], *[T.StructField(*kind) for kind in kinds]]
        return local_table(df.sparkSession, rows, T.StructType(fields))
    # ``types`` bounds the number of groups.
    boxes = F.broadcast(quartile_table(rates, ["tip_rate"], [payment], True, False))
    basic = rates.groupBy(payment).agg(
        F.count("*").alias("trips"), F.avg("tip_rate").alias("avg_rate")
    )
    return basic.join(boxes, payment).select(
        payment, "trips", "avg_rate", "q1", "median", "q3"
    )


def payment_share(df: DataFrame, payment: str = PAYMENT) -> DataFrame:
    """Trips per payment type and their share of all trips, with its name."""
    counts = df.groupBy(payment).agg(F.count("*").alias("trips"))
    total = counts.agg(F.sum("trips")).scalar()
    return with_key(counts, payment).select(
        payment,
        payment_label(payment).alias("name"),
        "trips",
        percent(F.col("trips"), total, 1).alias("share_pct"),
    )


def fee_structure(
    df: DataFrame,
    payment: str = PAYMENT,
    types=(CARD, CASH),
    fare: str = FARE,
    tip: str = TIP,
    tolls: str = TOLLS,
    total: str = TOTAL,
) -> DataFrame:
    """Mean fare, tip, tolls and total per payment type and what is left of the total."""
    means = (
        df.where(F.col(payment).isin(*types))
        .groupBy(payment)
        .agg(*[mean(c).alias(c) for c in (fare, tip, tolls, total)])
    )
    rest = F.col(total) - F.col(fare) - F.col(tip) - F.col(tolls)
    return means.withColumn("other_fees", F.bround(rest, 4))


def hourly_payment_share(
    df: DataFrame, payment: str = PAYMENT, types=(CARD, CASH), pickup_time: str = PICKUP_TIME
) -> DataFrame:
    """Share of each payment type among the listed ones per hour, 0 in an empty hour."""
    rows = with_clock(df.where(F.col(payment).isin(*types)), pickup_time)
    empty = hour_grid(df.sparkSession).withColumn(payment, F.lit(None).cast("int"))
    counts = (
        rows.where(F.col("pickup_hour").isNotNull())
        .select("pickup_hour", F.col(payment).cast("int").alias(payment))
        .unionByName(empty)
        .groupBy("pickup_hour")
        .agg(
            F.count(payment).alias("trips"),
            *[F.count_if(F.col(payment) == t).alias(f"type_{t}") for t in types],
        )
    )
    share = {
        t: F.coalesce(percent(F.col(f"type_{t}"), F.col("trips"), 4), F.lit(0.0)) for t in types
    }
    return counts.select(
        "pickup_hour", "trips", *[share[t].alias(f"type_{t}_pct") for t in types]
    )


def payment_means(
    df: DataFrame, payment: str = PAYMENT, columns=(FARE, TIP, TOTAL)
) -> DataFrame:
    """Mean of each column per payment type."""
    return (
        df.where(F.col(payment).isNotNull())
        .groupBy(payment)
        .agg(*[mean(c).alias(f"avg_{c}") for c in columns])
    )


def tip_means(df: DataFrame, payment: str = PAYMENT, tip: str = TIP) -> DataFrame:
    """Mean tip of card and of cash trips in one row."""
    return df.agg(
        mean(F.when(F.col(payment) == CARD, F.col(tip))).alias("card_tip_avg"),
        mean(F.when(F.col(payment) == CASH, F.col(tip))).alias("cash_tip_avg"),
    )
