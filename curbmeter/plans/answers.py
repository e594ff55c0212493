"""From question texts to their results (the dispatch of Q1-Q7), one or any number at once.

:func:`answer_all` reads the trips once: three grouping sets count them per
zone and hour of the week, per pair of zones and per payment type. All
coarser counts - any zone, any day, any origin - are grouping sets of these
small tables, and each question finds its row by an equi-join, in which a
parameter that it does not name is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.functions.timing import minutes_between, with_clock
from curbmeter.functions.values import payment_label
from curbmeter.operators.ranks import with_rank
from curbmeter.plans.forecasting import Forecaster, score_requests
from curbmeter.plans.questions import (
    hourly_demand_answer,
    location_ranking,
    payment_analysis,
    peak_hours,
    route_info,
)
from curbmeter.plans.tagging import TagRules, tag_text
from curbmeter.schema import (
    ALIGHTING,
    BOARDING,
    DISTANCE,
    DROPOFF_TIME,
    DROPOFF_ZONE,
    FARE,
    PAYMENT,
    PICKUP_TIME,
    PICKUP_ZONE,
    TIP,
    TOTAL,
    WEEKEND,
    WEEKEND_DAYS,
    WORKDAY,
)
from curbmeter.session import broadcast_if_small, cut_lineage

PREDICT_NEEDS = ("location", "hour", "weekday")


def answer(trips: DataFrame, text: str, forecaster: Forecaster | None = None) -> DataFrame:
    """Tag one question and return the DataFrame that answers it.

    ``trips`` is the cleaned table. A forecast needs a fitted ``forecaster``
    and a question that names zone, hour and weekday.
    """
    spark = trips.sparkSession
    tags = tag_text(spark.createDataFrame([(text,)], "text string")).first().asDict()
    intent = tags["intent"]
    if intent == "predict":
        absent = [name for name in PREDICT_NEEDS if tags[name] is None]
        if absent:
            raise ValueError(f"a forecast needs zone, hour and weekday; missing: {absent}")
        if forecaster is None:
            raise ValueError("a forecast needs a fitted forecaster")
        request = tuple(int(tags[name]) for name in PREDICT_NEEDS)
        requests = spark.createDataFrame([request], "location_id int, hour int, weekday int")
        return score_requests(requests, forecaster)
    if intent == "ranking":
        return location_ranking(trips, tags["rank_type"], int(tags["top_n"]))
    if intent == "peak_hours":
        return peak_hours(trips, tags["location"])
    if intent == "route_info":
        return route_info(trips, tags["route_from"], tags["route_to"])
    if intent == "payment":
        return payment_analysis(trips)
    return hourly_demand_answer(trips, tags["location"], tags["day_type"])


MEASURES = ("distance", "fare", "total", "duration_min", "tip")
HOURS = range(24)


@dataclass
class DemandFacts:
    """The counts that answer every question, from one scan; all tables are small beside the trips."""

    cells: DataFrame
    routes: DataFrame
    payments: DataFrame


def demand_facts(
    trips: DataFrame,
    pickup_zone: str = PICKUP_ZONE,
    dropoff_zone: str = DROPOFF_ZONE,
    pickup_time: str = PICKUP_TIME,
    dropoff_time: str = DROPOFF_TIME,
) -> DemandFacts:
    """Count the trips once, per cell of the week, per pair of zones and per payment type.

    ``cells`` has ``zone, hour, weekday, trips``, ``routes`` and ``payments``
    have the sum and number of every measure. Rows with a null zone or payment
    type are kept as such; they count where the question does not name one.
    """
    clock = with_clock(trips, pickup_time)
    values = {
        "distance": F.col(DISTANCE),
        "fare": F.col(FARE),
        "total": F.col(TOTAL),
        "duration_min": minutes_between(pickup_time, dropoff_time),
        "tip": F.col(TIP),
    }
    rows = clock.select(
        F.col(pickup_zone).cast("long").alias("zone"),
        F.col("pickup_hour").alias("hour"),
        F.col("pickup_weekday").alias("weekday"),
        F.col(dropoff_zone).cast("long").alias("to_zone"),
        F.col(PAYMENT).alias("payment"),
        *[value.alias(name) for name, value in values.items()],
    )
    keys = ["zone", "hour", "weekday", "to_zone", "payment"]
    sets = {"cells": keys[:3], "routes": ["zone", "to_zone"], "payments": ["payment"]}
    numbers = [f(c).alias(f"{part}_{c}") for c in MEASURES for f, part in ((F.sum, "sum"), (F.count, "n"))]
    counted = cut_lineage(
        rows.groupingSets(list(sets.values()), *keys).agg(
            F.grouping_id().alias("grain"), F.count("*").alias("trips"), *numbers
        )
    )

    def grain(name: str) -> DataFrame:
        bits = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in sets[name])
        return counted.where(F.col("grain") == bits)

    sums = [c for m in MEASURES for c in (f"sum_{m}", f"n_{m}")]
    return DemandFacts(
        grain("cells").select(*sets["cells"], "trips"),
        grain("routes").select(*sets["routes"], "trips", *sums),
        grain("payments").select("payment", "trips", *sums),
    )


def _levels(df: DataFrame, keys: list, sets: list, *numbers: Column) -> DataFrame:
    """Grouping sets in which null means "not named": groups of a null key itself are left out."""
    found = df.groupingSets(sets, *keys).agg(*[F.grouping(k).alias(f"_any_{k}") for k in keys], *numbers)
    for key in keys:
        found = found.where((F.col(f"_any_{key}") == 1) | F.col(key).isNotNull()).drop(f"_any_{key}")
    return found


def hour_table(cells: DataFrame) -> DataFrame:
    """``zone, workday, weekend``: 24 counts each, per zone and (null) for all of them (Q1, Q6)."""
    off = F.col("weekday").isin(*WEEKEND_DAYS)

    def counts(days: Column, name: str) -> Column:
        return F.array(*[F.sum(F.when(days & (F.col("hour") == h), F.col("trips")).otherwise(0)) for h in HOURS]).alias(name)

    known = cells.where(F.col("hour").isNotNull())
    return _levels(known, ["zone"], [["zone"], []], counts(~off, "workday"), counts(off, "weekend"))


def route_levels(routes: DataFrame) -> DataFrame:
    """``zone, to_zone, trips`` and the mean of every measure, for all pairs and (null) any origin or destination (Q4)."""
    sums = [F.sum(c).alias(c) for c in routes.columns if c not in ("zone", "to_zone")]
    found = _levels(routes, ["zone", "to_zone"], [["zone", "to_zone"], ["zone"], ["to_zone"], []], *sums)
    means = [F.try_divide(F.col(f"sum_{m}"), F.col(f"n_{m}")).alias(f"avg_{m}") for m in MEASURES]
    return found.select("zone", "to_zone", F.col("trips").alias("trip_count"), *means)


def place_lists(routes: DataFrame, longest: Column) -> DataFrame:
    """``rank_type, total_locations, places``: the busiest zones per rank type, as many as the longest list asked for (Q2)."""

    def ends(column: str, name: str) -> DataFrame:
        known = routes.where(F.col(column).isNotNull())
        return known.groupBy(F.lit(name).alias("rank_type"), F.col(column).alias("location")).agg(F.sum("trips").alias("trips"))

    zones = ends("zone", BOARDING).unionAll(ends("to_zone", ALIGHTING))
    ranked = cut_lineage(with_rank(zones, "rank_type", F.desc("trips"), "location"))
    # Two rows.
    types = ranked.groupBy("rank_type").agg(F.min("rank").alias("first"), F.count("*").alias("total_locations"))
    place = F.col("rank") - F.col("first") + 1
    listed = ranked.join(F.broadcast(types), "rank_type").where(place <= longest)
    return listed.groupBy("rank_type", "total_locations").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(place.alias("place"), "location", "trips"))),
            lambda p: F.struct(p["location"].alias("location"), p["trips"].alias("trips")),
        ).alias("places")
    )


def payment_list(payments: DataFrame) -> DataFrame:
    """One row with the list of payment types: code, name, trips, share of all trips in percent, means (Q5)."""
    whole = F.sum("trips").cast("double")
    means = [F.try_divide(F.col(f"sum_{m}"), F.col(f"n_{m}")).alias(f"avg_{m}") for m in ("fare", "tip", "total")]
    each = F.struct("payment", payment_label("payment").alias("name"), "trips", *means)
    one = payments.agg(whole.alias("_whole"), F.array_sort(F.collect_list(F.when(F.col("payment").isNotNull(), each))).alias("_types"))
    return one.select(
        F.transform(
            "_types",
            lambda t: t.withField("share_pct", F.try_divide(t["trips"].cast("double"), F.col("_whole")) * 100.0),
        ).alias("payment")
    )


def _peak(counts: Column, first: int, last: int) -> Column:
    """``struct(hour, trips)`` of the most trips within some hours, the earliest one of several."""
    part = F.slice(counts, first + 1, last - first + 1)
    return F.array_max(F.transform(part, lambda n, i: F.struct(n.alias("trips"), (-i - first).alias("less"))))


def hourly_struct(counts: Column) -> Column:
    """The answer to a question for hourly demand, as in :func:`hourly_demand_answer`, from the 24 counts (Q1)."""
    fields = []
    for name, hours in (("", (0, 23)), ("morning_", (6, 9)), ("evening_", (16, 19))):
        peak = _peak(counts, *hours)
        fields += [(-peak["less"]).alias(f"{name}peak_hour"), peak["trips"].alias(f"{name}peak_trips")]
    mean = F.bround(F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n) / F.lit(24.0), 1)
    return F.struct(*fields[:2], mean.alias("avg_demand"), *fields[2:])


def hourly_answers(hours: DataFrame) -> DataFrame:
    """:func:`hour_table` with its answers for ``any_day``, ``on_workdays`` and ``on_weekends``, worked out once per zone."""
    both = cut_lineage(hours.withColumn("both", F.zip_with("workday", "weekend", lambda a, b: a + b)))
    answers = {"any_day": "both", "on_workdays": "workday", "on_weekends": "weekend"}
    return both.select("zone", "workday", "weekend", *[hourly_struct(F.col(c)).alias(name) for name, c in answers.items()])


def _matched(questions: DataFrame, table: DataFrame, keys: dict, intents: tuple) -> DataFrame:
    """Left join by parameters of the question; both sides null is a match. One row of ``table`` per key."""
    table = broadcast_if_small(table.withColumnsRenamed({key: f"_{key}" for key in keys.values()}))
    same = [F.col(ours).eqNullSafe(F.col(f"_{theirs}")) for ours, theirs in keys.items()]
    asked = reduce(Column.__and__, same, F.col("intent").isin(*intents))
    return questions.join(table, asked, "left").drop(*[f"_{theirs}" for theirs in keys.values()])


def answer_all(
    trips: DataFrame,
    questions: DataFrame,
    text: str = "text",
    forecaster: Forecaster | None = None,
    rules: TagRules | None = None,
    facts: DemandFacts | None = None,
) -> DataFrame:
    """Tag every question and answer it: ``questions`` with its tags and one struct per kind of answer (Q1-Q7).

    Only the struct of a question's own intent is set: ``hourly`` (peaks and
    mean of the 24 counts), ``peaks`` (24 counts of workdays and of weekends),
    ``ranking`` (number of zones and the first ``top_n``), ``route`` (count and
    means in full, count 0 and null means for a pair without trips),
    ``payment`` (list of types) and ``forecast`` (demand of exactly that cell,
    and the predicted one if a ``forecaster`` is given). ``problem`` says what
    a forecast lacks. A zone that has no trips counts 0. Questions may be
    many; texts that repeat give rows that repeat, and an empty table gives none.

    The trips are scanned once, when this is called; pass ``facts`` to use an
    earlier scan. Lists are as long as the longest one asked for.
    """
    facts = facts or demand_facts(trips)
    tagged = cut_lineage(tag_text(questions, text, rules))
    asked_places = tagged.where("intent = 'ranking'").agg(F.coalesce(F.max("top_n"), F.lit(0))).scalar()
    is_a = lambda intent: F.col("intent") == intent

    hours = cut_lineage(hourly_answers(hour_table(facts.cells)))
    found = _matched(tagged, hours, {"location": "zone"}, ("hourly_demand", "peak_hours"))
    none = F.array_repeat(F.lit(0).cast("long"), len(HOURS))
    quiet = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip((0, 0, 0.0, 6, 0, 16, 0), hours.schema["any_day"].dataType)])
    day = F.col("day_type")
    hourly = F.when(day == WORKDAY, F.col("on_workdays")).when(day == WEEKEND, F.col("on_weekends")).otherwise(F.col("any_day"))
    peaks = F.struct(*[F.coalesce(c, none).alias(c) for c in ("workday", "weekend")])
    found = found.withColumns(
        {"hourly": F.when(is_a("hourly_demand"), F.coalesce(hourly, quiet)), "peaks": F.when(is_a("peak_hours"), peaks)}
    ).drop(*[c for c in hours.columns if c != "zone"])

    # Two rows, and one.
    places = F.broadcast(place_lists(facts.routes, asked_places).withColumnRenamed("rank_type", "_rank_type"))
    found = found.join(places, is_a("ranking") & (F.col("rank_type") == F.col("_rank_type")), "left")
    first = F.slice(F.coalesce("places", F.array().cast(places.schema["places"].dataType)), 1, F.col("top_n").cast("int"))
    ranking = F.struct(F.coalesce("total_locations", F.lit(0).cast("long")).alias("total_locations"), first.alias("places"))
    found = found.withColumn("ranking", F.when(is_a("ranking"), ranking)).drop("_rank_type", "places", "total_locations")
    found = found.join(F.broadcast(payment_list(facts.payments)), is_a("payment"), "left")

    means = [f"avg_{m}" for m in MEASURES]
    levels = cut_lineage(route_levels(facts.routes))
    found = _matched(found, levels, {"route_from": "zone", "route_to": "to_zone"}, ("route_info",))
    route = F.struct(F.coalesce("trip_count", F.lit(0).cast("long")).alias("trip_count"), *means)
    found = found.withColumn("route", F.when(is_a("route_info"), route)).drop("trip_count", *means)

    keys = {"location": "zone", "hour": "hour", "weekday": "weekday"}
    past = facts.cells.where("zone is not null and hour is not null").withColumnRenamed("trips", "historical_demand")
    found = _matched(found, past, keys, ("predict",))
    fields = ["historical_demand"]
    if forecaster is not None:
        wanted = tagged.where(is_a("predict") & F.col("location").isNotNull() & F.col("hour").isNotNull() & F.col("weekday").isNotNull())
        requests = wanted.select(F.col("location").alias("location_id"), "hour", "weekday").distinct()
        scored = score_requests(requests, forecaster).select("location_id", "hour", "weekday", "predicted_demand", "known_zone")
        found = _matched(found, cut_lineage(scored), {"location": "location_id", "hour": "hour", "weekday": "weekday"}, ("predict",))
        fields += ["predicted_demand", "known_zone"]
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in PREDICT_NEEDS]), lambda c: c.isNotNull())
    complete = F.size(lacks) == 0
    found = found.withColumn("forecast", F.when(is_a("predict") & complete, F.struct(*fields))).drop(*fields)
    return found.withColumn("problem", F.when(is_a("predict") & ~complete, F.concat(F.lit("missing: "), F.array_join(lacks, ", "))))
