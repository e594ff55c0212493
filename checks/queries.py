"""One callable ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.inputs import cleaned_trips, raw_trips, stored_raw, table
from curbmeter.functions.timing import with_duration, with_time_features
from curbmeter.operators import clean, demand, encoding, evaluation, fares, profile, quantiles
from curbmeter.operators.duplicates import distinct_rows
from curbmeter.operators.heavy import top_keys
from curbmeter.operators.sampling import histogram
from curbmeter.plans import analyses, answers, forecasting, questions, tagging, trees
from curbmeter.plans.incremental import AuditState
from curbmeter.schema import (
    ALIGHTING,
    BOARDING,
    DROPOFF_ZONE,
    FARE,
    PAYMENT,
    PICKUP_TIME,
    PICKUP_ZONE,
    WEEKEND,
    WORKDAY,
)
from curbmeter.session import checkpoint_root, cut_lineage
from curbmeter.sources.clustered import write_clustered
from curbmeter.sources.months import read_months
from curbmeter.sources.tables import preview, read_zones, with_zone_names, write_trips
from curbmeter.streaming.trips import read_trip_stream, valid_trips_with_features

RAW, CLEANED = raw_trips, cleaned_trips
# Rules for another kind of text than questions: addresses of web pages.
URL_RULES = tagging.TagRules(
    intents=(
        ("tracker", ("ads", "track")),
        ("blog", ("blog.",)),
        ("feed", ("utm_source=feed",)),
        ("mobile", ("//m.",)),
    ),
    default_intent="page",
    numbers={"location": (("/",), r"/(\d+)"), "top_n": (("page=",), r"page=(\d+)")},
    day_types=(("secure", ("https://",)), ("plain", ("http://",))),
    weekdays=(("/en/", 0), ("/fr/", 1), ("/es/", 2)),
    ranking_intent="blog",
    alighting=("#top",),
    default_top_n=1,
)


MEANS = ("mean", "std", "avg_fare", "avg_rate", "mae", "rmse", "density")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round the floating columns, so that the order of summation does not show.

    Means are cut earlier than values; fares have five digits and their
    quartiles eight at most, so eight digits never meet a tie.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns(
        {c: F.round(F.col(c), min(digits, 6) if c in MEANS else digits) for c in doubles}
    )


def supplier_zones(spark, sf_dir) -> DataFrame:
    """A zone dimension made of the suppliers: lowest supplier name and nation per zone id."""
    return (
        table(spark, sf_dir, "supplier")
        .select((F.col("s_suppkey") % 265 + 1).cast("int").alias("LocationID"), "s_name", "s_nationkey")
        .groupBy("LocationID")
        .agg(F.min("s_name").alias("Zone"), F.min("s_nationkey").alias("Borough"))
    )


def zone_enrichment(spark, sf_dir) -> DataFrame:
    # Trips are counted per zone first, so the join sees one row per zone.
    per_zone = demand.group_counts(CLEANED(spark, sf_dir), PICKUP_ZONE)
    named = with_zone_names(per_zone, supplier_zones(spark, sf_dir))
    return named.select(PICKUP_ZONE, "Zone", "Borough", "trips")


def sparse(spark, sf_dir) -> DataFrame:
    names = clean.sparse_columns(RAW(spark, sf_dir))
    return spark.createDataFrame([(n,) for n in names], "column string")


def sample_points(spark, sf_dir) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), PICKUP_TIME)
    mixed = seconds * 7919 + F.col(PICKUP_ZONE) * 104729 + F.col(DROPOFF_ZONE) * 1299709
    key = (mixed % 1000003) / F.lit(1000003.0)
    return fares.distance_fare_points(CLEANED(spark, sf_dir), sample=100_000, key=key)


def cube(spark, sf_dir) -> DataFrame:
    return demand.demand_cube(CLEANED(spark, sf_dir))


def stored_cube(spark, sf_dir) -> DataFrame:
    """The cube behind a checkpoint, for queries that use it more than once."""
    return cut_lineage(cube(spark, sf_dir))


def encoded_cube(spark, sf_dir) -> DataFrame:
    cells = stored_cube(spark, sf_dir)
    return encoding.demand_features(cells, encoding.zone_encoder(cells))


def scaled_cube(spark, sf_dir) -> DataFrame:
    table_ = encoded_cube(spark, sf_dir).withColumn("demand", F.col("demand").cast("double"))
    scaled = encoding.standardise(table_, [*encoding.FEATURES, "demand"])
    return rounded(scaled.select(PICKUP_ZONE, "pickup_hour", "pickup_weekday", *encoding.FEATURES, "demand"), 4)


def unscaled_demand(spark, sf_dir) -> DataFrame:
    cells = stored_cube(spark, sf_dir).withColumn("scaled", F.col("demand").cast("double"))
    scaled = encoding.standardise(cells, ["scaled"])
    back = encoding.unscale(scaled, {"scaled": "demand"}, cells)
    return rounded(back.withColumnRenamed("scaled", "demand_again"), 4)


def mean_prediction(spark, sf_dir) -> DataFrame:
    """Predict every test cell with the train mean of its hour and weekday."""
    train, test = encoding.split(stored_cube(spark, sf_dir))
    means = train.groupBy("pickup_hour", "pickup_weekday").agg(F.avg("demand").alias("prediction"))
    # At most 168 rows.
    return test.join(F.broadcast(means), ["pickup_hour", "pickup_weekday"])


def flat_prediction(spark, sf_dir) -> DataFrame:
    """Predict every test cell with the train mean of its hour."""
    train, test = encoding.split(stored_cube(spark, sf_dir))
    means = train.groupBy("pickup_hour").agg(F.avg("demand").alias("prediction"))
    # At most 24 rows.
    return test.join(F.broadcast(means), "pickup_hour")


def question_texts(spark, sf_dir) -> DataFrame:
    """One question per trip, in one of seven forms."""
    trips = CLEANED(spark, sf_dir)
    pu, do = F.col(PICKUP_ZONE).cast("string"), F.col(DROPOFF_ZONE).cast("string")
    hour = F.hour(PICKUP_TIME).cast("string")
    n = (F.col(PICKUP_ZONE) % 20 + 1).cast("string")
    day = F.get(F.array(*[F.lit(d) for d in "一二三四五六日"]), F.weekday(PICKUP_TIME))
    form = F.col(DROPOFF_ZONE) % 7
    text = (
        F.when(form == 0, F.concat(F.lit("请预计区域"), pu, F.lit("星期"), day, F.lit(" "), hour, F.lit("时会有多少订单")))
        .when(form == 1, F.concat(F.lit("上客最热门的地方 Top "), n))
        .when(form == 2, F.concat(F.lit("从区域"), pu, F.lit("去区域 "), do, F.lit(" 大约要多少钱")))
        .when(form == 3, F.concat(hour, F.lit(":00 左右现金与信用卡的付款比例")))
        .when(form == 4, F.concat(F.lit("星期"), day, F.lit("哪段路最忙")))
        .when(form == 5, F.concat(F.lit("平日区域 "), pu, F.lit(" 每小时的订单")))
        .otherwise(F.concat(F.lit("假日下客排行前"), n, F.lit("的地方")))
    )
    return trips.select(PICKUP_ZONE, DROPOFF_ZONE, text.alias("text"))


def tag_questions(spark, sf_dir) -> DataFrame:
    return tagging.tag_text(question_texts(spark, sf_dir)).drop(PICKUP_ZONE, DROPOFF_ZONE)


def answer_questions(spark, sf_dir) -> DataFrame:
    """Every different question text with its answer; lists as text, means as sums, whose digits are few."""
    answered = answers.answer_all(CLEANED(spark, sf_dir), question_texts(spark, sf_dir).select("text").distinct())

    def listed(column: str, *fields: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")

    sums = [F.round(F.col(f"route.avg_{m}") * F.col("route.trip_count"), 8).alias(f"sum_{m}") for m in answers.MEASURES]
    return answered.select(
        "text",
        "intent",
        "hourly.*",
        F.array_join(F.col("peaks.workday").cast("array<string>"), ",").alias("workday"),
        F.array_join(F.col("peaks.weekend").cast("array<string>"), ",").alias("weekend"),
        "ranking.total_locations",
        F.when(F.col("ranking").isNotNull(), listed("ranking.places", "location", "trips")).alias("places"),
        F.when(F.col("payment").isNotNull(), listed("payment", "payment", "name", "trips")).alias("payment_types"),
        "route.trip_count",
        *sums,
        "forecast.historical_demand",
        "problem",
    )


def tag_urls(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return tagging.tag_text(pages, "url", URL_RULES)


def hourly_fares(spark, sf_dir) -> DataFrame:
    """Mean times count gives the sum, whose five digits do not depend on the order of summation."""
    means = demand.hourly_fare_by_day_type(CLEANED(spark, sf_dir))
    return means.select("is_weekend", "pickup_hour", "trips", F.round(F.col("avg_fare") * F.col("trips"), 5).alias("fares"))


def full_routes(spark, sf_dir) -> DataFrame:
    """Every mean times the count, which gives sums of eight digits at most."""
    routes = questions.route_table(CLEANED(spark, sf_dir))
    means = [c for c in routes.columns if c.startswith("avg_")]
    sums = [F.round(F.col(c) * F.col("trip_count"), 8).alias("sum_" + c.removeprefix("avg_")) for c in means]
    return routes.select(PICKUP_ZONE, DROPOFF_ZONE, "trip_count", *sums)


def chained(name: str):
    """One data set of the analysis chain."""

    def run(spark, sf_dir) -> DataFrame:
        return analyses.run_analyses(CLEANED(spark, sf_dir), distributions=False)[name]

    return run


def chained_fares(spark, sf_dir) -> DataFrame:
    means = chained("hourly_fare_by_daytype")(spark, sf_dir)
    return means.select("is_weekend", "pickup_hour", "trips", F.round(F.col("avg_fare") * F.col("trips"), 5).alias("fares"))


def csv_round_trip(spark, sf_dir) -> DataFrame:
    """The cleaned trips written as CSV and read back."""
    trips = CLEANED(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}/csv"
    write_trips(trips, path, "csv")
    return spark.read.schema(trips.schema).csv(path, header=True)


def months_of_schemas(spark, sf_dir) -> DataFrame:
    """Raw trips written as three groups of months whose columns differ, read as one table, of some zones."""
    trips = RAW(spark, sf_dir)
    root = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}"
    month = F.month(PICKUP_TIME)
    wide = trips.where(month % 3 == 1).withColumns({c: F.col(c).cast("long") for c in (PICKUP_ZONE, PAYMENT, "VendorID")})
    other = trips.where(month % 3 == 2).withColumnRenamed("airport_fee", "Airport_Fee")
    other = other.withColumn("RatecodeID", F.col("RatecodeID").cast("int")).withColumn("passenger_count", F.col("passenger_count").cast("long"))
    parts = {"as_is": trips.where((month % 3 == 0) | month.isNull()), "wide": wide, "other": other, "short": None}
    # A path of the first schema again, which shares its scan.
    parts["short"], parts["as_is"] = parts["as_is"].where(F.col(DROPOFF_ZONE) <= 50), parts["as_is"].where(F.col(DROPOFF_ZONE) > 50)
    for name, part in parts.items():
        write_trips(part, f"{root}/{name}")
    return read_months(spark, [f"{root}/{name}" for name in parts]).where(F.col(PICKUP_ZONE).between(100, 160))


_audit_states: dict = {}


def grown_state(spark, sf_dir) -> AuditState:
    """The stored audit of a folder of raw trips that grew in two steps, made once per session and data set.

    The second step adds files with other types and puts others in the place of some of the first step.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _audit_states:
        trips = RAW(spark, sf_dir)
        root = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}"
        state = AuditState(spark, f"{root}/months", f"{root}/state")
        part = F.coalesce(F.month(PICKUP_TIME) % 3, F.lit(0))
        write_trips(trips.where(part == 0), f"{root}/months/first")
        write_trips(trips.where((part == 2) & (F.col(PICKUP_ZONE) < 100)), f"{root}/months/second")
        state.update()
        write_trips(trips.where(part == 2), f"{root}/months/second")
        wide = {c: F.col(c).cast("long") for c in (PICKUP_ZONE, PAYMENT, "VendorID")}
        write_trips(trips.where(part == 1).withColumns(wide), f"{root}/months/third")
        state.update()
        _audit_states[key] = state
    return _audit_states[key]


def grown(report: str):
    """One report from the stored audit."""
    return lambda spark, sf_dir: grown_state(spark, sf_dir).reports()[report]


def clustered(spark, sf_dir) -> DataFrame:
    """The cleaned trips written along the curve and read back."""
    path = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}/clustered"
    write_clustered(CLEANED(spark, sf_dir), path, files=32)
    return spark.read.parquet(path)


def csv_zones(spark, sf_dir) -> DataFrame:
    """The zone dimension written as CSV, read as users' files are, and joined to trips per zone."""
    path = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}/zones"
    zones = supplier_zones(spark, sf_dir).select(
        "LocationID", F.col("Borough").cast("string").alias("Borough"), "Zone", F.lit("N/A").alias("service_zone")
    )
    write_trips(zones, path, "csv")
    per_zone = demand.group_counts(CLEANED(spark, sf_dir), PICKUP_ZONE)
    return with_zone_names(per_zone, read_zones(spark, path)).drop("LocationID")


def streamed_features(spark, sf_dir) -> DataFrame:
    """All files of raw trips as a stream, run until none is left."""
    root = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}"
    source = read_trip_stream(spark, stored_raw(spark, sf_dir), RAW(spark, sf_dir).schema, files_per_trigger=4)
    stream = valid_trips_with_features(source).writeStream.format("parquet")
    stream = stream.option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        PICKUP_TIME, PICKUP_ZONE, DROPOFF_ZONE, FARE, "pickup_date", "pickup_hour", "pickup_weekday", "pickup_day",
        "is_weekend", "is_rush_hour", F.round("hour_sin", 6).alias("hour_sin"),
    )


def within(column: str, table_: DataFrame, actual: str = "demand"):
    """Whether a prediction lies in the range of the values that it was learned from."""
    span = table_.agg(F.struct(F.min(actual).alias("lo"), F.max(actual).alias("hi"))).scalar()
    # Means of equal values may leave the range by the last bit.
    return F.col(column).between(span["lo"] - F.lit(1e-9), span["hi"] + F.lit(1e-9))


_forecasters: dict = {}


def forecaster(spark, sf_dir) -> forecasting.Forecaster:
    """The forest on all cells, fitted once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _forecasters:
        _forecasters[key] = forecasting.train_forecaster(CLEANED(spark, sf_dir))
    return _forecasters[key]


def forest_predictions(spark, sf_dir) -> DataFrame:
    """Test cells with their demand and whether the forest predicts a possible one."""
    train, _ = encoding.split(stored_cube(spark, sf_dir))
    scored = forecasting.evaluate(CLEANED(spark, sf_dir), {"forest": forecasting.forest()})["forest"]
    return scored.select(PICKUP_ZONE, "pickup_hour", "pickup_weekday", "demand", within("prediction", train).alias("in_range"))


def model_comparison(spark, sf_dir) -> DataFrame:
    """Per model the test cells, and whether it is better than the overall mean of the train cells."""
    train, _ = encoding.split(stored_cube(spark, sf_dir))
    mean = train.agg(F.avg("demand")).scalar()
    scored = forecasting.evaluate(
        CLEANED(spark, sf_dir), {"boosted_trees": forecasting.boosted_trees(), "forest": forecasting.forest()}
    )

    def row(name: str) -> DataFrame:
        judged = scored[name].select("demand", "prediction", within("prediction", train).alias("in_range"), mean.alias("mean"))
        return judged.agg(
            F.lit(name).alias("model"),
            F.count("*").alias("cells"),
            (F.avg(F.abs(F.col("demand") - F.col("prediction"))) < F.avg(F.abs(F.col("demand") - F.col("mean")))).alias("better"),
        )

    return row("boosted_trees").unionByName(row("forest"))


def tree_group_means(spark, sf_dir) -> DataFrame:
    """One split on one binary feature, by both regressors: the test cells get the train mean of their day type."""
    cells = stored_cube(spark, sf_dir)
    featured = encoding.with_vector(encoding.with_demand_features(cells), ["is_weekend"])
    train, test = encoding.split(featured)
    forest = forecasting.forest(numTrees=1, maxDepth=1, minInstancesPerNode=1, bootstrap=False).fit(train)
    boosted = forecasting.boosted_trees(maxIter=1, maxDepth=1).fit(train)
    both = boosted.transform(forest.transform(test).withColumnRenamed("prediction", "forest"))
    keys = [PICKUP_ZONE, "pickup_hour", "pickup_weekday"]
    return rounded(both.select(*keys, "forest", F.col("prediction").alias("boosted")), 4)


def feature_vectors(spark, sf_dir) -> DataFrame:
    """The elements of the feature vector by their place."""
    array = vector_to_array("features")
    vectors = encoding.with_vector(encoded_cube(spark, sf_dir))
    keys = [PICKUP_ZONE, "pickup_hour", "pickup_weekday"]
    return rounded(vectors.select(*keys, *[array[i].alias(f"f{i}") for i in range(len(encoding.FEATURES))]), 6)


def scaled_on_train(spark, sf_dir) -> DataFrame:
    """Demand of all cells in units fitted on the train cells alone."""
    cells = stored_cube(spark, sf_dir).withColumn("scaled", F.col("demand").cast("double"))
    train, _ = encoding.split(cells)
    return rounded(encoding.standardise(cells, ["scaled"], train), 4)


def feature_importance(spark, sf_dir) -> DataFrame:
    """The features, whether each importance is a share, and the sum of all."""
    shares = forecasting.feature_importance(forecaster(spark, sf_dir).model, spark)
    total = shares.agg(F.round(F.sum("importance"), 6)).scalar()
    return shares.select("feature", "label", F.col("importance").between(0, 1).alias("is_share"), total.alias("total"))


def score_requests(spark, sf_dir) -> DataFrame:
    """Every flow asks for its destination at the next hour; some zones are unknown."""
    fitted = forecaster(spark, sf_dir)
    requests = CLEANED(spark, sf_dir).select(
        (F.col(DROPOFF_ZONE) + F.when(F.col(DROPOFF_ZONE) % 50 == 0, 1000).otherwise(0)).alias("location_id"),
        ((F.hour(PICKUP_TIME) + 1) % 24).alias("hour"),
        F.weekday(PICKUP_TIME).alias("weekday"),
    ).distinct()
    scored = forecasting.score_requests(requests, fitted)
    return scored.withColumn("in_range", within("predicted_demand", fitted.cube)).drop("predicted_demand")


def cells_by_nodes(spark, sf_dir) -> DataFrame:
    """Every cell with whether the prediction from the forest's nodes is the model's own."""
    fitted = forecaster(spark, sf_dir)
    keys = [PICKUP_ZONE, "pickup_hour", "pickup_weekday"]
    featured = encoding.demand_features(fitted.cube, fitted.encoder)
    nodes = cut_lineage(trees.node_table(spark, fitted.model))
    ours = trees.predict_by_nodes(featured, nodes, keys, fitted.model.getOrDefault("maxDepth"))
    theirs = fitted.model.transform(encoding.with_vector(featured)).select(*keys, F.col("prediction").alias("model"))
    agrees = F.abs(F.col("prediction") - F.col("model")) < 1e-9
    return theirs.join(ours, keys, "left").select(*keys, F.coalesce(agrees, F.lit(False)).alias("agrees"))


def importance_by_nodes(spark, sf_dir) -> DataFrame:
    """The features with whether the importance from the nodes is the model's own."""
    model = forecaster(spark, sf_dir).model
    ours = trees.importance_by_nodes(trees.node_table(spark, model)).withColumnRenamed("importance", "ours")
    shares = forecasting.feature_importance(model, spark).join(ours, "feature")
    return shares.select("feature", "label", (F.abs(F.col("importance") - F.col("ours")) < 1e-9).alias("agrees"))


def importance_shares(spark, sf_dir) -> DataFrame:
    """The importances in ascending order."""
    return rounded(forecasting.feature_importance(forecaster(spark, sf_dir).model, spark), 6)


def predicted_requests(spark, sf_dir) -> DataFrame:
    """The answers of the batch scoring with the predicted demand."""
    requests = CLEANED(spark, sf_dir).select(
        F.col(DROPOFF_ZONE).alias("location_id"), F.hour(PICKUP_TIME).alias("hour"), F.weekday(PICKUP_TIME).alias("weekday")
    )
    return forecasting.score_requests(requests.distinct(), forecaster(spark, sf_dir))


def forest_errors(spark, sf_dir) -> DataFrame:
    """MAE and RMSE of both regressors on the test cells."""
    models = {"boosted_trees": forecasting.boosted_trees(), "forest": forecasting.forest()}
    scored = forecasting.evaluate(CLEANED(spark, sf_dir), models)
    rows = [evaluation.error_metrics(df).withColumn("model", F.lit(name)) for name, df in scored.items()]
    return rounded(rows[0].unionByName(rows[1]), 4)


def _on(source, operator, *args, digits=None, **kwargs):
    def run(spark, sf_dir):
        result = operator(source(spark, sf_dir), *args, **kwargs)
        return rounded(result, digits) if digits is not None else result

    return run


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _lineitem(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# Queries on a stored audit and the report they return.
GROWN = {
    "null_profile": "nulls", "key_null_profile": "key_nulls", "sign_audit": "signs", "passenger_validity": "passengers",
    "time_order_audit": "time_order", "padding_audit": "padding", "fare_consistency": "consistency",
    "sparse_columns": "sparse", "reject_funnel": "rejected", "passenger_distribution": "passenger_counts",
    "domain_summary": "domains", "domain_values": "domain_values", "domain_anomalies": "domain_anomalies",
    "domain_anomaly_total": "anomaly_total",
}
CHAINED = (
    "demand_cube", "hourly_by_daytype", "weekday_hour_counts", "weekday_hour_matrix", "top_pickup_zones",
    "top_dropoff_zones", "top5_zone_hourly", "od_flows", "payment_share", "fee_structure",
    "hourly_payment_share", "payment_means", "tip_means",
)
ROUNDED = ("hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "duration_min")


def features(trips: DataFrame) -> DataFrame:
    columns = [PICKUP_TIME, PICKUP_ZONE, DROPOFF_ZONE, FARE]
    full = with_duration(with_time_features(trips))
    added = [c for c in full.columns if c not in trips.columns]
    return full.select(*columns, *[F.round(c, 6).alias(c) if c in ROUNDED else c for c in added])


# What fitted models give has no SQL; ``cells_by_nodes`` and ``importance_by_nodes`` check it by a second way.
WITHOUT_SQL = {"importance_shares", "predicted_requests", "forest_errors"}
QUERIES = {
    # Sources and previews
    "raw_trips": _on(RAW, lambda df: df),
    "preview_head": _on(RAW, preview),
    "preview_tail": _on(RAW, preview, last=True),
    "zone_enrichment": zone_enrichment,
    "csv_round_trip": csv_round_trip,
    "csv_zones": csv_zones,
    "months_of_schemas": months_of_schemas,
    "clustered_trips": clustered,
    "clustered_route_info": _on(clustered, questions.route_info, 100, 9),
    "clustered_peak_hours": _on(clustered, questions.peak_hours, 100),
    "streamed_features": streamed_features,
    # Profile and audit
    "schema_profile": _on(RAW, profile.schema_profile),
    "describe_numeric": _on(RAW, profile.describe, digits=8),
    "null_profile": _on(RAW, profile.null_profile),
    "null_column_count": _on(RAW, profile.null_column_count),
    "worst_null_columns": _on(RAW, profile.worst_null_columns),
    "iqr_audit": _on(RAW, profile.iqr_audit, digits=8),
    "sign_audit": _on(RAW, profile.sign_audit),
    "passenger_validity": _on(RAW, profile.passenger_validity),
    "passenger_distribution": _on(RAW, profile.value_distribution),
    "time_order_audit": _on(RAW, profile.time_order_audit),
    "domain_summary": _on(RAW, profile.domain_summary),
    "domain_values": _on(RAW, profile.domain_values),
    "domain_anomalies": _on(RAW, profile.domain_anomalies),
    "domain_anomaly_total": _on(RAW, profile.domain_anomaly_total),
    "padding_audit": _on(RAW, profile.padding_audit),
    "duplicate_count": _on(RAW, profile.duplicate_count),
    "duplicate_count_by_marks": _on(RAW, profile.duplicate_count, whole_bytes=0),
    "distinct_by_marks": _on(RAW, distinct_rows, whole_bytes=0),
    "quality_report": _on(RAW, profile.quality_report),
    # Cleaning
    "key_null_profile": _on(RAW, profile.key_null_profile),
    "sparse_columns": sparse,
    "fare_consistency": _on(RAW, clean.fare_consistency),
    "reject_funnel": _on(RAW, clean.reject_funnel),
    "clean_stats": _on(RAW, clean.clean_stats),
    "clean_trips": _on(RAW, clean.clean),
    # Features
    "time_features": _on(CLEANED, features),
    "tip_rate_rows": _on(
        CLEANED, lambda df: fares.with_tip_rate(df).select(PAYMENT, FARE, "tip_rate")
    ),
    # Aggregates
    "demand_cube": cube,
    "demand_summary": _on(cube, demand.demand_summary),
    "hourly_by_daytype": _on(CLEANED, demand.hourly_by_day_type),
    "weekday_hour_counts": _on(CLEANED, demand.weekday_hour_counts),
    "weekday_hour_matrix": _on(CLEANED, demand.weekday_hour_matrix),
    "top_pickup_zones": _on(CLEANED, demand.top_groups, PICKUP_ZONE),
    "top_dropoff_zones": _on(CLEANED, demand.top_groups, DROPOFF_ZONE),
    "top5_zone_hourly": _on(CLEANED, demand.top_zone_hours),
    "od_flows": _on(CLEANED, demand.flows),
    "distance_fare_clip": _on(CLEANED, fares.distance_fare_points),
    "distance_fare_sample": sample_points,
    "hourly_fare_by_daytype": hourly_fares,
    "fare_by_passengers": _on(CLEANED, fares.fare_by_passengers, digits=8),
    "payment_share": _on(CLEANED, fares.payment_share),
    "tip_rate": _on(CLEANED, fares.tip_rates, digits=8),
    "fee_structure": _on(CLEANED, fares.fee_structure),
    "hourly_payment_share": _on(CLEANED, fares.hourly_payment_share),
    "payment_means": _on(CLEANED, fares.payment_means),
    "tip_means": _on(CLEANED, fares.tip_means),
    "distinct_flags": _on(RAW, demand.distinct_values, "store_and_fwd_flag", 5),
    "pickup_zone_count": _on(CLEANED, demand.distinct_count, PICKUP_ZONE),
    "fare_quantiles": _on(
        CLEANED, quantiles.exact_quantiles, [FARE, "trip_distance"], (0.01, 0.25, 0.5, 0.9, 0.99), digits=8
    ),
    "fare_quantiles_by_zone": _on(
        CLEANED, quantiles.exact_quantiles, [FARE], (0.25, 0.5, 0.75), [PICKUP_ZONE], digits=8
    ),
    # The most frequent keys, proven from counts of buckets
    "certified_flows": _on(CLEANED, top_keys, PICKUP_ZONE, DROPOFF_ZONE, top=15),
    "certified_users": _on(_events, top_keys, "user_id", top=20),
    "certified_parts": _on(_lineitem, top_keys, "l_partkey", "l_suppkey", top=25),
    # Audits of a folder that grows, from stored states
    **{f"grown_{name}": grown(report) for name, report in GROWN.items()},
    "grown_describe_numeric": lambda spark, sf_dir: rounded(grown_state(spark, sf_dir).describe()),
    "grown_demand_cube": lambda spark, sf_dir: grown_state(spark, sf_dir).cube(),
    # Questions
    "hourly_demand": _on(CLEANED, questions.hourly_demand, 100, WORKDAY),
    "hourly_demand_answer": _on(CLEANED, questions.hourly_demand_answer),
    "hourly_demand_zone_answer": _on(CLEANED, questions.hourly_demand_answer, 100, WEEKEND),
    "location_ranking": _on(CLEANED, questions.location_ranking, BOARDING, 10),
    "location_ranking_dropoff": _on(CLEANED, questions.location_ranking, ALIGHTING, 5),
    "route_info": _on(CLEANED, questions.route_info, 100, None),
    "route_info_empty": _on(CLEANED, questions.route_info, 100, 9999),
    "route_table": full_routes,
    "payment_analysis": _on(CLEANED, questions.payment_analysis),
    "peak_hours": _on(CLEANED, questions.peak_hours, 100),
    "tag_questions": tag_questions,
    "tag_urls": tag_urls,
    "answer_all": answer_questions,
    # Model
    "zone_encoder": _on(cube, encoding.zone_encoder),
    "encoded_cube": lambda spark, sf_dir: rounded(encoded_cube(spark, sf_dir), 6),
    "scaled_features": scaled_cube,
    "unscaled_demand": unscaled_demand,
    "split_counts": _on(cube, encoding.split_counts),
    "error_metrics": _on(mean_prediction, evaluation.error_metrics, digits=4),
    "mean_model_comparison": lambda spark, sf_dir: rounded(
        evaluation.compare_models(
            {"by_hour": flat_prediction(spark, sf_dir), "by_cell": mean_prediction(spark, sf_dir)}
        ),
        4,
    ),
    "residual_summary": lambda spark, sf_dir: rounded(
        evaluation.residual_summary(evaluation.with_residual(mean_prediction(spark, sf_dir))), 4
    ),
    "residual_histogram": lambda spark, sf_dir: rounded(
        evaluation.residual_histogram(evaluation.with_residual(mean_prediction(spark, sf_dir))), 4
    ),
    "actual_predicted": _on(mean_prediction, evaluation.actual_predicted, digits=4),
    "actual_range": _on(mean_prediction, evaluation.actual_range),
    "forest_predictions": forest_predictions,
    "model_comparison": model_comparison,
    "feature_importance": feature_importance,
    "score_requests": score_requests,
    "tree_group_means": tree_group_means,
    "cells_by_nodes": cells_by_nodes,
    "importance_by_nodes": importance_by_nodes,
    "importance_shares": importance_shares,
    "predicted_requests": predicted_requests,
    "forest_errors": forest_errors,
    "feature_vectors": feature_vectors,
    "scaled_on_train": scaled_on_train,
    # The analysis chain: the same data sets from two aggregates
    **{f"chain_{name}": chained(name) for name in CHAINED},
    "chain_hourly_fare_by_daytype": chained_fares,
    # The same operators on another table
    "events_hourly": _on(_events, demand.hourly_by_day_type, "ts"),
    "events_iqr": _on(_events, profile.iqr_audit, ["value"], digits=8),
    "events_top_users": _on(_events, demand.top_groups, "user_id", top=20),
    "events_describe": _on(_events, profile.describe, ["value"], digits=8),
    "events_value_histogram": _on(_events, histogram, "value", 50, digits=8),
}
