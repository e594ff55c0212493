"""Audits of a folder that grows: each file is read once, and reports are made of stored partial states.

The state of a file holds counts (rows, values present, signs, rejected rows by
reason and so on), its code values, its bucket state of the numeric columns
and its cells of the demand cube. All of them add up, so a report on all files
is a sum of small rows. A file is known by path, length and time of change: a
changed file is read again and its old state no longer counts, nor does that of
a file that is gone.

Each update writes one batch to the state's tables and the list of its files
last. A batch without that list - its job was lost - counts for nothing, and of
two batches that both read a file one counts. A batch whose files all lack a
column is judged without the rules on it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.functions.values import is_float, missing, percent
from curbmeter.operators import profile
from curbmeter.operators.buckets import Distribution, bucket_state, merged_state, tall_values
from curbmeter.operators.clean import KEPT, has_keys, keep_valid, present, trip_rules
from curbmeter.operators.demand import demand_cube
from curbmeter.schema import (
    CODE_DOMAINS,
    DROPOFF_TIME,
    FARE,
    KEY_COLUMNS,
    PASSENGERS,
    PICKUP_TIME,
    PICKUP_ZONE,
    SIGN_COLUMNS,
    STORE_FLAG,
    TOTAL,
)
from curbmeter.session import broadcast_if_small, cut_lineage
from curbmeter.sources.months import read_months

VERSION = ("file", "length", "modified")
TABLES = ("files", "counts", "codes", "buckets", "cube")
FILE = "_state_file"


def judged(df: DataFrame) -> DataFrame:
    """Add the number of the first broken rule, or of the rules for a row that is kept, and whether all keys are there.

    Both are worked out once per row for all counts; text of reasons would be compared in each.
    """
    rules, reason = trip_rules(df), F
    for i, rule in enumerate(rules):
        reason = reason.when(~rule.keep, F.lit(i))
    return df.withColumns({"_reason": reason.otherwise(F.lit(len(rules))), "_keyed": has_keys(df)})


def counted(df: DataFrame) -> dict:
    """Aggregates by ``(measure, column)`` over :func:`judged` rows; each is a number of rows, so those of files add up."""
    found = {("rows", ""): F.count("*"), ("keyed", ""): F.count_if("_keyed")}
    for c in [c for c in df.columns if c not in (FILE, "_reason", "_keyed")]:
        found["present", c] = F.count_if(~missing(df, c))
        found["keyed_present", c] = F.count_if(F.col("_keyed") & ~missing(df, c))
    for c in present(df, SIGN_COLUMNS):
        found["negative", c] = F.count_if(F.col(c) < 0)
        found["zero", c] = F.count_if(F.col(c) == 0)
    for i, reason in enumerate([*[rule.reason for rule in trip_rules(df)], KEPT]):
        found["reason", reason] = F.count_if(F.col("_reason") == i)
    if PASSENGERS in df.columns:
        found["passengers", ""] = F.count_if(F.col(PASSENGERS) <= 0)
    if {PICKUP_TIME, DROPOFF_TIME} <= set(df.columns):
        found["time_order", ""] = F.count_if(F.col(DROPOFF_TIME) <= F.col(PICKUP_TIME))
    if {TOTAL, FARE} <= set(df.columns):
        found["consistency", ""] = F.count_if(F.col(TOTAL) < F.col(FARE))
    if STORE_FLAG in df.columns:
        text = F.col(STORE_FLAG).cast("string")
        found["leading", ""] = F.count_if(F.startswith(text, F.lit(" ")))
        found["trailing", ""] = F.count_if(F.endswith(text, F.lit(" ")))
    return found


def counts_by_file(trips: DataFrame) -> DataFrame:
    """``(file, measure, column, n)``, from one scan."""
    rows = judged(trips)
    measures = counted(rows)
    one = rows.groupBy(FILE).agg(*[value.alias(f"m{i}") for i, value in enumerate(measures.values())])
    entries = [
        F.struct(F.lit(m).alias("measure"), F.lit(c).alias("column"), F.col(f"m{i}").alias("n"))
        for i, (m, c) in enumerate(measures)
    ]
    return one.select(FILE, F.inline(F.array(*entries)))


def codes_by_file(trips: DataFrame) -> DataFrame:
    """``(file, column, value, rows)`` of the code columns and the passenger count; a column that is absent is null."""
    names = list(dict.fromkeys([*[d.column for d in CODE_DOMAINS], PASSENGERS]))
    absent = {c: F.lit(None).cast("string") for c in names if c not in trips.columns}
    return profile.text_counts(trips.withColumns(absent), names, [FILE])


def numbered_files(trips: DataFrame, files: list) -> tuple:
    """The trips with a hash in the place of their file's path, and the file of each hash.

    The states are counted per file: a path is a hundred bytes or more, which
    would be copied and compared for each value of a row. Should two of the
    files share a hash, they keep their paths.
    """
    names = trips.sparkSession.createDataFrame([(f,) for f in files], "file string")
    hashed = names.select("file", F.xxhash64("file").alias(FILE))
    if hashed.select(FILE).distinct().count() < len(files):
        return trips, names.withColumn(FILE, F.col("file"))
    return trips.withColumn(FILE, F.xxhash64(FILE)), hashed


@dataclass
class AuditState:
    """The stored states of the Parquet files under ``source``, in the shared folder ``folder``."""

    spark: SparkSession
    source: str
    folder: str

    def listing(self) -> DataFrame:
        """The files there are now, with their version; no content is read."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        found = reader.option("pathGlobFilter", "*.parquet").load(self.source)
        return found.select(
            F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"), "path"
        )

    def _written(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def live(self) -> DataFrame:
        """The files whose state is stored and which are still there as they were, each with the batch that counts."""
        known = self.spark.read.parquet(f"{self.folder}/files").groupBy(*VERSION).agg(F.min("batch").alias("batch"))
        return known.join(self.listing(), list(VERSION))

    def pending(self) -> DataFrame:
        """Files that are new or changed."""
        found = self.listing()
        if not self._written("files"):
            return found
        return found.join(self.spark.read.parquet(f"{self.folder}/files"), list(VERSION), "left_anti")

    def update(self) -> int:
        """Read the new and changed files, each once per table of the state, and store their states; returns how many.

        The names of these files come to the driver, as for any read; nothing of other files is read.
        """
        new = self.pending().collect()
        if not new:
            return 0
        trips, names = numbered_files(read_months(self.spark, [row["path"] for row in new], file_column=FILE), [row["file"] for row in new])
        values = trips.drop(FILE)
        numeric = profile.columns_of_kind(values, "numeric")
        tables = {
            "counts": counts_by_file(trips),
            "codes": codes_by_file(trips),
            "buckets": bucket_state(tall_values(trips, numeric, [FILE]), [FILE, "column"]),
            "cube": self._cells(trips),
        }
        batch = uuid.uuid4().hex
        for name, states in tables.items():
            # One row per new file.
            self._append(name, states.join(F.broadcast(names), FILE).drop(FILE), batch)
        kinds = T.StructType([T.StructField("file", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType())])
        listed = [tuple(row[c] for c in VERSION) for row in new]
        self._append("files", self.spark.createDataFrame(listed, kinds), batch)
        return len(new)

    @staticmethod
    def _cells(trips: DataFrame) -> DataFrame:
        kept = keep_valid(trips)
        # One column of file and zone, so that the cube is that of A1 for each file.
        pairs = kept.where(F.col(PICKUP_ZONE).isNotNull()).withColumn("place", F.struct(FILE, F.col(PICKUP_ZONE).cast("long").alias("zone")))
        cells = demand_cube(pairs, "place")
        return cells.select(F.col(f"place.{FILE}").alias(FILE), "place.zone", "pickup_hour", "pickup_weekday", "demand")

    def _append(self, name: str, states: DataFrame, batch: str) -> None:
        states.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/{name}")

    def _states(self, name: str) -> DataFrame:
        counts = broadcast_if_small(cut_lineage(self.live().select("file", "batch")))
        return self.spark.read.parquet(f"{self.folder}/{name}").join(counts, ["file", "batch"], "left_semi")

    def trips(self) -> DataFrame:
        """The rows of all files whose state counts."""
        return read_months(self.spark, [row["path"] for row in self.live().select("path").collect()])

    def cube(self, zone: str = PICKUP_ZONE) -> DataFrame:
        """Trips that pass the rules per zone, hour and weekday (A1).

        Repeated rows are not taken out: whether a row occurs in another file does not follow from the states.
        """
        return self._states("cube").groupBy(F.col("zone").alias(zone), "pickup_hour", "pickup_weekday").agg(F.sum("demand").alias("demand"))

    def codes(self) -> DataFrame:
        """``column, value, rows`` of the code columns and the passenger count."""
        return self._states("codes").groupBy("column", "value").agg(F.sum("rows").alias("rows"))

    def describe(self) -> DataFrame:
        """Count, mean, sample deviation, extremes and quartiles per numeric column.

        All but the quartiles come from the states; these take one scan of the buckets they lie in, as pushed filters.
        """
        trips = self.trips()
        numeric = profile.columns_of_kind(trips, "numeric")
        return profile.described(Distribution(trips, numeric, state=merged_state(self._states("buckets"), ["column"])))

    def quartile_brackets(self) -> DataFrame:
        """Between which values of the data the quartiles lie, from the states alone; a bucket is 0.8 % wide."""
        state = cut_lineage(merged_state(self._states("buckets"), ["column"]))
        columns = sorted(row["column"] for row in state.select("column").distinct().collect())
        known = Distribution(self.spark.range(0), columns, state=state)
        rows = [(c, p, *known.want_quantile([(c,)], p)) for c in columns for p in profile.QUARTILES]
        return self.spark.createDataFrame(rows, "column string, p double, low double, high double")

    def reports(self) -> dict:
        """The reports that add up, by the names of the batch run; the trips are not read."""
        totals = cut_lineage(self._states("counts").groupBy("measure", "column").agg(F.sum("n").alias("n")))
        rows = self._one(totals, "rows")
        keyed = self._one(totals, "keyed")

        def of(measure: str) -> DataFrame:
            return totals.where(F.col("measure") == measure).select("column", "n")

        absent = of("present").select("column", (rows - F.col("n")).alias("nulls"))
        rated = absent.select("column", "nulls", percent(F.col("nulls"), rows).alias("rate_pct"))
        zeros = of("zero").withColumnRenamed("n", "zero")
        signs = of("negative").withColumnRenamed("n", "negative").join(zeros, "column")
        # One row per column.
        known = {row["column"] for row in of("present").collect()}
        codes = cut_lineage(self.codes().where(F.col("column").isin(*known)))
        coded = [d for d in CODE_DOMAINS if d.column in known]
        domains = codes.where(F.col("column").isin([d.column for d in coded]))
        # The reports on code columns look at the names of the table's columns only.
        schema = self.spark.createDataFrame([], T.StructType([T.StructField(d.column, T.StringType()) for d in coded]))
        return {
            "rows": totals.where(F.col("measure") == "rows").select(F.col("n").alias("rows")),
            "nulls": rated.where(F.col("nulls") > 0).orderBy(F.desc("rate_pct"), "column"),
            "key_nulls": rated.where(F.col("column").isin(*KEY_COLUMNS)).orderBy(F.desc("rate_pct"), "column"),
            "signs": signs.select("column", "negative", percent(F.col("negative"), rows).alias("negative_pct"), "zero", percent(F.col("zero"), rows).alias("zero_pct")),
            "passengers": self._failures(totals, "passengers", rows),
            "time_order": self._failures(totals, "time_order", rows),
            "padding": totals.agg(*[F.sum(F.when(F.col("measure") == m, F.col("n"))).alias(m) for m in ("leading", "trailing")]),
            "consistency": totals.agg(rows.alias("rows"), F.sum(F.when(F.col("measure") == "consistency", F.col("n"))).alias("total_below_fare")).withColumn("rate_pct", percent(F.col("total_below_fare"), F.col("rows"))),
            "sparse": of("keyed_present").where(~F.col("column").isin(*KEY_COLUMNS) & (F.try_divide((keyed - F.col("n")).cast("double"), keyed) > 0.5)).select("column"),
            "rejected": of("reason").where("n > 0").select(F.col("column").alias("reason"), F.col("n").alias("rows")),
            "passenger_counts": codes.where((F.col("column") == PASSENGERS) & F.col("value").isNotNull()).select(F.col("value").cast("double").alias(PASSENGERS), "rows").orderBy(PASSENGERS),
            "domains": profile.domain_summary(schema, counts=domains),
            "domain_values": profile.domain_values(schema, counts=domains),
            "domain_anomalies": profile.domain_anomalies(schema, counts=domains),
            "anomaly_total": profile.domain_anomaly_total(schema, counts=domains),
        }

    @staticmethod
    def _one(totals: DataFrame, measure: str):
        return totals.where(F.col("measure") == measure).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()

    @staticmethod
    def _failures(totals: DataFrame, measure: str, rows) -> DataFrame:
        found = totals.agg(F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0)).alias("invalid"))
        return found.select("invalid", percent(F.col("invalid"), rows).alias("rate_pct"))
