"""Column names, types and fixed value tables of the taxi-trip preset.

Every operator takes column names as arguments; the names below are only the
defaults, so the same operators run on any table with comparable columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VENDOR = "VendorID"
PICKUP_TIME = "tpep_pickup_datetime"
DROPOFF_TIME = "tpep_dropoff_datetime"
PASSENGERS = "passenger_count"
DISTANCE = "trip_distance"
RATE_CODE = "RatecodeID"
STORE_FLAG = "store_and_fwd_flag"
PICKUP_ZONE = "PULocationID"
DROPOFF_ZONE = "DOLocationID"
PAYMENT = "payment_type"
FARE = "fare_amount"
TIP = "tip_amount"
TOLLS = "tolls_amount"
TOTAL = "total_amount"

TRIP_SCHEMA = T.StructType(
    [
        T.StructField(VENDOR, T.IntegerType()),
        T.StructField(PICKUP_TIME, T.TimestampNTZType()),
        T.StructField(DROPOFF_TIME, T.TimestampNTZType()),
        T.StructField(PASSENGERS, T.DoubleType()),
        T.StructField(DISTANCE, T.DoubleType()),
        T.StructField(RATE_CODE, T.DoubleType()),
        T.StructField(STORE_FLAG, T.StringType()),
        T.StructField(PICKUP_ZONE, T.IntegerType()),
        T.StructField(DROPOFF_ZONE, T.IntegerType()),
        T.StructField(PAYMENT, T.IntegerType()),
        T.StructField(FARE, T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField(TIP, T.DoubleType()),
        T.StructField(TOLLS, T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField(TOTAL, T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("airport_fee", T.DoubleType()),
    ]
)

ZONE_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.IntegerType()),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)

# A trip without one of these cannot be used and is dropped.
KEY_COLUMNS = (PICKUP_TIME, DROPOFF_TIME, DISTANCE, FARE, TOTAL, PASSENGERS)

# Columns of the outlier audit and of the sign audit.
IQR_COLUMNS = (
    DISTANCE,
    FARE,
    TIP,
    TOLLS,
    TOTAL,
    PASSENGERS,
    "extra",
    "mta_tax",
    "improvement_surcharge",
    "congestion_surcharge",
    "airport_fee",
)
SIGN_COLUMNS = (DISTANCE, FARE, TIP, TOLLS, TOTAL)

# Hours of the rush-hour flag, weekend days (Monday = 0).
RUSH_HOURS = (7, 8, 9, 17, 18, 19)
WEEKEND_DAYS = (5, 6)

# Day types and boarding sides as they are written in questions.
WORKDAY, WEEKEND, ALL_DAYS = "工作日", "周末", "全部"
BOARDING, ALIGHTING = "上车", "下车"
WEEKDAY_NAMES = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")

# Payment names used in reports.
PAYMENT_NAMES = {1: "信用卡", 2: "现金", 3: "免费", 4: "争议/拒付"}
UNKNOWN_PAYMENT_PREFIX = "类型"


@dataclass(frozen=True)
class CodeDomain:
    """Legal values of a code column and what each known value means."""

    column: str
    standard: tuple
    meanings: dict
    trimmed: bool = False


# The data dictionary of the four code columns.
CODE_DOMAINS = (
    CodeDomain(
        VENDOR,
        (1, 2),
        {
            1: "Creative Mobile Technologies",
            2: "VeriFone Inc.",
            6: "未知供应商(异常)",
            7: "未知供应商(异常)",
        },
    ),
    CodeDomain(
        RATE_CODE,
        (1, 2, 3, 4, 5, 6),
        {
            1: "标准费率",
            2: "JFK机场",
            3: "纽瓦克机场",
            4: "Nassau或Westchester",
            5: "议价费率",
            6: "团体行程",
            99: "未知费率(异常)",
        },
    ),
    CodeDomain(
        STORE_FLAG,
        ("Y", "N"),
        {"Y": "存储后转发", "N": "实时发送"},
        trimmed=True,
    ),
    CodeDomain(
        PAYMENT,
        (1, 2, 3, 4),
        {
            0: "未知支付方式(异常)",
            1: "信用卡",
            2: "现金",
            3: "无费用",
            4: "争议/拒付",
            5: "未知(异常)",
            6: "无效行程(异常)",
        },
    ),
)
UNKNOWN_MEANING = "未知异常值"

# Codes that disqualify a trip.
BAD_PAYMENTS = (0, 5, 6)
BAD_RATES = (99,)
BAD_VENDORS = (6, 7)
GOOD_FLAGS = ("Y", "N")


def code_table(spark: SparkSession, domains=CODE_DOMAINS) -> DataFrame:
    """The data dictionary as rows ``(column, value, meaning, is_standard)``."""
    rows = [
        (domain.column, str(value), meaning, value in domain.standard)
        for domain in domains
        for value, meaning in domain.meanings.items()
    ]
    return spark.createDataFrame(
        rows, "column string, value string, meaning string, is_standard boolean"
    )
