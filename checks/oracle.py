"""The SQL that each registered query is compared with, in DuckDB's dialect."""

from __future__ import annotations

TRIPS = """
base AS (
  SELECT *, l_orderkey*7919 + l_linenumber*104729 + l_partkey*1299709 + l_suppkey*15485863 AS h
  FROM lineitem
), mixed AS (
  SELECT *, h % 1009 AS a, (h % 10007) % 100 AS b, (h % 100003) % 86400 AS s,
         l_extendedprice / 1000.0::DOUBLE AS fare0
  FROM base
), priced AS (
  SELECT *, CASE WHEN b < 60 THEN fare0 * l_discount * 3.0::DOUBLE ELSE 0::DOUBLE END AS tip0,
         CASE WHEN a % 17 = 0 THEN 6.55::DOUBLE ELSE 0::DOUBLE END AS toll0,
         l_shipdate + to_seconds(s) AS pick
  FROM mixed
), once AS (
  SELECT a,
    CAST(CASE WHEN a % 79 = 0 THEN NULL WHEN a % 97 = 0 THEN 6 WHEN a % 89 = 0 THEN 7
         ELSE 1 + b % 2 END AS INTEGER) AS VendorID,
    pick AS tpep_pickup_datetime,
    pick + to_minutes(CAST(b % 61 - 1 AS BIGINT)) AS tpep_dropoff_datetime,
    CAST(CASE WHEN a % 41 = 0 THEN NULL WHEN b < 3 THEN 0 ELSE 1 + b % 6 END AS DOUBLE) AS passenger_count,
    CASE WHEN b = 7 THEN 0::DOUBLE WHEN b = 8 THEN -1::DOUBLE ELSE l_quantity / 2::DOUBLE END AS trip_distance,
    CAST(CASE WHEN a % 43 = 0 THEN NULL WHEN b BETWEEN 90 AND 92 THEN 99 ELSE 1 + a % 6 END AS DOUBLE) AS RatecodeID,
    CASE WHEN a % 37 = 0 THEN NULL WHEN b = 11 THEN ' Y' WHEN b = 12 THEN 'N ' WHEN b = 13 THEN 'X'
         WHEN b < 20 THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
    CAST(1 + l_suppkey % 265 AS INTEGER) AS PULocationID,
    CAST(1 + l_partkey % 265 AS INTEGER) AS DOLocationID,
    CAST(CASE WHEN a % 83 = 0 THEN NULL WHEN b < 60 THEN 1 WHEN b < 85 THEN 2 WHEN b < 88 THEN 3
         WHEN b < 91 THEN 4 WHEN b < 93 THEN 0 WHEN b < 95 THEN 5 WHEN b < 97 THEN 6 ELSE 1 END
         AS INTEGER) AS payment_type,
    CASE WHEN b = 9 THEN -fare0 ELSE fare0 END AS fare_amount,
    tip0 AS tip_amount,
    toll0 AS tolls_amount,
    CASE WHEN b = 10 THEN 0::DOUBLE
         ELSE fare0 * (1::DOUBLE + l_tax) + 3.5::DOUBLE + tip0 + toll0 END AS total_amount,
    CASE WHEN a % 3 = 0 THEN l_tax END AS airport_fee
  FROM priced
), trips AS (
  SELECT * EXCLUDE (a) FROM once
  UNION ALL
  SELECT * EXCLUDE (a) FROM once WHERE a % 101 = 0
)"""

REASON = """CASE
  WHEN tpep_pickup_datetime IS NULL OR tpep_dropoff_datetime IS NULL OR trip_distance IS NULL
    OR fare_amount IS NULL OR total_amount IS NULL OR passenger_count IS NULL THEN '01 missing key'
  WHEN trip_distance <= 0 THEN '02 distance not positive'
  WHEN fare_amount <= 0 THEN '03 fare not positive'
  WHEN passenger_count <= 0 THEN '04 passengers not positive'
  WHEN tpep_dropoff_datetime <= tpep_pickup_datetime THEN '05 dropoff not after pickup'
  WHEN payment_type IN (0, 5, 6) THEN '06 payment code'
  WHEN RatecodeID = 99 THEN '07 rate code'
  WHEN VendorID IN (6, 7) THEN '08 vendor code'
  WHEN store_and_fwd_flag IS NULL OR trim(store_and_fwd_flag) NOT IN ('Y', 'N') THEN '09 store flag'
  ELSE '10 kept' END"""

COLUMNS = (
    "VendorID tpep_pickup_datetime tpep_dropoff_datetime passenger_count trip_distance RatecodeID "
    "store_and_fwd_flag PULocationID DOLocationID payment_type fare_amount tip_amount tolls_amount "
    "total_amount airport_fee"
).split()
NUMERIC = [
    c for c in COLUMNS
    if c not in ("tpep_pickup_datetime", "tpep_dropoff_datetime", "store_and_fwd_flag")
]
DOUBLES = [
    "passenger_count", "trip_distance", "RatecodeID", "fare_amount", "tip_amount", "tolls_amount",
    "total_amount", "airport_fee",
]
IQR = [
    "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount",
    "passenger_count", "airport_fee",
]
KEYS = [
    "tpep_pickup_datetime", "tpep_dropoff_datetime", "trip_distance", "fare_amount",
    "total_amount", "passenger_count",
]

CLEANED = f"""{TRIPS}, tagged AS (SELECT *, {REASON} AS reason FROM trips),
cleaned AS (
  SELECT DISTINCT * EXCLUDE (reason, airport_fee) REPLACE (trim(store_and_fwd_flag) AS store_and_fwd_flag)
  FROM tagged WHERE reason = '10 kept'
), clocked AS (
  SELECT *, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         CAST(isodow(tpep_pickup_datetime) - 1 AS INTEGER) AS pickup_weekday,
         isodow(tpep_pickup_datetime) >= 6 AS is_weekend
  FROM cleaned
), hours AS (SELECT CAST(range AS INTEGER) AS pickup_hour FROM range(24)),
slots AS (SELECT * FROM (VALUES (true), (false)) d(is_weekend), hours),
cube AS (
  SELECT PULocationID, pickup_hour, pickup_weekday, count(*) AS demand
  FROM clocked GROUP BY ALL
), encoder AS (
  SELECT PULocationID, CAST(row_number() OVER (ORDER BY PULocationID) - 1 AS INTEGER) AS location_encoded
  FROM (SELECT DISTINCT PULocationID FROM cube)
), encoded AS (
  SELECT PULocationID, pickup_hour, pickup_weekday, demand, location_encoded,
    sin(pickup_hour * (2 * pi()) / 24) AS hour_sin, cos(pickup_hour * (2 * pi()) / 24) AS hour_cos,
    sin(pickup_weekday * (2 * pi()) / 7) AS weekday_sin, cos(pickup_weekday * (2 * pi()) / 7) AS weekday_cos,
    CAST(pickup_weekday >= 5 AS INTEGER) AS is_weekend,
    CAST(pickup_hour IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour
  FROM cube JOIN encoder USING (PULocationID)
), parts AS (
  SELECT *, (PULocationID * 131 + pickup_hour * 17 + pickup_weekday * 7) % 5 = 0 AS is_test FROM cube
), by_cell AS (
  SELECT t.*, m.prediction FROM parts t JOIN (
    SELECT pickup_hour, pickup_weekday, avg(demand) AS prediction FROM parts WHERE NOT is_test GROUP BY ALL
  ) m USING (pickup_hour, pickup_weekday) WHERE is_test
), by_hour AS (
  SELECT t.*, m.prediction FROM parts t JOIN (
    SELECT pickup_hour, avg(demand) AS prediction FROM parts WHERE NOT is_test GROUP BY ALL
  ) m USING (pickup_hour) WHERE is_test
)"""

PAYMENT_NAME = """CASE payment_type WHEN 1 THEN '信用卡' WHEN 2 THEN '现金' WHEN 3 THEN '免费'
  WHEN 4 THEN '争议/拒付' ELSE '类型' || payment_type END"""
DURATION = "(epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 6e7::DOUBLE"


def raw(select: str) -> str:
    return f"WITH {TRIPS}\n{select}"


def cleaned(select: str) -> str:
    return f"WITH {CLEANED}\n{select}"


def per_column(columns, select: str) -> str:
    """The select for each column, ``{c}`` filled in, as one union."""
    return " UNION ALL ".join("(" + select.format(c=c) + ")" for c in columns)


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round_even(({part})::DOUBLE / ({whole}) * 100.0::DOUBLE, {digits})"


def mean(expression: str, digits: int = 2) -> str:
    return f"round_even(avg({expression}), {digits})"


def iqr_of(source: str, column: str) -> str:
    q = f"SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}"
    return f"""SELECT '{column}' AS "column", round(q1, 8) AS q1, round(q3, 8) AS q3,
      round(q3 - q1, 8) AS iqr, round(q1 - 1.5 * (q3 - q1), 8) + 0.0 AS lower,
      round(q3 + 1.5 * (q3 - q1), 8) AS upper, n AS outliers, {pct('n', 'm')} AS rate_pct
    FROM (SELECT any_value(q1) AS q1, any_value(q3) AS q3, count(*) AS m,
            count(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS n
          FROM {source}, ({q}))"""


def describe_of(source: str, column: str) -> str:
    numbers = {
        "mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})",
        "q25": f"quantile_cont({column}::DOUBLE, 0.25)", "q50": f"quantile_cont({column}::DOUBLE, 0.5)",
        "q75": f"quantile_cont({column}::DOUBLE, 0.75)", "max": f"max({column})",
    }
    parts = ", ".join(f"round({e}::DOUBLE, {6 if n in ('mean', 'std') else 8}) + 0.0 AS {n}" for n, e in numbers.items())
    return f"""SELECT '{column}' AS "column", count({column}) AS count, {parts} FROM {source}"""


NULLS = per_column(
    COLUMNS,
    """SELECT '{c}' AS "column", n AS nulls, round_even(n::DOUBLE / m * 100.0::DOUBLE, 2) AS rate_pct
       FROM (SELECT count(*) AS m, count(*) FILTER ({c} IS NULL) AS n FROM trips)""",
)

CODES = {
    "VendorID": "CAST(VendorID AS VARCHAR)",
    "RatecodeID": "CAST(CAST(RatecodeID AS BIGINT) AS VARCHAR)",
    "store_and_fwd_flag": "store_and_fwd_flag",
    "payment_type": "CAST(payment_type AS VARCHAR)",
}
CODE_COUNTS = "codes AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {e} AS value, count(*) AS n FROM trips GROUP BY ALL"""
    for c, e in CODES.items()
) + """), dictionary("column", value, meaning, ok) AS (VALUES
  ('VendorID', '1', 'Creative Mobile Technologies', true), ('VendorID', '2', 'VeriFone Inc.', true),
  ('VendorID', '6', '未知供应商(异常)', false), ('VendorID', '7', '未知供应商(异常)', false),
  ('RatecodeID', '1', '标准费率', true), ('RatecodeID', '2', 'JFK机场', true),
  ('RatecodeID', '3', '纽瓦克机场', true), ('RatecodeID', '4', 'Nassau或Westchester', true),
  ('RatecodeID', '5', '议价费率', true), ('RatecodeID', '6', '团体行程', true),
  ('RatecodeID', '99', '未知费率(异常)', false),
  ('store_and_fwd_flag', 'Y', '存储后转发', true), ('store_and_fwd_flag', 'N', '实时发送', true),
  ('payment_type', '0', '未知支付方式(异常)', false), ('payment_type', '1', '信用卡', true),
  ('payment_type', '2', '现金', true), ('payment_type', '3', '无费用', true),
  ('payment_type', '4', '争议/拒付', true), ('payment_type', '5', '未知(异常)', false),
  ('payment_type', '6', '无效行程(异常)', false)
), judged AS (
  SELECT c."column", c.value, c.n, sum(c.n) OVER (PARTITION BY c."column") AS m,
    coalesce((CASE WHEN c."column" = 'store_and_fwd_flag' THEN trim(c.value) ELSE c.value END) IN
      (SELECT d.value FROM dictionary d WHERE d."column" = c."column" AND d.ok), false) AS is_standard
  FROM codes c
)"""

DISTINCT_TRIPS = "(SELECT count(*) FROM (SELECT DISTINCT * FROM trips))"
STATS = f"""stats AS (
  SELECT count(*) AS rows_before, (SELECT count(*) FROM cleaned) AS rows_after,
    count(*) FILTER (reason < '02') AS removed_missing,
    count(*) FILTER (reason > '02' AND reason < '06') AS removed_outlier,
    count(*) FILTER (reason > '06' AND reason < '10') AS removed_category,
    count(*) FILTER (reason = '10 kept') - (SELECT count(*) FROM cleaned) AS removed_duplicate
  FROM tagged)"""

POINTS = """points AS (
  SELECT * FROM cleaned WHERE trip_distance > 0
    AND trip_distance <= (SELECT quantile_cont(trip_distance, 0.99) FROM cleaned)
    AND fare_amount <= (SELECT quantile_cont(fare_amount, 0.99) FROM cleaned))"""
BOXED = """rows6 AS (
  SELECT passenger_count, fare_amount FROM cleaned WHERE passenger_count IN (1, 2, 3, 4, 5, 6)
    AND fare_amount <= (SELECT quantile_cont(fare_amount, 0.99) FROM cleaned)
), boxes AS (
  SELECT passenger_count, quantile_cont(fare_amount, 0.25) AS q1, quantile_cont(fare_amount, 0.5) AS median,
    quantile_cont(fare_amount, 0.75) AS q3 FROM rows6 GROUP BY ALL
), placed AS (
  SELECT *, fare_amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM rows6 JOIN boxes USING (passenger_count))"""

ROUTE = f"""count(*) AS trip_count, {mean('trip_distance')} AS avg_distance, {mean('fare_amount')} AS avg_fare,
  {mean('total_amount')} AS avg_total, {mean(DURATION, 1)} AS avg_duration_min, {mean('tip_amount')} AS avg_tip"""


def on_hours(condition: str) -> str:
    return f"""hourly AS (
      SELECT pickup_hour, count(c.PULocationID) AS trips
      FROM hours LEFT JOIN (SELECT * FROM clocked WHERE {condition}) c USING (pickup_hour) GROUP BY ALL)"""


def hourly_answer(condition: str) -> str:
    def peak(where: str) -> str:
        return f"(SELECT pickup_hour FROM hourly WHERE {where} ORDER BY trips DESC, pickup_hour LIMIT 1)"

    morning, evening = "pickup_hour BETWEEN 6 AND 9", "pickup_hour BETWEEN 16 AND 19"
    return f"""WITH {CLEANED}, {on_hours(condition)}
    SELECT {peak('true')} AS peak_hour, max(trips) AS peak_trips, {mean('trips', 1)} AS avg_demand,
      {peak(morning)} AS morning_peak_hour, max(trips) FILTER ({morning}) AS morning_peak_trips,
      {peak(evening)} AS evening_peak_hour, max(trips) FILTER ({evening}) AS evening_peak_trips FROM hourly"""


def grid(condition: str = "true") -> str:
    return cleaned(
        f"""SELECT is_weekend, pickup_hour, count(c.PULocationID) AS trips
        FROM slots LEFT JOIN (SELECT * FROM clocked WHERE {condition}) c USING (is_weekend, pickup_hour)
        GROUP BY ALL"""
    )


def top_zones(column: str, n: int) -> str:
    return f"""SELECT {column}, count(*) AS trips FROM cleaned WHERE {column} IS NOT NULL
      GROUP BY ALL ORDER BY trips DESC, {column} LIMIT {n}"""


def ranking(column: str, n: int) -> str:
    return cleaned(
        f"""SELECT {column} AS location, count(*) AS trips,
          (SELECT count(DISTINCT {column}) FROM cleaned) AS total_locations
        FROM cleaned GROUP BY ALL ORDER BY trips DESC, location LIMIT {n}"""
    )


def errors(source: str) -> str:
    return f"""SELECT count(*) AS n, avg(abs(demand - prediction)) AS mae,
      sqrt(avg((demand - prediction) * (demand - prediction))) AS rmse FROM {source}"""


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def rule_case(text: str, rules, default: str) -> str:
    cases = " ".join(
        f"WHEN {contains_any(text, words)} THEN {value if isinstance(value, int) else repr(value)}"
        for value, words in rules
    )
    return f"CASE {cases} ELSE {default} END"


def number(text: str, pattern: str, type: str = "BIGINT") -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '{pattern}', 1), '') AS {type})"


QUESTION = """CASE DOLocationID % 7
  WHEN 0 THEN '请预计区域' || PULocationID || '星期' || day || ' ' || pickup_hour || '时会有多少订单'
  WHEN 1 THEN '上客最热门的地方 Top ' || (PULocationID % 20 + 1)
  WHEN 2 THEN '从区域' || PULocationID || '去区域 ' || DOLocationID || ' 大约要多少钱'
  WHEN 3 THEN pickup_hour || ':00 左右现金与信用卡的付款比例'
  WHEN 4 THEN '星期' || day || '哪段路最忙'
  WHEN 5 THEN '平日区域 ' || PULocationID || ' 每小时的订单'
  ELSE '假日下客排行前' || (PULocationID % 20 + 1) || '的地方' END"""
# Fixed values in what follows: the words of the rules, labels, codes and patterns.
DAYS = "一二三四五六日"
QUESTION_INTENT = rule_case(
    "t",
    (
        ("predict", ("预测", "预计", "预估", "会有多少", "需求量")),
        ("ranking", ("排名", "排行", "top", "热门", "热度")),
        ("peak_hours", ("高峰", "繁忙", "最忙", "峰值")),
        ("hourly_demand", ("时段", "小时", "每小时", "分小时", "几点")),
        ("route_info", ("费用", "车费", "价格", "花费", "多少钱", "距离", "时间")),
        ("payment", ("支付", "信用卡", "现金", "小费", "付款")),
    ),
    "'hourly_demand'",
)
QUESTION_DAY = rule_case(
    "t", [(i, (f"{p}{d}",)) for p in ("周", "星期") for i, d in enumerate(DAYS)], "NULL"
)

TAGGED = f"""SELECT text, {QUESTION_INTENT} AS intent, {number('t', '区域[ ]*([0-9]+)')} AS location,
  {number('t', '从区域[ ]*([0-9]+)')} AS route_from, {number('t', '(?:到|去|至)区域[ ]*([0-9]+)')} AS route_to,
  {number('t', '([0-9]{1,2})[ ]*(?:点|时|:00)', 'INTEGER')} AS hour,
  coalesce({number('t', '(?:前|top)[ ]*([0-9]+)')}, 10) AS top_n, {QUESTION_DAY} AS weekday,
  {rule_case('t', (('工作日', ('工作日', '平日', '上班日')), ('周末', ('周末', '休息日', '假日'))), 'NULL')} AS day_type,
  CASE WHEN {QUESTION_INTENT} = 'ranking' AND {contains_any('t', ('下车', '下客', '到达'))}
    THEN '下车' ELSE '上车' END AS rank_type
FROM (SELECT text, lower(trim(text)) AS t FROM (SELECT {QUESTION} AS text
  FROM (SELECT *, substr('{DAYS}', pickup_weekday + 1, 1) AS day FROM clocked)))"""

def peak_of(first: int, last: int) -> str:
    """Hour and trips of the largest of the 24 counts ``c`` within some hours, the first one of several."""
    part = f"c[{first + 1}:{last + 1}]"
    return f"CAST(list_position({part}, list_max({part})) + {first - 1} AS INTEGER)", f"list_max({part})"


PEAKS = {"": peak_of(0, 23), "morning_": peak_of(6, 9), "evening_": peak_of(16, 19)}
ANSWERS = f"""q AS MATERIALIZED (SELECT DISTINCT * FROM ({TAGGED})),
asked_hours AS (
  SELECT DISTINCT location, d.day_type FROM (SELECT location, day_type FROM q WHERE intent = 'hourly_demand'
    UNION ALL SELECT location, unnest(['工作日', '周末']) FROM q WHERE intent = 'peak_hours') d
),
filled AS (
  SELECT a.location, a.day_type, h.pickup_hour,
    CAST(coalesce(sum(demand) FILTER ((a.location IS NULL OR PULocationID = a.location)
      AND (a.day_type IS NULL OR (pickup_weekday >= 5) = (a.day_type = '周末'))), 0) AS BIGINT) AS n
  FROM asked_hours a CROSS JOIN hours h LEFT JOIN cube USING (pickup_hour) GROUP BY ALL
),
days AS (SELECT location, day_type, list(n ORDER BY pickup_hour) AS c FROM filled GROUP BY ALL),
ends AS (
  SELECT '上车' AS rank_type, PULocationID AS location, count(*) AS trips FROM cleaned WHERE PULocationID IS NOT NULL GROUP BY ALL
  UNION ALL SELECT '下车', DOLocationID, count(*) FROM cleaned WHERE DOLocationID IS NOT NULL GROUP BY ALL
),
lists AS (
  SELECT rank_type, count(*) AS total_locations, list(location || ':' || trips ORDER BY trips DESC, location) AS l FROM ends GROUP BY ALL
),
types AS (
  SELECT string_agg(payment_type || ':' || name || ':' || n, ',' ORDER BY payment_type) AS t
  FROM (SELECT payment_type, {PAYMENT_NAME} AS name, count(*) AS n FROM cleaned WHERE payment_type IS NOT NULL GROUP BY ALL)
),
asked_routes AS (SELECT DISTINCT route_from AS f, route_to AS t FROM q WHERE intent = 'route_info'),
routes AS (
  SELECT f, t, count(fare_amount) AS trip_count, round(sum(trip_distance), 8) AS sum_distance, round(sum(fare_amount), 8) AS sum_fare,
    round(sum(total_amount), 8) AS sum_total, round(sum({DURATION}), 8) AS sum_duration_min, round(sum(tip_amount), 8) AS sum_tip
  FROM asked_routes LEFT JOIN cleaned ON f = PULocationID AND t = DOLocationID GROUP BY ALL
)
SELECT text, intent,
  {", ".join(f"CASE WHEN c IS NOT NULL THEN {hour} END AS {name}peak_hour, {n} AS {name}peak_trips" for name, (hour, n) in PEAKS.items())},
  round_even(list_sum(c) / 24.0::DOUBLE, 1) AS avg_demand,
  CASE intent WHEN 'peak_hours' THEN array_to_string(w.c2, ',') END AS workday, CASE intent WHEN 'peak_hours' THEN array_to_string(e.c2, ',') END AS weekend,
  total_locations, array_to_string(l[1 : q.top_n], ',') AS places, t.t AS payment_types,
  trip_count, sum_distance, sum_fare, sum_total, sum_duration_min, sum_tip, demand AS historical_demand,
  CASE WHEN intent = 'predict' AND (q.location IS NULL OR hour IS NULL OR weekday IS NULL) THEN 'missing: ' || array_to_string(list_filter([
    CASE WHEN q.location IS NULL THEN 'location' END, CASE WHEN hour IS NULL THEN 'hour' END, CASE WHEN weekday IS NULL THEN 'weekday' END
  ], lambda x: x IS NOT NULL), ', ') END AS problem
FROM q
LEFT JOIN days d ON intent = 'hourly_demand' AND d.location IS NOT DISTINCT FROM q.location AND d.day_type IS NOT DISTINCT FROM q.day_type
LEFT JOIN (SELECT location, c AS c2 FROM days WHERE day_type = '工作日') w ON intent = 'peak_hours' AND w.location IS NOT DISTINCT FROM q.location
LEFT JOIN (SELECT location, c AS c2 FROM days WHERE day_type = '周末') e ON intent = 'peak_hours' AND e.location IS NOT DISTINCT FROM q.location
LEFT JOIN lists r ON intent = 'ranking' AND r.rank_type = q.rank_type
LEFT JOIN types t ON intent = 'payment'
LEFT JOIN routes o ON intent = 'route_info' AND o.f IS NOT DISTINCT FROM route_from AND o.t IS NOT DISTINCT FROM route_to
LEFT JOIN cube ON intent = 'predict' AND PULocationID = q.location AND pickup_hour = hour AND pickup_weekday = weekday"""

_FEATURES = "location_encoded hour_sin hour_cos weekday_sin weekday_cos is_weekend is_rush_hour".split()

TYPES = {c: "double" for c in DOUBLES} | {
    "VendorID": "int", "PULocationID": "int", "DOLocationID": "int", "payment_type": "int",
    "store_and_fwd_flag": "string", "tpep_pickup_datetime": "timestamp_ntz",
    "tpep_dropoff_datetime": "timestamp_ntz",
}
KINDS = {"double": "numeric", "int": "numeric", "string": "text", "timestamp_ntz": "datetime"}

ORACLE = {
    "raw_trips": raw("SELECT * FROM trips"),
    "preview_head": raw(
        f"SELECT * FROM (SELECT * FROM trips ORDER BY tpep_pickup_datetime, "
        + ", ".join(f"{c} NULLS FIRST" for c in COLUMNS if c != "tpep_pickup_datetime")
        + " LIMIT 5)"
    ),
    "preview_tail": raw(
        f"SELECT * FROM (SELECT * FROM trips ORDER BY tpep_pickup_datetime DESC, "
        + ", ".join(f"{c} DESC NULLS LAST" for c in COLUMNS if c != "tpep_pickup_datetime")
        + " LIMIT 5)"
    ),
    "zone_enrichment": cleaned(
        """SELECT PULocationID, "Zone", "Borough", count(*) AS trips FROM cleaned LEFT JOIN (
          SELECT CAST(1 + s_suppkey % 265 AS INTEGER) AS PULocationID, min(s_name) AS "Zone",
            min(s_nationkey) AS "Borough" FROM supplier GROUP BY 1) z USING (PULocationID)
        GROUP BY ALL"""
    ),
    "schema_profile": raw(
        "SELECT (SELECT count(*) FROM trips) AS rows, * FROM (VALUES "
        + ", ".join(f"({i}, '{c}', '{TYPES[c]}', '{KINDS[TYPES[c]]}')" for i, c in enumerate(COLUMNS))
        + """) v("position", "column", type, kind)"""
    ),
    "describe_numeric": raw(" UNION ALL ".join(describe_of("trips", c) for c in NUMERIC)),
    "null_profile": raw(f"SELECT * FROM ({NULLS}) WHERE nulls > 0"),
    "null_column_count": raw(f"SELECT count(*) AS columns_with_nulls FROM ({NULLS}) WHERE nulls > 0"),
    "worst_null_columns": raw(
        f"""SELECT * FROM ({NULLS}) WHERE nulls > 0 ORDER BY rate_pct DESC, "column" LIMIT 15"""
    ),
    "iqr_audit": raw(" UNION ALL ".join(f"({iqr_of('trips', c)})" for c in IQR)),
    "sign_audit": raw(
        per_column(
            ["trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount"],
            """SELECT '{c}' AS "column", n AS negative, round_even(n::DOUBLE / m * 100.0::DOUBLE, 2) AS negative_pct,
              z AS zero, round_even(z::DOUBLE / m * 100.0::DOUBLE, 2) AS zero_pct
            FROM (SELECT count(*) AS m, count(*) FILTER ({c} < 0) AS n, count(*) FILTER ({c} = 0) AS z FROM trips)""",
        )
    ),
    "passenger_validity": raw(
        f"""SELECT count(*) FILTER (passenger_count <= 0) AS invalid,
        {pct('count(*) FILTER (passenger_count <= 0)', 'count(*)')} AS rate_pct FROM trips"""
    ),
    "passenger_distribution": raw(
        "SELECT passenger_count, count(*) AS rows FROM trips WHERE passenger_count IS NOT NULL GROUP BY ALL"
    ),
    "time_order_audit": raw(
        f"""SELECT count(*) FILTER (tpep_dropoff_datetime <= tpep_pickup_datetime) AS invalid,
        {pct('count(*) FILTER (tpep_dropoff_datetime <= tpep_pickup_datetime)', 'count(*)')} AS rate_pct FROM trips"""
    ),
    "domain_summary": raw(
        per_column(
            list(CODES),
            """SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
              round_even((count(*) - count({c}))::DOUBLE / count(*) * 100.0::DOUBLE, 2) AS null_pct,
              count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM trips""",
        )
    ),
    "domain_values": raw(
        f"""SELECT j."column", j.value, j.n AS rows, {pct('j.n', 'j.m')} AS share_pct, j.is_standard,
          coalesce(d.meaning, CASE WHEN j.is_standard THEN '' ELSE '未知异常值' END) AS meaning
        FROM judged j LEFT JOIN dictionary d ON d."column" = j."column" AND d.value = j.value
        WHERE j.value IS NOT NULL"""
    ).replace("\nSELECT j.", f", {CODE_COUNTS}\nSELECT j."),
    "domain_anomalies": f"""WITH {TRIPS}, {CODE_COUNTS}
        SELECT "column", CAST(n AS BIGINT) AS anomalous, {pct('n', 'm')} AS rate_pct FROM (
          SELECT "column", coalesce(sum(n) FILTER (value IS NOT NULL AND NOT is_standard), 0) AS n, sum(n) AS m
          FROM judged GROUP BY ALL)""",
    "domain_anomaly_total": f"""WITH {TRIPS}, {CODE_COUNTS}
        SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS anomalous FROM judged
        WHERE value IS NOT NULL AND NOT is_standard""",
    "padding_audit": raw(
        """SELECT count(*) FILTER (store_and_fwd_flag LIKE ' %') AS leading,
        count(*) FILTER (store_and_fwd_flag LIKE '% ') AS trailing FROM trips"""
    ),
    "duplicate_count": raw(
        f"""SELECT count(*) - {DISTINCT_TRIPS} AS duplicates,
        {pct(f'count(*) - {DISTINCT_TRIPS}', 'count(*)')} AS rate_pct FROM trips"""
    ),
    "quality_report": f"""WITH {CLEANED}, {STATS}
        SELECT unnest(['01 rows before', '02 columns before', '03 columns with nulls',
            '04 rows removed for missing keys', '05 rows removed as outliers',
            '06 rows removed as duplicates', '07 rows after', '08 completeness pct']) AS metric,
          unnest([rows_before, {len(COLUMNS)}, (SELECT count(*) FROM ({NULLS}) WHERE nulls > 0),
            removed_missing, removed_outlier, removed_duplicate, rows_after,
            {pct('rows_after', 'rows_before')}]::DOUBLE[]) AS value
        FROM stats""",
    "key_null_profile": raw(f"""SELECT * FROM ({NULLS}) WHERE "column" IN ({', '.join(repr(k) for k in KEYS)})"""),
    "sparse_columns": f"""WITH {TRIPS}, keyed AS (SELECT * FROM trips WHERE passenger_count IS NOT NULL
          AND trip_distance IS NOT NULL AND fare_amount IS NOT NULL AND total_amount IS NOT NULL
          AND tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL)
        SELECT "column" FROM ("""
    + per_column(
        [c for c in COLUMNS if c not in KEYS],
        """SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE AS rate FROM keyed""",
    )
    + ") WHERE rate > 0.5",
    "fare_consistency": raw(
        f"""SELECT count(*) AS rows, count(*) FILTER (total_amount < fare_amount) AS total_below_fare,
        {pct('count(*) FILTER (total_amount < fare_amount)', 'count(*)')} AS rate_pct FROM trips"""
    ),
    "reject_funnel": cleaned("SELECT reason, count(*) AS rows FROM tagged GROUP BY ALL"),
    "clean_stats": f"WITH {CLEANED}, {STATS} SELECT * FROM stats",
    "clean_trips": cleaned("SELECT * FROM cleaned"),
    "time_features": cleaned(
        f"""SELECT tpep_pickup_datetime, PULocationID, DOLocationID, fare_amount,
          tpep_pickup_datetime AS pickup_datetime, CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
          pickup_hour, pickup_weekday, CAST(day(tpep_pickup_datetime) AS INTEGER) AS pickup_day, is_weekend,
          pickup_hour IN (7, 8, 9, 17, 18, 19) AS is_rush_hour,
          round(sin(2 * pi() * pickup_hour / 24), 6) + 0.0 AS hour_sin,
          round(cos(2 * pi() * pickup_hour / 24), 6) + 0.0 AS hour_cos,
          round(sin(2 * pi() * pickup_weekday / 7), 6) + 0.0 AS weekday_sin,
          round(cos(2 * pi() * pickup_weekday / 7), 6) + 0.0 AS weekday_cos,
          round({DURATION}, 6) AS duration_min FROM clocked"""
    ),
    "tip_rate_rows": cleaned(
        """SELECT payment_type, fare_amount,
          tip_amount / fare_amount * 100.0::DOUBLE AS tip_rate FROM cleaned
        WHERE fare_amount <> 0 AND tip_amount / fare_amount * 100.0::DOUBLE <= 100"""
    ),
    "demand_cube": cleaned("SELECT * FROM cube"),
    "demand_summary": cleaned(
        f"""SELECT count(*) AS cells, count(DISTINCT PULocationID) AS zones, min(demand) AS min_demand,
        max(demand) AS max_demand, {mean('demand')} AS mean_demand FROM cube"""
    ),
    "hourly_by_daytype": grid(),
    "weekday_hour_counts": cleaned(
        """SELECT pickup_weekday, pickup_hour, count(total_amount) AS trips
        FROM (SELECT CAST(range AS INTEGER) AS pickup_weekday FROM range(7)) d, hours
        LEFT JOIN clocked USING (pickup_weekday, pickup_hour) GROUP BY ALL"""
    ).replace(
        "FROM (SELECT CAST(range AS INTEGER) AS pickup_weekday FROM range(7)) d, hours\n",
        "FROM (SELECT * FROM (SELECT CAST(range AS INTEGER) AS pickup_weekday FROM range(7)) d, hours)\n",
    ),
    "weekday_hour_matrix": cleaned(
        "SELECT d.pickup_weekday, "
        + ", ".join(f"count(total_amount) FILTER (pickup_hour = {h}) AS h{h:02d}" for h in range(24))
        + """ FROM (SELECT CAST(range AS INTEGER) AS pickup_weekday FROM range(7)) d
        LEFT JOIN clocked USING (pickup_weekday) GROUP BY ALL"""
    ),
    "top_pickup_zones": cleaned(top_zones("PULocationID", 10)),
    "top_dropoff_zones": cleaned(top_zones("DOLocationID", 10)),
    "top5_zone_hourly": f"""WITH {CLEANED}, busiest AS (SELECT PULocationID FROM ({top_zones('PULocationID', 5)}))
        SELECT s.PULocationID, s.pickup_hour, count(c.payment_row) AS trips
        FROM (SELECT * FROM busiest, hours) s
        LEFT JOIN (SELECT *, 1 AS payment_row FROM clocked) c USING (PULocationID, pickup_hour) GROUP BY ALL""",
    "od_flows": cleaned(
        """SELECT PULocationID, DOLocationID, count(*) AS trips,
          '区域' || PULocationID || ' → 区域' || DOLocationID AS label
        FROM cleaned WHERE PULocationID IS NOT NULL AND DOLocationID IS NOT NULL
        GROUP BY ALL ORDER BY trips DESC, PULocationID, DOLocationID LIMIT 15"""
    ),
    "distance_fare_clip": f"""WITH {CLEANED}, {POINTS}
        SELECT trip_distance, fare_amount, passenger_count FROM points""",
    "distance_fare_sample": f"""WITH {CLEANED}, {POINTS}
        SELECT trip_distance, fare_amount, passenger_count FROM (
          SELECT *, ((CAST(epoch(tpep_pickup_datetime) AS BIGINT) * 7919 + PULocationID * 104729
            + DOLocationID * 1299709::BIGINT) % 1000003) / 1000003.0::DOUBLE AS k FROM points
          ORDER BY k, trip_distance, fare_amount, passenger_count, tpep_pickup_datetime,
            tpep_dropoff_datetime, PULocationID, DOLocationID LIMIT 100000)""",
    "hourly_fare_by_daytype": cleaned(
        """SELECT is_weekend, pickup_hour, count(fare_amount) AS trips, round(sum(fare_amount), 5) AS fares
        FROM slots LEFT JOIN clocked USING (is_weekend, pickup_hour) GROUP BY ALL"""
    ),
    "fare_by_passengers": f"""WITH {CLEANED}, {BOXED}
        SELECT passenger_count, count(*) AS trips, round(avg(fare_amount), 6) AS avg_fare,
          round(any_value(q1), 8) AS q1, round(any_value(median), 8) AS median,
          round(any_value(q3), 8) AS q3, round(min(fare_amount) FILTER (inside), 8) AS whisker_low,
          round(max(fare_amount) FILTER (inside), 8) AS whisker_high,
          count(*) FILTER (NOT inside) AS fliers
        FROM placed GROUP BY passenger_count""",
    "payment_share": cleaned(
        f"""SELECT payment_type, {PAYMENT_NAME} AS name, n AS trips, {pct('n', 'm', 1)} AS share_pct FROM (
          SELECT payment_type, count(*) AS n, (SELECT count(*) FROM cleaned) AS m FROM cleaned GROUP BY ALL)
        WHERE payment_type IS NOT NULL"""
    ),
    "tip_rate": cleaned(
        """SELECT payment_type, count(*) AS trips, round(avg(r), 6) AS avg_rate,
          round(quantile_cont(r, 0.25), 8) AS q1, round(quantile_cont(r, 0.5), 8) AS median,
          round(quantile_cont(r, 0.75), 8) AS q3
        FROM (SELECT payment_type, tip_amount / fare_amount * 100.0::DOUBLE AS r FROM cleaned
          WHERE payment_type IN (1, 2)) WHERE r <= 100 GROUP BY ALL"""
    ),
    "fee_structure": cleaned(
        f"""SELECT *, round_even(total_amount - fare_amount - tip_amount - tolls_amount, 4) AS other_fees FROM (
          SELECT payment_type, {mean('fare_amount')} AS fare_amount, {mean('tip_amount')} AS tip_amount,
            {mean('tolls_amount')} AS tolls_amount, {mean('total_amount')} AS total_amount
          FROM cleaned WHERE payment_type IN (1, 2) GROUP BY ALL)"""
    ),
    "hourly_payment_share": cleaned(
        f"""SELECT pickup_hour, trips, coalesce({pct('a', 'nullif(trips, 0)', 4)}, 0) AS type_1_pct,
          coalesce({pct('b', 'nullif(trips, 0)', 4)}, 0) AS type_2_pct FROM (
          SELECT pickup_hour, count(payment_type) AS trips, count(*) FILTER (payment_type = 1) AS a,
            count(*) FILTER (payment_type = 2) AS b
          FROM hours LEFT JOIN (SELECT * FROM clocked WHERE payment_type IN (1, 2)) USING (pickup_hour) GROUP BY ALL)"""
    ),
    "payment_means": cleaned(
        f"""SELECT payment_type, {mean('fare_amount')} AS avg_fare_amount, {mean('tip_amount')} AS avg_tip_amount,
        {mean('total_amount')} AS avg_total_amount FROM cleaned WHERE payment_type IS NOT NULL GROUP BY ALL"""
    ),
    "tip_means": cleaned(
        """SELECT round_even(avg(tip_amount) FILTER (payment_type = 1), 2) AS card_tip_avg,
        round_even(avg(tip_amount) FILTER (payment_type = 2), 2) AS cash_tip_avg FROM cleaned"""
    ),
    "distinct_flags": raw(
        """SELECT DISTINCT store_and_fwd_flag FROM trips WHERE store_and_fwd_flag IS NOT NULL
        ORDER BY store_and_fwd_flag LIMIT 5"""
    ),
    "pickup_zone_count": cleaned("SELECT count(DISTINCT PULocationID) AS distinct_values FROM cleaned"),
    "fare_quantiles": cleaned(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 8) AS value FROM cleaned"""
            for c in ("fare_amount", "trip_distance") for p in (0.01, 0.25, 0.5, 0.9, 0.99)
        )
    ),
    "fare_quantiles_by_zone": cleaned(
        " UNION ALL ".join(
            f"""SELECT PULocationID, 'fare_amount' AS "column", {p}::DOUBLE AS p,
            round(quantile_cont(fare_amount, {p}), 8) AS value FROM cleaned GROUP BY ALL"""
            for p in (0.25, 0.5, 0.75)
        )
    ),
    "hourly_demand": f"WITH {CLEANED}, {on_hours('PULocationID = 100 AND NOT is_weekend')} SELECT * FROM hourly",
    "hourly_demand_answer": hourly_answer("true"),
    "hourly_demand_zone_answer": hourly_answer("PULocationID = 100 AND is_weekend"),
    "location_ranking": ranking("PULocationID", 10),
    "location_ranking_dropoff": ranking("DOLocationID", 5),
    "route_info": cleaned(f"SELECT {ROUTE}, '出发区域100' AS description FROM cleaned WHERE PULocationID = 100"),
    "route_info_empty": cleaned(
        f"""SELECT {ROUTE}, '出发区域100、到达区域9999' AS description FROM cleaned
        WHERE PULocationID = 100 AND DOLocationID = 9999"""
    ),
    "route_table": cleaned(
        f"""SELECT PULocationID, DOLocationID, count(*) AS trip_count,
          round(sum(trip_distance), 8) AS sum_distance, round(sum(fare_amount), 8) AS sum_fare,
          round(sum(total_amount), 8) AS sum_total, round(sum({DURATION}), 8) AS sum_duration_min,
          round(sum(tip_amount), 8) AS sum_tip
        FROM cleaned GROUP BY PULocationID, DOLocationID"""
    ),
    "payment_analysis": cleaned(
        f"""SELECT payment_type, {PAYMENT_NAME} AS name, n AS trips, {pct('n', 'm', 1)} AS share_pct,
          avg_fare_amount, avg_tip_amount, avg_total_amount,
          (SELECT {mean('tip_amount')} FROM cleaned WHERE payment_type = 1) AS card_tip_avg,
          (SELECT {mean('tip_amount')} FROM cleaned WHERE payment_type = 2) AS cash_tip_avg
        FROM (SELECT payment_type, count(*) AS n, (SELECT count(*) FROM cleaned) AS m,
            {mean('fare_amount')} AS avg_fare_amount, {mean('tip_amount')} AS avg_tip_amount,
            {mean('total_amount')} AS avg_total_amount FROM cleaned GROUP BY payment_type)
        WHERE payment_type IS NOT NULL"""
    ),
    "peak_hours": grid("PULocationID = 100"),
    "tag_questions": cleaned(TAGGED),
    "answer_all": f"WITH {CLEANED}, {ANSWERS}",
    "tag_urls": "SELECT page_id, url, "
    + rule_case(
        "t",
        (("tracker", ("ads", "track")), ("blog", ("blog.",)), ("feed", ("utm_source=feed",)), ("mobile", ("//m.",))),
        "'page'",
    )
    + " AS intent, "
    + number("t", "/([0-9]+)")
    + " AS location, coalesce("
    + number("t", "page=([0-9]+)")
    + ", 1) AS top_n, "
    + rule_case("t", ((0, ("/en/",)), (1, ("/fr/",)), (2, ("/es/",))), "NULL")
    + " AS weekday, "
    + rule_case("t", (("secure", ("https://",)), ("plain", ("http://",))), "NULL")
    + """ AS day_type, CASE WHEN NOT contains(t, 'ads') AND NOT contains(t, 'track') AND contains(t, 'blog.')
      AND contains(t, '#top') THEN '下车' ELSE '上车' END AS rank_type
    FROM (SELECT page_id, url, lower(trim(url)) AS t FROM pages)""",
    "zone_encoder": cleaned("SELECT * FROM encoder"),
    "encoded_cube": cleaned(
        "SELECT PULocationID, pickup_hour, pickup_weekday, demand, location_encoded, is_weekend, is_rush_hour, "
        + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("hour_sin", "hour_cos", "weekday_sin", "weekday_cos"))
        + " FROM encoded"
    ),
    "scaled_features": cleaned(
        "SELECT PULocationID, pickup_hour, pickup_weekday, "
        + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM encoded)) / (SELECT stddev_pop({c}) FROM encoded), 4) + 0.0 AS {c}"
            for c in (*_FEATURES, "demand")
        )
        + " FROM encoded"
    ),
    "unscaled_demand": cleaned("SELECT *, demand::DOUBLE AS demand_again FROM cube"),
    "split_counts": cleaned(
        "SELECT count(*) FILTER (NOT is_test) AS train, count(*) FILTER (is_test) AS test FROM parts"
    ),
    "error_metrics": cleaned(
        f"SELECT n AS rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse FROM ({errors('by_cell')})"
    ),
    "mean_model_comparison": cleaned(
        f"""SELECT metric, round(a, 4) AS by_hour, round(b, 4) AS by_cell,
          CASE WHEN a < b THEN 'by_hour' ELSE 'by_cell' END AS better,
          round(abs(a - b) / greatest(a, b) * 100, 4) AS difference_pct
        FROM (SELECT unnest(['MAE', 'RMSE']) AS metric, unnest([x.mae, x.rmse]) AS a, unnest([y.mae, y.rmse]) AS b
          FROM ({errors('by_hour')}) x, ({errors('by_cell')}) y)"""
    ),
    "residual_summary": cleaned(
        "SELECT count(*) AS n, round(avg(demand - prediction), 4) + 0.0 AS mean_residual FROM by_cell"
    ),
    "residual_histogram": f"""WITH {CLEANED}, residuals AS (SELECT demand - prediction AS v FROM by_cell),
        span AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS m FROM residuals),
        binned AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 50) AS INTEGER), 49) AS bin FROM residuals, span)
        SELECT b.bin, round(lo + (hi - lo) / 50 * b.bin, 4) + 0.0 AS bin_start,
          round(lo + (hi - lo) / 50 * (b.bin + 1), 4) + 0.0 AS bin_end, count(x.bin) AS n,
          round(count(x.bin) / (m * ((hi - lo) / 50)), 4) AS density
        FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b LEFT JOIN binned x USING (bin), span
        GROUP BY b.bin, lo, hi, m""",
    "actual_predicted": cleaned("SELECT demand AS actual, round(prediction, 4) AS predicted FROM by_cell"),
    "actual_range": cleaned("SELECT min(demand) AS low, max(demand) AS high FROM by_cell"),
    "events_hourly": """WITH clocked AS (SELECT CAST(hour(ts) AS INTEGER) AS pickup_hour, isodow(ts) >= 6 AS is_weekend, 1 AS one FROM events),
        slots AS (SELECT is_weekend, CAST(range AS INTEGER) AS pickup_hour FROM (VALUES (true), (false)) d(is_weekend), range(24))
        SELECT is_weekend, pickup_hour, count(one) AS trips FROM slots LEFT JOIN clocked USING (is_weekend, pickup_hour) GROUP BY ALL""",
    "events_iqr": iqr_of("events", "value"),
    "events_top_users": "SELECT user_id, count(*) AS trips FROM events GROUP BY ALL ORDER BY trips DESC, user_id LIMIT 20",
    "events_describe": describe_of("events", "value"),
    "events_value_histogram": """WITH span AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS m FROM events),
        binned AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 50) AS INTEGER), 49) AS bin FROM events, span)
        SELECT b.bin, round(lo + (hi - lo) / 50 * b.bin, 8) AS bin_start,
          round(lo + (hi - lo) / 50 * (b.bin + 1), 8) AS bin_end, count(x.bin) AS n,
          round(count(x.bin) / (m * ((hi - lo) / 50)), 6) AS density
        FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b LEFT JOIN binned x USING (bin), span
        GROUP BY b.bin, lo, hi, m""",
}

_FEATURE_PLACES = (
    "location_encoded", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "is_weekend", "is_rush_hour",
)
_REQUESTS = """requests AS (
  SELECT DISTINCT DOLocationID + CASE WHEN DOLocationID % 50 = 0 THEN 1000 ELSE 0 END AS location_id,
    (pickup_hour + 1) % 24 AS hour, pickup_weekday AS weekday FROM clocked
)"""
_WEEKDAYS = "['周一', '周二', '周三', '周四', '周五', '周六', '周日']"
ORACLE |= {
    "duplicate_count_by_marks": ORACLE["duplicate_count"],
    "distinct_by_marks": raw("SELECT DISTINCT * FROM trips"),
    "clustered_trips": cleaned("SELECT * FROM cleaned"),
    "clustered_route_info": cleaned(
        f"SELECT {ROUTE}, '出发区域100、到达区域9' AS description FROM cleaned WHERE PULocationID = 100 AND DOLocationID = 9"
    ),
    "clustered_peak_hours": grid("PULocationID = 100"),
    "months_of_schemas": raw("SELECT * FROM trips WHERE PULocationID BETWEEN 100 AND 160"),
}
ORACLE |= {
    "csv_round_trip": cleaned("SELECT * FROM cleaned"),
    "csv_zones": cleaned(
        """SELECT PULocationID, trips, "Borough", "Zone", CASE WHEN "Zone" IS NOT NULL THEN 'N/A' END AS service_zone
        FROM (SELECT PULocationID, count(*) AS trips FROM cleaned WHERE PULocationID IS NOT NULL GROUP BY ALL)
        LEFT JOIN (SELECT CAST(1 + s_suppkey % 265 AS INTEGER) AS PULocationID, min(s_name) AS "Zone",
          CAST(min(s_nationkey) AS VARCHAR) AS "Borough" FROM supplier GROUP BY 1) z USING (PULocationID)"""
    ),
    "streamed_features": f"""WITH {TRIPS}, tagged AS (SELECT *, {REASON} AS reason FROM trips), kept AS (
          SELECT *, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
            CAST(isodow(tpep_pickup_datetime) - 1 AS INTEGER) AS pickup_weekday FROM tagged WHERE reason = '10 kept')
        SELECT tpep_pickup_datetime, PULocationID, DOLocationID, fare_amount,
          CAST(tpep_pickup_datetime AS DATE) AS pickup_date, pickup_hour, pickup_weekday,
          CAST(day(tpep_pickup_datetime) AS INTEGER) AS pickup_day, pickup_weekday >= 5 AS is_weekend,
          pickup_hour IN (7, 8, 9, 17, 18, 19) AS is_rush_hour,
          round(sin(2 * pi() * pickup_hour / 24), 6) + 0.0 AS hour_sin FROM kept""",
    "forest_predictions": cleaned(
        "SELECT PULocationID, pickup_hour, pickup_weekday, demand, true AS in_range FROM parts WHERE is_test"
    ),
    "model_comparison": cleaned(
        """SELECT model, (SELECT count(*) FROM parts WHERE is_test) AS cells, true AS better
        FROM (VALUES ('boosted_trees'), ('forest')) m(model)"""
    ),
    "feature_importance": """SELECT feature, label, true AS is_share, 1.0::DOUBLE AS total FROM (VALUES
        ('location_encoded', '区域编码'), ('hour_sin', '小时(sin)'), ('hour_cos', '小时(cos)'),
        ('weekday_sin', '星期(sin)'), ('weekday_cos', '星期(cos)'), ('is_weekend', '是否周末'),
        ('is_rush_hour', '是否高峰时段')) f(feature, label)""",
    "cells_by_nodes": cleaned("SELECT PULocationID, pickup_hour, pickup_weekday, true AS agrees FROM cube"),
    "importance_by_nodes": """SELECT feature, label, true AS agrees FROM (VALUES
        ('location_encoded', '区域编码'), ('hour_sin', '小时(sin)'), ('hour_cos', '小时(cos)'),
        ('weekday_sin', '星期(sin)'), ('weekday_cos', '星期(cos)'), ('is_weekend', '是否周末'),
        ('is_rush_hour', '是否高峰时段')) f(feature, label)""",
    "score_requests": f"""WITH {CLEANED}, {_REQUESTS}
        SELECT location_id, hour, weekday, {_WEEKDAYS}[weekday + 1] AS weekday_name, c.demand AS historical_demand,
          hour IN (7, 8, 9, 17, 18, 19) AS is_rush_hour, weekday >= 5 AS is_weekend,
          e.location_encoded IS NOT NULL AS known_zone, true AS in_range
        FROM requests r LEFT JOIN encoder e ON e.PULocationID = location_id
        LEFT JOIN cube c ON c.PULocationID = location_id AND c.pickup_hour = hour AND c.pickup_weekday = weekday""",
    "tree_group_means": cleaned(
        """SELECT PULocationID, pickup_hour, pickup_weekday, round(m, 4) AS forest, round(m, 4) AS boosted
        FROM parts JOIN (SELECT pickup_weekday >= 5 AS w, avg(demand) AS m FROM parts WHERE NOT is_test GROUP BY ALL)
          ON w = (pickup_weekday >= 5) WHERE is_test"""
    ),
    "feature_vectors": cleaned(
        "SELECT PULocationID, pickup_hour, pickup_weekday, "
        + ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS f{i}" for i, c in enumerate(_FEATURE_PLACES))
        + " FROM encoded"
    ),
    "scaled_on_train": cleaned(
        """SELECT PULocationID, pickup_hour, pickup_weekday, demand, round((demand - m) / s, 4) + 0.0 AS scaled FROM cube,
        (SELECT avg(demand) AS m, stddev_pop(demand) AS s FROM parts WHERE NOT is_test)"""
    ),
}
ORACLE |= {
    f"chain_{name}": ORACLE[name]
    for name in (
        "demand_cube", "hourly_by_daytype", "weekday_hour_counts", "weekday_hour_matrix", "top_pickup_zones",
        "top_dropoff_zones", "top5_zone_hourly", "od_flows", "hourly_fare_by_daytype", "payment_share",
        "fee_structure", "hourly_payment_share", "payment_means", "tip_means",
    )
}
# A stored audit of a folder that grew gives the reports of its present files.
ORACLE |= {
    f"grown_{name}": ORACLE[name]
    for name in (
        "null_profile", "key_null_profile", "sign_audit", "passenger_validity", "time_order_audit", "padding_audit",
        "fare_consistency", "sparse_columns", "reject_funnel", "passenger_distribution", "domain_summary",
        "domain_values", "domain_anomalies", "domain_anomaly_total", "describe_numeric",
    )
}
ORACLE["grown_demand_cube"] = cleaned(
    """SELECT PULocationID, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
      CAST(isodow(tpep_pickup_datetime) - 1 AS INTEGER) AS pickup_weekday, count(*) AS demand
    FROM tagged WHERE reason = '10 kept' GROUP BY ALL"""
)
ORACLE["certified_flows"] = cleaned(
    """SELECT PULocationID, DOLocationID, count(*) AS trips FROM cleaned
    WHERE PULocationID IS NOT NULL AND DOLocationID IS NOT NULL GROUP BY ALL ORDER BY trips DESC, 1, 2 LIMIT 15"""
)
ORACLE["certified_users"] = ORACLE["events_top_users"]
ORACLE["certified_parts"] = """SELECT l_partkey, l_suppkey, count(*) AS trips FROM lineitem
    GROUP BY ALL ORDER BY trips DESC, 1, 2 LIMIT 25"""
