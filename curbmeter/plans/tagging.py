"""Tagging of question texts with an intent and its parameters (Q7).

The rules are data: ordered lists of words and one pattern per parameter. They
become ``CASE`` and ``regexp_extract`` expressions, so a column of texts is
tagged in one pass without a shuffle and without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.functions.values import stripped
from curbmeter.schema import ALIGHTING, BOARDING, WEEKDAY_NAMES, WEEKEND, WORKDAY

# Words per intent, first match wins; a text without any is
# taken as a question for the hourly demand.
INTENT_WORDS = (
    ("predict", ("预测", "预计", "预估", "会有多少", "需求量")),
    ("ranking", ("排名", "排行", "top", "热门", "热度")),
    ("peak_hours", ("高峰", "繁忙", "最忙", "峰值")),
    ("hourly_demand", ("时段", "小时", "每小时", "分小时", "几点")),
    ("route_info", ("费用", "车费", "价格", "花费", "多少钱", "距离", "时间")),
    ("payment", ("支付", "信用卡", "现金", "小费", "付款")),
    ("hourly_demand", ("区域", "哪里", "哪个")),
)
DEFAULT_INTENT = "hourly_demand"
# Words of day types, of alighting, and of weekdays in the order tried.
DAY_TYPE_WORDS = (
    (WORKDAY, ("工作日", "平日", "上班日")),
    (WEEKEND, ("周末", "休息日", "假日")),
)
ALIGHTING_WORDS = ("下车", "下客", "到达")
WEEKDAY_WORDS = tuple(
    (name.replace("周", prefix), day)
    for prefix in ("周", "星期")
    for day, name in enumerate(WEEKDAY_NAMES)
)
# Digits and blanks as they occur in questions, full-width ones included.
DIGIT, BLANKS = "[0-9０-９]", r"[\s\p{Z}]*"
# Patterns whose first group is the parameter. A pattern is tried
# only on texts with one of the words before it.
NUMBER_PATTERNS = {
    "location": (("区域",), f"区域{BLANKS}({DIGIT}+)"),
    "route_from": (("从区域",), f"从区域{BLANKS}({DIGIT}+)"),
    "route_to": (("到区域", "去区域", "至区域"), f"(?:到|去|至)区域{BLANKS}({DIGIT}+)"),
    "hour": (("点", "时", ":00"), f"({DIGIT}{{1,2}}){BLANKS}(?:点|时|:00)"),
    "top_n": (("前", "top"), f"(?:前|top){BLANKS}({DIGIT}+)"),
}
DEFAULT_TOP_N = 10
FULL_WIDTH_DIGITS = "０１２３４５６７８９"


@dataclass(frozen=True)
class TagRules:
    """The rule set; every part can be replaced for another kind of text."""

    intents: tuple = INTENT_WORDS
    default_intent: str | None = DEFAULT_INTENT
    numbers: dict = field(default_factory=lambda: dict(NUMBER_PATTERNS))
    day_types: tuple = DAY_TYPE_WORDS
    weekdays: tuple = WEEKDAY_WORDS
    alighting: tuple = ALIGHTING_WORDS
    ranking_intent: str = "ranking"
    default_top_n: int = DEFAULT_TOP_N


def any_of(text: Column, words) -> Column:
    """True when the text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_of(text: Column, rules, default=None) -> Column:
    """Value of the first rule with a word in the text."""
    chain = F
    for value, words in rules:
        chain = chain.when(any_of(text, words), F.lit(value))
    return chain.otherwise(F.lit(default))


def number_in(text: Column, words, pattern: str, type: str = "long") -> Column:
    """The number in the first match, null without one."""
    digits = F.regexp_extract(text, pattern, 1)
    number = F.translate(digits, FULL_WIDTH_DIGITS, "0123456789").try_cast(type)
    return F.when(any_of(text, words), number)


def tag_text(df: DataFrame, text: str = "text", rules: TagRules | None = None) -> DataFrame:
    """Add the tags of each text to its row.

    As in the rule order, a question for the demand of a day type is tagged
    ``predict``; an hour after noon written as ``下午5点`` stays 5.
    """
    rules = rules or TagRules()
    clean = F.col("_clean")
    numbers = {
        name: number_in(clean, words, pattern, "int" if name == "hour" else "long")
        for name, (words, pattern) in rules.numbers.items()
    }
    if "top_n" in numbers:
        numbers["top_n"] = F.coalesce(numbers["top_n"], F.lit(rules.default_top_n).cast("long"))
    return (
        df.withColumn("_clean", F.lower(stripped(text)))
        .withColumns(
            {
                "intent": first_of(clean, rules.intents, rules.default_intent),
                **numbers,
                "weekday": first_of(clean, [(day, (word,)) for word, day in rules.weekdays]),
                "day_type": first_of(clean, rules.day_types),
            }
        )
        .withColumn(
            "rank_type",
            F.when(
                (F.col("intent") == rules.ranking_intent) & any_of(clean, rules.alighting),
                ALIGHTING,
            ).otherwise(BOARDING),
        )
        .drop("_clean")
    )
