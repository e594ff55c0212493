"""Judge URLs by host and path rules that are found through their rarest token.

Every rule has literal tokens that a fitting URL must hold as whole tokens. A
rule is indexed by the one that is rarest among the URLs. A URL's tokens fetch
their rules, and only the fetched rules run as regular expressions. All of it
is DataFrame work.

Few rules are a map from key to rules in the plan; each URL stays one row and is
not shuffled. More rules are a table: tokens that are no key are dropped first,
the others meet the rules in an equality join in which a token of many URLs is
dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.llm.shared import store
from curbmeter.session import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules are written host/path; a URL that no rule fits passes.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
DEFAULT = "allow"
_TOKEN = "[0-9A-Za-z]+"
# Up to so many rules are looked up in a map; a look-up walks through its keys.
MAP_RULES = 256
# URLs that fetch the rules of one key in one task.
SHARE = 100_000


def split_url(url):
    """Host (ASCII letters lower-cased) and path of a URL column; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _tokens(column, pattern: str = f"({_TOKEN})"):
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(1))


def _literal(column):
    """A regular expression that matches just this text."""
    return F.regexp_replace(column, "([^0-9A-Za-z/])", r"\\$1")


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rule, verdict, size, pattern, tokens`` from ``rule, verdict``; of equal rules ``block`` holds.

    The pattern runs on host and path together: the host may have subdomains in
    front, the path any end. A path token counts only if the rule shows its end.
    """
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    before = F.when(host == "", F.lit("^[^/]*")).otherwise(F.concat(F.lit(r"^(?:[^/]*\.)?"), _literal(host)))
    return (
        rules.where("rule is not null and verdict is not null")
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            "rule",
            "verdict",
            F.length("rule").alias("size"),
            F.concat(before, F.lit(r"(?=/|\z)"), _literal(path)).alias("pattern"),
            F.array_distinct(F.concat(_tokens(host), _tokens(path, f"({_TOKEN})(?=[^0-9A-Za-z])"))).alias("tokens"),
        )
    )


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Compiled rules with the ``key`` they are fetched by: their token that is rarest among ``urls(tokens)``.

    ``n`` is the number of URLs that have the key. A rule that shows no whole
    token has the key '' and is fetched by every URL; its ``n`` is null.
    """
    compiled = store(compile_rules(rules), "rules")
    known = compiled.select("rule", F.explode("tokens").alias("token"))
    wanted = broadcast_if_small(store(known.select("token").distinct(), "tokens"))
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token")
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        known.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x"))
        .select("rule", F.col("x.token").alias("key"), "x.n")
    )
    return store(compiled.join(rarest, "rule", "left").withColumn("key", F.coalesce("key", F.lit(""))), "rules")


def _mapped(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``urls`` with ``best(size, rule, verdict)``: the rules, at most ``MAP_RULES``, are a map in the plan."""
    by_key: dict = {}
    for r in index.select("key", "size", "rule", "verdict", "pattern").collect():
        entry = F.struct(F.lit(-r["size"]).alias("size"), *[F.lit(r[c]).alias(c) for c in ("rule", "verdict", "pattern")])
        by_key.setdefault(r["key"], []).append(entry)
    if not by_key:
        return urls.withColumn("best", F.lit(None).cast("struct<size int, rule string, verdict string>"))
    fetch = F.create_map(*[x for key, entries in by_key.items() for x in (F.lit(key), F.array(*entries))])
    keys = F.filter(F.concat(F.array(F.lit("")), "tokens"), lambda t: F.map_contains_key(fetch, t))
    fetched = F.flatten(F.transform(keys, lambda t: fetch[t]))
    return urls.withColumn("best", F.array_min(F.filter(fetched, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))))


def _joined(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The same for any number of rules, by a join on the key."""
    # Numbered in a written table: the numbers stay when an executor is lost.
    urls = store(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    shares = F.floor(F.coalesce("n", F.lit(urls.count())) / SHARE) + 1
    index = index.withColumn("shares", shares)
    keys = broadcast_if_small(store(index.select("key", "shares").distinct(), "keys"))
    asked = urls.select("row", F.concat("host", "path").alias("url"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("key"))
    asked = asked.join(keys, "key").withColumn("share", F.pmod("row", "shares")).drop("shares")
    dealt = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = dealt.select("key", "share", "size", "rule", "verdict", "pattern")
    fits = asked.join(dealt, ["key", "share"]).where(F.expr("regexp_like(url, pattern)"))
    best = fits.groupBy("row").agg(F.min(F.struct((-F.col("size")).alias("size"), "rule", "verdict")).alias("best"))
    return urls.join(best, "row", "left")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", map_rules: int = MAP_RULES
) -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict``.

    Of the rules that fit, the longest wins, of equally long ones the smaller
    string. Where none fits, ``rule`` is null and the verdict is ``allow``. A
    null URL or one without ``://`` has an empty host and path. Repeated rows
    and null ids are judged each; empty tables are fine on either side; other
    columns are not read. More than ``map_rules`` rules are joined.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host.alias("host"), path.alias("path")
    )
    urls = urls.withColumn("tokens", F.array_distinct(_tokens(F.concat("host", "path"))))
    index = index_rules(rules, urls)
    judged = _mapped(urls, index) if index.count() <= map_rules else _joined(urls, index)
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"),
    )
