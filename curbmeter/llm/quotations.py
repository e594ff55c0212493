"""Link messages to the messages they quote, and order conversations by reply.

A message's lines are parsed for their quote level (``>``, ``> >``, ``>>``).
Lines of level 0 are its own. Consecutive lines of one level of 1 or more are
a quoted passage; it is normalised, hashed, and joined to the passages of
earlier messages of the conversation. A passage that is none of them, an
excerpt, is joined by its paragraphs and lines. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from curbmeter.llm.shared import store

# Marks of quoting in front of a line: '>' signs, spaces between them allowed.
MARKS = r"^(?:[ \t]*>)+"
PARAGRAPHS = r"\n\s*\n"
# Turns are worked on in blocks of so many when the latest earlier original is sought.
TURNS = 4096
TEMPLATE = "<|%s|>\n%s"


def _lines(text):
    """``level`` and ``line`` of each line, marks and the space behind them removed."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    return F.transform(
        lines,
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, MARKS + " ?", "").alias("line"),
        ),
    )


def normalised(text):
    """Lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _normalised_all(texts):
    """The distinct texts of an array, normalised, without empty ones."""
    return F.array_distinct(F.filter(F.transform(texts, normalised), lambda x: x != ""))


def parse_messages(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with ``body`` (own lines), ``own`` and ``quoted`` (``level``, ``text``) passages.

    Own passages are the whole body, its runs between quotes, the paragraphs of
    both, and its lines; a quote may hold any of them.
    """
    lines = _lines(F.col(text_col))
    parsed = messages.withColumn("_lines", lines)
    level = F.transform("_lines", lambda x: x["level"])
    body = F.trim(F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    # A run starts where the level differs from the line before.
    starts = F.filter(
        F.sequence(F.lit(1), F.size("_lines")),
        lambda i: (i == 1) | (F.element_at("_levels", i) != F.element_at("_levels", F.greatest(i - 1, F.lit(1)))),
    )
    runs = F.transform(
        "_starts",
        lambda s, k: F.struct(
            F.element_at("_levels", s).alias("level"),
            F.array_join(
                F.transform(
                    F.slice("_lines", s, F.coalesce(F.get("_starts", k + 1), F.size("_lines") + 1) - s),
                    lambda x: x["line"],
                ),
                "\n",
            ).alias("text"),
        ),
    )
    parsed = parsed.withColumn("_levels", level).withColumn("body", body)
    quotes = F.exists("_levels", lambda x: x > 0)
    parsed = parsed.withColumn("_starts", F.when(quotes, starts).otherwise(F.array().cast("array<int>")))
    quoted = F.filter(runs, lambda r: (r["level"] > 0) & (normalised(r["text"]) != ""))
    answers = F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["text"])
    paragraphs = F.flatten(F.transform(answers, lambda x: F.split(x, PARAGRAPHS)))
    own = _normalised_all(
        F.concat(F.array("body"), F.split("body", PARAGRAPHS), F.split("body", "\n"), answers, paragraphs)
    )
    return parsed.withColumn("quoted", quoted).withColumn("own", own).drop("_lines", "_levels", "_starts")


def _latest(originals: DataFrame, asked: DataFrame) -> DataFrame:
    """``conv, passage, turn, original`` for ``asked(conv, passage, turn)``: the latest earlier turn among ``originals``.

    It is found without listing pairs: in blocks of turns, by the last original
    of each earlier block and by a running last within the block.
    """
    block = F.floor(F.col("turn") / TURNS).alias("block")
    originals = originals.select("conv", "passage", "turn", block)
    asked = asked.select("conv", "passage", "turn", block).distinct()
    last = originals.groupBy("conv", "passage", "block").agg(F.max("turn").alias("original"))
    # The last original of the blocks before: one row per block.
    by_block = W.Window.partitionBy("conv", "passage").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    blocks = asked.select("conv", "passage", "block").distinct().join(last, ["conv", "passage", "block"], "full")
    before = blocks.withColumn("before", F.last("original", ignorenulls=True).over(by_block)).drop("original")
    by_turn = (
        W.Window.partitionBy("conv", "passage", "block").orderBy("turn").rangeBetween(W.Window.unboundedPreceding, -1)
    )
    both = originals.select("conv", "passage", "block", "turn", F.col("turn").alias("original"), F.lit(False).alias("ask"))
    both = both.unionByName(asked.select("conv", "passage", "block", "turn", F.lit(None).cast("long").alias("original"), F.lit(True).alias("ask")))
    within = both.withColumn("within", F.max("original").over(by_turn)).where("ask").drop("original", "ask")
    found = within.join(before, ["conv", "passage", "block"], "left").select(
        "conv", "passage", "turn", F.coalesce("within", "before").alias("original")
    )
    return found.where("original is not null")


def _holders(sets: DataFrame, originals: DataFrame) -> DataFrame:
    """``conv, passage, turn``: the turns that have every one of a set's passages, from ``sets(conv, passage, hashes)``.

    Only the turns that have the rarest of them are looked at.
    """
    of_set = sets.select("conv", F.col("passage").alias("set"), F.size("hashes").alias("size"), F.explode("hashes").alias("passage"))
    counts = originals.groupBy("conv", "passage").agg(F.count(F.lit(1)).alias("n"))
    known = of_set.join(counts, ["conv", "passage"]).groupBy("conv", "set", "size")
    known = known.agg(F.count(F.lit(1)).alias("have"), F.min_by("passage", F.struct("n", "passage")).alias("passage"))
    few = known.where(F.col("have") == F.col("size")).join(originals, ["conv", "passage"]).select("conv", "set", "turn")
    held = few.join(of_set, ["conv", "set"]).join(originals, ["conv", "passage", "turn"])
    held = held.groupBy("conv", "set", "size", "turn").agg(F.count(F.lit(1)).alias("have"))
    return held.where(F.col("have") == F.col("size")).select("conv", F.col("set").alias("passage"), "turn")


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``conv, turn, level, length, passage, original``: each turn's quoted passages and the turn they come from.

    The original is the latest earlier turn of the conversation that has the
    passage as its own. If none has, it is the latest that has all paragraphs
    of the passage, then all its lines, then the longest paragraph that an
    earlier turn has, then the longest such line; for the last two ``length``
    is that of the paragraph or line.
    """
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    parsed = parse_messages(base.where("conv is not null and turn is not null"))

    def pieces(texts):
        return F.transform(_normalised_all(texts), lambda x: F.struct(F.length(x).alias("length"), F.xxhash64(x).alias("passage")))

    quotes = store(
        parsed.where(F.size("quoted") > 0)
        .select("conv", "turn", F.explode("quoted").alias("q"))
        .select("conv", "turn", "q.level", "q.text", normalised(F.col("q.text")).alias("passage"))
        .select(
            "conv",
            "turn",
            "level",
            F.length("passage").alias("length"),
            F.xxhash64("passage").alias("passage"),
            pieces(F.split("text", PARAGRAPHS)).alias("paragraphs"),
            pieces(F.split("text", "\n")).alias("lines"),
        )
        .distinct(),
        "quotes",
    )
    parts = F.array_union(F.col("paragraphs.passage"), F.col("lines.passage"))
    wanted = quotes.select("conv", F.explode(F.array_union(F.array("passage"), parts)).alias("passage")).distinct()
    originals = (
        parsed.select("conv", "turn", F.explode("own").alias("own"))
        .select("conv", "turn", F.xxhash64("own").alias("passage"))
        .join(wanted, ["conv", "passage"], "left_semi")
        .distinct()
    )
    originals = store(originals, "originals")
    columns = ["conv", "turn", "level", "length", "passage", "original"]
    linked = store(quotes.join(_latest(originals, quotes), ["conv", "passage", "turn"], "left"), "linked")
    whole = linked.where("original is not null").select(*columns).distinct()
    excerpts = linked.where("original is null").drop("original")
    if excerpts.isEmpty():
        return whole
    # The passage itself has no original; one piece may also be a line that it repeats.
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(name).alias("pieces")) for kind, name in enumerate(("lines", "paragraphs"))])
    tried = excerpts.select("conv", "turn", "level", "length", "passage", F.explode(kinds).alias("x")).select("*", "x.*").drop("x")
    tried = tried.where((F.size("pieces") > 1) | (F.col("pieces")[0]["passage"] != F.col("passage")))
    tried = tried.withColumn("hashes", F.array_sort("pieces.passage")).withColumn("set", F.xxhash64("hashes"))
    tried = store(tried, "excerpts")
    sets = tried.select("conv", F.col("set").alias("passage"), "hashes").distinct()
    holders = store(_holders(sets, originals), "holders")
    of_set = _latest(holders, tried.select("conv", F.col("set").alias("passage"), "turn")).withColumnRenamed("passage", "set")
    each = tried.select("conv", "turn", "level", "passage", "kind", F.explode("pieces").alias("piece"))
    each = each.select("conv", "turn", "level", "passage", "kind", F.col("piece.length").alias("length"), F.col("piece.passage").alias("piece"))
    of_piece = _latest(originals, each.select("conv", F.col("piece").alias("passage"), "turn")).withColumnRenamed("passage", "piece")
    rank = lambda every: F.struct(F.lit(every).alias("every"), "kind", "length", "original").alias("best")
    found = tried.join(of_set, ["conv", "set", "turn"]).select("conv", "turn", "level", "passage", rank(True))
    found = found.unionByName(each.join(of_piece, ["conv", "piece", "turn"]).select("conv", "turn", "level", "passage", rank(False)))
    best = found.groupBy("conv", "turn", "level", "passage").agg(F.max("best").alias("best"))
    return whole.unionByName(best.select("conv", "turn", "level", "best.length", "passage", "best.original"))


def reply_roots(parents: DataFrame) -> DataFrame:
    """``conv, turn, root, depth`` from ``conv, turn, parent``: where a chain of replies leads, and how long it is.

    Chains are followed by doubling, so rounds grow with the logarithm of the longest.
    """
    chain = store(parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        ahead = chain.select("conv", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        joined = store(chain.join(ahead, ["conv", "root"], "left"), "chains")
        if joined.where("further is not null").isEmpty():
            return chain
        chain = joined.select(
            "conv",
            "turn",
            F.coalesce("further", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )


def conversations_by_reply(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per message: ``conv_id, turn, role, body, chat, parent_turn, thread_turn, depth, n_quotes``.

    ``body`` is the text without quotes, ``chat`` the body in the chat template.
    ``parent_turn`` is the original of the message's quote of the lowest level,
    then of the longest passage, then the latest; null without a linked quote.
    Excerpts are linked as :func:`link_quotations` says.
    ``thread_turn`` is the turn that the chain of parents leads to, the
    message's own without one, and ``depth`` the chain's length. Sorted by
    ``conv_id, thread_turn, turn`` every message follows what it replies to.
    ``n_quotes`` counts quoted passages, linked or not.

    Rows with a null conversation or turn are returned and link to nothing;
    rows that share conversation and turn share links; null texts are empty, a
    null role is ``unknown`` in the chat. Empty tables give no rows; other
    columns are not read.
    """
    links = link_quotations(messages, conv_col, turn_col, text_col)
    nearest = F.struct(-F.col("level"), "length", "original")
    parents = store(links.groupBy("conv", "turn").agg(F.max_by("original", nearest).alias("parent")), "parents")
    roots = reply_roots(parents).join(parents, ["conv", "turn"])
    base = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    parsed = parse_messages(base).select("conv_id", "turn", "role", "body", F.size("quoted").cast("long").alias("n_quotes"))
    places = roots.select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "parent", "root", "depth")
    out = parsed.join(places, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.format_string(TEMPLATE, F.coalesce("role", F.lit("unknown")), F.col("body")).alias("chat"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        "n_quotes",
    )
