"""The corpus operators as queries ``(spark, sf_dir) -> DataFrame`` over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from curbmeter.llm import (
    dart_minhash,
    decontaminate,
    forest,
    licenses,
    packing,
    periodic,
    perplexity,
    quality,
    quotations,
    sharding,
    spelling,
    url_rules,
    warc,
)
from curbmeter.llm.shared import ship_package, table


def nearest_neighbours(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def quality_scores(spark, sf_dir) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def contamination(spark, sf_dir) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", "items").cast("binary")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def shards(spark, sf_dir) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def url_verdicts(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(list(url_rules.RULES), "rule string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def replies(spark, sf_dir) -> DataFrame:
    return quotations.conversations_by_reply(table(spark, sf_dir, "conversations"))


def archives(spark, sf_dir) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def near_duplicates(spark, sf_dir) -> DataFrame:
    classes = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: per source and language a directory, in it one per thousand and hundred ids.

    Ids that end in 00 are named LICENSE and lie one level higher, those that end in 000 two.
    """
    number = F.col("doc_id").cast("string")
    thousand, hundred = F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100").cast("string")
    return docs.withColumn(
        "path",
        F.when(number.endswith("000"), F.concat_ws("/", "source", "lang", F.lit("LICENSE")))
        .when(number.endswith("00"), F.concat_ws("/", "source", "lang", thousand, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", "lang", thousand, hundred, F.concat(number, F.lit(".txt")))),
    )


def license_scan(spark, sf_dir) -> DataFrame:
    files = document_paths(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    found = licenses.scan_licenses(files, licenses.templates_frame(spark))
    return found.select("doc_id", "path", "license", "cosine", "origin", "license_dir")


def packed(spark, sf_dir) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; where the id's checksum ends in 0, the words from some place on repeat with some period."""
    seed = F.floor(F.col("h") / 10).cast("long")
    words = docs.select(
        "doc_id",
        "text",
        F.crc32(F.col("doc_id").cast("string")).alias("h"),
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"),
    ).withColumn("n", F.when(F.col("h") % 10 == 0, F.size("words")))
    placed = words.withColumn("a", (seed % F.greatest("n", F.lit(1))).cast("int")).withColumn("repeats", (3 + seed % 8).cast("int"))
    period = (F.lit(1) + F.expr("(n - a) div repeats")).cast("int")
    block = F.slice("words", F.col("a") + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.col("repeats"))), 1, F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def word_runs(spark, sf_dir) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs).withColumn("best", periodic.longest_run())
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic.written_runs().cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def spelling_variants(spark, sf_dir) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), drop_every=199)
    return spelling.group_variants(words).select("word", "n", "n_near", "form", "form_n", "root")


def quality_rules(spark, sf_dir) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *perplexity.BASE_COLUMNS, "base_failed", "kept")


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    name: _shipped(query)
    for name, query in {
        "op1_lsh_forest": nearest_neighbours,
        "op2_attention_quality": quality_scores,
        "op3_winnowing": contamination,
        "op4_extendible_sharding": shards,
        "op5_url_rules": url_verdicts,
        "op6_quotation_linking": replies,
        "op7_warc_round_trip": archives,
        "op8_dart_minhash": near_duplicates,
        "op9_license_scan": license_scan,
        "op10_differencing_packing": packed,
        "op11_periodic_runs": word_runs,
        "op12_spelling_variants": spelling_variants,
        "op13_perplexity_rules": quality_rules,
        "pipeline": corpus_pipeline.run,
    }.items()
}
