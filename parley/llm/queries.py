"""The operators of this package, each over its whole given table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    alignment,
    collision_search,
    license_scan,
    near_dedup,
    packing,
    piece_codec,
    quality,
    quality_rules,
    spelling_variants,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from parley.llm.common import only, table

# Parts of host names that the blocked hosts of the query are known by.
BLOCKED_NAMES = ("adult", "ads-track", "casino", "cheap-pills", "free-bets", "spam-farm")


def documents(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return only(table(spark, folder, "documents"), "doc_id", "text", *more)


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scanned(documents(spark, folder)).drop("spans")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(documents(spark, folder, "source", "lang"), table(spark, folder, "labels"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_words_removed(documents(spark, folder)).drop("kept_text")


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.linked(documents(spark, folder))


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.segmented(documents(spark, folder))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = only(table(spark, folder, "pages"), "page_id", "url")
    hosts = url_filter.with_parts(pages).select(F.col("host").alias("key")).distinct()
    return url_filter.judged(pages, hosts.filter(F.col("key").rlike("|".join(BLOCKED_NAMES))))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return collision_search.neighbours(only(table(spark, folder, "embeddings"), "vec_id", "embedding"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(documents(spark, folder))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(documents(spark, folder), table(spark, folder, "labels"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(documents(spark, folder))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.grouped(documents(spark, folder))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_minhash": op5_minhash,
    "op6_pieces": op6_pieces,
    "op7_url_filter": op7_url_filter,
    "op8_neighbours": op8_neighbours,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_counts": op13_token_counts,
}
