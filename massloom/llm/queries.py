"""Queries of the problems on language data and on matching and clustering records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import clusters, languages, matching, mixing, oracles, tokens
from massloom.operators import units
from massloom.session import cut, table


def _features(spark: SparkSession, d: str) -> DataFrame:
    return units.feature_units(table(spark, d, "feature_metadata"), table(spark, d, "study"))


def _ions(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster(_features(spark, d), "feature_id", "polarity", "mz", "rt_sec", 0.015, 15.0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ions(spark, d).select(F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("key").cast("bigint").alias("feature_id"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.describe(_ions(spark, d))
    return c.withColumn("x", F.round(F.col("x") + 1e-9, 6)).withColumn("y", F.round(F.col("y") + 1e-7, 4))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return tokens.encode_texts(docs).select("doc_id", "ids")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(languages.label_segments(table(spark, d, "documents")))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.label_segments(table(spark, d, "documents"))


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(_features(spark, d), table(spark, d, "sample_metadata"), table(spark, d, "partner_features"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = matching.accepted(_features(spark, d), table(spark, d, "sample_metadata"), table(spark, d, "partner_features"))[2]
    return pairs.select("feature_id", "partner_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(tokens.count_tokens(table(spark, d, "documents").select("doc_id", "source", "votes", "text")).drop("text"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(_sized(spark, d), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, target = _sized(spark, d), table(spark, d, "mix_target")
    sizes = sized.select(mixing.source_key(F.col("source")).alias("source"), "tokens").filter("source is not null and tokens > 0")
    return mixing.shares(mixing.draw(sized, target), sizes, target)


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p7_mix": p7_mix, "p7_shares": p7_shares, "p4_found": p4_found, "p4_clusters": p4_clusters, "p6_ids": p6_ids, "p8_found": p8_found, "p8_segments": p8_segments}
SQL: dict[str, str] = oracles.SQL
