"""The driver's tables in the roles this engine gives them. Columns and filters reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path, language, size_bytes, content, doc_id) from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo_id"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"), "doc_id")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, repo_id, agent, agents, latency_ms, citations, ts) from events."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("repo_id"), F.col("event_type").alias("agent"), F.array("event_type", F.lit("mentor")).alias("agents"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("citations"), "ts")
