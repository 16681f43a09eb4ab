"""Sinks: JSON lines, CSV, Parquet by condition, vector indexes and usage logs. Upserted tables are in keyed.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.sources.shared import drop


def json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").json(path)


def csv_report(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def vector_index(df: DataFrame, path: str, index_key: str) -> None:
    """(id, embedding) under index_key=...; never a pickle. Writing a key again replaces that key alone."""
    df.select("id", "embedding", F.lit(index_key).alias("index_key")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_key").parquet(path)


def load_index(spark: SparkSession, path: str, index_key: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("index_key") == index_key).drop("index_key")


def index_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("index_key").agg(F.count("*").alias("n"))


def delete_index(spark: SparkSession, path: str, index_key: str) -> bool:
    """Removes one key of the stored indexes; whether it was there."""
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(index_key)
    return drop(spark, f"{path}/index_key={folder}")


def retrieval_lines(retrieved: DataFrame, path: str) -> None:
    """A JSON line for each question with its results in order: retrieved (question, rank, id, score)."""
    results = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    json_lines(retrieved.groupBy("question").agg(results.alias("results")), path)


def log_usage(df: DataFrame, path: str) -> None:
    """Appends facts; summaries are aggregated when asked for, so nothing is locked."""
    df.write.mode("append").parquet(path)
