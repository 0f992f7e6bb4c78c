"""Statistics about the files of a lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import truncate_text
from ..sources import file_path, listed_files


def _files(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.row_index").alias("row_index"),
        "*",
    )


def readable_file_stats(df: DataFrame) -> DataFrame:
    """Rows and bytes per file that ``df`` reads; row counts come from the footers."""
    path, size = file_path(F.col("_metadata.file_path")), F.col("_metadata.file_size")
    return df.select(path.alias("path"), size.alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes per file. A listed file that gives no row is reported as ``empty_or_unreadable``."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    read = readable_file_stats(reader.schema(read_schema(spark, path)).parquet(path))
    listed = listed_files(spark, path).select("path", "bytes")
    missing = listed.join(read, "path", "left_anti").withColumn("rows", F.lit(0).cast("bigint"))
    both = read.withColumn("state", F.lit("ok")).unionByName(
        missing.withColumn("state", F.lit("empty_or_unreadable"))
    )
    return both.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "rows", "bytes", "state")


def read_schema(spark: SparkSession, path: str):
    """Schema of the first readable file below ``path``."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    return reader.parquet(path).schema


def dataset_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files, rows and kilobytes of the readable files."""
    stats = file_stats(spark, path).where(F.col("state") == "ok")
    return stats.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1024, 1).alias("kilobytes"),
    )


def file_samples(df: DataFrame, columns: int = 3, width: int = 50) -> DataFrame:
    """Per file: its columns, and the start of the first values of its first row."""
    names = df.columns[:columns]
    shown = [truncate_text(F.col(c).cast("string"), width, "...").alias(c) for c in names]
    first = F.min_by(F.struct(*shown), F.col("row_index"))
    return (
        _files(df)
        .groupBy("file_name")
        .agg(first.alias("sample"))
        .select("file_name", F.lit(", ".join(df.columns)).alias("columns"), "sample.*")
    )


def store_stats(df: DataFrame) -> DataFrame:
    """Spans, files and newest shard of a sharded lake."""
    return df.agg(
        F.count("*").alias("spans"),
        F.count_distinct(F.col("_metadata.file_path")).alias("files"),
        F.max("shard").alias("current_shard"),
    )


def batch_state(batched: DataFrame) -> DataFrame:
    """Highest batch and its row count; what a restart has to know."""
    per_batch = batched.groupBy(F.col("batch_idx").cast("bigint").alias("batch_idx")).agg(F.count("*").alias("rows"))
    return per_batch.agg(F.max("batch_idx").alias("batch_idx"), F.max_by("rows", "batch_idx").alias("rows"))


def preview(df: DataFrame, n: int = 10, width: int = 100) -> DataFrame:
    """First rows with every value as text cut at ``width``."""
    return df.limit(n).select(*[F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns])


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns, and the column names."""
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(", ".join(df.columns)).alias("names")
    )
