"""Sinks: JSON lines, CSV, vector tables and batches; rewrites go to a new snapshot that a pointer then names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOG_COLUMNS, CLUSTER_COLUMNS
from .log import Store


def append_jsonl(df: DataFrame, path: str, dry_run: bool = False) -> None:
    """Append rows as JSON lines, as one commit of the log in `path`, so that appends keep their order and writers don't meet;
    files.jsonl reads them back in order."""
    Store(df.sparkSession, path, df.schema, form="json").append(df, dry_run)


def snapshot(df: DataFrame, root: str) -> str:
    """Write a new version beside the older ones, then point to it; readers never see half a store."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/{version}")


def _csv(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def cluster_csv(df: DataFrame, path: str, encoder: str) -> None:
    """Rows without error, all columns as text, missing ones empty."""
    good = df.filter(F.col("error").isNull()) if "error" in df.columns else df
    _csv(good.withColumn("encoder", F.lit(encoder)), CLUSTER_COLUMNS, path)


def catalog_csv(df: DataFrame, path: str) -> None:
    _csv(df, CATALOG_COLUMNS, path)


def feature_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def batches(df: DataFrame, path: str) -> None:
    """Rows with batch_index to a folder per batch."""
    df.write.mode("overwrite").partitionBy("batch_index").json(path)


def vector_table(df: DataFrame, path: str) -> None:
    """A new version by field, so that a search over some fields reads only those; a pointer then names it, so an index
    may be rewritten from itself and readers never see half of one."""
    version = uuid.uuid4().hex
    df.write.partitionBy("field").parquet(f"{path}/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
