"""Incremental sync: a stream of caption files keeps a vector table up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.stores import captioned, last_per_key, sync_plan, upsert, without


def caption_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def sync_index(images: DataFrame, captions: DataFrame, index: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The index brought up to date with the folder, and one row (removed, encoded): vectors of images that are gone leave
    first, then captions without vectors are encoded and stand at the end."""
    plan = sync_plan(images, captions, index)
    gone, fresh = plan.filter("action = 'remove'").select("path"), plan.filter("action = 'encode'").select("path")
    kept = without(index, gone)
    todo = captions.join(fresh, "path", "left_semi")
    counts = plan.agg(F.count_if(F.col("action") == "remove").alias("removed"), F.count_if(F.col("action") == "encode").alias("encoded"))
    return upsert(kept, encode(todo)), counts


def index_image(path: str, captions: DataFrame, index: DataFrame, describe: Callable[[str], DataFrame], encode: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """The index with one image's vectors renewed; its caption is reused unless it is missing or `force` asks for a new one."""
    own = captions.filter(F.col("path") == path)
    return upsert(index, encode(describe(path) if force or own.isEmpty() else own))


def progress(query: StreamingQuery) -> tuple[int, int]:
    """(batches done, rows read so far) of a running stream, from its recent reports."""
    seen = query.recentProgress
    return (max((p["batchId"] for p in seen), default=-1) + 1, sum(p["numInputRows"] for p in seen))


def sync(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Each batch's new paths are encoded once and appended to `root`, a folder per batch.

    A batch that runs again overwrites its own folder, so the table holds every path once whatever fails: paths of other
    batches are taken out by an anti-join, and the last record of a path within a batch wins.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        own = f"{root}/batch={number}"
        todo = last_per_key(captioned(df).withColumn("__n", F.monotonically_increasing_id()), "path", "__n").drop("__n")
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            have = spark.read.option("basePath", root).parquet(root)
            todo = todo.join(have.filter(F.col("batch") != number).select("path").distinct(), "path", "left_anti")
        encode(todo).write.mode("overwrite").parquet(own)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
