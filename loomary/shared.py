"""The folder that driver and executors share, tables written there, and numbering of rows without one task for all."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one on a local master (tests); else an error,
    because a folder of one machine is no use to the others."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="loomary-")
        spark.sparkContext.setCheckpointDir(f"file://{_OWN[key]}")
    return f"file://{_OWN[key]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/loomary-{label}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended first
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder, which cuts its lineage, and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`df` plus `name`: the place of each row in the order, from 0.

    Rows are dealt by ranges of the order and a hash of the whole row (so a hot key spreads), ranked in their range, and
    written, because a second evaluation could cut the ranges elsewhere; offsets of the ranges, one small row each, give
    the rest. Rows that agree in all of it are interchangeable.
    """
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keys = [*[F.col(x) if isinstance(x, str) else x for x in order], F.xxhash64(*hashable)]
    names = [f"__o{i}" for i in range(len(keys))]
    dealt = df.withColumns(dict(zip(names, keys, strict=True))).repartitionByRange(*names).withColumn("__p", F.spark_partition_id())
    ranked = written(dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*names))).drop(*names), "numbered")
    counts = ranked.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    met = ranked.join(F.broadcast(before), F.col("__p") == F.col("__q"))  # a row per range
    return met.withColumn(name, F.col("__before") + F.col("__n") - 1).drop("__p", "__q", "__n", "__before")
