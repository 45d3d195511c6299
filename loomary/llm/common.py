"""Helpers that the training-data operators share: table reading and written intermediate tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, new_path
from ..shared import written as _written

BITS = 1 << 24
_SCOPE: ContextVar[str] = ContextVar("scope", default="")
_TABLES: dict[str, list[str]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the package (on a cluster, give it with --py-files)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written inside belong to this scope; those that an earlier use of it left are deleted first.

    For chains whose every result is stored before the next step begins, as in a pipeline of stages.
    """
    for path in _TABLES.pop(name, []):
        delete(spark, path)
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and read back from the shared folder; it belongs to the scope around it."""
    out = _written(df, label)
    _TABLES.setdefault(_SCOPE.get(), []).append(out.written_at)
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables whose last reader has been written itself."""
    for df in tables:
        delete(df.sparkSession, df.written_at)


def maybe_in(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose `key` (a hash) may be in `known`: a bitmap of BITS bits tells, which has 2^18 rows at most
    and so is broadcast. It only spares the exact join after it rows that are of no use."""
    bit, word = f"shiftrightunsigned({key}, 58)", f"({key} & {BITS // 64 - 1}L)"
    bits = known.groupBy(F.expr(word).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} as int))")).alias("__bits"))
    met = df.withColumn("__word", F.expr(word)).join(F.broadcast(bits), "__word")
    return met.filter(F.expr(f"(shiftrightunsigned(__bits, cast({bit} as int)) & 1L) = 1")).drop("__word", "__bits")
