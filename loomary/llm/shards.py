"""Sharding by histogram sort: shards are ranges of one key order whose bytes are nearly equal.

The key is (hash of the text, document id), so equal texts stand together and only a group heavier than the tolerance
is divided. Each shard is cut into sub-ranges of about `target_bytes`, so that the one exchange of whole rows makes
tasks of bounded size; beyond SUBRANGES of them in all (4 TB at 64 MB) they grow, so that the driver's table of splitters
doesn't, and are sorted with spills; the histograms give the exact number of rows below each
sub-range, from which slots follow without a further pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read
from .histogram import LOW, find_ranges

OVERHEAD = 16
SUBRANGES = 1 << 16


def shard(docs: DataFrame, shards: int = 40, text_col: str = "text", id_col: str = "doc_id", tolerance: float = 0.001, target_bytes: int = 64 << 20) -> DataFrame:
    """`docs` plus `placed` (a column of that name is replaced), a struct of size, shard (from 0) and slot (gapless in each shard, from 0).

    A row's size is the UTF-8 bytes of its text plus 16. Shards differ from equal bytes by `tolerance` of a shard or by
    one document's size. Null texts count as size 16; null ids come first among equal texts. Rows that share text and
    id are one key and stay in one shard. An empty table gives an empty one. Slots among rows with the same key follow
    no order of their own.
    """
    size = F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long") + OVERHEAD
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "placed"]).alias("row"), size.alias("size"), F.shiftrightunsigned(F.xxhash64(f"`{text_col}`"), 1).alias("k1"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOW)).alias("k2"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    parts = max(1, min(SUBRANGES // shards, max(4, -(-total // (shards * target_bytes)))))
    mean = total / shards
    ranges = find_ranges(keyed.select("k1", "k2", "size"), "k1", "k2", "size", shards * parts, lambda i: mean * (tolerance if i % parts == 0 else 0.2 / parts))
    if ranges is None:
        return docs.withColumn("placed", F.lit(None).cast("struct<size: bigint, shard: int, slot: bigint>"))
    starts = [0, *(s.rows_below for s in ranges.splits)]
    offsets = docs.sparkSession.createDataFrame([(i, i // parts, starts[i] - starts[i // parts * parts]) for i in range(len(starts))], "sub int, shard int, offset long")
    dealt = ranges.assign(keyed, "k1", "k2", "sub").withColumn("n", F.row_number().over(Window.partitionBy("sub").orderBy("k1", "k2")))
    placed = dealt.join(F.broadcast(offsets), "sub")
    return placed.select("row.*", F.struct("size", "shard", (F.col("offset") + F.col("n") - 1).alias("slot")).alias("placed"))


def op1_shards(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents in shards 0 to 39 of nearly equal bytes."""
    placed = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "placed.size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard"))
