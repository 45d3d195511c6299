"""Sources: image folders, lenient and strict JSON lines, keyed CSV, packs and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_caption, path_order, semantic_text, suffix
from ..operators.stores import captioned, last_per_key
from ..schema import CLUSTER_COLUMNS, IMAGE_SUFFIXES, PACK, VECTORS
from ..shared import numbered
from .log import COMMIT, POSITION, Store, is_store


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of image files in order of path parts; columns not selected aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.filter(suffix(F.col("path")).isin(IMAGE_SUFFIXES)).orderBy(path_order(F.col("path")))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lenient: a missing file has no rows; blank and malformed lines are skipped. Rows of a log (sinks.append_jsonl) come in the
    order in which they were appended."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if is_store(spark, path):
        return Store(spark, path, schema, form="json").rows().orderBy(COMMIT, POSITION).select(*schema.names)
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    found = spark.read.schema(marked).option("columnNameOfCorruptRecord", "_bad").json(path)
    return found.filter(F.col("_bad").isNull() & F.greatest(*[F.col(f.name).isNotNull() for f in schema.fields])).drop("_bad")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, _line_number, ordinal, line) of text files: the line's number in its file (from 1, blank lines count) and its place
    over all files (from 0), which are taken by name.

    Files are read in splits, side by side. A split's lines have ascending ids; how many lines stand in the splits before it
    follows from one count a split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", "first", before(Window.partitionBy("file").orderBy("block")).alias("above"), before(Window.orderBy("file", "block")).alias("ahead"))
    at = F.col("id") - F.col("first")
    return raw.join(starts, ["file", "block"]).select("file", (F.col("above") + at + 1).alias("_line_number"), (F.col("ahead") + at).alias("ordinal"), "line")


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with file, _line_number and ordinal (see numbered_lines); the first malformed line raises ValueError.

    A log (sinks.append_jsonl) has an ordinal by its commits and no line numbers: its lines were never written by hand.
    """
    if is_store(spark, path):
        rows = Store(spark, path, schema, form="json").rows()
        return numbered(rows, [COMMIT, POSITION], "ordinal").select(*schema.names, F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("_line_number"), "ordinal")
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    bad = lines.filter(F.try_parse_json("line").isNull()).orderBy("file", "_line_number").first()
    if bad:
        raise ValueError(f"{bad['file']}:{bad['_line_number']}: not JSON")
    return lines.select(F.from_json("line", schema).alias("r"), "file", "_line_number", "ordinal").select("r.*", "file", "_line_number", "ordinal")


def pack_images(spark: SparkSession, folder: str) -> DataFrame:
    """A pack's stickers, as `images`; no rows without a stickers folder."""
    own = f"{folder.rstrip('/')}/stickers"
    if exists(spark, own):
        return images(spark, own)
    return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def captions(spark: SparkSession, path: str, schema: T.StructType, fields: list[str]) -> DataFrame:
    """Strict captions: a malformed line raises; (path, ordinal, fields .., semantic_text) of rows that are ok and have a path.
    Repeated paths stay. Ordinals are unique over all part files."""
    rows = captioned(strict_jsonl(spark, path, schema))
    caption = normalize_caption(F.col("caption"))
    own = rows.select("path", "ordinal", caption.alias("c"))
    return own.select("path", "ordinal", *[F.col(f"c.{f}").alias(f) for f in fields], semantic_text(F.col("c")).alias("semantic_text"))


def csv_by_path(spark: SparkSession, path: str, columns: list[str], key: str = "path") -> DataFrame:
    """A CSV's last row per key, in order of file names and lines; rows without key are left out."""
    rows = csv(spark, path, columns)
    if exists(spark, path):  # a file is one split, as values may hold line ends
        rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_ordinal": F.monotonically_increasing_id()})
        return last_per_key(rows.filter(F.coalesce(F.col(key), F.lit("")) != ""), key, "_file", "_ordinal").drop("_file", "_ordinal")
    return rows


def cluster_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a cluster CSV that have a path and a cluster."""
    return csv(spark, path, CLUSTER_COLUMNS).filter((F.coalesce("path", F.lit("")) != "") & (F.coalesce("visual_cluster_id", F.lit("")) != ""))


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all strings; a missing file has no rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


def pack(spark: SparkSession, folder: str) -> DataFrame:
    """(packName, stickerCount, position, sticker) of a pack's info file; raises FileNotFoundError without one."""
    path = f"{folder.rstrip('/')}/pack_info.json"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(PACK).json(path, multiLine=True).select("packName", "stickerCount", F.posexplode_outer("stickers").alias("position", "sticker"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector table (the current version, if it has versions); a missing validity counts as valid. Raises ValueError if a
    column is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if exists(spark, f"{path}/current"):
        path = f"{path}/{spark.read.schema('version string').json(f'{path}/current').first()[0]}"
    found = spark.read.parquet(path)
    missing = {"path", "ordinal", "field", "text", "vector"} - set(found.columns)
    if missing:
        raise ValueError(f"vector table without {', '.join(sorted(missing))}")
    valid = F.coalesce(F.col("valid"), F.lit(True)) if "valid" in found.columns else F.lit(True)
    return found.withColumn("valid", valid)


def vectors_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return vectors(spark, path) if exists(spark, path) else None


def indexed_paths(spark: SparkSession, path: str) -> DataFrame:
    """The distinct paths of a vector table; none if it is missing."""
    found = vectors_or_none(spark, path)
    return (found if found is not None else empty_vectors(spark)).select("path").distinct()


def empty_vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VECTORS)


def features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table, as sinks.feature_table wrote it."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)
