"""Keyed stores: first and last row per key, resumable work, folder profiles, imports, listings, deletes and sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folder_name, image_url, sticker_name, suffix
from ..schema import IMAGE_SUFFIXES


def last_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order`; keys are aggregated before the exchange, so a hot key is no burden."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by `order`."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def captioned(captions: DataFrame) -> DataFrame:
    """Rows that count as done: ok and with a path."""
    return captions.filter(F.coalesce("ok", F.lit(False)) & (F.coalesce("path", F.lit("")) != ""))


def done_paths(captions: DataFrame) -> DataFrame:
    return captioned(captions).select("path").distinct()


def pending(images: DataFrame, done: DataFrame, key: str = "path", overwrite: bool = False, limit: int = 0, order: Column | None = None) -> DataFrame:
    """Images not done yet, in order; a limit (0 or less: none) counts after the others are gone."""
    left = images if overwrite else images.join(done.select(key).distinct(), key, "left_anti")
    ordered = left.orderBy(order if order is not None else F.col(key))
    return ordered.limit(limit) if limit > 0 else ordered


def folder_profile(files: DataFrame, size: str, sha256: str) -> DataFrame:
    """One row: files, bytes, MB, groups of equal content and files beyond the first of each group."""
    groups = files.groupBy(sha256).agg(F.count("*").alias("c"), F.sum(size).alias("b"))
    return groups.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("image_files"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"),
        F.round(F.coalesce(F.sum("b"), F.lit(0)) / 1048576.0, 3).alias("total_megabytes"),
        F.count_if(F.col("c") > 1).alias("duplicate_content_groups"),
        F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("duplicate_files"),
    )


def counts_by(files: DataFrame, key: str, name: str = "files") -> DataFrame:
    return files.groupBy(key).agg(F.count("*").alias(name))


def import_plan(files: DataFrame, known: DataFrame, sha256: str, order: str, present: DataFrame | None = None, limit: int = 0, keep_duplicates: bool = False) -> DataFrame:
    """Files in order with an action: imported, exists or skipped_duplicate. A limit counts imported rows only, and rows after
    it are left out.

    `known`: hashes of the manifest. `present`: column `order` of files whose destination exists. The order key is unique;
    with a limit, the key of the last row that may be imported comes from a top-k, so nothing is numbered in one task.
    """
    seen = known.select(F.col(sha256).alias("k")).distinct().withColumn("known", F.lit(True))
    first = files.groupBy(F.col(sha256).alias("h")).agg(F.min(order).alias("__first"))  # aggregated before the exchange: a common file is no burden
    met = files.join(first, F.col(sha256).eqNullSafe(F.col("h"))).join(seen, F.col(sha256) == F.col("k"), "left")
    duplicate = F.lit(False) if keep_duplicates else F.col("known").isNotNull() | (F.col(order) > F.col("__first"))
    if present is not None:
        there = present.select(F.col(order).alias("p")).distinct().withColumn("there", F.lit(True))
        met = met.join(there, F.col(order) == F.col("p"), "left").drop("p")
    exists = F.col("there").isNotNull() if present is not None else F.lit(False)
    plan = met.withColumn("action", F.when(duplicate, "skipped_duplicate").when(exists, "exists").otherwise("imported")).drop("k", "known", "h", "__first", "there")
    if limit <= 0:
        return plan
    top = plan.filter(F.col("action") == "imported").select(order).orderBy(order).limit(limit)
    last = top.agg(F.when(F.count("*") == limit, F.max(order)).alias("__last"))  # one row
    return plan.crossJoin(F.broadcast(last)).filter(F.col("__last").isNull() | (F.col(order) <= F.col("__last"))).drop("__last")


def import_folder(files: DataFrame, manifest: DataFrame, folder: str, prefix: str, present: DataFrame | None = None, limit: int = 0, keep_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """The plan of a folder's import (source, sha256, length, destination, action), and one row of counters.

    `files`: source, content, length. `present`: the column destination of files that exist. copy_files carries it out.
    """
    hashed = files.select("source", "length", F.sha2("content", 256).alias("sha256"))
    named = hashed.withColumn("destination", F.concat(F.lit(folder.rstrip("/") + "/"), folder_name(F.col("source"), F.col("sha256"), prefix)))
    there = named.join(present.select("destination").distinct(), "destination", "left_semi").select("source") if present is not None else None
    plan = import_plan(named, manifest, "sha256", "source", there, limit, keep_duplicates)
    return plan, _import_counts(plan)


def import_pack(resolved: DataFrame, manifest: DataFrame, folder: str, present: DataFrame | None = None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """The plan of a pack's import and one row of counters; `ok` is false where stickers were resolved and none is there.

    `resolved`: position, sticker_id, md5, source (null: missing), sha256 (of the file). Missing files are left out of the plan.
    """
    found = resolved.filter(F.col("source").isNotNull())
    named = found.withColumn("destination", F.concat(F.lit(folder.rstrip("/") + "/"), sticker_name(F.col("sticker_id"), F.col("md5"), F.col("source"))))
    there = named.join(present.select("destination").distinct(), "destination", "left_semi").select("position") if present is not None else None
    plan = import_plan(named, manifest, "sha256", "position", there, limit)
    missing = resolved.agg(F.count_if(F.col("source").isNull()).alias("missing"))
    counts = _import_counts(plan).crossJoin(missing)
    return plan, counts.withColumn("ok", (F.col("missing") == 0) | (F.col("imported") + F.col("exists") > 0))


def _import_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("imported", "exists", "skipped_duplicate")], F.count("*").alias("total"))


def uploads(files: DataFrame, at: Column) -> DataFrame:
    """Uploaded files (path, content) with sha256 and the name they are stored by; `problem` where the type isn't known."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    name = F.concat(F.unix_timestamp(at).cast("string"), F.lit("_"), F.substring("sha256", 1, 16), suffix(F.col("path")))
    known = suffix(F.col("path")).isin(IMAGE_SUFFIXES)
    return hashed.withColumn("name", F.when(known, name)).withColumn("problem", F.when(~known, F.lit("unsupported type")))


def copy_files(plan: DataFrame, mode: str = "copy") -> None:
    """Carry out a plan (source, destination, action) on a file system that all executors mount; `exists` rows are skipped."""
    if mode not in ("copy", "symlink", "hardlink"):
        raise ValueError(f"unknown mode {mode}")

    def run(rows) -> None:
        import os
        import shutil

        act = {"copy": shutil.copy2, "symlink": os.symlink, "hardlink": os.link}[mode]
        for r in rows:
            os.makedirs(os.path.dirname(r["destination"]), exist_ok=True)
            temporary = f"{r['destination']}.part"
            if os.path.lexists(temporary):
                os.unlink(temporary)
            act(r["source"], temporary)
            os.replace(temporary, r["destination"])  # a task that runs twice does no harm

    plan.filter(F.col("action") == "imported").select("source", "destination").foreachPartition(run)


def listing(images: DataFrame, captions: DataFrame, indexed: DataFrame, fields: list[str]) -> DataFrame:
    """Images with their caption fields (blank if none), whether they are indexed, and their address."""
    own = captions.select("path", *[F.col(f).alias(f) for f in fields])
    marks = indexed.select("path").distinct().withColumn("m", F.lit(True))
    met = images.join(own, "path", "left").join(marks, "path", "left")
    return met.select("path", image_url(F.col("path")).alias("url"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields], F.coalesce("m", F.lit(False)).alias("indexed"))


def corpus_status(images: DataFrame, captions: DataFrame, vectors: DataFrame, key: str = "path") -> DataFrame:
    """One row with the numbers of images, captioned and indexed paths."""
    count = lambda df, name: df.agg(F.count_distinct(key).alias(name))
    return count(images, "images").crossJoin(count(captions, "captions")).crossJoin(count(vectors, "vectors"))


def without(df: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def cascade_delete(keys: DataFrame, key: str = "path", **stores: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The stores without the keys, and one row of how many rows each loses."""
    gone, counts = keys.select(key).distinct(), None
    for name, df in stores.items():
        n = df.join(gone, key, "left_semi").agg(F.count("*").alias(f"removed_{name}"))
        counts = n if counts is None else counts.crossJoin(n)
    return {name: without(df, gone, key) for name, df in stores.items()}, counts


def upsert(store: DataFrame, incoming: DataFrame, key: str = "path", ordinal: str = "ordinal") -> DataFrame:
    """Rows of `incoming` replace all rows of their keys and stand at the end."""
    top = store.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("top"))
    moved = incoming.crossJoin(top).withColumn(ordinal, F.col(ordinal) + F.col("top") + 1).drop("top")
    return without(store, incoming, key).unionByName(moved, allowMissingColumns=True)


def sync_plan(images: DataFrame, captions: DataFrame, vectors: DataFrame, key: str = "path") -> DataFrame:
    """(key, action): `remove` for vectors without image, then `encode` for captions of images without vector."""
    have = vectors.select(key).distinct()
    stale = have.join(images.select(key).distinct(), key, "left_anti").select(key, F.lit("remove").alias("action"))
    missing = captions.select(key).distinct().join(have, key, "left_anti").join(images, key, "left_semi")
    return stale.unionByName(missing.select(key, F.lit("encode").alias("action")))
