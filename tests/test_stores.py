import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomary.operators import captions, catalog, stores
from loomary.schema import CATALOG_COLUMNS, MANIFEST_RECORD
from loomary.sources import files, sinks
from loomary.streaming.sync import caption_stream, sync


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_folder_scan_profile_and_import(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("hello world.png", "sub/duplicate.PNG", "notes.txt"):
        (tmp_path / name).write_bytes(b"same")
    found = files.images(spark, str(tmp_path)).select("path", "length", F.sha2("content", 256).alias("sha"))
    assert found.count() == 2 and files.images(spark, str(tmp_path), recursive=False).count() == 1
    assert stores.folder_profile(found, "length", "sha").first().asDict() | {"total_megabytes": 0} == {"image_files": 2, "total_bytes": 8, "total_megabytes": 0, "duplicate_content_groups": 1, "duplicate_files": 1}
    plan = stores.import_plan(found, found.limit(0), "sha", "path")
    assert sorted(r["action"] for r in plan.collect()) == ["imported", "skipped_duplicate"]
    target = plan.withColumn("source", F.regexp_replace("path", "^file:/+", "/")).withColumn("destination", F.concat(F.lit(f"{tmp_path}/out/"), "sha"))
    stores.copy_files(target)
    assert len(list((tmp_path / "out").iterdir())) == 1
    with pytest.raises(ValueError):
        stores.copy_files(target, "move")


def test_empty_profile(spark):
    empty = spark.createDataFrame([], "length long, sha string")
    assert stores.folder_profile(empty, "length", "sha").first()["image_files"] == 0


def test_import_limit_counts_imported_only(spark):
    df = spark.createDataFrame([(i, str(i // 2)) for i in range(10)], "id long, sha string")
    plan = stores.import_plan(df, df.filter("id = 0"), "sha", "id", df.filter("id = 2"), 2)
    assert rows(plan.select("id", "action"), "id") == [(0, "skipped_duplicate"), (1, "skipped_duplicate"), (2, "exists"), (3, "skipped_duplicate"), (4, "imported"), (5, "skipped_duplicate"), (6, "imported")]
    assert stores.import_plan(df, df.limit(0), "sha", "id", keep_duplicates=True).filter("action = 'imported'").count() == 10


def test_lenient_and_strict_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"path":"a","ok":true}\n\nbroken\n{"path":"b","ok":false}\n')
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("ok", T.BooleanType())])
    got = files.jsonl(spark, str(path), schema)
    assert rows(got, "path") == [("a", True), ("b", False)]
    assert files.jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(ValueError, match=":3:"):
        files.strict_jsonl(spark, str(path), schema)
    path.write_text('{"path":"a"}\n\n{"path":"b"}')
    assert [r["_line_number"] for r in files.strict_jsonl(spark, str(path), schema).orderBy("path").collect()] == [1, 3]


def test_done_and_last_wins(spark):
    df = spark.createDataFrame([("a", True, 0), ("a", False, 1), ("b", False, 2), ("b", True, 3), ("", True, 4), (None, True, 5)], "path string, ok boolean, n int")
    assert rows(stores.done_paths(df), "path") == [("a",), ("b",)]
    last = stores.last_per_key(df.filter("path <> ''"), "path", "n")
    assert rows(last, "path") == [("a", False, 1), ("b", True, 3)]
    assert rows(stores.last_per_key(stores.captioned(df), "path", "n"), "path") == [("a", True, 0), ("b", True, 3)]
    assert rows(stores.pending(df.select("path").filter("path <> ''").distinct(), stores.done_paths(df).filter("path = 'a'")), "path") == [("b",)]
    assert stores.pending(df.select("path"), df.limit(0), limit=-1).count() == 6


def test_upsert_and_sync(spark):
    store = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "path string, ordinal long")
    got = stores.upsert(store, spark.createDataFrame([("a", 0)], "path string, ordinal long"))
    assert rows(got, "ordinal") == [("b", 1), ("a", 3)]
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert rows(stores.sync_plan(one("a", "b"), one("a", "b", "z"), one("b", "c")), "path") == [("a", "encode"), ("c", "remove")]
    left, counts = stores.cascade_delete(one("a", "q"), images=one("a", "b"), captions=one("a", "a"))
    assert counts.first().asDict() == {"removed_images": 1, "removed_captions": 2} and left["captions"].count() == 0


def test_catalog_round_trip(spark, tmp_path):
    images = spark.createDataFrame([("images/a.png", "a.png")], "path string, file_name string")
    none = spark.createDataFrame([], MANIFEST_RECORD)
    out = catalog.export(images, (none, {"source_path": "source_path"}))
    sinks.catalog_csv(out, str(tmp_path / "catalog"))
    again = files.csv(spark, str(tmp_path / "catalog"), CATALOG_COLUMNS)
    assert again.columns == CATALOG_COLUMNS and again.count() == 1
    edits = again.withColumn("manual_tags", F.lit("私房梗;常用")).withColumn("wechat_keyword", F.lit("懂了"))
    store = spark.createDataFrame([], "path string, ok boolean, source string, manual_tags string, wechat_keyword string")
    applied = catalog.apply_edits(store, edits, ["wechat_keyword", "manual_tags"])
    assert rows(applied.select("change", "semantic_text", "source"), "change") == [("created", "懂了；私房梗;常用", "catalog_csv")]


def test_edits_keep_failed_records_failed_and_apply_in_order(spark):
    store = spark.createDataFrame([("a", False, "", "old", "x")], "path string, ok boolean, source string, f string, g string")
    edits = spark.createDataFrame([("a", "one", "", 1), ("a", "", "two", 2), (" ", "z", "z", 3)], "path string, f string, g string, n int")
    got = catalog.apply_edits(store, edits, ["f", "g"], ordinal="n").first().asDict()
    assert got == {"path": "a", "ok": False, "source": "catalog_csv", "change": "changed", "f": "one", "g": "two", "semantic_text": "one；two"}
    got = catalog.apply_edits(store, edits, ["f", "g"], overwrite=True, ordinal="n").first()
    assert (got["f"], got["g"]) == ("NONE", "two")


def test_annotation_batches_and_validation(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(7)], "n int")
    b = catalog.batches(df, "n", 3)
    assert rows(b.select("n", "batch_index"), "n") == [(i, i // 3) for i in range(7)]
    sinks.batches(b, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 7
    ext = spark.createDataFrame([(1, "a"), (2, " "), (3, "a "), (4, None)], "line int, path string")
    got = catalog.validate_external(ext, "path", "line").orderBy("line").collect()
    assert [r["problem"] for r in got] == [None, "missing path", "duplicate path", "missing path"]


def test_merge_external(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "path string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 8)], "path string, v int")
    assert rows(catalog.merge_external(old, new, "path", False), "path") == [("a", 1, "kept"), ("b", 2, "skipped"), ("c", 8, "added")]
    assert rows(catalog.merge_external(old, new, "path", True), "path")[1] == ("b", 9, "replaced")


def test_pack(spark, tmp_path):
    (tmp_path / "stickers").mkdir()
    (tmp_path / "stickers" / "ABCDEF.jpg").write_bytes(b"x")
    (tmp_path / "pack_info.json").write_text(json.dumps({"packName": "p", "stickerCount": 1, "stickers": [{"stickerId": "7", "md5": "abcdef", "downloaded": True, "fileSize": 10}]}))
    items = files.pack(spark, str(tmp_path)).select("position", "sticker.*")
    found = files.images(spark, str(tmp_path / "stickers")).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.lit(0).alias("place"), F.lit(True).alias("primary"), F.lit(True).alias("direct"))
    got = catalog.resolve(items, "position", F.col("path"), F.col("md5"), found)
    assert got.first()["found_by"] == "by_code"
    profile = catalog.pack_profile(got, F.col("source").isNotNull(), F.col("downloaded"), F.col("fileSize")).first().asDict()
    assert profile == {"metadata_records": 1, "available_source_files": 1, "missing_source_files": 0, "downloaded_records": 1, "positive_file_size_records": 1}
    with pytest.raises(FileNotFoundError):
        files.pack(spark, str(tmp_path / "stickers"))


def test_snapshot(spark, tmp_path):
    for n in (1, 2):
        sinks.snapshot(spark.range(n), str(tmp_path / "s"))
    assert sinks.read_snapshot(spark, str(tmp_path / "s")).count() == 2


def _flaky(path):
    if path == "bad":
        raise captions.RequestError("busy", 503, "r", "b")
    return "text " + path


def test_captioner_failures_are_rows(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "path string")
    got = {r["path"]: r for r in captions.describe(df, _flaky, 2, lambda s: None).collect()}
    assert got["a"]["content"] == "text a" and got["a"]["attempts"] == 1
    assert not got["bad"]["ok"] and got["bad"]["status"] == 503 and got["bad"]["attempts"] == 3


def test_stream_encodes_each_path_once(spark, tmp_path):
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("ok", T.BooleanType())])
    (tmp_path / "in").mkdir()
    for name, paths in (("1", ["a", "b", "a"]), ("2", ["b", "c"])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"path": p, "ok": True}) for p in paths))
        sync(caption_stream(spark, str(tmp_path / "in"), schema), lambda df: df.select("path"), str(tmp_path / "v"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "v")).select("path"), "path") == [("a",), ("b",), ("c",)]
