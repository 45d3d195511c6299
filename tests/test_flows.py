"""Whole flows: batches, external captions, imports, uploads, captioning, settings, sync."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomary.operators import captions, catalog, stores, vectors
from loomary.schema import CAPTION_RECORD, CLUSTER_COLUMNS
from loomary.shared import numbered
from loomary.sources import files, sinks
from loomary.streaming.sync import index_image, sync_index


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_batches_keep_every_column_and_row(spark, adaptive):
    """Wide rows and repeated order keys, with and without adaptive execution."""
    df = spark.range(20_000).select((F.col("id") % 6000).alias("k"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("wide"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = catalog.batches(df, "k", 300).select("k", "id", "batch_index", F.sha2("wide", 256).alias("w")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r["id"] for r in got) == list(range(20_000)) and len({r["w"] for r in got}) == 20_000
    by = {}
    for r in got:
        by.setdefault(r["batch_index"], []).append(r["k"])
    assert {b: len(v) for b, v in by.items()} == {b: 300 if b < 66 else 200 for b in range(67)}
    assert all(max(by[b]) <= min(by[b + 1]) for b in range(66))


def test_numbering_of_equal_and_no_rows(spark):
    df = spark.createDataFrame([(1, None)] * 5 + [(None, "x")] * 2, "a int, b string")
    assert sorted(r["n"] for r in numbered(df, ["a"], "n").collect()) == list(range(7))
    assert numbered(df.limit(0), ["a"], "n").columns == ["a", "b", "n"] and numbered(df.limit(0), ["a"], "n").count() == 0
    with pytest.raises(ValueError):
        catalog.batches(df, "a", 0)


def test_export_of_batches(spark):
    images = spark.createDataFrame([(f"p{i}",) for i in range(7)], "path string")
    done = spark.createDataFrame([("p1",), ("gone",), ("p1",)], "path string")
    out, counts = catalog.export_batches(images, done, 2, limit=5)
    assert sorted((r["path"], r["batch_index"]) for r in out.collect()) == [("p0", 0), ("p2", 0), ("p3", 1), ("p4", 1), ("p5", 2)]
    assert tuple(counts.first()) == (3, 5, 2)
    assert tuple(catalog.export_batches(images, done, 3, overwrite=True)[1].first()) == (3, 7, 2)


def test_guarded_merge(spark):
    old = spark.createDataFrame([("a", "1"), (None, "x")], "path string, v string")
    good = spark.createDataFrame([("a", "2", 1), ("b", "3", 2)], "path string, v string, line int")
    assert sorted(tuple(r) for r in catalog.guarded_merge(old, good, "path", "line", False).collect()) == [("a", "1", "skipped"), ("b", "3", "added")]
    bad = spark.createDataFrame([("a", "2", 1), (" ", "3", 2), ("a", "4", 3)], "path string, v string, line int")
    with pytest.raises(ValueError, match="line 2: missing path; line 3: duplicate path"):
        catalog.guarded_merge(old, bad, "path", "line", True)
    summary = catalog.validation_summary(catalog.validate_external(bad, "path", "line"), "line").first()
    assert summary["valid"] == 1 and [tuple(e) for e in summary["errors"]] == [(2, "missing path"), (3, "duplicate path")]


def test_external_items(spark):
    df = spark.createDataFrame([(" a ", '{"x": 1}', "in", "top"), ("b", "text", None, " top "), ("c", None, None, None)], "path string, raw string, x string, top string")
    made = catalog.external_item(F.col("path"), F.struct(F.col("x").alias("x")), F.col("raw"), {"x": F.col("top")}, F.lit("m"), ["x"])
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in made.items()]).orderBy("path").collect()] == [("a", "m", "in", "in"), ("b", "m", "top", "top"), ("c", "m", "NONE", "")]


def test_imports(spark):
    found = spark.createDataFrame([(f"/s/{n}", bytearray(c), 4) for n, c in (("a b.png", b"1"), ("b.PNG", b"1"), ("c.gif", b"2"), ("d", b"3"))], "source string, content binary, length long")
    none = spark.createDataFrame([], "sha256 string")
    plan, counts = stores.import_folder(found, none, "/out/", "my set")
    got = {r["source"]: r for r in plan.collect()}
    assert got["/s/a b.png"]["destination"].startswith("/out/my_set_a_b_") and got["/s/d"]["destination"].endswith(".png")
    assert tuple(counts.first()) == (3, 0, 1, 4)
    there = plan.filter("source = '/s/c.gif'").select("destination")
    assert tuple(stores.import_folder(found, none, "/out", "my set", there)[1].first()) == (2, 1, 1, 4)
    limited, counts = stores.import_folder(found, plan.filter("source like '%c.gif'").select("sha256"), "/out", "x", limit=2)
    assert {r["source"]: r["action"] for r in limited.collect()} == {"/s/a b.png": "imported", "/s/b.PNG": "skipped_duplicate", "/s/c.gif": "skipped_duplicate", "/s/d": "imported"}
    first = stores.import_folder(found, none, "/out", "x", limit=1)[0]
    assert [r["source"] for r in first.collect()] == ["/s/a b.png"]


def test_pack_import(spark):
    items = spark.createDataFrame([(i, str(i), f"m{i}", None if i % 2 else f"/p/{i}.jpg", f"h{i}") for i in range(30)], "position int, sticker_id string, md5 string, source string, sha256 string")
    plan, counts = stores.import_pack(items, spark.createDataFrame([("h0",)], "sha256 string"), "/out")
    assert tuple(counts.first()) == (14, 0, 1, 15, 15, True)
    assert plan.filter("position = 2").first()["destination"] == "/out/qq_favorite_0002_m2.jpg"
    assert [r["position"] for r in catalog.missing_examples(items, "position").collect()] == list(range(1, 21, 2))
    assert not stores.import_pack(items.filter("source is null"), spark.createDataFrame([], "sha256 string"), "/out")[1].first()["ok"]


def test_uploads(spark):
    df = spark.createDataFrame([("x.PNG", bytearray(b"1")), ("x.txt", bytearray(b"1"))], "path string, content binary")
    good, bad = stores.uploads(df, F.lit(datetime(2020, 1, 1)).cast("timestamp")).orderBy("path").collect()
    assert good["name"] == f"1577836800_{good['sha256'][:16]}.png" and good["problem"] is None and (bad["name"], bad["problem"]) == (None, "unsupported type")


def _answer(path):
    if path.startswith("bad"):
        raise captions.RequestError("busy", 503, "r", "b", {"x": "y"}) if path == "bad1" else OSError("gone")
    return json.dumps({"action": path})


@pytest.mark.parametrize("paths", [["a", "b"], ["bad1", "bad2"], ["a", "bad1", "b", "bad2"], []])
def test_captions_of_good_and_failed_calls(spark, paths):
    df = spark.createDataFrame([(p, "visual_0000", 2, "animal") for p in paths], "path string, visual_cluster_id string, cluster_size int, asset_type string").coalesce(1)
    made = captions.describe(df, _answer, 1, lambda s: None)
    got = {r["path"]: r for r in made.collect()}
    assert {p: (r["ok"], r["attempts"], r["status"], r["headers"]) for p, r in got.items()} == {p: (True, 1, None, None) if not p.startswith("bad") else (False, 2, 503, {"x": "y"}) if p == "bad1" else (False, 2, None, None) for p in paths}
    labels = made.select("path", captions.status_label(F.col("ok")).alias("status"))
    assert tuple(captions.run_counters(labels, "status", ["ok", "failed"]).first()) == (sum(not p.startswith("bad") for p in paths), sum(p.startswith("bad") for p in paths), len(paths))
    from loomary.functions.text import parse_caption

    tagged = {r["path"]: r for r in captions.caption_representatives(df, _answer, "qwen", parse_caption, retries=0).collect()}
    for p in paths:
        assert tuple(tagged[p]["cluster"]) == ("visual_0000", "2", "animal")
        assert (tagged[p]["caption"]["action"] if not p.startswith("bad") else tagged[p]["caption"]) == (None if p.startswith("bad") else p)


def test_requests(spark):
    df = spark.createDataFrame([("data:x",)], "image string")
    body = json.loads(df.select(captions.request_body("m\"1", "s", "p\n", F.col("image"), json_mode=True)).first()[0])
    assert body["messages"][1]["content"][1] == {"type": "image_url", "image_url": {"url": "data:x", "detail": "low"}}
    assert (body["model"], body["response_format"], body["temperature"]) == ('m"1', {"type": "json_object"}, 0.1)


def test_sources_that_are_absent(spark, tmp_path):
    assert files.pack_images(spark, str(tmp_path)).count() == 0
    assert files.vectors_or_none(spark, str(tmp_path / "v")) is None and files.indexed_paths(spark, str(tmp_path / "v")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.vectors(spark, str(tmp_path / "v"))
    with pytest.raises(FileNotFoundError):
        files.features(spark, str(tmp_path / "v"))


def test_keyed_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("path,visual_cluster_id\na,1\n,2\nb,\na,3\n")
    assert {r["path"]: r["visual_cluster_id"] for r in files.csv_by_path(spark, str(tmp_path / "c.csv"), ["path", "visual_cluster_id"]).collect()} == {"a": "3", "b": None}
    df = spark.createDataFrame([("a", "visual_0000"), ("", "visual_0001"), ("b", "")], "path string, visual_cluster_id string")
    sinks.cluster_csv(df, str(tmp_path / "t"), "clip")
    assert [(r["path"], r["encoder"], r["width"]) for r in files.cluster_rows(spark, str(tmp_path / "t")).collect()] == [("a", "clip", None)]
    assert files.cluster_rows(spark, str(tmp_path / "t")).columns == CLUSTER_COLUMNS
    lines = [{"path": "a", "ok": True, "caption": {"action": " run "}}, {"path": "", "ok": True}, {"path": "b", "ok": False}, {"path": "a", "ok": True, "caption": None}]
    (tmp_path / "x.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    got = files.captions(spark, str(tmp_path / "x.jsonl"), CAPTION_RECORD, ["action", "notes"]).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [("a", 0, "run", "NONE", "run"), ("a", 6, "NONE", "NONE", "")]


def test_requests_are_checked():
    from loomary.operators import clusters

    vectors.check_request("a", 100, "mean")
    for bad in (("", 1, "max"), ("a", 0, "max"), ("a", 101, "max"), ("a", 1, "best")):
        with pytest.raises(ValueError):
            vectors.check_request(*bad)
    assert clusters.split_kinds(["a, b", "b", ",c"]) == ["a", "b", "c"] and clusters.split_kinds([]) == []


def test_an_index_is_rewritten_from_itself(spark, tmp_path):
    own = vectors.encoded(spark.createDataFrame([("p", 0, "x", "y"), ("q", 1, "z", "")], "path string, ordinal long, a string, b string"), ["a", "b"], vectors.hashing_encoder(8))
    sinks.vector_table(own, f"{tmp_path}/v")
    sinks.vector_table(vectors.remove_paths(files.vectors(spark, f"{tmp_path}/v"), own.filter("path = 'p'").select("path"))[0], f"{tmp_path}/v")
    assert sorted((r["path"], r["field"], r["valid"]) for r in files.vectors(spark, f"{tmp_path}/v").collect()) == [("q", "a", True), ("q", "b", False)]


def test_sync_of_an_index(spark):
    encode = lambda df: vectors.encoded(df, ["a"], vectors.hashing_encoder(8))
    own = spark.createDataFrame([("p", 0, "x"), ("q", 1, "y"), ("r", 2, "z")], "path string, ordinal long, a string")
    index = encode(own.filter("path <> 'r'"))
    images = spark.createDataFrame([("p",), ("r",)], "path string")
    after, counts = sync_index(images, own, index, encode)
    assert tuple(counts.first()) == (1, 1) and sorted(r["path"] for r in after.collect()) == ["p", "r"]
    again = index_image("p", own, after, lambda p: spark.createDataFrame([(p, 0, "new")], "path string, ordinal long, a string"), encode, force=True)
    assert {r["path"]: r["text"] for r in again.collect()} == {"p": "new", "r": "z"}
    kept = index_image("p", own, after, None, encode)
    assert {r["path"]: r["text"] for r in kept.collect()} == {"p": "x", "r": "z"}
