"""Stores with a commit log: order, deletes, rewrites, compaction, writers side by side."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomary.sources import files, log, sinks

SCHEMA = "path string, v long"


def _store(spark, tmp_path, form="parquet"):
    return log.Store(spark, str(tmp_path / "store"), spark.createDataFrame([], SCHEMA).schema, form=form)


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _read(store, version=None):
    return [(r["path"], r["v"]) for r in store.rows(version).orderBy("commit", "position").collect()]


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_order_deletes_and_versions(spark, tmp_path, form):
    store = _store(spark, tmp_path, form)
    assert store.version() == 0 and _read(store) == [] and store.compact() is None and store.append(_rows(spark)) is None
    want = []
    for k in range(6):
        rows = [("a", k), (None, k), (f"b{k}", k)]
        assert store.append(_rows(spark, *rows)) == k + 1
        want += rows
    assert store.append(_rows(spark, ("x", 1)), dry_run=True) is None and _read(store) == want
    assert {r["path"]: r["v"] for r in store.last().collect()} == {"a": 5, None: 5, **{f"b{k}": k for k in range(6)}}
    assert {r["path"]: r["v"] for r in store.last(where=F.col("v") < 3).collect()}["a"] == 2
    store.delete(_rows(spark, ("a", 0), ("none", 0), (None, 0)))
    store.append(_rows(spark, ("a", 9)))
    left = [r for r in want if r[0] not in ("a", None)] + [("a", 9)]
    assert _read(store) == left and _read(store, 6) == want
    before = {tuple(r) for r in store.rows().collect()}
    assert store.compact(2) == 9 and {tuple(r) for r in store.rows().collect()} == before
    store.append(_rows(spark, ("z", 1)))
    store.delete(_rows(spark, ("b0", 0)))
    store.compact()
    assert store.vacuum() == 11 and _read(store) == [r for r in [*left, ("z", 1)] if r[0] != "b0"]
    assert store.append(_rows(spark, ("last", 1))) == 13 and _read(store)[-1] == ("last", 1)


def test_rewrite_meets_other_writers(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(_rows(spark, ("a", 1)))
    calls = []

    def change(rows):
        calls.append(1)
        if len(calls) == 1:
            store.append(_rows(spark, ("b", 2)))  # another writer, in between
        return rows.withColumn("v", F.col("v") * 10).orderBy("v")

    assert store.rewrite(change) == 3 and len(calls) == 2 and _read(store) == [("a", 10), ("b", 20)]
    with pytest.raises(log.Conflict):
        store.rewrite(lambda rows: (store.append(_rows(spark, ("c", 3))), rows)[1], tries=2)


def test_compaction_beside_a_rewrite(spark, tmp_path):
    """A compaction that read before a rewrite and commits after it brings nothing back."""
    store = _store(spark, tmp_path)
    store.append(_rows(spark, ("a", 1)))
    folder = store._write(store.rows(1))
    store.rewrite(lambda rows: rows.withColumn("v", F.lit(5)))
    store._commit("compact", folder, 1)
    assert _read(store) == [("a", 5)]


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    store = _store(spark, tmp_path)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: store.append(_rows(spark, (f"p{k}", k), (f"p{k}", k + 100))), range(12)))
    assert sorted(numbers) == list(range(1, 13))
    got = _read(store)
    assert sorted(got) == sorted((f"p{k}", k + x) for k in range(12) for x in (0, 100))
    assert all(got.index((f"p{k}", k)) + 1 == got.index((f"p{k}", k + 100)) for k in range(12))


@pytest.mark.parametrize("link", [True, False])
def test_put_if_absent(spark, tmp_path, link):
    path = f"{tmp_path}/log/1"
    with ThreadPoolExecutor(4 if link else 1) as pool:
        won = list(pool.map(lambda k: log.put_if_absent(spark, path, str(k), link), range(8)))
    assert sum(won) == 1 and open(path).read() == str(won.index(True)) and [p.name for p in (tmp_path / "log").iterdir() if p.name[0] != "."] == ["1"]


def test_appended_lines_come_back_in_order(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    for k in range(6):
        sinks.append_jsonl(_rows(spark, ("a", k)), path)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert [r["v"] for r in files.jsonl(spark, path, schema).collect()] == list(range(6))
    got = files.strict_jsonl(spark, path, schema)
    assert [(r["v"], r["ordinal"]) for r in got.orderBy("ordinal").collect()] == [(k, k) for k in range(6)]


def test_line_numbers_over_splits(spark, tmp_path):
    """Three files, one of many splits, blank lines and line ends of two kinds: as one reader of whole files has them."""
    folder = tmp_path / "lines"
    folder.mkdir()
    texts = ["\n".join("" if i % 17 == 5 else f'{{"path": "p{i}", "v": {i}}}' for i in range(4000)), '{"v": 1}\r\n\r\n{"v": 2}\r\n', '{"path": "é"}']
    for k, text in enumerate(texts):
        (folder / f"{'cab'[k]}.jsonl").write_bytes(text.encode())
    want, ordinal = [], 0
    for k in (1, 2, 0):
        lines = texts[k].removesuffix("\n").split("\n")
        for n, line in enumerate(lines, 1):
            want.append(("cab"[k], n, ordinal, line.rstrip("\r")))
            ordinal += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = files.numbered_lines(spark, str(folder))
        assert got.select("file").distinct().count() == 3 and spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        assert [(r["file"].rsplit("/", 1)[1][0], *r[1:]) for r in got.orderBy("ordinal").collect()] == want
        rows = files.strict_jsonl(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)
        assert rows.count() == sum(bool(x[3].strip()) for x in want) and rows.select("ordinal").distinct().count() == rows.count()
        (folder / "a.jsonl").write_text(texts[1] + "\n{broken\n")
        with pytest.raises(ValueError, match=r"a\.jsonl:5: not JSON"):
            files.strict_jsonl(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_keyed_csv_over_files(spark, tmp_path):
    for name, text in (("b", "path,v\na,3\n" + "x,0\n" * 2000), ("a", "path,v\na,1\nb,2\n"), ("c", "path,v\nb,\"4\n5\"\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r["path"]: r["v"] for r in files.csv_by_path(spark, str(tmp_path), ["path", "v"]).collect()}
    assert got == {"a": "3", "b": "4\n5", "x": "0"}
