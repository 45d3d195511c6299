"""Many queries at once and searches that read few cells, beside plain searches; moments; the one-exchange cascade."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomary.operators import bulk, catalog, clusters, stores, vectors


def test_many_queries_equal_single_ones(spark, monkeypatch):
    dice = np.random.default_rng(1)
    x = np.round(dice.normal(size=(300, 6)), 1)
    x[10:20] = x[5]
    df = spark.createDataFrame([(f"v{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("null", None), ("short", [9.0])], "key string, v array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 300, 7)], "q long, v array<double>")
    own = np.concatenate([x, [[9.0, 0, 0, 0, 0, 0]]])
    names = [*(f"v{i:03d}" for i in range(300)), "short"]
    want = set()
    for i in range(0, 300, 7):
        s = np.round(own @ x[i], 6)
        for rank, j in enumerate(sorted(range(301), key=lambda j: (-s[j], names[j]))[:12], 1):
            want.add((i, rank, names[j], float(s[j])))
    for limit in (1 << 25, 48 * 5):  # one pass, and passes of five queries
        monkeypatch.setattr(bulk, "QUERY_BYTES", limit)
        assert {tuple(r) for r in bulk.search_many(asked, df, 12, "key", "v", "q", 6).collect()} == want
    assert bulk.search_many(asked.limit(0), df, 3, "key", "v", "q").count() == 0 and bulk.search_many(asked, df.limit(0), 3, "key", "v", "q").count() == 0
    assert bulk.search_many(asked, df, 1000, "key", "v", "q").filter("q = 0").count() == 301


def test_best_is_mergeable():
    dice = np.random.default_rng(2)
    scores = np.round(dice.normal(size=(500, 7)), 1)
    got = []
    for order in (np.arange(500), dice.permutation(500)):
        best = bulk.Best(7, 9)
        for part in np.array_split(order, 13):
            best.add(scores[part], part.astype(object))
        best.trim()
        got.append(sorted(zip(best.query.tolist(), best.score.tolist(), best.id.tolist(), strict=True)))
    assert got[0] == got[1] and len(got[0]) == 63


def test_a_task_takes_a_part_of_the_queries_at_once():
    """Scores come by parts of the queries, unrounded."""
    x = np.random.default_rng(4).normal(size=(3000, 5))
    best = bulk.Best(1500, 3, 6)
    for at in range(0, 3000, 700):
        for q in range(0, 1500, 400):
            best.add(x[at : at + 700] @ x[q : min(q + 400, 1500)].T, np.arange(at, min(at + 700, 3000)).astype(object), q)
    best.trim()
    s = np.round(x @ x[:1500].T, 6)
    want = {(q, int(i), s[i, q]) for q in range(1500) for i in np.lexsort((np.arange(3000), -s[:, q]))[:3]}
    assert set(zip(best.query.tolist(), best.id.tolist(), best.score.tolist(), strict=True)) == want


@pytest.mark.parametrize("mode", ["max", "mean", "sum"])
def test_cells_give_the_same_and_read_less(spark, tmp_path, mode):
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(12, 8)) * 4
    rows = []
    for i in range(360):
        for k, f in enumerate(("a", "b")):
            rows.append((f"p{i}", i, f, k, "t", (i + k) % 5 != 0 and i % 40 != 7, [float(v) for v in centres[i % 12] + 0.2 * dice.normal(size=8)]))
    index = spark.createDataFrame(rows, "path string, ordinal long, field string, position int, text string, valid boolean, vector array<float>")
    bulk.write_cells(index, str(tmp_path / "i"), 12)
    for asked in (centres[0], -centres[3], centres[1] + centres[2], np.zeros(8)):
        encode = lambda texts, asked=asked: np.array([asked], np.float32)
        for fields, top in ((None, 7), (["b"], 25), (None, 400)):
            got, cells = bulk.search_cells(spark, str(tmp_path / "i"), "q", encode, fields, top, mode)
            want = vectors.search(index, "q", encode, fields, top, mode, ["a", "b"])
            plain = lambda df: [(r["path"], round(r["score"], 6), r["best_field"]) for r in df.collect()]
            assert plain(got) == plain(want)
            if top == 7 and asked.any():
                assert len(cells) <= 6  # of thirteen
    with pytest.raises(FileNotFoundError):
        bulk.search_cells(spark, str(tmp_path / "none"), "q", encode)


def test_moments_merge_in_any_order(spark):
    dice = np.random.default_rng(4)
    x = dice.normal(size=(400, 3)) * [1, 1000, 1e-3] + [5, -1e6, 0]
    parts = [clusters._moments_of(p) for p in np.array_split(x, 9)]
    states = []
    for order in (range(9), reversed(range(9)), [4, 1, 8, 0, 2, 7, 3, 6, 5]):
        total = None
        for k in order:
            total = parts[k] if total is None else clusters.merged_moments(total, parts[k])
        states.append(np.stack(total))
    assert np.allclose(states[0], states[1], rtol=1e-9) and np.allclose(states[0], states[2], rtol=1e-9)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(900, None, 1.0, float("nan"))]
    n, mean, deviation = clusters.moments(spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(6), ["a", "b", "c"])
    assert n.tolist() == [400, 401, 400] and np.allclose(mean[[0, 2]], x.mean(axis=0)[[0, 2]]) and np.allclose(deviation[[0, 2]], x.std(axis=0)[[0, 2]])
    empty = clusters.standardise(spark.createDataFrame([], "a double, b int"), ["a", "b"])
    assert empty.count() == 0 and empty.columns == ["a", "b"]


def test_cascade_takes_the_first_way(spark):
    files = spark.createDataFrame([("d0/A.png", 0, True, True), ("d1/a.PNG", 1, False, False), ("d1/code7.gif", 1, False, True), ("d2/b.png", 2, True, False)], "file string, place long, primary boolean, direct boolean")
    items = spark.createDataFrame([(1, "d0/A.png", "code7", "x"), (2, "z/A.png", "", "x"), (3, "z/a.pNg", "code7", "x"), (4, "none", "CODE7", "x"), (5, None, None, None), (5, None, None, None), (6, "", "zz", "x"), (7, "d1/code7.gif", "", "x")], "id long, path string, code string, n string")
    out = catalog.resolve(items, "id", F.col("path"), F.col("code"), files)
    assert out.columns == ["id", "path", "code", "n", "source", "found_by"]
    got = sorted(((r["id"], r["source"], r["found_by"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "d0/A.png", "by_path"), (2, "d0/A.png", "by_own"), (3, "d0/A.png", "by_name"), (4, "d1/code7.gif", "by_code"), (5, None, None), (5, None, None), (6, None, None), (7, "d1/code7.gif", "by_path")], key=str)


def test_common_files_are_no_window(spark):
    files = spark.createDataFrame([(i, "same" if i % 3 else f"h{i}") for i in range(60)] + [(100, None), (101, None)], "n long, sha256 string")
    plan = stores.import_plan(files, spark.createDataFrame([("h9",)], "sha256 string"), "sha256", "n")
    got = {r["n"]: r["action"] for r in plan.collect()}
    assert all(got[i] == ("imported" if i == 1 or (i % 3 == 0 and i != 9) else "skipped_duplicate") for i in range(60)) and (got[100], got[101]) == ("imported", "skipped_duplicate")
    assert "Window" not in plan._jdf.queryExecution().toString()
