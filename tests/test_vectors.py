import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomary.functions import features, hashing
from loomary.operators import clusters, metric, vectors
from loomary.sources import files, sinks

FIELDS = ["expression", "notes"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [("a", 0, "happy cat", "NONE"), ("b", 1, "sad dog", "happy cat"), ("c", 2, "none", ""), ("a", 3, "happy cat", "x")]
    return vectors.build_index(spark.createDataFrame(rows, "path string, ordinal long, expression string, notes string"), FIELDS, vectors.hashing_encoder()).cache()


def test_search(spark, index, tmp_path):
    encode = vectors.hashing_encoder()
    got = vectors.search(index, "happy cat", encode).collect()
    assert [(r["path"], r["ordinal"]) for r in got[:3]] == [("a", 0), ("b", 1), ("a", 3)] and got[1]["best_field"] == "notes"
    last = next(r for r in got if r["path"] == "c")
    assert (last["score"], last["best_field"], last["field_scores"]) == (-1.0, "", {})
    assert len(vectors.search(index, "x", encode, top=0).collect()) == 1
    assert len(vectors.search(index, "x", encode, top=99).collect()) == 4
    one, both = (vectors.search(index, "sad", encode, f, 9, "sum").orderBy("ordinal").collect() for f in (["notes", "notes"], None))
    for r, s in zip(one, both, strict=True):
        assert set(r["field_scores"]) <= {"notes"} and s["score"] == pytest.approx(sum(s["field_scores"].values()) if s["field_scores"] else -1)
    with pytest.raises(ValueError):
        vectors.search(index, "x", encode, ["no"])
    with pytest.raises(ValueError):
        vectors.search(index, "x", encode, mode="median")
    assert vectors.search(index.limit(0), "x", encode, ["no"]).count() == 0
    sinks.vector_table(index, str(tmp_path / "v"))
    again = files.vectors(spark, str(tmp_path / "v"))
    assert vectors.search(again, "happy cat", encode).first()["path"] == "a"
    with pytest.raises(ValueError):
        index.drop("text").write.parquet(str(tmp_path / "w"))
        files.vectors(spark, str(tmp_path / "w"))


def test_upsert_and_remove(spark, index):
    left, removed = vectors.remove_paths(index, spark.createDataFrame([("a",), ("q",)], "path string"))
    assert removed.first()[0] == 2 and left.select("path").distinct().count() == 2
    more = index.filter("path = 'b'").withColumn("path", F.lit("a"))
    assert vectors.upsert_paths(index, more).filter("path = 'a'").count() == 2


def test_modes_agree_with_numpy(spark):
    x = np.random.default_rng(0).normal(size=(30, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    for mode, f in (("max", max), ("sum", sum), ("mean", lambda v: sum(v) / len(v))):
        score, best, _ = vectors.combined([(c, F.col(c), (F.col("id") + k) % 3 != 0) for k, c in enumerate("abc")], mode)
        for r in df.select("id", score.alias("s"), best.alias("b")).collect():
            valid = {c: x[r["id"], k] for k, c in enumerate("abc") if (r["id"] + k) % 3}
            assert r["s"] == pytest.approx(f(list(valid.values()))) and r["b"] == max(valid, key=valid.get)


def test_hashes(spark):
    pixels = [float(i % 9) for i in range(72)]
    got = spark.range(1).select(hashing.to_hex(hashing.difference_hash(F.lit(pixels))).alias("d"), hashing.to_hex(hashing.average_hash(F.lit([1.0] * 64))).alias("a"), hashing.hamming(hashing.from_hex(F.lit("f" * 16)), F.lit(0).cast("long")).alias("h")).first()
    assert tuple(got) == ("f" * 16, "0" * 16, 64)


def test_banded_pairs_are_brute_force(spark):
    dice = np.random.default_rng(1)
    base = dice.integers(0, 1 << 63, 40, dtype=np.int64)
    codes = [int(c) for c in base] + [int(c) ^ sum(1 << int(b) for b in dice.choice(63, k % 7, replace=False)) for k, c in enumerate(base)] + [int(base[0]), -1, -2]
    df = spark.createDataFrame(list(enumerate(codes)), "key long, code long")
    got = {tuple(r) for r in clusters.hamming_pairs(df, "key", "code", 4).collect()}
    want = {(i, j, d) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (d := ((codes[i] ^ codes[j]) & (2**64 - 1)).bit_count()) <= 4}
    assert got == want


def test_chain_is_one_group(spark):
    df = spark.createDataFrame([(i, (1 << 4 * i) - 1) for i in range(12)] + [(99, -1)], "key long, code long")
    got = {r["key"]: (r["near_duplicate_group"], r["duplicate_group_size"]) for r in clusters.near_duplicate_groups(df, "key", "code").collect()}
    assert {got[i] for i in range(12)} == {("dup_0000", 12)} and got[99] == ("dup_0001", 1)


def _classes(codes, bound):
    """Least code that each reaches, by all pairs."""
    x = np.array(codes).view(np.uint64)
    near, root = np.bitwise_count(x[:, None] ^ x[None]) <= bound, np.array(codes)
    while True:
        now = np.where(near, root[None], np.iinfo(np.int64).max).min(axis=1)
        if (now == root).all():
            return dict(zip(codes, root.tolist(), strict=True))
        root = now


@pytest.mark.parametrize("kind", ["dense", "sparse", "even", "one"])
def test_groups_of_codes_are_those_of_all_pairs(spark, monkeypatch, kind):
    dice = random.Random(3)
    near = [c ^ (1 << dice.randrange(40)) ^ (1 << dice.randrange(40)) for c in range(0, 1 << 62, 1 << 56)]
    codes = {"dense": [3 * i + (i % 7 << 50) for i in range(500)], "sparse": [c ^ m for c in near for m in (0, 15 << 30, 511 << 30)] + [-1, -2], "even": [i for i in range(900) if i.bit_count() % 5 == 0], "one": [7]}[kind]
    codes = sorted(set(codes))
    for stars in (2, 0):  # 0: by the last step alone
        monkeypatch.setattr(clusters, "STARS", stars)
        got = {r["node"]: r["root"] for r in clusters.code_roots(spark.createDataFrame([(c,) for c in codes], "c long"), 4).collect()}
        assert got == _classes(codes, 4)


def test_a_dense_group_makes_no_pairs(spark):
    """Of 4,096 neighbouring codes 3,000,000 pairs are within 4 bits; the links that are written stay in proportion to the codes."""
    codes = spark.range(4096).select(F.col("id").alias("c"))
    made = []
    keep = clusters.written
    try:
        clusters.written = lambda df, label: (made.append((label, out := keep(df, label))), out)[1]
        assert {r["root"] for r in clusters.code_roots(codes, 4).select("root").distinct().collect()} == {0}
    finally:
        clusters.written = keep
    assert all(df.count() <= 35 * 4096 for _, df in made)


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clustered(kind):
    dice = np.random.default_rng(2)
    if kind == "random":
        return np.concatenate([c + 0.15 * dice.normal(size=(12, 5)) for c in dice.normal(size=(4, 5)) * 2])
    if kind == "tied":  # copies, equal distances and zero vectors
        grid = np.array([[i, j, 0] for i in range(4) for j in range(4)], float)
        return np.concatenate([grid, grid[3:8], np.eye(3) * 7, np.eye(3) * 7])
    steps = np.cumsum(1 + 0.01 * np.arange(12))  # each nearest neighbour is the one before: a merge a round
    return np.stack([np.cos(steps / 20), np.sin(steps / 20)], axis=1) * 20


@pytest.mark.parametrize(("method", "threshold", "kind", "fit"), [("average", 0.3, "random", 8), ("ward", 1.5, "tied", 4), ("ward", 4.0, "chain", 7), ("average", 0.2, "tied", 4096)])
def test_rounds_are_whole_clustering(spark, method, threshold, kind, fit):
    """A small fit: rounds of mutual nearest neighbours, then tasks; 4096: one task."""
    x = _clustered(kind)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0]), (1000, None)], "key long, v array<double>")
    rows = clusters.agglomerate(df, "key", "v", threshold, method, fit, 16).collect()
    got = {r["key"]: r["root"] for r in rows}
    whole = clusters.linkage(_unit(x) if method == "average" else x, threshold, method)
    assert 1 < len(set(whole)) < len(x) and len(rows) == len(x)
    assert [[got[i] == got[j] for j in range(len(x))] for i in range(len(x))] == (whole[:, None] == whole[None]).tolist()
    assert all(r["cluster_size"] == sum(v == r["root"] for v in got.values()) and r["root"] == min(k for k, v in got.items() if v == r["root"]) for r in rows)


def _links_of(x, size, threshold, method):
    i, j = np.triu_indices(len(x), 1)
    d = metric.pair_distances(x[i], x[j], size[i], size[j], method)
    return i[d < threshold], j[d < threshold], d[d < threshold]


@pytest.mark.parametrize(("method", "threshold", "kind"), [("average", 0.3, "random"), ("ward", 4.0, "chain"), ("ward", 1.5, "random")])
def test_links_are_enough_for_clusters(method, threshold, kind):
    x = _unit(_clustered(kind)) if method == "average" else _clustered(kind)
    size = np.ones(len(x))
    got, want = clusters.linked(x, size, *_links_of(x, size, threshold, method), threshold, method), clusters.linkage(x, threshold, method)
    assert [np.flatnonzero(got == got[i]).tolist() for i in range(len(x))] == [np.flatnonzero(want == want[i]).tolist() for i in range(len(x))]


@pytest.mark.parametrize(("method", "threshold", "most", "linked"), [("average", 0.3, 128, 1), ("ward", 2.5, 128, 0), ("ward", 2.5, 0, 8)])
def test_rounds_over_links_are_whole_clustering(spark, monkeypatch, method, threshold, most, linked):
    """Neighbours are found once: rounds over links alone (linked 0), with tasks for components; none allowed: by blocks."""
    monkeypatch.setattr(clusters, "LINKS", most)
    monkeypatch.setattr(clusters, "LINKED", linked)
    calls, keep = [], clusters.nearest
    monkeypatch.setattr(clusters, "nearest", lambda *a: (calls.append(1), keep(*a))[1])
    x = _clustered("random")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key long, v array<double>")
    got = {r["key"]: r["root"] for r in clusters.agglomerate(df, "key", "v", threshold, method, 5, 16).collect()}
    whole = clusters.linkage(_unit(x) if method == "average" else x, threshold, method)
    assert [got[i] for i in range(len(x))] == [int(np.flatnonzero(whole == v)[0]) for v in whole]
    assert bool(calls) == (most == 0)


def test_clusters_of_strings_and_of_nothing(spark):
    df = spark.createDataFrame([("é", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])], "key string, v array<float>")
    got = {r["key"]: (r["root"], r["visual_cluster_id"], r["cluster_size"]) for r in clusters.agglomerate(df, "key", "v", 0.1).collect()}
    assert got == {"é": ("b", "visual_0000", 2), "b": ("b", "visual_0000", 2), "c": ("c", "visual_0001", 1)}
    assert clusters.agglomerate(df.limit(0), "key", "v", 0.1).count() == 0


@pytest.mark.parametrize(("shape", "threshold"), [("euclidean", 1.0), ("cosine", 0.02)])
def test_threshold_join_is_that_of_all_pairs(spark, shape, threshold):
    dice = np.random.default_rng(5)
    x = np.concatenate([c + 0.12 * dice.normal(size=(60, 6)) for c in dice.normal(size=(25, 6)) * 9])
    x[7], x[8], x[9] = x[6], 0, 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 6), (9999, None)], "key long, v array<double>").repartition(4)
    pairs, found = metric.near_pairs(df, "key", "v", threshold, shape, 40)
    y = _unit(x) if shape == "cosine" else x
    d = 1 - y @ y.T if shape == "cosine" else np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    got = {(r["a"], r["b"]): r["distance"] for r in pairs.collect()}
    assert set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] < threshold}
    assert all(v == pytest.approx(d[k], abs=1e-9) for k, v in got.items())
    assert found.compared() < 0.1 * len(x) * (len(x) - 1) / 2
    assert metric.near_pairs(df.limit(0), "key", "v", threshold, shape)[0].count() == 0


def test_constant_columns_are_zero(spark):
    got = clusters.standardise(spark.createDataFrame([(1, 5.0), (3, 5.0)], "a int, b double"), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_representatives(spark):
    df = spark.createDataFrame([("a", "0001", "2", "cartoon_character"), ("b", "0002", "5", "real_person"), ("c", "0003", "1", "text_meme")], "path string, visual_cluster_id string, cluster_size string, asset_type string")
    done = spark.createDataFrame([("b",)], "path string")
    names = lambda x: [r["path"] for r in x.collect()]
    assert names(clusters.representatives(df, done, least=2)) == ["a"]
    assert names(clusters.representatives(df, done.limit(0), kinds=["real_person"])) == ["b"]
    assert names(clusters.representatives(df, done, overwrite=True, limit=2)) == ["b", "a"]


def _plain(img: np.ndarray, small: np.ndarray, width: int, height: int) -> list[float]:
    """The 34 features pixel by pixel."""
    n = img.shape[0]
    out = []
    for c in range(3):
        hist = [0] * 8
        for v in img[..., c].ravel():
            hist[min(int(v * 8), 7)] += 1
        out += [h / n**2 for h in hist]
    light = [[0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] for p in row] for row in img]
    satur = [(max(p) - min(p)) / max(p) if max(p) > 1e-6 else 0 for row in img for p in row]
    slope = lambda v, k: v[1] - v[0] if k == 0 else v[-1] - v[-2] if k == n - 1 else (v[k + 1] - v[k - 1]) / 2
    edge = [math.hypot(slope([light[i][x] for i in range(n)], y), slope(light[y], x)) for y in range(n) for x in range(n)]
    for values in (sum(light, []), satur, edge):
        out += [statistics.fmean(values), statistics.pstdev(values)]
    distinct = len({tuple(int(v) // 32 for v in p) for row in small for p in row}) / small.shape[0] ** 2
    return [*out, distinct, min(width / max(height, 1), 5) / 5, math.log1p(width) / 10, math.log1p(height) / 10]


def test_features_pixel_by_pixel():
    dice = np.random.default_rng(4)
    pixels, small = dice.integers(0, 256, (3, 64, 64, 3)) / 255, dice.integers(0, 256, (3, 32, 32, 3)).astype(np.uint8)
    pixels[1] = 0
    sizes = np.array([[32, 16], [900, 100], [5, 0]], float)
    got = features.handcrafted(pixels, small, sizes)
    for k in range(3):
        assert got[k].tolist() == pytest.approx(_plain(pixels[k], small[k], *sizes[k]), abs=1e-9)


def _decode(content):
    if content.startswith(b"bad"):
        raise OSError("not an image")
    red = np.zeros((64, 64, 3))
    red[..., 0] = 1
    ramp = np.arange(72).reshape(8, 9)
    return features.Decoded(red, (red[:32, :32] * 255).astype(np.uint8), 32, 16, ramp[:, :8], ramp)


@pytest.mark.parametrize("contents", [[b"ok"], [b"bad"], [b"ok", b"bad", b"ok"], []])
def test_features_of_good_and_bad_images(spark, contents):
    df = spark.createDataFrame([(f"d/{i}.PNG", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary").coalesce(1)
    made = features.build_features(df, _decode)
    for r in made.collect():
        if contents[int(r["path"][2:-4])] == b"bad":
            assert (r["error"], r["feature"], r["asset_type"], r["width"]) == ("not an image", None, None, None)
        else:
            assert (r["width"], len(r["feature"]), r["dhash"], r["suffix"], r["aspect_ratio"], r["file_name"]) == (32, 34, "f" * 16, ".png", 2.0, r["path"][2:])
            assert r["asset_type"] == "text_or_flat_graphic" and r["ahash"] == "00000000ffffffff" and r["error"] is None
    n = sum(c == b"ok" for c in contents)
    assert tuple(features.build_summary(made).first()) == (len(contents), n, 34 if n else 0)


def test_labels_override_the_type(spark):
    df = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad")), ("c", bytearray(b"ok"))], "path string, content binary")
    labels = spark.createDataFrame([("a", "animal", 0.5), ("b", "animal", 0.5)], "path string, label string, margin double")
    got = {r["path"]: (r["asset_type"], r["asset_confidence"]) for r in features.labelled(features.build_features(df, _decode), labels).collect()}
    assert got == {"a": ("animal", 0.5), "b": (None, None), "c": ("text_or_flat_graphic", 0.45)}


def test_cluster_features(spark):
    """Two groups by colour; near-duplicates by hash; the row with an error stays without clusters."""
    rows = [(f"{i:02d}", None, [float(i % 2), 0.5] + [0.1] * 32, "0" * 15 + str(i % 4)) for i in range(8)] + [("zz", "broken", None, None)]
    made = spark.createDataFrame(rows, "path string, error string, feature array<float>, dhash string")
    for encoder, bound in (("handcrafted", None), ("clip", None)):
        got = clusters.cluster_features(made, encoder, bound)
        by = {r["path"]: r for r in got.collect()}
        assert by["zz"]["visual_cluster_id"] is None and by["zz"]["duplicate_group_size"] is None
        assert {(int(p) % 2, r["visual_cluster_id"], r["cluster_size"], r["near_duplicate_group"], r["duplicate_group_size"]) for p, r in by.items() if p != "zz"} == {(0, "visual_0000", 4, "dup_0000", 8), (1, "visual_0001", 4, "dup_0000", 8)}
        assert tuple(clusters.cluster_counts(got).first()) == (8, 2, 1)
    one = clusters.cluster_features(made.filter("path in ('00', 'zz')")).collect()
    assert {r["path"]: r["visual_cluster_id"] for r in one} == {"00": "visual_0000", "zz": None}
    assert [r["visual_cluster_id"] for r in clusters.cluster_features(made.filter("path = 'zz'")).collect()] == [None]


def test_close_codes_are_all_found(spark):
    dice = random.Random(5)
    codes = {dice.getrandbits(64) - (1 << 63) for _ in range(60)}
    for c in list(codes):
        for k in range(1, 6):
            x = c & ((1 << 64) - 1)
            for bit in dice.sample(range(64), k):
                x ^= 1 << bit
            codes.add(x - (1 << 64) if x >> 63 else x)
    for bound in (0, 4):
        got = {(r[0], r[1], r[2]) for r in clusters.code_pairs(spark.createDataFrame([(c,) for c in codes], "c long"), bound).collect()}
        far = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
        assert got == {(a, b, far(a, b)) for a in codes for b in codes if a < b and far(a, b) <= bound}


def _full_matrix(x, threshold, method):
    """Agglomerative clustering by the whole matrix at each step."""
    d = metric.linkage_distances(x, x, np.ones(len(x)), np.ones(len(x)), method, lambda d: d < 1e9)
    groups = {i: [i] for i in range(len(x))}
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if not d[i, j] < threshold:
            break
        a, b = len(groups[i]), len(groups[j])
        for k in groups:
            if k not in (i, j):
                n = len(groups[k])
                d[i, k] = d[k, i] = (a * d[i, k] + b * d[j, k]) / (a + b) if method == "average" else math.sqrt(max(0, ((a + n) * d[i, k] ** 2 + (b + n) * d[j, k] ** 2 - n * d[i, j] ** 2) / (a + b + n)))
        groups[i] += groups.pop(j)
        d[j, :] = d[:, j] = np.inf
    return {frozenset(v) for v in groups.values()}


@pytest.mark.parametrize(("method", "threshold"), [("average", 0.18), ("ward", 2.4)])
def test_linkage_is_that_of_the_whole_matrix(method, threshold):
    dice = np.random.default_rng(8)
    for n in (0, 1, 2, 60):
        x = np.round(dice.normal(size=(n, 3)), 1)
        x = _unit(x) if method == "average" else x
        label = clusters.linkage(x, threshold, method)
        assert {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label)} == (_full_matrix(x, threshold, method) if n else set())


def test_index_life_cycle(spark):
    encode = vectors.hashing_encoder()
    rows = lambda *x: spark.createDataFrame(list(x), "path string, ordinal long, a string, b string")
    with pytest.raises(ValueError):
        vectors.build_index(rows(), ["a", "b"], encode)
    index = vectors.build_index(rows(("p", 0, "cat", "NONE"), ("q", 1, "dog", "red")), ["a", "b"], encode, "m1")
    assert vectors.index_facts(index) == ("m1", ["a", "b"]) and vectors.active_model(index, "x") == "m1" and vectors.active_model(None, "x") == "x"
    new = vectors.encoded(spark.createDataFrame([("p", 5, "cow", "x", "extra")], "path string, ordinal long, a string, b string, c string"), ["a", "b", "c"], encode, "m2")
    after = vectors.upsert_paths(index, new)
    assert {(r["path"], r["ordinal"], r["field"], r["model"]) for r in after.collect()} == {("q", 1, "a", "m1"), ("q", 1, "b", "m1"), ("p", 2, "a", "m1"), ("p", 2, "b", "m1")}
    best = vectors.search(after, "cow", encode, top=1).first()
    assert (best["path"], best["best_field"], best["fields"]) == ("p", "a", {"a": "cow", "b": "x"})
    assert files.empty_vectors(spark).count() == 0 and vectors.active_model(files.empty_vectors(spark), "x") == "x"
    calls = []
    lazy = vectors.cached_encoder("one", lambda m: calls.append(m) or encode)
    lazy(["a"]), lazy(["b"])
    assert calls == ["one"] and vectors.loaded_models() == ["one"] and vectors.unload_models() == ["one"] and vectors.loaded_models() == []


def test_zero_shot_margin(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "k int, v array<double>")
    assert tuple(vectors.zero_shot(df, "k", "v", [("x", [1.0, 0.0]), ("y", [0.5, 0.0]), ("z", [1.0, 0.0])]).first()) == (1, "x", 1.0, 0.0, {"x": 1.0, "y": 0.5, "z": 1.0})
