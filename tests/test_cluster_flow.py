"""Images with consecutive hashes through the whole flow: one near-duplicate group, and no list of pairs."""

import random
from math import comb

import pytest

from loomary.operators import clusters
from loomary.plans import pipeline, scale


def _no_pairs(*_):
    raise AssertionError("a list of pairs")


@pytest.fixture
def made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "code_pairs", _no_pairs)
    return pipeline.run_pipeline(spark.range(200).withColumnRenamed("id", "vec_id"), f"file://{tmp_path}/flow", scale._modelled, "clip")


def test_table_of_consecutive_hashes(made):
    rows = made[0].collect()
    assert len(rows) == 180 and {(r["near_duplicate_group"], r["duplicate_group_size"]) for r in rows} == {("dup_0000", "180")}


def test_counts_of_consecutive_hashes(made):
    assert tuple(made[1].first()) == (200, 180, 7, 7, 1)


@pytest.fixture
def tables(monkeypatch):
    """Rows of the tables written, by label."""
    found, plain = {}, clusters.written

    def counted(df, label):
        out = plain(df, label)
        found.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(clusters, "written", counted)
    return found


def test_consecutive_hashes_take_one_link_a_code_and_task(spark, tables, tmp_path):
    table, _ = pipeline.run_pipeline(spark.range(2000).withColumnRenamed("id", "vec_id"), f"file://{tmp_path}/flow", scale._modelled, "clip")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "keys" not in tables and sum(tables["links"]) < 1800 * tasks and table.count() == 1800


def test_counts_need_no_table_of_keys(spark, tables, tmp_path):
    _, counts = pipeline.run_pipeline(spark.range(500).withColumnRenamed("id", "vec_id"), f"file://{tmp_path}/flow", scale._modelled, "clip")
    assert tuple(counts.first()) == (500, 450, 7, 7, 1) and "keys" not in tables


def test_counts_deal_consecutive_hashes_to_few_keys(spark, tables, tmp_path, monkeypatch):
    """A code has two keys of lines, not 35 of bands, and its components take no rounds."""
    dealt, plain = [], clusters._keys
    monkeypatch.setattr(clusters, "_keys", lambda c, edges, equal: (dealt.append(comb(len(edges) - 1, equal)), plain(c, edges, equal))[1])
    _, counts = pipeline.run_pipeline(spark.range(3000).withColumnRenamed("id", "vec_id"), f"file://{tmp_path}/flow", scale._modelled, "clip")
    assert tuple(counts.first()) == (3000, 2700, 7, 7, 1) and dealt == [2] and "labels" not in tables


def _roots(codes):
    """Least code that each reaches within 4 bits, by all pairs."""
    root = {x: x for x in codes}
    for j, b in enumerate(codes):
        for a in codes[:j]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {x: low if v == high else v for x, v in root.items()}
    return root


@pytest.mark.parametrize("crowd", [4096, 20])
@pytest.mark.parametrize("kind", ["one", "apart", "halves", "bridge"])
def test_codes_linked_along_lines_equal_all_pairs(spark, monkeypatch, kind, crowd):
    """Dense codes: one group, codes apart from it and near each other, two groups alike, and two that one code joins."""
    dice, far = random.Random(5), 511 << 40
    lone = [dice.getrandbits(63) for _ in range(30)]
    near = [x ^ 1 << dice.randrange(63) ^ 1 << dice.randrange(63) for x in lone[:15]]
    more = {"one": [], "apart": [*lone, *near, -1, -2], "halves": [x | far for x in range(300)], "bridge": [*(x | far for x in range(60)), 5 | 15 << 40, 6 | 255 << 40]}[kind]
    codes = sorted({*range(300), *more})
    monkeypatch.setattr(clusters, "DENSE", 2.0**60)
    got = clusters.code_roots(spark.createDataFrame([(x,) for x in codes], "c long"), 4, crowd=crowd)
    assert {x["node"]: x["root"] for x in got.collect()} == _roots(codes)


def test_hashes_with_the_highest_bit_are_unsigned(spark):
    """-1 and -2 ** 44 differ from 2 ** 44 - 1 in 20 bits and all 64; -2 ** 63 and 1 differ in two."""
    codes = [-(2**63), 1, 2**44 - 1, -1, -(2**44), *(2**62 + (k << 20) for k in range(0, 90, 9))]
    got = clusters.code_roots(spark.createDataFrame([(x,) for x in codes], "c long"), 4)
    assert {x["node"]: x["root"] for x in got.collect()} == _roots(sorted(codes))


@pytest.mark.parametrize("settled", [0, 1 << 19])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_by_rounds_and_in_a_task(spark, monkeypatch, settled, kind):
    dice = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(dice.randrange(90), dice.randrange(90)) for _ in range(40)] + [(7, 7)]
    root = {k: k for k in range(200)}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    monkeypatch.setattr(clusters, "SETTLED", settled)
    name = (lambda k: k) if kind == "long" else "é{:03d}".format
    links = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
    got = clusters.components(links, spark.createDataFrame([(name(k),) for k in range(200)], f"node {kind}"))
    assert {x["node"]: x["root"] for x in got.collect()} == {name(k): name(v) for k, v in root.items()}


@pytest.mark.parametrize("crowd", [4096, 20, 2])
def test_code_roots_equal_all_pairs(spark, crowd):
    """Chains of near codes, codes far from all others and consecutive ones; keys that a task links, and crowded ones."""
    r = random.Random(3)
    codes = set(range(0, 1500, 5))
    for _ in range(60):
        x = r.getrandbits(64) - (1 << 63)
        codes.add(x)
        for _ in range(r.randint(0, 3)):
            for k in r.sample(range(63), r.randint(1, 6)):
                x ^= 1 << k
            codes.add(x)
    codes = sorted(codes)
    root = {x: x for x in codes}
    for j, b in enumerate(codes):
        for a in codes[:j]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {x: low if v == high else v for x, v in root.items()}
    df = spark.createDataFrame([(x,) for x in codes], "c long")
    assert {x["node"]: x["root"] for x in clusters.code_roots(df, 4, crowd=crowd).collect()} == root
    assert clusters.code_roots(df.limit(0), 4, crowd=crowd).count() == 0


def test_few_linked_clusters_go_on_by_rounds(spark, monkeypatch):
    """A chain in which one pair merges a round: nine clusters are left in the fourth one, with room for eight in a task."""

    def no_components(*_):
        raise AssertionError("components")

    monkeypatch.setattr(clusters, "components", no_components)
    df = spark.createDataFrame([(k, [float(3**k)]) for k in range(12)], "id long, v array<double>")
    got = clusters.agglomerate(df, "id", "v", 1e6, "ward", fit=1).collect()
    assert len(got) == 12 and {(r["root"], r["cluster_size"]) for r in got} == {(0, 12)}
