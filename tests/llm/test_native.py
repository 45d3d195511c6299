"""Sharding, line dedup, fingerprints and license scans beside brute force, with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomary.llm import cws, histogram, licenses, lines, shards

ODD = "doc_id long, text string, k1 int, `__cell` string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with working names."""
    texts = ["", None, "  \n\t", "a", "All rights reserved.", LONG, "é ß ñ " * 20, "x y\nx y\n\nz 12"] + [f"some words number {i} here and there {i * 7}" for i in range(40)]
    rows = [(i, t, i, "c") for i, t in enumerate(texts)] + [(3, "other", None, None), (3, "a", 3, "c"), (3, "a", 3, "c"), (None, "a", 1, None), (None, None, None, None), (99, LONG, 1, "x")]
    return spark.createDataFrame(rows, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def test_shards_hold_near_equal_bytes(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.xxhash64("id") % 50 + 60).cast("int")).alias("text"))
    got = shards.shard(df, 7).select("doc_id", "text", "placed.*").collect()
    assert len(got) == 4000 and {r["size"] - 16 - len(r["text"].encode()) for r in got} == {0}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 4 * max(r["size"] for r in got)
    assert all(sorted(r["slot"] for r in by[s]) == list(range(len(by[s]))) for s in by)


def test_hot_text_is_divided(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = shards.shard(df, 6).groupBy("placed.shard").agg(F.sum("placed.size").alias("b")).collect()
    assert len(got) == 6 and max(r["b"] for r in got) <= 1.02 * min(r["b"] for r in got)


def test_equal_texts_stand_together(spark, odd):
    got = shards.shard(odd, 2).select("text", "placed.*").orderBy("shard", "slot").collect()
    seen, last = set(), object()
    for r in got:
        if r["text"] != last:
            assert r["text"] not in seen
            seen.add(r["text"])
            last = r["text"]
    assert len(got) == odd.count()


def test_shards_of_odd_and_empty_tables(spark, odd, empty):
    got = shards.shard(odd)
    assert got.columns == [*odd.columns, "placed"]
    a, b = (Counter(tuple(r) for r in x.select("doc_id", "text", "k1").collect()) for x in (got, odd))
    assert a == b
    slots = defaultdict(list)
    for r in got.select("placed.*").collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shards.shard(empty).count() == 0


def test_splitters_are_exact(spark):
    rows = [(i % 5 * 1000, i // 5, i % 7) for i in range(500)] + [(-(1 << 62), 0, 1), ((1 << 62), -9, 4)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, w long")
    found = histogram.find_ranges(df, "k1", "k2", "w", 9, lambda i: 0)
    for s in found.splits:
        below = [w for a, b, w in rows if (a, b) < (s.key1, s.key2)]
        assert (sum(below), len(below)) == (s.below, s.rows_below)
    got = found.assign(df, "k1", "k2", "part").collect()
    assert all(r["part"] == sum((s.key1, s.key2) <= (r["k1"], r["k2"]) for s in found.splits) for r in got)


def _terms(text):
    w = (text or "").strip(" \t\n\x0b\f\r").lower()
    w = re.split("[ \t\n\x0b\f\r]+", w) if w else []
    return Counter(tuple((w + [""] * 5)[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _jaccard(a, b):
    both = set(a) | set(b)
    most = sum(max(a[t], b[t]) for t in both)
    return sum(min(a[t], b[t]) for t in both) / most if most else 1.0


def test_collision_rate_is_generalised_jaccard(spark):
    base = [f"t{i}" for i in range(90)]
    texts = []
    for k in range(60):
        a = [f"{w}x{k}" for w in base]
        texts.append((k, " ".join(a + a[:40]), " ".join(a[: 30 + k] + a[:40] * (1 + k % 3))))
    df = spark.createDataFrame(texts, "k int, a string, b string")
    fp = cws.fingerprints(df, ["k"], ["a", "b"]).withColumn("like", cws.likeness("a", "b")).collect()
    errors = [r["like"] - _jaccard(_terms(texts[r["k"]][1]), _terms(texts[r["k"]][2])) for r in fp]
    assert abs(sum(errors) / len(errors)) < 0.03 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.09


def test_fingerprint_depends_on_the_text_alone(spark, odd):
    df = odd.withColumn("n", F.monotonically_increasing_id()).withColumn("other", F.reverse("text"))
    one = {r["n"]: r["text"] for r in cws.fingerprints(df, ["n"], ["text"]).collect()}
    two = {r["n"]: r["text"] for r in cws.fingerprints(df, ["n"], ["text", "other"]).collect()}
    texts = {r["n"]: r["text"] for r in df.select("n", "text").collect()}
    by_text = {}
    for n, fp in one.items():
        assert len(fp) == 256 and by_text.setdefault(texts[n], fp) == fp and two[n] == fp
    assert {n for n in texts if (texts[n] or "").strip()} == set(one)


def test_next_document_goes_round(spark, odd, empty):
    got = cws.with_next(odd).filter("own").collect()
    order = sorted(((r["doc_id"] if r["doc_id"] is not None else float("-inf")), r["text"] or "") for r in odd.collect())
    after = defaultdict(set)
    for k, (d, t) in enumerate(order):
        after[d].add(order[(k + 1) % len(order)][1])
    assert len(got) == len(order)
    ids = Counter(d for d, _ in order)
    for r in got:
        d = r["id"] if r["id"] is not None else float("-inf")
        if ids[d] == 1 and ids[[x for x, _ in order][([x for x, _ in order].index(d) + 1) % len(order)]] == 1:
            assert r["next"] in after[d]
    assert cws.with_next(empty).count() == 0


def test_line_templates(spark):
    rows = [(i, " ".join(f"{chr(97 + i)}{chr(97 + j)}" for j in range(9)) + f"\nServer {i} answered in {i * 3} ms today\nShared line of boilerplate text") for i in range(5)]
    rows += [(10, rows[0][1]), (11, None), (12, ""), (13, "\n\n"), (None, "Lonely line without any copies")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, leaf string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(df, most=0.9).collect()}
    assert got[0]["text"] == rows[0][1] and got[10]["text"] == rows[0][1].split("\n")[0]
    for i in range(1, 5):
        assert got[i]["text"] == rows[i][1].split("\n")[0] and got[i]["lines"]["n_dropped"] == 2
    assert got[11]["text"] is None and got[12]["text"] == "" and got[13]["text"] == "\n\n" and got[None]["text"].startswith("Lonely")
    whole = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, most=0.3).collect()}
    assert whole[3] == rows[3][1]  # more than the share: a copy, left to a document-level stage
    twice = lines.dedup_lines(spark.createDataFrame([(i, "same line again and again") for i in range(2)], "doc_id long, text string"))
    assert {r["lines"]["n_dropped"] for r in twice.collect()} == {0}  # exact copies count once


def test_lines_of_one_document_count_once(spark):
    own = ["I went to the shop.", "I went to the park.", "I went to the market."]
    rows = [(0, "\n".join([*own, *[f"own words {w} of zero" for w in "abc"]])), (1, "I went to see Ann.\nBut Ann was out of town today"), (2, "I went to see Bob.\nThen Bob left by the next train")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r["text"] for d, r in got.items()} == dict(rows)


def test_long_passage_of_short_documents_goes(spark):
    passage = " ".join(f"shared{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    own = [" ".join(f"own{chr(97 + i)}{chr(97 + j)}" for j in range(20)) for i in range(4)]
    rows = [(i, f"{own[i]}\n{passage}") for i in range(4)] + [(4, passage), (5, f"{own[0]}\n{passage}")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: own[1], 2: own[2], 3: own[3], 4: "", 5: rows[5][1]}  # 5: an exact copy of 0
    line = "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(10)) for i in range(10))
    copies = [(i, f"{line}\nend{chr(97 + i)}") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert got == dict(copies)  # copies of document 0, left to a document-level stage


def test_lines_of_odd_and_empty_tables(spark, odd, empty):
    got = lines.dedup_lines(odd)
    assert got.columns == [*odd.columns, "lines"] and got.count() == odd.count()
    assert lines.dedup_lines(empty).count() == 0


def _licenses(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    return sorted((label, k) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def test_base_phrases_are_brute_force(spark, odd, empty):
    more = spark.createDataFrame([(200, "CC BY cc by, cc-by; General Public License general public license all\nrights reserved ALL RIGHTS RESERVED é", 1, "")], ODD)
    df = odd.unionByName(more)
    found = defaultdict(set)
    for r in licenses.scan(df).filter("base").collect():
        found[r["id"]].add((r["label"], r["start"]))
    for r in df.collect():
        if r["doc_id"] not in (3, None):
            assert sorted(found[r["doc_id"]]) == _licenses(r["text"])
    assert licenses.scan(empty).count() == 0


def test_edited_notice_is_one_span(spark):
    notice = next(t for label, t in licenses.NOTICES if label == "mit" and len(t.split()) > 20).split()
    edited = ["intro"] * 30 + notice[:15] + ["quite"] + notice[15:30] + notice[32:] + ["end"] * 10
    df = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(notice[:10]))], "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert [(r["id"], r["label"], r["start"], r["end"]) for r in got] == [(1, "mit", 30, 30 + len(notice) - 1)] and 0.85 < got[0]["coverage"] < 1


def test_crc_of_contract(spark):
    assert spark.sql("select crc32(cast('aé' as binary))").first()[0] == zlib.crc32("aé".encode())


def test_long_passage_of_two_documents(spark):
    """It goes from the second of two unlike documents and stays in both versions of one."""
    word = lambda k, i: "".join(chr(97 + int(x)) for x in f"{k}{i}")
    passage = " ".join(word("99", i) for i in range(80))
    own = [" ".join(word(k, i) for i in range(120)) for k in range(4)]
    rows = [(1, f"{own[0]}\n{passage}"), (2, f"{passage}\n{own[1]}"), (3, f"{own[2]}\nshort line of mine"), (4, f"{own[2]}\nanother end here")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: own[1], 3: rows[2][1], 4: rows[3][1]}
