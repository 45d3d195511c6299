"""Near-duplicates by Jaccard similarity beside all pairs."""

import random

import pytest

from loomary.llm import jaccard


def _alike(a, b, similarity):
    return len(a & b) >= similarity * len(a | b) - 1e-9


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_rare_pairs_lose_none(spark, similarity):
    r = random.Random(4)
    common = list(range(40))
    sets = []
    for _ in range(60):
        own = [r.randrange(1000, 10**9) for _ in range(r.randint(0, 12))]
        sets.append(frozenset(r.sample(common, r.randint(1, 40)) + own))
        sets.append(frozenset(r.sample(sorted(sets[-1]), max(1, len(sets[-1]) * 9 // 10)) + own[:1]))
        sets.append(frozenset(own) or frozenset([7]))
    sets = list(dict.fromkeys(sets))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "fp long, s array<long>")
    roots = spark.createDataFrame([(i, i // 7) for i in range(len(sets))], "fp long, root long")
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if i // 7 != j // 7 and _alike(a, b, similarity)}
    got = {(x["a"], x["b"]) for x in jaccard.rare_pairs(df, roots, similarity).collect()}
    assert want <= got and len(want) > 8


def test_shared_passages_make_no_pairs(spark):
    passage = list(range(60))
    df = spark.createDataFrame([(i, passage + [1000 * i + k for k in range(100, 120)]) for i in range(1, 301)], "fp long, s array<long>")
    assert jaccard.rare_pairs(df, df.selectExpr("fp", "fp as root"), 0.8).count() == 0


def _classes(texts):
    sets = [frozenset(jaccard.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i in range(j):
            if (not sets[i] and not b) or (sets[i] and b and _alike(sets[i], b, 0.8)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_dedup_equals_all_pairs(spark):
    """Copies, chains of near copies, texts of little but a common passage; columns named as working ones; nulls and repeats."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(k)] + passage + [word() for _ in range(k)]) for k in (1, 2, 3, 4, 5, 6, 8, 30) for _ in range(12)]
    chain = [word() for _ in range(150)]
    for _ in range(15):
        texts.append(" ".join(chain))
        at = r.randrange(150)
        chain[at : at + 2] = [word(), word()]
    texts += ["", None, "  ", "one", "one", "a b c d e", "a b c d e", texts[0], " ".join(passage), " ".join(passage[:55])]
    rows = [(i, t, 1, 2, "k", "t", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, n int, keys string, tie string, root long").repartition(5)
    got = jaccard.near_dedup(df)
    assert got.columns == df.columns
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(_classes(texts)))
    assert jaccard.near_dedup(df.limit(0)).count() == 0


def test_anchors_link_near_copies_without_bands(spark):
    """Texts without a MinHash band meet by the anchors of their fingerprints; links are decided by exact similarity."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(20):
        words = [word() for _ in range(800)]
        texts += [" ".join(words), " ".join([*words, word()]), " ".join([*words[:-1], word(), word()])]
    sets = [jaccard.shingles(t) for t in texts]
    rows = [(jaccard._node(s), len(s), jaccard.of_hashes(s) - (1 << 64 if jaccard.of_hashes(s) >> 63 else 0), []) for s in sets]
    sketched = spark.createDataFrame(rows, "fp long, n int, sim long, keys array<long>")
    by_fp = spark.createDataFrame([(x[0], t) for x, t in zip(rows, texts, strict=True)], "fp long, text string")
    found = {x["node"]: x["root"] for x in jaccard.roots(sketched, by_fp).collect()}
    of = [found.get(x[0], x[0]) for x in rows]
    alike = [sum(a >> k & 1 != b >> k & 1 for k in range(64)) <= 3 for a, b in ((rows[i][2], rows[i + 1][2]) for i in range(0, 60, 3))]
    assert sum(alike) > 10 and all(of[3 * k] == of[3 * k + 1] for k, near in enumerate(alike) if near)
    assert len({of[i] for i in range(0, 60, 3)}) == 20
