"""The template tree beside one written down plainly: leaves, supported places, templates, documents."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomary.llm import lines


def _plain_lines(text):
    for raw in (text or "").split("\n"):
        line = re.sub(r"[\x20\t\x0b\f\r]+", " ", raw).strip(" ")
        if line:
            yield line


def _sure(constants, n):
    return constants == n or constants >= max(0.7 * n, 4)


def _brute(texts, min_docs=3):
    """{line: in two documents only} of all lines whose template recurs."""
    leaves, docs_of = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    plain_of = defaultdict(set)
    for doc, text in enumerate(dict.fromkeys(texts)):
        for line in _plain_lines(text):
            words = tuple("<*>" if re.search("[0-9]", w) else w for w in line.split(" "))
            leaf = (len(words), words[:3])
            leaves[leaf][words].add(doc)
            docs_of[leaf].add(doc)
            plain_of[words].add(line)
    out = {}
    for leaf, own in leaves.items():
        n, need = leaf[0], 2 if leaf[0] > 50 else min_docs
        support = defaultdict(set)
        for words, docs in own.items():
            for k, w in enumerate(words):
                if w != "<*>":
                    support[k, w] |= docs
        named = defaultdict(list)
        for words in own:
            fields = tuple((k, w) for k, w in enumerate(words) if w != "<*>" and len(support[k, w]) >= need)
            if fields and _sure(len(fields), n):
                named[fields].append(words)
        for group in named.values():
            docs = set().union(*(own[w] for w in group))
            if len(docs) >= need:
                for words in group:
                    out |= {p: len(docs) < min_docs for p in plain_of[words]}
    return out


def _texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 3)))
    forms = [[word() for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 12, 55]))] for _ in range(14)]
    out = []
    for _ in range(45):
        own = []
        for _ in range(r.randint(0, 9)):
            line = list(r.choice(forms))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                line[r.randrange(len(line))] = r.choice([word(), str(r.randrange(99)), f"x{r.randrange(9)}"])
            own.append(r.choice([" ", " ", "  ", "\t"]).join(line) + r.choice(["", "", " ", "\r"]))
        out.append(r.choice(["\n", "\n\n"]).join(own))
    return [*out, None, "", out[3], out[3], "ß é ñ ü\nß é ñ ü", "ß é ñ ü", "ß é 1 ü\nx"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recurring_lines_equal_brute_force(spark, seed):
    texts = _texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = lines._lines(df, "text", "doc_id").persist()
    found = lines.recurring(own).select("line", "pair")
    got = {r["plain"]: r["pair"] for r in own.join(found, "line").select("plain", "pair").distinct().collect()}
    assert got == _brute(texts) and got
    counts = {r["doc_id"]: r["lines"]["n_recurring"] for r in lines.dedup_lines(df).collect()}
    known = _brute(texts)
    assert counts == {i: sum(p in known for p in _plain_lines(t)) for i, t in enumerate(texts)}
    first = own.join(found, "line").groupBy("plain").agg(F.min("id").alias("id"))
    assert first.count() == len(known)
    own.unpersist()
