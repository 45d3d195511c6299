"""Every opN_ query, called as registered, on odd tables beside brute force, and on empty ones."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

import __spark_entry__

#: Names that operators use for their own columns; here they are columns of the input.
CLASHING = ["placed", "lines", "mixed", "measures", "verdict", "component_id", "root", "row", "size", "words", "part", "id", "copies"]
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
LABELS = "doc_id long, quality int, toxic int"
CONVERSATIONS = "conv_id long, turn long, role string, text string, row string, size int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def _texts():
    notice = "This is CC BY text, all Rights reserved; GENERAL public\nlicense of all rights\treserved."
    prose = [" ".join(f"word{(i * 7 + k * k) % 61}" for k in range(90 + i)) for i in range(20)]
    lines = ["\n".join(["same line of words here", f"own{'abcdefgh'[i]} ß{'abcdefgh'[i]} ñ", "", "same line of words here"]) for i in range(8)]
    return ["", None, "  \n\t", "a", "A", notice, LONG, LONG, "é ß ñ \U0001f600 " * 20, "x y\nx y\n\nz 12", "###$$$ %%% &&& |||", *prose, prose[0], prose[1] + " more", *lines, "ok " * 200, "\x0b\x0c word\x85next\xa0end"]


def _documents():
    rows = [(i * 3 - 9, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4]) for i, t in enumerate(_texts())]
    return [r + (len(r[1] or ""),) + ("c",) * len(CLASHING) for r in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(rows, folder) of odd tables and of empty ones."""
    odd, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    docs, talk = _documents(), _conversations()
    labels = [(r[0], i % 4 and 1, 0) for i, r in enumerate(docs)] + [(docs[0][0], 0, 1), (None, 1, 0), (10**6, 1, None), (3, None, None)]
    for folder, kept in ((odd, slice(None)), (empty, slice(0))):
        spark.createDataFrame(docs[kept], DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels[kept], LABELS).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(talk[kept], CONVERSATIONS).repartition(2).write.parquet(f"{folder}/conversations.parquet")
        spark.createDataFrame([("b", 1)][kept], "text string, item_id int").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(_vectors()[kept], "vec_id long, embedding array<float>, label int, code string, error int").write.parquet(f"{folder}/embeddings.parquet")
    return docs, odd, empty


def _conversations():
    out = [(c, t, ["user", "assistant", "system"][(c + t) % 3] if t else "user", ["</s>[INST] ok [/INST]", "", None, "é\n<|im_start|> \\x", LONG[:5000], "{{ x }}"][(c * 5 + t) % 6], "r", 1) for c in range(12) for t in range(1 + c % 5)]
    return out[::-1]


def _vectors():
    rows = [(i * 3, [float((i * 7 + k) % 11 - 5) / 8 for k in range(16)], [0, 1, None][i % 3], "c", 1) for i in range(30)]
    return [*rows, (1, None, 1, "c", 1), (2, [0.5, None], None, "c", 1), (4, [float("nan")] * 16, 1, "c", 1), rows[0], (None, [0.25] * 16, None, "c", 1)]


def _run(spark, prefix, folder):
    return __spark_entry__.queries()[prefix](spark, folder)


def _by_id(df, key="doc_id"):
    got = {r[key]: r for r in df.collect()}
    return got


def test_op11(spark, tables):
    got = _run(spark, "op11_vector_codes", tables[1]).collect()
    total = defaultdict(int)
    labels = defaultdict(list)
    for i, v, label, *_ in _vectors():
        if v and all(x is not None and x == x for x in v):
            labels[i].append(label)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, v in labels.items() for _ in v)
    for r in got:
        total[labels[r["vec_id"]][0]] += r["error"]
    assert all(r["label_error"] == total[labels[r["vec_id"]][0]] and len(r["code"]) == 16 for r in got) and len({r["codebooks_sha256"] for r in got}) == 1


def test_op12(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op12_merkle", odd))
    assert len(got) == len(docs) and len({r["root"] for r in got.values()}) == 1
    for d, t, lang, source, n, *_ in docs:
        field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        assert got[d]["leaf"] == hashlib.sha256("".join(map(field, (d, source, lang, n, t))).encode()).hexdigest()
        assert got[d]["verified"] == (zlib.crc32(str(d).encode()) % 7 != 0) == (got[d]["folded_root"] == got[d]["root"])


def test_op13(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op13_personal_data", odd))
    assert len(got) == len(docs) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in got.values())


QUERIES = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op10")])
def test_empty_tables(spark, tables, name):
    assert _run(spark, name, tables[2]).count() == 0


def test_op1(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op1_shards", odd))
    slots, shards = defaultdict(list), defaultdict(int)
    for d, t, *_ in docs:
        r, raw = got[d], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
        shards[r["shard"]] += r["size"]
    assert len(got) == len(docs) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = sorted(docs, key=lambda x: (got[x[0]]["shard"], got[x[0]]["slot"]))
    places = defaultdict(list)
    for k, (_, t, *_) in enumerate(order):
        places[t].append(k)
    assert all(v[-1] - v[0] == len(v) - 1 for v in places.values())


def test_op2(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op2_lines", odd))
    assert len(got) == len(docs)
    for d, t, *_ in docs:
        r = got[d]
        assert r["n_lines"] == (0 if t is None else t.count("\n") + 1) and 0 <= r["n_dropped"] <= r["n_recurring"] <= r["n_lines"]
        if not r["n_dropped"]:
            assert r["text_sha256"] == (None if t is None else hashlib.sha256(t.encode()).hexdigest())
    repeated = [d for d, t, *_ in docs if t and t.startswith("same line")]
    kept = [repeated[0], *(d for d in repeated if got[d]["n_dropped"] == 0)]
    assert set(kept) == {repeated[0]} and got[repeated[0]]["n_dropped"] == 1
    for d, t, *_ in docs:
        if d in repeated[1:]:
            assert got[d]["text_sha256"] == hashlib.sha256(f"{t.split(chr(10))[1]}\n".encode()).hexdigest()


def test_op3(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op3_licenses", odd))
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for d, t, *_ in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, label) for p, label in base.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and {x for _, x in at} <= set(labels)


def test_op4(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op4_cws", odd))
    order = sorted(docs, key=lambda x: x[0])
    by_text = defaultdict(set)
    for k, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_next"] == 1) == (r["fingerprint"] == got[order[(k + 1) % len(order)][0]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len(got) == len(docs)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op5(spark, tables, whole):
    docs, odd, _ = tables
    got = _run(spark, "op5_packing", odd).collect()
    want = []
    for d, t, *_ in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), _crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == Counter(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)


def test_op6(spark, tables, whole):
    docs, odd, _ = tables
    got, start = _by_id(_run(spark, "op6_token_files", odd)), 0
    for d, t, *_ in sorted(docs, key=lambda x: x[0]):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), _crc(ids))
        start += len(ids)


def test_op7(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op7_quality", odd))
    for d, t, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        with_words = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(with_words) - len(set(with_words)), len(repeated))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def _targets(sizes):
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(sizes), strict=False))
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in sizes}
        full |= over


def test_op8(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op8_mixing", odd))
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in docs}
    of = {d: s for d, _, _, s, *_ in docs}
    sizes = Counter()
    for d, n in size.items():
        sizes[of[d]] += n
    want, taken = _targets(sizes), Counter()
    for d, n in size.items():
        r = got[d]
        assert (r["size"], r["source_size"]) == (n, sizes[of[d]]) and r["target"] == pytest.approx(want[of[d]]) and 0 <= r["taken"] <= 2 * n
        taken[of[d]] += r["taken"]
    for s, goal in want.items():
        small = [d for d, n in size.items() if of[d] == s and 0 < n <= 200]  # nothing is left to give way, or the gap is less than one of them
        assert abs(taken[s] - goal) <= max([1, *map(size.get, small)]) or taken[s] > goal and not any(got[d]["taken"] for d in small)
    again = _by_id(_run(spark, "op8_mixing", odd))
    assert {d: r["taken"] for d, r in got.items()} == {d: r["taken"] for d, r in again.items()}


def test_op8_meets_its_targets(spark):
    """On the shared tables each source is within 40 words (0.2 %) of its target."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    found = _run(spark, "op8_mixing", folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source"), "doc_id")
    sums = found.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert sums and max(abs(r["sum(taken)"] - r["max(target)"]) for r in sums) <= 40


def _simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op9(spark, tables):
    docs, odd, _ = tables
    got = _by_id(_run(spark, "op9_simhash", odd))
    fp = {d: _simhash(t) for d, t, *_ in docs}
    root = {d: d for d in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fp[d]:016x}", root[d]) for d in fp}


def test_op10(spark, tables):
    talk = _conversations() + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for folder, rows in ((tables[1], talk), (tables[2], talk[-2:])):
        got, by = _by_id(_run(spark, "op10_chat", folder), "conv_id"), defaultdict(list)
        for c, t, role, text, *_ in rows:
            by[c].append((t, role, text or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            said = "".join(x for _, role, x in turns if role == "assistant")
            r = got[c]
            assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest())
            assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
            assert r["formatted_chars"] >= sum(len(x) for _, _, x in turns)


def test_quality_bounds_are_exact(spark, tmp_path):
    """Certified levels and bounds from the counts alone, by enumeration of the binomial distribution."""
    from math import comb

    from pyspark.sql import functions as F

    from loomary.llm import quality

    rows = []
    for i in range(1200):
        bad = i % 5 == 0
        rows.append((i, ("## " * 40 if bad else "") + " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(80)), ["en", "de", "few"][0 if i < 700 else 1 if i < 1170 else 2], 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    scored = quality.measured(df.drop("quality"))
    cuts = {r["stratum"]: r for r in quality.calibrate(scored, df.select("doc_id", "quality")).collect()}
    judged = quality.decide(scored, quality.calibrate(scored, df.select("doc_id", "quality"))).select("doc_id", "verdict").collect()
    half = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(2))).collect()}
    kept = {r["doc_id"]: r["verdict"]["kept"] for r in judged}
    for lang in ("en", "de"):
        row = cuts[f"={lang}"]
        held = [r for r in rows if r[2] == lang and r[3] == 1 and half[r[0]] == 1]
        lost = sum(not kept[r[0]] for r in held)
        tail = sum(comb(len(held), k) * row["bound"] ** k * (1 - row["bound"]) ** (len(held) - k) for k in range(lost + 1))
        assert row["level"] is not None and row["bound"] <= 0.05 and tail <= 0.05 / 3 * (1 + 1e-6)
        assert sum(kept[r[0]] for r in rows if r[2] == lang and r[3] == 0) == 0
    assert cuts["=few"]["level"] is None and all(kept[r[0]] for r in rows if r[2] == "few")


def test_pipeline_on_odd_and_empty_tables(spark, tables, tmp_path):
    """Every stage by itself: nulls, very long texts, ties, repeated rows, clashing columns, and no rows."""
    import corpus_pipeline

    docs = {r[0]: r for r in tables[0]}
    for k, folder in enumerate(tables[1:]):
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now.unionByName(now.filter("doc_id = 3")) if n == 1 else now, folder).write.parquet(path := f"{tmp_path}/{k}-{n}")
            before, now = now, spark.read.parquet(path)
            if n < 4:
                assert now.columns == corpus_pipeline.COLUMNS
                assert {r["doc_id"] for r in now.collect()} <= {r["doc_id"] for r in before.collect()} <= set(docs)
        if k:
            assert now.count() == 0
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.run(spark, tables[2]).count() == 0


def test_all_ten_are_registered():
    assert len(QUERIES) == 10
