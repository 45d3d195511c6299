"""Packing, token files, quality rules, mixing, near-dedup and chat formatting beside brute force, with odd rows."""

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomary.llm import chat, huffman, mixing, packing, quality, simhash, tokens
from loomary.llm.components import components
from test_native import LONG, ODD, empty, odd  # noqa: F401

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(PATH)


TEXTS = ["", "A b, c.", "don't it's I'LL 'd", "Éa ΣΑΣ İstanbul straße", "a b  c\x1cd\x85e", "é ́x", "x<|endoftext|>y <|ENDOFTEXT|>", "漢字 12 3.4 😀!?", "tab\tnew\nline\r\n", "µ ª Ÿ ﬁ"]


def test_chunks_give_the_librarys_ids(whole):
    own = tokens.ChunkTokenizer(PATH)
    for text in TEXTS * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" .,'aAéÉzZ\n")), max_size=40))
def test_any_text_gives_the_librarys_ids(text):
    own, lib = tokens.tokenizer(PATH), test_any_text_gives_the_librarys_ids
    lib.whole = getattr(lib, "whole", None) or tokenizers.Tokenizer.from_file(PATH)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.whole.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded():
    own, fresh = tokens.ChunkTokenizer(PATH, generation=3000), tokens.ChunkTokenizer(PATH)
    for k in range(60):
        text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + j)}, again x{k}" for j in range(9))
        assert own.encode(text) == fresh.encode(text)
        assert max(len(own.young), len(own.old)) <= 3000 // tokens.ENTRY + 30
    assert len(fresh.young) > 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(6, 18))
def test_code_lengths(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = [int(x) for x in lengths if x]
    assert max(used, default=0) <= limit and sum(2.0**-x for x in used) <= 1 and (lengths > 0).tolist() == [c > 0 for c in counts]
    if len(used) > 1 and limit == 18:
        import heapq

        heap = [c for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert sum(c * int(x) for c, x in zip(counts, lengths, strict=True)) >= cost
        if max(used) < 18:
            assert sum(c * int(x) for c, x in zip(counts, lengths, strict=True)) == cost


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    dice = np.random.default_rng(n)
    ids = np.minimum(dice.zipf(1.3, n), 3000) - 1
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3000) + (np.arange(3000) == 5))
    counts = np.array([n // 3, 0, n - n // 3])
    raw = huffman.encode_block(np.array([4, -1, huffman.NULL_ID]), counts, ids, huffman.canonical(lengths), lengths)
    docs, c, back = huffman.decode_block(raw, huffman.decode_table(lengths))
    assert docs.tolist() == [4, -1, huffman.NULL_ID] and c.tolist() == counts.tolist() and back.tolist() == ids.tolist()


def test_token_files_read_back(spark, odd, empty, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 500)
    for name, df in (("odd", odd), ("empty", empty)):
        huffman.write_documents(df, PATH, 49408, f"{tmp_path}/{name}")
    assert huffman.read_back(spark, f"{tmp_path}/empty").count() == 0
    got = sorted(huffman.read_back(spark, f"{tmp_path}/odd").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: (d is not None, d or 0))
    want = Counter((r["doc_id"], tuple([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in odd.collect())
    assert want == Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4


def test_many_small_partitions_keep_the_order(spark, tmp_path, monkeypatch):
    dice = np.random.default_rng(5)
    rows = [(part << 33 | k, 1000 * part + k, dice.integers(0, 50, int(dice.integers(1, 40))).astype("<u2").tobytes()) for part in range(40) for k in range(int(dice.integers(1, 30)))]
    frame = spark.createDataFrame([(r >> 33, r, d, bytearray(i)) for r, d, i in rows], "part int, row long, doc_id long, ids binary")
    frame.repartition(40, "part").sortWithinPartitions("row").drop("part").write.parquet(f"{tmp_path}/tokens")
    huffman.write(spark.read.parquet(f"{tmp_path}/tokens"), f"{tmp_path}/files", 50)
    got = {r["doc_id"]: (r["start"], len(r["ids"]) // 4) for r in huffman.read_back(spark, f"{tmp_path}/files").collect()}
    at = 0
    for _, doc, raw in rows:
        assert got[doc] == (at, len(raw) // 2)
        at += len(raw) // 2
    blocks = spark.read.parquet(f"{tmp_path}/files/blocks").withColumn("file", F.input_file_name()).collect()
    assert [r["row"] for r in sorted(blocks, key=lambda r: r["file"])] == sorted(r["row"] for r in blocks)
    for r in blocks:
        assert len({d // 1000 for d in np.frombuffer(r["payload"], "<i8", int.from_bytes(r["payload"][4:8], "little"), 20).tolist()}) == 1


def _check_packing(pieces, capacity=packing.CAPACITY):
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_near_the_bound(spark):
    dice = random.Random(3)
    sizes = [dice.choice([dice.randint(1, 2048), dice.randint(1, 300), 2048]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    first = packing.pack(df, block=700).join(df, "row").collect()
    whole = packing.founders(np.array(sizes), 2048, 0, 1)[0].max() + 1  # best fit decreasing over all pieces
    assert len(first) == 3000 and math.ceil(sum(sizes) / 2048) <= _check_packing(first) <= whole
    again = packing.pack(df, block=700).collect()
    assert {(r["row"], r["sequence_id"], r["offset"]) for r in again} == {(r["row"], r["sequence_id"], r["offset"]) for r in first}


def test_search_finds_the_least_number_of_bins():
    """Beside an exhaustive search over small sets."""

    def least(sizes, rooms):
        if not sizes:
            return len(rooms)
        best = len(rooms) + len(sizes)
        for k, room in enumerate(rooms):
            if room >= sizes[0] and room not in rooms[:k]:
                best = min(best, least(sizes[1:], [*rooms[:k], room - sizes[0], *rooms[k + 1 :]]))
        return min(best, least(sizes[1:], [*rooms, 20 - sizes[0]]))

    dice, better = random.Random(9), 0
    for seed in range(60):
        sizes = sorted((dice.randint(3, 12) for _ in range(9)), reverse=True)
        found = packing.evolve(np.array(sizes), packing.founders(np.array(sizes), 20, seed), 20, seed, children=60)[0]
        assert np.bincount(found, weights=sizes).max() <= 20
        first = packing.founders(np.array(sizes), 20, seed, 1)[0].max() + 1
        assert least(sizes, []) <= found.max() + 1 <= first
        better += found.max() + 1 == least(sizes, [])
    assert better >= 58


def test_bins_that_cant_be_filled_stay(spark):
    df = spark.createDataFrame([(i, 1500) for i in range(300)], "row long, length long")
    assert _check_packing(packing.pack(df, block=64).join(df, "row").collect()) == 300
    assert packing.pack(df.limit(0)).count() == 0


def test_crossover_beats_a_bad_parent():
    sizes = np.array([6, 4, 6, 4, 5, 5] * 20)
    alone = np.arange(len(sizes))
    good = packing.founders(sizes, 10, 1)[0]
    child = packing.cross(sizes, alone, good, 10, random.Random(1))
    assert np.bincount(child, weights=sizes).max() <= 10 and len(set(child)) < len(sizes) and len(set(good)) == 60
    assert packing.evolve(sizes, [alone, good], 10, 1)[0].max() + 1 == 60


def test_pieces_of_odd_documents(spark, odd, empty, whole):
    got = packing.packed_digests(odd).collect()
    want = Counter()
    for r in odd.collect():
        n = len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], p, p * 2048, min(2048, n - p * 2048)) for p in range(-(-n // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want
    _check_packing(got)
    assert packing.packed_digests(empty).count() == 0


def _measure(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines_ = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines_), len(lines_) - len(set(lines_)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b\xa0é ", max_size=60))
def test_measures_are_brute_force(text):
    assert quality.measure(text) == _measure(text)


def test_measures_of_odd_rows(spark, odd, empty):
    for r in quality.measured(odd).collect():
        assert tuple(r["measures"]) == _measure(r["text"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = quality.measured(odd.withColumn("lang", F.lit(None).cast("string")))
    got = quality.decide(scored, quality.calibrate(scored, none)).collect()
    assert len(got) == odd.count() and all(r["verdict"]["kept"] == (not r["verdict"]["base_failed"]) for r in got)
    nothing = quality.measured(empty.withColumn("lang", F.lit("en")))
    assert quality.decide(nothing, quality.calibrate(nothing, none)).count() == 0


def test_bound_is_clopper_pearson():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    p = quality.upper_bound(7, 200, 0.01)
    assert sum(math.comb(200, k) * p**k * (1 - p) ** (200 - k) for k in range(8)) == pytest.approx(0.01, rel=1e-6)
    assert quality.upper_bound(5, 5, 0.1) == quality.upper_bound(0, 0, 0.1) == 1


def test_cutoffs_limit_false_rejection(spark):
    dice = random.Random(5)
    rows, marks = [], []
    for i in range(9000):
        good = i % 4 > 0
        junk = 0 if good else 3
        body = " ".join("".join(dice.choice("abcdefghij") for _ in range(5)) + "#" * junk for _ in range(60))
        rows.append((i, body, "en" if i % 2 else None))
        marks.append((i, int(good)))
    docs = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string")).cache()
    cuts = quality.calibrate(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert cuts.count() == 2 and all(r["level"] is not None and r["bound"] <= 0.005 for r in cuts.collect())
    kept = {r["doc_id"]: r["verdict"]["kept"] for r in quality.decide(docs, cuts).collect()}
    assert sum(not kept[i] for i, g in marks if g) / 6750 <= 0.005 and not any(kept[i] for i, g in marks if not g)


def test_targets_by_hand(spark):
    df = spark.createDataFrame([("a", 100, 1), ("b", 10, 100), ("c", 1000, 3), (None, 50, 10)], "source string, size long, n long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    left, caps, weights = 1.5 * 4600, {"a": 200, "b": 2000, "c": 6000, None: 1000}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, open_ = {}, set(caps)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= caps[s]}
        if not over:
            break
        want |= {s: caps[s] for s in over}
        left -= sum(caps[s] for s in over)
        open_ -= over
    want |= share
    assert got == pytest.approx(want)


def test_mix_meets_its_targets(spark, odd, empty):
    dice = random.Random(2)
    rows = [(i, " ".join(["w"] * (40 if i % 3 == 0 else dice.randint(0, 200))), "s" + str(min(i % 10, 4))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).select("doc_id", "source", "mixed.*").collect()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["size"] == len(rows[r["doc_id"]][1].split())
        by[r["source"]].append(r)
    for parts in by.values():
        assert abs(sum(r["copies"] * r["size"] for r in parts) - parts[0]["target"]) <= 1 and parts[0]["source_size"] == sum(r["size"] for r in parts)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7)).select("doc_id", "mixed.copies").collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    sourced = odd.withColumn("source", F.when(F.col("k1") > 5, "a"))
    assert mixing.mix(sourced).count() == odd.count() and mixing.mixture(sourced).columns == sourced.columns
    assert mixing.mix(empty.withColumn("source", F.lit("a"))).count() == 0


def _simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbé \n\x85", max_size=40))
def test_simhash_is_brute_force(text):
    assert simhash.simhash(text) == _simhash(text)


def _classes(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_links_lose_none(spark):
    dice = random.Random(7)
    fps = [dice.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for _ in range(240):
        f = dice.choice(fps)
        for b in dice.sample(range(64), dice.randint(0, 4)):
            f ^= 1 << b
        fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()}
    assert [got[i] for i in range(len(fps))] == _classes(fps)


def test_crowded_anchor_is_exact(monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", 8)
    dice = random.Random(9)
    base = dice.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in dice.sample(range(64), dice.randint(0, 5))) for _ in range(150)})
    a, b = simhash._forest(np.array(fps, np.uint64), 3)
    found = {i: i for i in fps}

    def find(x):
        while found[x] != x:
            x = found[x]
        return x

    for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True):
        assert (x ^ y).bit_count() <= 3
        found[find(x)] = find(y)
    want = _classes(fps)
    assert len({find(x) for x in fps}) == len(set(want))


def test_crowded_bin_keeps_every_component(monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 1 << 14, raising=False)
    dice = np.random.default_rng(11)
    seeds = dice.integers(0, 1 << 32, 2500, np.uint64)
    flips = np.uint64(1) << dice.integers(0, 32, (2, 3500), np.uint64)
    fps = np.unique(np.concatenate((seeds, dice.choice(seeds, 3500) ^ flips[0] ^ flips[1])))  # one half is constant
    assert len(fps) > simhash.WIDE

    def count(a, b):
        root = {x: x for x in fps.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 3
            root[find(x)] = find(y)
        return len({find(x) for x in root})

    x, y = zip(*[(np.repeat(fps[i], len(near)), fps[near]) for i in range(len(fps)) if len(near := np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3))], strict=True)
    a, b = simhash._forest(fps, 3)
    assert count(np.concatenate(a), np.concatenate(b)) == count(np.concatenate(x), np.concatenate(y))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_class_stays(spark, odd, empty):
    got = simhash.near_dedup(odd)
    assert got.columns == odd.columns and simhash.near_dedup(empty).count() == 0
    rows = odd.collect()
    fps = [_simhash(r["text"]) for r in rows]
    roots, want = _classes(fps), {}
    for k, r in zip(roots, rows, strict=True):
        want.setdefault(k, []).append(r["doc_id"])
    ids = sorted((min((d for d in v if d is not None), default=None) for v in want.values()), key=lambda d: (d is None, d or 0))
    assert sorted((r["doc_id"] for r in got.collect()), key=lambda d: (d is None, d or 0)) == ids


def test_similar_documents_leave_the_pipeline(spark):
    import corpus_pipeline

    dice, texts = random.Random(4), []
    for k in range(30):
        words = [f"w{dice.randrange(5000)}" for _ in range(120)]
        texts.append(" ".join(words))
        for _ in range(3):
            for at in dice.sample(range(120), k % 5):
                words[at] = f"n{dice.randrange(5000)}"
            texts.append(" ".join(words))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(root)) and 30 < len(got) < len(texts)


def test_template_language():
    render = chat.compile_template("{% set n = 'a' ~ 1 %}{% for m in messages %}{% if loop.first and not false %}[{{ m.x | upper }}]{% elif m['x'] in 'bc' %}{{ n }}{% else %}-{% endif %}{# remark #}{% endfor %}{{ messages | length }}", ("<<",))
    assert render([{"x": "q"}, {"x": "b"}, {"x": "z"}])[0] == "[Q]a1-3"
    folded = chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{{ x }}"), lambda t: t)
    assert [(p.kind, p.value) for p in folded.parts] == [("constant", "abcd"), ("write", None)]
    for bad in ("{{ x.__class__() }}", "{% import os %}", "{{ x | eval }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ 'a' 'b' }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.compile_template("{{ m.__class__ }}")([]) == ("", [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), st.one_of(st.text(max_size=12), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "/s>", "[", "a"]), max_size=6).map("".join))), max_size=6))
def test_chat_round_trip(turns):
    text, spans = chat.compile_template()([{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_overlapping_controls_are_broken():
    escape = chat.escaper(("ab", "bc", "aa"))
    for text in ("abc", "aaaa", "a\\b", "\\\\ab", "abab"):
        out = escape(text)
        assert not any(c in out for c in ("ab", "bc", "aa")) and chat.unescape(out) == text


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, "x"), (2, None, "assistant", "a"), (2, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert chat.read_turns(got[1]["formatted"]) == [("user", "hi"), ("user", "hi"), ("assistant", "")]
    assert chat.read_turns(got[None]["formatted"]) == [("", "x")] and chat.read_turns(got[2]["formatted"]) == [("assistant", "a"), ("assistant", "b")]
    assert chat.format_conversations(df.limit(0)).count() == 0
    json.dumps([list(map(tuple, got[1]["loss_spans"]))])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    lines_ = [" ".join(f"w{(i * 31 + j * 17 + k * 7) % 4001}" for j in range(30)) for i in range(40) for k in range(3)]
    texts = ["\n".join(lines_[3 * i : 3 * i + 3]) for i in range(40)]
    texts += [texts[0], texts[1], texts[1] + " end", "too short", None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        kept.append(Counter(r["doc_id"] for r in now.collect()))
    assert set(kept[0]) == set(range(43)) and kept[0] == kept[1]
    grams = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in spark.read.parquet(f"{tmp_path}/line dedup").collect() for w in [r["text"].split()]}
    alike = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    assert set(kept[2]) == {a for a in grams if not any(b < a and alike(a, b) for b in grams)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _check_packing(got)
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == kept[3]
    assert len(LONG) > 100_000 and ODD
