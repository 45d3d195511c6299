"""SimHash near-duplicates by anchor-point covering.

A text's 64-bit fingerprint has bit j set if over half of its shingles' XXH64 values have it. Two fingerprints
within 3 bits of each other are within 1 bit in one half of 32 bits at least. On 31 bits of each half the [31,26]
Hamming code is a perfect covering code of radius 1: its words are the anchors. A fingerprint goes to every anchor
within covering radius plus threshold (1 + 1 = 2 bits) of that half: 16 anchors at most. Of two fingerprints within
1 bit on the half, the nearest anchor of one is among the anchors of the other, so each link is found at some anchor.
Fingerprints are compared whole (64 bits) per anchor, which yields a spanning forest of its links instead of all
pairs. Only distinct fingerprints travel, so groups of copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

SEED = 42
BLOCK = 1 << 16
NEAR, WIDE = 8, 4096
#: Comparisons held at once in a crowded bin.
CELLS = 1 << 21


def simhash(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint over word shingles of the whole text; 0 for a text without words or null."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) < words:
        parts, words = [whole], 1
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    starts, ends = starts[:n], ends[words - 1 :]
    for k in range(0, n, BLOCK):
        hashes = [digest(whole[i:j], SEED) for i, j in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of shingles that are hashed already: bits that over half of the values have; 0 for none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """simhash() of a string column as signed long."""

    @F.pandas_udf(T.LongType())
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([simhash(x, words) for x in part], np.uint64).view(np.int64))

    return fingerprints(text)


def _syndrome(half: Column) -> Column:
    """(low, s): the low 31 bits of `half` and their syndrome in the [31,26] Hamming code, 0 for its words."""
    low = half.bitwiseAND(F.lit(0x7FFFFFFF))
    syndrome = F.lit(0)
    for bit in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> bit & 1)
        syndrome = syndrome + F.bit_count(low.bitwiseAND(F.lit(mask))) % 2 * F.lit(1 << bit)
    return F.struct(low.alias("low"), syndrome.cast("int").alias("s"))


def anchored(fingerprints: DataFrame) -> DataFrame:
    """(anchor, fp): a distinct fingerprint `fp` once for each anchor it goes to; the top bit of anchor tells the half."""
    halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")), F.struct(F.lit(1).alias("side"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half"))))
    at = fingerprints.select("fp", halves.alias("h")).select("fp", "h.side", _syndrome(F.col("h.half")).alias("c")).select("fp", "side", "c.low", "c.s")
    near = F.expr("if(s = 0, array(low), transform(filter(sequence(1, 31), i -> (i ^ s) = 0 or i < (i ^ s)), i -> low ^ shiftleft(1L, i - 1) ^ if((i ^ s) = 0, 0L, shiftleft(1L, (i ^ s) - 1))))")
    return at.select("fp", "side", F.explode(near).alias("word")).select((F.col("side").cast("long") * F.lit(1 << 31) + F.col("word")).alias("anchor"), "fp")


def _forest(fps: np.ndarray, bits: int) -> tuple[list, list]:
    """Spanning forest of the links within `bits` among distinct fingerprints."""
    if len(fps) > WIDE:
        return _split(fps, bits)
    a, b, rest = [], [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.bitwise_count(front[:, None] ^ rest[None, :]) <= bits
            hit = near.any(axis=0)
            a.append(front[near[:, hit].argmax(axis=0)])
            b.append(rest[hit])
            front, rest = rest[hit], rest[~hit]
    return a, b


def _split(fps: np.ndarray, bits: int) -> tuple[list, list]:
    """For a crowded anchor: fingerprints within `bits` agree in one of bits + 1 equal pieces; a bin that is itself crowded is searched in blocks."""
    a, b = [], []
    edges = np.linspace(0, 64, bits + 2).astype(int)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        piece = (fps >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(piece, kind="stable")
        sorted_fps, cuts = fps[order], np.flatnonzero(np.diff(piece[order])) + 1
        for group in np.split(sorted_fps, cuts):
            if len(group) <= WIDE:
                x, y = _forest(group, bits) if len(group) > 1 else ([], [])
                a += x
                b += y
                continue
            x, y = _spread(group, bits)
            a += x
            b += y
    return a, b


def _spread(fps: np.ndarray, bits: int) -> tuple[list, list]:
    """Spanning forest as in _forest, for any number of fingerprints: the frontier advances in blocks of CELLS comparisons at most."""
    a, b, rest = [], [], fps
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            block = front.pop()
            step = max(1, CELLS // len(rest))
            if len(block) > step:
                front.append(block[step:])
                block = block[:step]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                a.append(block[near[:, hit].argmax(axis=0)])
                b.append(rest[hit])
                front.append(rest[hit])
                rest = rest[~hit]
    return a, b


def _linker(bits: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by anchor; each anchor's rows stand together."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(anchor: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            a, b = [], []
            starts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]))
            sizes = np.diff(starts)
            small = np.repeat(sizes <= NEAR, sizes)
            for lag in range(1, NEAR):
                if len(fp) <= lag:
                    break
                hit = (anchor[lag:] == anchor[:-lag]) & small[lag:] & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= bits)
                a.append(fp[:-lag][hit])
                b.append(fp[lag:][hit])
            for g in np.flatnonzero(sizes > NEAR):
                x, y = _forest(fp[starts[g] : starts[g + 1]], bits)
                a += x
                b += y
            pair = lambda z: np.concatenate([*z, np.empty(0, np.uint64)]).view(np.int64)
            return pd.DataFrame({"a": pair(a), "b": pair(b)}).drop_duplicates()

        for batch in batches:
            if not len(batch):
                continue
            anchor, fp = batch["anchor"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64)
            if held and held[0][0][0] == anchor[-1]:
                held.append((anchor, fp))
                continue
            cut = int(np.searchsorted(anchor, anchor[-1]))
            held.append((anchor[:cut], fp[:cut]))
            yield out(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held = [(anchor[cut:], fp[cut:])]
        if held:
            yield out(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    return link


def links(fingerprints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): a spanning forest, per anchor, of all links at `bits` (3 or fewer) or less among distinct fingerprints `fp`."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves with one flip each cover 3 bits at most")
    dealt = anchored(fingerprints).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(_linker(bits), "a long, b long")


def classes(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", fp_col: str = "fp", roots: DataFrame | None = None) -> DataFrame:
    """`docs` (with fp_col) plus component_id, the least id_col that links reach, and root, a fingerprint that names the class.

    Null ids take no part in the minimum (a class of null ids only has component_id null). Repeated rows all stay and
    share a class. An empty table gives an empty one. Columns that clash with working names are safe: only id_col and
    fp_col are read, and the joins add nothing but component_id and root (which must not be there yet). `roots` (node,
    root) replaces the components of the links within `bits`.
    """
    own = docs.select(F.col(fp_col).alias("fp"), F.col(id_col).alias("id"))
    nodes = written(own.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(links(nodes.select("fp"), bits)) if roots is None else roots
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.filter("root <> fp").groupBy("root").agg(F.min("least").alias("below"))
    heads = linked.filter("root = fp").join(least, "root", "left").select("root", F.least("least", "below").alias("component_id"))
    of = written(linked.join(heads, "root").select(F.col("fp").alias("__fp"), "component_id", "root"), "classes")
    return docs.join(of, docs[fp_col] == of["__fp"], "left").drop("__fp")


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits: int = 3, words: int = 3) -> DataFrame:
    """One row of each class of near-duplicates, with the columns of `docs`.

    The row kept is the one with the least id (ties: the least hash of the text). Rows with a null id stay only if
    their class has no other id, one of them. Null and empty texts share fingerprint zero and so one class.
    """
    names = docs.columns
    marked = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("tie"), fingerprint_column(F.col(f"`{text_col}`"), words).alias("fp")), "marked")
    return one_each(marked, classes(marked.select("id", "tie", "fp"), bits, "id"))


def one_each(marked: DataFrame, known: DataFrame) -> DataFrame:
    """The row of each class that near_dedup keeps; marked: (row, id, tie, fp), known: its classes."""
    first = known.filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = first.groupBy("root").agg(F.min(F.struct("tie", "fp")).alias("m"), F.min("component_id").alias("k_id"))
    keep = one.select("k_id", F.col("m.tie").alias("k_tie"), F.col("m.fp").alias("k_fp"))
    kept = marked.join(keep, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie")) & (F.col("fp") == F.col("k_fp")))
    return kept.groupBy("id", "tie", "fp").agg(F.first("row").alias("row")).select("row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    marked = written(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")), "simhash")
    return classes(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
