"""Near-duplicates by exact Jaccard similarity of five-word shingle sets.

Texts meet by the anchor points of simhash.py first: SimHash fingerprints of the sets go to the words of a covering code,
and the links within BITS bits that come from there are decided by the exact similarity of the whole sets. What so few
bits can't reach (at Jaccard 0.8 some ten of 64 bits differ) meets by MinHash bands (BANDS of ROWS samples): a pair at
Jaccard 0.8 shares no band with probability (1 - 0.8^4)^32, about 4e-8, and less above. First every text of a bucket is
compared with the bucket's centre (a few rounds, another centre each), so that groups of copies cost a comparison a text;
texts of buckets that are not linked throughout by then meet by a prefix filter on their rarest shingles, which loses no
pair and spares those that only share common passages. Only distinct shingle sets travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, written
from .components import components
from .simhash import classes, of_hashes, one_each
from .simhash import links as anchor_links

SEED, WORDS, SIMILARITY, STARS, BITS = 42, 5, 0.8, 2, 3
BANDS, ROWS = 32, 4
CHUNK = 1 << 12
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles of the whole text; of all words if they are fewer."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    whole, words = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[i:j], SEED) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def bands(values: np.ndarray) -> np.ndarray:
    """One key a band; none for an empty set."""
    if not len(values):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), CHUNK):
        np.minimum(least, (values[k : k + CHUNK, None] * _TIMES).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _node(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), SEED) - (1 << 63)


def _sketch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        sets = [shingles(x) for x in part]
        sim = np.array([of_hashes(s) for s in sets], np.uint64).view(np.int64)
        yield pd.DataFrame({"fp": [_node(s) for s in sets], "n": [len(s) for s in sets], "sim": sim, "keys": [bands(s) for s in sets]})


def _sets(needed: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, s): the shingle sets of the fingerprints in `needed` (fp, distinct); texts: (fp, text). No rows give no rows."""

    @F.pandas_udf("array<long>")
    def values(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingles(x).view(np.int64) for x in part])

    met = maybe_in(texts, needed, "fp").join(needed, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    return written(met.select("fp", values("text").alias("s")), "shingles")


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets are at least so similar. No pairs give no links."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    return written(common.filter(F.col("c") >= similarity * (F.col("n") - F.col("c"))).select("a", "b"), "links")


def rare_pairs(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of `sets` (fp, s) of different root (roots: fp, root) that may be similar, by a prefix filter.

    Elements are ordered from the rarest on. Of two sets that similar, the smaller one (size n) shares 2 s / (1 + s) of its
    elements at least, so one of its first n - ceil(that) + 1 is among the first m - ceil(s m) + 1 of the larger one.
    Elements of one set alone can't be shared: they only take up places, which also bounds what two sets have in common.
    What many sets share comes last, so a passage that they have in common makes no pairs.
    """
    parts = sets.select("fp", F.size("s").alias("n"), F.explode("s").alias("t"))
    shared = parts.groupBy("t").agg(F.count("*").alias("f")).filter("f > 1")
    ranked = parts.join(shared, "t").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("e"))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1
    own = ranked.withColumn("alone", F.col("n") - F.size("e")).withColumn("wide", first(similarity))
    places = own.filter("alone < wide").select("fp", "n", "alone", F.posexplode(F.expr("slice(e, 1, wide - alone)")).alias("k", "e"))
    at = written(places.select("fp", "n", "alone", (F.col("alone") + F.col("k")).alias("place"), F.col("e.t").alias("t")).join(roots, "fp"), "places")
    small = at.filter(F.col("place") < first(2 * similarity / (1 + similarity))).select("t", *[F.col(c).alias(f"{c}_") for c in ("fp", "n", "alone", "root")])
    most = F.least(F.col("n") - F.col("alone"), F.col("n_") - F.col("alone_"))  # elements in common
    alike = (F.col("n_") >= similarity * F.col("n") - 1e-9) & (most >= similarity * (F.col("n") + F.col("n_") - most) - 1e-9)
    met = at.join(small, "t").filter((F.struct("n_", "fp_") < F.struct("n", "fp")) & (F.col("root") != F.col("root_")) & alike)
    return met.select(F.least("fp", "fp_").alias("a"), F.greatest("fp", "fp_").alias("b")).distinct()


def _alike(x: Column, y: Column, similarity: float) -> Column:
    """Sets of such sizes may be similar."""
    return F.least(x, y) >= similarity * F.greatest(x, y)


def anchored_pairs(nodes: DataFrame, similarity: float, bits: int = BITS) -> DataFrame:
    """(a, b) of sets (fp, n, sim) whose fingerprints are linked within `bits`: a spanning forest for each anchor over the first
    set of each fingerprint, and that one beside the others of its fingerprint."""
    heads = written(nodes.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("h")).select("sim", "h.fp", "h.n"), "heads")
    end = lambda x: heads.select(F.col("sim").alias(x), F.col("fp").alias(f"{x}_fp"), F.col("n").alias(f"{x}_n"))
    forest = anchor_links(heads.select(F.col("sim").alias("fp")), bits).distinct().join(end("a"), "a").join(end("b"), "b")
    same = nodes.join(end("sim"), "sim").select(F.col("fp").alias("a_fp"), F.col("n").alias("a_n"), F.col("sim_fp").alias("b_fp"), F.col("sim_n").alias("b_n"))
    both = forest.select("a_fp", "a_n", "b_fp", "b_n").unionByName(same.filter("a_fp <> b_fp"))
    return both.filter(_alike(F.col("a_n"), F.col("b_n"), similarity)).select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct()


def _between(pairs: DataFrame) -> DataFrame:
    """The distinct ends of the pairs."""
    return written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "needed")


def roots(sketched: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of all linked sets; sketched: (fp, n, sim, keys), one row a text at least. No rows give no rows."""
    nodes = sketched.groupBy("fp").agg(F.first("n").alias("n"), F.first("sim").alias("sim"))
    pairs = written(anchored_pairs(nodes, similarity), "pairs")
    links = _links(pairs, _sets(_between(pairs), texts), similarity)
    known = components(links)
    dealt = sketched.groupBy("fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).join(known, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.explode("keys").alias("key"))
    # a repeated key needs company that isn't linked yet
    mixed = dealt.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("key")
    open_ = written(dealt.join(mixed, "key", "left_semi"), "buckets")
    for k in range(STARS + 1):
        if k < STARS:
            centre = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", F.lit(k)), "fp", "n", "root")).alias("c"))
            near = open_.join(centre, "key").filter((F.col("root") != F.col("c.root")) & _alike(F.col("n"), F.col("c.n"), similarity))
            pairs = written(near.select(F.least("fp", "c.fp").alias("a"), F.greatest("fp", "c.fp").alias("b")).distinct(), "pairs")
            sets = _sets(_between(pairs), texts)
        else:
            left = written(open_.select("fp", "root").distinct(), "left")
            sets = _sets(left.select("fp"), texts)
            pairs = rare_pairs(sets, left, similarity)
        links = links.unionByName(_links(pairs, sets, similarity))
        known = components(links)
        if k < STARS:
            now = open_.drop("root").join(known, open_["fp"] == known["node"], "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
            mixed = now.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("key")
            open_ = written(now.join(mixed, "key", "left_semi"), "buckets")
    return known


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates, with the columns of `docs`; which one: as in simhash.near_dedup.

    Texts without words (null ones too) are one class.
    """
    text = F.col(f"`{text_col}`")
    sketch = F.pandas_udf(_sketch, "fp long, n int, sim long, keys array<long>")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), sketch(text).alias("s"))
    marked = written(row.select("row", "id", "tie", "s.fp", "s.n", "s.sim", "s.keys"), "marked")
    found = roots(marked.select("fp", "n", "sim", "keys"), marked.select("fp", F.col(f"row.`{text_col}`").alias("text")), similarity)
    return one_each(marked.select("row", "id", "tie", "fp"), classes(marked.select("id", "tie", "fp"), id_col="id", roots=found))
