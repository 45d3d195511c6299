"""Exact neighbours of vectors without all pairs: pivots, distance rings and the triangle inequality.

Rows are dealt to blocks by their nearest pivot and their distance from it (a ring); blocks are cut to a bounded number of
rows, so a crowded ring is spread over several. For each block the least and largest distance to every pivot is known. Of
two blocks, no rows are nearer than the gap between those intervals at any pivot: pairs of blocks whose gap reaches the
radius are never compared. The others are compared by matrix products, and what is close to the limit is decided by the
exact difference. Which rows are pivots decides how much is spared, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

PIVOTS, RINGS = 32, 64
#: Rows of a block: a sixteenth of all, within these limits; blocks in all (beyond, they grow).
LEAST, MOST, BLOCKS = 1 << 10, 1 << 14, 1 << 15
CHUNK = 512
SLACK = 1e-9


def packed(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x, np.float64)]


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of packed vectors; shorter ones are filled with zeros."""
    rows = [np.frombuffer(v) for v in vectors]
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.empty((0, width))
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


def pack(df: DataFrame, key: str, vector: str, unit: bool = False) -> DataFrame:
    """(id, vec): vectors as packed doubles, scaled to length one if `unit` (a zero vector stays); null components count as 0."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [np.nan_to_num(np.asarray(v, np.float64), nan=0.0) + 0.0 for v in part]
            yield pd.Series([(r / max(float(np.linalg.norm(r)), 1e-12) if unit else r).tobytes() for r in rows], dtype=object)

    return df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), run(F.col(vector).cast("array<double>")).alias("vec"))


@dataclass(frozen=True)
class Blocks:
    """`rows` with their block, and `pairs` (p, q; p <= q) of blocks that must be compared; n: rows a block."""

    rows: DataFrame
    pairs: DataFrame
    sizes: dict[int, int]

    def compared(self) -> int:
        """Pairs of rows that are compared."""
        return sum(self.sizes[r["p"]] * (self.sizes[r["q"]] if r["p"] != r["q"] else self.sizes[r["p"]] - 1) // (1 if r["p"] != r["q"] else 2) for r in self.pairs.toLocalIterator())

    def compare(self, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
        """run(rows of p, rows of q, whether they are the same) for each pair, in a task of its own."""
        ends = self.pairs.select(F.explode(F.array_distinct(F.array("p", "q"))).alias("block"), "p", "q")

        def both(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", ignore_index=True)
            p, q = key
            return run(pdf[pdf["block"] == p].reset_index(drop=True), pdf[pdf["block"] == q].reset_index(drop=True), p == q)

        return self.rows.join(ends, "block").groupBy("p", "q").applyInPandas(both, schema)


def blocks(rows: DataFrame, radius: float, block: int | None = None) -> Blocks:
    """Blocks of `rows` (id, vec and others), and the pairs of them that may hold rows nearer than `radius` (Euclidean).

    The driver sees the pivots, a count for each pivot and ring, and two small vectors a block (BLOCKS of them at most).
    """
    rows = written(rows, "vectors")
    pivots = matrix(rows.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(PIVOTS).toPandas()["vec"])
    width, names = max(radius / 2, 1e-12), rows.columns

    def far(pdf: pd.DataFrame) -> np.ndarray:
        x = matrix(pdf["vec"])
        both = max(x.shape[1], pivots.shape[1])
        x, c = (np.pad(m, ((0, 0), (0, both - m.shape[1]))) for m in (x, pivots))
        return np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in c], axis=1)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                d = far(pdf)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell, ring=np.minimum(d[np.arange(len(d)), cell] / width, RINGS - 1).astype(np.int64))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    ringed = written(rows.mapInPandas(place, f"{schema}, cell long, ring long"), "rings")
    counts = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n")).orderBy("cell", "ring").collect()
    total = sum(r["n"] for r in counts)
    block = max(block or min(max(total // 16, LEAST), MOST), total // BLOCKS)
    chain, left = [0], set(range(1, len(pivots)))  # cells from one to the nearest other, as small ones share a block
    while left:
        chain.append(min(left, key=lambda k: (float(((pivots[k] - pivots[chain[-1]]) ** 2).sum()), k)))
        left.remove(chain[-1])
    at = {cell: k for k, cell in enumerate(chain)}
    cut, first, room = [], 0, 0
    for r in sorted(counts, key=lambda r: (at[r["cell"]], r["ring"])):
        share = -(-r["n"] // block)
        if r["n"] <= room:
            cut.append((r["cell"], r["ring"], first - 1, 1))
            room -= r["n"]
        else:
            cut.append((r["cell"], r["ring"], first, share))
            first, room = first + share, block - r["n"] if share == 1 else 0
    of = rows.sparkSession.createDataFrame(cut, "cell long, ring long, first long, share long")
    placed = written(ringed.join(F.broadcast(of), ["cell", "ring"]).select(*names, (F.col("first") + F.pmod(F.xxhash64("id"), F.col("share"))).alias("block")), "blocks")  # `of`: PIVOTS * RINGS rows at most

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, n = {}, {}, {}
        for pdf in parts:
            for b, own in pdf.groupby("block"):
                d = far(own)
                low[b] = np.minimum(low.get(b, np.inf), d.min(axis=0))
                high[b] = np.maximum(high.get(b, -np.inf), d.max(axis=0))
                n[b] = n.get(b, 0) + len(own)
        yield pd.DataFrame({"block": list(low), "low": packed(np.array(list(low.values()))), "high": packed(np.array(list(high.values()))), "n": list(n.values())}, columns=["block", "low", "high", "n"])

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "low": [matrix(pdf["low"]).min(axis=0).tobytes()], "high": [matrix(pdf["high"]).max(axis=0).tobytes()], "n": [pdf["n"].sum()]})

    known = "block long, low binary, high binary, n long"
    spans = placed.select("vec", "block").mapInPandas(reach, known).groupBy("block").applyInPandas(meet, known).orderBy("block").toPandas()
    low, high, ids = matrix(spans["low"]), matrix(spans["high"]), spans["block"].to_numpy(np.int64)

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k in pdf["id"]:
                gap = np.maximum(low[k:] - high[k], low[k] - high[k:]).max(axis=1)
                hit = ids[k:][gap < radius * (1 + SLACK) + SLACK]
                yield pd.DataFrame({"p": ids[k], "q": hit})

    pairs = rows.sparkSession.range(len(ids)).mapInPandas(near, "p long, q long")
    return Blocks(placed, written(pairs, "pairs"), dict(zip(ids.tolist(), spans["n"].tolist(), strict=True)))


def linkage_distances(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, method: str, exact: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Distances of clusters with means x, y and sizes a, b. average: of unit vectors, one less the product of the means, which
    is the mean of all cosine distances. ward: sqrt(2ab / (a + b)) times the distance of the means.

    Ward's come from squared norms, which is inexact where it is small: entries that exact(d) marks are taken from differences.
    """
    product = x @ y.T
    if method == "average":
        return np.round(1 - product, 12)
    weight = 2 * a[:, None] * b[None, :] / (a[:, None] + b[None, :])
    d = np.sqrt(np.maximum(((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * product) * weight, 0))
    if exact is not None:
        i, j = np.nonzero(exact(d))
        for k in range(0, len(i), 1 << 16):
            r, c = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            d[r, c] = np.round(np.sqrt(((x[r] - y[c]) ** 2).sum(axis=1) * weight[r, c]), 12)
    return d


def pair_distances(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, method: str) -> np.ndarray:
    """linkage_distances of x[k] and y[k]."""
    if method == "average":
        return np.round(1 - (x * y).sum(axis=1), 12)
    return np.round(np.sqrt(((x - y) ** 2).sum(axis=1) * (2 * a * b / (a + b))), 12)


def euclidean_radius(threshold: float, method: str) -> float:
    """Means of clusters nearer than `threshold` are nearer than this: 1 - x.y >= |x - y|^2 / 2 as no mean is longer than one;
    2ab / (a + b) >= 1."""
    return float(np.sqrt(2 * threshold)) if method == "average" else threshold


def _about(threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """Marks distances whose side of the threshold the norms can't tell."""
    return lambda d: np.abs(d - threshold) <= 1e-6 * (1 + threshold)


def near_pairs(df: DataFrame, key: str, vector: str, threshold: float, metric: str = "euclidean", block: int | None = None) -> tuple[DataFrame, Blocks]:
    """(a, b, distance), a below b: all pairs of rows nearer than `threshold`, by Euclidean or cosine distance; and the blocks.

    Keys are unique; null keys and null vectors have no pairs. A zero vector is at cosine distance one of every other.
    Equal vectors give all their pairs: the result is one of pairs. An empty table gives none.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    average = metric == "cosine"
    found = blocks(pack(df.filter(F.col(key).isNotNull()), key, vector, average), euclidean_radius(threshold, "average" if average else "ward"), block)
    kind = dict(df.dtypes)[key]

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y, out = matrix(left["vec"]), matrix(right["vec"]), []
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            ones = np.ones(len(part)), np.ones(len(y))
            d = linkage_distances(part, y, *ones, "average" if average else "ward", lambda d: d < threshold + 1e-6 * (1 + threshold))
            i, j = np.nonzero(d < threshold)
            i, j = (i[keep], j[keep]) if same and (keep := i + at < j) is not None else (i, j)
            out.append(pd.DataFrame({"a": left["id"].to_numpy()[i + at], "b": right["id"].to_numpy()[j], "distance": d[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": []})

    pairs = found.compare(run, f"a {kind}, b {kind}, distance double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"), found


def forest(found: Blocks, threshold: float, method: str, kind: str) -> DataFrame:
    """(a, b): a spanning forest, for each pair of blocks, of the rows (id, vec, size) nearer than `threshold`."""

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y = matrix(left["vec"]), matrix(right["vec"])
        ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        m, label, links = len(x), np.arange(len(x) + len(y)), []
        if same:
            label[m:] = label[:m]
        for at in range(0, m, CHUNK):
            d = linkage_distances(x[at : at + CHUNK], y, left["size"].to_numpy(np.float64)[at : at + CHUNK], right["size"].to_numpy(np.float64), method, _about(threshold))
            hit = d < threshold
            own, other = np.arange(at, at + len(d)), np.arange(m, m + len(y))
            while True:  # every row joins one neighbour of another tree, until there are none
                apart = hit & (label[own][:, None] != label[other][None, :])
                rows = np.flatnonzero(apart.any(axis=1))
                if not len(rows):
                    break
                for r, c in zip(rows.tolist(), apart[rows].argmax(axis=1).tolist(), strict=True):
                    u, v = label[own[r]], label[other[c]]
                    if u != v:
                        links.append((ids[own[r]], ids[other[c]]))
                        label[label == max(u, v)] = min(u, v)
        return pd.DataFrame(links, columns=["a", "b"], dtype=None if links else object)

    return found.compare(run, f"a {kind}, b {kind}")


def links(found: Blocks, threshold: float, method: str, kind: str, most: int) -> DataFrame | None:
    """(a, b, d), a below b: all pairs of the rows (id, vec, size) nearer than `threshold`, written; None if there are more
    than `most` a row, of a pair of blocks or of all.

    Candidates come from products in single precision with a margin for its errors; the exact distance decides.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        right = left if same else right
        x, y, a, b = matrix(left["vec"]), matrix(right["vec"]), left["size"].to_numpy(np.float64), right["size"].to_numpy(np.float64)
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        p, q = ((m**2).sum(axis=1) / 2 for m in (x, y))
        scale = 2 + 4 * max(p.max(initial=0), q.max(initial=0))
        single = scale < 1e12
        low = -(threshold**2) / 2 if method == "ward" else 1 - threshold
        low -= (width + 8) * scale * (2.4e-7 if single else 1e-15)
        u, v = (np.c_[x, -p, np.ones(len(x))], np.c_[y, np.ones(len(y)), -q]) if method == "ward" else (x, y)
        u, v = (m.astype(np.float32 if single else np.float64) for m in (u, v))
        out, n = [], 0
        for at in range(0, len(x), CHUNK):
            start = at if same else 0
            hit = np.flatnonzero(~(u[at : at + CHUNK] @ v[start:].T <= low))
            for k in range(0, len(hit), 1 << 16):
                i, j = np.divmod(hit[k : k + (1 << 16)], len(y) - start)
                i, j = i + at, j + start
                i, j = (i[i < j], j[i < j]) if same else (i, j)
                d = pair_distances(x[i], y[j], a[i], b[j], method)
                ok = d < threshold
                out.append((i[ok], j[ok], d[ok]))
                n += len(out[-1][2])
            if n > most * (len(x) + len(y)):
                one = left["id"].to_numpy()[:1]
                return pd.DataFrame({"a": one, "b": one, "d": [0.0]})
        i, j, d = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pd.DataFrame({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j], "d": d})

    pairs = found.compare(run, f"a {kind}, b {kind}, d double")
    out = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"), "links")
    n, crowded = out.agg(F.count("*"), F.count_if(F.col("a") == F.col("b"))).first()
    return None if crowded or n > most * sum(found.sizes.values()) else out


def nearest(found: Blocks, threshold: float, method: str, kind: str) -> DataFrame:
    """(id, other, d): each row's nearest other one below `threshold`, the lesser id among equally near ones; a task sends one
    row for each of its rows."""

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y, a, b = matrix(left["vec"]), matrix(right["vec"]), left["size"].to_numpy(np.float64), right["size"].to_numpy(np.float64)
        best = [(np.full(len(x), np.inf), np.zeros(len(x), np.int64)), (np.full(len(y), np.inf), np.zeros(len(y), np.int64))]
        for at in range(0, len(x), CHUNK):
            own = np.arange(at, min(at + CHUNK, len(x)))

            def close(d: np.ndarray, own=own) -> np.ndarray:
                if same:
                    d[np.arange(len(own)), own] = np.inf
                margin = 1e-6 * (1 + threshold)
                least = np.minimum(d.min(axis=1, keepdims=True), threshold), np.minimum(d.min(axis=0, keepdims=True), threshold)
                return (d <= least[0] + margin) | (d <= least[1] + margin)

            d = linkage_distances(x[own], y, a[own], b, method, close)
            if same:
                d[np.arange(len(own)), own] = np.inf
            for side, axis in ((0, 1), (1, 0)):
                if not d.size or (side and same):
                    continue
                at_, value = d.argmin(axis=axis), d.min(axis=axis)
                if side == 0:
                    best[0][0][own], best[0][1][own] = value, at_
                else:
                    better = value < best[1][0]
                    best[1][0][better], best[1][1][better] = value[better], own[at_[better]]
        out = []
        for (value, at_), mine, others in ((best[0], left, right), (best[1], right, left)):
            ok = value < threshold
            out.append(pd.DataFrame({"id": mine["id"].to_numpy()[ok], "other": others["id"].to_numpy()[at_[ok]] if ok.any() else [], "d": value[ok]}))
        return pd.concat(out)

    met = found.compare(run, f"id {kind}, other {kind}, d double")
    return met.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.other", "m.d")
