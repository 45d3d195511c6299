"""Near-duplicates by Hamming distance, connected components, standardising, exact agglomerative clusters, representatives."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import from_hex, hamming
from ..functions.text import safe_int
from ..shared import numbered, shared_dir, written
from .metric import blocks, euclidean_radius, forest, linkage_distances, links, matrix, nearest, pack, pair_distances

#: Clusters that one task takes; rounds in which codes meet one of a crowded key.
FIT, STARS = 4096, 2
#: Codes of a key from which it is crowded; rows of keys that a task holds at once; codes of a key that meet by their places.
CROWD, HELD, FEW = 1 << 12, 1 << 20, 8
#: Places a code up to which codes are dense; bits in which the codes of a line differ; edges whose components a task finds.
DENSE, LINE, SETTLED = 8, 10, 1 << 19
#: Links a row up to which clusters go by their links; multiples of FIT that a task takes of linked clusters and of links.
LINKS, LINKED, SPARSE = 128, 8, 256
#: Default thresholds by encoder (average linkage on cosine distance; Ward on standardised features).
COSINE_THRESHOLD, WARD_THRESHOLD = 0.18, 2.4


def hamming_pairs(hashes: DataFrame, key: str, code: str, bound: int = 4) -> DataFrame:
    """(left_key, right_key, distance) of all pairs of rows within `bound` bits, left below right.

    64 bits in bound + 1 bands: two codes that close agree in a band, so equal bands are candidates and the exact
    distance decides. Only distinct codes are joined; rows are expanded at the end.
    """
    rows = hashes.select(F.col(key).alias("k"), F.col(code).alias("c"))
    near = code_pairs(rows.select("c").distinct(), bound)
    same = rows.select("c").distinct().select(F.col("c").alias("c1"), F.col("c").alias("c2"), F.lit(0).alias("distance"))
    left, right = rows.select(F.col("k").alias("x"), F.col("c").alias("c1")), rows.select(F.col("k").alias("y"), F.col("c").alias("c2"))
    both = near.unionByName(same).join(left, "c1").join(right, "c2").filter(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("left_key"), F.greatest("x", "y").alias("right_key"), "distance").distinct()


def _keys(c: Column, edges: list[int], equal: int) -> Column:
    """One key for each choice of `equal` of the bands of 64 bits between `edges`."""
    masks = [((1 << (high - low)) - 1) << low for low, high in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.xxhash64(F.lit(k), c.bitwiseAND(F.lit(signed(sum(chosen))))) for k, chosen in enumerate(combinations(masks, equal))])


def code_pairs(codes: DataFrame, bound: int, equal: int = 3) -> DataFrame:
    """(c1, c2, distance) of distinct codes `c` within `bound` bits, c1 below c2.

    The 64 bits are cut into bound + `equal` bands. Two codes that close differ in `bound` bands at most, so they agree
    in `equal` others: all choices of so many bands are keys, each of some 64 * equal / (bound + equal) bits (27 for 4
    bits), which keeps the candidates of a key few at any number of codes. The exact distance decides.
    """
    edges = np.linspace(0, 64, bound + equal + 1).astype(int).tolist()
    dealt = codes.select("c", F.explode(_keys(F.col("c"), edges, equal)).alias("key"))
    a, b = dealt.withColumnRenamed("c", "c1"), dealt.withColumnRenamed("c", "c2")
    met = a.join(b, "key").filter(F.col("c1") < F.col("c2"))
    return met.withColumn("distance", hamming(F.col("c1"), F.col("c2"))).filter(F.col("distance") <= bound).select("c1", "c2", "distance").distinct()


def _weights(codes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of codes, and the information of their first 1 to 64 bits, as if bits were independent: bits that (nearly)
    all codes share weigh little. The driver sees a count for each value of each byte, 2,048 at most."""
    octets = F.array(*[F.shiftrightunsigned("c", 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8)])
    counts = np.zeros((8, 256))
    for r in codes.filter(F.col("c").isNotNull()).select(F.posexplode(octets).alias("at", "octet")).groupBy("at", "octet").count().collect():
        counts[r["at"], r["octet"]] = r["count"]
    ones = (counts @ (np.arange(256)[:, None] >> np.arange(8) & 1)).ravel()
    p = np.clip(ones / max(counts[0].sum(), 1), 1e-9, 1 - 1e-9)
    return int(counts[0].sum()), np.cumsum(1e-3 - p * np.log2(p) - (1 - p) * np.log2(1 - p))


def _even_edges(weight: np.ndarray, parts: int) -> list[int]:
    """Cuts of the 64 bits into bands that tell codes apart about equally."""
    inner = np.abs(np.concatenate([[0], weight])[None] - weight[-1] * np.arange(1, parts)[:, None] / parts).argmin(axis=1)
    return [0, *inner.tolist(), 64]


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) that isn't the least of its component, with that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := label[u] != label[v]).any():
        low, high = np.minimum(label[u], label[v])[apart], np.maximum(label[u], label[v])[apart]
        np.minimum.at(label, high, low)
        while (label != (further := label[label])).any():
            label = further
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which signed codes differ; numpy counts those of the absolute value if numbers are signed."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _key_linker(bound: int, crowd: int, held: int):
    """From rows (key, c) in order of key to (a, b): of each few keys together, every code that links within `bound` bits
    reach from a lesser one, beside the least of them. A key of more than `crowd` codes gives (key, null) instead."""

    def forest(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rest = codes
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                near = _apart(front[:, None], rest[None, :]) <= bound
                hit = near.any(axis=0)
                yield front[near[:, hit].argmax(axis=0)], rest[hit]
                front, rest = rest[hit], rest[~hit]

    def out(key: np.ndarray, code: np.ndarray) -> pd.DataFrame:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        sizes = np.diff(starts)
        few, pairs = np.repeat(sizes <= FEW, sizes), []
        for lag in range(1, min(FEW, len(code))):
            hit = (key[lag:] == key[:-lag]) & few[lag:] & (_apart(code[lag:], code[:-lag]) <= bound)
            pairs.append((code[:-lag][hit], code[lag:][hit]))
        for g in np.flatnonzero((sizes > FEW) & (sizes <= crowd)):
            pairs.extend(forest(code[starts[g] : starts[g + 1]]))
        a, b = (np.concatenate([*z, np.empty(0, np.int64)]) for z in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        b, a = _least_reached(a, b)
        crowded = key[starts[:-1][sizes > crowd]]
        return pd.DataFrame({"a": np.concatenate([a, crowded]), "b": pd.Series(np.concatenate([b, crowded])).astype("Int64").mask(np.arange(len(a) + len(crowded)) >= len(a))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, codes, n = [], [], 0
        for batch in batches:
            keys.append(batch["key"].to_numpy(np.int64))
            codes.append(batch["c"].to_numpy(np.int64))
            n += len(batch)
            if n >= held:  # all but the last key, of which no more is kept than tells that it is crowded
                key, code = np.concatenate(keys), np.concatenate(codes)
                cut = int(np.flatnonzero(key == key[-1])[0])
                if cut:
                    yield out(key[:cut], code[:cut])
                keys, codes = [key[cut:][: crowd + 1]], [code[cut:][: crowd + 1]]
                n = len(keys[0])
        if n:
            yield out(np.concatenate(keys), np.concatenate(codes))

    return run


def code_roots(codes: DataFrame, bound: int, equal: int = 3, crowd: int = CROWD) -> DataFrame:
    """(node, root): each distinct code `c` (none null) with the least one that it reaches over steps of `bound` bits.

    Keys as in code_pairs, but of bands that tell the codes apart evenly, and without the pairs: a task links the codes of
    its keys and tells of each code the least one reached. Of keys with more than `crowd` codes, each code meets one of them
    (a few times, another each time), which links dense groups at a comparison a code; in those that aren't linked
    throughout by then all codes that don't belong to the key's largest group meet all codes.

    Codes that fill much of the places that their bits leave (consecutive ones) are linked along lines first: a few bands,
    all but one of them equal. What doesn't belong to the largest group by then meets all codes of its keys as above.
    """
    n, weight = _weights(codes)
    nodes = codes.select(F.col("c").alias("node"))
    keyed = lambda of, parts, same: of.select("c", F.explode(_keys(F.col("c"), _even_edges(weight, parts), same)).alias("key"))
    linked = lambda dealt: written(dealt.repartition("key").sortWithinPartitions("key").mapInPandas(_key_linker(bound, crowd, HELD), "a long, b long"), "links")
    apart = sure = None
    if n and weight[-1] <= np.log2(DENSE * n):
        parts = max(2, int(np.ceil(weight[-1] / LINE)))
        known = components(linked(keyed(codes, parts, parts - 1)).filter("b is not null"), nodes)
        most = known.groupBy("root").agg(F.count("*").alias("n")).agg(F.max_by("root", F.struct("n", "root")).alias("root"), F.max("n").alias("n")).first()
        if most["n"] == n:
            return known
        sure = known.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))
        if n - most["n"] <= n // 4:
            apart = known.filter(F.col("root") != most["root"]).select(F.col("node").alias("c"))
    dealt = keyed(codes, bound + equal, equal)
    if apart is not None:
        dealt = dealt.join(keyed(apart, bound + equal, equal).select("key").distinct(), "key", "left_semi")
    found = linked(dealt)
    met = found.filter("b is not null")
    known = components(met if sure is None else met.unionByName(sure), nodes)
    crowded = found.filter("b is null").select(F.col("a").alias("key"))
    if crowded.isEmpty():
        return known
    known = written(known, "roots")
    met = written(dealt.join(crowded, "key", "left_semi").join(known, F.col("c") == F.col("node")).select("key", "c", "root"), "keys")
    for k in range(STARS + 1):
        if k < STARS:
            one = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("c", F.lit(k)).alias("h"), F.col("c").alias("c_"), F.col("root").alias("root_"))).alias("one")).select("key", "one.c_", "one.root_")
        else:
            counts = met.groupBy("key", "root").agg(F.count("*").alias("n"))
            most = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
            one = met.join(most, "key").filter("root <> most").select("key", F.col("c").alias("c_"), F.col("root").alias("root_"))
        near = met.join(one, "key").filter((F.col("root") != F.col("root_")) & (hamming(F.col("c"), F.col("c_")) <= bound))
        links = written(near.select(F.least("root", "root_").alias("a"), F.greatest("root", "root_").alias("b")).distinct(), "links")
        if not links.isEmpty():
            now = components(links, links.select(F.explode(F.array("a", "b")).alias("node"))).select(F.col("node").alias("was"), F.col("root").alias("low"))
            renamed = lambda df, now=now: df.join(now, F.col("root") == F.col("was"), "left").withColumn("root", F.coalesce("low", "root")).drop("was", "low")
            known = written(renamed(known), "roots")
            met = renamed(met)
        if k < STARS:
            mixed = met.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("key")
            met = written(met.join(mixed, "key", "left_semi"), "keys")
            if met.isEmpty():
                break
    return known


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node that each can reach over edges (a, b). A task finds them if there are few different
    edges. Otherwise labels spread by their minimum and by following roots, which halves the distance each round; every
    round is written to the shared folder. Raises RuntimeError if that doesn't settle."""
    ends = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    n, kind = ends.count(), dict(ends.dtypes)["u"]
    labels = nodes.select(F.col("node"), F.col("node").alias("root")).distinct()
    if not n:
        return labels
    if n <= SETTLED:

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if held := list(batches):
                node, root = _least_reached(*(np.concatenate([b[c].to_numpy() for b in held]) for c in ("u", "v")))
                yield pd.DataFrame({"moved": node, "low": root})

        low = ends.coalesce(1).mapInPandas(settle, f"moved {kind}, low {kind}")
        return written(labels.join(low, F.col("node") == F.col("moved"), "left").select("node", F.coalesce("low", "root").alias("root")), "roots")
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
    touched = written(labels.join(both.select(F.col("u").alias("node")).distinct(), "node", "left_semi"), "labels")
    for _ in range(rounds):
        near = both.join(touched.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        hooked = touched.join(near, F.col("node") == F.col("u")).select("node", "root", F.least("root", "r").alias("low"))
        jump = hooked.select(F.col("node").alias("j"), F.col("low").alias("far"))
        now = written(hooked.join(jump, F.col("low") == F.col("j")).select("node", F.col("root").alias("old"), F.least("low", "far").alias("root")), "labels")
        touched = now.select("node", "root")
        if not now.filter("root <> old").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.select("node").distinct().join(touched, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _named(groups: DataFrame, prefix: str, name: str) -> DataFrame:
    """`groups` (unique in root) plus a name by the place of its root: prefix and four digits at least."""
    return numbered(groups, ["root"], "__place").withColumn(name, F.format_string(f"{prefix}_%04d", "__place")).drop("__place")


def near_duplicate_groups(hashes: DataFrame, key: str, code: str, bound: int = 4) -> DataFrame:
    """(key, root, near_duplicate_group, duplicate_group_size): classes of rows whose codes are linked within `bound` bits.

    Links and components run over distinct codes; no list of pairs is made. Groups are named by the rank of their least key.
    """
    rows = hashes.select(F.col(key).alias("key"), F.col(code).alias("c"))
    codes = rows.select("c").distinct()
    roots = code_roots(written(codes.filter(F.col("c").isNotNull()), "codes"), bound)
    classed = rows.join(roots, F.col("c") == F.col("node")).select("key", F.col("root").alias("code_root"))
    groups = classed.groupBy("code_root").agg(F.min("key").alias("root"), F.count("*").alias("duplicate_group_size"))
    named = _named(groups, "dup", "near_duplicate_group")
    return classed.join(named, "code_root").select(F.col("key").alias(key), "root", "near_duplicate_group", "duplicate_group_size")


def merged_moments(a: tuple, b: tuple) -> tuple:
    """(counts, means, sums of squared deviations) of two sets of rows together, column by column; the order doesn't matter."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    off = b[1] - a[1]
    return n, a[1] + off * share, a[2] + b[2] + off * off * a[0] * share


def _moments_of(x: np.ndarray) -> tuple:
    there = ~np.isnan(x)
    n = there.sum(axis=0).astype(np.float64)
    mean = np.where(there, x, 0).sum(axis=0) / np.maximum(n, 1)
    return n, mean, np.where(there, (x - mean) ** 2, 0).sum(axis=0)


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and population deviations of columns by one state over all of them; nulls and NaN don't count.

    A task sends one state (three arrays); states are merged by groups of 64, then all, so no task takes more than that of
    a 64th. No rows give counts and means of zero.
    """
    state = "part int, n array<double>, mean array<double>, m2 array<double>"
    row = lambda part, s: pd.DataFrame({"part": [part], "n": [s[0]], "mean": [s[1]], "m2": [s[2]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                own = _moments_of(b[columns].to_numpy(np.float64, na_value=np.nan))
                total = own if total is None else merged_moments(total, own)
        if total is not None:
            yield row(hash(total[1].tobytes()) % 64, total)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [tuple(map(np.asarray, s)) for s in zip(pdf["n"], pdf["mean"], pdf["m2"], strict=True)]
        return row(0, reduce(merged_moments, states))

    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    found = numbers.mapInPandas(run, state).groupBy("part").applyInPandas(meet, state).collect()  # 64 rows at most
    none = (np.zeros(len(columns)),) * 3
    n, mean, m2 = reduce(merged_moments, [(np.array(r["n"]), np.array(r["mean"]), np.array(r["m2"])) for r in found], none)
    return n, mean, np.sqrt(m2 / np.maximum(n, 1))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1; a constant column becomes 0. No columns: nothing to do."""
    if not columns:
        return df
    _, mean, deviation = moments(df, columns)
    z = {c: (F.col(f"`{c}`").cast("double") - F.lit(float(m))) / F.lit(float(s) if s > 1e-12 * (1 + abs(m)) else 1.0) for c, m, s in zip(columns, mean, deviation, strict=True)}
    return df.select(*[z[c].alias(c) if c in z else F.col(f"`{c}`") for c in df.columns])


def linkage(x: np.ndarray, threshold: float, method: str, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of agglomerative clustering cut below `threshold`: average linkage on cosine distance (of unit vectors or means of
    them), or Ward on Euclidean. `sizes`: rows that each mean stands for (none: one each).

    Each row keeps its nearest other row, so a merge costs a pass over rows, not over the matrix; the matrix itself, which
    the update formulas need, is 8 n^2 bytes. Among equal distances the first pair in row order merges first.
    """
    n = len(x)
    size, label = np.ones(n) if sizes is None else np.array(sizes, np.float64), np.arange(n)
    d = linkage_distances(x, x, size, size, method, lambda d: d < threshold + 1e-6 * (1 + threshold))
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1) if n else np.empty(0, np.int64)
    least = d[np.arange(n), near]
    for _ in range(n - 1):
        i = int(least.argmin())
        if not least[i] < threshold:
            break
        i, j = sorted((i, int(near[i])))
        a, b = size[i], size[j]
        if method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = np.sqrt(np.maximum(((a + size) * d[i] ** 2 + (b + size) * d[j] ** 2 - size * d[i, j] ** 2) / (a + b + size), 0))
        new = np.round(new, 12)
        new[[i, j]] = np.inf
        new[np.isinf(d[i])] = np.inf
        d[i, :] = d[:, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i], label[label == label[j]] = a + b, label[i]
        stale = np.flatnonzero((near == i) | (near == j) | (new < least) | ((new == least) & (near > i)))
        stale = np.union1d(stale, [i, j])
        near[stale] = d[stale].argmin(axis=1)
        least[stale] = d[stale, near[stale]]
    return label


def linked(x: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, threshold: float, method: str) -> np.ndarray:
    """Labels as `linkage` gives them, from the pairs a < b nearer than the threshold: rounds in which mutual nearest
    neighbours merge. A merged cluster is no nearer to another than the nearer of its two parts, so only what was linked
    to one of them can be linked to it."""
    x, size, label, n = x.copy(), np.array(sizes, np.float64), np.arange(len(x)), len(x)
    while len(a):
        u, v, w = np.r_[a, b], np.r_[b, a], np.r_[d, d]
        order = np.lexsort((v, w, u))
        u, v = u[order], v[order]
        first = np.r_[True, u[1:] != u[:-1]]
        near = np.full(n, -1)
        near[u[first]] = v[first]
        i = u[first]
        i = i[(near[near[i]] == i) & (i < near[i])]
        j = near[i]
        x[i] = (x[i] * size[i, None] + x[j] * size[j, None]) / (size[i] + size[j])[:, None]
        size[i] += size[j]
        to, new = np.arange(n), np.zeros(n, bool)
        to[j], new[i] = i, True
        label = to[label]
        low, high = np.minimum(to[a], to[b]), np.maximum(to[a], to[b])
        touched = new[low] | new[high]
        old = ~touched
        pair = np.unique((low * n + high)[touched & (low < high)])
        low, high = pair // n, pair % n
        far = np.concatenate([pair_distances(x[p], x[q], size[p], size[q], method) for p, q in zip(np.array_split(low, 1 + len(low) // 65536), np.array_split(high, 1 + len(low) // 65536), strict=True)])
        ok = far < threshold
        a, b, d = np.r_[a[old], low[ok]], np.r_[b[old], high[ok]], np.r_[d[old], far[ok]]
    return label


def _by_links(clusters: DataFrame, edges: DataFrame, threshold: float, method: str, fit: int, kind: str) -> DataFrame:
    """(b, a): which cluster each that vanishes merges into, in the end; clusters: (id, size, vec), edges: (a, b, d).

    As `linked`, with a round's links in tables. Clusters without a link are done. When so few are left, or a component of
    the links has so few clusters and links, a task does the rest of it. Components are looked for every sixth round; the
    first time only if more than twice as many are left, as a round costs less than they do.
    """
    moves, number = [], 0

    def rest(key: tuple, pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        place = pd.Series(np.arange(len(pdf)), index=pdf["id"])
        a, b = (place[links[c]].to_numpy(np.int64) for c in ("a", "b"))
        label = linked(matrix(pdf["vec"]), pdf["size"].to_numpy(np.float64), a, b, links["d"].to_numpy(np.float64), threshold, method)
        gone = label != np.arange(len(pdf))
        return pd.DataFrame({"b": pdf["id"].to_numpy()[gone], "a": pdf["id"].to_numpy()[label[gone]]})

    def finished(of: DataFrame, own: DataFrame) -> DataFrame:
        return written(of.groupBy("part").cogroup(own.groupBy("part")).applyInPandas(rest, f"b {kind}, a {kind}"), "merged")

    @F.pandas_udf("double")
    def far(u: pd.Series, m: pd.Series, v: pd.Series, n: pd.Series) -> pd.Series:
        x, y = matrix(pd.concat([u, v])), len(u)
        return pd.Series(pair_distances(x[:y], x[y:], m.to_numpy(np.float64), n.to_numpy(np.float64), method))

    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        near = written(both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(F.col("a").alias("id"), F.col("m.b").alias("other")), "nearest")
        n, m = near.count(), edges.count()
        if not n:
            break
        clusters = clusters.select("id", "size", "vec", F.lit(0).alias("part")).join(near.select("id"), "id", "left_semi")
        if n <= LINKED * fit and m <= SPARSE * fit:
            moves.append(finished(clusters, edges.withColumn("part", F.lit(0))))
            break
        if number % 6 == 3 and (number > 3 or n > 2 * LINKED * fit or m > 2 * SPARSE * fit):
            roots = components(edges.select("a", "b"), near.select(F.col("id").alias("node"))).withColumnRenamed("root", "part")
            parted = written(clusters.drop("part").join(roots, F.col("id") == F.col("node")).drop("node"), "clusters")
            own = written(edges.join(roots, F.col("a") == F.col("node")).drop("node"), "links")
            few = parted.groupBy("part").agg(F.count("*").alias("n")).join(own.groupBy("part").agg(F.count("*").alias("m")), "part")
            small = written(few.filter((F.col("n") <= LINKED * fit) & (F.col("m") <= SPARSE * fit)).select("part"), "small")
            moves.append(finished(parted.join(small, "part", "left_semi"), own.join(small, "part", "left_semi")))
            clusters, edges = (written(t.join(small, "part", "left_anti").drop("part"), "left") for t in (parted, own))
            number += 1
            continue
        mutual = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
        merged = written(mutual.filter("n = 2").select("a", "b"), "merged")
        moves.append(merged.select("b", "a"))
        clusters = written(_merge(clusters, merged), "clusters")
        to = merged.select(F.explode(F.array("a", "b")).alias("was"), F.col("a").alias("now"))
        moved = edges.join(to.select(F.col("was").alias("a"), F.col("now").alias("a_")), "a", "left").join(to.select(F.col("was").alias("b"), F.col("now").alias("b_")), "b", "left")
        moved = written(moved, "moved")
        x, y = F.coalesce("a_", "a"), F.coalesce("b_", "b")
        new = moved.filter("a_ is not null or b_ is not null").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()
        new = new.join(clusters.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("vec").alias("u")), "a").join(clusters.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("vec").alias("v")), "b")
        new = new.select("a", "b", far("u", "m", "v", "n").alias("d")).filter(F.col("d") < threshold)
        edges = written(moved.filter("a_ is null and b_ is null").select("a", "b", "d").unionByName(new), "links")
        number += 1
    up = written(reduce(DataFrame.unionByName, moves, clusters.limit(0).select(F.col("id").alias("b"), F.col("id").alias("a"))), "moves")
    while True:  # each follows the one that its own merged into
        on = up.select(F.col("b").alias("k"), F.col("a").alias("far"))
        next_ = written(up.join(on, F.col("a") == F.col("k"), "left").select("b", F.coalesce("far", "a").alias("a"), F.col("far").isNotNull().alias("on")), "moves")
        up = next_.select("b", "a")
        if not next_.filter("on").limit(1).count():
            return up


def agglomerate(df: DataFrame, key: str, vector: str, threshold: float, method: str = "average", fit: int = FIT, block: int | None = None) -> DataFrame:
    """(key, root, visual_cluster_id, cluster_size): exact agglomerative clusters; root is a cluster's least key.

    Clusters are rows of a table: id (the least key), size and mean, from which both linkages give exact distances. Merges
    below the threshold never leave a connected component of the graph of pairs below it. Components of up to `fit` clusters
    are clustered in a task each (8 fit^2 bytes). Larger ones go by rounds: clusters that are each other's nearest neighbour
    merge, all at once, which leads to the same clusters as one merge after another, until so few are left or nothing merges.
    If rows have up to LINKS links below the threshold, these are found once and the rounds go over them (_by_links);
    otherwise each round looks for neighbours anew. Only blocks that the triangle inequality doesn't keep apart are
    compared. Equal vectors are one cluster from the start. Keys are unique; rows with a null key or vector are left out.
    """
    if method not in ("average", "ward"):
        raise ValueError(f"unknown method {method}")
    kind, radius = dict(df.dtypes)[key], euclidean_radius(threshold, method)
    rows = written(pack(df.filter(F.col(key).isNotNull()), key, vector, method == "average"), "packed")
    whole = F.col("vec") if method == "ward" else F.when(F.ltrim(F.hex("vec"), F.lit("0")) == "", F.concat("vec", F.col("id").cast("string").cast("binary"))).otherwise(F.col("vec"))
    joined = threshold > 0
    copies = rows.groupBy((whole if joined else F.col("id")).alias("same")).agg(F.min("id").alias("root"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    first = written(copies.select("same", F.col("root").alias("id"), "size", "vec"), "clusters")
    own = rows.select(F.col("id").alias("key"), (whole if joined else F.col("id")).alias("same")).join(first.select("same", "id"), "same").select("key", F.col("id").alias("now"))
    clusters = first.select("id", "size", "vec")
    if small := first.count() <= fit:  # all of them fit one task
        clusters = clusters.withColumn("part", F.lit(0))
    elif (edges := links(found := blocks(clusters, radius, block), threshold, method, kind, LINKS)) is not None:
        up = _by_links(clusters, edges, threshold, method, fit, kind)
        return _clustered(own.join(up, F.col("now") == F.col("b"), "left").select("key", F.coalesce("a", "now").alias("root")), key)
    else:
        roots = components(forest(found, threshold, method, kind), clusters.select(F.col("id").alias("node")))
        clusters = written(clusters.join(roots, F.col("id") == F.col("node")).select("id", "size", "vec", F.col("root").alias("part")), "clusters")
    moves, large = [], clusters.select("part").limit(0)
    while not small:
        large = clusters.groupBy("part").agg(F.count("*").alias("m")).filter(F.col("m") > fit).select("part")
        big = written(clusters.join(large, "part", "left_semi"), "big")
        near = written(nearest(blocks(big, radius, block), threshold, method, kind), "nearest") if not big.isEmpty() else None
        merged = None if near is None else written(near.alias("n").join(near.select(F.col("id").alias("i"), F.col("other").alias("o")), (F.col("other") == F.col("i")) & (F.col("n.id") == F.col("o")) & (F.col("n.id") < F.col("other"))).select(F.col("n.id").alias("a"), F.col("other").alias("b")), "merged")
        if merged is None or merged.isEmpty():
            break
        moves.append(merged)
        clusters = written(_merge(clusters, merged), "clusters")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        label = linkage(matrix(pdf["vec"]), threshold, method, pdf["size"].to_numpy(np.float64))
        return pd.DataFrame({"was": pdf["id"], "root": pdf.groupby(label)["id"].transform("min")})

    fine = clusters if small else clusters.join(large, "part", "left_anti")
    settled = fine.groupBy("part").applyInPandas(cut, f"was {kind}, root {kind}")
    if not small:
        settled = settled.unionByName(clusters.join(large, "part", "left_semi").select(F.col("id").alias("was"), F.col("id").alias("root")))
    for merged in moves:
        own = own.join(merged.select("a", "b"), F.col("now") == F.col("b"), "left").select("key", F.coalesce("a", "now").alias("now"))
    return _clustered(own.join(settled, F.col("now") == F.col("was")).select("key", "root"), key)


def _clustered(rooted: DataFrame, key: str) -> DataFrame:
    """Rows (key, root) with the name and size of their cluster."""
    out = written(rooted, "clustered")
    sizes = out.groupBy("root").agg(F.count("*").alias("cluster_size"))
    named = _named(sizes, "visual", "visual_cluster_id")
    return out.join(named, "root").select(F.col("key").alias(key), "root", "visual_cluster_id", "cluster_size")


def _merge(clusters: DataFrame, merged: DataFrame) -> DataFrame:
    """Clusters (id, size, vec, part) after b went into a: sizes added up, means weighted by them."""

    @F.pandas_udf("binary")
    def mean(u: pd.Series, m: pd.Series, v: pd.Series, n: pd.Series) -> pd.Series:
        both = zip(u, m, v, n, strict=True)
        return pd.Series([((np.frombuffer(a) * p + np.frombuffer(b) * q) / (p + q)).tobytes() for a, p, b, q in both], dtype=object)

    of = clusters.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("vec").alias("v"))
    new = clusters.join(merged, F.col("id") == F.col("a")).join(of, "b").select("id", (F.col("size") + F.col("n")).alias("size"), mean("vec", "size", "v", "n").alias("vec"), "part")
    gone = merged.select(F.explode(F.array("a", "b")).alias("id"))
    return clusters.join(gone, "id", "left_anti").unionByName(new)


def cluster_features(made: DataFrame, encoder: str = "handcrafted", threshold: float | None = None, bound: int = 4) -> DataFrame:
    """Feature rows with visual_cluster_id, cluster_size, near_duplicate_group and duplicate_group_size; rows with an error
    pass through without them. Vectors of a model go by average linkage on cosine distance, handcrafted features are
    standardised and go by Ward. A single valid row is a cluster of its own; no valid row gives no clusters. Clusters and
    near-duplicates don't need each other: their jobs run side by side."""
    fine = made.filter(F.col("error").isNull()).select("path", "feature", "dhash")
    if encoder == "handcrafted":
        width = fine.select(F.coalesce(F.max(F.size("feature")), F.lit(0))).first()[0]
        wide = standardise(fine.select("path", *[F.get("feature", F.lit(i)).cast("double").alias(f"f{i}") for i in range(width)]), [f"f{i}" for i in range(width)])
        vectors, method, limit = wide.select("path", F.array(*[f"f{i}" for i in range(width)]).cast("array<double>").alias("v")), "ward", WARD_THRESHOLD
    else:
        vectors, method, limit = fine.select("path", F.col("feature").cast("array<double>").alias("v")), "average", COSINE_THRESHOLD
    hashes, spark = fine.select("path", from_hex(F.col("dhash")).alias("code")), made.sparkSession
    shared_dir(spark)  # named once, before both
    with ThreadPoolExecutor(1) as beside:
        twins = beside.submit(inheritable_thread_target(spark)(near_duplicate_groups), hashes, "path", "code", bound)
        visual = agglomerate(vectors, "path", "v", limit if threshold is None else threshold, method).select(F.col("path").alias("p1"), "visual_cluster_id", "cluster_size")
    twins = twins.result().select(F.col("path").alias("p2"), "near_duplicate_group", "duplicate_group_size")
    return made.join(visual, F.col("path") == F.col("p1"), "left").join(twins, F.col("path") == F.col("p2"), "left").drop("p1", "p2")


def cluster_counts(clustered: DataFrame) -> DataFrame:
    """One row: valid records, visual clusters and near-duplicate groups (those of one image count)."""
    return clustered.agg(
        F.count("visual_cluster_id").alias("records"),
        F.count_distinct("visual_cluster_id").alias("visual_clusters"),
        F.count_distinct("near_duplicate_group").alias("near_duplicate_groups"),
    )


def split_kinds(values: list[str]) -> list[str]:
    """Asset types of an argument that may be repeated, hold commas, or both; none: no filter."""
    return list(dict.fromkeys(x for v in values for x in map(str.strip, v.split(",")) if x))


def representatives(rows: DataFrame, done: DataFrame, key: str = "path", cluster: str = "visual_cluster_id", size: str = "cluster_size", kind: str = "asset_type", least: int = 1, kinds: list[str] | None = None, overwrite: bool = False, limit: int = 0) -> DataFrame:
    """The first row (by key) of each cluster, largest clusters first. A cluster whose first row is done is left out."""
    sized = rows.withColumn("__size", safe_int(F.col(size).cast("string"))).filter(F.col("__size") >= least)
    fit = sized.filter(F.col(kind).isin(kinds)) if kinds else sized
    rest = [c for c in rows.columns if c != cluster]
    first = fit.groupBy(cluster).agg(F.min_by(F.struct(*rest), F.col(key)).alias("r"), F.max("__size").alias("max_size")).select(cluster, "r.*", "max_size")
    left = first if overwrite else first.join(done.select(key).distinct(), key, "left_anti")
    ordered = left.orderBy(F.desc("max_size"), cluster)
    return ordered.limit(limit) if limit > 0 else ordered
