"""Vector codes: product quantisation in whole numbers, the nearest entries found by VA-file filtering.

Coordinates become whole numbers, vectors are cut into parts, and each part position has a small codebook. To find a
part's nearest entry, entry coordinates are quantised to BITS bits: each coordinate lies in a cell of its axis. For each
query, tables of squared distances to the nearer and to the farther end of every cell give, added up over the axes, a
lower and an upper bound for every entry. Only entries whose lower bound reaches down to the least upper bound are
refined by exact integer distances, so that the result is that of a full search, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, written

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 8, 16, 6, 4096, 3
#: Coordinates below this are exact in 64-bit arithmetic (a squared distance of up to 32 of them); larger ones take Python's integers.
NARROW = 1 << 28
QUERIES = 1 << 12
LIMB, LIMBS = 40, 4
MOST = (1 << 63) - 1


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact for any finite x; of dtype object if a value is NARROW or more."""
    if not x.size or np.abs(x).max() * SCALE < NARROW:
        return np.floor(x.astype(np.float64) * SCALE).astype(np.int64)
    exact = lambda v: int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE))
    return np.array([exact(float(v)) for v in x.ravel()], object).reshape(x.shape)


class Approximation:
    """Entries (rows of whole numbers) with the cells of their coordinates: `cell[e, k]` is the place, among the occupied cells
    of axis k, of entry e's coordinate; `low` and `high` are those cells' ends, drawn in to the coordinates they hold."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        self.axes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for axis in entries.T:
            least = axis.min()
            cell = ((axis - least) * (1 << bits) // (axis.max() - least + 1)).astype(np.int64)
            used, cell = np.unique(cell, return_inverse=True)
            low = np.array([axis[cell == c].min() for c in range(len(used))], entries.dtype)
            high = np.array([axis[cell == c].max() for c in range(len(used))], entries.dtype)
            self.axes.append((cell, low, high))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each query to each entry."""
        lower = np.zeros((len(queries), len(self.entries)), self.entries.dtype)
        upper = lower.copy()
        for (cell, low, high), q in zip(self.axes, queries.T, strict=True):
            below, above = low - q[:, None], q[:, None] - high
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            lower += (near * near)[:, cell]
            upper += (far * far)[:, cell]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each query's nearest entry (the first of equally near ones) and the squared distance."""
        lower, upper = self.bounds(queries)
        at, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        off = queries[at] - self.entries[entry]
        exact = (off * off).sum(axis=1)
        order = np.lexsort((entry, exact, at)) if exact.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], exact[i], entry[i])), np.int64)
        first = order[np.concatenate(([True], np.diff(at[order]) > 0))] if len(order) else order
        return entry[first], exact[first]


def _assigned(part: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    wide = part.dtype == object or any(abs(v) >= NARROW for e in book for v in e)
    kind = object if wide else np.int64
    index, blocks = Approximation(np.array(book, kind)), [part[k : k + QUERIES].astype(kind) for k in range(0, len(part), QUERIES)]
    found = [index.nearest(b) for b in blocks]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return whole_numbers(out)


def codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """By part position, the entries after so many rounds; kept: (id, v), v not null and finite.

    A task adds up its own parts by entry; what meets then is parts * entries rows a task, of sums in limbs of 40 bits, so
    that they are exact whatever the number of rows (2^23 tasks). The driver holds the codebooks alone.
    """
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toPandas()
    seeds, step = _matrix(first["v"], width), width // parts
    books = [[[int(x) for x in row[p * step : (p + 1) * step]] for row in seeds] for p in range(parts)]
    names = [f"s{i}" for i in range(LIMBS)]
    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], books=books) -> Iterator[pd.DataFrame]:
            total: dict[tuple[int, int], list] = {}
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["v"], width)
                for p, book in enumerate(books):
                    own = x[:, p * step : (p + 1) * step]
                    at, _ = _assigned(own, book)
                    for e in np.unique(at):
                        mine = own[at == e]
                        t = total.setdefault((p, int(e)), [0, [0] * step])
                        t[0] += len(mine)
                        t[1] = [a + int(b) for a, b in zip(t[1], mine.sum(axis=0), strict=True)]
            rows = [(p, e, n, k, v) for (p, e), (n, vs) in total.items() for k, v in enumerate(vs)]
            split = [[(v >> LIMB * i) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [v >> LIMB * (LIMBS - 1)] for *_, v in rows]
            yield pd.concat([pd.DataFrame([r[:4] for r in rows], columns=["p", "e", "n", "k"]), pd.DataFrame(split, columns=names)], axis=1)

        schema = "p int, e int, n long, k int, " + ", ".join(f"{s} long" for s in names)
        met = kept.select("v").mapInPandas(sums, schema).groupBy("p", "e", "k").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        books = [[list(e) for e in book] for book in books]
        for r in met.collect():  # parts * entries * step rows
            books[r["p"]][r["e"]][r["k"]] = sum(r[s] << LIMB * i for i, s in enumerate(names)) // r["n"]
    return books


def encode(df: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """`df` (its rows whose vector is whole and finite) plus `coded` (a column of that name is replaced): a struct of code and
    error; and the codebooks.

    Rows whose vector is null or holds null, infinite or NaN components are left out. The codebooks begin with the vectors
    of the `entries` least ids (nulls last, ties by vector; fewer rows give fewer entries). A vector shorter than the widest
    one, rounded up to a multiple of `parts`, counts as filled with zeros; so does an empty one (one component a part at least). Repeated rows count as often
    as they stand. An error beyond 64 bits is the largest 64-bit number. No rows left: an empty table and empty codebooks.
    """
    v = F.col(f"`{vector_col}`")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.filter(sound).select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "coded"]).alias("row"), F.col(f"`{id_col}`").alias("id"), v.alias("v"))
    width = kept.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return df.drop("coded").withColumn("coded", F.lit(None).cast("struct<code: string, error: bigint>")).limit(0), [[] for _ in range(parts)]
    width = -(-max(width, 1) // parts) * parts
    books, step = codebooks(kept.select("id", "v"), width, parts, entries, rounds), width // parts

    @F.pandas_udf("code string, error long")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch, width)
            found = [_assigned(x[:, p * step : (p + 1) * step], book) for p, book in enumerate(books)] if len(x) else []
            hexes = np.array([f"{i:02x}" for i in range(max(256, entries))])
            text = hexes[np.stack([f[0] for f in found], axis=1)] if found else []
            total = sum(f[1].astype(object) for f in found) if found else []
            yield pd.DataFrame({"code": ["".join(t) for t in text], "error": [min(int(e), MOST) for e in total]})

    return kept.select("row", code("v").alias("coded")).select("row.*", "coded"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Contract query: code, error and its sum over the label for every sound vector, and the hash of the codebooks."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = encode(table, "vec_id", "embedding")
    coded = written(coded.select("vec_id", "label", "coded.*"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(numbers), 256).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by SQL: parts as rows (p, id, v), and a codebook (p, e, v) for each round."""
    nearest = "select x.p, x.vec_id, arg_min(b.e, (list_sum(list_transform(range(1, 9), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k])))::bigint, b.e)) as e, min(list_sum(list_transform(range(1, 9), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k])))::bigint) as error from parts x join {book} b using (p) group by x.p, x.vec_id"
    steps = [
        "whole as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as w from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "parts as materialized (select p, vec_id, w[8 * p + 1 : 8 * p + 8] as v from whole, range(8) t(p))",
        "b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from parts where vec_id in (select vec_id from whole order by vec_id limit 16))",
    ]
    for k in range(ROUNDS):
        steps.append(f"a{k} as materialized ({nearest.format(book=f'b{k}')})")
        mean = ", ".join(f"(sum(v[{i}]) // count(*) - case when sum(v[{i}]) % count(*) < 0 then 1 else 0 end)::bigint" for i in range(1, 9))
        steps.append(f"b{k + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{k} b left join (select p, e, [{mean}] as v from a{k} join parts using (p, vec_id) group by p, e) m using (p, e))")
    steps.append(f"final as materialized ({nearest.format(book=f'b{ROUNDS}')})")
    steps.append("codes as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(error)::bigint as error from final group by vec_id)")
    steps.append(f"books as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from b{ROUNDS})")
    return "with " + ",\n".join(steps) + "\nselect c.vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from codes c join whole using (vec_id), books"


ORACLE = _oracle()
