"""Search at scale: many queries by block products, and top k from cells of an index with bounds on their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import numbered, written
from ..sources.files import exists
from .metric import matrix, pack
from .vectors import MODES, check_fields, clamp, index_facts, search

#: Bytes of query vectors and rows of results that a pass over the table takes along; rows and scores that a task has at once.
QUERY_BYTES, HELD, ROWS, SCORES = 32 << 20, 1 << 20, 1 << 12, 1 << 21
CELLS = 64


class Best:
    """The k best (score, id) of each query so far; of equal scores the lesser id. It may be merged in any order."""

    def __init__(self, queries: int, k: int, digits: int | None = None) -> None:
        self.k, self.digits, self.least = k, digits, np.full(queries, -np.inf)
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        self.more: list[tuple] = []
        self.held = 0

    def _rounded(self, scores: np.ndarray) -> np.ndarray:
        return scores if self.digits is None else np.round(scores, self.digits)

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """scores: a row for each id, a column for each query from `first` on. Only what may stay is rounded and kept."""
        own, slack = slice(first, first + scores.shape[1]), 0.0 if self.digits is None else 10.0**-self.digits
        hit = scores >= self.least[own] - slack
        if len(scores) >= self.k and np.count_nonzero(hit) > 4 * self.k * scores.shape[1]:
            self.least[own] = np.maximum(self.least[own], self._rounded(np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]))
            hit = scores >= self.least[own] - slack
        row, query = np.nonzero(hit)
        value = self._rounded(scores[row, query])
        keep = value >= self.least[own][query]
        self.more.append((query[keep] + first, value[keep], ids[row[keep]]))
        self.held += int(keep.sum())
        if self.held > 4 * self.k * len(self.least):
            self.trim()

    def trim(self) -> None:
        query, score, id_ = (np.concatenate(x) for x in zip((self.query, self.score, self.id), *self.more, strict=True))
        rows = pd.DataFrame({"q": query, "s": -score, "id": id_}).sort_values(["q", "s", "id"], kind="stable")
        rows = rows[rows.groupby("q").cumcount() < self.k]
        self.query, self.score, self.id = rows["q"].to_numpy(), -rows["s"].to_numpy(), rows["id"].to_numpy(object)
        self.more, self.held = [], len(rows)
        full = rows.groupby("q")["s"].agg(["size", "max"])
        full = full[full["size"] == self.k]
        self.least[full.index] = np.maximum(self.least[full.index], -full["max"].to_numpy())


def search_many(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", vector: str = "vector", query_key: str = "query", digits: int | None = None) -> DataFrame:
    """(query, rank, id, score): the k rows of `vectors` with the largest dot product, for each row of `queries`.

    A pass over the table takes as many queries along as fit QUERY_BYTES and have HELD results; a task multiplies its rows by
    all of them, SCORES products at a time, and sends k rows a query. No pair of rows is a row of a table. Equal scores
    (rounded to `digits`, if given) go to the lesser id. Null vectors are left out; keys are unique; no queries or no vectors
    give no rows.
    """
    k = clamp(k)
    asked = numbered(pack(queries, query_key, vector), ["id"], "place").select("place", "id", "vec")
    asked = written(asked, "queries")
    facts = asked.agg(F.count("*"), F.max(F.length("vec"))).first()
    kinds, step = (dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]), max(1, min(QUERY_BYTES // (facts[1] or 8), HELD // k))
    table, out = pack(vectors, key, vector), None
    table = written(table, "table") if facts[0] > step else table
    for first in range(0, facts[0], step):  # one pass, unless the queries or their results are too many for a task
        part = asked.filter((F.col("place") >= first) & (F.col("place") < first + step)).orderBy("place").toPandas()
        m = matrix(part["vec"])

        def best(batches: Iterator[pd.DataFrame], m=m) -> Iterator[pd.DataFrame]:
            top, wide = Best(len(m), k, digits), max(1, SCORES // ROWS)
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    own = batch.iloc[at : at + ROWS]
                    x, ids = matrix(own["vec"]), own["id"].to_numpy(object)
                    for q in range(0, len(m), wide):
                        top.add(x @ m[q : q + wide].T, ids, q)
            top.trim()
            yield pd.DataFrame({"place": top.query, "id": top.id, "score": top.score})

        names = part[["place", "id"]].assign(place=part["place"] - first)
        found = table.mapInPandas(best, f"place long, id {kinds[1]}, score double")
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "id"))
        ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        named = ranked.join(queries.sparkSession.createDataFrame(names.rename(columns={"id": "query"}), f"place long, query {kinds[0]}"), "place").select("query", "rank", "id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query {kinds[0]}, rank int, id {kinds[1]}, score double")
    return out.select(F.col("query").alias(query_key), "rank", F.col("id").alias(key), "score")


# Cells with bounds.


def write_cells(index: DataFrame, root: str, cells: int = CELLS) -> None:
    """Write an index (path, ordinal, field, position, text, valid, vector) by cells of like paths, beside a summary: for each
    cell and field the centre of the valid vectors and the largest distance from it, and the cell's number of paths.

    A path's cell is that of its first valid field's nearest pivot (paths without one have a cell of their own, -1). The
    pivots are vectors of the index, chosen by hash; they decide what a search spares, not what it finds.
    """
    spark = index.sparkSession
    vec = pack(index.filter("valid").withColumn("k", F.struct("path", "ordinal", "field", "position")), "k", "vector")
    vec = written(vec.select("id.*", "vec"), "vectors")
    pivots = matrix(vec.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(cells).toPandas()["vec"])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = matrix(pdf["vec"])
                d = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
                yield pdf.drop(columns="vec").assign(cell=d.argmin(axis=1))

    kind = dict(index.dtypes)
    first = vec.groupBy("path", "ordinal").agg(F.min_by("vec", "position").alias("vec")).mapInPandas(place, f"path {kind['path']}, ordinal {kind['ordinal']}, cell long")
    dealt = index.join(first, ["path", "ordinal"], "left").withColumn("cell", F.coalesce("cell", F.lit(-1)))
    dealt.repartition("cell", F.pmod(F.xxhash64("path"), F.lit(8))).write.partitionBy("cell").parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    own = rows.filter("valid").select("cell", "field", F.col("vector").cast("array<double>").alias("v"))
    long = own.select("cell", "field", F.posexplode("v").alias("k", "x"))
    centre = long.groupBy("cell", "field", "k").agg(F.avg("x").alias("x")).groupBy("cell", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("centre"))
    centre = written(centre, "centres")
    away = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    radius = own.join(centre, ["cell", "field"]).withColumn("away", away).groupBy("cell", "field").agg(F.max("away").alias("radius"))
    paths = rows.groupBy("cell").agg(F.count_distinct("path", "ordinal").alias("paths"))
    paths.join(centre.join(radius, ["cell", "field"]), "cell", "left").coalesce(1).write.parquet(f"{root}/summary")  # a row for each cell and field


def _bounds(summary: pd.DataFrame, query: np.ndarray, chosen: list[str], mode: str) -> pd.DataFrame:
    """(cell, paths, most): no path of the cell has a larger score."""
    size = float(np.linalg.norm(query))
    rows = []
    for cell, own in summary.groupby("cell"):
        tops = [float(np.dot(query, np.asarray(c, np.float64)) + size * r) for f, c, r in zip(own["field"], own["centre"], own["radius"], strict=True) if f in chosen]
        most = sum(max(t, 0.0) for t in tops) if mode == "sum" and any(t > 0 for t in tops) else max(tops, default=-1.0)
        rows.append((cell, int(own["paths"].iloc[0]), max(most, -1.0) + 1e-6 * (1 + size)))
    return pd.DataFrame(rows, columns=["cell", "paths", "most"]).sort_values(["most", "cell"], ascending=[False, True], ignore_index=True)


def search_cells(spark: SparkSession, root: str, query: str, encoder: Callable[[list[str]], np.ndarray], fields: list[str] | None = None, top: int = 10, mode: str = "max") -> tuple[DataFrame, list[int]]:
    """As vectors.search, over what write_cells wrote; and the cells that were read.

    A dot product is at most the centre's plus radius times the query's length. The cells with the largest bounds that hold
    `top` paths are searched first; their last score is what a further cell's bound must reach to be read at all.
    """
    if mode not in MODES:
        raise ValueError(f"score mode {mode}; known: {', '.join(MODES)}")
    if not exists(spark, f"{root}/summary"):
        raise FileNotFoundError(root)
    summary = spark.read.parquet(f"{root}/summary").toPandas()
    rows = spark.read.parquet(f"{root}/rows")
    known = index_facts(rows)[1]
    chosen, vector = check_fields(fields, known), np.asarray(encoder([query])[0], np.float64)
    bounds = _bounds(summary, vector, chosen, mode)
    first = bounds["cell"][: int((bounds["paths"].cumsum() < clamp(top)).sum()) + 1].tolist()
    within = lambda cells: rows.filter(F.col("cell").isin(cells)).drop("cell")
    some = [r["score"] for r in search(within(first), query, encoder, fields, top, mode, known).select("score").collect()]
    least = min(some) if len(some) == clamp(top) else -np.inf
    cells = sorted({*first, *bounds["cell"][bounds["most"] >= least].tolist()})
    return search(within(cells), query, encoder, fields, top, mode, known), cells
