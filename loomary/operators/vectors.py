"""Search over vectors by field: build, score, combine, top k, upsert and delete; zero-shot labels."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_placeholder, normalize_text
from ..functions.vectors import dot, literal
from .stores import upsert, without

MODES = ("max", "mean", "sum")


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model: signed hashes of character trigrams, scaled to length one."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for k in range(max(1, len(text) - 2)):
                h = int.from_bytes(hashlib.blake2b(text[k : k + 3].encode(), digest_size=8).digest(), "big")
                row[h % dimensions] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out

    return encode


def encode_column(text: Column, encoder: Callable[[list[str]], np.ndarray]) -> Column:
    """Vectors of texts, batch by batch; the encoder is loaded once per task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(encoder(part.fillna("").tolist())))

    return run(text)


def build_index(records: DataFrame, fields: list[str], encoder: Callable[[list[str]], np.ndarray], model: str = "") -> DataFrame:
    """(path, ordinal, field, position, text, valid, vector, model) of rows (path, ordinal, fields ..). Repeated paths stay.

    Fields that hold a placeholder are encoded as empty text and are not valid. No records: ValueError.
    """
    if records.isEmpty():
        raise ValueError("no caption records to index")
    return encoded(records, fields, encoder, model)


def encoded(records: DataFrame, fields: list[str], encoder: Callable[[list[str]], np.ndarray], model: str = "") -> DataFrame:
    """The index rows of records, however many. Each distinct text is encoded once; the blank of all invalid fields, which is
    the most common one, is encoded here and takes no part in the join that gives the others their vectors."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("position"), normalize_text(F.col(f)).alias("text")) for k, f in enumerate(fields)])
    long = records.select("path", "ordinal", F.explode(parts).alias("p")).select("path", "ordinal", "p.*").withColumn("valid", ~is_placeholder(F.col("text")))
    texts = long.filter("valid").select(F.col("text").alias("__text")).distinct()
    vectors = texts.withColumn("vector", encode_column(F.col("__text"), encoder))
    met = long.filter("valid").join(vectors, F.col("text") == F.col("__text")).drop("__text")
    blank = long.filter("not valid").withColumn("vector", literal(encoder([""])[0].tolist()).cast("array<float>"))
    return met.unionByName(blank).withColumn("model", F.lit(model))


def index_facts(index: DataFrame) -> tuple[str | None, list[str]]:
    """(model, fields in order) of an index, from its distinct combinations (a row per field)."""
    own = index.select("field", "position", *(["model"] if "model" in index.columns else [F.lit("").alias("model")])).distinct().orderBy("position").collect()
    return (own[0]["model"] or None if own else None), list(dict.fromkeys(r["field"] for r in own))


def active_model(index: DataFrame | None, default: str) -> str:
    """The index's model, or the default where there is no index or it names none."""
    return (index_facts(index)[0] if index is not None else None) or default


_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def cached_encoder(model: str, load: Callable[[str], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """An encoder that a Python worker loads at its first use and keeps."""

    def encode(texts: list[str]) -> np.ndarray:
        if model not in _MODELS:
            _MODELS[model] = load(model)
        return _MODELS[model](texts)

    return encode


def loaded_models() -> list[str]:
    return sorted(_MODELS)


def unload_models(*models: str) -> list[str]:
    """Forget models (none named: all) and say which were there."""
    return [m for m in models or loaded_models() if _MODELS.pop(m, None) is not None]


def check_fields(selected: list[str] | None, known: list[str]) -> list[str]:
    """None or empty: all; repeats collapse; an unknown one raises ValueError."""
    chosen = list(dict.fromkeys(selected or known))
    if bad := [f for f in chosen if f not in known]:
        raise ValueError(f"unknown field {', '.join(bad)}; known: {', '.join(known)}")
    return chosen


def combined(scores: list[tuple[str, Column, Column]], mode: str) -> tuple[Column, Column, Column]:
    """(score, best field, scores by field) of (field, score, valid) triples: the largest, mean or sum of the valid ones.

    Without a valid one the score is -1, the field empty, the map empty. Earlier fields win ties.
    """
    if mode not in MODES:
        raise ValueError(f"score mode {mode}; known: {', '.join(MODES)}")
    all_ = F.array(*[F.struct(F.when(v, s).alias("score"), F.lit(-k).alias("place"), F.lit(f).alias("field")) for k, (f, s, v) in enumerate(scores)])
    valid = F.filter(all_, lambda x: x["score"].isNotNull())
    total = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x["score"])
    best = F.array_max(valid)
    value = {"max": best["score"], "sum": total, "mean": total / F.size(valid)}[mode]
    score = F.when(F.size(valid) == 0, -1.0).otherwise(value)
    by_field = F.map_from_entries(F.transform(valid, lambda x: F.struct(x["field"], x["score"])))
    return score, F.coalesce(best["field"], F.lit("")), by_field


def check_request(query: str, top: int, mode: str, most: int = 100) -> None:
    """What a service asks of a request; the library itself clamps."""
    if not query:
        raise ValueError("the query is empty")
    if not 1 <= top <= most:
        raise ValueError(f"top_k is 1 to {most}")
    if mode not in MODES:
        raise ValueError(f"score mode {mode}; known: {', '.join(MODES)}")


def clamp(k: int) -> int:
    """The least number of results is one; Spark's limit handles a k above the number of rows."""
    return max(1, k)


def top_k(scored: DataFrame, k: int, *tie: str) -> DataFrame:
    """Best scores first, ties by `tie`; each task keeps k rows, no full sort."""
    return scored.orderBy(F.col("score").desc(), *tie).limit(clamp(k))


def score_wide(df: DataFrame, query: dict[str, list[float]] | list[float], vectors: dict[str, Column], valid: dict[str, Column], mode: str, digits: int | None = None) -> DataFrame:
    """`df` plus score, best_field and field_scores for vectors held in columns; each row is scored where it lies."""
    rows = []
    for f, v in vectors.items():
        s = dot(v, literal(query[f] if isinstance(query, dict) else query))
        rows.append((f, F.round(s, digits) if digits is not None else s, valid[f]))
    score, best, by_field = combined(rows, mode)
    return df.withColumn("score", score).withColumn("best_field", best).withColumn("field_scores", by_field)


def search(index: DataFrame, query: str, encoder: Callable[[list[str]], np.ndarray], fields: list[str] | None = None, top: int = 10, mode: str = "max", known: list[str] | None = None) -> DataFrame:
    """The best paths of a long index: path, ordinal, score, best_field, field_scores, fields.

    The query is a literal, so nothing is joined; an index partitioned by field reads the chosen fields only. `known` names
    the index's fields; without it they are looked up. Only scores are aggregated; texts are fetched for the top rows.
    """
    known = known if known is not None else index_facts(index)[1]
    if not known:
        return index.select("path", "ordinal", F.lit(0.0).alias("score"), F.lit("").alias("best_field"), F.create_map(F.lit(""), F.lit(0.0)).alias("field_scores"), F.create_map(F.lit(""), F.lit("")).alias("fields")).limit(0)
    chosen, vector = check_fields(fields, known), literal(encoder([query])[0].tolist())
    if mode not in MODES:
        raise ValueError(f"score mode {mode}; known: {', '.join(MODES)}")
    scored = index.filter(F.col("field").isin(chosen)).select("path", "ordinal", "field", "position", F.when(F.col("valid"), dot(F.col("vector"), vector)).alias("s"))
    value = {"max": F.max("s"), "mean": F.avg("s"), "sum": F.sum("s")}[mode]
    rows = scored.groupBy("path", "ordinal").agg(
        F.coalesce(value, F.lit(-1.0)).alias("score"),
        F.coalesce(F.max_by("field", F.when(F.col("s").isNotNull(), F.struct("s", -F.col("position")))), F.lit("")).alias("best_field"),
        F.map_from_entries(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("field", "s")))).alias("field_scores"),
    )
    best = top_k(rows, top, "ordinal", "path")
    texts = index.select(F.col("path").alias("p"), F.col("ordinal").alias("o"), "field", "text").join(best.select(F.col("path").alias("p"), F.col("ordinal").alias("o")), ["p", "o"], "left_semi")
    own = texts.groupBy("p", "o").agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("fields"))
    met = best.join(own, F.col("path").eqNullSafe(F.col("p")) & F.col("ordinal").eqNullSafe(F.col("o")), "left").drop("p", "o")
    return top_k(met, top, "ordinal", "path")


def upsert_paths(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of their paths and stand at the end; the index's own fields and model hold."""
    model, known = index_facts(index)
    if not known:
        return rows
    own = rows.filter(F.col("field").isin(known)).withColumn("ordinal", F.col("ordinal") - F.lit(rows.agg(F.coalesce(F.min("ordinal"), F.lit(0))).first()[0]))
    moved = upsert(index, own)
    return moved.withColumn("model", F.lit(model or "")) if "model" in index.columns else moved.select(*index.columns)


def remove_paths(index: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index without the paths, and one row with the number of paths' rows removed."""
    gone = paths.select("path").distinct()
    return without(index, gone), index.join(gone, "path", "left_semi").agg(F.count_distinct("path", "ordinal").alias("removed"))


def zero_shot(df: DataFrame, key: str, vector: str, labels: list[tuple[str, list[float]]], digits: int | None = None) -> DataFrame:
    """(key, label, score, margin, scores): the best label, earlier ones winning ties, its lead over the second, and all scores."""
    score = lambda v: F.round(dot(F.col(vector), literal(v)), digits) if digits is not None else dot(F.col(vector), literal(v))
    all_ = F.sort_array(F.array(*[F.struct(score(v).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("label")) for k, (name, v) in enumerate(labels)]), asc=False)
    ranked = df.select(key, all_.alias("all"))
    best, second = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    return ranked.select(key, best["label"].alias("label"), best["score"].alias("score"), (best["score"] - F.coalesce(second["score"], F.lit(0.0))).alias("margin"), F.map_from_entries(F.transform("all", lambda x: F.struct(x["label"], x["score"]))).alias("scores"))
