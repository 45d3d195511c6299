"""Quality rules with risk-controlled thresholds.

Rules are ratios over whole texts. Labelled documents are split in two by a hash of their id. The tuning half sets,
for each stratum and each level of strictness, one cutoff per rule: the strictest at which at most that share of good
documents would go, kept only where it removes bad documents LIFT times as often. The holdout half then tests the
levels from the mildest on: a level is certified if the exact (Clopper-Pearson) upper bound on the share of good
documents that it rejects is at most `risk`; testing stops at the first level that isn't. Tests within a stratum have a
fixed sequence and so share one error; strata share `delta` by Bonferroni. Of the certified levels the mildest holds
that catches ENOUGH of the bad tuning documents that the last one catches; it rejects no document that the last keeps.

A stratum needs log(delta / strata) / log(1 - risk) good holdout labels for its first certificate: 86 with four strata,
risk 0.05 and delta 0.05. A stratum with fewer labels keeps what the base rules keep.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, written

WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
LEVELS = (0.0, 0.0002, 0.0005, 0.001, 0.002, 0.004, 0.008)
LIFT, ENOUGH = 3.0, 0.98
#: rule: SQL over the measured columns, and the grid of cutoffs from mild to strict; a document fails where its value is above.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5, 6.0]),
    "short_words": ("- word_chars / greatest(n_words, 1)", [-1.0, -1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25, -4.5]),
    "few_words": ("- n_words", [-50.0, -55.0, -60.0, -70.0, -80.0, -90.0, -100.0, -120.0, -150.0, -200.0, -300.0]),
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

_symbols = re.compile(f"[{re.escape(SYMBOLS)}]")


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The columns of MEASURES for one whole text; words are runs without ASCII white space, null has none."""
    raw = (text or "").encode()
    words = raw.split()
    seen: set[bytes] = set()
    n_lines = n_dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    known = set(windows)
    repeats = 0
    if len(known) < len(windows):
        met: set = set()
        twice = {w for w in windows if w in met or met.add(w)}
        end = 0  # words before this place are counted
        for k, w in enumerate(windows):
            if w in twice:
                repeats += k + WINDOW - max(k, end)
                end = k + WINDOW
    joined = b"".join(words)
    return len(words), len(joined.decode()), len(_symbols.findall(text or "")), n_lines, n_dup, repeats


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the struct column `measures` (MEASURES) of each whole text; a column of that name is replaced."""

    @F.pandas_udf(MEASURES)
    def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for part in texts:
            yield pd.DataFrame([measure(x) for x in part], columns=names)

    return docs.withColumn("measures", measures(F.col(f"`{text_col}`")))


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """Exact one-sided upper confidence bound (Clopper-Pearson) for a binomial share: the p at which P(X <= rejected) = delta."""
    if n == 0 or rejected >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(rejected + 1)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(max(mid, 1e-300)) > delta else (low, mid)
    return high


def _names(prefix: str) -> list[str]:
    return [f"{prefix}_{rule}" for rule in RULES]


def _values() -> list:
    return [F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"measures.\1", sql)).cast("double").alias(f"value_{rule}") for rule, (sql, _) in RULES.items()]


def _paths(counts: pd.DataFrame) -> pd.DataFrame:
    """One stratum's tuning counts (rows: good 0 and 1) to cutoffs per level, one array per rule; null: the rule is off."""
    good, bad = (counts[counts["good"] == x].sum(numeric_only=True) for x in (1, 0))
    row: dict = {"stratum": counts["stratum"].iloc[0]}
    for rule, (_, grid) in RULES.items():
        path = []
        for level in LEVELS:
            cut = None
            for k, c in enumerate(grid):
                lost, caught = good[f"{rule}_{k}"] / max(good["n"], 1), bad[f"{rule}_{k}"] / max(bad["n"], 1)
                if lost > level:
                    break
                cut = c if good["n"] and caught > 0 and caught >= LIFT * lost else cut
            path.append(cut)
        row[f"cuts_{rule}"] = path
    return pd.DataFrame([row])


def _fails(level: int | None) -> F.Column:
    """Whether a document fails one of the rules at a level of the path (None: at the chosen cutoff)."""
    at = [F.col(f"value_{r}") > (F.element_at(F.col(f"cuts_{r}"), level + 1) if level is not None else F.col(f"cut_{r}")) for r in RULES]
    return F.coalesce(F.array_max(F.array(*[F.coalesce(x, F.lit(False)) for x in at])), F.lit(False))


def calibrate(scored: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per stratum: stratum, level (null: none certified), bound (of the last certified level, which holds for all
    milder ones), and cut_<rule> (null: off).

    `scored` has `measures`; an id that repeats in it counts as often as it occurs; `labels` has id_col and label_col (1 good, 0 bad, else ignored; an id labelled both ways
    counts as bad). All labelled documents count. Without labels, or with an empty table, nothing is certified and nothing is rejected.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"))
    slim = scored.select(F.col(f"`{id_col}`").alias("id"), stratum(stratum_col).alias("stratum"), *_values())
    known = written(slim.join(marks, "id").withColumn("holdout", F.pmod(F.xxhash64("id"), F.lit(2))), "labelled")
    sums = [F.sum((F.col(f"value_{r}") > c).cast("long")).alias(f"{r}_{k}") for r, (_, grid) in RULES.items() for k, c in enumerate(grid)]
    tuned = known.filter("holdout = 0").groupBy("stratum", "good").agg(F.count("*").alias("n"), *sums)
    paths = written(tuned.groupBy("stratum").applyInPandas(_paths, "stratum string, " + ", ".join(f"{c} array<double>" for c in _names("cuts"))), "paths")
    good, bad = F.expr("holdout = 1 and good = 1"), F.expr("holdout = 0 and good = 0")
    lost = [F.count_if(good & _fails(k)).alias(f"lost_{k}") for k in range(len(LEVELS))]
    caught = [F.count_if(bad & _fails(k)).alias(f"caught_{k}") for k in range(len(LEVELS))]
    held = known.join(paths, "stratum").groupBy("stratum").agg(F.count_if(good).alias("n"), *lost, *caught)
    share = delta / max(paths.count(), 1)

    @F.pandas_udf("level int, bound double")
    def certified(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            level, bound = None, None
            for k in range(len(LEVELS)):
                if (p := upper_bound(row[f"lost_{k}"], row["n"], share)) > risk:
                    break
                level, bound = k, p
            if level is not None:
                level = next(k for k in range(level + 1) if row[f"caught_{k}"] >= ENOUGH * row[f"caught_{level}"])
            out.append((level, bound))
        return pd.DataFrame(out, columns=["level", "bound"]).astype({"level": "Int32", "bound": "float64"})

    chosen = held.select("stratum", certified(F.struct("n", *[f"{x}_{k}" for x in ("lost", "caught") for k in range(len(LEVELS))])).alias("c")).select("stratum", "c.level", "c.bound")
    cuts = [F.element_at(F.col(f"cuts_{r}"), F.col("level") + 1).alias(f"cut_{r}") for r in RULES]
    return written(paths.join(chosen, "stratum").select("stratum", "level", "bound", *cuts), "cutoffs")


def stratum(column: str) -> F.Column:
    """The stratum as text; null is a stratum of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("null"))


def decide(scored: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """`scored` plus `verdict` (a column of that name is replaced), a struct of base_failed, kept, level and bound.

    The table of cutoffs has a row per stratum and is read from files, so Spark knows its size and broadcasts it only
    below its threshold.
    """
    base = (F.col("measures.n_words") < MIN_WORDS) | (100 * F.col("measures.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("measures.n_words"))
    at = cutoffs.select(F.col("stratum").alias("__stratum"), F.struct("*").alias("__cuts"))
    met = scored.join(at, stratum(stratum_col) == F.col("__stratum"), "left")
    value = dict(zip(RULES, _values(), strict=True))
    fails = [F.coalesce(value[r] > F.col(f"__cuts.cut_{r}"), F.lit(False)) for r in RULES]
    kept = ~base & ~F.array_contains(F.array(*fails), True)
    return met.withColumn("verdict", F.struct(base.alias("base_failed"), kept.alias("kept"), F.col("__cuts.level").alias("level"), F.col("__cuts.bound").alias("bound"))).drop("__stratum", "__cuts")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: the measures of every document and whether it stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = written(measured(docs).drop("text"), "measured")
    rules = decide(scored, calibrate(scored, read(spark, sf_dir, "labels")))
    return rules.select("doc_id", *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "verdict.base_failed", "verdict.kept", "verdict.level", "verdict.bound")
