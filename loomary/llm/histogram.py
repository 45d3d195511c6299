"""Exact splitters of a weighted key order by iterated histograms (histogram sort), in DataFrame operations only.

A key is a pair of longs. The first histogram has CELLS cells over the range of the first part. Each splitter then
looks into the cell that holds its target: that cell is cut into finer cells, first by the first part of the key and,
once that has a single value left (a group of equal first parts, however large), by the second. Counts are exact, so
each refinement is. Splitters are refined in groups, so that the driver reads ROUND counts at a time at most, whatever the
size of the input; what it keeps is one splitter a range.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 14
ROUND = 1 << 16
#: Finer cells of a cell, at least.
LEAST = 8
LOW = -(1 << 63)


@dataclass(frozen=True)
class Cell:
    """Keys from (low1, low2) to (high1, high2) that occur; their weight and rows, and those below them."""

    low1: int
    high1: int
    low2: int
    high2: int
    weight: int
    rows: int
    below: int
    rows_below: int
    first: bool  # it holds all keys with its first parts

    @property
    def by(self) -> int:
        return 1 if self.low1 < self.high1 else 2

    @property
    def single(self) -> bool:
        return self.by == 2 and self.low2 == self.high2


@dataclass(frozen=True)
class Split:
    """Rows with (key1, key2) >= this key lie above; `below` and `rows_below` are the exact sums of the others."""

    key1: int
    key2: int
    below: int
    rows_below: int


@dataclass(frozen=True)
class Ranges:
    """Splitters, and how rows find their range: by the first histogram's cell, then by the few splitters in it."""

    splits: list[Split]
    first: int
    last: int
    step: int
    weight: int
    rows: int

    def assign(self, df: DataFrame, key1: str, key2: str, name: str) -> DataFrame:
        """`df` plus `name`: the number of splitters at or below the row's key. The joined table has CELLS + 1 rows at most."""
        spark, by_cell = df.sparkSession, {}
        for s in self.splits:
            by_cell.setdefault(_div(s.key1, self.step), []).append((s.key1, s.key2))
        rows, base = [], sum(len(v) for c, v in by_cell.items() if c < self.first)
        for c in range(self.first, self.last + 1):
            rows.append((c, base, sorted(by_cell.get(c, []))))
            base += len(by_cell.get(c, []))
        cells = spark.createDataFrame(rows, "__cell long, __base int, __splits array<struct<key1: long, key2: long>>")
        met = df.withColumn("__cell", F.expr(f"{key1} div {self.step}L")).join(F.broadcast(cells), "__cell")
        at = F.expr(f"__base + size(filter(__splits, s -> s.key1 < {key1} or (s.key1 = {key1} and s.key2 <= {key2})))")
        return met.withColumn(name, at).drop("__cell", "__base", "__splits")


def _div(a: int, b: int) -> int:
    """Division towards zero, as SQL's div."""
    return -(-a // b) if a < 0 else a // b


def _sums(weight: str) -> list[Column]:
    return [F.min("k1"), F.max("k1"), F.min("k2"), F.max("k2"), F.sum(weight), F.count("*")]


def _cells(counted: list, below: int, rows_below: int, first: bool) -> list[Cell]:
    out = []
    for r in sorted(counted, key=lambda r: (r[0], r[2])):
        out.append(Cell(*map(int, r[:6]), below, rows_below, first))
        below, rows_below = below + int(r[4]), rows_below + int(r[5])
    return out


def find_ranges(df: DataFrame, key1: str, key2: str, weight: str, parts: int, tolerance) -> Ranges | None:
    """Splitters of `df` into `parts` ranges of equal weight; None for an empty table.

    tolerance(i): how far splitter i may be from its target (in weight). Where a single key is heavier than that, the
    nearer side of the key is taken: rows that share both parts of the key are never separated.
    """
    keys = df.select(F.col(key1).alias("k1"), F.col(key2).alias("k2"), F.col(weight).cast("long").alias("w"))
    whole = keys.agg(*_sums("w")).first()
    if not whole[5]:
        return None
    step = (whole[1] - whole[0]) // CELLS + 1
    cell = F.expr(f"k1 div {step}L")
    first = _cells(keys.groupBy(cell.alias("c")).agg(*_sums("w")).drop("c").collect(), 0, 0, True)
    total, found = int(whole[4]), {}
    if parts > 1 and total == 0:  # nothing has weight: one range
        return Ranges([], _div(whole[0], step), _div(whole[1], step), step, 0, int(whole[5]))
    open_at = {i: first for i in range(1, parts)}
    while open_at:
        inside: dict[Cell, list[int]] = {}
        for i, cells in open_at.items():
            target = total * i / parts
            c = cells[min(bisect_right(cells, target, key=lambda c: c.below + c.weight), len(cells) - 1)]
            near, far = abs(target - c.below), abs(c.below + c.weight - target)
            if min(near, far) <= tolerance(i) or c.single:
                found[i] = _low(c) if near <= far else _high(c)
            else:
                inside.setdefault(c, []).append(i)
        if not inside:
            break
        open_at, cells_of = {}, list(inside.items())
        for k in range(0, len(cells_of), ROUND // LEAST):
            group = cells_of[k : k + ROUND // LEAST]
            for (c, wanted), counted in zip(group, _finer(df, keys, cell, step, [c for c, _ in group]), strict=True):
                open_at |= dict.fromkeys(wanted, _cells(counted, c.below, c.rows_below, c.first and c.by == 1))
    return Ranges([found[i] for i in sorted(found)], _div(whole[0], step), _div(whole[1], step), step, total, int(whole[5]))


def _finer(df: DataFrame, keys: DataFrame, cell: Column, step: int, inside: list[Cell]) -> list[list]:
    """For each of these cells (ROUND // LEAST at most), the counts of the finer cells in it: ROUND in all at most."""
    fine = ROUND // len(inside)
    asked = []
    for n, c in enumerate(inside):
        wide = (c.high1 - c.low1 if c.by == 1 else c.high2 - c.low2) // fine + 1
        asked.append((_div(c.low1, step), n, c.low1, c.high1, c.low2, c.high2, c.by == 1, wide))
    table = df.sparkSession.createDataFrame(asked, "c long, n int, low1 long, high1 long, low2 long, high2 long, first boolean, wide long")
    hit = keys.withColumn("c", cell).join(F.broadcast(table), "c").filter("k1 between low1 and high1 and (first or k2 between low2 and high2)")
    out: list[list] = [[] for _ in inside]
    for r in hit.groupBy("n", F.expr("if(first, k1, k2) div wide").alias("c")).agg(*_sums("w")).collect():
        out[r[0]].append(r[2:])
    return out


def _low(c: Cell) -> Split:
    return Split(c.low1, LOW if c.first else c.low2, c.below, c.rows_below)


def _high(c: Cell) -> Split:
    up = (c.below + c.weight, c.rows_below + c.rows)
    return Split(c.high1 + 1, LOW, *up) if c.first else Split(c.high1, c.high2 + 1, *up)
