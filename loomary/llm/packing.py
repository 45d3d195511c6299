"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt by a hash into blocks of about BLOCK. Each block is evolved on ISLANDS
islands, each a task of its own with a population of packings: crossover injects whole well-filled bins of one parent
into the other, bins that hold a duplicate are removed, and the documents that this displaces are best-fitted, largest
first. After each epoch the best packing of each island migrates to the next. Bins of a block that stay below the first of
FLOORS are opened again, and their pieces, a small share, are packed across blocks in the next round, until one block is
left; where that would open most pieces again, a lower floor holds, so in the end the last bins of all blocks meet.
An island stops when it has reached the least possible number of bins.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, written
from .tokens import token_ids

CAPACITY = 2048
BLOCK, ISLANDS, EPOCHS, CHILDREN, POPULATION = 4096, 2, 3, 8, 4
FULL, STUCK = 0.998, 0.5
FLOORS = (1.0, 0.9995, 0.999, FULL, 0.99, 0.97, 0.9, 0.75, 0.5)
STATE = "block int, island int, rows binary, sizes binary, packings array<binary>"


class Bins:
    """Open bins by free space; best fit is the least free space that is enough."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, {}

    def put(self, bin_: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(bin_)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        high = self.mask >> size
        if not high:
            return None
        room = size + (high & -high).bit_length() - 1
        stack = self.by_room[room]
        found = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        return found, room - size


def best_fit(sizes: np.ndarray, packing: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit the pieces `left`, in their order, into the bins of `packing` (-1: not packed) and new bins; bins renumbered from 0."""
    used = packing >= 0
    names, dense = np.unique(packing[used], return_inverse=True)
    out = np.full(len(sizes), -1, np.int64)
    out[used] = dense
    rooms = capacity - np.bincount(dense, weights=sizes[used], minlength=len(names)).astype(np.int64)
    bins, n = Bins(capacity), len(names)
    for b, room in enumerate(rooms.tolist()):
        if room > 0:
            bins.put(b, room)
    for k, size in zip(left.tolist(), sizes[left].tolist(), strict=True):
        found = bins.take(size)
        if found is None:
            found, n = (n, capacity - size), n + 1
        out[k] = found[0]
        if found[1]:
            bins.put(*found)
    return out


def fitness(sizes: np.ndarray, packing: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, bins as unevenly filled as possible."""
    fill = np.bincount(packing, weights=sizes)
    return len(fill), -float(((fill / capacity) ** 2).mean()) if len(fill) else 0.0


def cross(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, dice: random.Random) -> np.ndarray:
    """The mother's packing with some of the father's best-filled bins."""
    fill = np.bincount(father, weights=sizes)
    order = np.argsort(-fill, kind="stable")
    well = order[: max(1, int(len(fill) * dice.uniform(0.2, 0.6)))]
    well = well[fill[well] >= FULL * capacity] if (fill[well] >= FULL * capacity).any() else well
    brought = np.isin(father, well)
    child = mother.copy()
    removed = np.zeros(int(mother.max()) + 1, bool)
    removed[mother[brought]] = True
    poor = np.bincount(mother, weights=sizes) < FULL * capacity
    removed |= poor & (np.array([dice.random() for _ in range(len(poor))]) < 0.5)
    displaced = removed[mother] & ~brought
    child[displaced] = -1
    child[brought] = father[brought] + int(mother.max()) + 1
    left = np.flatnonzero(displaced)
    return best_fit(sizes, child, left[np.argsort(-sizes[left], kind="stable")], capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, children: int = CHILDREN, most: int = POPULATION) -> list[np.ndarray]:
    """The best packings after `children` crossovers, best first."""
    dice = random.Random(seed)
    least = -(-int(sizes.sum()) // capacity)
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    for k in range(children):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = dice.sample(range(len(ranked)), 2)
        child = cross(sizes, ranked[min(a, b)][2], ranked[max(a, b)][2], capacity, dice)
        ranked = sorted([*ranked, (fitness(sizes, child, capacity), len(population) + k, child)], key=lambda x: x[:2])[:most]
    return [p for _, _, p in ranked]


def founders(sizes: np.ndarray, capacity: int, seed: int, n: int = POPULATION) -> list[np.ndarray]:
    """Best fit decreasing, then best fit in noisy orders; only the first if it can't be beaten."""
    empty = np.full(len(sizes), -1, np.int64)
    out = [best_fit(sizes, empty, np.argsort(-sizes, kind="stable"), capacity)]
    if fitness(sizes, out[0], capacity)[0] <= -(-int(sizes.sum()) // capacity):
        return out
    noise = np.random.default_rng(seed)
    for k in range(1, n):
        order = np.argsort(-(sizes * noise.uniform(1 - 0.1 * k, 1, len(sizes))), kind="stable")
        out.append(best_fit(sizes, empty, order, capacity))
    return out


def _state(block: int, island: int, rows: np.ndarray, sizes: np.ndarray, population: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"block": [block], "island": [island], "rows": [rows.astype("<i8").tobytes()], "sizes": [sizes.astype("<i8").tobytes()], "packings": [[p.astype("<i4").tobytes() for p in population]]})


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.int64)


def _round(items: DataFrame, blocks: int, level: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(row, length, bin, fill, block) of `items` (row, length), packed within blocks."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        rows, sizes = pdf["row"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        seed = hash((level, block, island))
        return _state(block, island, rows, sizes, evolve(sizes, founders(sizes, capacity, seed & 0xFFFFFFFF), capacity, seed))

    def epoch(number: int):
        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("migrant")
            own = pdf.iloc[0]
            population = {p: None for raw in pdf["packings"] for p in raw}
            sizes, block, island = _unpack(own["sizes"], "<i8"), int(own["block"]), int(own["island"])
            best = evolve(sizes, [_unpack(p, "<i4") for p in population], capacity, hash((level, block, island, number)))
            return _state(block, island, _unpack(own["rows"], "<i8"), sizes, best)

        return go

    block = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)).cast("int")
    dealt = items.select("row", "length", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = written(dealt.groupBy("block", "island").applyInPandas(found, STATE), "islands")
    for number in range(epochs):
        own = state.withColumn("migrant", F.lit(0))
        sent = state.withColumn("island", (F.col("island") + 1) % islands).withColumn("packings", F.slice("packings", 1, 1)).withColumn("migrant", F.lit(1))
        state = written(own.unionByName(sent).groupBy("block", "island").applyInPandas(epoch(number), STATE), "islands")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        options = [(fitness(_unpack(r["sizes"], "<i8"), _unpack(r["packings"][0], "<i4"), capacity), r["island"], r) for _, r in pdf.iterrows()]
        r = min(options, key=lambda x: x[:2])[2]
        sizes, packing = _unpack(r["sizes"], "<i8"), _unpack(r["packings"][0], "<i4")
        fill = np.bincount(packing, weights=sizes).astype(np.int64)
        order = np.argsort(packing, kind="stable")
        ends = np.cumsum(sizes[order])
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(packing[order])) + 1)) if len(order) else np.empty(0, np.int64)
        base = np.repeat((ends - sizes[order])[firsts], np.diff(np.append(firsts, len(order))))
        return pd.DataFrame({"row": _unpack(r["rows"], "<i8")[order], "length": sizes[order], "block": r["block"], "bin": packing[order], "fill": fill[packing[order]], "offset": ends - sizes[order] - base})

    return written(state.groupBy("block").applyInPandas(best, "row long, length long, block int, bin int, fill long, offset long"), "packed")


def pack(pieces: DataFrame, row: str = "row", length: str = "length", capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(row, sequence_id, offset) for pieces with a unique long `row` and a `length` of 1 to `capacity`.

    Pieces of full length have a sequence of their own. An empty table gives an empty one. Reruns over the same rows
    agree: all dice are seeded by level, block and island.
    """
    items = pieces.select(F.col(row).alias("row"), F.col(length).cast("long").alias("length"))
    placed = items.filter(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level = items.filter(F.col("length") < capacity), 0
    n = rest.count()
    while n:
        blocks = -(-n // block)
        packed = _round(rest, blocks, level, capacity, islands, epochs)
        sequence = F.lit(level << 56) + F.col("block").cast("long") * F.lit(1 << 24) + F.col("bin")
        below = packed.agg(*[F.count_if(F.col("fill") < x * capacity) for x in FLOORS]).first()
        floor = next((k for k, left in enumerate(below) if left <= STUCK * n), None)
        if blocks == 1 or floor is None:  # the last block, or bins that can't be filled: they stay as they are
            n, open_ = 0, F.lit(False)
        else:
            n, open_ = below[floor], F.col("fill") < FLOORS[floor] * capacity
        placed = placed.unionByName(packed.filter(~open_).select("row", sequence.alias("sequence_id"), "offset"))
        rest, level = packed.filter(open_).select("row", "length"), level + 1
    return placed


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = 0, text_col: str = "text") -> DataFrame:
    """`docs` without the text, a row per piece: piece, start, length and ids (binary, little-endian unsigned 32-bit).

    A document's ids are those of its whole text (null: none), then `end`; only documents longer than `capacity` are cut.
    """
    ids = docs.withColumn("__ids", token_ids(F.col(f"`{text_col}`"), tokenizer_path, end)).drop(text_col)
    piece = ids.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((octet_length(__ids) div 4 - 1) div {capacity} as int))")))
    start = F.col("piece").cast("long") * capacity
    part = piece.withColumn("start", start).withColumn("ids", F.expr(f"substring(__ids, piece * {4 * capacity} + 1, {4 * capacity})")).drop("__ids")
    return part.withColumn("length", (F.octet_length("ids") / 4).cast("long"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of 2048 tokens."""
    return packed_digests(read(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for documents; a repeated row is packed as often as it occurs."""
    import public_tokenizers

    pieces = cut(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    kept = written(pieces.select(F.monotonically_increasing_id().alias("row"), "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return kept.join(pack(kept), "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
