"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the expected number of its copies. Among all rates that give each source its target of
words, those closest (in relative entropy) to one copy each are exponentially tilted: min(2, exp(lambda * z)) with one
multiplier per source and z the document's size over its source's mean. The dual is convex; Newton steps, kept in a
bracket, find all multipliers at once from the table of (source, size, count), which is all they need of the corpus.
Rates become copies by systematic rounding from the largest size down; what a source then lacks or has too much is made
up by documents of the largest sizes that fit, a few rounds, so that it misses its target by less than a small document.
Which documents of a size get one copy more is told by a hash of id and text. Only (source, size, hash) is ever dealt out
for all this; whole rows meet the table of (source, size) once. Sums are exact decimals and integers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
UNIT = 1 << 20
STEPS, FIXES = 200, 8


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, docs, source_size, smallest, target) from rows (source, size, n).

    Weights repeat over the sources in code-point order, null last. What exceeds `most` times a source's size is shared
    again by weight among the others until none is above. One small aggregate a round; the ranking of the sources is
    the only step in one task, on one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(totals.withColumn("weight", F.element_at(cycle, F.pmod(place, F.lit(len(weights))) + 1)).withColumn("cap", most * F.col("source_size").cast("double")), "sources")
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full, cap = 0.0, -1, F.col("weight") * F.lit(0.0)
    while True:
        row = ranked.agg(F.count_if(cap >= F.col("cap")), F.sum(F.when(cap >= F.col("cap"), F.col("cap")).otherwise(0.0)), F.sum(F.when(cap < F.col("cap"), F.col("weight")).otherwise(0.0))).first()
        if row[0] == full or not row[2]:
            break
        full, level = row[0], (share * whole - row[1]) / row[2]
        cap = F.col("weight") * F.lit(level)
    return ranked.select("source", "docs", "source_size", "smallest", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def multipliers(sizes: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """(source, mean, full, lam): each source's multiplier, or full where every document is taken `most` times."""
    mean = F.col("source_size") / F.greatest("docs", F.lit(1))
    full = F.col("target") >= most * F.col("source_size")
    high = F.when(F.col("smallest").isNotNull(), F.lit(math.log(most)) * mean / F.col("smallest") + 1).otherwise(1.0)
    state = written(wanted.select("source", "target", mean.alias("mean"), full.alias("full"), F.lit(0.0).alias("lam"), F.lit(-1e5).alias("low"), high.alias("high"), F.coalesce(full, F.lit(True)).alias("done")), "newton")
    exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")
    for _ in range(STEPS):
        if not state.filter("not done").limit(1).count():
            break
        met = sizes.join(state.filter("not done").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("z", F.col("size") / F.col("mean"))
        words, rate = F.col("n") * F.col("size"), tilted(F.col("lam"), F.col("z"), most)
        sums = met.groupBy("source").agg(exact(words * rate).alias("has"), exact(F.when(rate < most, words * rate * F.col("z")).otherwise(0.0)).alias("slope"))
        now = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("has") - F.col("target")
        now = now.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
        step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope")))
        inside = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
        close = (F.abs(gap) <= F.col("target") * 1e-7 + 1e-3) | (F.col("high") - F.col("low") < 1e-12)
        state = written(now.withColumn("lam", F.when(F.col("done") | close, F.col("lam")).otherwise(inside)).withColumn("done", F.col("done") | F.coalesce(close, F.lit(True))).select("source", "target", "mean", "full", "lam", "low", "high", "done"), "newton")
    else:
        raise RuntimeError(f"the multipliers did not settle in {STEPS} steps")
    return state.select("source", "mean", "full", "lam")


def tilted(lam: Column, z: Column, most: int) -> Column:
    """The rate; the exponent is held so that it can't overflow."""
    return F.least(F.exp(F.least(lam * z, F.lit(math.log(most) + 1))), F.lit(float(most)))


def rounding(sizes: DataFrame, found: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, copies): the copies of all n documents of a size together, from prefix sums of the rates over falling sizes.

    Prefix sums go by blocks of 64 sizes, so that no task holds all sizes of a large source.
    """
    met = sizes.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(most)).otherwise(tilted(F.col("lam"), F.col("size") / F.col("mean"), most))
    cells = written(met.select("source", "size", "n", F.round(rate * UNIT).cast("long").alias("rate"), F.expr("size div 64").alias("block")), "rates")
    mass = F.sum(F.col("n") * F.col("rate"))
    before = lambda x, w: F.coalesce(x.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cells.groupBy("source", "block").agg(mass.alias("sum"))
    starts = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), before(F.sum("sum"), Window.partitionBy("source").orderBy(F.desc("block"))).alias("from"))
    inner = cells.withColumn("in", before(mass, Window.partitionBy("source", "block").orderBy(F.desc("size"))))
    start = inner.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("start", F.col("from") + F.col("in"))
    copies = F.expr(f"(start + n * rate + {UNIT // 2}) div {UNIT} - (start + {UNIT // 2}) div {UNIT}")
    return written(start.select("source", "size", "n", F.when(F.col("size") == 0, F.col("n")).otherwise(copies).alias("copies")), "cells")


def settled(cells: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """`cells` with the copies of a few sizes changed, so that each source's words come nearest its target.

    A round takes, for every source, as many documents as fit of the largest size that is not above the gap and was not
    tried before; it needs one aggregate, and the gap is below that size afterwards unless the size is used up.
    """
    source = F.col("source").eqNullSafe(F.col("s"))
    taken = cells.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    gap = F.round(F.col("target") - F.coalesce("taken", F.lit(0))).cast("long")
    state, picked = written(wanted.join(taken, source, "left").select("source", gap.alias("gap"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("more")), "gaps"), []
    room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    for _ in range(FIXES):
        open_ = state.filter("gap <> 0").select(F.col("source").alias("s"), "gap", "at")
        fits = cells.join(open_, source).withColumn("room", room).filter("size > 0 and size <= abs(gap) and room > 0 and (at is null or size < at)")
        best = fits.groupBy("source", "gap").agg(F.max(F.struct("size", "room")).alias("best"))
        more = F.signum("gap").cast("long") * F.expr("least(best.room, abs(gap) div best.size)")
        state = written(best.select("source", F.col("best.size").alias("at"), more.alias("more"), "gap").withColumn("gap", F.expr("gap - more * at")), "gaps")
        if state.isEmpty():
            break
        picked.append(state.select(F.col("source").alias("s"), F.col("at").alias("z"), "more"))
    for x in picked:
        cells = cells.join(x, source & (F.col("size") == F.col("z")), "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).select("source", "size", "n", "copies")
    return written(cells, "cells")


def limits(narrow: DataFrame, cells: DataFrame) -> DataFrame:
    """(source, size, least, upto): documents of the cell have `least` copies, those with dice up to `upto` (null: none) one more.

    The dice that stands at the wanted place is found by counts over ranges of dice, then by order in one range: about
    the square root of the cell's documents in either step, however many they are.
    """
    split = cells.select("source", "size", "n", F.expr("copies div n").cast("int").alias("least"), F.expr("copies % n").alias("extra"))
    some = split.filter("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "extra", (F.floor(F.sqrt("n") / 4) + 1).alias("ranges"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    dealt = narrow.join(some, same).select("source", "size", "dice", "extra", F.expr("shiftright(shiftright(dice, 31) * ranges, 32)").alias("range"))
    counts = dealt.groupBy("source", "size", "extra", "range").agg(F.count("*").alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = counts.withColumn("ahead", ahead).filter("ahead < extra and extra <= ahead + m").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("range").alias("r"), (F.col("extra") - F.col("ahead")).alias("place"))
    inside = dealt.join(hit, same & (F.col("range") == F.col("r"))).select("source", "size", "dice", "place")
    at = inside.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size").orderBy("dice"))).filter("rank = place")
    upto = at.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("dice").alias("upto"))
    return split.join(upto, same, "left").select("source", "size", "least", "upto")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, size_col: str | None = None) -> DataFrame:
    """`docs` plus `mixed`, a struct of size, source_size, target and copies (0 to `most`); a column of that name is replaced.

    Sizes are the words of text_col, or size_col (not null, not negative) where it is given; then no text is needed. Null
    and empty texts have size 0 and one copy. A null source is a source of its own, last in order. Rows that share id and
    text (id alone with size_col) are one key: each has the same copies. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != "mixed"]
    size = word_count(F.col(f"`{text_col}`")) if size_col is None else F.col(f"`{size_col}`").cast("long")
    key = [id_col] if size_col else [id_col, text_col]
    dice = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in key]), 1)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), dice.alias("dice"))
    narrow = written(sized.drop("row"), "narrow")
    sizes = written(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    wanted = written(targets(sizes, share, most, weights), "targets")
    cells = settled(rounding(sizes, multipliers(sizes, wanted, most), most), wanted, most)
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    told = limits(narrow, cells).join(wanted.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    told = written(told.withColumnsRenamed({"source": "s", "size": "z"}), "told")
    copies = F.col("least") + F.coalesce(F.col("dice") <= F.col("upto"), F.lit(False)).cast("int")
    met = sized.join(told, same).withColumn("__mixed", F.struct("size", "source_size", "target", copies.alias("copies")))
    return met.select(*[F.col(f"row.`{c}`") for c in names], F.col("__mixed").alias("mixed"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    return mix(docs, **options).filter("mixed.copies > 0").withColumn("mixed", F.explode(F.expr("sequence(1, mixed.copies)"))).drop("mixed")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: what the mix takes of every document."""
    sized = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix(written(sized, "sized"), size_col="words")
    return mixed.select("doc_id", "mixed.size", "mixed.source_size", "mixed.target", (F.col("mixed.copies") * F.col("mixed.size")).alias("taken"), "mixed.copies")
