"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its word shingles, weighted by how often they occur. For each sample i and term, hashes give
exponentials a0, f and e2; c = a0 + f and r = e1 + e2 with e1 = -ln(a0 / c) are independent gamma(2, 1) variables and
e2 / r is a uniform beta: the draws of consistent weighted sampling. With t = floor(ln(w) / r + beta) the term's value
is c / (y e^r) for y = e^(r (t - beta)), which is a0 e^(-r t); the sample is the pair (term, t) of least value. Two
texts share a sample with probability equal to their generalised Jaccard similarity, the sum of the lesser weights
over the sum of the greater.

The least value is found without trying every sample of every term. The hash behind a0 is drawn bit by bit: bit i of
a term's k-th hash is bit k of its uniform for sample i. The AND of the first d hashes so marks, in one 64-bit mask, the
samples for which a term's uniform is among the top 2^-d, and only those can hold the least value where a text has
many terms. d follows from the number of distinct words (a lower bound for that of terms), so that REACH terms are
expected per sample; a sample that none reaches (probability 64 e^-REACH, about 7e-6 a text) stays empty and agrees
with none. The samples of a mask are looked up byte by byte, so a term makes a row for each of them and no others. Terms that occur more often, a small share, are tried for every sample. The fingerprint is a function of the
text alone, and no term is ever shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read
from .histogram import LOW, find_ranges

SAMPLES, WORDS = 64, 5
SPACES = " \t\n\x0b\f\r"
DEPTH, REACH = 16, 16
#: Parts of a task.
TOGETHER = 2
TAG = 4  # hex digits of a sample in a fingerprint
EMPTY = "-" * TAG


def _grams(df: DataFrame, text: str, k: int, keep: list[str]) -> DataFrame:
    """(keep .., __d, __g): a row per k words of a text, in columns __g.w0 ..; a text with fewer words is one row, filled up with
    empty words. __d, the text's level: how many hashes are ANDed, so that its distinct words over 2^level are REACH at
    least. Each step is a column of its own, as one nested expression would repeat its parts."""
    plain = df.select(*keep, F.lower(F.btrim(text, F.lit(SPACES))).alias("__plain")).filter("__plain <> ''")
    words = plain.select(*keep, F.split("__plain", f"[{SPACES}]+").alias("__words")).withColumn("__short", F.greatest(k - F.size("__words"), F.lit(0)))
    known = words.withColumn("__d", F.size(F.array_distinct("__words")) - (k - 1))
    level = F.greatest(F.lit(0), F.least(F.lit(DEPTH), F.floor(F.log2(F.greatest("__d", F.lit(1)) / F.lit(REACH))))).cast("int")
    filled = known.select(*keep, level.alias("__d"), F.when(F.col("__short") > 0, F.concat("__words", F.array_repeat(F.lit(""), F.col("__short")))).otherwise(F.col("__words")).alias("__filled"))
    sized = filled.withColumn("__count", F.size("__filled") - k + 1)
    return sized.select(*keep, "__d", F.explode(F.arrays_zip(*[F.slice("__filled", F.lit(i + 1), F.col("__count")).alias(f"w{i}") for i in range(k)])).alias("__g"))


def _set_bits(mask: str) -> Column:
    """The places of the bits that are set in a long. The tables (places by value of a byte) are constants once planned."""
    tables = [json.dumps([[8 * b + i for i in range(8) if x >> i & 1] for x in range(256)]) for b in range(8)]
    at = [F.expr(f"element_at(from_json('{t}', 'array<array<int>>'), cast(({mask} >>> {8 * b}) & 255 as int) + 1)") for b, t in enumerate(tables)]
    return F.concat(*at)


def _order_keys(drawn: DataFrame, keep: list[str], sides: int) -> DataFrame:
    """(keep .., __k0 ..): per side the order key of sample __i of a term: the greater, the less its value.

    The uniform is 1 - v with v = 2^-c (1 - f / 2), f from the hash __h, c its level. The key holds c, 26 bits of f, and
    32 bits that tell (term, t). Small steps: code generated from one large expression would be too long to be compiled.
    """
    uniform = lambda seed: f"((xxhash64(__h, {seed}) >>> 11) + 0.5D) / 9007199254740992D"
    own = [*keep, "__i", "__h", "__c"]
    per_side = [c for j in range(sides) for c in (f"__w{j}", f"__q{j}")]
    heavy = " or ".join(f"__w{j} > 1" for j in range(sides))
    x = drawn.select(*own, *per_side, F.expr(heavy).alias("__heavy"))
    x = x.select("*", *[F.expr(f"if(__heavy, -ln({u}), null)").alias(c) for c, u in (("__a0", "1D - (1D - ((__h >>> 38) + 0.5D) / 134217728D) / shiftleft(1L, __c)"), ("__f", uniform(1)), ("__e2", uniform(2)))])
    x = x.withColumn("__r", F.expr("ln((__a0 + __f) / __a0) + __e2"))
    x = x.select("*", *[F.expr(f"if(__w{j} > 1, floor((ln(cast(__w{j} as double)) + __e2) / __r), 0L)").alias(f"__t{j}") for j in range(sides)])
    x = x.select("*", *[F.expr(f"if(__t{j} > 0, greatest(1D - exp(-__a0 * exp(-__r * __t{j})), 1e-9D), null)").alias(f"__v{j}") for j in range(sides)])
    x = x.select("*", *[F.expr(f"cast(floor(-log2(__v{j})) as int)").alias(f"__l{j}") for j in range(sides)])
    plain = "shiftleft(cast(__c as bigint), 58) | shiftleft(__h >>> 38, 32) | (__h & 4294967295L)"
    moved = "shiftleft(cast(__l{0} as bigint), 58) | shiftleft(cast(greatest(0D, least(1D, 2D - 2D * __v{0} * shiftleft(1L, __l{0}))) * 67108863D as bigint), 32) | (xxhash64(__h, __t{0}) & 4294967295L)"
    return x.select(*keep, "__i", *[F.expr(f"if((__q{j} >>> __i) & 1 = 0, null, if(__t{j} > 0, {moved.format(j)}, {plain}))").alias(f"__k{j}") for j in range(sides)])


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str], words: int = WORDS) -> DataFrame:
    """One row per distinct `keys` with a fingerprint for each text column, named after it.

    Rows that share keys count as one text with all their terms, so keys should be unique. Where `rows` is already
    partitioned by some of the keys, nothing is shuffled. Null and empty texts and those of white space have the empty
    fingerprint; a row of such texts only has no row in the result. Terms that several of the texts share are drawn once.
    """
    n = len(texts)
    sides = F.explode(F.array(*[F.struct(F.lit(j).alias("side"), F.coalesce(F.col(c), F.lit("")).alias("text")) for j, c in enumerate(texts)]))
    split = rows.select(*keys, sides.alias("__s")).select(*keys, F.col("__s.side").alias("__side"), F.col("__s.text").alias("__text"))
    terms = _grams(split, "__text", words, [*keys, "__side"]).select(*keys, "__side", "__d", F.xxhash64(*[f"__g.w{i}" for i in range(words)]).alias("__term"))
    here = lambda j: F.col("__side") == j
    weighed = terms.groupBy(*keys, "__term").agg(*[F.count_if(here(j)).alias(f"__w{j}") for j in range(n)], *[F.max(F.when(here(j), F.col("__d")).otherwise(0)).alias(f"__d{j}") for j in range(n)])
    hashed = weighed.select("*", *[F.xxhash64("__term", F.lit(-k)).alias(f"__a{k}") for k in range(1, DEPTH + 1)])
    ands = " & ".join(f"if(__d{{0}} >= {k}, __a{k}, -1L)" for k in range(1, DEPTH + 1))
    masks = [F.expr(f"if(__w{j} = 0, 0L, if(__w{j} > 1, -1L, {ands.format(j)}))").alias(f"__q{j}") for j in range(n)]
    met = hashed.select("*", *masks).withColumn("__any", F.expr(" | ".join(f"__q{j}" for j in range(n))))
    tried = met.withColumn("__i", F.explode_outer(_set_bits("__any"))).filter("__i is not null").drop("__any")  # a filter before it would compute the masks twice
    level = str(DEPTH)
    for k in range(DEPTH, 0, -1):
        level = f"if((__a{k} >>> __i) & 1 = 0, {k - 1}, {level})"
    drawn = tried.select("*", F.xxhash64("__term", "__i").alias("__h"), F.expr(level).alias("__c"))
    least = _order_keys(drawn, keys, n).groupBy(*keys, "__i").agg(*[F.max(f"__k{j}").alias(f"__k{j}") for j in range(n)])
    tag = lambda c: F.substring(F.hex(F.col(c).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(0x10000))), 2, TAG)
    named = least.select(*keys, F.struct("__i", F.struct(*[tag(f"__k{j}").alias(f"t{j}") for j in range(n)])).alias("__sample"))
    made = named.groupBy(*keys).agg(F.map_from_entries(F.collect_list("__sample")).alias("__m"))
    return made.select(*keys, *[F.lower(F.array_join(F.transform(F.lit(list(range(SAMPLES))), _of(j)), "")).alias(c) for j, c in enumerate(texts)])


def _of(side: int):
    return lambda i: F.coalesce(F.try_element_at("__m", i)[f"t{side}"], F.lit(EMPTY))


def likeness(a: str, b: str) -> Column:
    """Share of samples in which two fingerprints agree; two empty ones are alike."""
    at = lambda x: f"substring({x}, i * {TAG} + 1, {TAG})"
    same = F.expr(f"size(filter(sequence(0, {SAMPLES - 1}), i -> {at(a)} = {at(b)} and {at(a)} <> '{EMPTY}'))") / F.lit(float(SAMPLES))
    none = F.lit(EMPTY * SAMPLES)
    return F.when((F.col(a) == none) & (F.col(b) == none), 1.0).otherwise(same)


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_bytes: int = 2 << 20, parts: tuple[int, int] = (64, 1 << 20)) -> DataFrame:
    """Rows (part, n, own, id, text, next): every row with the text of the next in ascending order of id (null first; ties by a
    hash of the text), the first after the last; `own` is false for copies of a part's successor.

    Parts are ranges of ids of about equal bytes with exact splitters, so the one exchange of texts serves the order too.
    Some parts meet in a task by hash, so that tasks are alike and hold few enough terms to aggregate them in memory.
    Ids travel as the order's first key (the least long stands for null), so whatever part of the rows a plan needs, it
    needs the same exchange.
    """
    text, k1 = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOW))
    named = F.when(F.col("k1") != F.lit(LOW), F.col("k1")).cast(docs.schema[id_col].dataType).alias("id")
    keyed = docs.select(text.alias("text"), k1.alias("k1")).withColumn("k2", F.xxhash64("text")).withColumn("size", F.octet_length("text") + 16)
    total = keyed.agg(F.sum("size")).first()[0] or 0
    count = min(parts[1], max(parts[0], -(-total // part_bytes)))
    ranges = find_ranges(keyed.select("k1", "k2", "size"), "k1", "k2", "size", count, lambda i: 0.2 * total / count)
    if ranges is None:
        return keyed.select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(True).alias("own"), named, "text", F.col("text").alias("next"))
    dealt = ranges.assign(keyed, "k1", "k2", "part")
    firsts = sorted(dealt.groupBy("part").agg(F.min(F.struct("k1", "k2")).alias("k")).select("part", "k.k1", "k.k2").collect())  # a row per part
    before = [(k1, k2, firsts[i - 1][0]) for i, (_, k1, k2) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "h1 long, h2 long, before int")
    met = dealt.join(F.broadcast(heads), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    # never null to the optimizer either, which else gives one user of the exchange a filter and the other none
    here, prior = "struct(coalesce(part, 0) as part, true as own)", "struct(coalesce(before, 0) as part, false as own)"
    twice = F.explode(F.expr(f"if(before is null, array({here}), array({here}, {prior}))"))
    both = met.select("k1", "k2", "text", twice.alias("p")).select("p.part", "p.own", "k1", "k2", "text").repartition(max(1, count // TOGETHER), "part")
    order = Window.partitionBy("part").orderBy(F.col("own").desc(), "k1", "k2")
    return both.withColumn("n", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit(""))).select("part", "n", "own", named, "text", "next")


def op4_cws(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of every document and of its edited text."""
    own = with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
    size, moved = F.char_length("text"), F.expr("char_length(text) div 4").cast("int")
    texts = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), size - moved), F.substring("next", F.lit(1), moved)))
    made = fingerprints(texts.select("part", "n", "text", "edited"), ["part", "n"], ["text", "edited"]).withColumnsRenamed({"part": "p", "n": "m", "text": "fingerprint", "edited": "edited_fingerprint"})
    facts = texts.select("part", "n", "own", F.col("id").alias("doc_id"), size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    none = F.lit(EMPTY * SAMPLES)
    met = facts.join(made, (F.col("part") == F.col("p")) & (F.col("n") == F.col("m")), "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("fingerprint", "edited_fingerprint")})
    after = met.withColumn("after", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("n"))).filter("own")
    return after.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "after").alias("near_next"))
