"""Line dedup by a log-template tree, in DataFrame operations only.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens, where tokens with a
digit count as variable. In each leaf a position keeps the tokens that at least `min_docs` documents have there; all
other tokens are variable fields. The line with its variable fields generalised is its template. A template recurs if
at least `min_docs` documents with different texts (two, if the line has more than LONG words) have lines of it and
enough of it is constant. Its first line (least
document id, then position) stays, the others are dropped. A document that would lose more than `most` of its words stays
whole only if it is proven to be a copy, for a document-level stage to judge: one other document must have the same
text or hold nearly all words of both (see COPY). Shared passages never make a copy, whatever their share of the text.
A long passage that only two documents have stays in both if they share more than `most` of the longer one's words:
two such documents are versions of each other, which a document-level stage must meet whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, read, release, written

DEPTH, MIN_DOCS, CONSTANT, LEAST_CONSTANT, MOST = 3, 3, 0.7, 4, 0.5
#: Above so many words two documents are enough: such a passage doesn't recur by chance.
LONG = 50
#: A copy shares COPY * most of the words of the longer document with one other: 8/9, a Jaccard of 0.8 if lengths are equal.
COPY = 16 / 9
SPACES = r"[\t\x0B\f\r]|  "
VARIABLE, SALT = "<*>", 64
DIGITS = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def _words(line: str) -> str:
    """SQL for the number of words of a line with single spaces between and none around."""
    return f"octet_length({line}) - octet_length(replace({line}, ' ', '')) + if({line} = '', 0, 1)"


def _general(text: Column) -> Column:
    """Words with a digit replaced; most texts have none and are only searched once."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, DIGITS, VARIABLE)).otherwise(text)


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, same, total, pos, words, constants, leaf, line, plain): the lines of every text that aren't blank, with single spaces.

    `same` is a hash of the text, `total` its words, `constants` the words of the line without a digit. A leaf is told by
    the number of words and the leading ones, `line` by all of them, where words with a digit are alike; the lowest bit of
    `leaf` is set for long lines.
    """
    text = F.col(f"`{text_col}`")
    clean = F.when(text.rlike(SPACES), F.regexp_replace(text, r"[\x20\t\x0B\f\r]+", " ")).otherwise(text)
    parts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("same"), F.split(clean, "\n").alias("parts"))
    total = F.expr(f"aggregate(parts, 0L, (sum, x) -> sum + {_words('btrim(x)')})")
    split = parts.withColumn("total", total).select("id", "same", "total", F.posexplode("parts").alias("pos", "line"))
    plain = split.select("id", "same", "total", "pos", F.btrim("line").alias("plain")).filter("plain <> ''")
    words = plain.withColumn("words", F.expr(_words("plain"))).withColumn("general", _general(F.col("plain")))
    variable = F.when(F.col("plain").rlike("[0-9]"), F.regexp_count("plain", F.lit(DIGITS))).otherwise(0)
    leaf = F.xxhash64("words", F.substring_index("general", " ", DEPTH)).bitwiseAND(F.lit(-2)).bitwiseOR((F.col("words") > LONG).cast("long"))
    return words.select("id", "same", "total", "pos", "words", (F.col("words") - variable).alias("constants"), leaf.alias("leaf"), F.xxhash64("words", "general").alias("line"), "plain")


def _need(min_docs: int) -> Column:
    """How many documents a leaf's lines need."""
    return F.when(F.col("leaf").bitwiseAND(F.lit(1)) == 1, min(2, min_docs)).otherwise(min_docs)


def _sure(constant: float, n: str) -> Column:
    """Whether enough of a line's words is constant."""
    return (F.col("constants") == F.col(n)) | (F.col("constants") >= F.greatest(constant * F.col(n), F.lit(float(LEAST_CONSTANT))))


def leaves(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, docs, low, high, words, constants): the leaves that enough documents meet; no other line can be of a recurring
    template. `low` and `high` are the least and greatest of its lines.

    Documents are told apart by their text, so exact copies count once. Only hashes of all lines are exchanged; what else
    is needed comes from the lines of the leaves that are left, summed up before the exchange.
    """
    counted = lines.select("leaf", "same").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).filter(F.col("docs") >= _need(min_docs))
    counted = written(counted, "leaves")
    facts = maybe_in(lines.select("leaf", "line", "words", "constants"), counted, "leaf").groupBy("leaf").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("words").alias("words"), F.max("constants").alias("constants"))
    return counted.join(facts, "leaf")


def _supported(rows: DataFrame, key: str) -> DataFrame:
    """(key, support) of the keys with enough distinct documents, grouped by document first; rows: (key, docs, same), a row
    per document known of a line, where docs (of the line) is null unless it is enough by itself. The lowest bit of `same`
    is that of the leaf."""
    each = rows.groupBy(key, "same").agg(F.max("docs").alias("docs"))
    counted = each.groupBy(key).agg(F.greatest(F.count("*"), F.max("docs")).alias("support"), F.max(F.col("same").bitwiseAND(F.lit(1))).alias("leaf"))
    return counted


def templates(lines: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """(line, template, pair) of lines (leaf, line, same, plain) whose template recurs; `pair`: in two documents, not min_docs.

    Documents are counted, not lines: a document with several lines of a template is one. A line that enough documents
    have needs no others; of any other line all documents are known by `some`, so the counts are exact up to min_docs.
    Lines of leaves that too few documents meet do no harm: none of their places is supported.
    """
    marked = F.col("same").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("leaf").bitwiseAND(F.lit(1)))
    some = F.array_distinct(F.array(F.min("same"), F.max("same"))) if min_docs <= 3 else F.collect_set("same")
    met = lines.select("line", "leaf", marked.alias("same")).distinct().groupBy("line", "leaf").agg(F.count("*").alias("docs"), some.alias("some"))
    met = met.withColumn("docs", F.when(F.col("docs") >= _need(min_docs), F.col("docs")))
    text = lines.groupBy("line").agg(F.min("plain").alias("plain"))
    own = written(met.join(text, "line").withColumn("tokens", F.split(_general(F.col("plain")), " ")).drop("plain"), "lines")
    tokens = own.select("line", "leaf", "docs", "some", F.posexplode("tokens").alias("pos", "token")).filter(F.col("token") != VARIABLE)
    places = tokens.select("line", "pos", "docs", "some", F.xxhash64("leaf", "pos", "token").alias("place"))
    counted = _supported(places.select("place", "docs", F.explode("some").alias("same")), "place")
    kept = written(counted.filter(F.col("support") >= _need(min_docs)).select("place"), "places")
    fixed = maybe_in(places.select("line", "pos", "place"), kept, "place").join(kept, "place", "left_semi")
    general = fixed.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("pos", "place"))).alias("fields"), F.count("*").alias("constants"))
    sized = general.join(own.select("line", "leaf", "docs", "some", F.size("tokens").alias("n")), "line").filter(_sure(constant, "n"))
    named = written(sized.select("line", "docs", "some", F.xxhash64("leaf", "n", "fields").alias("template")), "templates")
    release(own, kept)
    common = _supported(named.select("template", "docs", F.explode("some").alias("same")), "template")
    enough = common.filter(F.col("support") >= _need(min_docs))
    return named.join(enough, "template").select("line", "template", (F.col("support") < min_docs).alias("pair"))


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """(line, template, pair) of all lines whose template recurs.

    A leaf with one line needs no tree below it: all its documents have that line. Only the texts of the lines of other
    leaves are taken apart.
    """
    met = written(leaves(lines, min_docs), "leaves")
    alone = met.filter("low = high").filter(_sure(constant, "words")).select(F.col("low").alias("line"), F.col("low").alias("template"), (F.col("docs") < min_docs).alias("pair"))
    mixed = met.filter("low <> high").select("leaf")
    inside = maybe_in(lines.select("leaf", "line", "same", "plain"), mixed, "leaf")
    return written(alone.unionByName(templates(inside, min_docs, constant)).dropDuplicates(["line"]), "recurring")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, constant: float = CONSTANT, most: float = MOST) -> DataFrame:
    """`docs` with recurring lines dropped from text_col, plus `lines`, a struct of n_lines, n_recurring and n_dropped.

    Null texts stay null and empty ones empty (no lines with tokens); blank lines are never dropped. Null ids come
    after all others when the first line is chosen. Rows that share id and text are treated alike. A document of
    nothing but recurring lines becomes empty, unless it is a copy (see `most`). An empty table gives an empty one. A column
    named `lines` is replaced.
    """
    lines = written(_lines(docs, text_col, id_col), "lines")
    known = recurring(lines, min_docs, constant)
    place = maybe_in(lines.select("id", "same", "total", "pos", "words", "line"), known, "line")
    found = written(place.join(known, "line").select("template", "pair", "id", "same", "total", "pos", "words").distinct(), "found")
    release(lines)
    order = F.struct(F.col("id").isNull(), "id", "same", "pos", "total")
    salted = found.groupBy("template", F.pmod(F.xxhash64("same"), F.lit(SALT)).alias("salt")).agg(F.min(order).alias("first"))
    first = written(salted.groupBy("template").agg(F.min("first").alias("first")), "firsts")
    drop = found.join(first, "template").withColumn("drop", ~order.eqNullSafe(F.col("first")))
    lost = F.when(F.col("drop"), F.col("words"))
    held = drop.repartition("id", "same").groupBy("id", "same", "total", "template", "pair", "first").agg(F.count("*").alias("n"), F.sum(lost).alias("lost"), F.max(lost).alias("shared"), F.collect_list(F.when(F.col("drop"), F.col("pos"))).alias("at"))
    source = F.struct("first.id", "first.same", F.col("first.total").alias("size")).alias("source")
    sure, pair = F.flatten(F.collect_list(F.when(~F.col("pair"), F.col("at")))), F.flatten(F.collect_list(F.when(F.col("pair"), F.col("at"))))
    by_source = held.withColumn("source", source).groupBy("id", "same", "total", "source").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"), F.sum(F.when(F.col("pair"), F.col("lost"))).alias("lost_pair"), F.sum("shared").alias("shared"), sure.alias("at"), pair.alias("at_pair"))
    versions = F.coalesce(F.col("shared") > most * F.greatest("total", "source.size"), F.lit(False))
    by_source = by_source.withColumn("lost", F.col("lost") - F.when(versions, F.coalesce("lost_pair", F.lit(0))).otherwise(0)).withColumn("at", F.when(versions, F.col("at")).otherwise(F.concat("at", "at_pair")))
    near = F.coalesce(F.col("shared") > COPY * most * F.greatest("total", "source.size"), F.lit(False)) | (F.col("same") == F.col("source.same"))
    other = ~F.struct("id", "same").eqNullSafe(F.struct("source.id", "source.same"))
    by_doc = by_source.groupBy("id", "same", "total").agg(F.sum("n").cast("int").alias("n_recurring"), F.sum("lost").alias("lost"), F.max(near & other).alias("copy"), F.flatten(F.collect_list("at")).alias("at"))
    spared = F.col("copy") & (F.col("lost") > most * F.col("total"))
    marked = by_doc.select(F.col("id").alias("__id"), F.col("same").alias("__same"), "n_recurring", F.when(spared, F.array().cast("array<int>")).otherwise(F.col("at")).alias("at"))
    marked = written(marked, "marked")
    release(found, first)
    names = [c for c in docs.columns if c != "lines"]
    rest = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in names if c != text_col])
    row = docs.select(rest.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("same", F.xxhash64("text"))
    met = row.join(marked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("same") == F.col("__same")), "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "at"), lambda i: F.col("parts")[i]), "\n")
    cut = met.withColumn("parts", F.when(F.size("at") > 0, F.split("text", "\n")))
    left = F.when(F.size("at") == 0, F.col("text")).when(F.size("at") == F.size("parts"), "").otherwise(kept)
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    facts = F.struct(n_lines.alias("n_lines"), F.coalesce("n_recurring", F.lit(0)).alias("n_recurring"), F.size("at").alias("n_dropped"))
    out = cut.select("row", left.alias("__text"), facts.alias("__facts"))
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names], F.col("__facts").alias("lines"))


def op2_lines(spark, sf_dir: str) -> DataFrame:
    """All documents with the lines that stay."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_recurring", "lines.n_dropped", F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"))
