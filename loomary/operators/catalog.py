"""The review catalog, edits applied to captions, annotation batches, external captions and sticker packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, joined_text, normalize_text, stem
from ..shared import numbered, written


def export(images: DataFrame, *stores: tuple[DataFrame, dict[str, str]], key: str = "path") -> DataFrame:
    """Images with columns of stores (deduplicated by key), as text, blank where a store has no row.

    Each store comes with {its column: name in the catalog}.
    """
    met, names = images, []
    for k, (store, columns) in enumerate(stores):
        met = met.join(store.select(F.col(key).alias(f"k{k}"), *[F.col(c).alias(n) for c, n in columns.items()]), F.col(key) == F.col(f"k{k}"), "left")
        names += columns.values()
    return met.select(*images.columns, *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names])


def merged_fields(existing: dict[str, Column], incoming: dict[str, Column], overwrite: bool, fill: str = "NONE") -> dict[str, Column]:
    """Field by field: an edit wins if it isn't blank (or always, with overwrite); blanks are filled."""
    out = {}
    for f, old in existing.items():
        new = normalize_text(incoming[f])
        both = new if overwrite else F.when(new != "", new).otherwise(normalize_text(old))
        out[f] = F.coalesce(F.nullif(both, F.lit("")), F.lit(fill))
    return out


def apply_edits(store: DataFrame, edits: DataFrame, fields: list[str], overwrite: bool = False, key: str = "path", source: str = "catalog_csv", ordinal: str | None = None) -> DataFrame:
    """The store after edits, with `change`: kept, changed (visited, altered or not) or created. A failed record stays failed.

    Edits with a blank key are skipped; where a key repeats, its edits apply in order of `ordinal`: for each field the last
    that isn't blank (with overwrite: the last).
    """
    usable = edits.filter(normalize_text(F.col(key)) != "") if dict(edits.dtypes)[key] == "string" else edits.filter(F.col(key).isNotNull())
    if ordinal:
        value = lambda f: normalize_text(F.col(f))
        last = lambda f: F.max_by(value(f), F.col(ordinal)) if overwrite else F.max_by(value(f), F.when(value(f) != "", F.col(ordinal)))
        usable = usable.groupBy(key).agg(*[last(f).alias(f) for f in fields])
    old = store.select(F.col(key).alias("o"), F.lit(True).alias("old"), F.col("source").alias("old_source"), F.col("ok").alias("old_ok"), *[F.col(f).alias(f"o_{f}") for f in fields])
    new = usable.select(F.col(key).alias("n"), F.lit(True).alias("new"), *[F.col(f).alias(f"n_{f}") for f in fields])
    met = old.join(new, F.col("o") == F.col("n"), "full_outer")
    both = merged_fields({f: F.col(f"o_{f}") for f in fields}, {f: F.col(f"n_{f}") for f in fields}, overwrite)
    values = {f: F.when(F.col("new").isNull(), F.col(f"o_{f}")).otherwise(both[f]) for f in fields}
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "created").otherwise("changed")
    out = met.select(F.coalesce("o", "n").alias(key), F.coalesce("old_ok", F.lit(True)).alias("ok"), F.when(F.col("new").isNull(), F.col("old_source")).otherwise(F.coalesce(F.nullif("old_source", F.lit("")), F.lit(source))).alias("source"), change.alias("change"), *[v.alias(f) for f, v in values.items()])
    return out.withColumn("semantic_text", joined_text([F.col(f) for f in fields]))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """`df` plus batch_index: runs of `size` rows in order; among equal keys rows go by a hash. No task orders the whole table."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    return numbered(df, [order], "batch_index").withColumn("batch_index", F.expr(f"batch_index div {size}"))


def export_batches(images: DataFrame, done: DataFrame, size: int, limit: int = 0, overwrite: bool = False, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Images still to be annotated, in batches, and one row of batches, images and skipped_captioned.

    The skipped count is that of all captioned paths, also of those whose image is gone.
    """
    left = images if overwrite else images.join(done.select(key).distinct(), key, "left_anti")
    left = left.orderBy(key).limit(limit) if limit > 0 else left
    out = batches(left, key, size)
    counts = out.agg(F.count_distinct("batch_index").alias("batches"), F.count("*").alias("images"))
    return out, counts.crossJoin(done.agg(F.count_distinct(key).alias("skipped_captioned")))


def validate_external(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Rows with `problem`: null, missing path, or duplicate path (after the first row with that path)."""
    path = F.nullif(normalize_text(F.col(key)), F.lit(""))
    first = rows.groupBy(path.alias("__path")).agg(F.min(line).alias("__first")).filter("__path is not null")
    met = rows.withColumn("__own", path).join(first, F.col("__own") == F.col("__path"), "left")
    problem = F.when(F.col("__own").isNull(), F.lit("missing path")).when(F.col(line) > F.col("__first"), F.lit("duplicate path"))
    return met.withColumn("problem", problem).drop("__own", "__path", "__first")


def external_item(path: Column, caption: Column, raw: Column, top: dict[str, Column], model: Column, fields: list[str]) -> dict[str, Column]:
    """Columns of one external record: the stripped path, the fields (of the caption, if that is an object, else of the
    top level) with blanks filled, the joined text, and the model. `raw` is the caption's JSON text."""
    nested = F.coalesce(F.ltrim(raw).startswith("{"), F.lit(False))
    value = {f: normalize_text(F.when(nested, caption[f]).otherwise(top[f])) for f in fields}
    filled = {f: F.coalesce(F.nullif(v, F.lit("")), F.lit("NONE")) for f, v in value.items()}
    return {"path": normalize_text(path), "model": model, **filled, "semantic_text": joined_text(list(filled.values()))}


def validation_summary(checked: DataFrame, line: str) -> DataFrame:
    """One row over validate_external's rows: valid (a number) and errors, ordered by line.

    The list holds problems only, which are for people to mend; it is made of (line, problem) pairs.
    """
    found = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct(F.col(line).cast("long").alias("line"), "problem"))))
    return checked.agg(F.count_if(F.col("problem").isNull()).alias("valid"), found.alias("errors"))


def guarded_merge(existing: DataFrame, incoming: DataFrame, key: str, line: str, overwrite: bool) -> DataFrame:
    """merge_external, unless any incoming row has a problem: then ValueError names the first ones, and nothing is merged."""
    checked = validate_external(incoming, key, line)
    bad = checked.filter(F.col("problem").isNotNull()).orderBy(line).select(line, "problem").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"line {r[0]}: {r[1]}" for r in bad))
    return merge_external(existing, incoming.drop(line), key, overwrite)


def merge_external(existing: DataFrame, incoming: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """The merged store with `outcome`: kept, skipped (existing wins), replaced or added. Existing rows without key go; keys
    are unique on both sides (keep the last row of each first)."""
    old = existing.filter(F.col(key).isNotNull())
    values = [c for c in existing.columns if c != key]
    met = old.select(F.col(key).alias("o"), *[F.col(c).alias(f"o_{c}") for c in values]).join(incoming.select(F.col(key).alias("n"), *[F.col(c).alias(f"n_{c}") for c in values]), F.col("o") == F.col("n"), "full_outer")
    outcome = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "added").when(F.lit(overwrite), "replaced").otherwise("skipped")
    new = F.col("outcome").isin("added", "replaced")
    return met.withColumn("outcome", outcome).select(F.coalesce("o", "n").alias(key), *[F.when(new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in values], "outcome")


def resolve(items: DataFrame, key: str, path: Column, code: Column, files: DataFrame) -> DataFrame:
    """`items` plus `source` and `found_by`: the file of each item by a cascade of look-ups.

    `files`: (file, place: order of its folder, primary: in the pack's own folder, direct: can be opened by its full
    path). In turn: the literal path; the name in the pack's own folder; the name in any folder, case ignored; the code
    against stems, case ignored. The first folder, then the first file wins. All probes of an item are rows of one keyed
    table, so the files are exchanged once; the least rank that meets a file decides.
    """
    order = F.struct("place", F.split("file", "/"))
    name, ways = basename(F.col("file")), ["by_path", "by_own", "by_name", "by_code"]
    probe = lambda rank, key: F.struct(F.lit(rank).alias("rank"), key.alias("key"))
    keys = [F.when(F.col("direct"), F.col("file")), F.when(F.col("primary"), name), F.lower(name), F.upper(stem(F.col("file")))]
    known = files.select("file", "place", F.explode(F.array(*map(probe, range(4), keys))).alias("p")).filter("p.key is not null")
    table = known.groupBy(F.col("p").alias("at")).agg(F.min_by("file", order).alias("file"))
    asked = [path, basename(path), F.lower(basename(path)), F.upper(code)]
    marked = items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item"), F.array(*[probe(k, F.nullif(x, F.lit(""))) for k, x in enumerate(asked)]).alias("asked"))
    marked = written(marked.withColumn("n", F.monotonically_increasing_id()), "items")
    probes = marked.select("n", F.explode("asked").alias("at")).filter("at.key is not null")
    way = F.element_at(F.array(*map(F.lit, ways)), F.col("at.rank") + 1)
    best = probes.join(table, "at").select("n", "file", "at.rank", way.alias("way")).groupBy("n").agg(F.min_by(F.struct("file", "way"), "rank").alias("b"))
    return marked.join(best, "n", "left").select("item.*", F.col("b.file").alias("source"), F.col("b.way").alias("found_by"))


def missing_examples(resolved: DataFrame, position: str, n: int = 10) -> DataFrame:
    """The first n items without a file, in order of position."""
    return resolved.filter(F.col("source").isNull()).orderBy(position).limit(n)


def pack_profile(items: DataFrame, available: Column, downloaded: Column, size: Column) -> DataFrame:
    """One row of counts over a pack's items."""
    return items.agg(
        F.count("*").alias("metadata_records"),
        F.count_if(available).alias("available_source_files"),
        F.count_if(~available).alias("missing_source_files"),
        F.count_if(downloaded).alias("downloaded_records"),
        F.count_if(F.coalesce(size, F.lit(0)) > 0).alias("positive_file_size_records"),
    )
