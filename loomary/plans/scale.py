"""Queries over what large corpora need: stores with a commit log, pruned joins and searches, clusters without a matrix.

Like the others, each stands beside DuckDB SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bulk, captions, metric
from ..shared import new_path, numbered
from ..sources.log import Store
from ..streaming import state
from . import pipeline
from .flows import _counts, _index, _long, _score
from .queries import DIGITS, EMBEDDED, query, table

# A store with a commit log.

_logged = "select source, doc_id, lang, doc_id % 20 + 1 as commit from documents"


def _appended(spark, d) -> Store:
    """Documents keyed by source, in twenty commits; each in order of doc_id."""
    docs = table(spark, d, "documents").select("source", "doc_id", "lang")
    store = Store(spark, new_path(spark, "query-store"), docs.schema, "source")
    for k in range(20):
        store.append(docs.filter(F.col("doc_id") % 20 == k).orderBy("doc_id"))
    return store


@query(
    "store_log",
    f"""with l as ({_logged}), gone as (select distinct source from documents where doc_id % 50 = 4 and source is not null),
    own as (select * from l where source not in (from gone) union all select source, doc_id, lang, 22 as commit from documents where doc_id % 100 = 4)
    select source, doc_id, lang, commit from own where source is not null qualify row_number() over (partition by source order by commit desc, doc_id desc) = 1""",
)
def store_log(spark, d):
    """Twenty appends, a delete of keys, a later append of some of them, a compaction and a vacuum: the last row of each key."""
    store, docs = _appended(spark, d), table(spark, d, "documents").select("source", "doc_id", "lang")
    store.delete(docs.filter("doc_id % 50 = 4").select("source"))
    store.append(docs.filter("doc_id % 100 = 4").orderBy("doc_id"))
    store.compact()
    store.vacuum()
    return store.last(where=F.col("source").isNotNull()).select("source", "doc_id", "lang", "commit")


@query("store_order", f"select source, doc_id, lang, row_number() over (order by commit, doc_id) - 1 as place from ({_logged})")
def store_order(spark, d):
    """All rows of twenty appends with their place in the order of writing."""
    rows = _appended(spark, d).rows()
    return numbered(rows, ["commit", "position"], "place").select("source", "doc_id", "lang", "place")


@query("store_rewrite", "select source, doc_id, upper(lang) as lang, 21 as commit from documents where doc_id % 2 = 1")
def store_rewrite(spark, d):
    """An atomic rewrite of all rows, an older version still being readable before a vacuum."""
    store = _appended(spark, d)
    number = store.rewrite(lambda rows: rows.filter("doc_id % 2 = 1").withColumn("lang", F.upper("lang")))
    assert store.rows(number - 1).count() > store.rows().count()
    return store.rows().select("source", "doc_id", "lang", "commit")


# Vectors: all near pairs, many searches at once, a search that reads few cells.


@query(
    "near_vectors",
    f"""with v as (select vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as u from ({EMBEDDED}))
    select a.vec_id as a, b.vec_id as b, round(1 - list_inner_product(a.u, b.u), {DIGITS}) as distance from v a join v b on a.vec_id < b.vec_id where 1 - list_inner_product(a.u, b.u) < 0.5""",
)
def near_vectors(spark, d):
    """All pairs of vectors at cosine distance below 0.5, blocks that are too far apart never being compared."""
    pairs, _ = metric.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5, "cosine")
    return pairs.withColumn("distance", F.round("distance", DIGITS))


@query(
    "search_many",
    f"""with v as ({EMBEDDED}), s as (select a.vec_id as query, b.vec_id as vec_id, round(list_inner_product(a.e, b.e), {DIGITS}) as score from v a, v b where a.vec_id % 2 = 0)
    select query, row_number() over (partition by query order by score desc, vec_id) as rank, vec_id, score from s qualify rank <= 10""",
)
def search_many(spark, d):
    """The ten best rows for every second one, in one pass over the table."""
    v = table(spark, d, "embeddings")
    queries = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return bulk.search_many(queries, v, 10, "vec_id", "embedding", "query", DIGITS)


def _cells_search(mode):
    def run(spark, d):
        root = new_path(spark, "query-cells")
        bulk.write_cells(_index(spark, d), root, 16)
        got, _ = bulk.search_cells(spark, root, "src 12", _counts, top=20, mode=mode)
        return got.select("path", "ordinal", F.round("score", DIGITS).alias("score"), "best_field", F.size("field_scores").alias("n"), F.col("fields")["lang"].alias("lang"))

    return run


for _mode, _agg in (("max", "max(s)"), ("mean", "avg(s)"), ("sum", "sum(s)")):
    query(
        f"cells_search_{_mode}",
        f"""with {_long}, s as (select *, {_score} as s from i), a as (select path, ordinal, coalesce({_agg}, -1.0) as score, max(s) as m, count(s) as n, max(text) filter (field = 'lang') as lang, max(s) filter (field = 'lang') as sl from s group by path, ordinal)
        select path, ordinal, round(score, 6) as score, case when n = 0 then '' when sl = m then 'lang' else 'source' end as best_field, n, lang from a order by score desc, ordinal limit 20""",
    )(_cells_search(_mode))


# A stream of changes with state.


@query(
    "stream_state",
    """with e as (select 'p' || doc_id % 40 as path, doc_id * 7919 % 100003 as seq, doc_id % 9 = 4 as removed, lang from documents),
    l as (select path, max(seq) as seq, arg_max(removed, seq) as removed, arg_max(lang, seq) as lang from e group by path)
    select path, seq, lang as text, length(lang) as v0 from l where not removed""",
)
def stream_state(spark, d):
    """Documents as changes of forty paths, out of order and each twice, in four batches: the table as the last ones leave it."""
    folder = new_path(spark, "query-events")
    n = F.col("doc_id")
    events = table(spark, d, "documents").select(n, F.concat(F.lit("p"), (n % 40).cast("string")).alias("path"), (n * 7919 % 100003).alias("seq"), F.timestamp_seconds(n * 60).alias("at"), (n % 9 == 4).alias("removed"), F.col("lang").alias("payload"))
    for k in range(4):
        own = events.filter((n % 4 == k) | (n % 4 == (k + 1) % 4)).drop("doc_id")
        own.coalesce(1).write.mode("append").json(folder)
    encode = lambda df: df.select("path", F.col("payload").alias("text"), F.length("payload").alias("v0"))
    schema = state.table_of(encode(spark.createDataFrame([], "path string, payload string")).schema)
    store = Store(spark, new_path(spark, "query-synced"), schema)
    stream = spark.readStream.schema("path string, seq long, at timestamp, removed boolean, payload string").option("maxFilesPerTrigger", 1).json(folder)
    state.follow(stream, encode, store, new_path(spark, "query-checkpoint")).awaitTermination()
    return state.current(store).select("path", "seq", "text", "v0")


# Calls with a journal.


def _odd_ones_fail(path: str) -> str:
    if int(path[1:]) % 7 == 0:
        raise ValueError("no")
    return f"c{path[1:]}"


@query("caption_once", "select 'p' || doc_id as path, doc_id % 7 <> 0 as ok, case when doc_id % 7 <> 0 then 'c' || doc_id end as content from documents")
def caption_once(spark, d):
    """Every document called once: half of them in a run before, whose answers the journal gives."""
    rows, journal = table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")), new_path(spark, "query-journal")
    once = lambda df, run: captions.describe_once(df, _odd_ones_fail, journal, run, 8, retries=0).select("path", "ok", "content")
    once(rows.filter("cast(substr(path, 2) as long) % 2 = 0"), "first").write.format("noop").mode("overwrite").save()
    return once(rows, "second")


# Images to the cluster table.


def _modelled(df):
    """Feature rows of vectors as images: a direction for each of ten classes as the model's vector, every tenth image broken."""
    n, fine = F.col("vec_id"), F.col("vec_id") % 10 != 3
    vector = F.array(*[F.when(n % 7 == k, 1.0).otherwise(0.0).cast("float") for k in range(7)])
    facts = {"file_name": F.concat(n.cast("string"), F.lit(".png")), "asset_type": F.lit("static"), "asset_confidence": F.lit(0.5), "width": F.lit(64), "height": F.lit(32), "aspect_ratio": F.lit(2.0), "suffix": F.lit(".png"), "ahash": F.lit("00"), "color_diversity": F.lit(0.25), "edge_density": F.lit(0.125), "saturation_mean": F.lit(0.75), "brightness_mean": F.lit(0.5)}
    return df.select(F.concat(F.lit("i/"), n.cast("string")).alias("path"), F.when(fine, vector).alias("feature"), F.lower(F.lpad(F.hex("vec_id"), 16, "0")).alias("dhash"), F.when(~fine, "broken").alias("error"), *[v.alias(k) for k, v in facts.items()])


@query(
    "run_pipeline",
    """with g as (select 'i/' || vec_id as path, vec_id, vec_id % 7 as k from embeddings where vec_id % 10 <> 3), r as (select k, count(*) as n, row_number() over (order by min(path)) - 1 as place from g group by k)
    select path, vec_id || '.png' as file_name, 'static' as asset_type, '0.5' as asset_confidence, printf('visual_%04d', place) as visual_cluster_id, 'dup_0000' as near_duplicate_group, n::varchar as cluster_size, (count(*) over ())::varchar as duplicate_group_size,
    '64' as width, '32' as height, '2.0' as aspect_ratio, '.png' as suffix, printf('%016x', vec_id) as dhash, '00' as ahash, '0.25' as color_diversity, '0.125' as edge_density, '0.75' as saturation_mean, '0.5' as brightness_mean, 'clip' as encoder from g join r using (k)""",
)
def run_pipeline(spark, d):
    """All nineteen columns of the cluster table's CSV, read back."""
    return pipeline.run_pipeline(table(spark, d, "embeddings"), new_path(spark, "query-pipeline"), _modelled, "clip")[0]


@query("run_pipeline_counts", "select count(*) as records, count(*) filter (vec_id % 10 <> 3) as valid_records, 7 as feature_dim, 7::bigint as visual_clusters, 1::bigint as near_duplicate_groups from embeddings")
def run_pipeline_counts(spark, d):
    return pipeline.run_pipeline(table(spark, d, "embeddings"), new_path(spark, "query-pipeline"), _modelled, "clip")[1]
