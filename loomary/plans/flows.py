"""Queries over whole flows: index life cycle, sources and sinks read back, captioning, imports, external captions, features.

Like the others, each stands beside DuckDB SQL that gives the same rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features, text
from ..operators import captions, catalog, clusters, stores
from ..operators import vectors as search
from ..schema import CAPTION_RECORD, CATALOG_COLUMNS
from ..shared import new_path
from ..sources import files, sinks
from .queries import DIGITS, EMBEDDED, _no_wait, query, table

# Index life cycle. The encoder is one that SQL can repeat: numbers of characters, of s and of digits.


def _counts(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count("s"), sum(c.isdigit() for c in t)] for t in texts], np.float32).reshape(-1, 3)


def _records(spark, d) -> DataFrame:
    path = F.concat(F.lit("images/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(path.alias("path"), F.col("doc_id").alias("ordinal"), "lang", F.when(F.col("doc_id") % 4 == 0, "none").otherwise(F.col("source")).alias("source"))


def _index(spark, d) -> DataFrame:
    return search.build_index(_records(spark, d), ["lang", "source"], _counts, "counts")


_clean = "trim(coalesce({0}, ''))"
_long = f"""r as (select 'images/' || doc_id as path, doc_id as ordinal, lang, case when doc_id % 4 = 0 then 'none' else source end as source from documents),
    l as (select path, ordinal, 'lang' as field, 0 as position, {_clean.format('lang')} as text from r union all select path, ordinal, 'source', 1, {_clean.format('source')} from r),
    i as (select *, text not in ('', 'none', 'NONE', '无', '未知', 'null', 'NULL', 'N/A', 'n/a') as valid from l)"""


@query("index_build", f"with {_long}, t as (select *, case when valid then text else '' end as t from i) select path, ordinal, field, position, text, valid, length(t) as v0, length(t) - length(replace(t, 's', '')) as v1, length(regexp_replace(t, '[^0-9]', '', 'g')) as v2, 'counts' as model from t")
def index_build(spark, d):
    return _index(spark, d).select("path", "ordinal", "field", "position", "text", "valid", *[F.get("vector", F.lit(k)).cast("long").alias(f"v{k}") for k in range(3)], "model")


def _index_search(mode):
    def run(spark, d):
        got = search.search(_index(spark, d), "src 12", _counts, top=20, mode=mode, known=["lang", "source"])
        return got.select("path", "ordinal", F.round("score", DIGITS).alias("score"), "best_field", F.size("field_scores").alias("n"), F.col("fields")["lang"].alias("lang"))

    return run


_score = "case when valid then (6 * length(text) + (length(text) - length(replace(text, 's', ''))) + 2 * length(regexp_replace(text, '[^0-9]', '', 'g')))::double end"
for _mode, _agg in (("max", "max(s)"), ("mean", "avg(s)"), ("sum", "sum(s)")):
    query(
        f"index_search_{_mode}",
        f"""with {_long}, s as (select *, {_score} as s from i), a as (select path, ordinal, coalesce({_agg}, -1.0) as score, max(s) as m, count(s) as n, max(text) filter (field = 'lang') as lang, max(s) filter (field = 'lang') as sl from s group by path, ordinal)
        select path, ordinal, round(score, 6) as score, case when n = 0 then '' when sl = m then 'lang' else 'source' end as best_field, n, lang from a order by score desc, ordinal limit 20""",
    )(_index_search(_mode))


@query(
    "index_upsert",
    f"""with {_long}, t as (select max(ordinal) as top from i)
    select path, ordinal, field, text from i where ordinal % 9 <> 0 union all select path, top + 1 + ordinal, field, 'new' from i, t where ordinal % 9 = 0""",
)
def index_upsert(spark, d):
    """New rows replace those of their paths at the end; a field that the index doesn't have is left out."""
    fresh = _records(spark, d).filter("ordinal % 9 = 0").select("path", "ordinal", *[F.lit("new").alias(c) for c in ("lang", "source", "extra")])
    out = search.upsert_paths(_index(spark, d), search.encoded(fresh, ["lang", "source", "extra"], _counts, "other"))
    return out.select("path", "ordinal", "field", "text")


@query("index_remove", f"with {_long} select count(distinct path) filter (ordinal % 5 = 0) as removed, count(*) filter (ordinal % 5 <> 0) as rows_left from i")
def index_remove(spark, d):
    left, removed = search.remove_paths(_index(spark, d), _records(spark, d).filter("ordinal % 5 = 0").select("path"))
    return removed.crossJoin(left.agg(F.count("*").alias("rows_left")))


@query(
    "zero_shot_scores",
    f"with v as ({EMBEDDED}) select vec_id, 'first' as label, round(e[1], 6) as score from v union all select vec_id, 'sum', round(list_sum(e), 6) from v",
)
def zero_shot_scores(spark, d):
    found = search.zero_shot(table(spark, d, "embeddings"), "vec_id", "embedding", [("first", [1.0] + [0.0] * 63), ("sum", [1.0] * 64)], DIGITS)
    return found.select("vec_id", F.explode("scores").alias("label", "score"))


# Sources and sinks, read back.


def _fresh(spark, label):
    return new_path(spark, f"query-{label}")


@query("jsonl_lines", "select doc_id, source, lang from documents where doc_id % 2 = 0 union all select doc_id, source, lang from documents where doc_id % 3 = 0")
def jsonl_lines(spark, d):
    """An append to a log and a dry run, and plain lines among which the lenient reader skips a malformed and a blank one."""
    docs, path, plain = table(spark, d, "documents").select("doc_id", "source", "lang"), _fresh(spark, "jsonl"), _fresh(spark, "lines")
    sinks.append_jsonl(docs.filter("doc_id % 2 = 0"), path)
    sinks.append_jsonl(docs, path, dry_run=True)
    docs.filter("doc_id % 3 = 0").write.json(plain)
    spark.createDataFrame([('{"doc_id": 1, "sou',), ("",)], "value string").write.mode("append").text(plain)
    return files.jsonl(spark, path, docs.schema).unionByName(files.jsonl(spark, plain, docs.schema))


@query(
    "strict_captions",
    "select 'p' || doc_id as path, ordinal, coalesce(nullif(trim(coalesce(lang, '')), ''), 'NONE') as action, coalesce(nullif(trim(coalesce(source, '')), ''), 'NONE') as notes from (select *, row_number() over (order by doc_id) - 1 as ordinal from documents) where doc_id % 3 <> 0",
)
def strict_captions(spark, d):
    """Caption records as lines of several files; those that aren't ok are left out. The ordinal is the line's place over all files."""
    own, path = table(spark, d, "documents"), _fresh(spark, "captions")
    caption = F.struct(F.col("lang").alias("action"), F.col("source").alias("notes"))
    lines = own.select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 3 != 0).alias("ok"), caption.alias("caption"))
    lines.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.json(path)
    return files.captions(spark, path, CAPTION_RECORD, ["action", "notes"]).select("path", "ordinal", "action", "notes")


@query("catalog_csv", "select 'p' || doc_id as path, coalesce(source, '') as notes, 'a \"b\", ' || chr(10) || 'c' as action from documents")
def catalog_csv(spark, d):
    """Quotes, commas and line ends survive the CSV; columns that the rows lack are blank."""
    path = _fresh(spark, "csv")
    sinks.catalog_csv(table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("notes"), F.lit('a "b", \nc').alias("action")), path)
    return files.csv_by_path(spark, path, CATALOG_COLUMNS).select("path", F.coalesce("notes", F.lit("")).alias("notes"), "action")


@query("cluster_csv", "select 'p' || doc_id as path, source as visual_cluster_id, 'clip' as encoder from documents where doc_id % 4 <> 1 and source is not null and source <> ''")
def cluster_csv(spark, d):
    """Rows with an error aren't written."""
    path = _fresh(spark, "clusters")
    own = table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("visual_cluster_id"), F.when(F.col("doc_id") % 4 == 1, "broken").alias("error"))
    sinks.cluster_csv(own, path, "clip")
    return files.cluster_rows(spark, path).select("path", "visual_cluster_id", "encoder")


@query("caption_snapshot", "select doc_id, lang from documents where doc_id % 2 = 1")
def caption_snapshot(spark, d):
    """The store's second version replaces the first."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang"), _fresh(spark, "snapshot")
    sinks.snapshot(docs, path)
    sinks.snapshot(docs.filter("doc_id % 2 = 1"), path)
    return sinks.read_snapshot(spark, path)


@query("vector_table", f"with {_long} select path, field, valid from i")
def vector_table(spark, d):
    path = _fresh(spark, "vectors")
    sinks.vector_table(_index(spark, d), path)
    return files.vectors(spark, path).select("path", "field", "valid")


@query("indexed_paths", "select 'images/' || doc_id as path from documents")
def indexed_paths(spark, d):
    path = _fresh(spark, "vectors")
    assert files.vectors_or_none(spark, path) is None
    sinks.vector_table(_index(spark, d), path)
    return files.indexed_paths(spark, path)


@query("batch_files", "select doc_id, (row_number() over (order by doc_id) - 1) // 300 as batch_index, sha256(coalesce(text, '')) as sha from documents")
def batch_files(spark, d):
    """Whole documents in batches, written by batch and read back."""
    path = _fresh(spark, "batches")
    sinks.batches(catalog.batches(table(spark, d, "documents"), "doc_id", 300), path)
    back = spark.read.schema("doc_id long, text string, batch_index long").json(path)
    return back.select("doc_id", F.col("batch_index").cast("long").alias("batch_index"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


# Annotation, imports, captions.


@query("batch_assign_wide", "select *, (row_number() over (order by doc_id) - 1) // 50 as batch_index from documents")
def batch_assign_wide(spark, d):
    return catalog.batches(table(spark, d, "documents"), "doc_id", 50)


@query("export_batches", "with l as (select * from documents where doc_id not in (select doc_id from labels) order by doc_id limit 130) select (count(*) + 39) // 40 as batches, count(*) as images, (select count(distinct doc_id) from labels) as skipped_captioned from l")
def export_batches(spark, d):
    return catalog.export_batches(table(spark, d, "documents"), table(spark, d, "labels"), 40, limit=130, key="doc_id")[1]


@query(
    "validation_summary",
    """with r as (select conv_id * 1000 + turn as line, case when turn % 4 = 3 then ' ' else 'c' || conv_id || '/' || turn // 2 end as path from conversations), p as (select line, case when trim(path) = '' then 'missing path' when row_number() over (partition by trim(path) order by line) > 1 then 'duplicate path' end as problem from r)
    select count(*) filter (problem is null) as valid, count(problem) as n_errors, min(line) filter (problem is not null) as first_line, max_by(problem, line) filter (problem is not null) as last_problem from p""",
)
def validation_summary(spark, d):
    path = F.when(F.col("turn") % 4 == 3, " ").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.expr("turn div 2").cast("string")))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), path.alias("path"))
    summary = catalog.validation_summary(catalog.validate_external(rows, "path", "line"), "line")
    return summary.select("valid", F.size("errors").cast("long").alias("n_errors"), F.col("errors")[0]["line"].alias("first_line"), F.element_at("errors", -1)["problem"].alias("last_problem"))


@query(
    "guarded_merge",
    "select coalesce(o.doc_id, n.doc_id)::varchar as path, case when n.doc_id is null then o.lang else n.source end as lang, case when n.doc_id is null then 'kept' when o.doc_id is null then 'added' else 'replaced' end as outcome from (select * from documents where doc_id % 2 = 0) o full join (select * from documents where doc_id % 3 = 0) n on o.doc_id = n.doc_id",
)
def guarded_merge(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    return catalog.guarded_merge(docs.filter("doc_id % 2 = 0").select("path", "lang"), docs.filter("doc_id % 3 = 0").select("path", F.col("source").alias("lang"), F.col("doc_id").alias("line")), "path", "line", True)


@query(
    "external_items",
    "select event_id, coalesce(nullif(trim(coalesce(case when event_id % 2 = 0 then props ->> 'k' else event_type end, '')), ''), 'NONE') as action, coalesce(case when event_id % 2 = 0 then props ->> 'k' else event_type end, '') as semantic_text from events",
)
def external_items(spark, d):
    rows = table(spark, d, "events").withColumn("raw", F.when(F.col("event_id") % 2 == 0, F.col("props")))
    nested = F.struct(F.get_json_object("raw", "$.k").alias("action"))
    made = catalog.external_item(F.col("event_id").cast("string"), nested, F.col("raw"), {"action": F.col("event_type")}, F.lit("m"), ["action"])
    return rows.select("event_id", made["action"].alias("action"), made["semantic_text"].alias("semantic_text"))


@query(
    "import_folder",
    """with f as (select doc_id, '/in/doc ' || doc_id || '.JPG' as source, sha256(coalesce(text, '')) as sha256 from documents), k as (select distinct sha256 from f where doc_id % 10 = 3), p as (select f.*, k.sha256 is not null as known, row_number() over (partition by f.sha256 order by source) as n from f left join k on f.sha256 = k.sha256)
    select source, '/out/my_set_doc_' || doc_id || '_' || sha256[1:16] || '.jpg' as destination, case when known or n > 1 then 'skipped_duplicate' else 'imported' end as action from p""",
)
def import_folder(spark, d):
    own = table(spark, d, "documents").select(F.concat(F.lit("/in/doc "), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.lit(1).alias("length"), "doc_id")
    known = own.filter("doc_id % 10 = 3").select(F.sha2("content", 256).alias("sha256"))
    return stores.import_folder(own, known, "/out/", "my set")[0].select("source", "destination", "action")


@query(
    "import_pack",
    "select count(*) filter (s_suppkey % 5 <> 0 and s_suppkey % 7 <> 1) as imported, 0 as exists, count(*) filter (s_suppkey % 5 <> 0 and s_suppkey % 7 = 1) as skipped_duplicate, count(*) filter (s_suppkey % 5 <> 0) as total, count(*) filter (s_suppkey % 5 = 0) as missing, true as ok from supplier",
)
def import_pack(spark, d):
    n = F.col("s_suppkey")
    items = table(spark, d, "supplier").select(n.alias("position"), n.cast("string").alias("sticker_id"), F.md5("s_name").alias("md5"), F.when(n % 5 != 0, F.concat(F.lit("/p/"), n.cast("string"), F.lit(".png"))).alias("source"), F.sha2("s_name", 256).alias("sha256"))
    return stores.import_pack(items, items.filter("position % 7 = 1").select("sha256"), "/out")[1]


@query("missing_examples", "select s_suppkey as position from supplier where s_suppkey % 5 = 0 order by s_suppkey limit 10")
def missing_examples(spark, d):
    n = F.col("s_suppkey")
    items = table(spark, d, "supplier").select(n.alias("position"), F.when(n % 5 != 0, "file").alias("source"))
    return catalog.missing_examples(items, "position").select("position")


@query("uploads", "select doc_id, case when doc_id % 3 <> 0 then '1577836800_' || sha256(coalesce(text, ''))[1:16] || '.webp' end as name, case when doc_id % 3 = 0 then 'unsupported type' end as problem from documents")
def uploads(spark, d):
    path = F.concat(F.lit("up/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".WEBP"))
    rows = table(spark, d, "documents").select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return stores.uploads(rows, F.timestamp_seconds(F.lit(1577836800))).select("doc_id", "name", "problem")


def _mixed(path: str) -> str:
    n = int(path)
    if n % 5 == 0:
        raise captions.RequestError("busy", 503) if n % 2 else ValueError("bad image")
    return json.dumps({"action": [f"a{n % 3}", ""], "notes": n})


@query(
    "caption_results",
    "select doc_id::varchar as path, case when doc_id % 5 = 0 then 'failed' else 'ok' end as status, case when doc_id % 5 <> 0 then 'a' || doc_id % 3 end as action, case when doc_id % 5 <> 0 then 'a' || doc_id % 3 || '；' || doc_id end as semantic_text, case when doc_id % 5 <> 0 then null when doc_id % 2 = 1 then 'busy' else 'bad image' end as error, case when doc_id % 10 = 5 then 503 end as http, case when doc_id % 5 = 0 then 2 else 1 end as attempts from documents",
)
def caption_results(spark, d):
    """Good and failed calls in one batch, answers parsed: lists joined, numbers printed."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    made = captions.describe(rows, _mixed, 1, _no_wait)
    caption, whole = text.parse_caption(F.col("content"))
    status = captions.status_label(F.col("ok"))
    return made.select("path", status.alias("status"), F.when(F.col("ok"), caption["action"]).alias("action"), F.when(F.col("ok"), whole).alias("semantic_text"), "error", F.col("status").alias("http"), "attempts")


@query("run_counters", "select count(*) filter (doc_id % 5 <> 0) as completed, count(*) filter (doc_id % 5 = 0) as failed, 0 as skipped, count(*) as total from documents")
def run_counters(spark, d):
    action = F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("completed")
    return captions.run_counters(table(spark, d, "documents").withColumn("action", action), "action", ["completed", "failed", "skipped"])


@query(
    "caption_representatives",
    "select doc_id::varchar as path, doc_id % 5 <> 0 as ok, 'qwen' as source, case when doc_id % 5 <> 0 then 'a' || doc_id % 3 || '；' || doc_id end as semantic_text, source as visual_cluster_id from (select *, row_number() over (partition by source order by doc_id::varchar) as n from documents where source is not null) where n = 1",
)
def caption_representatives(spark, d):
    own = table(spark, d, "documents").filter("source is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("visual_cluster_id"), F.lit("3").alias("cluster_size"), F.lit("animal").alias("asset_type"))
    first = clusters.representatives(own, own.limit(0))
    made = captions.caption_representatives(first, _mixed, "qwen", text.parse_caption, retries=0)
    return made.select("path", "ok", "source", "semantic_text", "cluster.visual_cluster_id")


@query(
    "caption_answers",
    """with r as (select event_id, case event_id % 5 when 0 then props when 1 then '{"k": ["' || event_type || '", " ", "x "]}' when 2 then 'no json' when 3 then '["k"]' else '{"action": {"b": ' || event_id || ', "a": true}}' end as raw from events)
    select event_id, case event_id % 5 when 4 then '{"a": true, "b": ' || event_id || '}' when 0 then 'NONE' else 'NONE' end as action from r""",
)
def caption_answers(spark, d):
    """Answers of all kinds: objects print as Python prints them, whatever is no object has blank fields."""
    kind, event = F.col("event_id") % 5, F.col("event_type")
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit('{"k": ["'), event, F.lit('", " ", "x "]}'))).when(kind == 2, "no json").when(kind == 3, '["k"]')
    raw = raw.otherwise(F.concat(F.lit('{"action": {"b": '), F.col("event_id").cast("string"), F.lit(', "a": true}}')))
    return table(spark, d, "events").select("event_id", text.parsed_caption(raw)["action"].alias("action"))


# Features and clusters. An image is the 64 numbers of an embedding, each a square of 8 x 8 pixels.


def _square(content: bytes) -> features.Decoded:
    values = np.frombuffer(content, "<f4").astype(float)
    if len(values) != 64:
        raise OSError("not an image")
    grey = ((values + 1) / 2).reshape(8, 8)
    pixels = np.repeat(np.repeat(np.stack([grey, grey, grey], axis=-1), 8, axis=0), 8, axis=1)
    return features.Decoded(pixels, (pixels[::2, ::2] * 255).astype(np.uint8), 64, 32, grey, np.hstack([grey, grey[:, :1]]))


@F.pandas_udf(T.BinaryType())
def _raw(vectors):
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes())


def _made(spark, d) -> DataFrame:
    own = table(spark, d, "embeddings")
    content = _raw(F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return features.build_features(own.select(F.concat(F.col("vec_id").cast("string"), F.lit(".GIF")).alias("path"), content.alias("content")), _square)


@query(
    "feature_rows",
    f"""with v as ({EMBEDDED}), g as (select vec_id, vec_id % 10 = 3 as bad, list_transform(e, lambda x: (x + 1) / 2) as g from v), m as (select *, list_sum(g) / 64 as mean from g)
    select vec_id || '.GIF' as path, case when not bad then 64 end as width, case when not bad then 2.0 end::double as aspect_ratio, case when not bad then '.gif' end as suffix, case when not bad then 'animated' end as asset_type, case when not bad then round(mean, 4) end as brightness_mean,
    case when not bad then 0.0 end::double as saturation_mean, case when not bad then round(sqrt(list_sum(list_transform(g, lambda x: (x - mean) * (x - mean))) / 64), 4) end as brightness_std, case when not bad then len(list_filter(g, lambda x: x >= 0.375 and x < 0.5)) / 64.0 end::double as bin3, case when bad then 'not an image' end as error from m""",
)
def feature_rows(spark, d):
    at = lambda i: F.get("feature", F.lit(i)).cast("double")
    return _made(spark, d).select("path", "width", "aspect_ratio", "suffix", "asset_type", F.round("brightness_mean", 4).alias("brightness_mean"), F.round("saturation_mean", 4).alias("saturation_mean"), F.round(at(25), 4).alias("brightness_std"), F.round(at(3), 6).alias("bin3"), "error")


@query("feature_summary", "select count(*) as records, count(*) filter (vec_id % 10 <> 3) as valid_records, 34 as feature_dim from embeddings")
def feature_summary(spark, d):
    return features.build_summary(_made(spark, d))


@query("cluster_pipeline", "select count(*) filter (vec_id % 10 <> 3) as records, count(distinct label) filter (vec_id % 10 <> 3) as visual_clusters from embeddings")
def cluster_pipeline(spark, d):
    """Features by a model (one direction per label), clustered: one visual cluster a label."""
    own = table(spark, d, "embeddings").filter("label is not null")
    labels = [r[0] for r in own.select("label").distinct().orderBy("label").collect()]  # a row per label
    vector = F.array(*[F.when(F.col("label") == x, 1.0).otherwise(0.0).cast("float") for x in labels])
    made = own.select(F.col("vec_id").cast("string").alias("path"), F.when(F.col("vec_id") % 10 != 3, vector).alias("feature"), F.lower(F.lpad(F.hex("vec_id"), 16, "0")).alias("dhash"), F.when(F.col("vec_id") % 10 == 3, "broken").alias("error"))
    return clusters.cluster_counts(clusters.cluster_features(made, "clip")).select("records", "visual_clusters")


# Display and requests.


@query("result_markdown", "select vec_id, '![preview](/images/' || vec_id || '.png)' || chr(10) || '**路径**: `i/' || vec_id || '.png`' || chr(10) || '**分数**: ' || printf('%.4f', vec_id / 8.0) || '  **最佳字段**: notes' || case when vec_id % 2 = 0 then chr(10) || '**补充**: n' || vec_id else '' end as markdown from embeddings")
def result_markdown(spark, d):
    n = F.col("vec_id").cast("string")
    path = F.concat(F.lit("i/"), n, F.lit(".png"))
    notes = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("n"), n)).otherwise("none")
    return table(spark, d, "embeddings").select("vec_id", text.result_markdown(text.image_url(path), path, F.col("vec_id") / 8, F.lit("notes"), {"补充": notes}).alias("markdown"))


@query("full_paths", "select page_id, case when page_id % 2 = 0 then '/a/' || page_id else '/root/p/x' || page_id end as path from pages")
def full_paths(spark, d):
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/a/"), n)).otherwise(F.concat(F.lit("x"), n))
    return table(spark, d, "pages").select("page_id", text.full_path(path, "/root/p").alias("path"))


@query("request_bodies", "select page_id, 'data:' || page_id as url, 'm' as model, 2 as messages, 'json_object' as form from pages")
def request_bodies(spark, d):
    body = captions.request_body("m", "be short", "what is it?", F.concat(F.lit("data:"), F.col("page_id").cast("string")), json_mode=True)
    rows = table(spark, d, "pages").select("page_id", body.alias("body"))
    at = lambda p: F.get_json_object("body", p)
    return rows.select("page_id", at("$.messages[1].content[1].image_url.url").alias("url"), at("$.model").alias("model"), F.when(at("$.messages[0].role") == "system", 2).otherwise(0).alias("messages"), at("$.response_format.type").alias("form"))


