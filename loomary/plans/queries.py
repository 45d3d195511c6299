"""The registered queries over the shared tables, each beside DuckDB SQL that gives the same rows.

The tables stand in for the corpus: documents for captions and files, embeddings for vectors and small images, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, hashing, text, vectors
from ..operators import captions, catalog, clusters, stores
from ..operators import vectors as search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Search.

EMBEDDED = "select vec_id, label, embedding::double[] as e from embeddings"


def _query_vector(df: DataFrame, vec_id: int) -> list[float]:
    return df.filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _semantic(spark, d, k):
    df = table(spark, d, "embeddings")
    scored = df.select("vec_id", F.round(vectors.dot(F.col("embedding"), vectors.literal(_query_vector(df, 0))), DIGITS).alias("score"))
    return search.top_k(scored, k, "vec_id")


SEMANTIC = f"with v as ({EMBEDDED}), s as (select a.vec_id, round(list_inner_product(a.e, b.e), 6) as score from v a, v b where b.vec_id = 0)"


@query("semantic_topk", f"{SEMANTIC} select * from s order by score desc, vec_id limit 10")
def semantic_topk(spark, d):
    return _semantic(spark, d, 10)


@query("topk_clamped", f"{SEMANTIC} select 'zero' as k_case, * from (select * from s order by score desc, vec_id limit 1) union all select 'all', * from s")
def topk_clamped(spark, d):
    one, every = _semantic(spark, d, 0), _semantic(spark, d, 2_000_000_000)
    return one.select(F.lit("zero").alias("k_case"), "*").unionByName(every.select(F.lit("all").alias("k_case"), "*"))


FIELDS = [f"f{i}" for i in range(4)]


def _fields(df: DataFrame) -> DataFrame:
    """Four vectors per row, slices of the embedding scaled to length one; field i is valid unless i + 2 divides vec_id."""
    parts = [vectors.unit(F.slice("embedding", 1 + 16 * i, 16)).alias(f"f{i}") for i in range(4)]
    return df.select("vec_id", *parts, *[(F.col("vec_id") % (i + 2) != 0).alias(f"v{i}") for i in range(4)])


def _scored(spark, d, mode, chosen=None):
    df = _fields(table(spark, d, "embeddings"))
    q = df.filter("vec_id = 7").select(*FIELDS).first()
    names = search.check_fields(chosen, FIELDS)
    out = search.score_wide(df, {f: q[f] for f in names}, {f: F.col(f) for f in names}, {f: F.col("v" + f[1:]) for f in names}, mode, DIGITS)
    return out.withColumn("score", F.round("score", DIGITS))


_slices = ", ".join(f"e[{1 + 16 * i}:{16 + 16 * i}] as f{i}" for i in range(4))
_scores = ", ".join(f"case when a.vec_id % {i + 2} <> 0 then round(list_inner_product(a.f{i}, q.f{i}) / sqrt(list_inner_product(a.f{i}, a.f{i})) / sqrt(list_inner_product(q.f{i}, q.f{i})), 6) end as s{i}" for i in range(4))
FIELD_SQL = f"with v as ({EMBEDDED}), f as (select vec_id, {_slices} from v), s as (select a.vec_id, {_scores} from f a, f q where q.vec_id = 7)"


def _combined_sql(mode: str, ids: list[int]) -> str:
    values = "list_filter([" + ", ".join(f"s{i}" for i in ids) + "], lambda x: x is not null)"
    score = {"max": "list_max(l)", "sum": "list_sum(l)", "mean": "list_sum(l) / len(l)"}[mode]
    best = " ".join(f"when s{i} = list_max(l) then 'f{i}'" for i in ids)
    return f"{FIELD_SQL}, l as (select *, {values} as l from s) select vec_id, coalesce(round(case when len(l) = 0 then -1.0 else {score} end, 6), -1.0) as score, case when len(l) = 0 then '' {best} end as best_field from l"


def _field_search(mode, chosen=None):
    def run(spark, d):
        return search.top_k(_scored(spark, d, mode, chosen).select("vec_id", "score", "best_field"), 10, "vec_id")

    return run


for _mode in search.MODES:
    query(f"field_search_{_mode}", f"{_combined_sql(_mode, [0, 1, 2, 3])} order by score desc, vec_id limit 10")(_field_search(_mode))
query("selected_fields_subset", f"{_combined_sql('max', [1, 3])} order by score desc, vec_id limit 10")(_field_search("max", ["f1", "f3", "f1"]))


@query("best_field_per_row", _combined_sql("sum", [0, 1, 2, 3]))
def best_field_per_row(spark, d):
    return _scored(spark, d, "sum").select("vec_id", "score", "best_field")


@query("field_scores_long", FIELD_SQL + " " + " union all ".join(f"select vec_id, 'f{i}' as field, s{i} as score from s where s{i} is not null" for i in range(4)))
def field_scores_long(spark, d):
    return _scored(spark, d, "max").select("vec_id", F.explode("field_scores").alias("field", "score"))


@query(
    "zero_shot_label",
    f"""with v as ({EMBEDDED}), c as (select label, p, avg(x) as x from (select label, unnest(e) as x, unnest(range(1, 65)) as p from v where label < 8) group by label, p),
    m as (select label, list(x order by p) as c from c group by label), s as (select vec_id, m.label as l, round(list_inner_product(e, c), 6) as score from v, m),
    r as (select *, row_number() over (partition by vec_id order by score desc, l) as n from s)
    select vec_id, 'label_' || max(l) filter (n = 1) as label, max(score) filter (n = 1) as score, round(max(score) filter (n = 1) - max(score) filter (n = 2), 6) as margin from r group by vec_id""",
)
def zero_shot_label(spark, d):
    df = table(spark, d, "embeddings")
    means = df.filter("label < 8").groupBy("label").agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(64)]).orderBy("label").collect()  # eight rows
    found = search.zero_shot(df, "vec_id", "embedding", [(f"label_{r[0]}", list(r[1:])) for r in means], DIGITS)
    return found.withColumn("margin", F.round("margin", DIGITS)).drop("scores")


# Text.

VARIANTS = ["", "none", "NONE", "None", "无", "未知", "null", "NULL", "Null", "N/A", "n/a", " none "]
_variant_sql = "case doc_id % 13 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(VARIANTS)) + " else source end"


def _variant(start: int = 0) -> F.Column:
    value = F.col("source")
    for i, v in enumerate(VARIANTS):
        value = F.when((F.col("doc_id") + start) % 13 == i, v).otherwise(value)
    return value


_known = "('', 'none', 'NONE', '无', '未知', 'null', 'NULL', 'N/A', 'n/a')"


@query("placeholder_mask", f"select doc_id, {_variant_sql} as value, trim({_variant_sql}) in {_known} as is_placeholder from documents")
def placeholder_mask(spark, d):
    return table(spark, d, "documents").select("doc_id", _variant().alias("value"), text.is_placeholder(_variant()).alias("is_placeholder"))


@query(
    "semantic_text_join",
    f"""with l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
    m as (select doc_id, list_filter([trim(coalesce(lang, '')), trim({_variant_sql}), coalesce(quality::varchar, ''), coalesce(toxic::varchar, '')], lambda x: x not in {_known}) as l from documents left join l using (doc_id))
    select doc_id, array_to_string(l, '；') as semantic_text from m""",
)
def semantic_text_join(spark, d):
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    met = table(spark, d, "documents").join(marks, "doc_id", "left")
    return met.select("doc_id", text.joined_text([F.col("lang"), _variant(), F.col("quality").cast("string"), F.col("toxic").cast("string")]).alias("semantic_text"))


_padded = "case when turn % 3 = 0 then chr(12288) || chr(9) || coalesce(text, '') || ' ' || chr(10) when turn % 3 = 1 then text else '  ' end"


@query("normalize_fill", f"select conv_id, turn, coalesce(nullif(trim({_padded}, ' ' || chr(9) || chr(10) || chr(12288)), ''), 'NONE') as value from conversations")
def normalize_fill(spark, d):
    df = table(spark, d, "conversations")
    padded = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("　\t"), F.coalesce("text", F.lit("")), F.lit(" \n"))).when(F.col("turn") % 3 == 1, F.col("text")).otherwise("  ")
    return df.select("conv_id", "turn", F.coalesce(F.nullif(text.normalize_text(padded), F.lit("")), F.lit("NONE")).alias("value"))


@query(
    "safe_name",
    """with s as (select doc_id, '/in/' || source || '/My doc (' || doc_id || ')' || case doc_id % 3 when 0 then '.PNG' when 1 then '' else '.tar.gif' end as p, sha256(text) as h from documents)
    select doc_id, 'my_pack_' || trim(regexp_replace('My doc (' || doc_id || ')' || case doc_id % 3 when 2 then '.tar' else '' end, '[^A-Za-z0-9_.-]+', '_', 'g'), '._') || '_' || h[1:16] || case doc_id % 3 when 0 then '.png' when 1 then '.png' else '.gif' end as name from s""",
)
def safe_name(spark, d):
    end = F.when(F.col("doc_id") % 3 == 0, ".PNG").when(F.col("doc_id") % 3 == 1, "").otherwise(".tar.gif")
    path = F.concat(F.lit("/in/"), "source", F.lit("/My doc ("), F.col("doc_id").cast("string"), F.lit(")"), end)
    return table(spark, d, "documents").select("doc_id", text.folder_name(path, F.sha2("text", 256), "my pack").alias("name"))


@query("url_basename", "with b as (select page_id, url, split(url, '/')[-1] as b from pages) select page_id, b as name, '/images/' || b as address, lower(regexp_extract(b, '^.+(\\.[^.]+)$', 1)) as suffix from b")
def url_basename(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", text.basename(url).alias("name"), text.image_url(url).alias("address"), text.suffix(url).alias("suffix"))


@query("props_json_normalise", "select event_id, coalesce(nullif(trim(props ->> 'k'), ''), 'NONE') as k, coalesce(nullif(trim(props ->> 'none'), ''), 'NONE') as missing from events")
def props_json_normalise(spark, d):
    field = lambda k: F.coalesce(F.nullif(text.normalize_text(F.get_json_object("props", f"$.{k}")), F.lit("")), F.lit("NONE"))
    return table(spark, d, "events").select("event_id", field("k").alias("k"), field("none").alias("missing"))


@query(
    "safe_int",
    """with s as (select event_id, case event_id % 5 when 0 then ' ' || (event_id % 97)::varchar || ' ' when 1 then '3.0' when 2 then '' when 3 then null else 'x' || event_id end as v from events)
    select event_id, coalesce(case when regexp_full_match(trim(v), '[+-]?[0-9]+') then trim(v)::int end, 1) as size from s""",
)
def safe_int(spark, d):
    id_ = F.col("event_id")
    value = F.when(id_ % 5 == 0, F.concat(F.lit(" "), (id_ % 97).cast("string"), F.lit(" "))).when(id_ % 5 == 1, "3.0").when(id_ % 5 == 2, "").when(id_ % 5 == 4, F.concat(F.lit("x"), id_.cast("string")))
    return table(spark, d, "events").select("event_id", text.safe_int(value).alias("size"))


_label_join = "documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l using (doc_id)"


@query("result_title", f"with t as (select doc_id, case when trim({_variant_sql}) in ('', 'NONE', 'none', '无', '未知', 'null', 'N/A') then null else trim({_variant_sql}) end as a, quality::varchar as b from {_label_join}) select doc_id, coalesce(a, b, 'doc' || doc_id || '.png') as title from t")
def result_title(spark, d):
    met = _labelled(spark, d)
    path = F.concat(F.lit("images/doc"), F.col("doc_id").cast("string"), F.lit(".png"))
    return met.select("doc_id", text.result_title(_variant(), F.col("quality").cast("string"), F.lit("none"), path).alias("title"))


@query("result_subtitle", f"with t as (select doc_id, case when trim({_variant_sql}) in ('', 'NONE', 'none', '无', '未知', 'null', 'N/A') then null else trim({_variant_sql}) end as a, toxic::varchar as b, lang from {_label_join}) select doc_id, array_to_string(list_filter([lang, a, b], lambda x: x is not null), '  |  ') as subtitle from t")
def result_subtitle(spark, d):
    return _labelled(spark, d).select("doc_id", text.result_subtitle(F.col("lang"), _variant(), F.col("toxic").cast("string")).alias("subtitle"))


def _labelled(spark, d) -> DataFrame:
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").join(marks, "doc_id", "left")


# Files, stores and imports.

_files = "(select doc_id, source, sha256(coalesce(text, '')) as sha, strlen(coalesce(text, '')) as bytes from documents)"


def _file_rows(spark, d) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", "source", F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("bytes"))


@query(
    "content_profile",
    f"""with g as (select sha, count(*) as c, sum(bytes) as b from {_files} group by sha)
    select coalesce(sum(c), 0)::bigint as image_files, coalesce(sum(b), 0)::bigint as total_bytes, round(coalesce(sum(b), 0) / 1048576.0, 3)::double as total_megabytes, count(*) filter (c > 1) as duplicate_content_groups, coalesce(sum(c - 1) filter (c > 1), 0)::bigint as duplicate_files from g""",
)
def content_profile(spark, d):
    return stores.folder_profile(_file_rows(spark, d), "bytes", "sha").withColumn("total_megabytes", F.col("total_megabytes").cast("double"))


@query("ext_counts", "select source, count(*) as files from documents group by source")
def ext_counts(spark, d):
    return stores.counts_by(table(spark, d, "documents"), "source")


@query("dedup_first", f"select sha, doc_id, source, bytes from (select *, row_number() over (partition by sha order by doc_id) as n from {_files}) where n = 1")
def dedup_first(spark, d):
    return stores.first_per_key(_file_rows(spark, d), "sha", "doc_id").select("sha", "doc_id", "source", "bytes")


@query(
    "import_plan_limit",
    f"""with k as (select distinct sha256(coalesce(text, '')) as sha from documents where doc_id % 10 = 3), p as (select f.*, row_number() over (partition by f.sha order by doc_id) as n, k.sha is not null as known from {_files} f left join k on f.sha = k.sha),
    a as (select doc_id, sha, case when known or n > 1 then 'skipped_duplicate' when doc_id % 5 = 1 then 'exists' else 'imported' end as action from p),
    b as (select *, coalesce(sum((action = 'imported')::int) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from a)
    select doc_id, sha, action from b where before < 100""",
)
def import_plan_limit(spark, d):
    files = _file_rows(spark, d).select("doc_id", "sha")
    return stores.import_plan(files, files.filter("doc_id % 10 = 3"), "sha", "doc_id", files.filter("doc_id % 5 = 1"), 100).select("doc_id", "sha", "action")


@query(
    "last_wins_store",
    """with a as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events), b as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type <> 'error')
    select 'any' as store, user_id, event_id, event_type from a where n = 1 union all select 'filtered_after', user_id, event_id, event_type from a where n = 1 and event_type <> 'error' union all select 'filtered_before', user_id, event_id, event_type from b where n = 1""",
)
def last_wins_store(spark, d):
    df = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    last = lambda x: stores.last_per_key(x, "user_id", "ts", "event_id")
    parts = {"any": last(df), "filtered_after": last(df).filter("event_type <> 'error'"), "filtered_before": last(df.filter("event_type <> 'error'"))}
    rows = [x.select(F.lit(n).alias("store"), "user_id", "event_id", "event_type") for n, x in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("pending_anti", "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) order by doc_id limit 200")
def pending_anti(spark, d):
    return stores.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id"), "doc_id", limit=200)


@query(
    "listing_flag",
    """with c as (select conv_id, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n = 1)
    select 'images/' || doc_id as path, '/images/' || doc_id as url, coalesce(role, '') as role, exists (select 1 from labels l where l.doc_id = d.doc_id) as indexed from documents d left join c on c.conv_id = d.doc_id""",
)
def listing_flag(spark, d):
    path = lambda c: F.concat(F.lit("images/"), F.col(c).cast("string")).alias("path")
    images = table(spark, d, "documents").select(path("doc_id"))
    last = stores.last_per_key(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn").select(path("conv_id"), "role")
    return stores.listing(images, last, table(spark, d, "labels").select(path("doc_id")), ["role"])


_sync = "with i as (select doc_id as id from documents where doc_id % 7 <> 0), c as (select doc_id as id from documents), v as (select vec_id as id from embeddings)"


def _stores(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return docs.filter("id % 7 <> 0"), docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))


@query("sync_plan", f"{_sync} select id, 'remove' as action from v where id not in (select id from i) union all select id, 'encode' from (select distinct id from c) where id not in (select id from v) and id in (select id from i)")
def sync_plan(spark, d):
    return stores.sync_plan(*_stores(spark, d), key="id")


@query("cascade_delete_counts", f"{_sync}, g as (select doc_id as id from labels where toxic = 1) select (select count(*) from i where id in (select id from g)) as removed_images, (select count(*) from c where id in (select id from g)) as removed_captions, (select count(*) from v where id in (select id from g)) as removed_vectors")
def cascade_delete_counts(spark, d):
    images, caps, vecs = _stores(spark, d)
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return stores.cascade_delete(gone, "id", images=images, captions=caps, vectors=vecs)[1]


@query("corpus_status", f"{_sync} select (select count(distinct id) from i) as images, (select count(distinct id) from c) as captions, (select count(distinct id) from v) as vectors")
def corpus_status(spark, d):
    return stores.corpus_status(*_stores(spark, d), key="id")


# Catalog, annotation, packs.


@query(
    "catalog_export",
    """with l as (select doc_id, max(quality) as quality from labels group by doc_id), c as (select conv_id, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n = 1), s as (select source, count(*) as cluster_size from documents group by source)
    select d.doc_id, d.source, coalesce(quality::varchar, '') as asset_type, coalesce(role, '') as usage_context, coalesce(c.text, '') as notes, coalesce(cluster_size::varchar, '') as cluster_size from documents d left join l on l.doc_id = d.doc_id left join c on c.conv_id = d.doc_id left join s on s.source = d.source""",
)
def catalog_export(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    last = stores.last_per_key(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text"), "doc_id", "turn")
    out = catalog.export(docs, (marks, {"quality": "asset_type"}), (last, {"role": "usage_context", "text": "notes"}), key="doc_id")
    return catalog.export(out, (docs.groupBy("source").agg(F.count("*").alias("n")), {"n": "cluster_size"}), key="source")


def _edits(overwrite: bool) -> str:
    pick = lambda f, new: f"coalesce(nullif({f'coalesce({new}, {chr(39)}{chr(39)})' if overwrite else f'coalesce(nullif({new}, {chr(39)}{chr(39)}), o.{f}, {chr(39)}{chr(39)})'}, ''), 'NONE')"
    return f"""with o as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source from documents where doc_id % 3 <> 0),
    n as (select doc_id, case when min(quality) = 1 then 'good' else '' end as lang, 'src' || max(toxic) as source from labels group by doc_id)
    select coalesce(o.doc_id, n.doc_id) as doc_id, case when n.doc_id is null then o.lang else {pick('lang', 'n.lang')} end as lang, case when n.doc_id is null then o.source else {pick('source', 'n.source')} end as tags, case when n.doc_id is null then 'kept' when o.doc_id is null then 'created' else 'changed' end as change from o full join n on o.doc_id = n.doc_id"""


def _apply(overwrite):
    def run(spark, d):
        old = table(spark, d, "documents").filter("doc_id % 3 <> 0").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("tags"), F.lit(True).alias("ok"), F.lit("").alias("source"))
        new = table(spark, d, "labels").groupBy("doc_id").agg(F.when(F.min("quality") == 1, "good").otherwise("").alias("lang"), F.concat(F.lit("src"), F.max("toxic").cast("string")).alias("tags"))
        return catalog.apply_edits(old, new, ["lang", "tags"], overwrite, "doc_id").select("doc_id", "lang", "tags", "change")

    return run


query("catalog_apply", _edits(False))(_apply(False))
query("catalog_apply_overwrite", _edits(True))(_apply(True))


def _merge_sql(overwrite: bool) -> str:
    pick = "n.lang" if overwrite else "o.lang"
    return f"""with o as (select doc_id, lang from documents where doc_id % 2 = 0), n as (select doc_id, source as lang from documents where doc_id % 3 = 0)
    select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then n.lang when n.doc_id is null then o.lang else {pick} end as lang, case when n.doc_id is null then 'kept' when o.doc_id is null then 'added' else '{'replaced' if overwrite else 'skipped'}' end as outcome from o full join n on o.doc_id = n.doc_id"""


def _merge(overwrite):
    def run(spark, d):
        docs = table(spark, d, "documents")
        return catalog.merge_external(docs.filter("doc_id % 2 = 0").select("doc_id", "lang"), docs.filter("doc_id % 3 = 0").select("doc_id", F.col("source").alias("lang")), "doc_id", overwrite)

    return run


query("merge_external", _merge_sql(False))(_merge(False))
query("merge_external_overwrite", _merge_sql(True))(_merge(True))


@query(
    "validate_external",
    """with r as (select conv_id * 1000 + turn as line, case when turn % 4 = 3 then ' ' else 'c' || conv_id || '/' || turn // 2 end as path from conversations)
    select line, path, case when trim(path) = '' then 'missing path' when row_number() over (partition by trim(path) order by line) > 1 then 'duplicate path' end as problem from r""",
)
def validate_external(spark, d):
    path = F.when(F.col("turn") % 4 == 3, " ").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.expr("turn div 2").cast("string")))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), path.alias("path"))
    return catalog.validate_external(rows, "path", "line")


@query("batch_assign", "select doc_id, (row_number() over (order by doc_id) - 1) // 50 as batch_index from documents")
def batch_assign(spark, d):
    return catalog.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


_pack_files = "(select s_suppkey % 3 as place, 'd' || s_suppkey % 3 || '/Supplier ' || s_suppkey || '.PNG' as file, s_suppkey % 3 = 0 as own, s_suppkey % 5 = 0 as direct from supplier union all select 3, 'd3/code' || s_suppkey || '.gif', false, false from supplier)"


@query(
    "multi_key_resolve",
    f"""with f as {_pack_files}, i as (select s_suppkey as id, case s_suppkey % 4 when 0 then 'd' || s_suppkey % 3 || '/Supplier ' || s_suppkey || '.PNG' when 1 then 'x/supplier ' || s_suppkey || '.png' when 2 then 'y/gone' else '' end as path, case when s_suppkey % 8 < 6 then 'CODE' || s_suppkey else '' end as code from supplier),
    a as (select file as k, min(file) as by_path from f where direct group by 1), b as (select split(file, '/')[-1] as k, min_by(file, place) as by_own from f where own group by 1),
    c as (select lower(split(file, '/')[-1]) as k, min_by(file, place) as by_name from f group by 1), e as (select upper(regexp_replace(split(file, '/')[-1], '\\.[^.]+$', '')) as k, min_by(file, place) as by_code from f group by 1)
    select id, coalesce(by_path, by_own, by_name, by_code) as source, case when by_path is not null then 'by_path' when by_own is not null then 'by_own' when by_name is not null then 'by_name' when by_code is not null then 'by_code' end as found_by
    from i left join a on a.k = path and path <> '' left join b on b.k = split(path, '/')[-1] and path <> '' left join c on c.k = lower(split(path, '/')[-1]) and path <> '' left join e on e.k = upper(code) and code <> ''""",
)
def multi_key_resolve(spark, d):
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    n = F.col("id").cast("string")
    named = F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/Supplier "), n, F.lit(".PNG"))
    files = own.select(named.alias("file"), (F.col("id") % 3).alias("place"), (F.col("id") % 3 == 0).alias("primary"), (F.col("id") % 5 == 0).alias("direct"))
    files = files.unionByName(own.select(F.concat(F.lit("d3/code"), n, F.lit(".gif")).alias("file"), F.lit(3).cast("long").alias("place"), F.lit(False).alias("primary"), F.lit(False).alias("direct")))
    path = F.when(F.col("id") % 4 == 0, named).when(F.col("id") % 4 == 1, F.concat(F.lit("x/supplier "), n, F.lit(".png"))).when(F.col("id") % 4 == 2, "y/gone").otherwise("")
    code = F.when(F.col("id") % 8 < 6, F.concat(F.lit("CODE"), n)).otherwise("")
    return catalog.resolve(own, "id", path, code, files).select("id", "source", "found_by")


@query(
    "pack_profile",
    "select count(*) as metadata_records, count(*) filter (o_orderstatus <> 'O') as available_source_files, count(*) filter (not (o_orderstatus <> 'O')) as missing_source_files, count(*) filter (o_orderpriority like '1%') as downloaded_records, count(*) filter (o_custkey % 11 > 0) as positive_file_size_records from orders",
)
def pack_profile(spark, d):
    return catalog.pack_profile(table(spark, d, "orders"), F.col("o_orderstatus") != "O", F.col("o_orderpriority").startswith("1"), F.col("o_custkey") % 11)


# Hashes, near-duplicates and features.

_hash = lambda bits: f"list_reduce(list_prepend(0::hugeint, list_transform({bits}, lambda b: b::int::hugeint)), lambda a, b: a * 2 + b)"
_ahash = _hash("list_transform(e, lambda x: x > list_sum(e) / 64)")
_dhash = _hash("list_transform(list_filter(range(2, 65), lambda i: (i - 1) % 8 <> 0), lambda i: e[i] > e[i - 1])")


@query("ahash", f"with v as ({EMBEDDED}) select vec_id, lower(lpad(to_hex(({_ahash})::ubigint), 16, '0')) as ahash from v")
def ahash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", hashing.to_hex(hashing.average_hash(F.col("embedding").cast("array<double>"))).alias("ahash"))


@query("dhash", f"with v as ({EMBEDDED}) select vec_id, lower(lpad(to_hex(({_dhash})::ubigint), 16, '0')) as dhash from v")
def dhash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", hashing.to_hex(hashing.difference_hash(F.col("embedding"), 8)).alias("dhash"))


def _codes(spark, d, thirds: bool) -> DataFrame:
    """Average hashes, each with a copy of vec_id % 6 flipped bits and, for chains, one with four further bits flipped."""
    base = table(spark, d, "embeddings").select("vec_id", hashing.average_hash(F.col("embedding").cast("array<double>")).alias("code"))
    low, more = F.expr("shiftleft(1L, cast(vec_id % 6 as int)) - 1"), F.lit(15 << 20)
    out = base.select(F.col("vec_id").alias("key"), "code").unionByName(base.select((F.col("vec_id") + 1000000).alias("key"), F.col("code").bitwiseXOR(low).alias("code")))
    return out.unionByName(base.select((F.col("vec_id") + 2000000).alias("key"), F.col("code").bitwiseXOR(low).bitwiseXOR(more).alias("code"))) if thirds else out


_code = f"with v as ({EMBEDDED}), b as (select vec_id, ({_ahash})::ubigint as code from v), "
_two = "select vec_id as key, code from b union all select vec_id + 1000000, xor(code, ((1 << (vec_id % 6)::int) - 1)::ubigint) from b"
_three = f"{_two} union all select vec_id + 2000000, xor(xor(code, ((1 << (vec_id % 6)::int) - 1)::ubigint), 15728640::ubigint) from b"


@query("hamming_pairs", f"{_code} h as materialized ({_two}) select x.key as left_key, y.key as right_key, bit_count(xor(x.code, y.code)::bit)::int as distance from h x, h y where x.key < y.key and bit_count(xor(x.code, y.code)::bit) <= 4")
def hamming_pairs(spark, d):
    return clusters.hamming_pairs(_codes(spark, d, False), "key", "code", 4)


@query(
    "near_dup_groups",
    f"""with recursive v as ({EMBEDDED}), b as (select vec_id, ({_ahash})::ubigint as code from v), h as materialized ({_three}), e as materialized (select x.key as a, y.key as b from h x, h y where bit_count(xor(x.code, y.code)::bit) <= 4),
    r as (select key as a, key as b from h union select r.a, e.b from r join e on r.b = e.a), m as (select a as key, min(b) as root from r group by a)
    select key, root, 'dup_' || lpad((dense_rank() over (order by root) - 1)::varchar, 4, '0') as near_duplicate_group, count(*) over (partition by root) as duplicate_group_size from m""",
)
def near_dup_groups(spark, d):
    return clusters.near_duplicate_groups(_codes(spark, d, True), "key", "code", 4)


@query(
    "heuristic_type",
    """with p as (select p_partkey, case when p_partkey % 9 = 0 then '.GIF' else '.png' end as suffix, p_size / 50.0 as cd, (p_partkey % 20) / 100.0 as ed, (p_partkey % 7) / 10.0 as sat from part)
    select p_partkey, case when lower(suffix) = '.gif' then 'animated' when cd >= 0.56 and ed <= 0.105 then 'photo_like' when sat >= 0.28 and ed >= 0.08 then 'cartoon_or_sticker' when cd <= 0.22 then 'text_or_flat_graphic' else 'uncertain' end as asset_type,
    (case when lower(suffix) = '.gif' then 0.8 when cd >= 0.56 and ed <= 0.105 then 0.55 when sat >= 0.28 and ed >= 0.08 then 0.5 when cd <= 0.22 then 0.45 else 0.25 end)::double as confidence from p""",
)
def heuristic_type(spark, d):
    key = F.col("p_partkey")
    kind, sure = features.asset_type(F.when(key % 9 == 0, ".GIF").otherwise(".png"), F.col("p_size") / 50, (key % 20) / 100, (key % 7) / 10)
    return table(spark, d, "part").select("p_partkey", kind.alias("asset_type"), sure.alias("confidence"))


def _stat(i: int, what: str) -> str:
    part = f"e[{1 + 16 * i}:{16 + 16 * i}]"
    mean = f"(list_sum({part}) / 16)"
    return f"round({mean}, 6) as mean{i}" if what == "mean" else f"round(sqrt(list_sum(list_transform({part}, lambda x: (x - {mean}) * (x - {mean}))) / 16), 6) as std{i}"


def _less(mean):
    return lambda x: x - mean


@query("channel_stats", f"with v as ({EMBEDDED}) select vec_id, " + ", ".join(_stat(i, w) for i in range(4) for w in ("mean", "std")) + " from v")
def channel_stats(spark, d):
    out = []
    for i in range(4):
        part = F.slice(F.col("embedding").cast("array<double>"), 1 + 16 * i, 16)
        mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / 16
        var = vectors.dot(*[F.transform(part, _less(mean))] * 2) / 16
        out += [F.round(mean, DIGITS).alias(f"mean{i}"), F.round(F.sqrt(var), DIGITS).alias(f"std{i}")]
    return table(spark, d, "embeddings").select("vec_id", *out)


@query("color_diversity", f"with v as ({EMBEDDED}) select vec_id, len(list_distinct(list_transform(e, lambda x: floor(x * 16)::int))) / 64.0::double as color_diversity from v")
def color_diversity(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.size(F.array_distinct(F.transform("embedding", lambda x: F.floor(x.cast("double") * 16)))) / 64).alias("color_diversity"))


_z = ", ".join(f"round((e[{i + 1}] - avg(e[{i + 1}]) over ()) / stddev_pop(e[{i + 1}]) over (), 6) as x{i}" for i in range(64))


@query("standardise", f"with v as ({EMBEDDED}) select vec_id, {_z}, 0.0::double as same from v")
def standardise(spark, d):
    """All 64 numbers, and a constant column."""
    names = [f"x{i}" for i in range(64)]
    wide = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)], F.lit(3.0).alias("same"))
    return clusters.standardise(wide, [*names, "same"]).select("vec_id", *[F.round(n, DIGITS).alias(n) for n in [*names, "same"]])


def _agglomerated(rows: str, distance: str, threshold: float) -> str:
    """The same by rounds in which mutual nearest neighbours merge; rows: (id, mean) of single vectors."""
    return f"""with recursive c as (
      select 0 as round, id, 1::bigint as size, mean, [id] as members from ({rows})
      union all
      (with cur as (select * from c), n as (select a.id, arg_min(b.id, ({distance}, b.id)) as other from cur a join cur b on a.id <> b.id where {distance} < {threshold} group by a.id),
        m as (select n.id as a, n.other as b from n join n k on n.other = k.id and k.other = n.id and n.id < n.other)
      select x.round + 1, x.id, x.size + coalesce(y.size, 0), case when y.id is null then x.mean else list_transform(list_zip(x.mean, y.mean), lambda z: (z[1] * x.size + z[2] * y.size) / (x.size + y.size)) end, x.members || coalesce(y.members, [])
      from cur x left join m on m.a = x.id left join cur y on y.id = m.b where x.id not in (select b from m) and exists (from m))),
    g as (select id as root, size as cluster_size, members, printf('visual_%04d', row_number() over (order by id) - 1) as visual_cluster_id from c where round = (select max(round) from c))
    select unnest(members) as vec_id, root, visual_cluster_id, cluster_size from g"""


_UNIT = "select vec_id as id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as mean from (" + EMBEDDED + ")"
_SCALED = "select vec_id as id, [" + ", ".join(f"(e[{i}] - avg(e[{i}]) over ()) / stddev_pop(e[{i}]) over ()" for i in range(1, 65)) + "] as mean from (" + EMBEDDED + ")"
_WARD = "sqrt(2.0 * a.size * b.size / (a.size + b.size)) * list_distance(a.mean, b.mean)"


@query("agglo_average", _agglomerated(_UNIT, "1 - list_inner_product(a.mean, b.mean)", 0.6))
def agglo_average(spark, d):
    return clusters.agglomerate(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


@query("agglo_ward", _agglomerated(_SCALED, _WARD, 8.5))
def agglo_ward(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)])
    z = clusters.standardise(df, [f"x{i}" for i in range(64)])
    return clusters.agglomerate(z.select("vec_id", F.array(*[f"x{i}" for i in range(64)]).alias("z")), "vec_id", "z", 8.5, "ward")


@query(
    "representatives",
    """with s as (select doc_id, source, lang, count(*) over (partition by source) as size from documents), r as (select *, row_number() over (partition by source order by doc_id) as n, max(size) over (partition by source) as m from s where size >= 2 and lang in ('en', 'fr', 'de'))
    select source, doc_id, lang, m as max_size from r where n = 1 and doc_id not in (select doc_id from labels) order by m desc, source limit 15""",
)
def representatives(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    sized = docs.join(docs.groupBy("source").agg(F.count("*").cast("string").alias("size")), "source")
    out = clusters.representatives(sized, table(spark, d, "labels").select("doc_id"), "doc_id", "source", "size", "lang", 2, ["en", "fr", "de"], limit=15)
    return out.select("source", "doc_id", "lang", F.col("max_size").cast("long").alias("max_size"))


def _stub(path: str) -> str:
    n = int(path)
    if n % 7 == 0:
        raise captions.RequestError("busy", 503, "unavailable", "try\nlater")
    if n % 11 == 0:
        raise ValueError("bad image")
    return f"caption {n}"


@query(
    "caption_failures",
    """select doc_id::varchar as path, case when doc_id % 7 = 0 then 'path=' || doc_id || ' | error=busy | status=503 | reason=unavailable | body=try\\nlater' else 'path=' || doc_id || ' | error=bad image | body=bad image' end as summary, 2 as attempts from documents where doc_id % 7 = 0 or doc_id % 11 = 0""",
)
def caption_failures(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    failed = captions.describe(rows, _stub, 1, _no_wait).filter("not ok")
    return failed.select("path", text.failure_summary(F.col("path"), F.col("error"), F.col("status"), F.col("reason"), F.col("body")).alias("summary"), "attempts")


def _no_wait(_: float) -> None:
    return None
