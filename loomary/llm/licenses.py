"""License scans by diagonal voting.

Every rolling k-gram of words of every document is hashed and joined with the positions of equal k-grams in the
templates (word for word, so a hash collision gives no vote). A vote's diagonal is its place in the document less its
place in the template: a copy of a template votes along one diagonal, a copy with words added or lost along neighbours.
Votes are aggregated by diagonal, neighbouring diagonals merged, and the resulting spans verified by the share of the
template's k-grams that they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

K = 2
SLACK = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public wordings (notices and opening clauses of well-known licenses) and their labels.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
#: Notices of up to SHORT words must stand whole; of longer ones NEED of the k-grams do.
SHORT, NEED = 12, 0.6
#: Template positions up to which their table is broadcast; a larger one is joined by shuffle.
SMALL = 100_000


def with_words(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """(keep .., words): words of whole texts with A-Z lower-cased; null and empty texts have none. One column a step, so that
    each is computed once."""
    plain = df.select(*keep, F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS, " ")).alias("plain"))
    return plain.filter("plain <> ''").withColumn("words", F.split("plain", " ")).drop("plain")


def _grams(column: str, k: int) -> Column:
    """Array of structs (w0 .. wk-1) for each place but the last k - 1."""
    n = F.size(column)
    parts = [F.slice(column, i + 1, F.greatest(n - k + 1, F.lit(0))).alias(f"w{i}") for i in range(k)]
    return F.arrays_zip(*parts)


def template_table(spark, templates: list[tuple[str, str, bool]], k: int) -> DataFrame:
    """(template, tpos, gram): one row per k-gram of each template."""
    rows = []
    for t, (_, text, _) in enumerate(templates):
        w = text.split()
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        rows += [(t, i, w[i : i + k]) for i in range(len(w) - k + 1)]
    table = spark.createDataFrame(rows, "template int, tpos int, w array<string>").select("template", "tpos", *[F.col("w")[i].alias(f"t{i}") for i in range(k)])
    table = table.withColumn("hash", F.xxhash64(*[f"t{i}" for i in range(k)]))
    return F.broadcast(table) if len(rows) <= SMALL else table


def scan(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, text_col: str = "text", id_col: str = "doc_id", k: int = K) -> DataFrame:
    """Verified spans: id, text_hash, template (index), label, base, start, end (words, end excluded), votes, coverage.

    `templates`: (label, words, base); base phrases match whole, on one diagonal. Rows that share id and text share
    spans. Null and empty texts, texts shorter than k words and empty tables have none. The template table is
    broadcast if it has SMALL rows at most.
    """
    templates = default_templates() if templates is None else templates
    table = template_table(docs.sparkSession, templates, k)
    facts = docs.sparkSession.createDataFrame([(t, label, base, len(text.split()) - k + 1, 1.0 if base or len(text.split()) <= SHORT else NEED, 0 if base else SLACK) for t, (label, text, base) in enumerate(templates)], "template int, label string, base boolean, grams int, need double, slack int")
    own = with_words(docs, F.col(f"`{text_col}`"), [F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash")])
    rolling = own.select("id", "text_hash", F.posexplode(_grams("words", k)).alias("pos", "g")).select("id", "text_hash", "pos", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(k)])
    same = F.col("h") == F.col("hash")
    for i in range(k):
        same = same & (F.col(f"w{i}") == F.col(f"t{i}"))
    votes = rolling.withColumn("h", F.xxhash64(*[f"w{i}" for i in range(k)])).join(table, same).select("id", "text_hash", "template", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    diagonals = votes.groupBy("id", "text_hash", "template", "diagonal").agg(F.collect_set("tpos").alias("at"))
    strong = diagonals.join(F.broadcast(facts) if len(templates) <= SMALL else facts, "template").filter("size(at) >= least(grams, if(base, grams, 3))")
    order = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    far = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack")).cast("int"), F.lit(0))
    merged = strong.withColumn("far", far).withColumn("span", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("id", "text_hash", "template", "label", "base", "grams", "need", "span").agg(
        F.min(F.col("diagonal") + F.array_min("at")).alias("start"),
        (F.max(F.col("diagonal") + F.array_max("at")) + k).alias("end"),
        F.sum(F.size("at")).cast("int").alias("votes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("met"),
    )
    checked = spans.withColumn("coverage", F.col("met") / F.col("grams")).filter("coverage >= need and `end` - start <= 2 * (grams + 1)")
    return checked.select("id", "text_hash", "template", "label", "base", "start", "end", "votes", "coverage")


def default_templates() -> list[tuple[str, str, bool]]:
    return [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Contract query: base phrases, labels and score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.col("base")
    comma = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    found = scan(docs).groupBy("id", "text_hash").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        comma(F.when(base, F.col("label"))).alias("base_labels"),
        comma("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count(F.translate("text", UPPER, LOWER), F.lit(BREAKS.replace("[", "[^"))), F.lit(0)).cast("long").alias("n_words"))
    met = counted.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash")), "left")
    return met.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"))
