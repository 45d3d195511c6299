"""A corpus pipeline of five stages over `documents`: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), reads what its predecessor wrote, and works on all of it. All but the last
return the columns of `documents` (others, whatever their names, are left out); n_chars follows the text. The mix repeats
documents, so doc_id repeats from there on. An empty table gives an empty one in every stage. Repeated rows are documents
like others until near-dedup.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomary.llm import jaccard, lines, mixing, packing, quality
from loomary.llm.common import new_path, read, scope, ship, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's working tables live until the next stage begins; its result must be stored by then."""

    @wraps(run)
    def scoped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        with scope(spark, "pipeline"):
            return run(spark, docs, sf_dir)

    return scoped


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep. Null and empty texts have too few words and go; a null
    language is a stratum of its own; labels of unknown or null ids don't count; without labels the base rules decide."""
    scored = written(quality.measured(docs.select(*COLUMNS)), "measured")
    judged = quality.decide(scored, quality.calibrate(scored, read(spark, sf_dir, "labels")))
    return judged.filter("verdict.kept").select(*COLUMNS)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs across documents; the first line (least doc_id, nulls last) stays.
    Null texts stay null; a document of nothing but recurring lines becomes empty unless it is a copy."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingle sets at Jaccard 0.8 or more. The least doc_id stays
    (nulls last, ties by text); null, empty and blank texts are one class."""
    return jaccard.near_dedup(docs.select(*COLUMNS))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice. Null sources are one source; texts without words are taken
    once; rows that share doc_id and text are taken alike."""
    return mixing.mixture(docs.select(*COLUMNS))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' token pieces, packed into sequences of 2048. A null text is one end id; a document that the mix repeats
    is packed as often, and so are the rows of its pieces."""
    return packing.packed_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the packing (a seeded genetic search) nor the tokenizer; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents` in sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
