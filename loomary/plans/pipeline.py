"""From images to the cluster table: features, clusters, near-duplicates, CSV, each step stored before the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.features import build_summary
from ..operators.clusters import cluster_counts, cluster_features
from ..sources import files, sinks


def run_pipeline(images: DataFrame, root: str, build: Callable[[DataFrame], DataFrame], encoder: str = "handcrafted", threshold: float | None = None, bound: int = 4) -> tuple[DataFrame, DataFrame]:
    """The cluster table of `images`, read back from {root}/clusters.csv, and one row: records, valid_records, feature_dim,
    visual_clusters and near_duplicate_groups.

    build: images to feature rows (functions.features.build_features with a decoder, or a model's vectors), which are
    stored in {root}/features. Images that failed count as records and aren't in the table. No images give an empty one.
    """
    spark = images.sparkSession
    sinks.feature_table(build(images), f"{root}/features")
    made = files.features(spark, f"{root}/features")
    sinks.cluster_csv(cluster_features(made, encoder, threshold, bound), f"{root}/clusters.csv", encoder)
    table = files.cluster_rows(spark, f"{root}/clusters.csv")
    counts = build_summary(made).crossJoin(cluster_counts(table).drop("records"))  # one row each
    return table, counts
