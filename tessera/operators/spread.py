"""Parallelism for inputs of few, large partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it has fewer partitions than there are cores; a stream or a larger input stays as it is.

    For row-wise Python work on small tables that are one file; on a large table nothing is shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
