"""Methylation sites over a stream of reads: the counters are sums, so they can be kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cytoplan.operators.meth_map import Settings, filter_reads, site_counts


def streaming_sites(reads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same plan as the batch one; write it in update or complete mode."""
    return site_counts(filter_reads(reads, settings), settings)


def streaming_chunks(reads: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """Reads per chromosome and window of event time, with a watermark, for append mode."""
    from pyspark.sql import functions as F

    return reads.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), "tid").agg(F.count(F.lit(1)).alias("reads"), F.sum("mapq").alias("sum_mapq"))
