"""Windowed signals over methylation maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered


def window_signal(sites: DataFrame, start: int, end: int, samples: int, kind: str = "mc") -> DataFrame:
    """For each chromosome: mean coverage and normalised signal of `samples` windows of floor(n / samples) rows, stride one.

    Rows are numbered by position inside [start, end]; window i covers rows i to i + steps - 1.  The rows that all windows
    share are summed once; only the others, fewer than twice `samples`, go to single windows.
    """
    inside = sites.filter(F.col("pos").between(start, end))
    sizes = inside.groupBy("chr").agg(F.floor(F.count(F.lit(1)) / samples).cast("long").alias("steps")).filter("steps > 0")
    rows = numbered(inside, ["chr"], "pos", "i").join(sizes, "chr")
    rows = rows.select("chr", "steps", "i", (F.col("c") + F.col("nc") + F.col(kind)).alias("cover"), F.col(kind).alias("v")).filter(F.col("i") < F.col("steps") + samples - 1)
    shared = (F.col("i") >= samples - 1) & (F.col("i") < F.col("steps"))
    own = F.sequence(F.greatest(F.lit(0), F.col("i") - F.col("steps") + 1), F.least(F.col("i"), F.lit(samples - 1)))
    spread = rows.withColumn("w", F.explode(F.when(shared, F.array(F.lit(-1).cast("long"))).otherwise(own)))
    sums = spread.groupBy("chr", "w").agg(F.sum("cover").alias("cover"), F.sum("v").alias("v"), F.max("v").alias("peak"))
    common = sums.filter("w = -1").select("chr", F.col("cover").alias("_cover"), F.col("v").alias("_v"), F.col("peak").alias("_peak"))
    every = sizes.select("chr", "steps", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("w"))
    windows = every.join(sums.filter("w >= 0"), ["chr", "w"], "left").join(common, "chr", "left").na.fill(0)
    step = (end - start) // samples
    peak = F.greatest("peak", "_peak", F.lit(1))
    return windows.select(
        "chr",
        (F.col("w") * step + start).alias("plot_pos"),
        ((F.col("cover") + F.col("_cover")) / F.col("steps")).alias("coverage"),
        ((F.col("v") + F.col("_v")) / F.col("steps") / peak).alias("signal"),
    )
