"""Statistics as tables: name and value reports, stored statistics, site filters and two-sample tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignments import chunks, summary
from .variants import file_statistics, with_statistics


def as_rows(one: DataFrame) -> DataFrame:
    """A one-row table as name and value."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("r")).select("r.*")


def alignment_report(reads: DataFrame) -> DataFrame:
    """Counts and extremes, with the mean insert size over all reads and the share of G and C."""
    s = summary(reads).drop("single_end")
    letters = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    s = s.withColumn("mean_isize", F.round(F.col("sum_isize") / F.col("reads"), 6)).withColumn("gc_percent", F.round((F.col("n_g") + F.col("n_c")) * 100 / letters, 6))
    return as_rows(s)


def variant_report(variants: DataFrame) -> DataFrame:
    s = file_statistics(variants)
    return as_rows(s.withColumn("ti_tv", F.round(F.try_divide("transitions", "transversions"), 6)))


def store_statistics(reads: DataFrame, path: str, chunk: int = 10_000) -> None:
    """global_stats, and chunk in a folder for each chromosome, so that a region reads few files."""
    alignment_report(reads).write.mode("overwrite").parquet(f"{path.rstrip('/')}/global_stats")
    chunks(reads, chunk).repartition("chromosome").sortWithinPartitions("chunk_id").write.mode("overwrite").partitionBy("chromosome").parquet(f"{path.rstrip('/')}/chunk")


def view_sites(variants: DataFrame, *, indels: bool = True, plain_letters: bool = False, variants_only: bool = False, min_present: float = 0.0) -> DataFrame:
    """Sites by kind and by the share of samples with a genotype."""
    rows = with_statistics(variants)
    test = F.lit(True)
    if not indels:
        test &= ~F.col("is_indel")
    if plain_letters:
        test &= F.col("ref").rlike("^[ACGT]+$") & F.col("alt").rlike("^[ACGT,]+$")
    if variants_only:
        test &= F.col("alt") != "."
    if min_present > 0:
        test &= F.coalesce((F.size("gts") - F.col("missing_genotypes")) >= min_present * F.size("gts"), F.lit(False))
    return rows.filter(test).select(*variants.columns)


def two_samples(rows: DataFrame, by: list[str], value: str, second: Column) -> DataFrame:
    """Sizes, means and Welch's t of a value in two samples of each group."""
    x = F.col(value).cast("double")
    parts = []
    for k, test in ((1, ~second), (2, second)):
        v = F.when(test, x)
        parts += [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"mean{k}"), F.var_samp(v).alias(f"var{k}")]
    out = rows.groupBy(*by).agg(*parts)
    spread = F.sqrt(F.try_divide("var1", "n1") + F.try_divide("var2", "n2"))
    return out.select(*by, "n1", "n2", "mean1", "mean2", F.try_divide(F.col("mean1") - F.col("mean2"), spread).alias("t"))
