"""Variant records: genotype statistics, filter chain, sample statistics and inheritance checks.

`variants` has chrom, pos, id, ref, alt, qual, filter, info, format and samples (array<string>).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplan.functions.text import info_map, tokens

from .regions import contained


def with_genotypes(variants: DataFrame) -> DataFrame:
    """Adds `alts`, and `gts`: the alleles of each sample (-1 missing), null where the record has no GT."""
    at = F.array_position(F.split("format", ":"), "GT")
    one = lambda s: F.transform(F.split(F.element_at(F.split(s, ":"), at.cast("int")), r"[/|]"), lambda a: F.when(a.rlike("^[0-9]+$"), a.cast("int")).otherwise(-1))
    gts = F.when(at > 0, F.transform("samples", one))
    return variants.withColumn("alts", F.split("alt", ",")).withColumn("gts", gts)


def with_statistics(variants: DataFrame, legacy_indel: bool = True) -> DataFrame:
    """Adds counts and frequencies of alleles and genotypes, missing ones, minor allele and the indel mark."""
    rows = with_genotypes(variants)
    alleles = F.flatten("gts")
    n = F.size("alts") + 1
    rows = rows.withColumn("allele_counts", F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.size(F.filter(alleles, lambda a: a == k))))
    rows = rows.withColumn("missing_alleles", F.size(F.filter(alleles, lambda a: a < 0))).withColumn("missing_genotypes", F.size(F.filter("gts", lambda g: F.exists(g, lambda a: a < 0))))
    present = F.aggregate("allele_counts", F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("allele_freqs", F.transform("allele_counts", lambda c: F.try_divide(c, present)))
    whole = F.filter("gts", lambda g: (F.size(g) == 2) & ~F.exists(g, lambda a: a < 0))
    pairs = F.transform(F.sequence(F.lit(0), n * n - 1), lambda k: F.size(F.filter(whole, lambda g: g[0] * n + g[1] == k)))
    rows = rows.withColumn("genotype_counts", pairs)
    rows = rows.withColumn("maf", F.array_min("allele_freqs")).withColumn("maf_allele", F.array_position("allele_freqs", F.col("maf")) - 1)
    longer = (F.col("alt") != ".") & (F.length("ref") != F.length("alt")) if legacy_indel else F.exists("alts", lambda a: (F.length(a) != F.length("ref")) & ~a.isin(".", "<INS>", "<DEL>"))
    rows = rows.withColumn("is_indel", longer | F.col("alt").isin("<INS>", "<DEL>") | ((F.col("alt") == ".") != (F.col("ref") == ".")) & (F.length("ref") != F.length("alt")))
    return rows


@dataclass(frozen=True)
class VariantFilter:
    """A named predicate; larger priorities are asked first."""

    name: str
    priority: int
    test: Callable[[DataFrame], Column]
    note: str


def coverage_filter(least: int) -> VariantFilter:
    return VariantFilter(f"cov{least}", 4, lambda _: F.element_at(info_map(F.col("info")), "DP").try_cast("int") >= least, f"Depth of {least} or more")


def maf_filter(most: float) -> VariantFilter:
    return VariantFilter(f"maf{most * 100:.0f}", 3, lambda _: F.col("maf") <= most, f"Minor allele frequency of {most:g} or less")


def missing_filter(most: float) -> VariantFilter:
    total = lambda: F.col("missing_alleles") + F.aggregate("allele_counts", F.lit(0), lambda s, x: s + x)
    return VariantFilter(f"missing{most * 100:.0f}", 3, lambda _: F.try_divide(F.col("missing_alleles"), total()) <= most, f"Share of missing alleles of {most:g} or less")


def alleles_filter(number: int) -> VariantFilter:
    return VariantFilter(f"alleles{number}", 3, lambda _: F.size("alts") + 1 == number, f"{number} alleles")


def quality_filter(least: int) -> VariantFilter:
    return VariantFilter(f"q{least}", 6, lambda _: F.coalesce(F.col("qual"), F.lit(-1)) >= least, f"Quality of {least} or more")


def snp_filter(include: bool = True) -> VariantFilter:
    return VariantFilter("snp" if include else "nosnp", 5, lambda _: (F.col("id") != ".") == include, "Known variant" if include else "No known variant")


def indel_filter(include: bool = True) -> VariantFilter:
    return VariantFilter("indel" if include else "noindel", 4, lambda _: F.col("is_indel") == include, "Indel" if include else "No indel")


def region_filter(regions: DataFrame) -> VariantFilter:
    """Positions inside a region; the table is joined, so it may be of any size."""
    return VariantFilter("reg", 2, lambda _: F.col("_in_region"), "Inside the regions") if regions is not None else VariantFilter("reg", 2, lambda _: F.lit(False), "No region")


def gene_regions(genes: DataFrame, names: list[str]) -> DataFrame:
    """Regions (chrom, start, end) of these genes; `genes` has name, chrom, start and end."""
    return genes.filter(F.col("name").isin(*names)).select("chrom", "start", "end")


def gene_filter(genes: DataFrame, names: list[str]) -> VariantFilter:
    """Positions inside one of the genes; give filter_chain their gene_regions."""
    return region_filter(gene_regions(genes, names))


def inheritance_filter(pattern: str, least: float, affected: list[bool]) -> VariantFilter:
    """Records where `least` of the samples (0 to 1) are cases that fit the pattern, and as many controls that do."""
    cases, controls = inheritance_shares(affected)[pattern]
    return VariantFilter(f"{pattern}{least * 100:.0f}", 3, lambda _: (cases >= 100 * least) & (controls >= 100 * least), f"{pattern.capitalize()} in {least:g} of cases and controls")


def filter_chain(variants: DataFrame, filters: list[VariantFilter], regions: DataFrame | None = None) -> DataFrame:
    """Adds `passed`, and writes the first filter that a record fails into `filter` (PASS where it was empty and all pass)."""
    rows = with_statistics(variants)
    if regions is not None:
        inside = contained(rows.select("chrom", "pos").distinct(), regions, "chrom", "pos", "pos").withColumn("_found", F.lit(True))
        rows = rows.join(inside, ["chrom", "pos"], "left").withColumn("_in_region", F.coalesce("_found", F.lit(False)))
    failed = F.lit(None).cast("string")
    for f in reversed(sorted(filters, key=lambda f: -f.priority)):  # the largest priority ends up outermost
        failed = F.when(F.coalesce(f.test(rows), F.lit(False)), failed).otherwise(F.lit(f.name))
    rows = rows.withColumn("_failed", failed)
    bare = F.col("filter").isin(".", "PASS")
    note = F.when(F.col("_failed").isNull(), F.when(F.col("filter") == ".", "PASS").otherwise(F.col("filter"))).when(bare, F.col("_failed")).otherwise(F.concat_ws(";", "filter", "_failed"))
    return rows.withColumn("filter", note).withColumn("passed", F.col("_failed").isNull()).select(*variants.columns, "passed")


def filter_headers(spark, filters: list[VariantFilter]) -> DataFrame:
    """id and description of the filters, in the order in which they are asked."""
    return spark.createDataFrame([(f.name, f.note) for f in sorted(filters, key=lambda f: -f.priority)], "id string, description string")


def file_statistics(variants: DataFrame) -> DataFrame:
    """One row: variants, known ones, indels, transitions, transversions, kinds, passes and mean quality over all."""
    rows = with_statistics(variants)
    change = F.concat("ref", "alt")
    single = (F.length("ref") == 1) & (F.length("alt") == 1) & F.col("ref").isin(*"ACGT") & F.col("alt").isin(*"ACGT") & (F.col("ref") != F.col("alt"))
    ti = change.isin("AG", "GA", "CT", "TC")
    return rows.agg(
        F.count(F.lit(1)).alias("variants"),
        F.max(F.size("samples")).alias("samples"),
        F.count_if(F.col("id") != ".").alias("snps"),
        F.count_if("is_indel").alias("indels"),
        F.count_if(single & ti).alias("transitions"),
        F.count_if(single & ~ti).alias("transversions"),
        F.count_if(F.size("alts") == 1).alias("biallelic"),
        F.count_if(F.size("alts") > 1).alias("multiallelic"),
        F.count_if(F.col("filter") == "PASS").alias("passes"),
        F.round(F.sum(F.when(F.col("qual") >= 0, F.col("qual")).otherwise(0)) / F.count(F.lit(1)), 6).alias("mean_quality"),
    )


def sample_genotypes(variants: DataFrame) -> DataFrame:
    """chrom, pos, sample (from 0) and gt of every genotype of records with GT."""
    return with_genotypes(variants).filter("gts IS NOT NULL").select("chrom", "pos", F.posexplode("gts").alias("sample", "gt"))


def sample_statistics(variants: DataFrame) -> DataFrame:
    """Genotypes with a missing allele, by sample."""
    return sample_genotypes(variants).groupBy("sample").agg(F.count_if(F.exists("gt", lambda a: a < 0)).alias("missing_genotypes"), F.count(F.lit(1)).alias("genotypes"))


def mendel_error(chrom: Column, child: Column, father: Column, mother: Column, male: Column) -> Column:
    """Whether a child's genotype can't come from its parents; null where one of them is missing or the rule doesn't hold.

    On X a son's allele comes from the mother; on Y and MT nothing is checked.
    """
    place = F.upper(F.regexp_replace(chrom, "^(?i)chr", ""))
    missing = F.exists(child, lambda a: a < 0) | F.exists(father, lambda a: a < 0) | F.exists(mother, lambda a: a < 0)
    first, last = child[0], F.element_at(child, -1)
    fits = (F.array_contains(father, first) & F.array_contains(mother, last)) | (F.array_contains(father, last) & F.array_contains(mother, first))
    son = F.array_contains(mother, first) & F.array_contains(mother, last)
    return F.when(place.isin("Y", "MT") | missing, None).when((place == "X") & male, ~son).otherwise(~fits)


def mendel_type(chrom: Column, child: Column, father: Column, mother: Column, male: Column) -> Column:
    """The kind of a Mendelian error, by how many alternate alleles child and parents have.

    -1: an allele is missing; -2: Y or MT; 0: no error.  Fixed values of the kinds: a heterozygous child of two parents
    without (1) or with only alternate alleles (2); a child without any whose mother (3), father (4) or both (5) have
    nothing else; a child with only alternate ones whose father (6), mother (7) or both (8) have none; on X, sons with
    only alternate alleles of a mother without any (9), and the other way round (10).
    """
    dose = lambda g: F.size(F.filter(g, lambda a: a > 0))
    c, f, m = dose(child), dose(father), dose(mother)
    missing = F.exists(child, lambda a: a < 0) | F.exists(father, lambda a: a < 0) | F.exists(mother, lambda a: a < 0)
    place = F.upper(F.regexp_replace(chrom, "^(?i)chr", ""))
    either = lambda at, both, by_father, by_mother: F.when((f == at) & (m == at), both).when(f == at, by_father).when(m == at, by_mother).otherwise(0)
    pair = F.when(c == 1, F.when((f == 0) & (m == 0), 1).when((f == 2) & (m == 2), 2).otherwise(0)).when(c == 0, either(2, 5, 4, 3)).otherwise(either(0, 8, 6, 7))
    son = F.when((c == 2) & (m == 0), 9).when((c == 0) & (m == 2), 10).otherwise(0)
    return F.when(missing, -1).when(place.isin("Y", "MT"), -2).when((place == "X") & male, son).otherwise(pair)


def mendel_types(variants: DataFrame, pedigree: DataFrame) -> DataFrame:
    """sample, type and records: how often each kind of error stands at each child."""
    trios = pedigree.filter("father IS NOT NULL AND mother IS NOT NULL").select("sample", "father", "mother", "sex")
    rows = with_genotypes(variants).filter("gts IS NOT NULL").select("chrom", "gts", F.posexplode("gts").alias("sample", "child")).join(trios, "sample")
    kind = mendel_type(F.col("chrom"), F.col("child"), F.get("gts", F.col("father")), F.get("gts", F.col("mother")), F.col("sex") == 1)
    return rows.groupBy("sample", kind.alias("type")).agg(F.count(F.lit(1)).alias("records"))


def mendel_errors(variants: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Errors by child; pedigree has sample, father and mother (numbers of samples) and sex (1 male)."""
    trios = pedigree.filter("father IS NOT NULL AND mother IS NOT NULL").select("sample", "father", "mother", "sex")
    rows = with_genotypes(variants).filter("gts IS NOT NULL").select("chrom", "gts", F.posexplode("gts").alias("sample", "child")).join(trios, "sample")
    bad = mendel_error(F.col("chrom"), F.col("child"), F.get("gts", F.col("father")), F.get("gts", F.col("mother")), F.col("sex") == 1)
    found = rows.groupBy("sample").agg(F.count_if(bad).alias("mendel_errors"))
    # children without a genotype have no errors
    return trios.select("sample").distinct().join(found, "sample", "left").select("sample", F.coalesce("mendel_errors", F.lit(0).cast("long")).alias("mendel_errors"))


def inheritance_shares(affected: list[bool]) -> dict[str, tuple[Column, Column]]:
    """Percent of all samples with a genotype that are cases, and controls, that fit each pattern; of a row with `gts`."""
    marks = F.array(*[F.lit(a) for a in affected])
    seen = F.filter(F.arrays_zip(F.col("gts").alias("g"), marks.alias("case")), lambda x: ~F.exists(x["g"], lambda a: a < 0))
    carries = lambda x: F.exists(x["g"], lambda a: a > 0)
    both = lambda x: F.forall(x["g"], lambda a: a > 0)
    share = lambda test: F.round(F.coalesce(F.try_divide(F.size(F.filter(seen, test)) * 100, F.size(seen)), F.lit(0)), 6)
    return {
        "dominant": (share(lambda x: x["case"] & carries(x)), share(lambda x: ~x["case"] & ~carries(x))),
        "recessive": (share(lambda x: x["case"] & both(x)), share(lambda x: ~x["case"] & ~both(x))),
    }


def inheritance(variants: DataFrame, affected: list[bool]) -> DataFrame:
    """Percent of cases and controls that fit a dominant or a recessive pattern, among samples with a genotype."""
    rows = with_genotypes(variants).filter("gts IS NOT NULL")
    shares = inheritance_shares(affected)
    return rows.select("chrom", "pos", *[c.alias(f"{who}_{pattern}") for pattern in shares for who, c in zip(("cases", "controls"), shares[pattern], strict=True)])


def condition(phenotype: Column) -> Column:
    return F.when(phenotype <= 1, "unaffected").when(phenotype <= 2, "affected").otherwise("unknown")


def family_errors(pedigree: DataFrame) -> DataFrame:
    """family, individual and what is wrong: repeated rows, unknown parents, parents of the wrong sex."""
    p = pedigree
    twice = p.groupBy("family", "individual").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("family", "individual", F.lit("duplicate").alias("error"))
    out = twice
    for role, sex in (("father", 1), ("mother", 2)):
        own = p.filter(F.col(role).isNotNull()).select("family", "individual", F.col(role).alias("parent"))
        known = p.select("family", F.col("individual").alias("parent"), F.col("sex").alias("_sex")).dropDuplicates(["family", "parent"])
        joined = own.join(known, ["family", "parent"], "left")
        out = out.unionByName(joined.filter("_sex IS NULL").select("family", "individual", F.lit(f"unknown {role}").alias("error")))
        out = out.unionByName(joined.filter(F.col("_sex") != sex).select("family", "individual", F.lit(f"{role} of wrong sex").alias("error")))
    return out


def subset(variants: DataFrame, samples: list[int]) -> DataFrame:
    """Only these samples, in this order."""
    return variants.withColumn("samples", F.array(*[F.get("samples", F.lit(i)) for i in samples]))


def without_info(variants: DataFrame, keys: list[str]) -> DataFrame:
    """INFO without these keys; `.` where nothing is left."""
    rest = F.filter(tokens(F.col("info"), ";"), lambda x: ~F.substring_index(x, "=", 1).isin(*keys))
    return variants.withColumn("info", F.when(F.size(rest) > 0, F.array_join(rest, ";")).otherwise("."))


def linkage(variants: DataFrame, window: int) -> DataFrame:
    """r2 of pairs of sites at most `window` positions apart, from the counts of alternate alleles of both samples' genotypes."""
    dose = F.transform("gts", lambda g: F.when(F.exists(g, lambda a: a < 0), None).otherwise(F.size(F.filter(g, lambda a: a > 0))))
    sites = with_genotypes(variants).filter("gts IS NOT NULL").select("chrom", "pos", dose.alias("x"))
    left = sites.select("chrom", F.col("pos").alias("pos1"), F.col("x").alias("x1"), F.floor(F.col("pos") / window).alias("bin"))
    right = sites.select("chrom", F.col("pos").alias("pos2"), F.col("x").alias("x2"), F.explode(F.array(F.floor(F.col("pos") / window), F.floor(F.col("pos") / window) - 1)).alias("bin"))
    near = left.join(right, ["chrom", "bin"]).filter((F.col("pos2") > F.col("pos1")) & (F.col("pos2") - F.col("pos1") <= window))
    both = F.filter(F.arrays_zip("x1", "x2"), lambda z: z["x1"].isNotNull() & z["x2"].isNotNull())
    sums = F.aggregate(
        both,
        F.struct(*[F.lit(0).cast("long").alias(k) for k in ("n", "a", "b", "aa", "bb", "ab")]),
        lambda s, z: F.struct((s["n"] + 1).alias("n"), (s["a"] + z["x1"]).alias("a"), (s["b"] + z["x2"]).alias("b"), (s["aa"] + z["x1"] * z["x1"]).alias("aa"), (s["bb"] + z["x2"] * z["x2"]).alias("bb"), (s["ab"] + z["x1"] * z["x2"]).alias("ab")),
    )
    rows = near.select("chrom", "pos1", "pos2", sums.alias("s"))
    cov, va, vb = F.col("s.n") * F.col("s.ab") - F.col("s.a") * F.col("s.b"), F.col("s.n") * F.col("s.aa") - F.col("s.a") * F.col("s.a"), F.col("s.n") * F.col("s.bb") - F.col("s.b") * F.col("s.b")
    return rows.select("chrom", "pos1", "pos2", F.round(F.coalesce(F.try_divide(cov * cov * F.lit(1.0), va * vb), F.lit(0.0)), 6).alias("r2"))


def haplotype_r2(variants: DataFrame, pairs: DataFrame, rounds: int = 30) -> DataFrame:
    """chrom1, pos1, chrom2, pos2, n and r2 of given pairs of sites, from haplotype frequencies by expectation maximisation.

    Samples with both genotypes fall into nine cells; only double heterozygotes leave open which alleles stand together,
    and each round shares them out by the product of the frequencies that it has.
    """
    dose = F.transform("gts", lambda g: F.when(F.exists(g, lambda a: a < 0), None).otherwise(F.size(F.filter(g, lambda a: a > 0))))
    sites = with_genotypes(variants).filter("gts IS NOT NULL").select("chrom", "pos", dose.alias("x"))
    named = lambda i: sites.select(F.col("chrom").alias(f"chrom{i}"), F.col("pos").alias(f"pos{i}"), F.col("x").alias(f"x{i}"))
    rows = pairs.select("chrom1", "pos1", "chrom2", "pos2").join(named(1), ["chrom1", "pos1"]).join(named(2), ["chrom2", "pos2"])
    both = F.filter(F.arrays_zip("x1", "x2"), lambda z: z["x1"].isNotNull() & z["x2"].isNotNull())
    cell = lambda a, b: F.size(F.filter(both, lambda z: (z["x1"] == a) & (z["x2"] == b)))
    rows = rows.select("chrom1", "pos1", "chrom2", "pos2", *[cell(a, b).alias(f"c{a}{b}") for a in range(3) for b in range(3)])
    c = {(a, b): F.col(f"c{a}{b}") for a in range(3) for b in range(3)}
    n = sum(c.values(), F.lit(0))
    # haplotypes that are certain: of each kind (allele of the first site, allele of the second)
    sure = {
        "f00": 2 * c[0, 0] + c[0, 1] + c[1, 0],
        "f01": 2 * c[0, 2] + c[0, 1] + c[1, 2],
        "f10": 2 * c[2, 0] + c[1, 0] + c[2, 1],
        "f11": 2 * c[2, 2] + c[1, 2] + c[2, 1],
    }
    rows = rows.withColumns({"n": n, **{f"s{k}": v for k, v in sure.items()}}).filter("n > 0")

    def step(f: Column, _: Column) -> Column:
        cis, trans = f["f00"] * f["f11"], f["f01"] * f["f10"]
        part = F.coalesce(F.try_divide(cis, cis + trans), F.lit(0.5)) * F.col("c11")
        return F.struct(*[((F.col(f"s{k}") + (part if k in ("f00", "f11") else F.col("c11") - part)) / (2.0 * F.col("n"))).alias(k) for k in sure])

    start = F.struct(*[F.lit(0.25).alias(k) for k in sure])
    rows = rows.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    p, q = F.col("f.f10") + F.col("f.f11"), F.col("f.f01") + F.col("f.f11")
    d = F.col("f.f11") - p * q
    r2 = F.coalesce(F.try_divide(d * d, p * (1 - p) * q * (1 - q)), F.lit(0.0))
    return rows.select("chrom1", "pos1", "chrom2", "pos2", "n", F.round(r2, 6).alias("r2"))
