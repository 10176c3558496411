"""Pileup: what every read shows at every reference position.

Reads, not letters, are shuffled: each goes to the spans of positions that it touches, is taken apart there, and the
positions of a span are put together in the same stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplan.functions import dna

from .realign import with_baq
from .reference import pieces
from .regions import contained

MASK = dna.UNMAPPED | dna.SECONDARY | dna.QC_FAIL | dna.DUPLICATE
#: Positions of a span.
SPAN = 256
_OP = re.compile(r"(\d+)([MIDNSHP=X])")
_LETTERS = np.array(list("ACGT"), dtype=object)
_NUMBER = np.full(256, 4, dtype=np.int64)
_NUMBER[list(b"ACGT")] = range(4)


def pileup(reads: DataFrame, min_mapq: int = 0, mask: int = MASK, contigs: DataFrame | None = None, min_quality: int = 0, keep: tuple[str, ...] = (), span: int = SPAN, baq: str | None = None, beds: DataFrame | None = None, without: tuple[str, list] | None = None) -> DataFrame:
    """tid, span, pos, read_id, token, quality, letter (null where deleted or skipped), ref, rev (on the reverse strand),
    offset (of the letter in its read) and the columns of `keep`.

    Tokens are letters (lower case on the reverse strand; with contigs `.` and `,` where they are the reference's), `*`
    deleted, `<` or `>` skipped, with the marks of a read's head and tail and of insertions and deletions that follow.
    Positions whose quality is under `min_quality` are left out.  With `baq` ("plain" or "extended", which asks for
    contigs) qualities are base alignment qualities.  With `beds` (chrom, start, end, half-open) only positions inside
    them are given; `without` is a column of read groups and those that take no part.
    """
    if without:
        reads = reads.filter(F.coalesce(~F.col(without[0]).isin(*without[1]), F.lit(True)))
    if baq:
        reads = with_baq(reads, contigs, baq == "extended")
    f = F.col("flag")
    reach = dna.reference_length(F.col("cigar"))
    good = reads.filter(dna.lacks(f, mask) & (F.col("tid") >= 0) & (F.col("mapq") >= min_mapq)).withColumn("reach", reach).filter("reach > 0")
    touched = F.explode(F.sequence(F.floor(F.col("pos") / span), F.floor((F.col("pos") + F.col("reach") - 1) / span))).alias("span")
    rows = good.select("tid", "pos", "read_id", "mapq", "cigar", "seq", "qual", dna.has(f, dna.REVERSE).alias("rev"), "reach", *keep, touched)
    if beds is not None:  # spans without a region don't go further
        held = beds.filter("end > start").select(F.col("chrom").alias("tid"), F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span))).alias("span"))
        rows = rows.join(held.distinct(), ["tid", "span"], "left_semi")
    # a stated number of partitions: rows multiply behind this shuffle, so its size in bytes says nothing
    rows = rows.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tid", "span")
    if contigs is None:
        rows = rows.withColumn("letters", F.lit(None).cast("string"))
    else:  # the letters of the span, and those of a deletion that goes on behind it
        rows = rows.join(pieces(contigs, span, span).select("tid", F.col("piece").alias("span"), "letters"), ["tid", "span"], "left")
    placed = F.aggregate(
        dna.cigar_ops(F.col("cigar")),
        F.struct(F.array().cast("array<struct<op:string,n:int,r:int,q:int>>").alias("ops"), F.lit(0).alias("r"), F.lit(0).alias("q")),
        lambda s, x: F.struct(
            F.array_append(s["ops"], F.struct(x["op"].alias("op"), x["n"].alias("n"), s["r"].alias("r"), s["q"].alias("q"))).alias("ops"),
            (s["r"] + F.when(x["op"].isin(*"MDN=X"), x["n"]).otherwise(0)).alias("r"),
            (s["q"] + F.when(x["op"].isin(*"MIS=X"), x["n"]).otherwise(0)).alias("q"),
        ),
        lambda s: s["ops"],
    )
    rows = rows.withColumn("ops", placed).select("*", F.posexplode("ops").alias("k", "o")).withColumn("next", F.get("ops", F.col("k") + 1)).filter(F.col("o.op").isin(*"MDN=X"))
    begin = F.col("pos") + F.col("o.r")
    first, last = F.greatest(F.lit(0), F.col("span") * span - begin), F.least(F.col("o.n") - 1, (F.col("span") + 1) * span - 1 - begin)
    rows = rows.drop("ops", "cigar").withColumns({"first": first.cast("int"), "last": last.cast("int")}).filter("first <= last").withColumn("i", F.explode(F.sequence("first", "last")))
    aligned = F.col("o.op").isin(*"M=X")
    at, place = F.col("o.q") + F.col("i"), F.col("o.r") + F.col("i")
    rows = rows.withColumn("letter", F.when(aligned, F.substr("seq", at + 1, F.lit(1))))
    rows = rows.withColumn("quality", F.substr("qual", F.when(aligned, at + 1).otherwise(F.greatest(F.col("o.q"), F.lit(1))), F.lit(1)))
    if min_quality:
        rows = rows.filter(F.ascii("quality") - 33 >= min_quality)
    inside = (F.col("pos") + place - F.col("span") * span + 1).cast("int")
    rows = rows.withColumns({"ref": F.substr("letters", inside, F.lit(1)), "inside": inside})
    cased = lambda c: F.when(F.col("rev"), F.lower(c)).otherwise(c)
    own = F.when(F.col("letter") == F.col("ref"), F.when(F.col("rev"), ",").otherwise(".")).otherwise(cased(F.col("letter")))
    shown = F.when(F.col("o.op") == "D", "*").when(F.col("o.op") == "N", F.when(F.col("rev"), "<").otherwise(">")).otherwise(own)
    ends = aligned & (F.col("i") == F.col("o.n") - 1)
    size = F.col("next.n")
    gone = F.rpad(F.coalesce(F.substr("letters", F.col("inside") + 1, size), F.lit("")), size, F.lit("N"))
    indel = (
        F.when(ends & (F.col("next.op") == "I"), F.concat(F.lit("+"), size.cast("string"), cased(F.substr("seq", at + 2, size))))
        .when(ends & (F.col("next.op") == "D"), F.concat(F.lit("-"), size.cast("string"), cased(gone)))
        .otherwise("")
    )
    head = F.when(place == 0, F.concat(F.lit("^"), F.chr(F.least(F.col("mapq"), F.lit(93)) + 33))).otherwise("")
    tail = F.when(place == F.col("reach") - 1, "$").otherwise("")
    rows = rows.select("tid", "span", (F.col("pos") + place).cast("long").alias("pos"), "read_id", *keep, F.concat(head, shown, indel, tail).alias("token"), "quality", "letter", "ref", "rev", F.when(aligned, at).alias("offset"))
    if beds is not None:
        rows = contained(rows, beds.filter("end > start").withColumn("end", F.col("end") - 1), "tid", "pos", "pos")
    return rows


def _texts(found: Column, max_depth: int | None) -> tuple[Column, Column, Column]:
    rows = F.array_sort(found)
    if max_depth is not None:
        rows = F.slice(rows, 1, max_depth)
    return F.size(rows).cast("long"), F.array_join(F.transform(rows, lambda x: x["token"]), ""), F.array_join(F.transform(rows, lambda x: x["quality"]), "")


def pileup_text(reads: DataFrame, min_mapq: int = 0, max_depth: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """tid, pos, depth, bases and qualities in the order of read_id; of deeper positions the first `max_depth` reads."""
    grouped = pileup(reads, min_mapq, **options).groupBy("tid", "span", "pos").agg(F.collect_list(F.struct("read_id", "token", "quality")).alias("x"))
    depth, bases, qualities = _texts(F.col("x"), max_depth)
    return grouped.select("tid", "pos", depth.alias("depth"), bases.alias("bases"), qualities.alias("qualities"))


def pileup_files(reads: DataFrame, file: str, names: list[str], contigs: DataFrame, min_mapq: int = 0, min_quality: int = 13, max_depth: int = 250) -> DataFrame:
    """Files side by side: tid, pos, ref and depth, bases and qualities of each (0, `*` and `*` where a file has nothing).

    `file` is the column that says where a read is from; reads of files that aren't named take no part.
    """
    rows = pileup(reads.filter(F.col(file).isin(*names)), min_mapq, contigs=contigs, min_quality=min_quality, keep=(file,))
    one = F.struct("read_id", "token", "quality")
    grouped = rows.groupBy("tid", "span", "pos").agg(F.max("ref").alias("ref"), *[F.collect_list(F.when(F.col(file) == n, one)).alias(f"_{n}") for n in names])
    columns = []
    for n in names:
        depth, bases, qualities = _texts(F.col(f"_{n}"), max_depth)
        columns += [depth.alias(f"depth_{n}"), F.when(depth > 0, bases).otherwise("*").alias(f"bases_{n}"), F.when(depth > 0, qualities).otherwise("*").alias(f"qualities_{n}")]
    return grouped.select("tid", "pos", F.coalesce("ref", F.lit("N")).alias("ref"), *columns)


def depth_of_files(reads: DataFrame, file: str, min_mapq: int = 0, min_quality: int = 0) -> DataFrame:
    """tid, pos, the file and depth: letters of good enough quality, deleted and skipped positions aside."""
    rows = pileup(reads, min_mapq, min_quality=min_quality, keep=(file,)).filter("letter IS NOT NULL")
    return rows.groupBy("tid", "span", "pos", file).agg(F.count(F.lit(1)).alias("depth")).drop("span")


def _aligned(cigar: str) -> tuple[np.ndarray, np.ndarray]:
    """For each aligned letter how far it is from the alignment's start, and which letter of the read it is."""
    r, q, there, own = 0, 0, [], []
    for size, op in _OP.findall(cigar or ""):
        n = int(size)
        if op in "M=X":
            there.append(np.arange(r, r + n))
            own.append(np.arange(q, q + n))
        r, q = r + n * (op in "MDN=X"), q + n * (op in "MIS=X")
    return (np.concatenate(there), np.concatenate(own)) if there else (np.zeros(0, dtype=np.int64),) * 2


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters of a column of texts, where each text begins and how long it is."""
    held = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8), ends[:-1], np.diff(ends)


def _shown(batch: pa.RecordBatch, min_quality: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells (place in the span, letter, quality) of all letters in a batch of span, pos, cigar, seq and qual."""
    at, pos = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    cigars = batch.column(2).dictionary_encode()
    kind = cigars.indices.to_numpy(zero_copy_only=False)
    tables = [_aligned(c) for c in cigars.dictionary.to_pylist()]
    begin = np.cumsum([0, *[len(t[0]) for t in tables]])
    there, own = (np.concatenate([t[k] for t in tables]) if tables else np.zeros(0, dtype=np.int64) for k in (0, 1))
    low, high = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
    order = np.argsort(kind, kind="stable")
    edge = np.searchsorted(kind[order], np.arange(len(tables) + 1))
    for k, (mine, _) in enumerate(tables):  # only what lies inside the span
        rows = order[edge[k] : edge[k + 1]]
        low[rows] = begin[k] + np.searchsorted(mine, at[rows] * span - pos[rows])
        high[rows] = begin[k] + np.searchsorted(mine, (at[rows] + 1) * span - pos[rows])
    count = high - low
    row = np.repeat(np.arange(len(pos)), count)
    cell = np.arange(len(row)) + np.repeat(low - (np.cumsum(count) - count), count)
    (seq, seq_at, seq_size), (qual, qual_at, qual_size) = _bytes(batch.column(3)), _bytes(batch.column(4))
    letter = own[cell]
    there = (pos - at * span)[row] + there[cell]
    good = (letter < seq_size[row]) & (letter < qual_size[row])
    row, letter, there = row[good], letter[good], there[good]
    number, quality = _NUMBER[seq[seq_at[row] + letter]], qual[qual_at[row] + letter].astype(np.int64)
    good = (number < 4) & ((quality - 33 >= min_quality) if min_quality else True)
    return row[good], ((there * 4 + number) * 256 + quality)[good]


def letter_counts(reads: DataFrame, contigs: DataFrame, keep: tuple[str, ...], min_mapq: int = 0, min_quality: int = 13, mask: int = MASK, span: int = SPAN) -> DataFrame:
    """tid, span, pos, the columns of `keep`, ref, letter, quality and n: how often a known letter of each quality stands on
    a known letter of the reference.

    Reads go to their spans, ordered by the columns of `keep`; a task counts one group of a span after the other in an array
    of one size, so neither its memory nor its rows grow with depth.
    """
    reach = dna.reference_length(F.col("cigar"))
    good = reads.filter(dna.lacks(F.col("flag"), mask) & (F.col("tid") >= 0) & (F.col("mapq") >= min_mapq)).withColumn("reach", reach).filter("reach > 0")
    touched = F.explode(F.sequence(F.floor(F.col("pos") / span), F.floor((F.col("pos") + F.col("reach") - 1) / span))).alias("span")
    group = ["tid", "span", *keep]
    rows = good.select("pos", "cigar", "seq", "qual", "tid", *keep, touched).select("span", "pos", "cigar", "seq", "qual", "tid", *keep)
    # a stated number of partitions: rows multiply behind this shuffle, so its size in bytes says nothing
    rows = rows.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tid", "span").sortWithinPartitions(*group)
    kinds = dict(rows.dtypes)
    cells = span * 4 * 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names = None, np.zeros(cells, dtype=np.int64), None

        def out() -> pa.RecordBatch:
            cell = np.flatnonzero(held)
            repeated = [v.take(pa.array(np.zeros(len(cell), dtype=np.int64))) for v in now[1]]
            columns = [*repeated, pa.array(now[0][1] * span + cell // 1024), pa.array(_LETTERS[cell // 256 % 4], pa.string()), pa.array((cell % 256 - 33).astype(np.int32)), pa.array(held[cell])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [*group, "pos", "letter", "quality", "n"]
            keys = [batch.column(i) for i in (5, 0, *range(6, 6 + len(keep)))]
            codes = [k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
            row, cell = _shown(batch, min_quality, span)
            edge = np.searchsorted(row, np.append(first, batch.num_rows))
            for k, a in enumerate(first.tolist()):
                values = [x.slice(a, 1) for x in keys]
                key = [v[0].as_py() for v in values]
                if now is None or now[0] != key:
                    if now is not None:
                        yield out()
                    now, held = (key, values), np.zeros(cells, dtype=np.int64)
                held += np.bincount(cell[edge[k] : edge[k + 1]], minlength=cells)
        if now is not None:
            yield out()

    counted = rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", pos long, letter string, quality int, n long")
    counted = counted.join(pieces(contigs, span, span).select("tid", F.col("piece").alias("span"), "letters"), ["tid", "span"])
    ref = F.substr("letters", (F.col("pos") - F.col("span") * span + 1).cast("int"), F.lit(1))
    return counted.withColumn("ref", ref).filter("ref IN ('A', 'C', 'G', 'T')").select("tid", "span", "pos", *keep, "ref", "letter", "quality", "n")


def genotype_likelihoods(reads: DataFrame, contigs: DataFrame, sample: str, min_mapq: int = 0, min_quality: int = 13) -> DataFrame:
    """tid, pos, sample, ref, alt, n and pl0 to pl2 of every position and sample that shows a letter beside the reference's.

    `alt` is the letter with most quality among the others at that position over all samples (ties: the first).  A letter
    read with error e has the chance 1 - e under its own allele and e / 3 under another; a heterozygote shows either by
    half.  Likelihoods are phred-scaled against the best of the three.  Everything is summed, nothing is collected.
    """
    return likelihoods_of(letter_counts(reads, contigs, (sample,), min_mapq, min_quality), sample)


def likelihoods_of(counts: DataFrame, sample: str) -> DataFrame:
    """The genotype likelihoods of `letter_counts`, which may hold more columns than `sample`."""
    bases = "ACGT"
    rows = counts.withColumns({"e": F.pow(F.lit(10.0), -F.col("quality") / 10), "q": F.col("quality")})
    times = F.col("n")
    same, other = times * F.log10(1 - F.col("e")), times * F.log10(F.col("e") / 3)
    half = times * F.log10((1 - F.col("e") + F.col("e") / 3) / 2)
    sums = [F.sum(times).alias("n"), F.sum(other).alias("other"), F.max("ref").alias("ref")]
    for b in bases:
        mine = F.col("letter") == b
        sums += [F.coalesce(F.sum(F.when(mine, c)), F.lit(0.0)).alias(f"{k}_{b}") for k, c in (("same", same), ("half", half), ("diff", other))]
        sums += [F.coalesce(F.sum(F.when(mine, times * F.col("q"))), F.lit(0)).alias(f"q_{b}")]
    by_sample = rows.groupBy("tid", "span", "pos", sample).agg(*sums)
    whole = by_sample.groupBy("tid", "span", "pos").agg(*[F.sum(f"q_{b}").alias(f"t_{b}") for b in bases])
    both = by_sample.join(whole, ["tid", "span", "pos"])
    best = F.greatest(*[F.when(F.col("ref") == b, -1).otherwise(F.col(f"t_{b}")) for b in bases])
    alt = F.coalesce(*[F.when((F.col("ref") != b) & (F.col(f"t_{b}") == best), b) for b in bases])
    both = both.withColumns({"best": best, "alt": alt}).filter("best > 0")
    pick = lambda k, c: F.coalesce(*[F.when(F.col(c) == b, F.col(f"{k}_{b}")) for b in bases])
    rest = F.col("other") - pick("diff", "ref") - pick("diff", "alt")
    likelihoods = [pick("same", "ref") + pick("diff", "alt") + rest, pick("half", "ref") + pick("half", "alt") + rest, pick("diff", "ref") + pick("same", "alt") + rest]
    both = both.withColumns({f"l{k}": x for k, x in enumerate(likelihoods)})
    top = F.greatest("l0", "l1", "l2")
    return both.select("tid", "pos", sample, "ref", "alt", "n", *[F.round(-10 * (F.col(f"l{k}") - top)).cast("int").alias(f"pl{k}") for k in range(3)])


def difference_histogram(likelihoods: DataFrame) -> DataFrame:
    """difference (to 255) and sites: how far the best genotype is ahead of the second."""
    second = F.array_sort(F.array("pl0", "pl1", "pl2"))[1]
    return likelihoods.groupBy(F.least(second, F.lit(255)).alias("difference")).agg(F.count(F.lit(1)).alias("sites"))


def call_genotypes(likelihoods: DataFrame, sample: str) -> DataFrame:
    """tid, pos, sample, gt (alternate alleles) and gq of the best genotype (ties: fewer), and the second best's distance."""
    order = F.array_sort(F.array(*[F.struct(F.col(f"pl{k}").alias("pl"), F.lit(k).alias("gt")) for k in range(3)]))
    return likelihoods.select("tid", "pos", sample, order[0]["gt"].alias("gt"), (order[1]["pl"] - order[0]["pl"]).alias("gq"))


def trio_differences(likelihoods: DataFrame, sample: str, father, mother, child) -> DataFrame:  # noqa: ANN001
    """tid, pos, and `difference`: by how much the best genotypes of a trio that a child can have from its parents are
    less likely (phred-scaled) than the best of all; `same`: the same for father and mother of one genotype."""
    role = {"f": father, "m": mother, "c": child}
    sums = [F.max(F.when(F.col(sample) == who, F.col(f"pl{g}"))).alias(f"{r}{g}") for r, who in role.items() for g in range(3)]
    rows = likelihoods.filter(F.col(sample).isin(father, mother, child)).groupBy("tid", "pos").agg(*sums).dropna()
    given = {0: (0,), 1: (0, 1), 2: (1,)}  # alternate alleles that a parent of so many can hand on
    fits = sorted({(f, m, a + b) for f in range(3) for m in range(3) for a in given[f] for b in given[m]})
    together = F.least(*[F.col(f"f{f}") + F.col(f"m{m}") + F.col(f"c{c}") for f, m, c in fits])
    return rows.select("tid", "pos", together.alias("difference"), F.least(*[F.col(f"f{g}") + F.col(f"m{g}") for g in range(3)]).alias("same"))


def allele_counts(likelihoods: DataFrame, sample: str, theta: float = 0.001) -> DataFrame:
    """tid, pos, samples, alleles (the likeliest number of alternate alleles) and variant (chance that there is one).

    The chance of the data given so many alternate alleles is built up sample by sample; the prior is that of a neutral
    population, theta / k for k alleles.  A site's samples are few and stand in one row.
    """
    one = F.struct(sample, F.array(*[F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10) for g in range(3)]).alias("l"))
    rows = likelihoods.groupBy("tid", "pos").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["l"]).alias("l"))
    at = lambda z, j: F.when((j >= 0) & (j < F.size(z)), F.get(z, j)).otherwise(0.0)

    def grow(z: Column, l: Column) -> Column:  # noqa: E741
        return F.transform(F.sequence(F.lit(0), F.size(z) + 1), lambda j: at(z, j) * l[0] + 2 * at(z, j - 1) * l[1] + at(z, j - 2) * l[2])

    start = F.array(F.lit(1.0))
    rows = rows.withColumn("z", F.aggregate("l", start, grow)).withColumn("ways", F.aggregate("l", start, lambda z, _: grow(z, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))))
    n = 2 * F.size("l")
    harmonic = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + 1 / k)
    prior = lambda j: F.when(j == 0, 1 - theta * harmonic).otherwise(theta / j)
    post = F.transform("z", lambda z, j: z / F.get("ways", j) * prior(j))
    rows = rows.withColumn("post", post)
    total = F.aggregate("post", F.lit(0.0), lambda s, x: s + x)
    best = F.array_position("post", F.array_max("post")) - 1
    return rows.select("tid", "pos", F.size("l").alias("samples"), best.cast("int").alias("alleles"), F.round(1 - F.col("post")[0] / total, 6).alias("variant"))
