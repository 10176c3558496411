"""Raw reads: statistics, filter, trimming, conversion and mapping.

`reads` has id, sequence and quality (Phred + 33).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplan.functions import dna, seeds
from cytoplan.functions.edits import fits

#: Letters of contigs that go to all tasks at once, and in all; where there are more, seeds and places are joined.
BLOCK, HELD = 1 << 19, 1 << 22


def read_statistics(reads: DataFrame) -> DataFrame:
    """Length, letters and mean quality of each read."""
    return reads.select("id", F.length("sequence").alias("length"), *[dna.count_of(F.col("sequence"), b).alias(f"n_{b.lower()}") for b in "ACGTN"], F.round(dna.mean_ascii(F.col("quality")), 6).alias("mean_quality"))


def quality_range(reads: DataFrame, low: int = 33, high: int = 126) -> DataFrame:
    """id and outside: quality letters whose code isn't in [low, high]."""
    codes = F.transform(F.filter(F.split("quality", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return reads.select("id", F.size(F.filter(codes, lambda c: ~c.between(low, high))).alias("outside"))


def filter_reads(reads: DataFrame, length: tuple[int, int], quality: tuple[float, float], max_n: int) -> DataFrame:
    """Adds `passed`: length and mean quality code inside their bounds, and fewer than max_n unknown letters."""
    ok = F.length("sequence").between(*length) & dna.mean_ascii(F.col("quality")).between(*quality) & (dna.count_of(F.col("sequence"), "N") < max_n)
    return reads.withColumn("passed", F.coalesce(ok, F.lit(False)))


def trim(reads: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Without so many letters at the ends."""
    n = F.greatest(F.length("sequence") - left - right, F.lit(0))
    return reads.withColumns({c: F.substr(F.col(c), F.lit(left + 1), n) for c in ("sequence", "quality")})


def paired(first: DataFrame, second: DataFrame, on: str = "ordinal") -> DataFrame:
    """Two files' reads side by side, by their ordinal."""
    return first.select(on, *[F.col(c).alias(f"{c}_1") for c in ("id", "sequence", "quality")]).join(second.select(on, *[F.col(c).alias(f"{c}_2") for c in ("id", "sequence", "quality")]), on)


def converted(reads: DataFrame, from_base: str = "C", to_base: str = "T") -> DataFrame:
    """Reads with every `from_base` as `to_base`; adds `converted`, how many that were, and `total`, all of both."""
    changed, same = dna.count_of(F.col("sequence"), from_base), dna.count_of(F.col("sequence"), to_base)
    return reads.withColumns({"converted": changed, "total": changed + same, "sequence": F.translate("sequence", from_base, to_base)})


def kmers(texts: DataFrame, key: str, text: str, k: int, step: int = 1) -> DataFrame:
    """key, offset (from 0) and kmer of all k letters in a row."""
    n = F.length(text) - k
    at = F.when(n >= 0, F.sequence(F.lit(0), n, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return texts.select(key, F.explode(at).alias("offset"), text).select(key, "offset", F.substr(F.col(text), F.col("offset") + 1, F.lit(k)).alias("kmer"))


def both_strands(reads: DataFrame) -> DataFrame:
    """id, sequence and strand of each read and of its reverse complement."""
    other = reads.select("id", dna.reverse_complement(F.col("sequence")).alias("sequence"), F.lit(1).alias("strand"))
    return reads.select("id", "sequence", F.lit(0).alias("strand")).unionByName(other)


def contig_windows(contigs: DataFrame, reach: int, size: int = 1 << 12) -> DataFrame:
    """chrom, start, piece, first and letters: contigs (chrom, start, sequence) in pieces of `size` letters and `reach` more, so that no row is long."""
    at = F.sequence(F.lit(0), F.floor(F.greatest(F.length("sequence") - 1, F.lit(0)) / size))
    rows = contigs.select("chrom", "start", "sequence", F.explode(at).alias("piece"))
    return rows.select("chrom", "start", "piece", (F.col("start") + F.col("piece") * size).alias("first"), F.substr("sequence", (F.col("piece") * size + 1).cast("int"), F.lit(size + reach)).alias("letters"))


def _places(pieces: DataFrame, k: int, size: int) -> DataFrame:
    """Every k letters of the pieces, each place of a contig once: kmer, chrom, begin (of the contig) and at."""
    n = F.least(F.length("letters") - k + 1, F.lit(size))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = pieces.select("chrom", "start", "first", "letters", F.explode(at).alias("offset"))
    return rows.select("chrom", F.col("start").alias("begin"), (F.col("first") + F.col("offset")).alias("at"), F.substr("letters", F.col("offset") + 1, F.lit(k)).alias("kmer"))


def map_exact(reads: DataFrame, contigs: DataFrame, k: int = 16, longest: int = 1 << 12) -> DataFrame:
    """read id, chrom, pos, strand of every exact occurrence of reads of k letters or more.

    The first k letters are looked up, and only places where they stand fetch the piece of the contig and compare the
    rest.  Lookups have a second key, so that Spark can split very common letters.
    """
    return map_mismatches(reads, contigs, 0, k, longest).select("id", "chrom", "pos", "strand")


def _differing(one: str, two: str) -> Column:
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.size(F.filter(F.arrays_zip(letters(one).alias("a"), letters(two).alias("b")), lambda z: z["a"] != z["b"]))


def _blocks(contigs: DataFrame, held: int) -> list[list[tuple]] | None:
    """Few and short contigs in blocks of BLOCK letters; None if there are more than `held` letters, or one is longer than a block."""
    n = F.length("sequence")
    letters, longest = contigs.agg(F.sum(n), F.max(n)).first()
    if (letters or 0) > held or (longest or 0) > BLOCK:
        return None
    out, room = [], 0
    for row in contigs.filter(n > 0).select("chrom", "start", "sequence").toLocalIterator():
        if len(row.sequence) > room:
            out.append([])
            room = BLOCK
        out[-1].append(tuple(row))
        room -= len(row.sequence)
    return out


def _map_held(reads: DataFrame, kinds: dict[str, str], block: list[tuple], errors: int, bisulfite: bool, gaps: bool) -> DataFrame:
    """Places of reads (id, sequence) in a block of contigs: one Arrow map, nothing is shuffled but hits."""
    names = ["id", "sequence", "chrom", "begin", "pos", "strand", "mismatches"] + ["cigar"] * gaps
    schema = f"id {kinds['id']}, sequence string, chrom {kinds['chrom']}, begin long, pos long, strand int, mismatches int" + ", cigar string" * gaps
    changes = (("C", "T"), ("G", "A")) if bisulfite else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = []
        for change in changes:
            if sides and not bisulfite:
                sides.append(sides[0])
            else:
                sides.append(seeds.Contigs([(c, s, t.replace(*change) if change else t) for c, s, t in block], errors, gaps))
        begins, chroms = np.array([s for _, s, _ in block], dtype=np.int64), pa.array([c for c, _, _ in block])
        for batch in batches:
            kind = batch.schema.field(0).type if batch.num_rows else None
            for numbers, letters in seeds.groups(batch.column(1)):
                for strand, (change, held) in enumerate(zip(changes, sides, strict=True)):
                    rows = letters if strand == 0 else seeds.reverse_complement(letters)
                    if change:
                        rows = np.where(rows == ord(change[0]), np.uint32(ord(change[1])), rows)
                    for row, place, *more in held.edits(rows) if gaps else held.mismatches(rows):
                        texts = pa.array([rows[i].tobytes().decode("utf-32-le") for i in row.tolist()], pa.string())
                        if gaps:
                            ends = np.minimum(place + rows.shape[1] + errors, held.end[held.owner[place]])
                            stretches = [held.text[a:b].tobytes().decode("utf-32-le").encode() for a, b in zip(place.tolist(), ends.tolist(), strict=True)]
                            found, cigars = fits([t.encode() for t in texts.to_pylist()], stretches, errors)
                            more = [found, cigars]
                        owner = held.owner[place]
                        columns = [
                            batch.column(0).take(pa.array(numbers[row])).cast(kind),
                            texts,
                            chroms.take(pa.array(owner)),
                            pa.array(begins[owner]),
                            pa.array(begins[owner] + place - held.begin[owner]),
                            pa.array(np.full(len(row), strand, dtype=np.int32)),
                            pa.array(more[0], pa.int32()),
                            *[pa.array(x, pa.string()) for x in more[1:]],
                        ]
                        out = pa.RecordBatch.from_arrays(columns, names=names)
                        yield out.filter(pa.array(np.asarray(more[0]) <= errors)) if len(row) else out.slice(0, 0)

    return reads.select("id", "sequence").mapInArrow(run, schema).distinct()


def _held(reads: DataFrame, contigs: DataFrame, errors: int, bisulfite: bool, gaps: bool, held: int) -> DataFrame | None:
    """Hits of reads in few contigs, or None if there are too many."""
    blocks = _blocks(contigs, held)
    if not blocks:
        return None
    kinds = {"id": dict(reads.dtypes)["id"], "chrom": dict(contigs.dtypes)["chrom"]}
    found = None
    for block in blocks:
        part = _map_held(reads, kinds, block, errors, bisulfite, gaps)
        found = part if found is None else found.unionByName(part)
    return found.distinct() if len(blocks) > 1 else found


def map_mismatches(reads: DataFrame, contigs: DataFrame, errors: int, k: int = 16, longest: int = 1 << 12, bisulfite: bool = False, held: int = HELD) -> DataFrame:
    """id, chrom, pos, strand and mismatches of every place where a read fits with at most `errors` differing letters.

    A read is cut into errors + 1 stretches; where it fits, one of them stands without a difference, so its first k
    letters are a seed there (reads with a stretch shorter than k aren't mapped).  With bisulfite, letters are compared
    after C became T on both sides (G became A on the reverse strand of the read, which is the same there).  Reads of up
    to `longest` letters are compared in one piece of the contig, longer ones in all pieces that they touch.

    Contigs of up to `held` letters in all go to the tasks that hold the reads; of more, seeds and places are joined.
    """
    usable = reads.filter(F.floor(F.length("sequence") / (errors + 1)) >= k)
    if (found := _held(usable, contigs, errors, bisulfite, False, held)) is not None:
        return found.select("id", "chrom", "pos", "strand", "mismatches")
    turn = (lambda c: F.translate(c, "C", "T")) if bisulfite else (lambda c: c)
    back = (lambda c: F.translate(c, "G", "A")) if bisulfite else (lambda c: c)
    step = F.floor(F.length("sequence") / (errors + 1)).cast("int")
    size = 1 << 12
    found = None
    for strand, change in ((0, turn), (1, back)):
        # the reverse strand is looked for by the reverse complement
        text = change(F.col("sequence") if strand == 0 else dna.reverse_complement(F.col("sequence")))
        own = reads.filter(step >= k).select("id", text.alias("sequence"), step.alias("step"))
        seeds = own.select("id", "sequence", F.explode(F.transform(F.sequence(F.lit(0), F.lit(errors)), lambda i: i * F.col("step"))).alias("skip"))
        seeds = seeds.withColumn("kmer", F.substr("sequence", F.col("skip") + 1, F.lit(k)))
        pieces = contig_windows(contigs.withColumn("sequence", change(F.col("sequence"))), max(longest, k), size)
        common = F.pmod(F.xxhash64("kmer"), F.lit(1024)).alias("_k")
        near = seeds.select("*", common).join(_places(pieces, k, size).select("*", common), ["kmer", "_k"])
        near = near.select("id", "sequence", "chrom", "begin", (F.col("at") - F.col("skip")).alias("pos")).distinct()
        held = pieces.select("chrom", F.col("start").alias("begin"), "piece", "first", "letters")
        first = F.floor((F.col("pos") - F.col("begin")) / size)
        short = near.filter(F.length("sequence") <= longest).withColumn("piece", first).join(held, ["chrom", "begin", "piece"])
        there = F.substr("letters", (F.col("pos") - F.col("first") + 1).cast("int"), F.length("sequence"))
        short = short.withColumn("there", there).filter(F.length("there") == F.length("sequence"))
        differ = _differing("sequence", "there") if errors else F.when(F.col("sequence") == F.col("there"), 0).otherwise(1)
        part = short.select("id", "chrom", "pos", differ.alias("mismatches"))
        # of a long read every piece compares its own letters
        touched = F.explode(F.sequence(first, F.floor((F.col("pos") - F.col("begin") + F.length("sequence") - 1) / size)))
        long = near.filter(F.length("sequence") > longest).withColumn("piece", touched).join(held, ["chrom", "begin", "piece"])
        a, b = F.greatest(F.col("pos"), F.col("first")), F.least(F.col("pos") + F.length("sequence"), F.col("first") + size)
        long = long.withColumns({"there": F.substr("letters", (a - F.col("first") + 1).cast("int"), (b - a).cast("int")), "own": F.substr("sequence", (a - F.col("pos") + 1).cast("int"), (b - a).cast("int"))})
        seen = long.select("id", F.xxhash64("sequence").alias("text"), "chrom", "begin", "pos", F.length("sequence").alias("n"), F.length("there").alias("seen"), _differing("own", "there").alias("differ"))
        whole = seen.groupBy("id", "text", "chrom", "begin", "pos", "n").agg(F.sum("seen").alias("seen"), F.sum("differ").cast("int").alias("mismatches")).filter(F.col("seen") == F.col("n"))
        part = part.unionByName(whole.select("id", "chrom", "pos", "mismatches"))
        part = part.filter(F.col("mismatches") <= errors).select("id", "chrom", "pos", F.lit(strand).alias("strand"), "mismatches")
        found = part if found is None else found.unionByName(part)
    return found


def map_edits(reads: DataFrame, contigs: DataFrame, errors: int, k: int = 16, bisulfite: bool = False, held: int = HELD) -> DataFrame:
    """id, chrom, pos, strand, mismatches (edits) and cigar of every place where a read fits with at most `errors` letters
    changed, inserted or deleted.

    A read fits at a place with so many edits as it needs against the contig from there on.  Of places at most `errors`
    apart the one with fewest edits stays, and the first of equal ones.  A read is cut into errors + 1 stretches, one of
    which stands unchanged wherever it fits, at most `errors` letters beside its place; its first k letters are the seed
    (reads with a stretch shorter than k aren't mapped).  Every place near a seed is measured, whole batches at once.

    Contigs of up to `held` letters in all go to the tasks that hold the reads; of more, seeds and places are joined.
    """
    usable = reads.filter(F.floor(F.length("sequence") / (errors + 1)) >= k)
    if (found := _held(usable, contigs, errors, bisulfite, True, held)) is not None:
        return _fewest(found.select("id", "chrom", "pos", "strand", "mismatches", "cigar"), errors)
    turn = (lambda c: F.translate(c, "C", "T")) if bisulfite else (lambda c: c)
    back = (lambda c: F.translate(c, "G", "A")) if bisulfite else (lambda c: c)
    step = F.floor(F.length("sequence") / (errors + 1)).cast("int")
    size = 1 << 12
    found = None
    for strand, change in ((0, turn), (1, back)):
        text = change(F.col("sequence") if strand == 0 else dna.reverse_complement(F.col("sequence")))
        own = reads.filter(step >= k).select("id", text.alias("sequence"), step.alias("step"))
        seeds = own.select("id", "sequence", F.explode(F.transform(F.sequence(F.lit(0), F.lit(errors)), lambda i: i * F.col("step"))).alias("skip"))
        seeds = seeds.withColumn("kmer", F.substr("sequence", F.col("skip") + 1, F.lit(k)))
        pieces = contig_windows(contigs.withColumn("sequence", change(F.col("sequence"))), k, size)
        common = F.pmod(F.xxhash64("kmer"), F.lit(1024)).alias("_k")
        near = seeds.select("*", common).join(_places(pieces, k, size).select("*", common), ["kmer", "_k"])
        place = F.explode(F.sequence(F.col("at") - F.col("skip") - errors, F.col("at") - F.col("skip") + errors)).alias("pos")
        near = near.select("id", "sequence", "chrom", "begin", place).filter("pos >= begin").distinct()
        # the letters of the contig from each place on, from all pieces that they touch
        first = F.floor((F.col("pos") - F.col("begin")) / size)
        last = F.floor((F.col("pos") - F.col("begin") + F.length("sequence") + errors - 1) / size)
        parts = near.select("*", F.explode(F.sequence(first, last)).alias("piece")).join(pieces.select("chrom", F.col("start").alias("begin"), "piece", "first", "letters"), ["chrom", "begin", "piece"])
        a, b = F.greatest(F.col("pos"), F.col("first")), F.least(F.col("pos") + F.length("sequence") + errors, F.col("first") + size)
        parts = parts.withColumn("part", F.struct("piece", F.substr("letters", (a - F.col("first") + 1).cast("int"), (b - a).cast("int")).alias("text")))
        whole = parts.groupBy("id", "sequence", "chrom", "begin", "pos").agg(F.array_join(F.array_sort(F.collect_list("part"))["text"], "").alias("stretch"))
        rows = whole.select("id", "chrom", "pos", F.lit(strand).alias("strand"), "sequence", "stretch")
        found = rows if found is None else found.unionByName(rows)
    kinds = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[x or b"" for x in batch.column(i).cast(pa.binary()).to_pylist()] for i in (4, 5)]
            edits, cigars = fits(*texts, errors)
            good = pa.array(edits <= errors)
            columns = [*(batch.column(i) for i in range(4)), pa.array(edits, pa.int32()), pa.array(cigars)]
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in columns], names=["id", "chrom", "pos", "strand", "mismatches", "cigar"])

    hits = found.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("id", "chrom", "pos", "strand")) + ", mismatches int, cigar string")
    return _fewest(hits, errors)


def _fewest(hits: DataFrame, errors: int) -> DataFrame:
    """Of places at most `errors` apart the one with fewest edits, and the first of equal ones."""
    beside = Window.partitionBy("id", "chrom", "strand").orderBy("pos").rangeBetween(-errors, errors)
    best = F.min(F.struct("mismatches", "pos")).over(beside)
    return hits.withColumn("_best", best).filter((F.col("_best.pos") == F.col("pos"))).drop("_best")


# Fixed value: the score of a mapping, whatever its letters.
MAPPING_SCORE = 254


def hit_tags(hits: DataFrame) -> DataFrame:
    """Adds the optional fields of a mapping: `as` (its score, the same for all), `nh` (places of the read) and `nm` (differing letters)."""
    places = hits.groupBy("id").agg(F.count(F.lit(1)).alias("nh"))
    return hits.join(places, "id").withColumns({"as": F.lit(MAPPING_SCORE), "nm": F.col("mismatches")})


def candidate_locations(reads: DataFrame, contigs: DataFrame, k: int = 16, step: int = 8, gap: int = 50) -> DataFrame:
    """id, strand, chrom, start, end and seeds: places of each read's seeds (every `step` letters), joined where at most `gap` apart."""
    from .regions import merge_close

    seeds = kmers(both_strands(reads).withColumn("key", F.struct("id", "strand")), "key", "sequence", k, step)
    common = F.pmod(F.xxhash64("kmer"), F.lit(1024)).alias("_k")
    met = seeds.select("key", "kmer", common).distinct().join(_places(contig_windows(contigs, k), k, 1 << 12).select("kmer", "chrom", F.col("at").alias("start"), common), ["kmer", "_k"])
    rows = met.select("key.id", "key.strand", "chrom", "start", (F.col("start") + k).alias("end"))
    return merge_close(rows, ["id", "strand", "chrom"], "start", "end", gap).withColumnRenamed("members", "seeds")
