"""Reference sequences in pieces: `fasta` and `packed_genome` as Spark data sources.

`spark.read.format("fasta").load(path)` plans pieces from the index of line lengths beside the file (`path.fai`, or the
option `index`), so that no task reads a contig as a whole and a slice reads its own bytes only.  `index_fasta` makes
such an index by a scan of byte ranges.  A packed genome holds three letters a byte, all contigs behind each other.

Options: `piece` (letters of a row, 65,536), `regions` (`name`, `name:start` or `name:start-end` from 1, closed, with
commas between), `splitBytes` (letters of a partition), `index`.  Rows have chrom, start (from 0) and sequence.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, opened

# Fixed value of the format: the letters that a packed byte tells apart, in their order.
PACKED_LETTERS = "ACGNT"
SCHEMA = "chrom string, start long, sequence string"


@dataclass
class Contig:
    name: str
    length: int
    offset: int
    line_letters: int = 0
    line_bytes: int = 0


class _Pieces(InputPartition):
    def __init__(self, parts: list[tuple[int, int, int]]) -> None:
        self.parts = parts  # number of the contig, first letter, end


def asked(contigs: list[Contig], regions: str | None) -> list[tuple[int, int, int]]:
    """Contigs' numbers and letters of the regions, cut to the contigs; everything without regions."""
    if not regions:
        return [(i, 0, c.length) for i, c in enumerate(contigs)]
    number = {c.name: i for i, c in enumerate(contigs)}
    out = []
    for text in filter(None, regions.split(",")):
        name, _, span = (text, "", "") if text in number else text.rpartition(":")
        if name not in number:
            continue
        first, _, last = span.partition("-")
        length = contigs[number[name]].length
        a, b = max(int(first or 1), 1) - 1, min(int(last or length), length)
        if a < b:
            out.append((number[name], a, b))
    return out


class PieceReader(DataSourceReader):
    """Plans pieces of contigs; what knows the file's form reads letters [a, b) of one."""

    def __init__(self, options: dict) -> None:
        self.path, self.piece, self.regions = options["path"], int(options.get("piece", 1 << 16)), options.get("regions")
        self.split, self.index = int(options.get("splitBytes", 64 << 20)), options.get("index")
        self.contigs = self.contigs_of()

    def contigs_of(self) -> list[Contig]:
        raise NotImplementedError

    def letters(self, contig: Contig, a: int, b: int) -> str:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        held: list[tuple[int, int, int]] = []
        size = 0
        for number, a, b in asked(self.contigs, self.regions):
            for x in range(a, b, self.split):
                y = min(x + self.split, b)
                if size and size + y - x > self.split:
                    out.append(_Pieces(held))
                    held, size = [], 0
                held.append((number, x, y))
                size += y - x
        return [*out, _Pieces(held)]

    def read(self, partition: _Pieces) -> Iterator[tuple]:
        for number, a, b in partition.parts:
            contig = self.contigs[number]
            for x in range(a, b, self.piece):
                yield contig.name, x, self.letters(contig, x, min(x + self.piece, b))


class FastaReader(PieceReader):
    def contigs_of(self) -> list[Contig]:
        with opened(self.index or f"{self.path}.fai") as f:
            rows = [line.decode().rstrip("\n").split("\t") for line in f]
        return [Contig(r[0], *map(int, r[1:5])) for r in rows if len(r) >= 5]

    def letters(self, contig: Contig, a: int, b: int) -> str:
        at = lambda k: contig.offset + k // contig.line_letters * contig.line_bytes + k % contig.line_letters
        with opened(self.path) as f:
            f.seek(at(a))
            data = f.read(at(b - 1) + 1 - at(a))
        return data.translate(None, b"\r\n").decode().upper()


class PackedReader(PieceReader):
    """A file of codes, and beside it `index` with lines `>name first last` (letters from 0)."""

    def contigs_of(self) -> list[Contig]:
        out: list[Contig] = []
        with opened(self.index or f"{self.path.rpartition('/')[0]}/index") as f:
            for line in f:
                name, first, last = line.decode().split()[:3]
                length = int(last) - int(first) + 1
                out.append(Contig(name.removeprefix(">"), length, out[-1].offset + out[-1].length if out else 0))
        return out

    def letters(self, contig: Contig, a: int, b: int) -> str:
        first, last = contig.offset + a, contig.offset + b
        with opened(self.path) as f:
            f.seek(first // 3)
            data = f.read((last + 2) // 3 - first // 3)
        table = packed_codes()
        return "".join(table[x] for x in data)[first % 3 : first % 3 + b - a]


def packed_codes() -> list[str]:
    """What each byte stands for: all triples of letters, then pairs and single ones (a file's end)."""
    return ["".join(x) for n in (3, 2, 1) for x in itertools.product(PACKED_LETTERS, repeat=n)]


def packed(text: str) -> bytes:
    """Letters as codes, three a byte."""
    number = {t: i for i, t in enumerate(packed_codes())}
    return bytes(number[text[i : i + 3]] for i in range(0, len(text), 3))


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:  # noqa: ANN001
        return FastaReader(self.options)


class PackedGenomeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_genome"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackedReader:  # noqa: ANN001
        return PackedReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def stretches(path: str, start: int, end: int) -> Iterator[tuple[int, str | None, int, int, int]]:
    """Of the lines that begin in [start, end): where each record's letters begin (or go on), its name (none if it began
    before), how many letters there are, and letters and bytes of the longest line."""
    with opened(path) as f:
        if start:
            f.seek(start - 1)
            f.readline()
        now: list | None = None
        while (at := f.tell()) < end and (line := f.readline()):
            if line.startswith(b">"):
                if now:
                    yield tuple(now)
                now = [f.tell(), line[1:].split()[0].decode() if line[1:].split() else "", 0, 0, 0]
                continue
            now = now or [at, None, 0, 0, 0]
            letters = len(line.rstrip(b"\r\n"))
            now[2] += letters
            if letters > now[3]:
                now[3:] = letters, len(line)
        if now:
            yield tuple(now)


class _ScanReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        return [_Range(p, a, min(a + self.split, size)) for p, size in listed(self.path, "") for a in range(0, size, self.split)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from stretches(partition.path, partition.start, partition.end)


class FastaScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_scan"

    def schema(self) -> str:
        return "place long, name string, letters long, line_letters int, line_bytes int"

    def reader(self, schema) -> _ScanReader:  # noqa: ANN001
        return _ScanReader(self.options)


def index_fasta(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """name, length, offset, line_letters and line_bytes of each record of a file, in its order: the lines of a .fai.

    Byte ranges are scanned on their own; the window that puts them together has a row for each record and range.
    """
    spark.dataSource.register(FastaScan)
    rows = spark.read.format("fasta_scan").option("splitBytes", split_bytes).load(path)
    begun = F.max(F.when(F.col("name").isNotNull(), F.col("place"))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("offset", begun).filter("offset IS NOT NULL")
    longest = F.max(F.struct("line_letters", "line_bytes"))
    out = rows.groupBy("offset").agg(F.max("name").alias("name"), F.sum("letters").alias("length"), longest.alias("line"))
    return out.select("name", "length", "offset", "line.line_letters", "line.line_bytes").orderBy("offset")


def contig_pieces(spark: SparkSession, path: str, regions: str | None = None, packed_form: bool = False, **options: str) -> DataFrame:
    """chrom, start and sequence in pieces, of the regions or of everything."""
    source = PackedGenomeSource if packed_form else FastaSource
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(**options)
    return (reader.option("regions", regions) if regions else reader).load(path)
