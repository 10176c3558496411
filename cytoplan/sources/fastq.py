"""FASTQ as a Spark data source: `spark.dataSource.register(FastqSource)`, then `spark.read.format("fastq").load(path)`.

A plain file is planned in byte ranges.  A quality line may begin with `@` too, so a record's first line is told by what
follows: the third line begins with `+`, and the second and fourth are equally long.  A gzip file is one range.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cytoplan.operators.ordering import numbered

from .files import listed, opened


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


def records(path: str, start: int, end: int | None) -> Iterator[tuple[str, str, str, int]]:
    """id, sequence, quality and the byte at which the record begins, of the records that begin in [start, end)."""
    with gzip.open(opened(path), "rb") if path.endswith(".gz") else opened(path) as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the rest of the line before; nothing but its end if a line begins at `start`
        held: list[tuple[int, bytes]] = []

        def fill(n: int) -> bool:
            while len(held) < n:
                at, line = f.tell(), f.readline()
                if not line:
                    return False
                held.append((at, line.rstrip(b"\r\n")))
            return True

        while fill(4):
            (at, name), (_, seq), (_, plus), (_, qual) = held[:4]
            if end is not None and at >= end:
                return
            if name.startswith(b"@") and plus.startswith(b"+") and len(seq) == len(qual):
                yield name[1:].decode(), seq.decode(), qual.decode(), at
                del held[:4]
            else:
                del held[0]


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in listed(self.path, ""):
            out += [_Range(path, 0, None)] if path.endswith(".gz") else [_Range(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from records(partition.path, partition.start, partition.end)


class FastqSource(DataSource):
    """Options: splitBytes, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "id string, sequence string, quality string, place long"

    def reader(self, schema) -> FastqReader:  # noqa: ANN001
        return FastqReader(self.options)


def with_ordinals(reads: DataFrame) -> DataFrame:
    """The reads of one file with `ordinal`, their number in it from 0: what two files of pairs are joined by."""
    return numbered(reads, [], "place", "ordinal", 1 << 24)


def at_positions(reads: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The reads of one file at the given ordinals."""
    return with_ordinals(reads).join(ordinals.select("ordinal").distinct(), "ordinal", "left_semi")
