"""BAM as a Spark data source: `spark.dataSource.register(BamSource)`, then `spark.read.format("bam").load(path)`.

A file is planned in ranges of compressed blocks.  A range begins at the first block boundary behind its offset and at
the first record that begins in it; both are found by checking the headers there, so a large file is read by many tasks.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import listed, located, opened

SCHEMA = "qname string, flag int, tid int, pos int, mapq int, cigar string, mtid int, mpos int, isize int, seq string, qual string, tags map<string,string>, n_tags int, tag_types map<string,string>"
# Fixed values of the format.
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def block_at(data: bytes, at: int) -> int:
    """Length of the compressed block at a place, 0 if none begins there."""
    if len(data) < at + 18 or data[at : at + 4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    k, end = at + 12, at + 12 + extra
    while k + 4 <= min(end, len(data)):
        size = struct.unpack_from("<H", data, k + 2)[0]
        if data[k : k + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + size
    return 0


def blocks(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Place and content of the blocks that begin in [start, end)."""
    with opened(path) as f:
        f.seek(start)
        data, at = f.read(1 << 17), 0
        while at < len(data) and not (block_at(data, at) and (start == 0 or _followed(data, at))):
            at += 1
        place = start + at
        f.seek(place)
        while end is None or place < end:
            head = f.read(18)
            if len(head) < 18:
                return
            size = block_at(head, 0) or _length_of(f, place)
            f.seek(place)
            raw = f.read(size)
            yield place, zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)
            place += size


def _length_of(f, place: int) -> int:
    f.seek(place)
    return block_at(f.read(1 << 16), 0)


def _followed(data: bytes, at: int) -> bool:
    """The next block begins where this one says that it ends."""
    after = at + block_at(data, at)
    return after >= len(data) or bool(block_at(data, after)) or after + 18 > len(data)


def header(path: str) -> tuple[list[tuple[str, int]], int]:
    """Names and lengths of the contigs, and the bytes of the header."""
    data = b""
    source = blocks(path, 0, None)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            data += next(source)[1]

    need(12)
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    n, at, contigs = struct.unpack_from("<i", data, at)[0], at + 4, []
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + size)
        contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    return contigs, at


def tags_of(data: bytes) -> tuple[dict[str, str], dict[str, str], int]:
    """Values and types (whole numbers of any width are i) by name, and how many tags there are; of repeats the last counts."""
    out, kinds, count, k = {}, {}, 0, 0
    while k + 3 <= len(data):
        name, kind = data[k : k + 2].decode(), chr(data[k + 2])
        k += 3
        if kind == "A":
            value, k = chr(data[k]), k + 1
        elif kind in _NUMBERS:
            value = str(struct.unpack_from(_NUMBERS[kind], data, k)[0])
            k += struct.calcsize(_NUMBERS[kind])
            kind = "f" if kind == "f" else "i"
        elif kind in "ZH":
            end = data.index(b"\0", k)
            value, k = data[k:end].decode(), end + 1
        elif kind == "B":
            inner, n = chr(data[k]), struct.unpack_from("<i", data, k + 1)[0]
            code = _NUMBERS[inner]
            size = struct.calcsize(code)
            value = ",".join([inner, *(str(struct.unpack_from(code, data, k + 5 + i * size)[0]) for i in range(n))])
            k += 5 + n * size
        else:
            break
        out[name], kinds[name] = value, kind
        count += 1
    return out, kinds, count


def tag_bytes(name: str, kind: str, value: str) -> bytes:
    """A tag as it stands in a record; whole numbers take as few bytes as they can."""
    head = name.encode()
    if kind == "i":
        number = int(value)
        code = next(c for c in "cCsSiI" if _fits(c, number))
        return head + code.encode() + struct.pack(_NUMBERS[code], number)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return head + b"A" + value[:1].encode()
    if kind == "B":
        inner, *numbers = value.split(",")
        cast = float if inner == "f" else int
        return head + b"B" + inner.encode() + struct.pack("<i", len(numbers)) + b"".join(struct.pack(_NUMBERS[inner], cast(x)) for x in numbers)
    return head + (kind if kind == "H" else "Z").encode() + value.encode() + b"\0"


def _fits(code: str, number: int) -> bool:
    bits = 8 * struct.calcsize(_NUMBERS[code])
    return 0 <= number < 1 << bits if code.isupper() else -(1 << (bits - 1)) <= number < 1 << (bits - 1)


def _bin(start: int, end: int) -> int:
    """The smallest bin of the index that holds [start, end): eight times finer on each of five levels, from 512 M to 16 K."""
    first, last = max(start, 0), max(start, end - 1, 0)
    for level in range(5, 0, -1):
        shift = 14 + 3 * (5 - level)
        if first >> shift == last >> shift:
            return ((1 << 3 * level) - 1) // 7 + (first >> shift)
    return 0


def record_bytes(row) -> bytes:  # noqa: ANN001
    """A row of this source as a record, with its length in front."""
    cigar = [] if row.cigar in (None, "", "*") else [(int(n), _OPS.index(op)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row.cigar)]
    seq = "" if row.seq in (None, "*") else row.seq
    name = (row.qname or "*").encode() + b"\0"
    reach = sum(n for n, op in cigar if op in (0, 2, 3, 7, 8))
    codes = [_BASES.find(c) if c in _BASES else 15 for c in seq.upper()]
    codes += [0] * (len(codes) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    qual = bytes(ord(c) - 33 for c in row.qual) if row.qual and len(row.qual) == len(seq) else b"\xff" * len(seq)
    kinds = row.tag_types or {}
    tags = b"".join(tag_bytes(k, kinds.get(k, "Z"), v) for k, v in (row.tags or {}).items())
    fixed = struct.pack("<iiBBHHHiiii", row.tid, row.pos, len(name), row.mapq, _bin(row.pos, row.pos + max(reach, 1)), len(cigar), row.flag, len(seq), row.mtid, row.mpos, row.isize)
    body = fixed + name + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def header_bytes(contigs: list[tuple[str, int]], text: str | None = None) -> bytes:
    """The header of a file over these contigs (name and length in the order of their tid)."""
    lines = (text if text is not None else "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{x}\n" for n, x in contigs)).encode()
    out = b"BAM\1" + struct.pack("<i", len(lines)) + lines + struct.pack("<i", len(contigs))
    for name, length in contigs:
        raw = name.encode() + b"\0"
        out += struct.pack("<i", len(raw)) + raw + struct.pack("<i", length)
    return out


#: Bytes of content in a compressed block.
BLOCK = 65280


def compressed(data: bytes) -> bytes:
    """One block."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(data: bytes) -> tuple:
    """One alignment, without the length in front."""
    tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, isize = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + l_name
    qname = data[32 : at - 1].decode()
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
    at += len(packed)
    qual = "".join(chr(min(q, 93) + 33) for q in data[at : at + l_seq])
    tags, kinds, n = tags_of(data[at + l_seq :])
    return (qname, flag, tid, pos, mapq, cigar, mtid, mpos, isize, seq, qual, tags, n, kinds)


def _plausible(data: bytes, at: int, contigs: int) -> bool:
    if at + 36 > len(data):
        return False
    size, tid, pos, l_name = struct.unpack_from("<iiiB", data, at)
    n_cigar, _, l_seq, mtid, mpos = struct.unpack_from("<HHiii", data, at + 16)
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (32 <= size and -1 <= tid < contigs and -1 <= mtid < contigs and pos >= -1 and mpos >= -1 and l_name >= 2 and l_seq >= 0 and least <= size):
        return False
    name = data[at + 36 : at + 36 + l_name]
    return len(name) < l_name or (name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]))


def _start(data: bytes, begin: int, end: int, contigs: int) -> int:
    """The first place in [begin, end) where a record may begin, -1 if there is none; all fixed fields must be known there."""
    end = min(end, len(data) - 35)
    if begin >= end:
        return -1
    field = lambda at: np.ndarray((end - begin,), dtype="<i4", buffer=data, offset=begin + at, strides=(1,))
    fits = field(0) >= 32
    for at in (4, 24):  # the contigs of the read and of its mate
        fits &= (field(at) >= -1) & (field(at) < contigs)
    for at in (8, 28, 20):  # both positions, and the number of letters
        fits &= field(at) >= (-1 if at != 20 else 0)
    return next((k for k in (np.flatnonzero(fits) + begin).tolist() if _plausible(data, k, contigs) and _chain(data, k, contigs)), -1)


def records(path: str, start: int, end: int, contigs: int, skip: int) -> Iterator[tuple]:
    """Alignments that begin in the blocks of [start, end).

    The first one is searched for, each byte once; a range that lies inside one long record ends with its last block.
    """
    data, at, inside, tried, own = bytearray(), skip if start == 0 else -1, True, 0, 0
    for place, block in blocks(path, start, None):
        if place >= end:
            if inside and at >= 0 and at >= len(data):
                return  # the last record ended with its block
            inside = False
        if at < 0:
            data += block
            own = len(data) if inside else own
            at = _start(bytes(data), tried, own, contigs)
            tried = max(tried, min(own, len(data) - 35))
            if at < 0 and not inside and tried >= own:
                return  # no record begins in this range
            if at < 0:
                continue
            limit = own
        else:
            limit = len(data) + len(block) if inside else len(data)
            data += block
        while at + 4 <= len(data) and at < limit:
            size = struct.unpack_from("<i", data, at)[0]
            if at + 4 + size > len(data):
                break
            yield record(bytes(data[at + 4 : at + 4 + size]))
            at += 4 + size
        if not inside and at >= limit:
            return
        del data[:at]
        at = 0


def _chain(data: bytes, at: int, contigs: int, depth: int = 3) -> bool:
    """Records follow from here, as far as the data goes."""
    for _ in range(depth):
        at += 4 + struct.unpack_from("<i", data, at)[0]
        if at + 36 > len(data):
            return True
        if not _plausible(data, at, contigs):
            return False
    return True


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        return [_Range(f, a, min(a + self.split, size)) for f, size in listed(self.path, ".bam") for a in range(0, size, self.split)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        contigs, size = header(partition.path)
        yield from records(partition.path, partition.start, partition.end, len(contigs), size)


class _Written(WriterCommitMessage):
    def __init__(self, held: str, name: str) -> None:
        self.held, self.name = held, name


class BamWriter(DataSourceWriter):
    """Each partition becomes a file of its own, which appears when the whole job is done."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.contigs = [(name, int(length)) for name, length in json.loads(options["contigs"])]
        self.text = options.get("header")
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        system, folder = located(self.path)
        held = f"{folder}/_temporary-{self.run}"
        system.create_dir(held, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"
        with system.open_output_stream(f"{held}/{name}") as f:
            data = header_bytes(self.contigs, self.text)
            for row in iterator:
                data += record_bytes(row)
                while len(data) >= BLOCK:
                    f.write(compressed(data[:BLOCK]))
                    data = data[BLOCK:]
            if data:
                f.write(compressed(data))
            f.write(compressed(b""))  # the empty block at the end
        return _Written(held, name)

    def commit(self, messages: list) -> None:
        system, folder = located(self.path)
        if self.overwrite:
            for old, _ in listed(self.path, ".bam"):
                system.delete_file(located(old)[1])
        for m in (m for m in messages if m):
            system.move(f"{m.held}/{m.name}", f"{folder}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, folder = located(self.path)
        held = f"{folder}/_temporary-{self.run}"
        if system.get_file_info(held).type.name == "Directory":
            system.delete_dir(held)


class BamSource(DataSource):
    """Options: splitBytes, the compressed bytes of a partition; for writing contigs, JSON of names and lengths in the
    order of tid, and header, the header's text if another one is wanted."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:  # noqa: ANN001
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:  # noqa: ANN001
        return BamWriter(self.options, overwrite)


def contigs_of(spark, path: str):  # noqa: ANN001, ANN201
    """tid, name and length from the header."""
    names, _ = header(path)
    return spark.createDataFrame([(i, n, length) for i, (n, length) in enumerate(names)], "tid int, name string, length long")
