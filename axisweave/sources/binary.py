"""Readers of binary indexed formats: bigWig and bigBed by their index, BAM as a stream of blocks."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: magic numbers of the formats and the fields of an alignment record
BIGWIG, BIGBED, CHROM_TREE, BLOCK_TREE = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
BASES, CIGAR_CODES = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_KINDS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
#: Data blocks of a bigWig or bigBed file that a task reads, and rows of an Arrow batch of alignments.
TASK_BLOCKS, BATCH = 512, 4096


def _open(path: str) -> pa.NativeFile:
    """A file that can be read at any place, on whatever store pyarrow knows."""
    import os

    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return store.open_input_file(name)


class BlockFile:
    """Header, chromosomes (name to number and length) and index of a bigWig or bigBed file."""

    def __init__(self, f: pa.NativeFile):
        self.f = f
        head = f.read_at(64, 0)
        self.order = next((o for o in "<>" if struct.unpack(f"{o}I", head[:4])[0] in (BIGWIG, BIGBED)), None)
        if self.order is None:
            raise ValueError("neither a bigWig nor a bigBed file")
        self.magic, _, _, tree, _, self.index, self.fields, self.defined, self.auto_sql, _, self.unpacked = struct.unpack(f"{self.order}IHHQQQHHQQI", head[:56])
        self.chroms = dict(self._chroms(tree))

    def _get(self, form: str, at: int) -> tuple:
        form = self.order + form
        return struct.unpack(form, self.f.read_at(struct.calcsize(form), at))

    def _chroms(self, at: int) -> Iterator[tuple[str, tuple[int, int]]]:
        magic, _, key, _ = self._get("IIII", at)
        if magic != CHROM_TREE:
            raise ValueError("damaged list of chromosomes")
        nodes = [at + 32]
        while nodes:
            here = nodes.pop()
            leaf, _, count = self._get("BBH", here)
            for k in range(count):
                name, *value = self._get(f"{key}s" + ("II" if leaf else "Q"), here + 4 + k * (key + 8))
                if leaf:
                    yield name.rstrip(b"\0").decode(), tuple(value)
                else:
                    nodes.append(value[0])

    def blocks(self, chrom: int | None = None, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
        """Place and size of the data blocks that may hold something of a range; only the nodes of the index that meet it are read."""
        if self._get("I", self.index)[0] != BLOCK_TREE:
            raise ValueError("damaged index")
        nodes = [self.index + 48]
        while nodes:
            here = nodes.pop()
            leaf, _, count = self._get("BBH", here)
            for k in range(count):
                c0, s0, c1, e1, *value = self._get("IIII" + ("QQ" if leaf else "Q"), here + 4 + k * (32 if leaf else 24))
                if chrom is None or ((c0, s0) < (chrom, end if end is not None else 1 << 32) and (c1, e1) > (chrom, start)):
                    if leaf:
                        yield tuple(value)
                    else:
                        nodes.append(value[0])

    def block(self, at: int, size: int) -> bytes:
        raw = self.f.read_at(size, at)
        return zlib.decompress(raw) if self.unpacked else raw

    def column_names(self) -> list[str]:
        """Fields of a bigBed file by its own declaration, or of BED."""
        from axisweave.sources.formats import FIELDS

        names = []
        if self.auto_sql:
            text = self.f.read_at(1 << 16, self.auto_sql).partition(b"\0")[0].decode()
            names = [line.strip().split(";")[0].split()[-1] for line in text.splitlines() if ";" in line]
        return ["chrom", "start", "end", *(names[3:] or FIELDS["bed12"][3 : max(3, self.fields)])]


def _wiggle(order: str, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome numbers, starts, ends and values of a bigWig block."""
    number, start, _, step, span, kind, _, n = struct.unpack(f"{order}IIIIIBBH", raw[:24])
    at = {1: [("s", "u4"), ("e", "u4"), ("v", "f4")], 2: [("s", "u4"), ("v", "f4")], 3: [("v", "f4")]}[kind]
    x = np.frombuffer(raw, np.dtype([(k, order + t) for k, t in at]), n, 24)
    s = x["s"].astype(np.int64) if kind < 3 else start + step * np.arange(n, dtype=np.int64)
    e = x["e"].astype(np.int64) if kind == 1 else s + span
    return np.full(n, number), s, e, x["v"].astype(np.float64)


def _entries(order: str, raw: bytes) -> Iterator[tuple[int, int, int, list[str]]]:
    """Chromosome number, start, end and other fields of a bigBed block's rows."""
    at = 0
    while at < len(raw):
        number, s, e = struct.unpack_from(f"{order}III", raw, at)
        to = raw.index(b"\0", at + 12)
        rest = raw[at + 12 : to].decode()
        yield number, s, e, rest.split("\t") if rest else []
        at = to + 1


def _read_blocks(spark: SparkSession, path: str, magic: int, chrom: str | None, start: int | None, end: int | None) -> DataFrame:
    f = BlockFile(_open(path))
    if f.magic != magic:
        raise ValueError(f"{path} is a file of the other kind")
    if chrom is not None and chrom not in f.chroms:
        raise ValueError(f"no chromosome {chrom}")
    places = list(f.blocks(f.chroms[chrom][0] if chrom is not None else None, start or 0, end))
    wig = magic == BIGWIG
    names = ["chrom", "start", "end", "value"] if wig else f.column_names()
    kinds = ["string", "long", "long"] + ["double" if wig else "string"] * (len(names) - 3)
    of = {number: name for name, (number, _) in f.chroms.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = BlockFile(_open(path))
        for batch in batches:
            for at, size in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                raw = g.block(at, size)
                if wig:
                    n, s, e, *rest = _wiggle(g.order, raw)
                    cols = [pa.array([of[int(n[0])]] * len(n), pa.string()) if len(n) else pa.array([], pa.string()), pa.array(s), pa.array(e), *map(pa.array, rest)]
                else:
                    rows = list(_entries(g.order, raw))
                    cols = [pa.array([of[r[0]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                    cols += [pa.array([r[3][k] if k < len(r[3]) else None for r in rows], pa.string()) for k in range(len(names) - 3)]
                yield pa.RecordBatch.from_arrays(cols, names)

    todo = spark.createDataFrame(places, "at long, size long").repartition(max(1, -(-len(places) // TASK_BLOCKS)))
    df = todo.mapInArrow(read, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    if chrom is not None:
        df = df.where(F.col("chrom") == chrom)
        df = df.where(F.col("end") > start) if start is not None else df
        df = df.where(F.col("start") < end) if end is not None else df
    return df


def read_bigwig(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """chrom, start, end, value of a bigWig file or of a range of it. The driver reads the index, tasks read the blocks that the range meets; the path must be readable everywhere."""
    return _read_blocks(spark, path, BIGWIG, chrom, start, end)


def read_bigbed(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """chrom, start, end and the other fields (as strings, named as the file says) of a bigBed file or of a range of it."""
    return _read_blocks(spark, path, BIGBED, chrom, start, end)


def _inflated(f: pa.NativeFile) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one after another, in pieces."""
    z, more = zlib.decompressobj(31), b""
    while more := more or f.read(1 << 20):
        yield z.decompress(more)
        more = z.unused_data
        if z.eof:
            z = zlib.decompressobj(31)


def _bins(start: int, end: int) -> Iterator[int]:
    """Numbers of the index's bins, of six sizes from 2**29 down to 2**14, that a range meets."""
    first = 0
    for level, shift in enumerate(range(29, 13, -3)):
        yield from range(first + (start >> shift), first + ((max(end, start + 1) - 1) >> shift) + 1)
        first += 1 << 3 * level


def indexed_places(index: pa.NativeFile, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of a block-gzipped file (from and to, as virtual offsets) that may hold rows of a range, by its index."""
    s = _Stream(_inflated(index))
    if s.take(4) != b"TBI\1":
        raise ValueError("not an index of a block-gzipped table")
    refs, *_, size = struct.unpack("<8i", s.take(32))
    names = s.take(size).rstrip(b"\0").split(b"\0")
    wanted, out = set(_bins(start, end)), []
    for k in range(refs):
        own = k < len(names) and names[k].decode() == chrom
        for _ in range(struct.unpack("<i", s.take(4))[0]):
            number, chunks = struct.unpack("<Ii", s.take(8))
            raw = s.take(16 * chunks)
            if own and number in wanted:
                out += struct.iter_unpack("<QQ", raw)
        (n,) = struct.unpack("<i", s.take(4))
        linear = struct.unpack(f"<{n}Q", s.take(8 * n))
        if own:  # nothing of the range lies before the place of its first window
            least = linear[min(start >> 14, n - 1)] if n else 0
            return sorted((a, b) for a, b in out if b > least)
    return []


def _lines(f: pa.NativeFile, begin: int, to: int) -> Iterator[str]:
    """Lines of a block-gzipped file between two virtual offsets (block and place in it)."""
    at, skip, held = begin >> 16, begin & 0xFFFF, b""
    while at < to >> 16 or (at == to >> 16 and to & 0xFFFF):
        z, raw, used = zlib.decompressobj(31), b"", 0
        while not z.eof:
            piece = f.read_at(1 << 16, at + used)
            if not piece:
                break
            raw += z.decompress(piece)
            used += len(piece) - len(z.unused_data)
        raw = raw[: to & 0xFFFF] if at == to >> 16 else raw
        held += raw[skip:]
        *whole, held = held.split(b"\n")
        yield from (x.decode() for x in whole)
        at, skip = at + max(used, 1), 0
        if not raw:
            break
    if held:
        yield held.decode()


def read_indexed_lines(spark: SparkSession, path: str, index: str, chrom: str, start: int, end: int) -> DataFrame:
    """value: the lines of a block-gzipped file's blocks that may hold rows of a range. Only these blocks are read, a stretch of them a task."""
    places = indexed_places(_open(index), chrom, start, end)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                yield pa.RecordBatch.from_arrays([pa.array(list(_lines(_open(path), a, b)), pa.string())], ["value"])

    return spark.createDataFrame(places, "a long, b long").repartition(max(1, len(places))).mapInArrow(read, "value string")


class _Stream:
    """Bytes on demand from an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            piece = next(self.pieces, None)
            if piece is None:
                break
            self.held, self.at = self.held[self.at :] + piece, 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in "ZH":
            to = raw.index(b"\0", at)
            out[name], at = raw[at:to].decode(), to + 1
        elif kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind == "B":
            form, (n,) = TAG_KINDS[chr(raw[at])], struct.unpack_from("<I", raw, at + 1)
            size = struct.calcsize(form)
            values = struct.unpack_from(f"<{n}{form[1]}", raw, at + 5)
            out[name], at = ",".join([chr(raw[at]), *(f"{v:g}" if isinstance(v, float) else str(v) for v in values)]), at + 5 + n * size
        else:
            form = TAG_KINDS[kind]
            (v,) = struct.unpack_from(form, raw, at)
            out[name], at = (f"{v:g}" if isinstance(v, float) else str(v)), at + struct.calcsize(form)
    return out


def bam_records(f: pa.NativeFile) -> Iterator[tuple]:
    """The twelve fields of each alignment: positions from 0 (-1: none), CIGAR null where MAPQ is 0, tags as a JSON object."""
    s = _Stream(_inflated(f))
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0]).rstrip(b"\0").decode())
        s.take(4)
    name_of = lambda k: names[k] if k >= 0 else "*"
    while len(size := s.take(4)) == 4:
        raw = s.take(struct.unpack("<i", size)[0])
        ref, pos, name_n, mapq, _, ops, flag, n, next_ref, next_pos, length = struct.unpack_from("<iiBBHHHiiii", raw)
        at = 32 + name_n
        cigar = "".join(f"{x >> 4}{CIGAR_CODES[x & 15]}" for x in struct.unpack_from(f"<{ops}I", raw, at)) or "*"
        at += 4 * ops
        packed = np.frombuffer(raw, np.uint8, (n + 1) // 2, at)
        seq = "".join(BASES[b] for b in np.stack([packed >> 4, packed & 15], 1).reshape(-1)[:n]) or "*"
        at += len(packed)
        qual = np.frombuffer(raw, np.uint8, n, at)
        text = "*" if not n or qual[0] == 255 else (qual + 33).tobytes().decode()
        nxt = "=" if next_ref >= 0 and next_ref == ref else name_of(next_ref)
        yield raw[32 : 31 + name_n].decode(), flag, name_of(ref), pos, mapq, cigar if mapq else None, nxt, next_pos, length, seq, text, json.dumps(_tags(raw[at + n :]), separators=(",", ":"))


_BAM = "QNAME string, FLAG int, RNAME string, POS long, MAPQ int, CIGAR string, RNEXT string, PNEXT long, TLEN long, SEQ string, QUAL string, TAGs string"


def read_bam_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments of one or more BAM files, a task a file: blocks are inflated one after another and never held together."""
    names = [x.split()[0] for x in _BAM.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in _BAM.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for r in bam_records(_open(path)):
                    rows.append(r)
                    if len(rows) == BATCH:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    paths = [paths] if isinstance(paths, str) else paths
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInArrow(read, _BAM)
