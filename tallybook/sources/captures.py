"""Packet captures as a data source whose partitions are stretches of a file.

The classic format has no marks between records, so a stretch looks for the first place from which a chain of CHAIN
plausible record headers follows (or the file's end), reads up to the first record that begins in the next stretch, and
holds that place against what the next stretch will find: if they differ the read fails, so no packet is lost or read
twice. Compressed captures are one partition, read as a stream. Files are opened through Arrow's file systems (local,
hdfs, s3, gs), so that a stretch costs its own bytes only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallybook.sources.files import capture_magic, ipv4_pair
from tallybook.sources.schemas import PACKET

#: Bytes of a stretch and of a read; record headers that have to follow each other; bytes of a record at most, where the file's own limit is larger or none.
SPLIT, READ, CHAIN, MOST = 128 << 20, 1 << 20, 6, 1 << 18
HEADER, RECORD = 24, 16
ROWS = 50_000
ARROW = pa.schema([("src_ip", pa.int64()), ("dst_ip", pa.int64()), ("length", pa.int64()), ("file", pa.string()), ("problem", pa.string())])


class Window:
    """Bytes of a file by place, read a piece at a time; what lies before the last place asked for is let go."""

    def __init__(self, stream, at: int, piece: int = READ):
        self.stream, self.piece, self.start, self.held, self.over = stream, piece, at, bytearray(), False

    def bytes_at(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the file's end."""
        while not self.over and at + n > self.start + len(self.held):
            more = self.stream.read(self.piece)
            self.over = not more
            self.held += more
        return bytes(self.held[at - self.start: at - self.start + n])

    def forget(self, before: int) -> None:
        if before - self.start >= self.piece:
            del self.held[: before - self.start]
            self.start = before


def opened(head: bytes) -> tuple[str, int, int, int]:
    """(byte order, link, most bytes a record, parts of a second) of a capture's header."""
    order, parts = capture_magic(head)
    limit, link = struct.unpack(order + "II", head[16:24])
    return order, link & 0xFFFF, min(limit, MOST) if limit else MOST, parts


def boundary(window: Window, at: int, size: int, order: str, most: int, parts: int) -> int:
    """The first place from `at` on where a chain of plausible headers begins; the file's size if there is none."""
    unpack = struct.Struct(order + "IIII").unpack
    while at < size:
        place, links, first = at, 0, 0
        while links < CHAIN and place < size:
            head = window.bytes_at(place, RECORD)
            if len(head) < RECORD:
                break
            second, part, kept, whole = unpack(head)
            # a chain's records are of one time, and hold no more than there was
            if part >= parts or not 0 < kept <= most or not kept <= whole <= MOST or links and abs(second - first) > 86_400:
                break
            first = second
            place, links = place + RECORD + kept, links + 1
        # or a shorter one that ends with the file, with a header that breaks off there, or (two at least) with such a record
        if links == CHAIN or links and size - RECORD < place <= size or links > 1 and place > size:
            return at
        at += 1
        window.forget(at)
    return size


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.captured_length = options["path"], int(options.get("split", SPLIT)), str(options.get("capturedLength", "false")).lower() == "true"

    def partitions(self) -> list[Stretch]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith((".pcap", ".pcap.gz"))), key=lambda f: f.path):
            step = f.size if f.path.endswith(".gz") else self.split
            out += [Stretch(f.path, at, min(at + step, f.size), f.size) for at in range(0, max(1, f.size), max(1, step))]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        problem = None
        try:
            with system.open_input_file(partition.path) as stream:
                for packet in self._gzipped(stream) if partition.path.endswith(".gz") else self._stretch(stream, partition):
                    rows.append((*packet, partition.path, None))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
        except Broken as e:
            problem = str(e)
        if problem:
            rows.append((None, None, None, partition.path, problem))
        yield _batch(rows)

    def _stretch(self, stream, p: Stretch) -> Iterator[tuple[int, int, int]]:
        try:
            order, link, most, parts = _header(stream.read(HEADER))
        except Broken:
            if p.start:  # said once, by the file's first stretch
                return
            raise
        at = HEADER
        stream.seek(at if p.start == 0 else p.start)
        window = Window(stream, HEADER if p.start == 0 else p.start)
        if p.start:
            at = boundary(window, p.start, p.size, order, most, parts)
        at = yield from self._records(window, at, max(p.end, HEADER), p.size, order, link)
        if at < p.size and p.end < p.size:
            stream.seek(p.end)
            found = boundary(Window(stream, p.end), p.end, p.size, order, most, parts)
            if found != at:
                raise ValueError(f"{p.path}: the record at {at} can't be told from others beyond {p.end}; read it with a larger split")

    def _records(self, window: Window, at: int, end: int, size: int | None, order: str, link: int):
        unpack = struct.Struct(order + "IIII").unpack
        while at < end:
            head = window.bytes_at(at, RECORD)
            if not head:
                break
            if len(head) < RECORD:
                raise Broken("truncated packet header")
            _, _, kept, whole = unpack(head)
            pair = ipv4_pair(link, window.bytes_at(at + RECORD, kept))
            at += RECORD + kept
            window.forget(at)
            if pair:
                yield *pair, kept if self.captured_length else whole
        return at

    def _gzipped(self, stream) -> Iterator[tuple[int, int, int]]:
        window = Window(Inflated(stream), 0)
        order, link, _, _ = _header(window.bytes_at(0, HEADER))
        yield from self._records(window, HEADER, 1 << 62, None, order, link)


class Broken(ValueError):
    """A file that isn't a capture, or breaks off."""


class Inflated:
    """A gzip stream's bytes, a piece at a time, member after member."""

    def __init__(self, stream):
        self.stream, self.inflate, self.rest = stream, zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            piece = self.rest or self.stream.read(n)
            if not piece:
                return b""
            try:
                out = self.inflate.decompress(piece, n)
            except zlib.error as e:
                raise Broken(str(e)) from e
            self.rest = self.inflate.unconsumed_tail
            if out:
                return out


def _header(head: bytes) -> tuple[str, int, int, int]:
    try:
        return opened(head)
    except (ValueError, struct.error) as e:
        raise Broken("not a capture file") from e


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


class CaptureSource(DataSource):
    """spark.read.format("capture").option("split", bytes).load(folder): (src_ip, dst_ip, length, file, problem) of IPv4 packets."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKET

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def split_captures(spark: SparkSession, folder: str, split: int = SPLIT, captured_length: bool = False) -> DataFrame:
    """(src_ip, dst_ip, length, file, problem) of captures of any size, a task for each stretch of `split` bytes; a bad file is one row with its problem."""
    spark.dataSource.register(CaptureSource)
    where = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return spark.read.format("capture").option("split", split).option("capturedLength", captured_length).load(where)


def write_captures(packets: DataFrame, folder: str) -> None:
    """Writes packets(file, second, src_ip, dst_ip, length) as raw-IP captures, a file for each value of `file`, its packets by second and addresses; executors write to `folder`, which has to be shared."""
    where = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65_535, 101)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(where)
        system.create_dir(root, recursive=True)
        name, out, done = None, None, []
        for batch in batches:
            for file, second, src, dst, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if out:
                        out.close()
                    name, out = file, system.open_output_stream(f"{root}/{file}.pcap")
                    out.write(head)
                    done.append(file)
                frame = b"\x45" + bytes(11) + struct.pack(">II", src, dst)
                out.write(struct.pack("<IIII", second, 0, len(frame), max(length, len(frame))) + frame)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])
            done = []
        if out:
            out.close()

    dealt = packets.select(F.col("file").cast("string"), *(F.col(c).cast("long") for c in ("second", "src_ip", "dst_ip", "length"))).repartition("file").sortWithinPartitions("file", "second", "src_ip", "dst_ip", "length")
    dealt.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
