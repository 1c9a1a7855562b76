"""Recordings as a Spark data source: lengths from headers, samples by byte ranges.

``register(spark)`` makes the formats ``wav_headers`` and ``wav_blocks`` known; both take ``path``, a file or a
folder (searched downwards) that all executors see, as a path or as an URI that Arrow's file systems know.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Format numbers of plain samples, and of the longer header that may describe them.
PLAIN, EXTENDED = 1, 0xFFFE
#: Largest value of a sample of that many bytes, by which it is divided.
FULL_SCALE = {2: 32768.0, 4: 2147483648.0}
FILES_PER_TASK, BLOCK_BYTES, BLOCKS_PER_TASK = 512, 1 << 20, 32


@dataclass
class Header:
    samplerate: int
    channels: int
    width: int
    start: int
    frames: int


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Span(InputPartition):
    path: str
    first: int
    last: int


def read_header(file: pa.NativeFile) -> Header:
    """Walks the chunks of a file up to its samples; a ValueError says what is wrong with it.

    A data chunk whose stated size is longer than the file (a recording that was cut off, or streamed) ends with the file.
    """
    size = file.size()
    if file.read(12)[:4] + file.read_at(12, 0)[8:] != b"RIFFWAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            form = file.read_at(min(length, 40), at + 8)
            if len(form) < 16:
                raise ValueError("short format chunk")
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            if tag == EXTENDED and len(form) >= 26:
                tag = struct.unpack("<H", form[24:26])[0]
            if tag != PLAIN or bits // 8 not in FULL_SCALE or bits % 8 or not channels or not rate:
                raise ValueError(f"format {tag} with {bits} bits isn't read")
            width = channels * bits // 8
            return Header(rate, channels, bits // 8, at + 8, min(length, size - at - 8) // width)
        at += 8 + length + length % 2
    raise ValueError("no samples")


def _opened(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


class _Waves(DataSource):
    def listed(self) -> list[tuple[str, int]]:
        """URIs and sizes of the files; only names and sizes come to the driver."""
        path = self.options.get("path")
        if not path:
            raise ValueError("path is missing")
        where, name = fs.FileSystem.from_uri(path)
        found = where.get_file_info(name)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [found] if found.is_file else where.get_file_info(fs.FileSelector(name, recursive=True))
        prefix = path[: path.index(name)] if name in path else ""
        return sorted((prefix + f.path, f.size) for f in files if f.is_file and f.path.lower().endswith(".wav"))


class WavHeaders(_Waves):
    """One row per file; a file that can't be read has its problem instead of figures."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return "path string, samplerate int, channels int, frames long, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.listed())


class _HeaderReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]]):
        self.paths = [p for p, _ in files]

    def partitions(self) -> list[InputPartition]:
        return [Files(self.paths[i : i + FILES_PER_TASK]) for i in range(0, len(self.paths), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with _opened(path) as file:
                    h = read_header(file)
                yield path, h.samplerate, h.channels, h.frames, None
            except ValueError as problem:
                yield path, None, None, None, str(problem)


class WavBlocks(_Waves):
    """Samples in blocks: path, first (place of the block's first sample), samples (mean of the channels, from -1 to 1).

    Option ``block_bytes``: bytes of a block, ``blocks_per_task``: blocks of one file that a task reads. Tasks are
    made from sizes alone; each reads the header of its file and then only its own range. Files that
    can't be read give no blocks; ``wav_headers`` tells which and why.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return "path string, first long, samples array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.listed(), int(self.options.get("block_bytes", BLOCK_BYTES)), int(self.options.get("blocks_per_task", BLOCKS_PER_TASK)))


class _BlockReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], block: int, per_task: int):
        if block < 1 or per_task < 1:
            raise ValueError("block_bytes and blocks_per_task are at least 1")
        self.files, self.block, self.per_task = files, block, per_task

    def partitions(self) -> list[InputPartition]:
        """Spans of blocks; blocks are counted from the first sample, so a file has at most as many as its size says."""
        spans = []
        for path, size in self.files:
            blocks = -(-size // self.block)
            spans += [Span(path, i, min(i + self.per_task, blocks)) for i in range(0, blocks, self.per_task)]
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.first == partition.last:
            return
        with _opened(partition.path) as file:
            try:
                h = read_header(file)
            except ValueError:
                return
            # whole frames in a block; a frame wider than a block (never with sane settings) makes one of its own
            width = h.channels * h.width
            step = max(1, self.block // width)
            last = partition.last if partition.last * self.block < file.size() else -(-h.frames // step)
            for at in range(partition.first * step, min(last * step, h.frames), step):
                raw = file.read_at(min(step, h.frames - at) * width, h.start + at * width)
                x = np.frombuffer(raw, f"<i{h.width}").reshape(-1, h.channels) / FULL_SCALE[h.width]
                yield partition.path, at, x.mean(axis=1).tolist()


def register(spark: SparkSession) -> None:
    """Make both formats known to the session and the package known to its workers."""
    from lexspan.session import ship_package

    ship_package(spark)
    spark.dataSource.register(WavHeaders)
    spark.dataSource.register(WavBlocks)


def recording_lengths(headers: DataFrame, recordings: DataFrame) -> DataFrame:
    """(rec, frames, samplerate) as ``fill_open_ends`` takes them, for recordings (rec, path); unread files have NULLs."""
    return recordings.select("rec", "path").join(headers, "path", "left").select("rec", "frames", "samplerate")


def signal(blocks: DataFrame) -> DataFrame:
    """(rec, pos, x), one row per sample, as ``frame_energy`` takes them; rec is the path."""
    return blocks.select(F.col("path").alias("rec"), "first", F.posexplode("samples").alias("i", "x")).select("rec", (F.col("first") + F.col("i")).alias("pos"), "x")
