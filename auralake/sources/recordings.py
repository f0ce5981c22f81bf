"""WAV recordings as a data source: read by byte ranges, and written with a commit.

A recording is read in chunks of frames, a row each. Where a chunk's bytes lie follows from the file's header, so tasks share
a long file by byte ranges, and the names and frames that a read asks for leave out files and bytes before they are read.
They are options of the read, not filters that Spark pushes down: Spark 4.1 keeps what it pushes to a Python source with the
table, so two differently filtered uses of one table in a plan would both read by the filters of the last.

Written recordings appear at once when the job commits; a task that fails, or a job that is given up, leaves none.
"""

from __future__ import annotations

import json
import posixpath
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from auralake.sources import wav

NAME = "recordings"
SCHEMA = "path string, item string, kind string, rate int, channels int, total long, start long, frames long, samples array<array<float>>, error string"
#: What a writer takes: chunks of a recording from frame ``start``, named ``item.kind.wav``, or ``item.wav`` without a kind.
WRITTEN = ["item", "kind", "rate", "start", "samples"]
CHUNK_FRAMES, PARTITION_BYTES, SPOOLED_BYTES = 65_536, 64 << 20, 16 << 20


def opened(uri: str) -> tuple[files.FileSystem, str]:
    """The file system of a path and the path on it; a path without a scheme is a local one."""
    return files.FileSystem.from_uri(uri) if ":/" in uri else (files.LocalFileSystem(), uri)


def named(path: str) -> tuple[str, str]:
    """Item and kind of ``item.kind.wav`` (``mix``, ``clean``, ...)."""
    item, _, kind = path.rpartition("/")[2].removesuffix(".wav").rpartition(".")
    return (item, kind) if item else (kind, "")


@dataclass
class Pieces(InputPartition):
    """Byte ranges (path, begin, end) of files that one task reads."""

    ranges: list[tuple[str, int, int]]


@dataclass(frozen=True)
class Placed:
    """Where a file's samples lie."""

    layout: wav.Layout
    at: int
    size: int

    @classmethod
    def of(cls, file: pa.NativeFile) -> Placed:
        """Reads no more than the heads of chunks and the format."""
        head = file.read(12)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            raise ValueError("no WAV file")
        place, layout, end = 12, None, file.size()
        while place + 8 <= end:
            file.seek(place)
            name, size = struct.unpack("<4sI", file.read(8))
            if name == b"fmt ":
                layout = wav.Layout.of(file.read(size))
            elif name == b"data" and layout:
                return cls(layout, place + 8, min(size, end - place - 8) // layout.block * layout.block)
            place += 8 + size + size % 2
        raise ValueError("no format or no data")


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.chunk = options["path"], int(options.get("chunkframes", CHUNK_FRAMES))
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted = {c: set(json.loads(options[c])) for c in ("item", "kind") if c in options}
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", 2**62))

    def partitions(self) -> list[InputPartition]:
        """Large files in ranges, small ones together; by names alone, so files that no filter wants are never opened."""
        system, root = opened(self.root)
        ranges, parts, held = [], [], 0
        for found in sorted(system.get_file_info(files.FileSelector(root, recursive=True)), key=lambda i: i.path):
            inner = found.path[len(root.rstrip("/")) + 1 :]
            if found.type != files.FileType.File or not inner.endswith(".wav") or any(p.startswith(("_", ".")) for p in inner.split("/")):
                continue
            item, kind = named(inner)
            if any({"item": item, "kind": kind}[c] not in values for c, values in self.wanted.items()):
                continue
            for begin in range(0, max(found.size, 1), self.bytes):
                end = min(begin + self.bytes, max(found.size, 1))
                if held and held + end - begin > self.bytes:
                    parts, ranges, held = [*parts, Pieces(ranges)], [], 0
                ranges.append((inner, begin, end))
                held += end - begin
        return [*parts, Pieces(ranges)]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        system, root = opened(self.root)
        for inner, begin, end in partition.ranges:
            item, kind = named(inner)
            with system.open_input_file(posixpath.join(root, inner)) as file:
                try:
                    placed = Placed.of(file)
                except (ValueError, struct.error) as e:
                    if begin == 0:
                        yield inner, item, kind, None, None, None, None, None, None, str(e)
                    continue
                block, total = placed.layout.block, placed.size // placed.layout.block
                step = self.chunk * block
                # A chunk is read by the range that its first byte lies in; the first range has what stands before, too.
                first = max(0, -(-(begin - placed.at) // step), self.low // self.chunk)
                last = min(-(-max(0, end - placed.at) // step), -(-self.high // self.chunk), -(-total // self.chunk))
                for k in range(first, last):
                    file.seek(placed.at + k * step)
                    x = placed.layout.frames(file.read(min(step, placed.size - k * step)))
                    yield inner, item, kind, placed.layout.rate, len(x), total, k * self.chunk, x.shape[1], x.tolist(), None


@dataclass
class Left(WriterCommitMessage):
    """The files that a task has written: (temporary path, name)."""

    moves: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """16-bit files from rows of chunks, in order within each recording. A task holds a chunk; long bodies spool to its disk."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.columns = options["path"], schema.fieldNames()
        self.apart = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = opened(self.root)
        folder = posixpath.join(root, self.apart, uuid.uuid4().hex)
        system.create_dir(folder, recursive=True)
        moves, now, body = [], None, None

        def close() -> None:
            if now is None:
                return
            name = f"{now[0]}.{now[1]}.wav" if now[1] else f"{now[0]}.wav"
            size = body.tell()
            body.seek(0)
            with system.open_output_stream(posixpath.join(folder, name)) as out:
                out.write(wav.header_of(channels, rate, size))
                shutil.copyfileobj(body, out, 1 << 20)
            moves.append((posixpath.join(folder, name), name))

        for row in rows:
            key = (row["item"], row["kind"] or "")
            if key != now:
                close()
                body = tempfile.SpooledTemporaryFile(SPOOLED_BYTES)
                now, frames, rate, channels = key, 0, row["rate"], len(row["samples"])
            x = np.array(row["samples"], dtype=np.float64).reshape(len(row["samples"]), -1)
            if (row["start"], row["rate"], len(x)) != (frames, rate, channels):
                raise ValueError(f"{key}: frame {row['start']} at rate {row['rate']} with {len(x)} channels does not follow frame {frames}, rate {rate}, {channels} channels")
            body.write(wav.body_of(x))
            frames += x.shape[1]
        close()
        return Left(moves)

    def commit(self, messages: list[Left]) -> None:
        system, root = opened(self.root)
        moves = [move for message in messages if message for move in message.moves]
        if len({name for _, name in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two tasks have written one recording")
        for path, name in moves:
            system.move(path, posixpath.join(root, name))
        self.abort(messages)

    def abort(self, messages: list[Left]) -> None:
        system, root = opened(self.root)
        path = posixpath.join(root, self.apart)
        if system.get_file_info(path).type == files.FileType.Directory:
            system.delete_dir(path)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Recordings)
    return spark


def read_recordings(
    spark: SparkSession, path: str, items: list[str] | None = None, kinds: list[str] | None = None, frames: tuple[int, int] | None = None,
    chunk_frames: int = CHUNK_FRAMES, partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """Chunks of the recordings below a path: of all, or of the given items and kinds; whole, or those that ``frames`` (from, to) overlap.

    Other files are not opened, and other bytes not read. A file that can't be read is one row with its ``error``.
    """
    reader = registered(spark).read.format(NAME).option("chunkframes", chunk_frames).option("partitionbytes", partition_bytes)
    for name, values in (("item", items), ("kind", kinds)):
        reader = reader.option(name, json.dumps(values)) if values is not None else reader
    return (reader.option("from", frames[0]).option("to", frames[1]) if frames else reader).load(path)


def read_range(spark: SparkSession, path: str, start: int, frames: int, items: list[str] | None = None, kinds: list[str] | None = None, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """(path, item, kind, rate, start, samples): what each recording's frames from ``start`` on hold, chunk by chunk."""
    rows = read_recordings(spark, path, items, kinds, (start, start + frames), chunk_frames).filter("error is null")
    # Columns of their own: within the lambda, ``start`` would mean the new one.
    rows = rows.withColumn("skip", F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int"))
    rows = rows.withColumn("keep", F.greatest(F.least(F.lit(start + frames) - F.col("start"), F.col("frames")).cast("int") - F.col("skip"), F.lit(0)))
    cut = rows.withColumn("samples", F.transform("samples", lambda c: F.slice(c, F.col("skip") + 1, F.col("keep"))))
    return cut.filter("keep > 0").select("path", "item", "kind", "rate", (F.col("start") + F.col("skip")).alias("start"), "samples")


def write_recordings(rows: DataFrame, path: str) -> None:
    """Chunks (item, kind, rate, start, samples) as recordings; a recording of that name is replaced. Chunks must not leave gaps."""
    ordered = rows.select(*WRITTEN).repartition("item", "kind").sortWithinPartitions("item", "kind", "start")
    registered(rows.sparkSession)
    ordered.write.format(NAME).mode("append").save(path)


def paired(rows: DataFrame, of: tuple[str, str] = ("mix", "clean")) -> DataFrame:
    """(item, rate, start, and the samples of both kinds) of chunks that stand in both; an item without either is none."""
    one = lambda kind: rows.filter(F.col("kind") == kind).select("item", "rate", "start", F.col("samples").alias(kind))
    return one(of[0]).join(one(of[1]), ["item", "rate", "start"])
