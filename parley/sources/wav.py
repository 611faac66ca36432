"""A data source ``wav``: long files are read by several tasks, each its own range of frames; rows are written as files.

A file is cut into partitions by its size alone, so planning reads no file. A task finds the format in
the file's head, takes its share of the frames, and gives them in rows of at most ``CHUNK``. With the
option ``samples`` set to false only heads are read. Files are reached through Arrow's file systems
(local and shared folders, or what its URIs name).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from parley.session import ship
from parley.sources.audio import pcm

#: Frames of a row, and bytes of a file that one task reads, about.
CHUNK, PART_BYTES = 65_536, 32 << 20
SCHEMA = "path string, sample_rate int, channels int, n_frames long, start long, samples array<float>, error string"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def head(file: pa.NativeFile) -> tuple[tuple, int, int]:
    """(kind, channels, rate, bits), place and bytes of the samples; reads heads of chunks only."""
    size = file.size()
    file.seek(0)
    if (own := file.read(12))[:4] != b"RIFF" or own[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= size and (form is None or data is None):
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            raw = file.read(min(n, 26))
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw)
            form = (struct.unpack_from("<H", raw, 24)[0] if kind == 0xFFFE and len(raw) >= 26 else kind, channels, rate, bits)
        elif name == b"data":
            data = at + 8, min(n, size - at - 8)
        at += 8 + n + n % 2
    if form is None or data is None:
        raise ValueError("no format or no data")
    if not form[1] or not form[3] // 8:
        raise ValueError("no channels or no bits")
    return form, *data


class Share(InputPartition):
    def __init__(self, path: str, nth: int, of: int):
        super().__init__((path, nth, of))


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.samples = options["path"], options.get("samples", "true").lower() != "false"
        self.part = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Share]:
        system, path = _place(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and f.path.lower().endswith(".wav")), key=lambda f: f.path):
            n = max(1, -(-f.size // self.part)) if self.samples else 1
            out += [Share(f.path, i, n) for i in range(n)]
        return out or [Share("", 0, 1)]

    def read(self, partition: Share) -> Iterator[tuple]:
        path, nth, of = partition.value
        if not path:
            return
        system, _ = _place(self.path)
        with system.open_input_file(path) as file:
            try:
                (kind, channels, rate, bits), at, size = head(file)
                width = bits // 8 * channels
                frames = size // width
                if not self.samples:
                    yield path, rate, channels, frames, 0, None, None
                    return
                first, end = nth * frames // of, (nth + 1) * frames // of
                for start in range(first, end, CHUNK) if frames else [0] * (nth == 0):
                    file.seek(at + start * width)
                    values = pcm(file.read((min(end, start + CHUNK) - start) * width), kind, channels, bits)
                    yield path, rate, channels, frames, start, values.astype(np.float32).tolist(), None
            except (ValueError, struct.error) as problem:
                if nth == 0:
                    yield path, None, None, None, None, None, str(problem)


class WavWriter(DataSourceWriter):
    """Rows ``name, sample_rate, samples`` as 16-bit mono files ``name.wav``. A file appears whole or not at
    all, and a repeated task writes it again."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, path = _place(self.path)
        system.create_dir(path)
        for row in iterator:
            data = np.clip(np.rint(np.asarray(row["samples"] or [], float) * 32768), -32768, 32767).astype("<i2").tobytes()
            rate = row["sample_rate"]
            hidden = f"{path}/.{row['name']}.{id(iterator)}"
            with system.open_output_stream(hidden) as out:
                out.write(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)))
                out.write(data)
            system.move(hidden, f"{path}/{row['name']}.wav")
        return WriterCommitMessage()


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """``spark.read.format("wav").load(path)`` and ``df.write.format("wav").mode("append").save(path)`` work from here on."""
    ship(spark)
    spark.dataSource.register(WavSource)
