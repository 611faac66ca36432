"""WAV files as rows of mono samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import ship

SCHEMA = "path string, sample_rate int, channels int, duration_s double, samples array<float>, error string"


def decode(content: bytes) -> tuple[int, int, np.ndarray]:
    """Sample rate, channels and mono samples of PCM (8, 16, 24, 32 bits) or float RIFF data."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", content, at + 8)
            if form[0] == 0xFFFE and size >= 26:
                form = (struct.unpack_from("<H", content, at + 32)[0], *form[1:])
        elif name == b"data":
            data = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("no format or no data")
    return form[2], form[1], pcm(data, form[0], form[1], form[5])


def pcm(data: bytes, kind: int, channels: int, bits: int) -> np.ndarray:
    """Mono samples of the whole frames in ``data``."""
    width = bits // 8
    if not channels or not width:
        raise ValueError("no channels or no bits")
    data = data[: len(data) // (width * channels) * (width * channels)]
    if kind == 3 and bits in (32, 64):
        values = np.frombuffer(data, f"<f{width}").astype(np.float64)
    elif kind == 1 and bits == 8:
        values = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif kind == 1 and bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        values = (whole - ((whole & 0x800000) << 1)) / float(1 << 23)
    elif kind == 1 and bits in (16, 32):
        values = np.frombuffer(data, f"<i{width}") / float(1 << (bits - 1))
    else:
        raise ValueError(f"samples of kind {kind} with {bits} bits are not supported")
    return values.reshape(-1, channels).mean(axis=1)


def read_wav(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """One row for each ``*.wav`` file under ``path``, resampled to ``rate``; what cannot be read has ``error``."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    own, channels, values = decode(bytes(content))
                    n = int(len(values) * rate / own)
                    samples = np.interp(np.arange(n) * (own / rate), np.arange(len(values)), values) if len(values) else values
                    rows.append((name, own, channels, len(values) / own, samples.astype(np.float32), None))
                except (ValueError, struct.error) as problem:
                    rows.append((name, None, None, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "duration_s", "samples", "error"]).astype({"sample_rate": "Int32", "channels": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def unsupported(spark: SparkSession, path: str) -> DataFrame:
    """Other files under ``path`` and why they are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(kind != "wav").select("path", F.when(kind.isin("mp3", "m4a", "aac"), "not supported yet").otherwise("not an audio file").alias("reason"))


#: Samples of a frame and steps between frames; features, places of each, and bins of their histograms.
FRAME, HOP, PLACES, BINS = 1024, 512, 100, 96


def _frame_features(values: np.ndarray, rate: int, frame: int, hop: int) -> np.ndarray:
    """Energy, zero crossings, centroid, rolloff of sorted sizes, and change of energy, for each whole frame."""
    starts = np.arange(0, len(values) - frame + 1, hop)
    rows = values[starts[:, None] + np.arange(frame)]
    size = np.abs(rows)
    mass = size.sum(axis=1)
    energy = np.sqrt((rows * rows).sum(axis=1))
    crossings = ((rows[:, 1:] >= 0) != (rows[:, :-1] >= 0)).sum(axis=1) / frame
    centroid = np.divide(size @ (np.arange(frame) * rate / frame / 2), mass, out=np.zeros(len(rows)), where=mass > 0)
    reached = np.cumsum(-np.sort(-size, axis=1), axis=1) >= 0.85 * mass[:, None]
    rolloff = np.where(reached.any(axis=1), reached.argmax(axis=1) * rate / frame / 2, rate / 2)
    return np.stack((energy, crossings, centroid, rolloff, np.abs(np.diff(energy, prepend=energy[:1]))))


def statistics_vector(values: np.ndarray, rate: int = 16_000, size: int = 512, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """A unit vector of sample statistics.

    Each of five features of the frames has ``PLACES`` places: mean, deviation, least, most, and a
    histogram of shares. The last places come from a hash of the samples, so that unlike sounds
    differ. No samples give zeros; fewer than a frame give the hash alone.
    """
    out = np.zeros(size)
    if not len(values):
        return out
    for k, own in enumerate(_frame_features(values, rate, frame, hop) if len(values) >= frame else ()):
        out[k * PLACES : k * PLACES + 4] = own.mean(), own.std(), own.min(), own.max()
        if own.max() > own.min():
            place = np.minimum((own - own.min()) / ((own.max() - own.min()) / BINS), BINS - 1).astype(int)
            out[k * PLACES + 4 : k * PLACES + 4 + BINS] = np.bincount(place, minlength=BINS) / len(own)
    code = 0
    for x in np.clip(values * 1000, 0, 2**32 - 1).astype(np.uint64).tolist():
        code = (code * 31 + x) % 2**32
    hashed = np.array([code * (i + 1) % 2**32 % 10_000 for i in range(5 * PLACES, size)])
    out[5 * PLACES :] = (hashed / 10_000 - 0.5) * 0.1
    scale = np.linalg.norm(out)
    return out / scale if scale > 0 else out


def with_embeddings(segments: DataFrame, least: int = 1600) -> DataFrame:
    """Segments (samples) with a ``vector`` of their statistics; those with fewer samples are left out."""
    ship(segments.sparkSession)

    @F.pandas_udf("array<double>")
    def embed(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: statistics_vector(np.asarray(s, float)))

    return segments.where(F.size("samples") >= least).withColumn("vector", embed("samples"))


def cut_segments(segments: DataFrame, audio: DataFrame, rate: int = 16_000) -> DataFrame:
    """Segments (path, start_ms, end_ms) with their samples."""
    first = F.floor(F.col("start_ms") * rate / 1000).cast("int")
    last = F.floor(F.col("end_ms") * rate / 1000).cast("int")
    return segments.join(audio.select("path", F.col("samples").alias("_all")), "path").select(*segments.columns, F.slice("_all", first + 1, F.greatest(last - first, F.lit(0))).alias("samples"))


def blob_vectors(rows: DataFrame, blob: str = "vector") -> DataFrame:
    """Little-endian float32 blobs as ``array<float>``; a length that is no multiple of 4 gives null."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)

    return rows.withColumn(blob, unpack(blob))
