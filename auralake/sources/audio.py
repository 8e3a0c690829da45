"""Audio files as rows of samples. Files are dealt by Spark's binary reader; a decoder looks at each header."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "format string, rate int, channels int, pcm array<smallint>"


def decode_wav(data: bytes) -> tuple[str, int, int, np.ndarray] | None:
    """16-bit PCM in a RIFF container; its chunks may come in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, found = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        found.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if b"fmt " not in found:
        raise ValueError("a RIFF file without a format")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", found[b"fmt "][:16])
    if kind not in (1, 0xFFFE) or bits != 16:
        raise ValueError("only 16-bit linear samples are read")
    return "wav", rate, channels, np.frombuffer(found.get(b"data", b"")[: len(found.get(b"data", b"")) // 2 * 2], "<i2")


def decode_sphere(data: bytes) -> tuple[str, int, int, np.ndarray] | None:
    """Uncompressed SPHERE: a text header of stated length."""
    if data[:7] != b"NIST_1A":
        return None
    size = int(data[8:16])
    head = dict(re.findall(r"^(\w+) -\w+ (.+?)\s*$", data[16:size].decode("latin-1"), re.M))
    if "shorten" in head.get("sample_coding", "") or int(head.get("sample_n_bytes", 2)) != 2:
        raise ValueError("only uncompressed 16-bit SPHERE is read")
    order = ">i2" if head.get("sample_byte_format") == "10" else "<i2"
    body = data[size:]
    return "sphere", int(head["sample_rate"]), int(head.get("channel_count", 1)), np.frombuffer(body[: len(body) // 2 * 2], order)


def decode(data: bytes, rate: int = 16000, channels: int = 1, big_endian: bool = False) -> tuple[str, int, int, np.ndarray]:
    """By header; without one, raw samples of the given form."""
    raw = np.frombuffer(data[: len(data) // 2 * 2], ">i2" if big_endian else "<i2")
    return decode_wav(data) or decode_sphere(data) or ("raw", rate, channels, raw)


def read_audio(spark: SparkSession, path: str, rate: int = 16000, channels: int = 1, big_endian: bool = False, strict: bool = True) -> DataFrame:
    """path, format, rate, channels and pcm (channels interleaved). A header that says otherwise than rate and channels is an
    error if strict."""

    @F.pandas_udf(FIELDS)
    def opened(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            kind, r, n, pcm = decode(bytes(c), rate, channels, big_endian)
            if strict and (r, n) != (rate, channels):
                raise ValueError(f"{n} channels at {r} Hz where {channels} at {rate} are expected")
            rows.append((kind, r, n, pcm.astype(np.int16)))
        return pd.DataFrame(rows, columns=["format", "rate", "channels", "pcm"])

    return spark.read.format("binaryFile").load(path).select("path", opened("content").alias("a")).select("path", "a.*")


def one_channel(pcm: Column, channels: Column | int, which: int = 0) -> Column:
    """Channel `which`, from 1, of interleaved samples; 0 mixes them: the mean, cut toward zero."""
    n = channels if isinstance(channels, Column) else F.lit(channels)
    frames = F.when(F.size(pcm) < n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.size(pcm) / n).cast("int") - 1))
    if which:
        return F.transform(frames, lambda i: F.get(pcm, i * n + (which - 1)))
    return F.transform(frames, lambda i: (F.aggregate(F.slice(pcm, i * n + 1, n), F.lit(0), lambda s, x: s + x.cast("int")) / n).cast("smallint"))


def work_list(ctl: DataFrame, skip: int = 0, run: int | None = None, part: int | None = None, parts: int = 1) -> DataFrame:
    """Of a list (line_no, path): each path once, at its first line; `skip` and `run` lines, or one of `parts` contiguous parts
    (from 1), of which the last takes what is left over."""
    if part is not None:
        n = ctl.count()
        share = n // parts
        skip, run = (part - 1) * share, None if part == parts else share
    first = F.col("line_no") > skip
    kept = ctl.where(first if run is None else first & (F.col("line_no") <= skip + run))
    return kept.groupBy("path").agg(F.min("line_no").alias("line_no"))
