"""Frame files: count-headed float matrices in either byte order, typed arrays with a checksum, and their sinks."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of the big-endian frame format: filter banks, and cepstra with the zeroth.
FBANK, MFCC, ZEROTH = 7, 6, 0o20000


def decode_frames(data: bytes, width: int) -> np.ndarray:
    """The matrix of a file whose header counts its floats; the byte order is the one in which that is right."""
    for order in "<>":
        if len(data) >= 4 and struct.unpack(f"{order}i", data[:4])[0] * 4 + 4 == len(data):
            x = np.frombuffer(data[4:], f"{order}f4")
            if len(x) % width:
                raise ValueError(f"{len(x)} floats aren't frames of {width}")
            return x.reshape(-1, width).astype(np.float32)
    raise ValueError("the header doesn't fit the file's size")


def read_frames(spark: SparkSession, path: str, width: int = 13) -> DataFrame:
    """path, frame_no and c."""

    @F.pandas_udf("array<array<float>>")
    def rows(content: pd.Series) -> pd.Series:
        return content.map(lambda c: [r.tolist() for r in decode_frames(bytes(c), width)])

    return spark.read.format("binaryFile").load(path).select("path", F.posexplode(rows("content")).alias("frame_no", "c"))


def frame_files(frames: DataFrame, utterance: str, kind: str = "counted", frame_rate: int = 100, logspec: bool = False) -> DataFrame:
    """(utterance, content): one file for each. kind `counted` is a native count and floats; `htk` is big-endian with a period
    header, the zeroth coefficient last; `text` has a line for each frame."""
    schema = f"{utterance} {frames.schema[utterance].dataType.simpleString()}, content binary"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_no")
        x = np.stack(rows["c"].to_list()).astype(np.float32)
        if kind == "htk":
            x = x if logspec else np.roll(x, -1, axis=1)
            head = struct.pack(">iihh", len(x), int(1e7 / frame_rate), x.shape[1] * 4, FBANK if logspec else MFCC | ZEROTH)
            body = head + x.astype(">f4").tobytes()
        elif kind == "text":
            body = "".join(" ".join(f"{v:.5g}" for v in r) + "\n" for r in x).encode()
        else:
            body = struct.pack("=i", x.size) + x.tobytes()
        return pd.DataFrame({utterance: [rows[utterance].iloc[0]], "content": [body]})

    return frames.select(utterance, "frame_no", "c").groupBy(utterance).applyInPandas(pack, schema)


def write_files(files: DataFrame, folder: str, name: str, suffix: str = "") -> int:
    """Writes each row's content to folder/name + suffix, where tasks see the folder; returns how many."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files_, root = fs.FileSystem.from_uri(folder)
        files_.create_dir(root, recursive=True)
        for b in batches:
            for n, c in zip(b[name], b["content"], strict=True):
                with files_.open_output_stream(f"{root}/.{n}{suffix}.part") as f:
                    f.write(bytes(c))
                files_.move(f"{root}/.{n}{suffix}.part", f"{root}/{n}{suffix}")
            yield pd.DataFrame({"n": [len(b)]})

    return files.select(name, "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def view(frames: DataFrame, width: int, start: int = 0, end: int | None = None, numbers: bool = False) -> DataFrame:
    """(frame_no, line): the first coefficients of frames start .. end - 1 as text of fixed width."""
    kept = frames.where((F.col("frame_no") >= start) & (F.col("frame_no") < end if end is not None else F.lit(True)))
    line = F.array_join(F.transform(F.slice("c", 1, width), lambda x: F.format_string("%7.3f", x)), " ")
    return kept.select("frame_no", F.concat(F.format_string("%6d: ", "frame_no"), line).alias("line") if numbers else line.alias("line"))


#: By the width of an element, the bits that the running sum is turned left by before each is added.
TURNS = {1: 5, 2: 10, 4: 20}


def checksum(x: np.ndarray, total: int = 0) -> int:
    """The running 32-bit sum of elements of one, two or four bytes, turned left before each is added."""
    turn = TURNS[x.itemsize]
    for w in x.view(f"{x.dtype.byteorder.replace('|', '=')}u{x.itemsize}").tolist():
        total = ((total << turn | total >> 32 - turn) + w) & 0xFFFFFFFF
    return total


def array_head(start: bytes, size: int, kind: str = "f4") -> tuple[dict, str, list[int], int, int, bool]:
    """(fields, byte order, shape, count, offset, summed) of a typed array file of `size` bytes, from its first ones: a text header up to
    `endhdr`, a byte-order word, one to three sizes, the count of values, which start at offset, and, if summed, a checksum behind them.
    kind is the values' numpy type, of one, two or four bytes, which the file doesn't say. shape is empty for a plain list of values."""
    if b"endhdr\n" not in start:
        raise ValueError("not a typed array file")
    head, body = start.split(b"endhdr\n", 1)
    lines = head.decode("ascii", "replace").split("\n")
    if lines[0] != "s3":
        raise ValueError("not a typed array file")
    fields = dict(x.split(None, 1) for x in lines[1:] if x.strip())
    order = next((o for o in "<>" if len(body) >= 4 and struct.unpack(f"{o}I", body[:4])[0] == 0x11223344), None)
    if order is None:
        raise ValueError("the byte-order word is damaged")
    summed, at = fields.get("chksum0", "no").strip() == "yes", len(head) + len("endhdr\n") + 4
    room = size - at - (4 if summed else 0)
    for d in (3, 2, 1):
        words = d + 1 if d > 1 else 1
        if min(len(body) - 4, room) < 4 * words:
            continue
        *shape, n = (int(v) for v in np.frombuffer(body[4:], f"{order}u4", count=words))
        if room == 4 * words + n * np.dtype(kind).itemsize and (d == 1 or int(np.prod(shape)) == n):
            return fields, order, shape, n, at + 4 * words, summed
    raise ValueError("the sizes don't fit the file")


def decode_array(data: bytes, kind: str = "f4") -> tuple[dict, np.ndarray]:
    """(header, array) of a typed array file (`array_head`); its checksum, if it has one, must be right."""
    fields, order, shape, n, offset, summed = array_head(data, len(data), kind)
    x = np.frombuffer(data, f"{order}{kind}", count=n, offset=offset)
    if summed:
        sizes = np.frombuffer(data, f"{order}u4", count=len(shape) + 1, offset=offset - 4 * len(shape) - 4)
        if checksum(x, checksum(sizes)) != struct.unpack(f"{order}I", data[-4:])[0]:
            raise ValueError("the checksum is wrong")
    x = x.astype(x.dtype.newbyteorder("="))
    return fields, x.reshape(shape) if shape else x


def encode_array(x: np.ndarray, kind: str = "f4") -> bytes:
    """A typed array file with a checksum, in this machine's byte order; values of one, two or four bytes."""
    x = np.ascontiguousarray(x, dtype=kind)
    sizes = np.array([*(x.shape if x.ndim > 1 else ()), x.size], dtype="u4")
    order = 0x11223344
    return b"s3\nversion 1.0\nchksum0 yes\nendhdr\n" + order.to_bytes(4, sys.byteorder) + sizes.tobytes() + x.tobytes() + checksum(x.ravel(), checksum(sizes)).to_bytes(4, sys.byteorder)


def read_arrays(spark: SparkSession, path: str, kind: str = "f4") -> DataFrame:
    """(path, shape, values) of typed array files, one a row; damaged files are an error."""

    @F.pandas_udf("shape array<int>, values array<double>")
    def decode(content: pd.Series) -> pd.DataFrame:
        found = [decode_array(bytes(c), kind)[1] for c in content]
        return pd.DataFrame({"shape": [list(x.shape) for x in found], "values": [x.ravel().astype(float) for x in found]})

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("_a")).select("path", "_a.*")


def array_files(arrays: DataFrame, name: str, kind: str = "f4") -> DataFrame:
    """(name, content) for `write_files`, of rows (name, shape, values). Values are cast to kind."""

    @F.pandas_udf("binary")
    def encode(shape: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([encode_array(np.asarray(v, dtype=float).reshape([int(n) for n in s]), kind) for s, v in zip(shape, values, strict=True)], dtype=object)

    return arrays.select(name, encode("shape", "values").alias("content"))


def read_projection(spark: SparkSession, path: str, width: int | None = None) -> list[list[float]]:
    """The matrix of a linear projection, its first `width` rows: metadata of the driver."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    x = decode_array(content)[1]
    x = x.reshape(x.shape[-2:]) if x.ndim == 3 else x
    return x[:width].astype(float).tolist()
