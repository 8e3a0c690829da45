"""Frame and typed-array files as Spark data sources. `register(spark)` makes both formats known:

    spark.read.format("frame_files").option("width", 13).load(folder)          path, frame_no, c
    spark.read.format("array_files").option("kind", "f4").load(folder)         path, shape, start, values

Files are read in ranges of `rangeBytes` bytes: a large file goes to many tasks, small ones share one. A range has the frames, or the
values, that begin in it. Values come in blocks of up to BLOCK, numbered from `start`, so no row holds a large file. A file's
checksum is tested, in blocks, by the task of its first range. Files whose names start with a dot or an underscore aren't read.

Tasks write hidden parts; the driver renames them when all tasks have ended, so a lost task or a failed job leaves no file that is
half written. In mode append a name that exists already is an error; in mode overwrite files of the same names are replaced, others stay.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import frames as formats

RANGE_BYTES = 64 << 20
BLOCK = 1 << 16
#: A typed array's header must end within so many bytes.
HEAD = 1 << 16


class Ranges(InputPartition):
    """(path, size, start, end) of each piece of one task."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


def ranges(sizes: list[tuple[str, int]], most: int) -> list[Ranges]:
    """Files of at most `most` bytes together, larger ones in pieces of that size. An empty file is a piece of its own."""
    out, now, held = [], [], 0
    for path, size in sizes:
        for start in range(0, max(size, 1), most):
            end = min(start + most, size)
            if now and held + end - start > most:
                out.append(Ranges(now))
                now, held = [], 0
            now.append((path, size, start, end))
            held += end - start
    return out + [Ranges(now)] if now else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        if self.most < 1:
            raise ValueError("rangeBytes must be positive")

    def partitions(self) -> list[Ranges]:
        store, root = fs.FileSystem.from_uri(self.root)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        kept = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._")
        return ranges(kept, self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.root)[0]
        for path, size, start, end in partition.pieces:
            with store.open_input_file(path) as f:
                yield from self.piece(f, path, size, start, end)


def _inside(start: int, end: int, offset: int, width: int, n: int) -> tuple[int, int]:
    """The first item that begins in bytes start .. end - 1 and the first behind, of n items of `width` bytes from offset on."""
    at = lambda b: min(max(-((offset - b) // width), 0), n)
    return at(start), at(end)


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class FrameReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.width, self.kind = int(options.get("width", 13)), options.get("kind", "counted")
        if self.kind not in ("counted", "htk"):
            raise ValueError(f"no frame files of kind {self.kind} are read")

    def head(self, first: bytes, path: str, size: int) -> tuple[str, int, int, int, bool]:
        """Byte order, offset, width, number of frames, and whether the zeroth coefficient is last."""
        if self.kind == "htk" and len(first) == 12:
            n, _, each, code = struct.unpack(">iihh", first)
            if each > 0 and each % 4 == 0 and n * each + 12 == size:
                return ">", 12, each // 4, n, bool(code & formats.ZEROTH)
        for order in "<>" if self.kind == "counted" and len(first) >= 4 else "":
            n = struct.unpack(f"{order}i", first[:4])[0]
            if n * 4 + 4 == size:
                if n % self.width:
                    raise ValueError(f"{path}: {n} floats aren't frames of {self.width}")
                return order, 4, self.width, n // self.width, False
        raise ValueError(f"{path}: the header doesn't fit the file's size")

    def piece(self, f: pa.NativeFile, path: str, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        order, offset, width, n, turned = self.head(f.read(12), path, size)
        i, stop = _inside(start, end, offset, 4 * width, n)
        f.seek(offset + 4 * width * i)
        step = max(BLOCK // width, 1)
        for at in range(i, stop, step):
            k = min(step, stop - at)
            x = np.frombuffer(f.read(4 * width * k), f"{order}f4").reshape(k, width).astype(np.float32)
            numbers = pa.array(np.arange(at, at + k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([path] * k), numbers, _lists(np.roll(x, 1, axis=1) if turned else x)], ["path", "frame_no", "c"])


class ArrayReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.kind = options.get("kind", "f4")
        if np.dtype(self.kind).itemsize not in formats.TURNS:
            raise ValueError(f"values of kind {self.kind} aren't of one, two or four bytes")

    def piece(self, f: pa.NativeFile, path: str, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        _, order, shape, n, offset, summed = formats.array_head(f.read(HEAD), size, self.kind)
        dtype = np.dtype(f"{order}{self.kind}")
        if summed and start == 0:
            self.test(f, path, order, len(shape) + 1, n, offset)
        i, stop = _inside(start, end, offset, dtype.itemsize, n)
        f.seek(offset + dtype.itemsize * i)
        for at in range(i, stop, BLOCK):
            k = min(BLOCK, stop - at)
            x = np.frombuffer(f.read(dtype.itemsize * k), dtype).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([shape or [n]], pa.list_(pa.int32())), pa.array([at], pa.int64()), _lists(x.reshape(1, k))], ["path", "shape", "start", "values"])

    def test(self, f: pa.NativeFile, path: str, order: str, words: int, n: int, offset: int) -> None:
        f.seek(offset - 4 * words)
        total = formats.checksum(np.frombuffer(f.read(4 * words), f"{order}u4"))
        dtype = np.dtype(f"{order}{self.kind}")
        for at in range(0, n, BLOCK):
            total = formats.checksum(np.frombuffer(f.read(dtype.itemsize * min(BLOCK, n - at)), dtype), total)
        if total != struct.unpack(f"{order}I", f.read(4))[0]:
            raise ValueError(f"{path}: the checksum is wrong")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """One job's writer. `contents` turns a task's batches into (file name, bytes) pieces, those of a file one after another."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.suffix, self.overwrite, self.job = options["path"], options.get("suffix", ""), overwrite, uuid.uuid4().hex
        self.kind = options.get("kind", self.default)

    def _part(self, root: str, name: str) -> str:
        return f"{root}/.{name}{self.suffix}.{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.root)
        store.create_dir(root, recursive=True)
        own, names, out, now, done = uuid.uuid4().hex, [], None, None, set()
        try:
            for name, piece in self.contents(iterator):
                if name != now:
                    if out is not None:
                        out.close()
                    if not name or "/" in name or name in done:
                        raise ValueError(f"{name!r} is no file name, or there are rows of it apart")
                    now, out = name, store.open_output_stream(f"{self._part(root, name)}.{own}")
                    done.add(name)
                    names.append(f"{name}\n{own}")
                out.write(piece)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        store.create_dir(root, recursive=True)
        parts = [x.split("\n") for m in messages if m for x in m.names]
        names = [n for n, _ in parts]
        taken = [] if self.overwrite else [n for n, i in zip(names, store.get_file_info([f"{root}/{n}{self.suffix}" for n in names]), strict=True) if i.type != fs.FileType.NotFound]
        if taken or len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"files exist already, or were written by two tasks: {taken[:9] or sorted(names)[:9]}")
        for name, own in parts:
            store.move(f"{self._part(root, name)}.{own}", f"{root}/{name}{self.suffix}")
        self.abort(messages)  # what attempts that were given up have left

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(".") and f".{self.job}." in i.base_name:
                store.delete_file(i.path)


class FrameWriter(_Writer):
    """Of rows (name, n, frame_no, c) by name and number, n the number of the file's frames, all equally long."""

    default = "counted"

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        now, left, width = None, 0, 0
        for b in batches:
            names, counts, _, c = b.columns
            for name, n, row in zip(names.to_pylist(), counts.to_pylist(), c, strict=True):
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float32)
                if name != now:
                    if left:
                        raise ValueError(f"{now} lacks {left} frames")
                    now, left, width = name, n, len(x)
                    yield name, struct.pack(">iihh", n, 100_000, 4 * width, formats.MFCC | formats.ZEROTH) if self.kind == "htk" else struct.pack("=i", n * width)
                if len(x) != width:
                    raise ValueError(f"{name}: frames of {width} and {len(x)} values")
                left -= 1
                yield name, np.roll(x, -1).astype(">f4").tobytes() if self.kind == "htk" else x.tobytes()
        if left:
            raise ValueError(f"{now} lacks {left} frames")


class ArrayWriter(_Writer):
    """Of rows (name, shape, values), a file each."""

    default = "f4"

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            for name, shape, values in zip(*(x.to_pylist() for x in b.columns), strict=True):
                yield name, formats.encode_array(np.asarray(values, dtype=float).reshape(shape), self.kind)


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "path string, frame_no int, c array<float>"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return "path string, shape array<int>, start long, values array<double>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (FrameFiles, ArrayFiles):
        spark.dataSource.register(source)


def write_frames(frames: DataFrame, folder: str, utterance: str, kind: str = "counted", suffix: str = "", mode: str = "append") -> None:
    """A file of frames (utterance, frame_no, c) for each utterance, streamed through its task. kind: `counted` or `htk`."""
    register(frames.sparkSession)
    counts = frames.groupBy(utterance).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    rows = frames.select(utterance, "frame_no", "c").join(counts, utterance).select(F.col(utterance).cast("string").alias("name"), F.col("_n").alias("n"), "frame_no", "c")
    rows.repartition("name").sortWithinPartitions("name", "frame_no").write.format("frame_files").options(kind=kind, suffix=suffix).mode(mode).save(folder)


def write_arrays(arrays: DataFrame, folder: str, name: str, kind: str = "f4", suffix: str = "", mode: str = "append") -> None:
    """A typed array file with a checksum for each row (name, shape, values)."""
    register(arrays.sparkSession)
    rows = arrays.select(F.col(name).cast("string").alias("name"), "shape", "values")
    rows.write.format("array_files").options(kind=kind, suffix=suffix).mode(mode).save(folder)
