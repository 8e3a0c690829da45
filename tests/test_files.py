"""Frame and typed-array files as data sources: ranges of every size, round trips, and writes that fail."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.sources import files, frames


@pytest.fixture(scope="module")
def source(spark):
    files.register(spark)
    return spark


def some_frames(spark, sizes=(5, 1, 40)):
    rng = np.random.default_rng(4)
    data = {f"u{i}": rng.normal(0, 1, (n, 13)).astype(np.float32) for i, n in enumerate(sizes)}
    return data, spark.createDataFrame([(u, i, r.tolist()) for u, x in data.items() for i, r in enumerate(x)], "utt string, frame_no int, c array<float>").repartition(3)


@pytest.mark.parametrize("kind", ["counted", "htk"])
@pytest.mark.parametrize("size", [1 << 26, 700, 60])
def test_frames_round_trip_in_ranges(source, tmp_path, kind, size):
    data, df = some_frames(source)
    files.write_frames(df, f"{tmp_path}/out", "utt", kind, ".mfc")
    assert sorted(os.listdir(tmp_path / "out")) == ["u0.mfc", "u1.mfc", "u2.mfc"]
    whole = {r.utt: bytes(r.content) for r in frames.frame_files(df, "utt", kind).collect()}
    assert all((tmp_path / "out" / f"{u}.mfc").read_bytes() == whole[u] for u in data)
    got = source.read.format("frame_files").options(width=13, kind=kind, rangeBytes=size).load(f"{tmp_path}/out")
    back = {}
    for r in got.collect():
        assert back.setdefault(os.path.basename(r.path)[:-4], {}).setdefault(r.frame_no, r.c) is r.c  # each frame once
    assert {u: [x[i] for i in range(len(x))] for u, x in back.items()} == {u: x.tolist() for u, x in data.items()}
    assert got.rdd.getNumPartitions() > (1 if size < 1 << 20 else 0)


def test_either_byte_order_and_damage(source, tmp_path):
    x = np.arange(26, dtype=np.float32).reshape(2, 13)
    (tmp_path / "a").write_bytes(struct.pack(">i", 26) + x.astype(">f4").tobytes())
    (tmp_path / "_b").write_bytes(b"not read")
    got = source.read.format("frame_files").option("width", 13).load(str(tmp_path)).orderBy("frame_no").collect()
    assert [r.c for r in got] == x.tolist()
    (tmp_path / "c").write_bytes(b"")
    with pytest.raises(Exception, match="header"):
        source.read.format("frame_files").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="frames of 7"):
        source.read.format("frame_files").option("width", 7).load(str(tmp_path / "a")).collect()
    with pytest.raises(Exception, match="none"):
        source.read.format("frame_files").load(str(tmp_path / "none")).collect()


def test_a_failed_job_leaves_no_file(source, tmp_path):
    _, df = some_frames(source)
    broken = df.withColumn("c", F.when((F.col("utt") == "u2") & (F.col("frame_no") == 39), F.slice("c", 1, 5)).otherwise(F.col("c")))
    with pytest.raises(Exception, match="values"):
        files.write_frames(broken, f"{tmp_path}/out", "utt")
    assert os.listdir(tmp_path / "out") == []
    files.write_frames(df.where("utt != 'u2'"), f"{tmp_path}/out", "utt")
    before = (tmp_path / "out" / "u0").read_bytes()
    with pytest.raises(Exception, match="exist already"):
        files.write_frames(df, f"{tmp_path}/out", "utt")
    assert sorted(os.listdir(tmp_path / "out")) == ["u0", "u1"] and (tmp_path / "out" / "u0").read_bytes() == before
    files.write_frames(df.where("utt = 'u0' and frame_no < 2"), f"{tmp_path}/out", "utt", mode="overwrite")
    assert len((tmp_path / "out" / "u0").read_bytes()) == 4 + 2 * 52 and sorted(os.listdir(tmp_path / "out")) == ["u0", "u1"]


@pytest.mark.parametrize("kind", ["f4", "i2", "u1"])
def test_arrays_round_trip_in_ranges(source, tmp_path, kind, monkeypatch):
    big = np.random.default_rng(2).integers(0, 99, (70, 1000)).astype(kind)
    rows = [("big", [70, 1000], big.ravel().astype(float).tolist()), ("cube", [1, 2, 3], [float(i) for i in range(6)]), ("none", [0], [])]
    files.write_arrays(source.createDataFrame(rows, "id string, shape array<int>, values array<double>"), f"{tmp_path}/out", "id", kind)
    for size in (1 << 26, 50_001):
        got = source.read.format("array_files").options(kind=kind, rangeBytes=size).load(f"{tmp_path}/out")
        for name, shape, values in rows[:2]:
            parts = sorted((r.start, r["values"], r["shape"]) for r in got.where(F.col("path").endswith(name)).collect())
            assert [v for _, p, _ in parts for v in p] == values and all(s == shape for *_, s in parts)
            assert [s for s, *_ in parts] == [sum(len(p) for _, p, _ in parts[:i]) for i in range(len(parts))]
        assert max(len(r["values"]) for r in got.collect()) <= files.BLOCK
    at = tmp_path / "out" / "big"
    data = bytearray(at.read_bytes())
    data[-9] ^= 1
    at.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        got.collect()


def test_ranges_hold_each_byte_once():
    sizes = [("a", 0), ("b", 10), ("c", 3), ("d", 4), ("e", 25)]
    for most in (1, 4, 7, 100):
        pieces = [p for r in files.ranges(sizes, most) for p in r.pieces]
        assert all(sum(e - s for _, _, s, e in r.pieces) <= most for r in files.ranges(sizes, most))
        for path, size in sizes:
            own = [(s, e) for p, _, s, e in pieces if p == path]
            assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
