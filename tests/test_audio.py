import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auralake.operators import activity, frontend, pitch, warp
from auralake.sources import audio, frames
from auralake.streaming import live

FE = frontend.FrontEnd()


def tone(hz, n, rate=16000, level=8000):
    return (level * np.sin(2 * np.pi * hz * np.arange(n) / rate)).astype(np.int16)


def wav(pcm, rate=16000, channels=1):
    body = pcm.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", len(body)) + body


def sphere(pcm, rate=16000, channels=1):
    head = f"NIST_1A\n   1024\nchannel_count -i {channels}\nsample_rate -i {rate}\nsample_n_bytes -i 2\nsample_byte_format -s2 10\nsample_coding -s3 pcm\nend_head\n".encode()
    return head.ljust(1024) + pcm.astype(">i2").tobytes()


def test_sources_agree(spark, tmp_path):
    x = tone(440, 1600)
    for name, data in (("a.wav", wav(x)), ("b.sph", sphere(x)), ("c.raw", x.astype("<i2").tobytes())):
        (tmp_path / name).write_bytes(data)
    got = audio.read_audio(spark, str(tmp_path)).collect()
    assert {r.format for r in got} == {"wav", "sphere", "raw"} and all(r.pcm == x.tolist() for r in got)
    (tmp_path / "d.wav").write_bytes(wav(np.repeat(x, 2), channels=2))
    with pytest.raises(Exception, match="2 channels"):
        audio.read_audio(spark, str(tmp_path)).collect()
    two = audio.read_audio(spark, str(tmp_path / "d.wav"), channels=2)
    for which in (0, 1, 2):
        assert two.select(audio.one_channel(F.col("pcm"), 2, which).alias("m")).first().m == x.tolist()
    ctl = spark.createDataFrame([(i + 1, p) for i, p in enumerate("abacd")], "line_no int, path string")
    assert sorted(r.path for r in audio.work_list(ctl).collect()) == list("abcd")
    assert [sorted(r.path for r in audio.work_list(ctl, part=k, parts=2).collect()) for k in (1, 2)] == [["a", "b"], ["a", "c", "d"]]


def brute_frame(x, start, fe=FE):
    part = x[start : start + fe.size].astype(float)
    prior = x[start - 1] if start else 0
    y = np.zeros(fe.size)
    y[: len(part)] = part - fe.alpha * np.concatenate([[prior], part[:-1]])
    spec = np.abs(np.fft.rfft(y * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(fe.size) / (fe.size - 1))), fe.n_fft)) ** 2
    return spec @ fe.filters


def test_frames_and_spectra(spark):
    x = tone(1000, 5000)
    u = spark.createDataFrame([("u", 0, x.tolist()), ("short", 0, x[:100].tolist()), ("none", 0, [])], "stream_id string, utt_seq int, pcm array<smallint>")
    framed = frontend.frames(u, FE, ["stream_id", "utt_seq"])
    assert (FE.size, FE.shift) == (410, 160)
    n = {r.stream_id: r["count"] for r in framed.groupBy("stream_id").count().collect()}
    assert n == {"u": 1 + (5000 - 410) // 160 + 1, "short": 1}
    got = {r.frame_no: r.mel for r in frontend.mel_spectra(framed, FE).where("stream_id = 'u'").collect()}
    for i, m in got.items():
        assert m == pytest.approx(brute_frame(x, i * 160).tolist(), rel=1e-9, abs=1e-6)
    top = int(np.argmax(got[3]))
    edges = np.flatnonzero(FE.filters[:, top]) * FE.rate / FE.n_fft
    assert edges.min() - 40 <= 1000 <= edges.max() + 40


def test_transforms():
    logs = np.random.default_rng(1).normal(0, 1, (4, 40))
    full = frontend.FrontEnd(n_cep=40, transform="dct")
    assert logs @ full.cosines @ full.inverse == pytest.approx(logs)
    assert frontend.FrontEnd(n_cep=40, transform="htk").of_log(logs)[:, 0] == pytest.approx(full.of_log(logs)[:, 0] * np.sqrt(2))
    c = FE.of_log(logs)
    assert c[:, 0] == pytest.approx((logs[:, 0] / 2 + logs[:, 1:].sum(axis=1)) / 40)
    k = 5
    want = sum((1 if j == 0 else 2) * logs[:, j] * np.cos(np.pi * k * (j + 0.5) / 40) for j in range(40)) / 80
    assert c[:, k] == pytest.approx(want)
    assert frontend.FrontEnd(output="smoothspec", n_cep=40).of_log(logs) == pytest.approx(logs)
    assert frontend.FrontEnd(lifter=22).of_log(logs) == pytest.approx(c * (1 + 11 * np.sin(np.arange(13) * np.pi / 22)))
    odd = frontend.FrontEnd(rate=11025.0, window=0.024, high=5000.0)
    assert odd.size == 265 and odd.hamming[132] == 1.0


@pytest.mark.parametrize("bad", [dict(n_fft=500), dict(n_fft=256), dict(high=9000.0), dict(frame_rate=0), dict(transform="x")])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        frontend.FrontEnd(**bad)


@pytest.mark.parametrize("kind, parameters", [("inverse_linear", (1.2,)), ("affine", (1.1, 20.0)), ("piecewise_linear", (1.1, 3000.0)), ("piecewise_linear", (0.9,))])
def test_warps_invert(kind, parameters):
    to, back = warp.warps(kind, parameters, 16000)
    for f in (100.0, 2500.0, 3100.0, 7000.0):
        assert back(to(f)) == pytest.approx(f)
    assert frontend.FrontEnd(warp=kind, warp_parameters=parameters if kind != "piecewise_linear" else (0.9, 3000.0), high=6000.0).filters.shape == (257, 40)


def test_hangover():
    speech = np.array([0] * 30 + [1] * 9 + [0] * 5 + [1] * 40 + [0] * 80, dtype=bool)
    start = 44 + 9 - 20
    assert activity.segments_of(speech) == [(start, 44 + 40 + 49 - start)]
    assert activity.segments_of(np.ones(12, dtype=bool)) == [(0, 12)] and activity.segments_of(np.zeros(0, dtype=bool)) == []


def signal():
    rng = np.random.default_rng(2)
    quiet = lambda n: rng.integers(-8, 9, n).astype(np.int16)
    return np.concatenate([quiet(16000), tone(700, 16000) + quiet(16000), quiet(24000)])


@pytest.fixture(scope="module")
def mel(spark):
    u = spark.createDataFrame([("s", 0, signal().tolist()), ("s", 1, signal().tolist()), ("t", 0, signal()[:9000].tolist())], "stream_id string, utt_seq int, pcm array<smallint>")
    return frontend.mel_spectra(frontend.frames(u, FE, ["stream_id", "utt_seq"]), FE).cache()


def test_activity_finds_the_burst(spark, mel):
    tracked = activity.track(mel).cache()
    segs = activity.segments(tracked).where("stream_id = 's'").orderBy("utt_seq", "seg_no").collect()
    assert [(r.utt_seq, r.seg_no) for r in segs] == [(0, 0), (1, 0)]
    for r in segs:
        assert 75 <= r.start_frame <= 100 and 60 <= r.n_frames <= 175
    off = activity.track(mel, remove_noise=False, remove_silence=False)
    assert off.where("not emitted").count() == 0


def test_live_activity_is_the_batch(spark, mel, tmp_path):
    rows = mel.select("stream_id", "utt_seq", "frame_no", F.col("mel").alias("c"), F.lead("frame_no").over(Window.partitionBy("stream_id", "utt_seq").orderBy("frame_no")).isNull().alias("last"))
    key = lambda df: {(r.stream_id, r.utt_seq, r.frame_no): tuple(round(v, 6) for v in r.c) for r in df.collect()}
    tracked = key(activity.track(mel).where("emitted").withColumnRenamed("mel", "c"))
    assert key(live.over_batch(rows, live.Activity)) == tracked
    got = streamed(spark, rows, live.Activity, tmp_path, [lambda r: r.frame_no < 130 and r.utt_seq == 0, lambda r: r.frame_no >= 130 and r.utt_seq == 0, lambda r: r.utt_seq == 1])
    assert key(got) == tracked


def streamed(spark, rows, machine, tmp_path, cuts):
    """The rows fed as files of one micro-batch each."""
    held = rows.collect()
    for i, cut in enumerate(cuts):
        spark.createDataFrame([r for r in held if cut(r)], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"live_{machine.__name__}"
    q = live.run_live(stream, machine, timeout_ms=None).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name)


def test_live_deltas_are_chunk_invariant(spark, tmp_path):
    x = np.random.default_rng(3).normal(0, 1, (20, 3))
    rows = spark.createDataFrame([("s", 0, i, r.tolist(), i == 19) for i, r in enumerate(x)] + [("late", 0, 0, [1.0, 2.0, 3.0], True)], "stream_id string, utt_seq int, frame_no int, c array<double>, last boolean")
    key = lambda df: {(r.stream_id, r.frame_no): tuple(round(v, 9) for v in r.c) for r in df.collect()}
    whole = key(live.over_batch(rows, live.Deltas))
    assert len(whole) == 21
    at = lambda i: x[min(max(i, 0), 19)]
    for i in range(20):
        want = np.r_[x[i], at(i + 2) - at(i - 2), (at(i + 3) - at(i - 1)) - (at(i + 1) - at(i - 3))]
        assert whole["s", i] == pytest.approx(want.tolist())
    assert key(streamed(spark, rows, live.Deltas, tmp_path, [lambda r: r.frame_no < 2, lambda r: 2 <= r.frame_no < 3, lambda r: r.frame_no >= 3])) == whole


def test_live_mean_and_gain():
    m = live.LiveMean(np.array([40.0, 3.0]))
    x = np.tile([[10.0, 1.0], [-1.0, 5.0]], (10, 1))
    assert m.chunk(x, False) == pytest.approx(x - [40, 3]) and m.mean == pytest.approx([40, 3])
    m.chunk(x, True)
    assert m.mean == pytest.approx([(40 * 500 + 200) / 520, (1500 + 20) / 520])
    m.chunk(np.tile([[10.0, 1.0]], (400, 1)), False)
    assert m.n == 500 and m.total == pytest.approx(m.mean * 500)
    g = live.LiveGain(5.0)
    assert g.chunk(np.array([[7.0, 1.0]]), True)[0, 0] == 2 and g.estimate == 7
    for _ in range(15):
        g.chunk(np.array([[9.0, 1.0]]), True)
    assert g.utterances == 8 and g.total == pytest.approx((7 + 15 * 9) / 2)


def test_pitch_of_tones(spark):
    u = spark.createDataFrame([("u", 0, tone(200, 8000).tolist()), ("v", 0, tone(320, 8000).tolist())], "stream_id string, utt_seq int, pcm array<smallint>")
    got = pitch.track(frontend.frames(u, FE, ["stream_id", "utt_seq"]), ["stream_id", "utt_seq"], FE.rate)
    for r in got.where("frame_no between 3 and 40").collect():
        assert r.f0 == pytest.approx({"u": 200, "v": 320}[r.stream_id], rel=0.1) and r.voicing > 0.8 and r.t == pytest.approx(r.frame_no / 100)
    one = frontend.frames(u, FE, ["stream_id", "utt_seq"]).where("frame_no = 9").collect()
    first = {}
    for r in one:  # the first lag under the threshold, which for a pure tone comes before the least difference
        n = len(r.samples) // 2
        loop = [sum((r.samples[j] - r.samples[j + t]) ** 2 for j in range(n)) for t in range(n)]
        first[r.stream_id] = next(t for t in range(1, n) if loop[t] * t / sum(loop[1 : t + 1]) < 0.1)
    alone = pitch.track(frontend.frames(u, FE, ["stream_id", "utt_seq"]), ["stream_id", "utt_seq"], FE.rate, smooth=0)
    assert {r.stream_id: r.f0 for r in alone.where("frame_no = 9").collect()} == {k: pytest.approx(FE.rate / t) for k, t in first.items()}
    x = np.random.default_rng(5).normal(0, 9, 64)
    d = [sum((x[j] - x[j + t]) ** 2 for j in range(32)) for t in range(32)]
    want = [1.0] + [d[t] * t / sum(d[1 : t + 1]) for t in range(1, 32)]
    assert pitch.difference(x) == pytest.approx(want)


def test_frame_files(spark, tmp_path):
    x = np.random.default_rng(6).normal(0, 1, (5, 13)).astype(np.float32)
    df = spark.createDataFrame([("u", i, r.tolist()) for i, r in enumerate(x)], "utt string, frame_no int, c array<float>")
    packed = frames.frame_files(df, "utt")
    assert frames.write_files(packed, f"file://{tmp_path}/out", "utt", ".mfc") == 1
    swapped = struct.pack(">i", x.size) + x.astype(">f4").tobytes()
    (tmp_path / "out" / "w.mfc").write_bytes(swapped)
    got = frames.read_frames(spark, str(tmp_path / "out"))
    for name in ("u.mfc", "w.mfc"):
        rows = got.where(F.col("path").endswith(name)).orderBy("frame_no").collect()
        assert np.array([r.c for r in rows], dtype=np.float32) == pytest.approx(x)
    htk = bytes(frames.frame_files(df, "utt", "htk").first().content)
    assert struct.unpack(">iihh", htk[:12]) == (5, 100000, 52, 6 | 0o20000)
    assert np.frombuffer(htk[12:], ">f4").reshape(5, 13)[:, -1] == pytest.approx(x[:, 0])
    assert bytes(frames.frame_files(df, "utt", "text").first().content).decode().split()[0] == f"{x[0, 0]:.5g}"
    lines = frames.view(df, 2, 1, 3, True).orderBy("frame_no").collect()
    assert lines[0].line == f"{1:6d}: {x[1, 0]:7.3f} {x[1, 1]:7.3f}" and len(lines) == 2


@pytest.mark.parametrize("shape", [(6,), (2, 3), (1, 2, 3)])
def test_typed_arrays(shape):
    x = np.arange(6, dtype=np.float32).reshape(shape)
    data = frames.encode_array(x)
    head, got = frames.decode_array(data)
    assert head["version"] == "1.0" and got.shape == shape and (got == x).all()
    with pytest.raises(ValueError):
        frames.decode_array(data[:-1] + bytes([data[-1] ^ 1]))


@pytest.mark.parametrize("kind, values", [("u1", [0, 255, 7, 8, 9, 10]), ("i2", [-32768, 32767, 0, 5, -1, 2]), ("i4", [1 << 30, -7, 0, 3, 2, 1]), ("f4", [0.5, -0.25, 8, 0, 1, 2])])
def test_arrays_of_any_width(spark, tmp_path, kind, values):
    turn = {"1": 5, "2": 10, "4": 20}[kind[1]]
    x = np.array(values, dtype=kind)
    total = 0
    for n, t in [(2, 20), (3, 20), (6, 20), *[(int(v), turn) for v in x.view(f"u{x.itemsize}")]]:
        total = (((total << t) | (total >> (32 - t))) + n) % (1 << 32)
    data = frames.encode_array(x.reshape(2, 3), kind)
    assert int.from_bytes(data[-4:], "little") == total
    swapped = b"s3\nchksum0 yes\nendhdr\n" + (0x11223344).to_bytes(4, "big") + np.array([2, 3, 6], ">u4").tobytes() + x.astype(f">{kind}").tobytes() + total.to_bytes(4, "big")
    for content in (data, swapped):
        assert (frames.decode_array(content, kind)[1] == x.reshape(2, 3)).all()
        with pytest.raises(ValueError, match="checksum"):
            frames.decode_array(content[:-5] + bytes([content[-5] ^ 1]) + content[-4:], kind)
    rows = spark.createDataFrame([("a", [2, 3], [float(v) for v in values]), ("b", [6], [float(v) for v in values])], "name string, shape array<int>, values array<double>")
    assert frames.write_files(frames.array_files(rows, "name", kind), f"file://{tmp_path}/out", "name", ".s3") == 2
    got = {r.path[-4]: (r.shape, r["values"]) for r in frames.read_arrays(spark, f"file://{tmp_path}/out", kind).collect()}
    assert got == {"a": ([2, 3], values), "b": ([6], values)}


def test_frames_of_rows_are_those_of_arrays(spark):
    for fe in (frontend.FrontEnd(rate=1000.0, window=0.032, n_fft=32, low=20.0, high=480.0), frontend.FrontEnd(rate=1000.0, frame_rate=50, window=0.012, n_fft=32, low=20.0, high=480.0)):
        pcm = [(None if n == 43 else n, 0, [(k * 7919) % 601 - 300 for k in range(n)]) for n in (1, 9, 10, 11, 12, 13, 20, 31, 32, 33, 41, 42, 43, 57)]
        u = spark.createDataFrame(pcm, "stream_id int, utt_seq int, pcm array<smallint>")
        rows = u.select("stream_id", "utt_seq", F.posexplode("pcm").alias("i", "value"))
        want, got = frontend.frames(u, fe, ["stream_id", "utt_seq"]), frontend.frames_of_rows(rows, fe, ["stream_id", "utt_seq"])
        assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_activity_is_the_same_in_any_batches(spark, mel):
    mel = mel.unionByName(mel.where("stream_id = 't'").withColumn("stream_id", F.lit(None).cast("string")))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = sorted(map(repr, activity.track(mel).collect()))
    was = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        assert sorted(map(repr, activity.track(mel).collect())) == whole and len(whole) == mel.count()
    finally:
        spark.conf.set(size, was)


def test_pitch_is_the_same_in_blocks(spark):
    x = np.random.default_rng(3).normal(0, 3000, 9000).astype(np.int16)
    u = spark.createDataFrame([("u", 0, x.tolist()), ("v", 0, tone(320, 4000).tolist())], "stream_id string, utt_seq int, pcm array<smallint>")
    framed = frontend.frames(u, FE, ["stream_id", "utt_seq"])
    track = lambda **k: sorted(map(repr, pitch.track(framed, ["stream_id", "utt_seq"], FE.rate, **k).collect()))
    assert track(block=6) == track(block=4) == track()


def test_signal_queries_hold_no_stream_in_a_row(spark):
    from auralake.plans import queries as plans

    samples = plans._signal(spark, "/root/testdata/sf0.001")
    assert not [c for c, kind in samples.dtypes if kind.startswith("array")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert samples.count() == events.count()
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = events.select("user_id", (F.row_number().over(by) - 1).alias("i"), F.round(F.col("value") * 100).cast("smallint").alias("v"))
    assert sorted(map(tuple, samples.select("stream_id", "i", "value").collect())) == sorted(map(tuple, want.collect()))
    plan = plans.noise_vad(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_extraction_from_files_to_feature_files(spark, tmp_path):
    """Audio files to cepstra of speech frames with noise taken off, against the same steps one after another."""
    rng = np.random.default_rng(9)
    quiet = rng.normal(0, 30, 12000)
    talk = quiet + np.concatenate([np.zeros(4000), 6000 * np.sin(2 * np.pi * 300 * np.arange(5000) / 16000) * (1 + np.sin(np.arange(5000) / 700)), np.zeros(3000)])
    for name, x in (("a", talk), ("b", quiet)):
        (tmp_path / f"{name}.wav").write_bytes(wav(np.clip(x, -32768, 32767).astype(np.int16)))
    read = audio.read_audio(spark, str(tmp_path / "*.wav")).select(F.regexp_extract("path", "([^/]*)$", 1).alias("stream_id"), F.lit(0).alias("utt_seq"), "pcm")
    got = {(r.stream_id, r.frame_no): r.c for r in frontend.extract(read, FE).collect()}
    want, counts = {}, {}
    for u in read.collect():
        x = np.array(u.pcm, dtype=float)
        cut = [(x[i : i + FE.size], x[i - 1] if i else 0.0) for i in range(0, len(x), FE.shift)]
        n = 1 if len(x) < FE.size else (len(x) - FE.size) // FE.shift + 2
        mel = FE.spectrum([s for s, _ in cut[:n]], np.array([p for _, p in cut[:n]]))
        tracker, hangover = activity.NoiseTracker(), activity.Hangover()
        for i, m in enumerate(mel):
            clean, speech = tracker.step(m)
            for k, c in hangover.step((i, clean), speech):
                want[u.stream_id, k] = FE.cepstra(c[None])[0]
        counts[u.stream_id] = n
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    spoken = {k for s, k in got if s == "a.wav"}
    assert spoken
    every = frontend.extract(read, FE, remove_noise=False, remove_silence=False)
    assert every.count() == sum(counts.values())
    assert frames.write_files(frames.frame_files(every.drop("utt_seq"), "stream_id"), f"file://{tmp_path}/out", "stream_id", ".feat") == 2
    assert frames.read_frames(spark, f"{tmp_path}/out/*.feat").count() == sum(counts.values())


def test_text_reports(spark):
    segs = spark.createDataFrame([("s", 0, 12, 30)], "stream_id string, seg_no int, start_frame int, n_frames long")
    assert activity.report_lines(segs, 160).first().line == "segment 0 of s: from 0.1 s, 4800 samples, 0.30 s"
    tracked = spark.createDataFrame([("s", 3, 0.03, 0.987, 123.456)], "stream_id string, frame_no int, t double, voicing double, f0 double")
    assert pitch.text_lines(tracked, ["stream_id"]).first().line == "0.030 0.99 123.46"
