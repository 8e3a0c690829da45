"""Live framing and features over typed state, against the batch operators."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import dynamic, frontend
from auralake.streaming import stateful


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, stateful.ROCKS)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(spark, tmp_path, batches, schema, operator, name):
    """The rows that an operator lets out for micro-batches, one after the other."""
    folder = tmp_path / name
    os.makedirs(folder / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
        query = operator(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()  # each batch restarts the query from its state
    return spark.read.parquet(f"{folder}/out").collect()


SIZES = [(4, 2), (5, 5), (3, 7), (8, 3)]


@pytest.mark.parametrize("size, shift", SIZES)
def test_frames_of_any_chunks(spark, size, shift):
    r = random.Random(size * 10 + shift)
    fe = frontend.FrontEnd(rate=1000.0, frame_rate=1000 // shift if 1000 % shift == 0 else 1000 / shift, window=size / 1000, n_fft=8, n_filt=1, n_cep=1, low=20.0, high=480.0, round_filters=False)
    fe = type("Cut", (), {"size": size, "shift": shift})() if (fe.size, fe.shift) != (size, shift) else fe
    rows = [(u, [r.randint(-9, 9) for _ in range(n)]) for u, n in enumerate((0, 1, 2, 3, 4, 5, 7, 8, 9, 20, 31))]
    want = {u: [] for u, _ in rows}
    for x in frontend.frames(spark.createDataFrame(rows, "u int, pcm array<smallint>"), fe, ["u"]).orderBy("u", "frame_no").collect():
        want[x.u].append((x.frame_no, x.samples, x.prior))
    for u, pcm in rows:
        for _ in range(6):
            m, got, at = stateful.Frames(size, shift), [], 0
            while at < len(pcm):
                n = r.randint(0, 6)
                got += m.add(np.array(pcm[at : at + n], dtype=np.int16))
                m = stateful.Frames(size, shift, m.frame_no, m.prior, m.skip, m.rest.tolist())  # through the state
                at += n
            assert got + m.flush() == want[u]


@pytest.mark.parametrize("kind", [*dynamic.SHAPES, "6,7:2"])
def test_rings_of_every_type(spark, kind):
    r = random.Random(1)
    frames = {u: [np.array([r.random() for _ in range(13)]) for _ in range(n)] for u, n in enumerate((1, 2, 5, 9, 23))}
    df = spark.createDataFrame([(u, i, c.tolist()) for u, cs in frames.items() for i, c in enumerate(cs)], "u int, frame_no int, c array<double>")
    want = {(x.u, x.frame_no): x.feat for x in dynamic.features(df, kind, ["u"]).collect()}
    for u, cs in frames.items():
        for step in (1, 3, 50):
            m, got = stateful.Ring(kind, 13), []
            for a in range(0, len(cs), step):
                got += m.add(cs[a : a + step], False)
                m = stateful.Ring(kind, 13, [x.tolist() for x in m.held], m.next)
            got += m.add([], True)
            assert [n for n, _ in got] == list(range(len(cs)))
            for n, feat in got:
                assert len(feat) == len(want[u, n]) and all(a == pytest.approx(b) for a, b in zip(feat, want[u, n], strict=True))
    assert stateful.Ring(kind, 13).add([], True) == []


def test_wrong_types_and_stores(spark):
    with pytest.raises(ValueError):
        stateful.Features("s2_4x", 12)
    with pytest.raises(ValueError):
        stateful.Features("3,4:1", 13)
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        with pytest.raises(RuntimeError, match="RocksDB"):
            stateful.live_features(spark.readStream.format("rate").load().select(F.lit("a").alias("stream_id")), "1s_c")


def test_live_framing(rocks, tmp_path):
    r = random.Random(5)
    fe = frontend.FrontEnd(rate=1000.0, frame_rate=250, window=0.01, n_fft=16, n_filt=1, n_cep=1, low=20.0, high=480.0, round_filters=False)
    whole = {(s, u): [r.randint(-999, 999) for _ in range(r.choice([3, 40, 90]))] for s in "ab" for u in range(3)}
    schema = "stream_id string, utt_seq int, chunk_no long, pcm array<smallint>, last boolean"
    batches: list[list] = [[], [], [], []]
    for (s, u), pcm in whole.items():
        cuts = sorted(r.sample(range(len(pcm) + 1), min(6, len(pcm))))
        parts = [pcm[a:b] for a, b in zip([0, *cuts], [*cuts, len(pcm)], strict=True)]
        # an utterance's chunks lie in one micro-batch or in consecutive ones; the end of utterance 1 is never said
        for i, p in enumerate(parts):
            batches[min(3, u + (i >= len(parts) // 2))].append((s, u, i, p or None, i == len(parts) - 1 and u != 1))
    for b in batches:
        r.shuffle(b)
    batches[2].append(("a", 0, 0, [1, 2, 3], False))  # late: an utterance that is over
    batches.append([("b", 2, 0, [7] * 50, True)])  # late: behind the end of its utterance
    got = {}
    for x in run(rocks, tmp_path, batches, schema, lambda s: stateful.frame_chunks(s, fe), "framing"):
        got.setdefault((x.stream_id, x.utt_seq), {})[x.frame_no] = (x.samples, x.prior)
    rows = [(s, u, pcm) for (s, u), pcm in whole.items()]
    want = {}
    for x in frontend.frames(rocks.createDataFrame(rows, "stream_id string, utt_seq int, pcm array<smallint>"), fe, ["stream_id", "utt_seq"]).collect():
        want.setdefault((x.stream_id, x.utt_seq), {})[x.frame_no] = (x.samples, x.prior)
    assert got == want


def test_live_features_and_their_state(rocks, tmp_path):
    r = random.Random(6)
    frames = [("a", u, i, [r.random() for _ in range(13)], i == n - 1) for u, n in ((0, 7), (1, 12)) for i in range(n)]
    schema = "stream_id string, utt_seq int, frame_no int, c array<double>, last boolean"
    operator = lambda s: stateful.live_features(s, "s2_4x")
    rows = run(rocks, tmp_path, [frames[:3], frames[3:9], frames[9:]], schema, operator, "ring")
    want = {(x.utt_seq, x.frame_no): x.feat for x in dynamic.features(rocks.createDataFrame(frames, schema), "s2_4x", ["utt_seq"]).collect()}
    assert len(rows) == len(want) and all(a == pytest.approx(b) for x in rows for a, b in zip(x.feat, want[x.utt_seq, x.frame_no], strict=True))
    # the state is a table that other code can read
    path = f"{tmp_path}/ring/state"
    held = rocks.read.format("statestore").option("stateVarName", "place").load(path).collect()
    assert len(held) == 1 and held[0]["value"]["utt"] == 1 and not held[0]["value"]["open"]
