"""Noise tracking, noise removal and voice activity: recurrences over the frames of a stream.

A stream is one group of rows, in the order of its utterances and frames; its state passes from one frame to the next,
vectorised over the filters. The same state object serves batches (sorted, by stream) and live streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from . import order

# The constants of the noise tracker and of the hangover.
POWER = 0.7
RISE, FALL = 0.995, 0.5
MASK, MASKED = 0.85, 0.2
MAX_GAIN = 20.0
SMOOTH = 4
PEAK_LEARN, PEAK_FORGET = 0.9, 0.9995
VOLUME_RANGE = 8.0
PRE_SPEECH, START_SPEECH, POST_SPEECH = 20, 10, 50
VAD_THRESHOLD = 3.0


def _envelope(env: np.ndarray, x: np.ndarray) -> np.ndarray:
    rate = np.where(x >= env, RISE, FALL)
    return rate * env + (1 - rate) * x


@dataclass
class NoiseTracker:
    """What a stream remembers: smoothed power, noise, floor and peak of each filter, and the slow peak of volume. It
    outlives utterances, not streams."""

    remove_noise: bool = True
    remove_silence: bool = True
    threshold: float = VAD_THRESHOLD
    state: dict = field(default_factory=dict)

    def step(self, mel: np.ndarray) -> tuple[np.ndarray, bool]:
        """(mel spectrum with less noise, whether the frame is speech)."""
        if not self.remove_noise and not self.remove_silence:
            return mel, True
        s = self.state
        if not s:
            s.update(power=mel, noise=mel / MAX_GAIN, floor=mel / MAX_GAIN, peak=np.zeros_like(mel), slow=0.0)
        s["power"] = POWER * s["power"] + (1 - POWER) * mel
        s["noise"] = _envelope(s["noise"], s["power"])
        signal = np.maximum(s["power"] - s["noise"], 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = max(0.0, float(np.nan_to_num(np.log(s["power"] / s["noise"]), nan=0.0, neginf=0.0).max(initial=0.0)))
        volume = float(np.log(signal.sum()))
        keep = PEAK_LEARN if volume > s["slow"] else PEAK_FORGET
        s["slow"] = keep * s["slow"] + (1 - keep) * volume
        speech = not (self.remove_silence and (ratio < self.threshold or s["slow"] - VOLUME_RANGE > volume))
        s["floor"] = _envelope(s["floor"], signal)
        s["peak"] = s["peak"] * MASK
        masked = np.where(signal < MASK * s["peak"], s["peak"] * MASKED, signal)
        s["peak"] = np.maximum(s["peak"], signal)
        if not self.remove_noise:
            return mel, speech
        masked = np.maximum(masked, s["floor"])
        gain = np.clip(np.divide(masked, s["power"], out=np.full_like(masked, MAX_GAIN), where=s["power"] > 0), 1 / MAX_GAIN, MAX_GAIN)
        return mel * smooth(gain), speech


def smooth(gain: np.ndarray) -> np.ndarray:
    """The mean of each filter with up to SMOOTH neighbours on either side."""
    sums, n = np.concatenate([[0.0], np.cumsum(gain)]), len(gain)
    low, high = np.maximum(np.arange(n) - SMOOTH, 0), np.minimum(np.arange(n) + SMOOTH + 1, n)
    return (sums[high] - sums[low]) / (high - low)


@dataclass
class Hangover:
    """Speech begins after START_SPEECH speech frames in a row, and reaches back over PRE_SPEECH more; it ends after
    POST_SPEECH others in a row, of which the last isn't part of it."""

    pre: int = PRE_SPEECH
    start: int = START_SPEECH
    post: int = POST_SPEECH
    inside: bool = False
    run: int = 0
    held: list = field(default_factory=list)

    def step(self, frame: object, speech: bool) -> list:
        """The frames that leave with this one."""
        if not self.inside:
            self.held = [*self.held[-self.pre :], frame]
        self.run = self.run + 1 if speech != self.inside else 0
        if not self.inside and self.run >= self.start:
            self.inside, self.run, out = True, 0, self.held
            self.held = []
            return out
        if self.inside and self.run >= self.post:
            self.inside, self.run, self.held = False, 0, []
            return []
        return [frame] if self.inside else []


def segments_of(speech: np.ndarray, pre: int = PRE_SPEECH, start: int = START_SPEECH, post: int = POST_SPEECH) -> list[tuple[int, int]]:
    """(first frame, frames) of each stretch of an utterance that the hangover lets out."""
    h, out, last = Hangover(pre, start, post), [], None
    for i, s in enumerate(speech):
        for f in h.step(i, bool(s)):
            if last is None or f != last + 1:
                out.append([f, 0])
            out[-1][1] += 1
            last = f
        if not h.inside:
            last = None
    return [tuple(x) for x in out]


def track(mel: DataFrame, stream: str = "stream_id", utterance: str = "utt_seq", remove_noise: bool = True, remove_silence: bool = True, threshold: float = VAD_THRESHOLD) -> DataFrame:
    """stream, utterance, frame_no, mel (with less noise), speech (of the frame itself) and emitted (after hangover).

    Streams run in parallel; within one, order matters, so utterances need their number. Its frames pass in sorted batches,
    of which the state and the few frames that the hangover may still let out stay in memory."""
    kind = mel.schema[stream].dataType.simpleString()
    uk = mel.schema[utterance].dataType.simpleString()

    def same(a: object, b: object) -> bool:
        return a == b or (a != a and b != b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[list] = []  # the hangover may still let out the last ones
        last = tracker = hangover = None

        def leave(n: int) -> Iterator[pa.RecordBatch]:
            if n > 0:
                out = list(zip(*open_rows[:n], strict=True))
                del open_rows[:n]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], [stream, utterance, "frame_no", "mel", "speech", "emitted"])

        for batch in batches:
            ids = [batch.column(stream), batch.column(utterance)]
            types = [*[c.type for c in ids], pa.int32(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
            for s, u, no, m in zip(*[c.to_pylist() for c in ids], batch.column("frame_no").to_pylist(), batch.column("mel").to_pylist(), strict=True):
                if last is None or not same(s, last[0]):
                    tracker, hangover = NoiseTracker(remove_noise, remove_silence, threshold), Hangover()
                elif not same(u, last[1]):
                    hangover = Hangover()
                last = (s, u)
                clean, speech = tracker.step(np.asarray(m, dtype=float))
                row = [s, u, no, clean, bool(speech), False]
                open_rows.append(row)
                for r in hangover.step(row, speech) if remove_silence else [row]:
                    r[-1] = True
            yield from leave(len(open_rows) - hangover.pre - 1 if hangover else 0)
        yield from leave(len(open_rows))

    ordered = mel.select(stream, utterance, "frame_no", "mel").repartition(stream).sortWithinPartitions(F.col(stream), F.col(utterance).asc_nulls_last(), "frame_no")
    return ordered.mapInArrow(run, f"{stream} {kind}, {utterance} {uk}, frame_no int, mel array<double>, speech boolean, emitted boolean")


#: Frames of a stream between two states that are written down.
CHUNK_FRAMES = 65_536
ARRAYS = ("power", "noise", "floor", "peak")


def _chunk_step(stream: str, utterance: str, options: tuple):
    """A function of a stream's frames of one chunk and its state at the chunk's start (one row or none): the frames that can't change any
    more, and the state at its end, in a row of its own (frame_no null)."""
    names = [stream, utterance, "frame_no", "mel", "speech", "emitted", "began", *ARRAYS, "slow", "inside", "run", "h_utt", "h_no", "h_mel", "h_speech"]

    def none(x: object) -> object:
        return None if pd.isna(x) else x

    def run(key: tuple, frames: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        tracker, hangover, utt, rows, open_rows = NoiseTracker(*options), Hangover(), None, [], []
        if len(state):
            s = state.iloc[0]
            if s["power"] is not None:
                tracker.state = {a: np.array(s[a], dtype=float) for a in ARRAYS} | {"slow": float(s["slow"])}
            hangover.inside, hangover.run, utt = bool(s["inside"]), int(s["run"]), none(s[utterance])
            open_rows = [[none(u), int(n), np.array(m, dtype=float), bool(p), False, False] for u, n, m, p in zip(s["h_utt"], s["h_no"], s["h_mel"], s["h_speech"], strict=True)]
            hangover.held = list(open_rows)
        fresh = not len(state)
        frames = frames.sort_values([utterance, "frame_no"], kind="stable", na_position="last")
        for u, n, m in zip(frames[utterance].tolist(), frames["frame_no"].tolist(), frames["mel"].tolist(), strict=True):
            u = none(u)
            if not fresh and u != utt:
                rows += open_rows
                open_rows, hangover = [], Hangover()
            fresh, utt = False, u
            clean, speech = tracker.step(np.asarray(m, dtype=float))
            row = [u, n, clean, bool(speech), False, False]
            if tracker.remove_silence:
                before = hangover.inside
                for r in hangover.step(row, speech):
                    r[4] = True
                row[5] = hangover.inside and not before
                open_rows.append(row)
                may = 0 if hangover.inside else len(hangover.held)
                rows += open_rows[: len(open_rows) - may]
                open_rows = open_rows[len(open_rows) - may :]
            else:
                row[4] = True
                rows.append(row)
        if not len(frames):  # the stream has ended before
            rows += open_rows
        out = [(key[0], *r, *[None] * 11) for r in rows]
        if len(frames):
            s = tracker.state
            kept = [s[a].tolist() for a in ARRAYS] if s else [None] * 4
            out.append((key[0], utt, None, None, None, None, None, *kept, s.get("slow"), hangover.inside, hangover.run, [r[0] for r in open_rows], [r[1] for r in open_rows], [r[2].tolist() for r in open_rows], [r[3] for r in open_rows]))
        got = pd.DataFrame(out, columns=names)
        for c in ("frame_no", "run"):
            got[c] = got[c].astype("Int32")
        for c in ("speech", "emitted", "began", "inside"):
            got[c] = got[c].astype("boolean")
        return got

    return run


def track_in_chunks(
    mel: DataFrame, folder: str | None = None, stream: str = "stream_id", utterance: str = "utt_seq", remove_noise: bool = True, remove_silence: bool = True, threshold: float = VAD_THRESHOLD, chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """As `track`, for streams too long to begin anew: also `began`, true for the frame that opens a stretch of speech.

    Streams are cut into chunks of so many frames. Each chunk is a job over all streams: a task takes a stream's frames of that chunk and the
    state that the chunk before left in the shared folder, so it holds one chunk of one stream, and a lost executor's
    tasks start again at their chunk. With a folder of the caller's, a run that was stopped goes on behind the last chunk
    that was finished; the frames must be the same ones then."""
    spark = mel.sparkSession
    folder = folder or tables.new_folder(spark, "chunks")
    kind, uk = mel.schema[stream].dataType.simpleString(), mel.schema[utterance].dataType.simpleString()
    frames_kind = f"{stream} {kind}, {utterance} {uk}, frame_no int, mel array<double>"
    if not tables.finished(spark, f"{folder}/frames"):
        rows = mel.select(stream, utterance, F.col("frame_no").cast("int").alias("frame_no"), "mel").withColumn("_none", F.col(utterance).isNull())
        placed = order.place(rows, [stream], ["_none", utterance, "frame_no"], "_at").drop("_none")
        placed.withColumn("_chunk", F.floor(F.col("_at") / chunk).cast("int")).drop("_at").write.mode("overwrite").partitionBy("_chunk").parquet(f"{folder}/frames")
    frames = spark.read.schema(f"{frames_kind}, _chunk int").parquet(f"{folder}/frames")
    arrays = ", ".join(f"{a} array<double>" for a in ARRAYS)
    schema = f"{frames_kind}, speech boolean, emitted boolean, began boolean, {arrays}, slow double, inside boolean, run int, h_utt array<{uk}>, h_no array<int>, h_mel array<array<double>>, h_speech array<boolean>"
    last = frames.agg(F.max("_chunk")).first()[0]
    step = _chunk_step(stream, utterance, (remove_noise, remove_silence, threshold))
    state = spark.createDataFrame([], schema)
    for c in range(-1 if last is None else last + 1):
        path = f"{folder}/step={c}"
        if not tables.finished(spark, path):
            own = frames.where(F.col("_chunk") == c).drop("_chunk")
            own.groupBy(stream).cogroup(state.groupBy(stream)).applyInPandas(step, schema).write.mode("overwrite").parquet(path)
        state = spark.read.schema(schema).parquet(path).where("frame_no is null")
    if last is None:
        return state.select(stream, utterance, "frame_no", "mel", "speech", "emitted", "began")
    every = spark.read.schema(schema).parquet(*[f"{folder}/step={c}" for c in range(last + 1)]).where("frame_no is not null")
    out = every.select(stream, utterance, "frame_no", "mel", "speech", "emitted", "began")
    held = state.select(stream, F.explode(F.arrays_zip("h_utt", "h_no", "h_mel", "h_speech")).alias("h"))
    return out.union(held.select(stream, "h.h_utt", "h.h_no", "h.h_mel", "h.h_speech", F.lit(False), F.lit(False)))


def segments(tracked: DataFrame, stream: str = "stream_id", utterance: str = "utt_seq", frame_rate: int = 100) -> DataFrame:
    """The stretches of emitted frames, gaps and islands over frame numbers: neighbours differ by a frame exactly where their
    places among the emitted ones do. Places come from `order.place`, so no task holds an utterance.

    Where the frames say which of them opened their stretch (`began`), `opened` is that frame."""
    keys, began = [stream, utterance], "began" in tracked.columns
    opened = F.when(F.col("began"), F.col("frame_no")) if began else F.lit(None).cast("long")
    islands = order.place(tracked.where("emitted").select(*keys, F.col("frame_no").cast("long").alias("frame_no"), opened.cast("long").alias("_o")), keys, ["frame_no"], "_i")
    out = islands.groupBy(*keys, (F.col("frame_no") - F.col("_i")).alias("_g")).agg(F.min("frame_no").alias("start_frame"), F.count(F.lit(1)).alias("n_frames"), F.max("_o").alias("opened"))
    numbered = order.place(out.select(*keys, "start_frame", "n_frames", "opened"), keys, ["start_frame"], "seg_no")
    return numbered.select(*keys, "seg_no", "start_frame", "n_frames", *(["opened"] if began else []), (F.col("start_frame") / frame_rate).alias("start_s"), (F.col("n_frames") / frame_rate).alias("length_s"))


def start_index(opened: Column, size: int, shift: int, pre: int = PRE_SPEECH) -> Column:
    """The frame that a segment is said to start at by the samples that were in when it opened: those of all frames before, less the
    frames that the hangover reaches back over. A stretch that opens early in a stream has a negative one."""
    return F.floor((F.lit(size) + (opened - 1) * shift) / F.lit(shift)) - pre


def segment_audio(segs: DataFrame, utterances: DataFrame, shift: int, size: int, keys: list[str], pcm: str = "pcm") -> DataFrame:
    """segs with the samples of their frames."""
    from pyspark.sql import functions as F

    met = segs.join(utterances.select(*keys, pcm), keys)
    return met.withColumn(pcm, F.slice(pcm, F.col("start_frame").cast("int") * shift + 1, (F.col("n_frames").cast("int") - 1) * shift + size))


def report_lines(segs: DataFrame, shift: int, stream: str = "stream_id", frame_rate: int = 100) -> DataFrame:
    """stream, seg_no and line: where each segment starts and how long it is."""
    line = F.format_string("segment %d of %s: from %.1f s, %d samples, %.2f s", F.col("seg_no").cast("int"), F.col(stream).cast("string"), F.col("start_frame") / frame_rate, (F.col("n_frames") * shift).cast("long"), F.col("n_frames") / frame_rate)
    return segs.select(stream, "seg_no", line.alias("line"))
