"""Live forms of the operators that remember: one state for each stream, kept in Spark's state store.

Frames arrive as rows (stream, utt_seq, frame_no, vector, and `last` on an utterance's last frame). Within a
micro-batch they are put in order; a frame at or before the newest one seen is late and left out, since these
recurrences can't take it back. A stream that is silent for the timeout is forgotten. The same machines run
over a batch table by `over_batch`, which the tests hold against the streaming form."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.activity import Hangover, NoiseTracker
from ..operators.running import GAIN_UTTERANCES, MEAN_LIMIT, MEAN_WINDOW



@dataclass
class LiveMean:
    """Subtracts the current mean of frames with a first coefficient of at least zero. The mean moves only between chunks: when
    over MEAN_LIMIT frames are in, and at an utterance's end. So the result depends on the chunks, here the micro-batches."""

    mean: np.ndarray
    total: np.ndarray = None
    n: float = 0.0

    def __post_init__(self) -> None:
        self.mean = np.asarray(self.mean, dtype=float)
        self.total = self.mean * MEAN_WINDOW if self.total is None else self.total
        self.n = self.n or MEAN_WINDOW

    def chunk(self, x: np.ndarray, last: bool) -> np.ndarray:
        out, used = x - self.mean, x[x[:, 0] >= 0]
        self.total, self.n = self.total + used.sum(axis=0), self.n + len(used)
        if self.n > MEAN_LIMIT or last:
            self.mean = self.total / self.n
            if self.n > MEAN_LIMIT:
                self.total, self.n = self.mean * MEAN_WINDOW, float(MEAN_WINDOW)
        return out


@dataclass
class LiveGain:
    """Subtracts from the first coefficient an estimate of its maximum: the mean of the maxima of past utterances."""

    estimate: float = 5.0
    highest: float | None = None
    total: float = 0.0
    utterances: int = 0

    def chunk(self, x: np.ndarray, last: bool) -> np.ndarray:
        if len(x):
            self.highest = max(x[:, 0].max(), -np.inf if self.highest is None else self.highest)
        x = x.copy()
        x[:, 0] -= self.estimate
        if last and self.highest is not None:
            self.total, self.utterances, self.highest = self.total + self.highest, self.utterances + 1, None
            self.estimate = self.total / self.utterances
            if self.utterances == GAIN_UTTERANCES:
                self.total, self.utterances = self.total / 2, GAIN_UTTERANCES // 2
        return x


@dataclass
class DeltaRing:
    """Vectors with their delta and double delta, three frames late; the edges replicate, so chunks don't show."""

    held: list = field(default_factory=list)
    before: int = 0

    def chunk(self, x: np.ndarray, last: bool) -> np.ndarray:
        if not self.held and len(x):
            self.held, self.before = [x[0]] * 3, 3
        self.held += list(x)
        if last and self.held:
            self.held += [self.held[-1]] * 3
        h, out = np.array(self.held), []
        for i in range(3, len(h) - 3):
            out.append(np.concatenate([h[i], h[i + 2] - h[i - 2], (h[i + 3] - h[i - 1]) - (h[i + 1] - h[i - 3])]))
        self.held = [] if last else self.held[max(0, len(h) - 6) :] if len(h) >= 6 else self.held
        return np.array(out)


class Normaliser:
    """Mean and gain of one stream, frame for frame."""

    output = "frame_no int, c array<double>"

    def __init__(self, mean: list[float], gain: float | None = None):
        self.steps = [LiveMean(np.array(mean))] + ([LiveGain(gain)] if gain is not None else [])

    def rows(self, utt: int, frames: pd.DataFrame, last: bool) -> pd.DataFrame:
        x = np.stack(frames["c"].to_list()).astype(float)
        for s in self.steps:
            x = s.chunk(x, last)
        return pd.DataFrame({"frame_no": frames["frame_no"].to_numpy(), "c": list(x)})


class Deltas:
    """Dynamic features of one stream, a few frames late."""

    output = "frame_no int, c array<double>"

    def __init__(self):
        self.ring, self.next = DeltaRing(), 0

    def rows(self, utt: int, frames: pd.DataFrame, last: bool) -> pd.DataFrame:
        out = self.ring.chunk(np.stack(frames["c"].to_list()).astype(float), last)
        at = self.next + np.arange(len(out))
        self.next = 0 if last else self.next + len(out)
        return pd.DataFrame({"frame_no": at, "c": list(out)})


class Activity:
    """Noise removal and hangover of one stream: noise statistics outlive utterances, the hangover doesn't."""

    output = "frame_no int, c array<double>"

    def __init__(self, **options):
        self.tracker, self.hangover = NoiseTracker(**options), Hangover()

    def rows(self, utt: int, frames: pd.DataFrame, last: bool) -> pd.DataFrame:
        out = []
        for n, c in zip(frames["frame_no"], frames["c"], strict=True):
            clean, speech = self.tracker.step(np.asarray(c, dtype=float))
            out += self.hangover.step((n, clean), speech) if self.tracker.remove_silence else [(n, clean)]
        if last:
            self.hangover = Hangover()
        return pd.DataFrame(out, columns=["frame_no", "c"])


def _advance(machine, newest: tuple, frames: pd.DataFrame) -> tuple[tuple, list[pd.DataFrame]]:
    """Runs a machine over the frames that aren't late, utterance by utterance."""
    frames = frames.sort_values(["utt_seq", "frame_no"], kind="stable").drop_duplicates(["utt_seq", "frame_no"])
    keys = list(zip(frames["utt_seq"].tolist(), frames["frame_no"].tolist(), strict=True))
    frames = frames[[k > newest for k in keys]]
    out = []
    for utt, part in frames.groupby("utt_seq", sort=True):
        rows = machine.rows(utt, part, bool(part["last"].iloc[-1]))
        if len(rows):
            rows.insert(0, "utt_seq", utt)
            out.append(rows)
    return max([newest, *keys]), out


def run_live(frames: DataFrame, machine: Callable[[], object], stream: str = "stream_id", timeout_ms: int | None = 600_000) -> DataFrame:
    """The streaming form: rows of the machine's output by stream, in append mode. Without a timeout no stream is forgotten,
    and a query over a finite source ends."""
    schema = f"{stream} {frames.schema[stream].dataType.simpleString()}, utt_seq int, {machine().output}"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, newest = pickle.loads(state.get[0]) if state.exists else (machine(), (-1, -1))
        newest, out = _advance(held, newest, pd.concat(list(batches)))
        state.update((pickle.dumps((held, newest)),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        for rows in out:
            rows.insert(0, stream, key[0])
            yield rows

    return frames.groupBy(stream).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def over_batch(frames: DataFrame, machine: Callable[[], object], stream: str = "stream_id") -> DataFrame:
    """The same over a whole table: one group a stream, one chunk an utterance."""
    schema = f"{stream} {frames.schema[stream].dataType.simpleString()}, utt_seq int, {machine().output}"
    names = [stream, "utt_seq", "frame_no", "c"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = _advance(machine(), (-1, -1), rows)[1]
        whole = pd.concat(out) if out else pd.DataFrame(columns=names[1:])
        whole.insert(0, stream, key[0])
        return whole

    return frames.groupBy(stream).applyInPandas(run, schema)
