"""Live operators over typed state: framing of sample chunks, and dynamic features of every type.

Each operator is a processor for `transformWithState`: what it remembers of a stream is a value state with named, typed columns and
a list state of rows, so a changed class reads the state of the one before, and Spark can show it as a table. Streams that are
silent for a while are forgotten by a timer, after what they still owe is let out.

Rows that come late, that is at or before the newest chunk or frame seen of their stream, are left out: samples that follow have been
framed already. Within a micro-batch rows are put in order. `last` ends an utterance; so does the first row of a later one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import dynamic
from ..operators.frontend import FrontEnd

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Frames:
    """The frames of one utterance, from its samples in chunks: each full frame as soon as its samples are there, and the partial
    one at the end."""

    def __init__(self, size: int, shift: int, frame_no: int = 0, prior: int = 0, skip: int = 0, rest: list[int] = ()):  # type: ignore[assignment]
        self.size, self.shift = size, shift
        self.frame_no, self.prior, self.skip, self.rest = frame_no, prior, skip, np.array(rest, dtype=np.int16)

    def add(self, samples: np.ndarray) -> list[tuple[int, list[int], float]]:
        """(frame number, samples, sample before) of the frames that these samples complete."""
        if self.skip and len(samples):  # between frames further apart than their size
            n = min(self.skip, len(samples))
            self.prior, self.skip, samples = int(samples[n - 1]), self.skip - n, samples[n:]
        x = np.concatenate([self.rest, samples])
        out, at = [], 0
        while len(x) - at >= self.size:
            out.append((self.frame_no, x[at : at + self.size].tolist(), float(self.prior)))
            self.frame_no += 1
            if len(x) - at < self.shift:
                self.prior, self.skip, at = int(x[-1]), self.shift - (len(x) - at), len(x)
                break
            at += self.shift
            self.prior = int(x[at - 1])
        self.rest = x[at:]
        return out

    def flush(self) -> list[tuple[int, list[int], float]]:
        return [(self.frame_no, self.rest.tolist(), float(self.prior))] if len(self.rest) else []


class Ring:
    """The features of one utterance's frames, as late as the type looks ahead; its edges replicate."""

    def __init__(self, kind: str, width: int, held: list[list[float]] = (), before: int = 0):  # type: ignore[assignment]
        self.reach, self.shape = dynamic.reach(kind), dynamic.shape_of(kind, width)
        self.width, self.held, self.next = width, [np.asarray(x, dtype=float) for x in held], before

    def add(self, frames: list[np.ndarray], last: bool) -> list[tuple[int, list[list[float]]]]:
        """(number of the frame within its utterance, streams)."""
        if not self.held and frames:
            self.held = [frames[0]] * self.reach
        self.held += frames
        if last and self.held:
            self.held += [self.held[-1]] * self.reach
        n = len(self.held) - 2 * self.reach
        if n <= 0:
            return []
        x = np.stack(self.held)
        part = lambda p: sum(w * x[self.reach + k : self.reach + k + n] for k, w in (dynamic.PARTS[p] if isinstance(p, str) else p).items())
        streams = [np.concatenate([part(p)[:, a : a + (m or self.width)] for p, a, m in stream], axis=1) for stream in self.shape]
        out = [(self.next + i, [s[i].tolist() for s in streams]) for i in range(n)]
        self.next += n
        self.held = self.held[n:]
        return out


class _Live(StatefulProcessor):
    """Order, lateness, ends of utterances and forgetting, which the operators share."""

    #: The column that orders the rows of an utterance, and columns of the value state besides place.
    order: str
    state: str
    rows: str

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "utt int, newest long, open boolean")
        self.value = handle.getValueState("value", self.state)
        self.list = handle.getListState("rows", self.rows)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows)).sort_values(["utt_seq", self.order], kind="stable").drop_duplicates(["utt_seq", self.order])
        utt, newest, open_ = self.place.get() if self.place.exists() else (-1, -1, False)
        machine = self.load() if open_ else None
        out = []
        for u, part in whole.groupby("utt_seq", sort=True):
            part = part[part[self.order] > newest] if u == utt else part
            if u < utt or not len(part):
                continue
            if u > utt and open_:  # its end was never said
                out += [(int(utt), *r) for r in self.end(machine)]
            if u > utt or not open_:
                if u == utt:
                    continue  # behind the end of its utterance
                machine = self.start()
            last = bool(part["last"].iloc[-1])
            out += [(int(u), *r) for r in self.step(machine, part)]
            if last:
                out += [(int(u), *r) for r in self.end(machine)]
            utt, newest, open_ = int(u), int(part[self.order].iloc[-1]), not last
        self.place.update((utt, newest, open_))
        if open_:
            self.save(machine)
        else:
            self.value.clear()
            self.list.clear()
        if self.timeout_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        utt, _, open_ = self.place.get() if self.place.exists() else (-1, -1, False)
        out = [(int(utt), *r) for r in self.end(self.load())] if open_ else []
        for s in (self.place, self.value, self.list):
            s.clear()
        yield self.frame(key, out)

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.columns)


class Framing(_Live):
    """Chunks of samples (stream, utt_seq, chunk_no, pcm, last) into frames."""

    order, state, rows = "chunk_no", "frame_no int, prior int, skip int", "sample smallint"
    columns = ("stream_id", "utt_seq", "frame_no", "samples", "prior")

    def __init__(self, size: int, shift: int, timeout_ms: int | None = None):
        super().__init__(timeout_ms)
        self.size, self.shift = size, shift

    def start(self) -> Frames:
        return Frames(self.size, self.shift)

    def load(self) -> Frames:
        return Frames(self.size, self.shift, *self.value.get(), [r[0] for r in self.list.get()])

    def save(self, m: Frames) -> None:
        self.value.update((m.frame_no, m.prior, m.skip))
        if len(m.rest):
            self.list.put([(int(v),) for v in m.rest])
        else:
            self.list.clear()

    def step(self, m: Frames, part: pd.DataFrame) -> list[tuple]:
        return [f for pcm in part["pcm"] if pcm is not None for f in m.add(np.asarray(pcm, dtype=np.int16))]

    def end(self, m: Frames) -> list[tuple]:
        return m.flush()


class Features(_Live):
    """Frames (stream, utt_seq, frame_no, c, last) into features of any type."""

    order, state, rows = "frame_no", "before int", "c array<double>"
    columns = ("stream_id", "utt_seq", "frame_no", "feat")

    def __init__(self, kind: str, width: int, timeout_ms: int | None = None):
        super().__init__(timeout_ms)
        self.kind, self.width = kind, width
        dynamic.shape_of(kind, width)

    def start(self) -> Ring:
        return Ring(self.kind, self.width)

    def load(self) -> Ring:
        return Ring(self.kind, self.width, [r[0] for r in self.list.get()], *self.value.get())

    def save(self, m: Ring) -> None:
        self.value.update((m.next,))
        if m.held:
            self.list.put([(x.tolist(),) for x in m.held])
        else:
            self.list.clear()

    def step(self, m: Ring, part: pd.DataFrame) -> list[tuple]:
        return m.add([np.asarray(c, dtype=float) for c in part["c"]], False)

    def end(self, m: Ring) -> list[tuple]:
        return m.add([], True)


def _run(rows: DataFrame, stream: str, processor: Callable[[], _Live], fields: str, timeout_ms: int | None) -> DataFrame:
    provider = rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "RocksDB" not in provider:
        raise RuntimeError(f"typed state needs the RocksDB state store: set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    kind = rows.schema[stream].dataType.simpleString()
    schema = T._parse_datatype_string(f"stream_id {kind}, utt_seq int, {fields}")
    grouped = rows.withColumnRenamed(stream, "stream_id").groupBy("stream_id")
    return grouped.transformWithStateInPandas(processor(), schema, "Append", "none" if timeout_ms is None else "ProcessingTime")


def frame_chunks(chunks: DataFrame, fe: FrontEnd, stream: str = "stream_id", timeout_ms: int | None = None) -> DataFrame:
    """stream_id, utt_seq, frame_no, samples and prior of a stream of sample chunks (stream, utt_seq int, chunk_no, pcm
    array<smallint>, last): what `frontend.frames` gives for whole utterances, however they are cut into chunks. A null chunk has no
    samples; a chunk that comes after a later one of its stream is left out. Emphasis and spectra follow as in a batch."""
    return _run(chunks, stream, lambda: Framing(fe.size, fe.shift, timeout_ms), "frame_no int, samples array<smallint>, prior double", timeout_ms)


def live_features(frames: DataFrame, kind: str, width: int = 13, stream: str = "stream_id", timeout_ms: int | None = None) -> DataFrame:
    """stream_id, utt_seq, frame_no (from 0, in the order of frames) and feat (array of streams) of a stream of frames (stream,
    utt_seq int, frame_no, c array<double>, last): what `dynamic.features` gives for whole utterances, for every type."""
    return _run(frames, stream, lambda: Features(kind, width, timeout_ms), "frame_no int, feat array<array<double>>", timeout_ms)
