"""Running estimates over whole tables: what a stream's utterances leave behind for the ones after them.

Two levels. Frames add up by utterance (sum, number, maximum: partial aggregates); the recurrence then runs over one row for each
utterance, in sorted batches of a stream; its estimates join back to the frames. So no task holds a stream's frames, and
a stream's utterances pass in bounded memory. Results equal those of the live operators when each utterance is one chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalise import _join_back, _replace_first

# When the running mean is renewed, and what it then counts for; utterances after which the observed maxima count half.
MEAN_LIMIT, MEAN_WINDOW = 800, 500
GAIN_UTTERANCES = 16
START_GAIN = {True: 5.0, False: 10.0}


class RunningMean:
    """The mean in force for each utterance, from the sums of those before."""

    def __init__(self, start: list[float]):
        self.mean = np.array(start, dtype=float)
        self.total, self.n = self.mean * MEAN_WINDOW, float(MEAN_WINDOW)

    def step(self, total: list[float], n: int) -> list[float]:
        before = self.mean.tolist()
        self.total, self.n = self.total + np.array(total, dtype=float), self.n + n
        self.mean = self.total / self.n
        if self.n > MEAN_LIMIT:
            self.total, self.n = self.mean * MEAN_WINDOW, float(MEAN_WINDOW)
        return before


class RunningGain:
    """The estimate of the maximum in force for each utterance."""

    def __init__(self, start: float):
        self.estimate, self.total, self.n = start, 0.0, 0

    def step(self, top: float | None) -> float:
        before = self.estimate
        if top is not None:
            self.total, self.n = self.total + top, self.n + 1
            self.estimate = self.total / self.n
            if self.n == GAIN_UTTERANCES:
                self.total, self.n = self.total / 2, GAIN_UTTERANCES // 2
        return before


def over_utterances(rows: DataFrame, stream: str, utterance: str, machine: Callable[[], object], inputs: list[str], name: str, kind: str) -> DataFrame:
    """stream, utterance and `name`: what a machine's step returns for the inputs of each utterance of a stream, in order (null
    utterances last), from one machine a stream."""
    s_kind, u_kind = (rows.schema[c].dataType.simpleString() for c in (stream, utterance))
    out_type = pa.list_(pa.float64()) if kind.startswith("array") else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            found = []
            for s, *values in zip(batch.column(0).to_pylist(), *[batch.column(i + 2).to_pylist() for i in range(len(inputs))], strict=True):
                if state is None or not (s == last or s != s and last != last):
                    state, last = machine(), s
                found.append(state.step(*values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, out_type)], [stream, utterance, name])

    ordered = rows.select(stream, utterance, *inputs).repartition(stream).sortWithinPartitions(stream, F.col(utterance).asc_nulls_last())
    return ordered.mapInArrow(run, f"{stream} {s_kind}, {utterance} {u_kind}, {name} {kind}")


def mean_norm(frames: DataFrame, stream: str, utterance: str, start: list[float], vector: str = "c") -> DataFrame:
    """frames with the vector less the running mean of the stream's utterances before, from `start` on. Only frames with
    a first coefficient of at least zero count for it; all are shifted."""
    width = len(start)
    x = lambda i: F.get(vector, F.lit(i)).cast("double")
    voiced = x(0) >= 0
    sums = frames.groupBy(stream, utterance).agg(F.array(*[F.coalesce(F.sum(F.when(voiced, x(i))), F.lit(0.0)) for i in range(width)]).alias("_t"), F.count(F.when(voiced, 1)).alias("_n"))
    means = over_utterances(sums, stream, utterance, lambda: RunningMean(start), ["_t", "_n"], "_mean", "array<double>")
    met = _join_back(frames, means, [stream, utterance])
    return met.withColumn(vector, F.zip_with(vector, "_mean", lambda a, m: a - m)).select(*frames.columns)


def gain_emax(frames: DataFrame, stream: str, utterance: str, start: float = START_GAIN[True], vector: str = "c") -> DataFrame:
    """frames with the first coefficient less the running estimate of its maximum: the mean of the maxima of the stream's
    utterances before, which count half after every GAIN_UTTERANCES."""
    first = F.get(vector, F.lit(0)).cast("double")
    tops = frames.groupBy(stream, utterance).agg(F.max(first).alias("_top"))
    estimates = over_utterances(tops, stream, utterance, lambda: RunningGain(start), ["_top"], "_gain", "double")
    met = _join_back(frames, estimates, [stream, utterance])
    return met.withColumn(vector, _replace_first(vector, first - F.col("_gain"))).select(*frames.columns)


def normalise(frames: DataFrame, stream: str, utterance: str, mean: list[float], gain: float | None = None, vector: str = "c") -> DataFrame:
    """The running mean, then the running gain of the shifted frames: what the live operators do to a stream, over a table."""
    out = mean_norm(frames, stream, utterance, mean, vector)
    return out if gain is None else gain_emax(out, stream, utterance, gain, vector)
