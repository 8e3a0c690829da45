"""Dynamic features: neighbours in time by lag and lead, edges replicated.

Frames are rows (utterance keys, frame number, vector). A missing neighbour is the nearest one there is, which a chain
of leads finds within the window's width, so no frame of an unbounded window is built."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import normalise


class Neighbours:
    """The vectors around each frame."""

    def __init__(self, utterance: list[str], frame: str, vector: str):
        self.window, self.vector = Window.partitionBy(*utterance).orderBy(frame), vector

    def __getitem__(self, k: int) -> Column:
        """The vector k frames on (back, if k is negative), or the last (first) there is."""
        step = F.lead if k > 0 else F.lag
        near = [step(self.vector, i).over(self.window) for i in range(abs(k), 0, -1)]
        return F.coalesce(*near, F.col(self.vector))


def _delta(x: Neighbours, k: int) -> Column:
    return vectors.subtract(x[k], x[-k])


def _double_delta(x: Neighbours) -> Column:
    return vectors.subtract(vectors.subtract(x[3], x[-1]), vectors.subtract(x[1], x[-3]))


def _part(c: Column, first: int, n: int) -> Column:
    return F.slice(c, first + 1, n)


def _stack(k: int) -> Callable[[Neighbours], list[Column]]:
    return lambda x: [F.concat(*[x[i] for i in range(-k, k + 1)])]


def _power_first(x: Neighbours) -> tuple[Column, Column, Column]:
    return x[0], _delta(x, 2), _double_delta(x)


def _streams_39(x: Neighbours) -> list[Column]:
    c, d, dd = _power_first(x)
    power = F.array(F.get(c, F.lit(0)), F.get(d, F.lit(0)), F.get(dd, F.lit(0)))
    return [F.concat(_part(c, 1, 12), _part(d, 1, 12), power, _part(dd, 1, 12))]


def _streams_4(x: Neighbours) -> list[Column]:
    c, d, dd = _power_first(x)
    power = F.array(F.get(c, F.lit(0)), F.get(d, F.lit(0)), F.get(dd, F.lit(0)))
    return [_part(c, 1, 12), F.concat(_part(d, 1, 12), _part(_delta(x, 4), 1, 12)), power, _part(dd, 1, 12)]


#: The streams of each feature type.
TYPES: dict[str, Callable[[Neighbours], list[Column]]] = {
    "1s_c": lambda x: [x[0]],
    "1s_c_d": lambda x: [F.concat(x[0], _delta(x, 2))],
    "1s_c_d_dd": lambda x: [F.concat(x[0], _delta(x, 2), _double_delta(x))],
    "1s_c_d_ld_dd": lambda x: [F.concat(x[0], _delta(x, 2), _delta(x, 4), _double_delta(x))],
    "s3_1x39": _streams_39,
    "s2_4x": _streams_4,
    "1s_3c": _stack(3),
    "1s_4c": _stack(4),
}
TYPES |= {"cep": TYPES["1s_c"], "cep_dcep": TYPES["1s_c_d"], "1s_12c_12d_3p_12dd": _streams_39}


#: The same streams as pieces (part, first dimension, number of dimensions; None is all), each part a weighted sum of frames around.
PARTS = {"c": {0: 1}, "d": {2: 1, -2: -1}, "l": {4: 1, -4: -1}, "a": {3: 1, -1: -1, 1: -1, -3: 1}}
_POWER = [("c", 0, 1), ("d", 0, 1), ("a", 0, 1)]
SHAPES: dict[str, list[list[tuple]]] = {
    "1s_c": [[("c", 0, None)]],
    "1s_c_d": [[("c", 0, None), ("d", 0, None)]],
    "1s_c_d_dd": [[("c", 0, None), ("d", 0, None), ("a", 0, None)]],
    "1s_c_d_ld_dd": [[("c", 0, None), ("d", 0, None), ("l", 0, None), ("a", 0, None)]],
    "s3_1x39": [[("c", 1, 12), ("d", 1, 12), *_POWER, ("a", 1, 12)]],
    "s2_4x": [[("c", 1, 12)], [("d", 1, 12), ("l", 1, 12)], _POWER, [("a", 1, 12)]],
    "1s_3c": [[({k: 1}, 0, None) for k in range(-3, 4)]],
    "1s_4c": [[({k: 1}, 0, None) for k in range(-4, 5)]],
}
SHAPES |= {"cep": SHAPES["1s_c"], "cep_dcep": SHAPES["1s_c_d"], "1s_12c_12d_3p_12dd": SHAPES["s3_1x39"]}


def shape_of(kind: str, width: int) -> list[list[tuple]]:
    """The pieces of a feature type's streams for vectors of this width; a type that doesn't fit the width is an error."""
    if kind in SHAPES:
        if width != 13 and any(n == 12 for stream in SHAPES[kind] for _, _, n in stream):
            raise ValueError(f"{kind} needs vectors of 13")
        return SHAPES[kind]
    widths, k = parse_streams(kind)
    if sum(widths) != width:
        raise ValueError(f"the widths of {kind} don't add up to {width}")
    return [[({i: 1}, sum(widths[:s]), w) for i in range(-k, k + 1)] for s, w in enumerate(widths)]


def parse_streams(spec: str) -> tuple[list[int], int]:
    """Of `w1,w2,...[:window]`: the widths of the streams and the frames stacked on either side."""
    if not re.fullmatch(r"\d+(,\d+)*(:\d+)?", spec):
        raise ValueError(f"not a feature type: {spec}")
    widths, _, window = spec.partition(":")
    return [int(w) for w in widths.split(",")], int(window or 0)


def reach(kind: str) -> int:
    """How many frames on either side a feature type looks at."""
    fixed = {"1s_c": 0, "cep": 0, "1s_c_d": 2, "cep_dcep": 2, "1s_c_d_dd": 3, "1s_c_d_ld_dd": 4, "s3_1x39": 3, "1s_12c_12d_3p_12dd": 3, "s2_4x": 4, "1s_3c": 3, "1s_4c": 4}
    return fixed[kind] if kind in fixed else parse_streams(kind)[1]


def in_blocks(frames: DataFrame, frame: str, block: int, halo: int) -> DataFrame:
    """frames with `_block` and `_own`: runs of `block` frame numbers, each with copies (_own false) of the `halo` frames on
    either side of it."""
    n = F.col(frame).cast("long")
    blocks = F.sequence(F.floor((n - halo) / F.lit(block)), F.floor((n + halo) / F.lit(block)))
    copied = frames.withColumn("_block", F.explode(blocks)).where(F.col("_block") >= 0)
    return copied.withColumn("_own", F.col("_block") == F.floor(n / F.lit(block)))


def features(frames: DataFrame, kind: str, utterance: list[str], frame: str = "frame_no", vector: str = "c", width: int = 13, name: str = "feat", block: int | None = None) -> DataFrame:
    """frames with `name`: array of streams, each an array. kind is one of TYPES or `w1,w2,...[:window]`.

    block: frames are numbered from 0 without gaps, and an utterance is worked on in runs of so many frames with the few on
    either side that they need, so no task holds a long utterance. Results are the same."""
    if block is not None:
        if block < reach(kind):
            raise ValueError("a block is shorter than what a feature looks at")
        split = in_blocks(frames, frame, block, reach(kind))
        return features(split, kind, [*utterance, "_block"], frame, vector, width, name).where("_own").drop("_block", "_own")
    x = Neighbours(utterance, frame, vector)
    if kind in TYPES:
        if width != 13 and TYPES[kind] in (_streams_39, _streams_4):
            raise ValueError(f"{kind} needs vectors of 13")
        return frames.withColumn(name, F.array(*TYPES[kind](x)))
    widths, k = parse_streams(kind)
    if sum(widths) != width:
        raise ValueError(f"the widths of {kind} don't add up to {width}")
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return frames.withColumn(name, F.array(*[F.concat(*[_part(x[i], s, w) for i in range(-k, k + 1)]) for s, w in zip(starts, widths, strict=True)]))


def parse_subvectors(spec: str) -> list[list[int]]:
    """Of a text as `24,0-11/25,12-23`: the dimensions of each part. A dimension twice in a part is an error."""
    parts = []
    for part in spec.split("/"):
        dims: list[int] = []
        for piece in part.split(","):
            m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", piece)
            if not m or m[2] and int(m[2]) < int(m[1]):
                raise ValueError(f"not a list of dimensions: {spec}")
            dims += range(int(m[1]), int(m[2] or m[1]) + 1)
        if len(set(dims)) < len(dims):
            raise ValueError(f"a dimension occurs twice in {part}")
        parts.append(dims)
    return parts


def subvectors(x: Column, spec: str) -> Column:
    """The parts of a vector, as streams."""
    return F.array(*[F.array(*[F.get(x, F.lit(d)) for d in dims]) for dims in parse_subvectors(spec)])


def frame_range(frames: DataFrame, start: int, end: int, window: int, frame: str = "frame_no") -> DataFrame:
    """The frames start .. end and `window` more on either side, which normalisation and deltas of the range need. The
    condition reaches the scan."""
    return frames.where(F.col(frame).between(start - window, end + window))


def padded_range(frames: DataFrame, utterance: list[str], start: int, end: int | None, window: int, width: int, mean: str = "batch", gain: str = "none", variance: bool = False, frame: str = "frame_no", vector: str = "c") -> DataFrame:
    """utterance, frame and vector of start - window .. end + window of each utterance: the frames there are, normalised by
    themselves, and copies of the first and last one where the utterance is shorter than that.

    end None, or beyond the utterance, is its last frame. An utterance that ends before start is left out; an end at or
    before start is an error."""
    if end is not None and end <= start:
        raise ValueError("the range ends before it starts")
    last = frames.groupBy(*utterance).agg(F.max(frame).alias("_last")).where(F.col("_last") >= start)
    names = [f"_u{i}" for i in range(len(utterance))]
    last = last.select(*[F.col(u).alias(n) for u, n in zip(utterance, names, strict=True)], F.least(F.col("_last"), F.lit(end) if end is not None else F.col("_last")).alias("_end"), "_last")
    same = reduce(lambda a, b: a & b, [F.col(u).eqNullSafe(F.col(n)) for u, n in zip(utterance, names, strict=True)])
    inside = frames.where(F.col(frame) >= start - window)
    inside = inside.join(last, same).where(F.col(frame) <= F.col("_end") + window).select(*utterance, frame, vector, "_end", "_last")
    out = normalise.normalise(inside, utterance, width, mean, gain, variance, vector)
    first = F.when(F.col(frame) == F.greatest(F.lit(start - window), F.lit(0)), F.lit(start - window)).otherwise(F.col(frame))
    final = F.when(F.col(frame) == F.least(F.col("_end") + window, F.col("_last")), F.col("_end") + window).otherwise(F.col(frame))
    return out.withColumn("_n", F.explode(F.sequence(first.cast("long"), final.cast("long")))).select(*utterance, F.col("_n").alias(frame), vector)
