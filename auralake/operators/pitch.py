"""Pitch by the cumulative-mean-normalised difference of a frame with itself.

Each frame's difference function is computed on Arrow batches; smoothing over neighbours is a row window of Spark, and
frames whose neighbours know a better period search again near it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(x: np.ndarray) -> np.ndarray:
    """Normalised differences of a frame at lags 0 .. half its length - 1; 1 at lag 0. Of whole samples the differences are whole
    numbers, so the transform's rounding goes."""
    x = np.asarray(x)
    whole, x = np.issubdtype(x.dtype, np.integer), x.astype(float)
    n = len(x) // 2
    if n < 1:
        return np.ones(1)
    head = x[:n]
    spectrum = np.fft.rfft(head, 4 * n).conj() * np.fft.rfft(x[: 2 * n], 4 * n)
    cross = np.fft.irfft(spectrum, 4 * n)[:n]
    squares = np.concatenate([[0.0], np.cumsum(x[: 2 * n] ** 2)])
    d = np.maximum(squares[n] + squares[n : 2 * n] - squares[:n] - 2 * cross, 0.0)
    d = np.rint(d) if whole else d
    out = np.ones(n)
    total = np.cumsum(d[1:])
    out[1:] = np.divide(d[1:] * np.arange(1, n), total, out=np.ones(n - 1), where=total > 0)
    return out


def search(d: np.ndarray, threshold: float, low: int = 0, high: int | None = None) -> int:
    """The first lag below the threshold, or else the least."""
    low = min(low, len(d) - 1)
    part = d[low : max(low + 1, len(d) if high is None else high)]
    below = np.flatnonzero(part < threshold)
    return low + int(below[0] if len(below) else part.argmin())


def track(framed: DataFrame, keys: list[str], rate: float, threshold: float = 0.1, spread: float = 0.2, smooth: int = 2, shift: int | None = None, block: int | None = None) -> DataFrame:
    """keys, frame_no, t, voicing and f0 of frames (keys, frame_no, samples).

    Of ties the frame's own period stays. A period of zero reads as the sampling rate. With block, which needs frame
    numbers without gaps, smoothing works on blocks of so many frames, and a long utterance fills no single task."""

    @F.pandas_udf("period int, diff double")
    def own(samples: pd.Series) -> pd.DataFrame:
        ds = [difference(s) for s in samples]
        at = [search(d, threshold) for d in ds]
        return pd.DataFrame({"period": at, "diff": [d[p] for d, p in zip(ds, at, strict=True)]})

    @F.pandas_udf("period int, diff double")
    def again(samples: pd.Series, period: pd.Series, diff: pd.Series, best: pd.Series) -> pd.DataFrame:
        out = []
        for s, p, v, b in zip(samples, period, diff, best, strict=True):
            if b == p:
                out.append((p, v))
            else:  # differences are worked out anew here rather than carried through the shuffle
                x = difference(s)
                width = max(1, int(b * spread))
                p = search(x, threshold, max(0, b - width), min(len(x), b + width))
                out.append((p, x[p]))
        return pd.DataFrame(out, columns=["period", "diff"])

    first = framed.select(*keys, "frame_no", "samples", own("samples").alias("_o"))
    parts = keys
    if block:  # a frame also goes to the block that ends or begins within its neighbourhood
        ends = F.array(F.floor((F.col("frame_no") - smooth) / block), F.floor(F.col("frame_no") / block), F.floor((F.col("frame_no") + smooth) / block))
        first, parts = first.withColumn("_part", F.explode(F.array_distinct(ends))), [*keys, "_part"]
    near = Window.partitionBy(*parts).orderBy("frame_no").rowsBetween(-smooth, smooth)
    best = F.min(F.struct(F.col("_o.diff").alias("diff"), F.col("frame_no").alias("at"), F.col("_o.period").alias("period"))).over(near)
    met = first.withColumn("_b", best)
    if block:
        met = met.where(F.col("_part") == F.floor(F.col("frame_no") / block))
    choice = F.when(F.col("_b.diff") < F.col("_o.diff"), F.col("_b.period")).otherwise(F.col("_o.period"))
    met = met.withColumn("_r", again("samples", F.col("_o.period"), F.col("_o.diff"), choice))
    step = (shift or int(rate / 100 + 0.5)) / rate
    f0 = F.when(F.col("_r.period") > 0, rate / F.col("_r.period")).otherwise(F.lit(float(rate)))
    return met.select(*keys, "frame_no", (F.col("frame_no") * step).alias("t"), F.greatest(1 - F.col("_r.diff"), F.lit(0.0)).alias("voicing"), f0.alias("f0"))


def text_lines(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame_no and line: time, voicing and pitch as text."""
    return tracked.select(*keys, "frame_no", F.format_string("%.3f %.2f %.2f", "t", "voicing", "f0").alias("line"))
