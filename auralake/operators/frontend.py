"""Acoustic front end: samples to frames to mel spectra to cepstra.

Spark cuts the samples of each utterance into frames, one row each, and deals them; the stateless kernel of a frame
(emphasis, window, spectrum, mel filters, cosine transform) works on whole Arrow batches of frames by numpy. What
depends on the frames before, noise removal and voice activity, is one pass by stream in `activity`."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import warp


@dataclass(frozen=True)
class FrontEnd:
    """Parameters, checked on construction. The defaults are those of 16 kHz speech."""

    rate: float = 16000.0
    frame_rate: int = 100
    window: float = 0.025625
    n_fft: int = 512
    n_cep: int = 13
    n_filt: int = 40
    low: float = 133.33334
    high: float = 6855.4976
    alpha: float = 0.97
    remove_dc: bool = False
    dither_seed: int | None = None
    lifter: int = 0
    transform: str = "legacy"
    output: str = "cepstra"
    round_filters: bool = True
    unit_area: bool = True
    double_width: bool = False
    warp: str = "inverse_linear"
    warp_parameters: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if self.frame_rate > min(32767, self.rate) or self.frame_rate <= 0:
            raise ValueError("the frame rate must be positive and at most the sampling rate")
        if self.n_fft & (self.n_fft - 1) or self.n_fft < self.size:
            raise ValueError("n_fft must be a power of two and hold a frame")
        if self.high > self.rate / 2 + 1 or self.low < 0 or self.low >= self.high:
            raise ValueError("the filters must lie below half the sampling rate")
        if self.transform not in ("legacy", "dct", "htk") or self.output not in ("cepstra", "logspec", "smoothspec"):
            raise ValueError("unknown transform or output")

    @property
    def shift(self) -> int:
        return int(self.rate / self.frame_rate + 0.5)

    @property
    def size(self) -> int:
        return int(self.window * self.rate + 0.5)

    @property
    def width(self) -> int:
        return self.n_cep if self.output == "cepstra" else self.n_filt

    @cached_property
    def hamming(self) -> np.ndarray:
        """The window; a frame of odd length keeps its middle sample as it is."""
        w = 0.54 - 0.46 * np.cos(2 * math.pi * np.arange(self.size) / (self.size - 1))
        if self.size % 2:
            w[self.size // 2] = 1.0
        return w

    @cached_property
    def filters(self) -> np.ndarray:
        """(bins, filters): triangles evenly spaced on the mel scale, warped if so asked."""
        to, back = warp.warps(self.warp, self.warp_parameters, self.rate)
        mel = lambda f: 2595.0 * math.log10(1.0 + to(f) / 700.0)
        hertz = lambda m: back(700.0 * (10.0 ** (m / 2595.0) - 1.0))
        low, high, bin_ = mel(self.low), mel(self.high), self.rate / self.n_fft
        step = (high - low) / (self.n_filt + 1)
        if self.double_width:
            low, high = low - step, high + step
            if hertz(low) < 0 or hertz(high) > self.rate / 2:
                raise ValueError("filters of double width go beyond the spectrum")
        edge = lambda k: math.floor(hertz(low + k * step) / bin_ + 0.5) * bin_ if self.round_filters else hertz(low + k * step)
        f = np.arange(self.n_fft // 2 + 1) * bin_
        out, reach = np.zeros((len(f), self.n_filt)), 2 if self.double_width else 1
        for i in range(self.n_filt):
            left, top, right = (edge(i + k * reach) for k in range(3))
            height = 2 / (right - left) if self.unit_area else 1.0
            out[:, i] = np.clip(np.minimum((f - left) / (top - left), (right - f) / (right - top)), 0, None) * height
        return out

    @cached_property
    def cosines(self) -> np.ndarray:
        """(filters, coefficients) of the chosen transform of log spectra."""
        i, j, n = np.arange(self.n_cep), np.arange(self.n_filt), self.n_filt
        table = np.cos(math.pi * np.outer(j + 0.5, i) / n)
        if self.transform == "legacy":
            table = table * np.where(j == 0, 1.0, 2.0)[:, None] / (2 * n)
            table[:, 0] = np.where(j == 0, 0.5, 1.0) / n
            return table
        table = table * math.sqrt(2 / n)
        if self.transform == "dct":
            table[:, 0] = math.sqrt(1 / n)
        return table

    @cached_property
    def inverse(self) -> np.ndarray:
        """(coefficients, filters): log spectra back from unitary coefficients."""
        i, j, n = np.arange(self.n_cep), np.arange(self.n_filt), self.n_filt
        table = np.cos(math.pi * np.outer(i, j + 0.5) / n) * math.sqrt(2 / n)
        table[0] = math.sqrt(1 / n)
        return table

    @cached_property
    def lift(self) -> np.ndarray:
        n = self.lifter
        return 1 + (n // 2) * np.sin(np.arange(self.n_cep) * math.pi / n) if n else np.ones(self.n_cep)

    def emphasis(self, samples: list, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frames after pre-emphasis, short ones filled with zeros, and how long each was."""
        x, n = np.zeros((len(samples), self.size)), np.array([len(s) for s in samples])
        for k, s in enumerate(samples):
            x[k, : len(s)] = s
        if self.alpha:
            x = x - self.alpha * np.concatenate([prior[:, None], x[:, :-1]], axis=1)
        x[np.arange(self.size) >= n[:, None]] = 0.0
        return x, n

    def spectrum(self, samples: list, prior: np.ndarray) -> np.ndarray:
        """Mel spectra of frames; the last frame of an utterance may be short."""
        x, _ = self.emphasis(samples, prior)
        if self.remove_dc:
            x = x - x.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(x * self.hamming, self.n_fft)) ** 2
        return power @ self.filters

    def cepstra(self, mel: np.ndarray) -> np.ndarray:
        """Cepstra, or log spectra, of mel spectra."""
        return self.of_log(np.log(mel + 1e-4))

    def of_log(self, log: np.ndarray) -> np.ndarray:
        if self.output == "logspec":
            return log
        if self.output == "smoothspec":
            return log @ replace(self, transform="dct", output="cepstra").cosines @ self.inverse
        return (log @ self.cosines) * self.lift


def frames(utterances: DataFrame, fe: FrontEnd, keys: list[str], pcm: str = "pcm") -> DataFrame:
    """keys, frame_no, samples, prior (the sample before, 0 at the start): all full frames and a partial one, by built-in
    functions. An utterance without samples has none."""
    n = F.size(pcm)
    last = F.when(n < fe.size, F.lit(0)).otherwise(F.floor((n - fe.size) / F.lit(fe.shift)).cast("int") + 1)
    cut = utterances.where(n > 0).select(*keys, F.col(pcm).alias("_pcm"), F.explode(F.sequence(F.lit(0), last)).alias("frame_no"))
    start = F.col("frame_no") * fe.shift
    prior = F.when(start > 0, F.get("_pcm", start - 1)).otherwise(F.lit(0))
    return cut.where(start < F.size("_pcm")).select(*keys, "frame_no", F.slice("_pcm", start + 1, F.lit(fe.size)).alias("samples"), prior.cast("double").alias("prior"))


def frames_of_rows(samples: DataFrame, fe: FrontEnd, keys: list[str], value: str = "value", index: str = "i") -> DataFrame:
    """As `frames`, from one row for each sample, numbered from 0 by `index`: a row goes to the frames that hold it or
    begin after it, so no row holds more than a frame."""
    i, k = F.col(index), F.col("frame_no")
    to = F.sequence(F.greatest(F.lit(0), F.ceil((i - fe.size + 1) / F.lit(fe.shift))).cast("int"), F.floor((i + 1) / F.lit(fe.shift)).cast("int"))
    near = samples.where(i <= fe.size - 1 + F.floor((i + 1) / F.lit(fe.shift)) * fe.shift)  # between frames further apart than their size
    met = near.select(*keys, F.explode(to).alias("frame_no"), i.cast("long").alias("_i"), F.col(value).alias("_v"))
    held = F.sort_array(F.collect_list(F.struct("_i", "_v")))
    cut = met.groupBy(*keys, "frame_no").agg(F.max("_i").alias("_last"), held.alias("_s"))
    start = k.cast("long") * fe.shift
    cut = cut.where((F.col("_last") >= start) & ((k == 0) | (F.col("_last") >= start - fe.shift + fe.size - 1)))
    own = F.transform(F.filter("_s", lambda s: s["_i"] >= start), lambda s: s["_v"])
    prior = F.when(F.col("_s")[0]["_i"] < start, F.col("_s")[0]["_v"]).otherwise(F.lit(0))
    return cut.select(*keys, "frame_no", own.alias("samples"), prior.cast("double").alias("prior"))


def dither(pcm: Column, seed: int) -> Column:
    """Each sample one higher with a chance of a quarter, drawn by a Mersenne Twister started afresh for each utterance."""

    @F.pandas_udf("array<smallint>")
    def noise(s: pd.Series) -> pd.Series:
        return s.map(lambda x: (np.asarray(x, dtype=np.int16) + (np.random.RandomState(seed).randint(0, 4, len(x)) == 0)).astype(np.int16))

    return noise(pcm)


def emphasised(framed: DataFrame, fe: FrontEnd) -> DataFrame:
    """framed with its samples after pre-emphasis, which the sample before the frame takes part in."""

    @F.pandas_udf("array<double>")
    def emphasise(samples: pd.Series, prior: pd.Series) -> pd.Series:
        x, n = fe.emphasis(samples.tolist(), prior.to_numpy(dtype=float))
        return pd.Series([row[:k] for row, k in zip(x, n, strict=True)], dtype=object)

    return framed.withColumn("samples", emphasise("samples", "prior"))


def mel_spectra(framed: DataFrame, fe: FrontEnd) -> DataFrame:
    """framed without its samples, and `mel`."""

    @F.pandas_udf("array<double>")
    def mel(samples: pd.Series, prior: pd.Series) -> pd.Series:
        return pd.Series(list(fe.spectrum(samples.tolist(), prior.to_numpy(dtype=float)))) if len(samples) else pd.Series([], dtype=object)

    return framed.withColumn("mel", mel("samples", "prior")).drop("samples", "prior")


def cepstra(mel: DataFrame, fe: FrontEnd, column: str = "mel", name: str = "c") -> DataFrame:
    @F.pandas_udf("array<float>")
    def cep(s: pd.Series) -> pd.Series:
        return pd.Series(list(fe.cepstra(np.stack(s.to_list())).astype(np.float32))) if len(s) else pd.Series([], dtype=object)

    return mel.withColumn(name, cep(column)).drop(column)


def log_spectra_to_cepstra(logs: DataFrame, fe: FrontEnd, column: str = "logspec", name: str = "c") -> DataFrame:
    """For stored log spectra."""

    @F.pandas_udf("array<float>")
    def cep(s: pd.Series) -> pd.Series:
        return pd.Series(list(fe.of_log(np.stack(s.to_list())).astype(np.float32))) if len(s) else pd.Series([], dtype=object)

    return logs.withColumn(name, cep(column))


def features(utterances: DataFrame, fe: FrontEnd, keys: list[str], pcm: str = "pcm") -> DataFrame:
    """keys, frame_no and cepstra of every frame, with no noise removal: nothing shuffles. `extract` does the whole path."""
    if fe.dither_seed is not None:
        utterances = utterances.withColumn(pcm, dither(F.col(pcm), fe.dither_seed))
    return cepstra(mel_spectra(frames(utterances, fe, keys, pcm), fe), fe)


def extract(utterances: DataFrame, fe: FrontEnd, stream: str = "stream_id", utterance: str = "utt_seq", pcm: str = "pcm", remove_noise: bool = True, remove_silence: bool = True) -> DataFrame:
    """The whole front end: stream, utterance, frame_no and c of the frames that are let out.

    In the order in which each step works on the one before: dither, frames, emphasis and mel spectra; noise tracking along
    the stream, which takes noise off the spectra and marks speech; log and cosine transform with lifter; hangover of the
    speech marks. Frames keep their number, so gaps show where silence was. Only the tracker depends on the frames before."""
    from . import activity

    if fe.dither_seed is not None:
        utterances = utterances.withColumn(pcm, dither(F.col(pcm), fe.dither_seed))
    mel = mel_spectra(frames(utterances, fe, [stream, utterance], pcm), fe)
    if remove_noise or remove_silence:
        mel = activity.track(mel, stream, utterance, remove_noise, remove_silence).where("emitted").select(stream, utterance, "frame_no", "mel")
    return cepstra(mel, fe)
