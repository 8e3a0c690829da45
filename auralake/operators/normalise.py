"""Mean, variance and gain normalisation of whole utterances: one partial aggregate by utterance, joined back.

Only frames with a first coefficient of at least zero count for means; all frames are shifted. An utterance without such
frames stays as it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _join_back(frames: DataFrame, stats: DataFrame, utterance: list[str]) -> DataFrame:
    """frames with the statistics of their utterance; null keys meet."""
    stats = stats.select(*[F.col(u).alias(f"_u{i}") for i, u in enumerate(utterance)], *[c for c in stats.columns if c not in utterance])
    same = reduce(lambda a, b: a & b, [F.col(u).eqNullSafe(F.col(f"_u{i}")) for i, u in enumerate(utterance)])
    return frames.join(stats, same).drop(*[f"_u{i}" for i in range(len(utterance))])


def _each(width: int, of) -> Column:
    return F.array(*[of(i) for i in range(width)])


def mean_norm(frames: DataFrame, utterance: list[str], width: int, vector: str = "c", variance: bool = False) -> DataFrame:
    """frames with the vector less its utterance's mean and, if asked for, divided by the deviation about that mean."""
    x = lambda i: F.get(vector, F.lit(i)).cast("double")
    voiced = x(0) >= 0
    aggs = [_each(width, lambda i: F.avg(F.when(voiced, x(i)))).alias("_mean")]
    if variance:
        aggs += [_each(width, lambda i: F.avg(x(i))).alias("_m1"), _each(width, lambda i: F.avg(x(i) * x(i))).alias("_m2")]
    stats = frames.groupBy(*utterance).agg(*aggs)
    met = _join_back(frames, stats, utterance)
    out = F.zip_with(vector, "_mean", lambda a, m: a - F.coalesce(m, F.lit(0.0)))
    if variance:
        spread = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.sqrt(F.greatest(F.get("_m2", i) - 2 * F.get("_mean", i) * F.get("_m1", i) + F.get("_mean", i) * F.get("_mean", i), F.lit(0.0))))
        out = F.zip_with(out, spread, lambda a, s: F.when(s > 0, a / s).otherwise(a))
    return met.withColumn(vector, out).select(*frames.columns)


def _replace_first(vector: str, first: Column) -> Column:
    return F.concat(F.array(first), F.slice(vector, 2, F.greatest(F.size(vector) - 1, F.lit(0))))


def gain_max(frames: DataFrame, utterance: list[str], vector: str = "c") -> DataFrame:
    """The first coefficient less its greatest value in the utterance."""
    first = F.get(vector, F.lit(0)).cast("double")
    met = _join_back(frames, frames.groupBy(*utterance).agg(F.max(first).alias("_top")), utterance)
    return met.withColumn(vector, _replace_first(vector, first - F.col("_top"))).select(*frames.columns)


def gain_noise(frames: DataFrame, utterance: list[str], vector: str = "c", threshold: float = 2.0) -> DataFrame:
    """The first coefficient less the mean of those within `threshold` of the least."""
    first = F.get(vector, F.lit(0)).cast("double")
    low = _join_back(frames, frames.groupBy(*utterance).agg(F.min(first).alias("_low")), utterance)
    noise = low.groupBy(*utterance).agg(F.avg(F.when(first < F.col("_low") + threshold, first)).alias("_noise"))
    met = _join_back(frames, noise, utterance)
    return met.withColumn(vector, _replace_first(vector, first - F.coalesce("_noise", F.lit(0.0)))).select(*frames.columns)


MEANS, GAINS = ("none", "batch", "live"), ("none", "max", "emax", "noise")


def normalise(frames: DataFrame, utterance: list[str], width: int, mean: str = "batch", gain: str = "none", variance: bool = False, vector: str = "c", whole: bool = True) -> DataFrame:
    """Mean and gain normalisation by name. whole: the frames are whole utterances.

    Batch means, `max` and `noise` need whole utterances: with parts of them they are an error and never turn into a
    running estimate by themselves. The running kinds, `live` and `emax`, depend on the order of utterances; they are
    the stateful operators of `streaming.live`, and an error here."""
    if mean not in MEANS or gain not in GAINS:
        raise ValueError(f"means are one of {MEANS}, gains one of {GAINS}")
    if mean == "live" or gain == "emax":
        raise ValueError("running estimates are kept by streaming.live")
    if not whole and (mean == "batch" or gain != "none"):
        raise ValueError("parts of utterances need running estimates, or none")
    out = mean_norm(frames, utterance, width, vector, variance) if mean == "batch" else frames
    return out if gain == "none" else (gain_max if gain == "max" else gain_noise)(out, utterance, vector)
