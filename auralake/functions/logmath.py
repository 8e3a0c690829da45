"""The log semiring as column expressions: integer logs in a small base, natural and decimal logs, and log sums.

Integer logs truncate toward zero and then shift, as 32-bit arithmetic does; log-zero absorbs. The aggregate
`log_sum_exp` sums in buckets of exponents, so it combines on the map side and never overflows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bucket of exponents in `log_sum_exp`.
BUCKET = 64.0


@dataclass(frozen=True)
class LogMath:
    """Integer logs of base `base`, kept without their last `shift` bits."""

    base: float = 1.0001
    shift: int = 0

    def __post_init__(self) -> None:
        if self.base <= 1.0 or not 0 <= self.shift < 30:
            raise ValueError("the base must be above 1 and the shift within 0..29")

    @property
    def zero(self) -> int:
        return -(1 << 31) >> (self.shift + 2)

    @property
    def step(self) -> float:
        """The natural log of one unit before the shift."""
        return math.log(self.base)

    def _whole(self, units: Column) -> Column:
        return F.shiftright(units.cast("int"), self.shift)

    def log(self, p: Column) -> Column:
        return F.when(p <= 0, F.lit(self.zero)).otherwise(self._whole(F.log(p) / F.lit(self.step)))

    def exp(self, x: Column) -> Column:
        return F.when(x <= self.zero, F.lit(0.0)).otherwise(F.exp(F.shiftleft(x.cast("long"), self.shift) * F.lit(self.step)))

    def add(self, x: Column, y: Column) -> Column:
        """log(exp(x) + exp(y)), within one unit of the sum of the exponentials."""
        far = F.shiftleft(F.abs(x - y).cast("long"), self.shift) * F.lit(self.step)
        more = self._whole(F.log1p(F.exp(-far)) / F.lit(self.step) + F.lit((1 << self.shift) / 2))
        return F.when(x <= self.zero, y).when(y <= self.zero, x).otherwise(F.greatest(x, y) + more)

    def add_exact(self, x: Column, y: Column) -> Column:
        return self.log(self.exp(x) + self.exp(y))

    def from_ln(self, x: Column) -> Column:
        return self._whole(x / F.lit(self.step))

    def to_ln(self, x: Column) -> Column:
        return F.shiftleft(x.cast("long"), self.shift) * F.lit(self.step)

    def from_log10(self, x: Column) -> Column:
        return self._whole(x / F.lit(self.step / math.log(10)))

    def from_log10_float(self, x: Column) -> Column:
        """As from_log10, without truncation."""
        return x / F.lit(self.step / math.log(10)) / F.lit(float(1 << self.shift))

    def to_log10(self, x: Column) -> Column:
        return F.shiftleft(x.cast("long"), self.shift) * F.lit(self.step / math.log(10))

    def float_to_log10(self, x: Column) -> Column:
        return x * F.lit((1 << self.shift) * self.step / math.log(10))

    def describe(self) -> dict:
        """What a persisted table would hold: base, shift, zero and the number of distinct sums."""
        reach = math.ceil(math.log(2 / self.step + 1) / self.step) >> self.shift if self.step else 0
        return {"base": self.base, "shift": self.shift, "zero": self.zero, "table": reach}


def ln_add(x: Column, y: Column) -> Column:
    """log(exp(x) + exp(y)) of natural logs; null is log-zero."""
    both = F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
    return F.coalesce(both, x, y)


def log_sum_exp(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """By keys, log(sum(exp(x))) of natural logs; nulls don't count, and a group of nulls is null."""
    bucket = F.floor(F.col(x) / BUCKET)
    part = df.where(F.col(x).isNotNull()).groupBy(*keys, bucket.alias("_b")).agg(F.sum(F.exp(F.col(x) - bucket * BUCKET)).alias("_s"))
    groups = part.groupBy(*keys).agg(F.max("_b").alias("_top"), F.collect_list(F.struct("_b", "_s")).alias("_parts"))
    total = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p._s * F.exp((p._b - F.col("_top")) * BUCKET))
    return groups.select(*keys, (F.col("_top") * BUCKET + F.log(total)).alias(name))
