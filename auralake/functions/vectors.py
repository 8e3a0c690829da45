"""Array and matrix kernels. Element-wise ones are column expressions; dense algebra on small matrices runs by numpy
on Arrow batches, one matrix a row, wherever Spark has dealt the rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def scale(x: Column, k: Column | float) -> Column:
    return F.transform(x, lambda a: a * k)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def outer(x: Column, y: Column) -> Column:
    return F.transform(x, lambda a: F.transform(y, lambda b: a * b))


def project(x: Column, matrix: list[list[float]]) -> Column:
    """matrix times x: one element for each row of the matrix."""
    return F.array(*[dot(F.array(*[F.lit(float(v)) for v in row]), x) for row in matrix])


def floor_nonzero(x: Column, least: float) -> Column:
    """Elements below `least` become it, unless they are zero."""
    return F.transform(x, lambda a: F.when((a != 0) & (a < least), F.lit(least)).otherwise(a))


def band_nonzero(x: Column, band: float) -> Column:
    """Elements nearer to zero than `band` move to its edge, unless they are zero."""
    return F.transform(x, lambda a: F.when((a > 0) & (a < band), F.lit(band)).when((a < 0) & (a > -band), F.lit(-band)).otherwise(a))


def set_bits(x: Column) -> Column:
    """Set bits of a binary column's bytes, or of a whole number."""
    return F.bit_count(x)


def normalise(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Cells (keys and value) with each value divided by the sum over its keys; a zero sum leaves zero."""
    sums = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum(value).alias("_sum"))
    share = F.when(F.col("_sum") != 0, F.col(value) / F.col("_sum")).otherwise(0.0)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(sums, same).select(*df.columns, share.alias(name))


def accumulate(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cell by cell sums of partial accumulators."""
    return parts.groupBy(*keys).agg(F.sum(value).alias(value))


def _square(rows: pd.Series) -> list[np.ndarray]:
    return [np.array([np.asarray(r, dtype=float) for r in m]) for m in rows]


def determinant(matrix: Column) -> Column:
    """Of a symmetric positive definite matrix (rows of rows); -1 for any other."""

    @F.pandas_udf("double")
    def det(m: pd.Series) -> pd.Series:
        def one(a: np.ndarray) -> float:
            try:
                return float(np.prod(np.diag(np.linalg.cholesky(a))) ** 2)
            except np.linalg.LinAlgError:
                return -1.0

        return pd.Series([one(a) for a in _square(m)])

    return det(matrix)


def solve(matrix: Column, right: Column) -> Column:
    """x with matrix x = right; null where the matrix isn't positive definite."""

    @F.pandas_udf("array<double>")
    def solved(m: pd.Series, b: pd.Series) -> pd.Series:
        def one(a: np.ndarray, v: np.ndarray):
            try:
                low = np.linalg.cholesky(a)
                return np.linalg.solve(low.T, np.linalg.solve(low, v)).tolist()
            except np.linalg.LinAlgError:
                return None

        return pd.Series([one(a, np.asarray(v, dtype=float)) for a, v in zip(_square(m), b, strict=True)])

    return solved(matrix, right)


def invert(matrix: Column) -> Column:
    """The inverse; null where the matrix isn't positive definite."""

    @F.pandas_udf("array<array<double>>")
    def inverse(m: pd.Series) -> pd.Series:
        def one(a: np.ndarray):
            try:
                np.linalg.cholesky(a)
                return np.linalg.inv(a).tolist()
            except np.linalg.LinAlgError:
                return None

        return pd.Series([one(a) for a in _square(m)])

    return inverse(matrix)


def multiply(x: Column, y: Column) -> Column:
    """The product of two matrices of rows."""

    @F.pandas_udf("array<array<double>>")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(p @ q).tolist() for p, q in zip(_square(a), _square(b), strict=True)])

    return product(x, y)
