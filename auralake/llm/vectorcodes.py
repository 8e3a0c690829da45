"""Product-quantisation codes of vectors: integer k-means of each part, with the exponion search.

Components become integers floor(scale * x), so that all distances, sums and ties are exact and the codes don't depend on how rows
are dealt out. A vector's nearest entry is searched from its entry of the round before: an entry that is as near as
that one lies no farther from it than twice the vector's own distance, so only the head of that entry's list of
neighbours, sorted by distance, is scanned.

A round writes the rows with their new entries to the shared folder, from where the next round starts, and drops the round's table
before; tasks then add up their rows by entry and Spark adds up the tasks. Codebooks hold at most `entries` vectors,
whatever the table's size, and are all that reaches the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Floats hold all integers to this one.
EXACT = 1 << 53
#: Vectors with a component of this magnitude have no code: their sums don't fit a decimal.
LARGEST = 2.0**52
LONGEST = (1 << 63) - 1


@dataclass
class Codebooks:
    """The codebooks of every round, `rounds[r][part]` an integer array (entries, width); the last ones are final. `dim` is
    the length of the vectors they are for."""

    dim: int
    scale: int
    rounds: list[list[np.ndarray]]

    @property
    def final(self) -> list[np.ndarray]:
        return self.rounds[-1]

    def digest(self) -> str:
        """SHA-256 of all final entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.final for entry in part for x in entry).encode()).hexdigest()


def bounds(dim: int, parts: int) -> list[int]:
    """Where parts begin, and the end: consecutive and equal, or as equal as dim allows."""
    return [i * dim // parts for i in range(parts + 1)]


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for components below LARGEST, as int64 where they fit and Python integers otherwise."""
    y = np.floor(x.astype(np.float64) * scale)
    if not y.size or np.abs(y).max() < EXACT:
        return y.astype(np.int64)
    return np.array([[int(v) for v in row] for row in y], dtype=object)


def _suited(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the fastest type in which four times a squared distance, and all that leads to it, is exact."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    top = 16 * most * most * max(1, arrays[0].shape[-1])
    kind = np.float64 if top < EXACT else np.int64 if top < LONGEST else object
    return [a.astype(kind) for a in arrays]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of y."""
    out = x @ y.T
    out *= -2
    out += (y * y).sum(axis=1)[None, :]
    out += (x * x).sum(axis=1)[:, None]
    return out


class Neighbours:
    """A codebook with each entry's other entries sorted by their distance from it."""

    def __init__(self, book: np.ndarray):
        self.book = book
        (own,) = _suited(book)
        between = _squared(own, own)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance, number of distances computed) of each row of x, searched from the entries
        `start`; of equally near ones the lowest."""
        x, book = _suited(x, self.book)
        own = ((x - book[start]) ** 2).sum(axis=1)
        best, at, scanned = own.copy(), start.copy(), len(x)
        reach = 4 * own
        by_entry = np.argsort(start, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(start[by_entry]) > 0]) if len(x) else []
        for rows in np.split(by_entry, heads[1:]) if len(x) else []:
            a = start[rows[0]]
            inside = np.searchsorted(self.sorted[a], reach[rows], side="right")
            for some, counts in self._alike(rows, inside):
                near = self.order[a][: counts.max()]
                d = _squared(x[some], book[near])
                scanned += d.size
                least = d.min(axis=1)
                best[some] = least
                at[some] = np.where(d == least[:, None], near[None, :], len(book)).min(axis=1)
        return at, best, scanned

    @staticmethod
    def _alike(rows: np.ndarray, inside: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows whose radius holds about as many entries are scanned together, where there are enough to tell apart."""
        if len(rows) < 64 or inside.max() < 2 * inside.min():
            return [(rows, inside)]
        level = np.frexp(inside)[1]
        return [(rows[level == k], inside[level == k]) for k in np.unique(level)]


def _kept(v: Column) -> Column:
    """True for vectors that are not null and hold only finite components."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _codable(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & F.forall(v, lambda x: F.abs(x) < LARGEST)


def kept_rows(vectors: DataFrame, vector_col: str) -> DataFrame:
    """vectors without the rows whose vector is null or holds a null or non-finite component."""
    return vectors.where(_kept(F.col(vector_col).cast("array<double>")))


def _array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = _array(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _assigned(vector: Column, codes: Column | None, books: list[np.ndarray], dim: int, scale: int) -> Column:
    """A struct of `codes` and `error` of each vector in the codebooks, searched from its codes so far; null for null."""
    cuts = bounds(dim, len(books))
    kind = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(near: list[Neighbours], column: pa.Array, before: pa.Array | None) -> pa.Array:
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        x = whole_numbers(_matrix(column.drop_null(), dim), scale)
        start = _matrix(before.drop_null(), len(books)).astype(np.int64) if before is not None else np.zeros((len(x), len(books)), np.int64)
        found = [n.nearest(x[:, cuts[p] : cuts[p + 1]], start[:, p])[:2] for p, n in enumerate(near)]
        total = sum(e.astype(object) if e.dtype == object else e.astype(np.int64) for _, e in found)
        sizes, errors = np.zeros(len(column), np.int64), np.full(len(column), None, dtype=object)
        sizes[there] = len(books)
        errors[there] = [int(e) if e <= LONGEST else None for e in total]
        gone = pa.array(sizes == 0)
        codes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.stack([c for c, _ in found], axis=1).ravel(), pa.int32()), mask=gone)
        return pa.StructArray.from_arrays([codes, pa.array(errors, pa.int64())], ["codes", "error"])

    if codes is None:

        @F.arrow_udf(kind)
        def first(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            near = [Neighbours(b) for b in books]
            for column in columns:
                yield run(near, _array(column), None)

        return first(vector)

    @F.arrow_udf(kind)
    def again(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        near = [Neighbours(b) for b in books]
        for column, before in columns:
            yield run(near, _array(column), _array(before))

    return again(vector, codes)


def _sums(rows: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """(part, entry, pos, value) of rows (v, codes): sums of the components of the vectors of each entry, and their number at pos
    -1. Tasks add up their own rows first, so at most one codebook a task is shuffled."""
    cuts = bounds(dim, parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x, codes = whole_numbers(_matrix(batch.column(0), dim), scale), _matrix(batch.column(1), parts)
            if x.dtype != object and int(np.abs(x).max(initial=0)) * len(x) > LONGEST:
                x = x.astype(object)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                found, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                summed = np.add.reduceat(x[order, cuts[p] : cuts[p + 1]], first, axis=0)
                for e, s in zip(found.tolist(), np.c_[n, summed].astype(object), strict=True):
                    total[p, e] = total[p, e] + s if (p, e) in total else s
        rows = [(p, e, i - 1, Decimal(int(v))) for (p, e), s in total.items() for i, v in enumerate(s)]
        part, entry, pos, value = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(pos, pa.int32()), pa.array(value, pa.decimal128(38, 0))], ["part", "entry", "pos", "value"])

    sums = rows.select("v", "codes").where(F.col("codes").isNotNull()).mapInArrow(add, "part int, entry int, pos int, value decimal(38,0)")
    return sums.groupBy("part", "entry", "pos").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def compress(
    vectors: DataFrame, *, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", name: str = "_al_code"
) -> tuple[Codebooks, DataFrame]:
    """(codebooks, the kept rows with a struct column `name` of their `codes` and `error`, a long).

    Rows whose vector is null or holds a null or non-finite component go; all others stay, repeated ones too, with all
    their columns. Codebooks start as the parts of the `entries` kept rows of least id (null ids last; equal ids by their
    components) and are renewed `rounds` times as the floors of their vectors' means; an entry without vectors stays. Vectors are then
    assigned once more. The error is the squared distance to the entries, summed over parts.

    The first row's length is `dim`; rows of another length, and rows with a component of 2**52 or more, have null codes and
    errors and count in no codebook; an error that a long can't hold is null. Parts are as equal as dim allows. An
    empty table gives codebooks without entries and no rows; fewer rows than `entries` give as many entries as rows."""
    kept = kept_rows(vectors, vector_col)
    first = kept.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.forall("v", lambda x: F.abs(x) < LARGEST))
    order = [F.col("id").isNull(), F.col("id"), F.col("v")]
    one = first.orderBy(*order).limit(1).collect()
    dim = len(one[0]["v"]) if one else 0
    heads = first.where(F.size("v") == dim).orderBy(*order).limit(entries).collect() if one else []
    start = whole_numbers(np.array([r["v"] for r in heads], dtype=np.float64).reshape(len(heads), dim), scale)
    cuts = bounds(dim, parts)
    books = Codebooks(dim, scale, [[start[:, cuts[p] : cuts[p + 1]] for p in range(parts)]])
    if not one:
        return books, kept.withColumn(name, F.lit(None).cast("struct<codes: array<int>, error: long>"))
    scratch = common.Scratch(vectors.sparkSession, "vector_codes")
    v = F.col(vector_col)
    right = F.when(_codable(v.cast("array<double>"), dim), v)
    coded = scratch.write(kept.withColumn(name, _assigned(right, None, books.final, dim, scale)), "round0")
    for r in range(rounds):
        new = [b.astype(object) for b in books.final]
        sums = {(s["part"], s["entry"], s["pos"]): int(s["value"]) for s in _sums(coded.select(v.alias("v"), F.col(f"{name}.codes").alias("codes")), dim, parts, scale).collect()}
        for (p, e, pos), n in sums.items():
            if pos < 0:
                new[p][e] = [sums[p, e, i] // n for i in range(cuts[p + 1] - cuts[p])]
        books.rounds.append([b.astype(np.int64) for b in new] if all(abs(int(c)) < EXACT for b in new for c in b.flat) else new)
        again = _assigned(F.when(F.col(f"{name}.codes").isNotNull(), v), F.col(f"{name}.codes"), books.final, dim, scale)
        coded = scratch.write(coded.withColumn(name, again), f"round{r + 1}")
        scratch.drop(f"round{r}")
    return books, coded


def encode(vectors: DataFrame, books: Codebooks, *, vector_col: str = "embedding", name: str = "_al_code") -> DataFrame:
    """The kept ones of other vectors with their codes and errors in the final codebooks, as `compress` gives them for its own."""
    v = F.col(vector_col)
    kept = kept_rows(vectors, vector_col)
    if not len(books.final[0]):
        return kept.withColumn(name, F.lit(None).cast("struct<codes: array<int>, error: long>"))
    return kept.withColumn(name, _assigned(F.when(_codable(v.cast("array<double>"), books.dim), v), None, books.final, books.dim, books.scale))


def code_string(codes: Column, parts: int) -> Column:
    """Codes in hex, two digits each, in the order of parts."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.get(codes, F.lit(p))), 2, "0") for p in range(parts)]))


def with_group_errors(coded: DataFrame, group_col: str, error_col: str, name: str) -> DataFrame:
    """coded, a table that can be read twice, with the sum of the errors of all rows of equal groups, null groups together.
    The sum is null where a code's error is, or where a long can't hold it."""
    g = F.col(group_col)
    total = F.sum(F.col(error_col).cast("decimal(38,0)"))
    small = total.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit(LONGEST).cast("decimal(38,0)"))
    sums = coded.groupBy(g.alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.when(small, total).cast("long").alias(name))
    return common.join_groups(coded, sums, group_col, "_g", "_n")
