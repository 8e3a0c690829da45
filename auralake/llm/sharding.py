"""Sharding by a keyed permutation of global row numbers.

Every row gets a number from 0 to N - 1 that depends only on the table's contents. A Feistel network over
Z_a x Z_b (a * b is the least such product at or above N with a near the root of N) permutes the numbers,
and values at or above N walk their cycle until they fall below it. Row number p of the shuffled order lies
in shard p mod shards, at slot p div shards, so both are computable from the number and back.

The plan numbers rows without a global sort: rows hash into BUCKETS buckets, the bucket sizes (BUCKETS rows,
so broadcast is bounded) give each bucket's first number, and a window inside each bucket gives the rest.
Equal rows are counted before the shuffle and expanded after it, so a row that repeats without end fills no
single task.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 16384
ROUNDS = 8
#: Copies of one row are numbered in runs of so many.
RUN = 4096


def _radices(n: int) -> tuple[int, int]:
    a = isqrt(n - 1) + 1 if n > 1 else 1
    return a, -(-n // a)


def _network(x: Column, a: int, b: int, seed: int, inverse: bool = False) -> Column:
    """One pass of the Feistel network over 0 <= x < a * b."""
    part = lambda half, i, size: F.pmod(F.xxhash64(half, F.lit(seed), i), F.lit(size))
    sign = -1 if inverse else 1
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s.l + sign * part(s.r, i, a), F.lit(a))).otherwise(s.l)
        right = F.when(i % 2 == 1, F.pmod(s.r + sign * part(s.l, i, b), F.lit(b))).otherwise(s.r)
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda s: s.l * b + s.r)


def permute(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """A permutation of 0 .. n - 1. A walk has at most a * b - n further steps, which is below the root of n,
    and about one row in that many walks at all."""
    if n <= 1:
        return x
    a, b = _radices(n)
    y = _network(x, a, b, seed, inverse)
    if a * b == n:
        return y
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), y, lambda v, _: F.when(v >= n, _network(v, a, b, seed, inverse)).otherwise(v))
    return F.when(y >= n, walk).otherwise(y)


def _units(rows: DataFrame) -> DataFrame:
    """The distinct rows, how often each occurs, and their buckets; a written table, so that rows are read once."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    units = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_al_m")).withColumn("_al_print", common.row_print(rows))
    return common.Scratch(rows.sparkSession, "shards").write(units.withColumn("_al_bucket", F.pmod("_al_print", F.lit(BUCKETS))), "units")


def _numbered(units: DataFrame, names: list[str]) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in names]
    sizes = units.groupBy("_al_bucket").agg(F.sum("_al_m").alias("_al_size"))
    before = Window.orderBy("_al_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    starts = sizes.select("_al_bucket", F.coalesce(F.sum("_al_size").over(before), F.lit(0)).alias("_al_start"))
    inside = Window.partitionBy("_al_bucket").orderBy("_al_print", *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("_al_off", F.coalesce(F.sum("_al_m").over(inside), F.lit(0))).join(F.broadcast(starts), "_al_bucket")
    first = F.col("_al_start") + F.col("_al_off")
    runs = placed.withColumn("_al_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_al_m") - 1) / RUN))))
    copy = F.explode(F.sequence(F.col("_al_run") * RUN, F.least(F.col("_al_run") * RUN + RUN, F.col("_al_m")) - 1))
    return runs.select(*cols, first.alias("_al_first"), copy.alias("_al_copy")).select(*cols, (F.col("_al_first") + F.col("_al_copy")).alias("_al_row"))


def number_rows(rows: DataFrame) -> DataFrame:
    """rows with `_al_row`: 0 .. N - 1, each once, the same on every run. Equal rows take neighbouring numbers. A column
    of rows named `_al_...` is an error."""
    if any(c.lower().startswith("_al_") for c in rows.columns):
        raise ValueError("columns named _al_... are the operator's own")
    return _numbered(_units(rows), rows.columns)


def shard_rows(rows: DataFrame, shards: int, seed: int = 20240229) -> DataFrame:
    """rows with `shard` (int) and `slot` (long): shard sizes differ by one at most, slots have no gaps.

    An empty table gives an empty result; null values number like any other; equal rows take places of their own, which
    of them takes which says nothing; columns of rows named shard or slot are replaced, and columns named `_al_...` are
    an error. Values of columns move whole, so long texts are better sharded by `shard_documents`."""
    rows = rows.drop("shard", "slot")
    if any(c.lower().startswith("_al_") for c in rows.columns):
        raise ValueError("columns named _al_... are the operator's own")
    units = _units(rows)
    n = units.agg(F.coalesce(F.sum("_al_m"), F.lit(0))).first()[0]
    place = permute(F.col("_al_row"), n, seed)
    cols = [F.col(f"`{c}`") for c in rows.columns]
    out = _numbered(units, rows.columns).select(*cols, place.alias("_al_place"))
    return out.select(*cols, (F.col("_al_place") % shards).cast("int").alias("shard"), ((F.col("_al_place") - F.col("_al_place") % shards) / shards).cast("long").alias("slot"))


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 20240229) -> Column:
    """The row number that lies at a shard's slot: the way back."""
    return permute(slot * shards + shard, n, seed, inverse=True)


def shard_documents(docs: DataFrame, shards: int, seed: int = 20240229) -> DataFrame:
    """docs with `shard` and `slot`. Only 128-bit row hashes are numbered, so texts of any length then move once.

    Rows with nulls, repeated rows and columns of any type and name pass through, but for shard and slot, which are
    replaced. An empty table gives an empty result."""
    docs = docs.drop("shard", "slot")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    keyed = plain.withColumn("key", common.row_key(plain))
    places = shard_rows(keyed.select(F.col("key.a").alias("a"), F.col("key.b").alias("b")), shards, seed)
    once = keyed.dropDuplicates(["key"])
    joined = once.join(places, (once.key.a == places.a) & (once.key.b == places.b))
    return joined.select(*names, "shard", "slot").toDF(*docs.columns, "shard", "slot")
