"""Mixing sources to target word counts by entropy balancing.

Among all document rates between 0 and CAP that give each source its target of words, the mix takes those
of the greatest entropy. Their form is exponential: rate = min(CAP, exp(lambda_s * size / mean size of s)), with
one dual variable per source. The dual is convex; safeguarded Newton iterations solve it, each one aggregate
over the table of (source, size) counts, which is far smaller than the documents and holds them all. Partial
sums are rounded to whole units before they are added, so the result doesn't depend on the order of addition.

Rates become whole copies by systematic rounding: documents stand in order of size and a source's running
sum of rates hands out a copy at each whole step. Of OFFSETS starting points each source takes the one whose
copies hold the number of words nearest to its target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: No source and no document counts for more than this many times its size.
CAP = 3
WEIGHTS = (1, 2, 3)
MAX_ITERATIONS = 200
TOLERANCE = 1e-7
#: Rates are multiples of 1 / GRID.
GRID = 1_000_000
#: Units of partial sums in the Newton steps, per word.
UNIT = 1000
#: A source is at its target within this share of it, or within so many words, below which the units don't reach.
NEAR_WORDS = 0.01
OFFSETS = 64
#: Cells of one source and size part into so many by the document's hash, or into as many as keep a part at about so many units
#: even where all units are in one cell.
PARTS, PART_UNITS = 64, 100_000
#: Equal rows are dealt with in runs of so many.
RUN = 4096
#: Tables of one row for each source are broadcast up to this many rows.
FEW_SOURCES = 10_000


def _numbered(totals: DataFrame, scratch: common.Scratch) -> DataFrame:
    """totals with `_al_source`: 1, 2, ... by code point, null last. Ranges of sources are numbered apart and moved by the
    sizes of the ranges before, so any number of sources will do."""
    dealt = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_al_range", F.spark_partition_id())
    dealt = scratch.write(dealt, "ranges")
    counts = dealt.groupBy("_al_range").agg(F.count(F.lit(1)).alias("_al_c"))  # a row for each partition
    before = F.coalesce(F.sum("_al_c").over(Window.orderBy("_al_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_al_range").orderBy(F.col("source").asc_nulls_last()))
    met = dealt.withColumn("_al_own", own).join(F.broadcast(counts.select("_al_range", before.alias("_al_before"))), "_al_range")
    return met.select("source", "source_size", (F.col("_al_own") + F.col("_al_before")).cast("long").alias("_al_source"))


def targets(totals: DataFrame, scratch: common.Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Of (source, source_size), one row each: also weight and target.

    Sources stand by code point, null last. Targets share the sum of sizes by weight; a source whose share
    would pass cap times its size gets just that, and the rest shares what remains. The level that one unit of weight
    gets rises with every round in which sources turn out to be capped, and is final when none does: one aggregate a
    round, and three numbers of it on the driver."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_al_source") - 1) % len(weights) + 1).cast("int"))
    t = scratch.write(_numbered(totals, scratch).withColumn("weight", weight), "numbered")
    size = F.col("source_size").cast("decimal(38,0)")
    level, capped = None, F.lit(False)
    while True:
        full = F.lit(False) if level is None else cap * F.col("source_size") <= F.lit(level) * F.col("weight")
        got = t.agg(F.sum(size).alias("all"), F.sum(F.when(full, size)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if not got["weight"]:  # all are capped, or there is none
            capped = F.lit(True)
            break
        nxt = float((got["all"] or 0) - cap * (got["held"] or 0)) / got["weight"]
        capped = full
        if level is not None and nxt <= level:
            break
        level = nxt
    target = F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level).cast("double") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"), "_al_source", capped.alias("_al_full"))


def _rate(dual: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(dual * size / mean, F.lit(5.0))))


def solve(cells: DataFrame, sources: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Adds `_al_dual` to sources. cells: (_al_source, size, _al_n), the number of documents of each size.

    A Newton step on the logarithm of the words taken; where it leaves the bracket that the signs so far give,
    the bracket's middle (or twice the distance, while it is open) stands in. Every source with a target
    between nothing and its cap converges, or the solver raises an error; the others need no dual."""
    inf = F.lit(float("inf"))
    mean = F.col("source_size") / F.col("_al_docs")
    state = sources.join(cells.groupBy(F.col("_al_source").alias("_al_s")).agg(F.sum(F.when(F.col("size") > 0, F.col("_al_n"))).alias("_al_docs")), F.col("_al_source") == F.col("_al_s")).drop("_al_s")
    state = state.withColumn("_al_mean", mean).withColumns({"_al_dual": F.lit(0.0), "_al_low": -inf, "_al_high": inf, "_al_done": F.col("_al_full") | (F.col("source_size") == 0)})
    kept = state.columns
    state, name = scratch.write(state, "dual0"), "dual0"
    small = common.few(state, FEW_SOURCES)
    for i in range(1, MAX_ITERATIONS + 1):
        open_ = state.where(~F.col("_al_done")).select("_al_source", "_al_dual", "_al_mean")
        rate = _rate(F.col("_al_dual"), F.col("size"), F.col("_al_mean"))
        slope = F.when(rate < CAP, rate * F.col("size") / F.col("_al_mean")).otherwise(0.0)
        whole = lambda x: F.sum(F.round(x * F.col("size") * F.col("_al_n") * UNIT).cast("decimal(38,0)")).cast("double") / UNIT
        sums = cells.join(F.broadcast(open_) if small else open_, "_al_source").groupBy(F.col("_al_source").alias("_al_s")).agg(whole(rate).alias("_al_g"), whole(slope).alias("_al_h"))
        g, h, d, t = F.col("_al_g"), F.col("_al_h"), F.col("_al_dual"), F.col("target")
        low, high = F.when(g < t, d).otherwise(F.col("_al_low")), F.when(g > t, d).otherwise(F.col("_al_high"))
        newton = d - F.when((h > 0) & (g > 0), g * F.log(g / t) / h).otherwise(F.lit(None))
        middle = F.when(low == -inf, 2 * high - 1).when(high == inf, 2 * low + 1).otherwise((low + high) / 2)
        step = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        shut = (high < inf) & (low > -inf) & (high - low <= 1e-13 * F.greatest(F.abs(low), F.abs(high)))
        near = (F.abs(g - t) <= F.greatest(TOLERANCE * t, F.lit(NEAR_WORDS))) | shut
        keep = F.col("_al_done") | near
        nxt = state.join(sums, F.col("_al_source") == F.col("_al_s"), "left")
        nxt = nxt.withColumns({"_al_dual": F.when(keep, d).otherwise(step), "_al_low": low, "_al_high": high, "_al_done": keep}).select(*kept)
        state = scratch.write(nxt, f"dual{i}")
        scratch.drop(name)
        name = f"dual{i}"
        if i > 4 and not state.where(~F.col("_al_done")).limit(1).count():  # the first steps are never enough
            return state
    left = state.where(~F.col("_al_done")).count()
    raise RuntimeError(f"{left} sources are off their targets after {MAX_ITERATIONS} Newton steps")


def copies(docs: DataFrame, keys: list[str], scratch: common.Scratch) -> DataFrame:
    """The mix by unit, a unit being all equal rows of (keys, source, size).

    docs: keys, source, size. Gives also source_size, target, _al_m (rows in the unit) and _al_k (rows taken)."""
    units = docs.groupBy(*keys, "source", "size").agg(F.count(F.lit(1)).alias("_al_m"))
    units = scratch.write(units.withColumn("_al_hash", F.xxhash64(*keys)), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("_al_m")).alias("source_size"))
    sources = scratch.write(targets(totals, scratch), "sources")
    small = common.few(sources, FEW_SOURCES)
    hint = F.broadcast if small else (lambda x: x)
    s = sources.select(F.col("source").alias("_al_name"), "_al_source")
    units = units.join(hint(s), F.col("source").eqNullSafe(F.col("_al_name"))).drop("_al_name")
    units = units.withColumn("_al_part", F.pmod("_al_hash", F.lit(max(PARTS, -(-units.count() // PART_UNITS)))))
    parts = scratch.write(units.groupBy("_al_source", "size", "_al_part").agg(F.sum("_al_m").alias("_al_n")), "parts")
    cells = scratch.write(parts.groupBy("_al_source", "size").agg(F.sum("_al_n").alias("_al_n")), "cells")
    state = solve(cells, sources, scratch).withColumnRenamed("_al_source", "_al_s")
    rate = F.when(F.col("source_size") == 0, 1.0).when(F.col("_al_full"), float(CAP)).otherwise(_rate(F.col("_al_dual"), F.col("size"), F.col("_al_mean")))
    rated = cells.join(hint(state.select("_al_s", "source_size", "target", "_al_full", "_al_dual", "_al_mean")), F.col("_al_source") == F.col("_al_s"))
    rated = rated.withColumn("_al_rate", F.round(rate * GRID).cast("long")).select("_al_source", "size", "_al_n", "_al_rate", "source_size", "target")
    running = Window.partitionBy("_al_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("_al_first", F.coalesce(F.sum(F.col("_al_rate") * F.col("_al_n")).over(running), F.lit(0)))
    within = Window.partitionBy("_al_source", "size").orderBy("_al_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_al_skip", F.coalesce(F.sum("_al_n").over(within), F.lit(0))).drop("_al_n")
    starts = offsets.join(rated.drop("_al_n"), ["_al_source", "size"]).withColumn("_al_first", F.col("_al_first") + F.col("_al_skip") * F.col("_al_rate"))
    order = Window.partitionBy("_al_source", "size", "_al_part").orderBy("_al_hash", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("_al_ahead", F.coalesce(F.sum("_al_m").over(order), F.lit(0))).join(starts.drop("_al_skip"), ["_al_source", "size", "_al_part"])
    at = F.col("_al_first") + F.col("_al_ahead") * F.col("_al_rate")
    placed = scratch.write(placed.withColumn("_al_at", at).select(*keys, "source", "size", "_al_m", "_al_source", "_al_rate", "_al_at", "source_size", "target"), "placed")
    steps = lambda x, o: F.floor((x + o) / GRID)
    taken = lambda o: steps(F.col("_al_at") + F.col("_al_m") * F.col("_al_rate"), o) - steps(F.col("_al_at"), o)
    tried = [F.lit(GRID * (2 * i + 1) // (2 * OFFSETS)) for i in range(OFFSETS)]
    sums = placed.groupBy("_al_source").agg(F.first("target").alias("_al_t"), *[F.sum(taken(o) * F.col("size")).alias(f"_al_o{i}") for i, o in enumerate(tried)])
    best = reduce(F.least, [F.struct(F.abs(F.col(f"_al_o{i}") - F.col("_al_t")).alias("off"), o.alias("at")) for i, o in enumerate(tried)])
    best = sums.select(F.col("_al_source").alias("_al_s"), best["at"].alias("_al_o"))
    out = placed.join(hint(best), F.col("_al_source") == F.col("_al_s"))
    return out.select(*keys, "source", "size", "source_size", "target", "_al_m", taken(F.col("_al_o")).alias("_al_k"))


def _spread(total: Column, rows: Column, j: Column) -> Column:
    """The part of row j (from 0) when a total is dealt evenly over so many rows."""
    return F.floor((j + 1) * total / rows) - F.floor(j * total / rows)


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, size, source_size, target, taken and copies.

    A null text or one without words has size 0 and takes nothing; texts of any length count whole; a null source is a
    source of its own, the last; null ids and repeated rows count like others, and equal rows share their copies as evenly
    as whole copies allow; documents of one size tie by the hash of their ids; an empty table gives an empty result. Other
    columns of docs don't matter."""
    scratch = common.Scratch(docs.sparkSession, "mix")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(common.words(F.col(text_col))).cast("long").alias("size"))
    units = copies(sized, ["doc_id"], scratch)
    runs = units.withColumn("_al_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_al_m") - 1) / RUN))))
    rows = runs.withColumn("_al_j", F.explode(F.sequence(F.col("_al_run") * RUN, F.least(F.col("_al_run") * RUN + RUN, F.col("_al_m")) - 1)))
    rows = rows.withColumn("copies", _spread(F.col("_al_k"), F.col("_al_m"), F.col("_al_j")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs, whatever their names and types.

    A row is known by 128 bits of hash over all its columns; repeated rows share the copies of all of them. Texts without
    words have size 0 and are taken once. An empty table gives an empty result."""
    scratch = common.Scratch(docs.sparkSession, "mixed")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, source = names[docs.columns.index("text")], names[docs.columns.index("source")]
    plain = docs.toDF(*names)
    keyed = plain.withColumn("key", common.row_key(plain))
    sized = keyed.select("key", F.col(source).alias("source"), F.size(common.words(F.col(text))).cast("long").alias("size"))
    taken = copies(sized, ["key"], scratch).where("_al_k > 0").select(F.col("key").alias("own"), "_al_k")
    joined = keyed.dropDuplicates(["key"]).join(taken, F.col("key") == F.col("own"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_al_k")))).select(*names).toDF(*docs.columns)
