"""Connected components of a graph of links, by alternating star contractions in Spark.

Each round points every node at the least node it has met (large star: the larger neighbours; small star: the
smaller ones), which keeps the graph connected and flattens it to stars in about log^2 n rounds. Minima are
taken by partial aggregation into a written table and joined back. Both sides of that join are read and dealt anew, so
Spark's skew join may split a node with a very large neighbourhood over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(links: DataFrame, larger: bool, scratch: common.Scratch, name: str) -> DataFrame:
    """links (a, b) with a > b. One contraction of either kind."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    least = scratch.write(least, f"{name}-least")
    if larger:  # every larger neighbour moves to the least of the neighbourhood
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # the smaller neighbours and the node itself do
        moved = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return scratch.write(moved.where("a > b").distinct(), name)


def components(links: DataFrame, scratch: common.Scratch, rounds: int = 60) -> DataFrame:
    """(a, b), the least node b of the component of each linked node a other than b itself.

    links: (a, b) of longs, in any order and number; links of a node to itself don't count."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, last = scratch.write(now, "links0"), None
    for i in range(1, rounds + 1):
        now = _stars(_stars(now, True, scratch, f"large{i}"), False, scratch, f"links{i}")
        for used in (f"large{i}-least", f"large{i}", f"links{i}-least"):
            scratch.drop(used)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if i > 1:
            scratch.drop(f"links{i - 1}")
        if tuple(state) == last:
            return now
        last = tuple(state)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
