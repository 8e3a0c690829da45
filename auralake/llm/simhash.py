"""Near-duplicates by SimHash fingerprints, candidates pruned by pigeonring chains.

A fingerprint splits into SEGMENTS segments in a ring. If two fingerprints differ in at most DISTANCE bits then, from
some segment on, every chain of l consecutive segments differs in at most l * DISTANCE / SEGMENTS bits: with 2 bits and
3 segments the first segment is equal, the first two differ in one bit at most, all three in two. The first two chains make
the join keys: an equal segment, and, since one bit can't touch both halves of the next one, an equal half of
it. So keys have about 32 bits, and what they bring together passes the chain check before the Hamming check.

Equal fingerprints are one node from the start. A key that more than CROWD different fingerprints share isn't
expanded into pairs: its fingerprints meet over the 65 fingerprints within one bit of each, where two
differ in at most two bits exactly if they have one of those in common. At most 65 can meet there, so no
group is large, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common, nearcopies
from .components import components

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
#: First bit and width of each segment; together they are the 64 bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CROWD = 64


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of `size` words; of the whole sequence where there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))) + np.arange(len(words))).tolist()
    starts = [0, *[e + 1 for e in ends]]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype=np.uint64)  # noqa: B905


def fingerprint(text: str | None) -> int:
    """A bit is 1 if set in over half of the hashes; as a signed long."""
    h = shingle_hashes(text)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([fingerprint(t) for t in s], dtype="int64")


def _bits(x: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(f: Column) -> Column:
    """The join keys of a fingerprint: (segment, half of the next) for each segment and half."""
    out = []
    for i, (first, width) in enumerate(SEGMENTS):
        nxt, w = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (at, size) in enumerate(((nxt, w // 2), (nxt + w // 2, w - w // 2))):
            tag = F.lit((i * 2 + half) << 40).cast("long")
            out.append(tag + F.shiftleft(_bits(f, first, width), 16) + _bits(f, at, size))
    return F.array(*out)


def _chains(x: Column, y: Column) -> Column:
    """True if from some segment on every chain stays within its budget."""
    d = [F.bit_count(_bits(x.bitwiseXOR(y), first, width)) for first, width in SEGMENTS]
    n = len(d)
    held = lambda i: [sum((d[(i + k) % n] for k in range(1, length)), d[i]) * n <= length * DISTANCE for length in range(1, n + 1)]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, held(i)) for i in range(n)])


def links(nodes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(f, g): links between different fingerprints f within DISTANCE bits that connect all that the full set of
    such links connects. nodes: f, each once."""
    keyed = scratch.write(nodes.select("f", F.explode(_keys(F.col("f"))).alias("key")), "keyed")
    shared = scratch.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    few = keyed.join(shared.where(F.col("n") <= CROWD).select("key"), "key")
    x, y = few.select("key", F.col("f").alias("x")), few.select("key", F.col("f").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE
    pairs = x.join(y, "key").where("x < y").where(_chains(F.col("x"), F.col("y"))).where(near).select(F.col("x").alias("f"), F.col("y").alias("g"))
    crowd = keyed.join(shared.where(F.col("n") > CROWD).select("key"), "key").select("f").distinct()
    around = F.array(F.col("f"), *[F.col("f").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(BITS)])
    met = crowd.select("f", F.explode(around).alias("v")).groupBy("v").agg(F.collect_list("f").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.explode(F.slice(F.col("all"), 2, BITS + 1)).alias("f"), F.col("all")[0].alias("g"))
    return pairs.union(stars).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), similarity: float | None = None) -> DataFrame:
    """Each row's id, its fingerprint `f` (signed long), `root` and component_id: the least fingerprint and the least
    id of its near-duplicate class; then the columns named in carry. No two classes share a root; they may share a
    component_id, where ids repeat or are null.

    Null, empty and blank texts have fingerprint zero and link like any other; texts of any length are hashed whole, in
    blocks of hashes. With a similarity, texts whose sets of five-word shingles have at least that Jaccard similarity link, too
    (`nearcopies`). Ids that repeat are one document for every row's class; null ids never name a class unless it has no
    other id; a tie between half of the hashes leaves a bit unset. An empty table gives an empty result. Other columns of
    docs don't matter, but those in carry keep their names, which must differ from the five above and from t and bands."""
    scratch = common.Scratch(docs.sparkSession, "simhash")
    near = () if similarity is None else (F.xxhash64(F.col(text_col)).alias("t"), nearcopies.bands(F.col(text_col)).alias("bands"))
    marked = scratch.write(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("f"), *carry, *near), "marked")
    nodes = scratch.write(marked.groupBy("f").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes.select("f"), scratch)
    if similarity is not None:
        found = nearcopies.links(marked, docs, text_col, scratch.write(found, "links"), similarity, scratch)
    roots = scratch.write(components(found.select(F.col("f").alias("a"), F.col("g").alias("b")), scratch), "roots")
    rooted = nodes.join(roots.select(F.col("a").alias("f"), F.col("b").alias("_al_b")), "f", "left").withColumn("root", F.coalesce("_al_b", "f"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that both sides of the last join are read and dealt anew, and a fingerprint that a third of all rows share
    # (that of empty texts, say) can be split
    named = scratch.write(rooted.select("f", "root").join(scratch.write(least, "least"), "root").select("f", "root", "component_id"), "named")
    return marked.join(named, "f").select("doc_id", "f", "root", "component_id", *carry)


def as_hex(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))
