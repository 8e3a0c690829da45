"""Links between texts whose sets of five-word shingles have a Jaccard similarity of at least `similarity`.

64 bits of SimHash can't find these: such texts differ in up to 11 bits or so, and a chain of segments that holds for 11 of 64 bits
is too short to tell any two texts apart. So candidates come from minima of BANDS * ROWS hash functions over a text's shingles:
texts that agree in all minima of a band meet there, which at 0.8 misses a pair once in 2,000 or more (and more seldom above).
Each text of a band pairs with two of the band's texts only, which differ by band, never with all; every pair is then checked on the whole texts.
Pairs whose ends are in one class already aren't checked: they can't change a class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from . import common
from .components import components

WORDS = 5
BANDS, ROWS = 20, 5
SEED = 7
#: One odd factor and one summand for each hash function, by rule.
FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}", SEED) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)
SUMMANDS = np.array([xxhash.xxh64_intdigest(f"summand {i}", SEED) for i in range(BANDS * ROWS)], dtype=np.uint64)
BLOCK = 1 << 12


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles' hashes, in blocks."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK, None] * FACTORS + SUMMANDS).min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band; none without shingles."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = minima(hashes).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least)], dtype=np.uint64).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def bands(text: pd.Series) -> pd.Series:
    """The band keys of each text; none for one that is null or has no word."""
    from .simhash import shingle_hashes

    return pd.Series([band_keys(shingle_hashes(t, WORDS)) for t in text], dtype=object)


def jaccard(a: str | None, b: str | None) -> float:
    """Of the texts' sets of five-word shingles; 1 where neither has a word."""
    from .simhash import shingle_hashes

    x, y = (np.unique(shingle_hashes(t, WORDS)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


@F.pandas_udf(DoubleType())
def similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _checked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(f, g) of the pairs (t, f, u, g) whose texts are similar enough. texts: t, text, each t once."""
    met = pairs.join(texts, "t").join(texts.select(F.col("t").alias("u"), F.col("text").alias("other")), "u")
    return met.where(similarities("text", "other") >= similarity).select("f", "g").distinct()


def links(marked: DataFrame, docs: DataFrame, text_col: str, found: DataFrame, similarity: float, scratch: common.Scratch) -> DataFrame:
    """found and the links (f, g) that this module adds to it.

    marked: a written table with t (hash of the text), f (its node) and bands, one row a document. docs: the same documents with their
    texts. found: links between nodes that are known."""
    keyed = scratch.write(marked.select("t", "f", F.explode("bands").alias("key")).distinct(), "bands")
    ranked = F.struct(F.xxhash64("key", "t").alias("rank"), F.col("t").alias("u"), F.col("f").alias("g"))  # another order in each band
    ends = keyed.groupBy("key").agg(F.min(ranked).alias("a"), F.max(ranked).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ends = scratch.write(ends.select("key", F.explode(F.array("a", "b")).alias("c")).select("key", "c.u", "c.g"), "band-ends")
    pairs = scratch.write(keyed.join(ends, "key").where("t != u and f != g").select("t", "f", "u", "g").distinct(), "near-pairs")
    # a text's first pair at once; the others only where the classes that come of it leave their ends apart
    first = pairs.groupBy("t", "f").agg(F.min(F.struct("u", "g")).alias("c")).select("t", "f", "c.*")
    first = scratch.write(_open(first, _roots(found, scratch)), "near-first")
    held = docs.select(F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    needed = pairs.select("t").union(pairs.select("u")).distinct()
    texts = scratch.write(held.join(needed, "t", "left_semi").groupBy("t").agg(F.min("text").alias("text")), "near-texts")
    one = scratch.write(found.union(_checked(first, texts, similarity)), "near-one")
    rest = scratch.write(_open(pairs, _roots(one, scratch)).join(first, ["t", "u"], "left_anti"), "near-rest")
    return scratch.write(one.union(_checked(rest, texts, similarity)), "near-links")


def _roots(found: DataFrame, scratch: common.Scratch) -> DataFrame:
    return components(found.select(F.col("f").alias("a"), F.col("g").alias("b")), scratch)


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (t, f, u, g) whose nodes f and g are in different classes. roots: (a, b), the root b of each node a but roots."""
    at = lambda node, name: roots.select(F.col("a").alias(node), F.col("b").alias(name))
    met = pairs.join(at("f", "_al_x"), "f", "left").join(at("g", "_al_y"), "g", "left")
    return met.where(F.coalesce("_al_x", "f") != F.coalesce("_al_y", "g")).select("t", "f", "u", "g")
