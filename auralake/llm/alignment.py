"""Alignment of two tokenizers' tokens of the same texts, and corpus-wide counts of the pairs of ids that meet.

Both tokenizations tile the same bytes. B's tokens are a static interval index; each A token's first and last overlapping B
token come from two bisections. A gap between A tokens that no B token spans ends a group. Tokens never lie across the
words that `encoding` cuts at, so each different word is aligned once for a worker's cache, all new words of a slice on one
axis of bytes, and a document's results are sums and joins of its words'.

Counts of pairs: a document's different pairs shuffle as (pair, number) after partial sums. They come back to the documents in
one of two ways: a table of at most BROADCAST_PAIRS pairs is broadcast, a larger one meets the documents' pairs in a join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, encoding

#: A pair is A's id times 2**ID_BITS plus B's.
ID_BITS = 32
#: The most pairs, at 17 bytes each, that are broadcast.
BROADCAST_PAIRS = 1 << 20
STATS = ("n_a", "n_b", "n_groups", "n_links")
FIELDS = [*[(c, pa.int64()) for c in STATS], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
KIND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, closes) for each A token: the first and last B token that overlap it, and whether no B token spans the
    gap behind it. Tokens are given by the ends of their bytes; both lists tile the same bytes from 0."""
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_starts, a_ends, side="left") - 1
    return first, last, np.r_[first[1:] > last[:-1], True] if len(a_ends) else np.zeros(0, dtype=bool)


def _joined(values: np.ndarray, sizes: np.ndarray, mark: str) -> pa.Array:
    """Runs of numbers in decimal, joined by mark."""
    return _join(pa.array(values).cast(pa.large_string()), sizes, mark)


def _join(strings: pa.Array, sizes: np.ndarray, mark: str) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int64()), strings)
    return pc.binary_join(lists, pa.scalar(mark, pa.large_string()))


class Aligner:
    """A worker's cache of aligned words."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoding.ByteLevel(a_path, plain=True), encoding.Pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        self.words = encoding.Words(self._learn, self._forget, self.a.splits and self.b.splits, encoding.MARK)
        self._forget()

    def _forget(self) -> None:
        self.stats = np.zeros((0, len(STATS) + 1), np.int64)
        self.groups = pa.array([], pa.large_string())
        self.links, self.numbers, self.pairs = encoding.Ragged(np.int64), {}, np.zeros(0, np.int64)

    def _same(self, words: list[str], tokens: tuple, bytes_of: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether each word's tokens give its bytes."""
        ids, counts = tokens
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        got = np.add.reduceat(np.r_[sizes[ids], 0], np.r_[0, np.cumsum(counts)[:-1]]) if len(words) else want
        got = np.where(counts == 0, 0, got)
        if (got == want).all() and b"".join(map(bytes_of.__getitem__, ids.tolist())) == b"".join(raw):
            return np.ones(len(words), dtype=bool)
        ends = np.cumsum(counts)
        return np.array([b"".join(map(bytes_of.__getitem__, ids[e - n : e].tolist())) == r for e, n, r in zip(ends, counts, raw, strict=True)])

    def _learn(self, words: list[str]) -> None:
        a, b = self.a.encode(words), self.b.encode(words)
        right = self._same(words, a, self.a.bytes, self.a_sizes) & self._same(words, b, self.b.bytes, self.b_sizes)
        (a_ids, a_n), (b_ids, b_n) = ((ids[np.repeat(right, n)], np.where(right, n, 0)) for ids, n in (a, b))
        first, last, closes = overlaps(np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]))
        met = last - first + 1
        ends = np.cumsum(met)
        b_at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - met), met)
        keys = (np.repeat(a_ids, met).astype(np.int64) << ID_BITS) | b_ids[b_at]
        of_word = np.repeat(np.arange(len(words)), a_n)
        per_word = lambda x: np.bincount(of_word, weights=x, minlength=len(words)).astype(np.int64)
        n_links, n_groups = per_word(met), per_word(closes)
        self.stats = np.concatenate([self.stats, np.stack([a_n, b_n, n_groups, n_links, right], axis=1)])
        shut = np.flatnonzero(closes)
        a_sides = _joined(a_ids, np.diff(shut, prepend=-1), ",")
        b_sides = _joined(b_ids, np.diff(last[shut], prepend=-1), ",")
        groups = _join(pc.binary_join_element_wise(a_sides, b_sides, pa.scalar("|", pa.large_string())), n_groups, ";")
        self.groups = pa.concat_arrays([self.groups, groups])
        different, which = np.unique(keys, return_inverse=True)
        listed = different.tolist()
        fresh = [k for k in listed if k not in self.numbers]
        self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh)), strict=True))
        self.pairs = np.concatenate([self.pairs, np.array(fresh, np.int64)])
        self.links.add(np.fromiter(map(self.numbers.__getitem__, listed), np.int64, len(listed))[which], n_links)

    def align(self, texts: pa.Array) -> pa.StructArray:
        """A row for each text, as in FIELDS: its pairs, each once, and how often they are linked in it. Texts that are null, empty,
        or whose tokens don't give back a space and the text have zeros, no pairs and an empty string."""
        texts = pc.fill_null(texts, "")
        words, sizes = self.words.of(texts, " ")
        begin, doc = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(texts)), sizes)
        right = (np.minimum.reduceat(self.stats[words, -1], begin) > 0) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        stats = np.add.reduceat(self.stats[words, :-1], begin, axis=0) * right[:, None]
        kept = right[doc]
        words, doc, sizes = words[kept], doc[kept], np.where(right, sizes, 0)
        joined = _join(self.groups.take(pa.array(words)), sizes, ";")
        prints = [hashlib.sha256(x.as_buffer()).hexdigest() if r else "" for x, r in zip(joined, right, strict=True)]
        both, n = np.unique(doc * (len(self.stats) + 1) + words, return_counts=True)
        doc, words = np.divmod(both, len(self.stats) + 1)
        links, met = self.links.take(words)
        key, n = np.repeat(doc, met) * (len(self.pairs) + 1) + links, np.repeat(n, met)
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(n[order], head) if len(key) else np.zeros(0, np.int64)
        doc, pair = np.divmod(key[head], len(self.pairs) + 1)
        offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
        columns = [*[pa.array(stats[:, i]) for i in range(len(STATS))], pa.array(prints, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(self.pairs[pair], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
        return pa.StructArray.from_arrays(columns, [name for name, _ in FIELDS])


_aligners: dict = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def aligned(text: Column, a_path: str, b_path: str) -> Column:
    """A struct of the number of A and B tokens, groups and links of a text, the SHA-256 of its groups (`a1,a2|b1;a3|b2,b3`), and its
    different pairs of ids with how often each is linked. Whole texts of any length; null texts as empty ones."""

    @F.arrow_udf(KIND)
    def align(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = _aligner(a_path, b_path)
        for column in columns:
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            out = [state.align(some) for some in encoding.slices(column)]
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct(FIELDS))

    return align(text)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of found hold each pair, and whether no pair of the same A id is held by more."""
    n = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n").alias("most"))
    return n.withColumn("a", F.shiftright("pair", ID_BITS)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(found: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.orderBy("pair").toArrow()
    pairs, n, best = (table[c].to_numpy() for c in ("pair", "n", "best"))

    @F.arrow_udf(T.StructType().add("n_best", "long").add("count_sum", "long"))
    def look(ids: pa.Array, times: pa.Array) -> pa.Array:
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        at, t = np.searchsorted(pairs, ids.flatten().to_numpy(zero_copy_only=False)), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        summed = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
        return pa.StructArray.from_arrays([pa.array(summed(t * best[at])), pa.array(summed(t * n[at]))], ["n_best", "count_sum"])

    return found.withColumn("_s", look("pairs", "times")).select("*", "_s.n_best", "_s.count_sum").drop("_s")


def _joined_up(found: DataFrame, counts: DataFrame) -> DataFrame:
    held = found.select("_row", F.arrays_zip("pairs", "times").alias("z")).select("_row", F.explode("z").alias("z")).select("_row", F.col("z.pairs").alias("pair"), F.col("z.times").cast("long").alias("t"))
    marked = counts.select(F.col("pair").alias("of"), "n", F.col("n").alias("rows"), "best")
    met = common.join_groups(held, marked, "pair", "of", "rows")
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    return found.join(sums, "_row", "left").na.fill(0, ["n_best", "count_sum"])


def align_corpus(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents: id, the counts of `aligned`, `n_best` (links whose pair is the one of its A id that most
    documents hold, ties included) and `count_sum` (over links, how many documents hold the pair). Pairs: what `pair_counts` gives.

    Every row is a document, repeated ids and null ids too. Texts without tokens count in no pair. Empty tables give empty
    ones. Results are the same whether pairs are broadcast or joined."""
    scratch = common.Scratch(docs.sparkSession, "alignment")
    found = docs.select(F.col(id_col).alias("doc_id"), aligned(F.col(text_col), a_path, b_path).alias("_al")).select("doc_id", "_al.*")
    found = scratch.write(found.withColumn("_row", F.monotonically_increasing_id()), "found")
    counts = scratch.write(pair_counts(found), "counts")
    out = (_looked_up if common.few(counts, broadcast_pairs) else _joined_up)(found, counts)
    return out.select("doc_id", *STATS, "n_best", "count_sum", "groups_sha256"), counts
