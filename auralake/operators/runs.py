"""Counts of the words of texts, and of runs of words, a slice of an Arrow column at a time: a task counts its slice as arrays and
hands on one row for each different word or run; Spark adds them up. Where it is known which words and pairs will be asked
for, a set of bits of bounded size tells a task which ones to hand on, and a task adds up what its slices have in common."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in one slice; a longer text is one of its own.
SLICE_BYTES = 8 << 20
#: The blanks of `text.words` become spaces.
_SPACES = bytes.maketrans(b"\t\n\r", b"   ")
SEED = 42
#: Joins the hashes of a pair to one.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of counts that a task holds of words, and of pairs, before it adds them up.
SUMS = 64 << 20
#: A set of hashes has 2 to this power bits; it follows the bytes of the texts, and beyond the most it lets more pass.
LEAST_BITS, MOST_BITS = 20, 28
#: Bytes of a set in one row, as `bitmap_or_agg` has them.
PAGE = 4096


def _coded(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """By slice: its different words, and for each word in order its place among them and the row of its text."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    plain = pa.Array.from_buffers(column.type, len(column), [None, offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_SPACES))], 0, column.offset)
    ends, at = np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(plain):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        lists = pc.split_pattern(plain.slice(at, end - at), " ")
        words = lists.flatten()
        rows = np.repeat(np.arange(end - at), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        there = pc.not_equal(words, "")
        found = words.filter(there).dictionary_encode()
        yield found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows[there.to_numpy(zero_copy_only=False)]
        at = end


def _hashes(different: pa.Array, prefix: str) -> np.ndarray:
    """The XXH64 of each word behind a prefix, unsigned."""
    words = different.to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, [prefix + w for w in words] if prefix else words, repeat(SEED)), np.uint64, len(different))


def _held(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key whether the set may have it: true for all that were put in, and for as many others as its bits are filled."""
    at = keys >> np.uint64(64 - (len(held) * 8).bit_length() + 1)
    return (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _added(tables: list[pa.Table]) -> pa.Table:
    """The rows of tables (a, n) or (a, b, n), or of their sums, with n added up by key as n_sum."""
    every = pa.concat_tables([t.rename_columns([*t.column_names[:-1], "n"]) if "n_sum" in t.column_names else t for t in tables])
    return every.group_by(every.column_names[:-1], use_threads=False).aggregate([("n", "sum")])


def asked(texts: DataFrame, text: str, prefix: str) -> Broadcast:
    """The set of the words and pairs of texts, for `together`. Each core gathers bits of its own, Spark joins them by pages, and
    what reaches the driver and the tasks is one set, 32 MB at most, however large the texts are."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text).cast("string").alias(text))
    bits = min(max(int(texts.agg(F.sum(F.octet_length(text))).first()[0] or 0).bit_length(), LEAST_BITS), MOST_BITS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for different, places, rows in _coded(batch.column(0)):
                hashes = _hashes(different, prefix)
                first = np.flatnonzero(rows[:-1] == rows[1:])
                for keys in (hashes, hashes[places[first]] * MIX + hashes[places[first + 1]]):
                    at = keys >> np.uint64(64 - bits)
                    bit = at & np.uint64(7)
                    for i in range(8):
                        some = at[bit == i] >> np.uint64(3)
                        held[some] |= np.uint8(1 << i)
        pages = held.reshape(-1, PAGE)
        filled = np.flatnonzero(pages.any(axis=1))
        for at in range(0, len(filled), 256):
            some = filled[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pages[i].tobytes() for i in some], pa.binary())], ["page", "held"])

    rows = texts.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(gather, "page int, held binary").groupBy("page").agg(F.bitmap_or_agg("held").alias("held"))
    held = np.zeros(((1 << bits) // 8 // PAGE, PAGE), np.uint8)
    for r in rows.collect():
        held[r.page] = np.frombuffer(r.held, np.uint8)
    return spark.sparkContext.broadcast(held.reshape(-1))


def together(docs: DataFrame, text: str, order: int, prefix: str, few: Broadcast | None = None, also: DataFrame | None = None) -> DataFrame:
    """(ord, word, _w0, _w1, n) from one pass over the texts: ord 0, how many words there are; 1, each word and how often it comes;
    2, if order is 2, each pair of words within a text, as hashes, and how often it comes. few: the set of words and pairs
    that will be asked for; of the others, some don't come out. Counts are whole, whether or not there is a set. also: texts whose
    words all come out, if only with a count of 0; nothing of theirs is counted."""
    names = ["ord", "word", "_w0", "_w1", "n"]

    def out(k: int, n: pa.Array, word: pa.Array | None = None, pair: list[pa.Array] | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.nulls(len(n), pa.string()) if word is None else word, *(pair or [none, none]), n], names)

    def summed(parts: Iterator[tuple[int, list[pa.Array], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Counts (order, key, n) as rows of sums; keys that a task meets again are added up here, as far as it may hold them."""
        held: dict[int, list[pa.Table]] = {1: [], 2: []}
        for k, key, n in parts:
            held[k].append(pa.table([*key, pa.array(n, pa.int64())], [*"ab"[: len(key)], "n"]))
            if sum(t.nbytes for t in held[k]) > SUMS:
                held[k] = [_added(held[k])]
                if held[k][0].nbytes > SUMS // 2:
                    yield from hand_on(k, held[k].pop())
        for k, tables in held.items():
            if tables:
                yield from hand_on(k, _added(tables))

    def hand_on(k: int, sums: pa.Table) -> Iterator[pa.RecordBatch]:
        for some in sums.combine_chunks().to_batches(1 << 16):
            yield out(k, some["n_sum"], *([some["a"]] if k == 1 else [None, [some["a"], some["b"]]]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0

        def parts() -> Iterator[tuple[int, list[pa.Array], np.ndarray]]:
            nonlocal total
            for batch in batches:
                for different, places, rows in _coded(batch.column(0)):
                    total += len(places)
                    hashes = _hashes(different, prefix) if few or order > 1 else None
                    sums, words = np.bincount(places, minlength=len(different)), different.cast(pa.string())
                    if few:
                        known = _held(few.value, hashes)
                        sums, words = sums[known], words.filter(pa.array(known))
                    yield 1, [words], sums
                    if order > 1:
                        first = np.flatnonzero(rows[:-1] == rows[1:])
                        a, b = places[first], places[first + 1]
                        if few:
                            both = known[a] & known[b]
                            a, b = a[both], b[both]
                            both = _held(few.value, hashes[a] * MIX + hashes[b])
                            a, b = a[both], b[both]
                        pairs, sums = np.unique(a * max(len(different), 1) + b, return_counts=True)
                        a, b = np.divmod(pairs, max(len(different), 1))
                        yield 2, [pa.array(hashes[x].view(np.int64)) for x in (a, b)], sums

        yield from summed(parts())
        yield out(0, pa.array([total], pa.int64()))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (different.cast(pa.string()) for batch in batches for different, _, _ in _coded(batch.column(0)))
        yield from summed((1, [words], np.zeros(len(words), np.int64)) for words in slices)

    schema = "ord int, word string, _w0 long, _w1 long, n long"
    found = docs.select(F.col(text).cast("string")).mapInArrow(count, schema)
    if also is not None:
        found = found.union(also.select(F.col(text).cast("string")).mapInArrow(name, schema))
    return found.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): each word of the texts and how often it comes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for different, places, _ in _coded(batch.column(0)):
                yield pa.RecordBatch.from_arrays([different.cast(pa.string()), pa.array(np.bincount(places, minlength=len(different)), pa.int64())], ["word", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, text: str, size: int, prefix: str) -> DataFrame:
    """(_w0, _w1, ..., n): every run of `size` words within a text and how often it comes. A word is its XXH64 behind a prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for different, places, rows in _coded(batch.column(0)):
                n, many = max(len(places) - size + 1, 0), max(len(different), 1)
                inside = np.flatnonzero(rows[:n] == rows[size - 1 :])
                key, some = places[inside], [places[inside + i] for i in range(size)]
                for i in range(1, size):
                    if i > 1 and many ** (i + 1) >= 1 << 63:  # as places among the different ones so far
                        key = np.unique(key, return_inverse=True)[1]
                    key = key * many + some[i]
                order = np.argsort(key)
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                sums = np.diff(np.append(first, len(order)))
                hashes = _hashes(different, prefix).view(np.int64)
                found = [pa.array(hashes[x[order[first]]], pa.int64()) for x in some]
                yield pa.RecordBatch.from_arrays([*found, pa.array(sums, pa.int64())], [*[f"_w{i}" for i in range(size)], "n"])

    columns = [f"_w{i}" for i in range(size)]
    found = docs.select(F.col(text).cast("string")).mapInArrow(count, ", ".join(f"{c} long" for c in columns) + ", n long")
    return found.groupBy(*columns).agg(F.sum("n").alias("n"))
