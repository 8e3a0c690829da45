"""Benchmark decontamination with suffix arrays of the documents.

Each batch of documents that a task reads is a shard. Its words become numbers of the benchmark's vocabulary;
runs of known words too short to hold a window are left out, since no match can touch them; the suffixes of
the rest are sorted, and every suffix of the benchmark is binary-searched among them by its first window, those that
share one at once. From each place where a whole window occurs the match is followed as far as any suffix of the benchmark
goes along: the longest verbatim match there, and where it lies in the document and in the benchmark.

The benchmark goes to the workers in blocks of at most BLOCK_WORDS words, one pass for each block, and each pass's broadcast
goes before the next, so what is held stays bounded however long the benchmark is. With one block documents don't
move at all; with more, the matches of each pass are written, and the documents meet them once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Words of a block of the benchmark, but for a longer single item.
BLOCK_WORDS = 1_000_000
#: Words of one shard at most, but for a longer single document.
SHARD_WORDS = 2_000_000

_table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def text_words(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_table).split() if text else []


class Benchmark:
    """The items' words as numbers, item after item, a 0 between. Windows that are equal share a number."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, parts, starts, widths, owners, at = [], [np.zeros(1, dtype=np.int32)], [], [], [], 1
        for k, (item, text) in enumerate(items):
            self.ids.append(item)
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in text_words(text)]
            width = min(window, len(w))
            for i in range(len(w) - width + 1 if w else 0):
                starts.append(at + i)
                widths.append(width)
                owners.append(k)
            parts.append(np.array([*w, 0], dtype=np.int32))
            at += len(w) + 1
        self.words = np.concatenate(parts)
        self.starts, self.widths, owners = np.array(starts, dtype=np.int64), np.array(widths, dtype=np.int64), np.array(owners, dtype=np.int64)
        self.least = int(self.widths.min(initial=window))
        self.window = window
        self.item_at = np.array([i for i in np.cumsum([0, *map(len, parts[1:])])[:-1]], dtype=np.int64) + 1
        rows = np.where(np.arange(window) < self.widths[:, None], self.words[np.minimum(self.starts[:, None] + np.arange(window), len(self.words) - 1)], 0).astype(np.int32)
        if len(rows):
            _, self.first, number = np.unique(np.ascontiguousarray(rows).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
            self.items_of = [np.unique(owners[x]) for x in np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])]
        else:
            self.first, self.items_of = np.zeros(0, dtype=np.int64), []
        longest = int(np.diff(np.flatnonzero(self.words == 0)).max(initial=1))
        self.suffixes = SuffixArray(self.words, np.flatnonzero(self.words > 0), longest).suffixes

    def longest(self, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, start in the benchmark) of the longest match of any benchmark suffix with words from each place on. It is
        that of a neighbour of the place that the stretch would take among the sorted suffixes."""
        low, high = np.zeros(len(places), dtype=np.int64), np.full(len(places), len(self.suffixes), dtype=np.int64)
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            at, own = self.suffixes[mid], places[live]
            n = _common(self.words, at, words, own)
            less = self.words[np.minimum(at + n, len(self.words) - 1)] < words[np.minimum(own + n, len(words) - 1)]
            low[live], high[live] = np.where(less, mid + 1, low[live]), np.where(less, high[live], mid)
        best, where = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for k in (low, low - 1):
            at = self.suffixes[np.clip(k, 0, len(self.suffixes) - 1)]
            n = np.where((k >= 0) & (k < len(self.suffixes)), _common(self.words, at, words, places), 0)
            where = np.where(n > best, at, where)
            best = np.maximum(best, n)
        return best, where


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 16) -> np.ndarray:
    """How many words a from i on and b from j on have in common; a 0 is equal to nothing, and both end with one."""
    n, live = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
    while len(live):
        x = a[np.minimum((i[live] + n[live])[:, None] + np.arange(step), len(a) - 1)]
        y = b[np.minimum((j[live] + n[live])[:, None] + np.arange(step), len(b) - 1)]
        same = np.cumprod((x == y) & (x > 0), axis=1).sum(axis=1)
        n[live] += same
        live = live[same == step]
    return n


class SuffixArray:
    """The suffixes of a shard's words, in order as far as `depth` words."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, depth: int):
        """words ends with a 0; only the suffixes at starts are of interest."""
        self.words, self.depth = words, depth
        order = np.arange(len(starts))
        rank = words.astype(np.int64)
        width = 1
        while width < depth:  # ranks of twice the width, from pairs of ranks
            far = np.concatenate([rank[width:], np.zeros(min(width, len(rank)), dtype=np.int64)])[: len(rank)]
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + far, return_inverse=True)
            width *= 2
        order = np.argsort(rank[starts], kind="stable")
        self.suffixes = starts[order]

    def _rows(self, at: np.ndarray, width: int) -> np.ndarray:
        return self.words[np.minimum(at[:, None] + np.arange(width), len(self.words) - 1)]

    def bounds(self, queries: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, a row of words: the range of suffixes that begin with its first widths words."""
        reach = queries.shape[1]
        inside = np.arange(reach) < widths[:, None]
        out = []
        for right in (False, True):
            low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(self.suffixes), dtype=np.int64)
            while (live := np.flatnonzero(low < high)).size:
                mid = (low[live] + high[live]) // 2
                differ = (self._rows(self.suffixes[mid], reach) != queries[live]) & inside[live]
                k = differ.argmax(axis=1)
                here, there = self._rows(self.suffixes[mid], reach)[np.arange(len(live)), k], queries[live, k]
                less = np.where(differ.any(axis=1), here < there, right)
                low[live], high[live] = np.where(less, mid + 1, low[live]), np.where(less, high[live], mid)
            out.append(low)
        return out[0], out[1]


def search(bench: Benchmark, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """For one shard, of every occurrence of a window: document, window start, width, distinct window, the length of the longest
    match from there on, and that match's start in the benchmark."""
    none = np.zeros(0, dtype=np.int64)
    lengths = np.array([len(d) + 1 for d in docs], dtype=np.int64)
    ends = np.cumsum(lengths)
    whole = np.concatenate([x for d in docs for x in (d, np.zeros(1, dtype=d.dtype))]) if docs else np.zeros(1, dtype=np.int32)
    breaks = np.flatnonzero(whole == 0)
    runs = np.diff(breaks, prepend=-1)  # each with the 0 that ends it
    long = runs[runs > bench.least]
    kept = np.flatnonzero(np.repeat((runs > bench.least), runs))
    words = whole[kept]
    left = np.repeat(np.cumsum(long), long) - np.arange(len(kept)) - 1  # words from here to the run's end
    starts = np.flatnonzero(left >= bench.least)
    if not len(starts) or not len(bench.first):
        return none, none, none, none, none, none
    array = SuffixArray(words, starts, bench.window)
    s, w = bench.starts[bench.first], bench.widths[bench.first]
    low, high = array.bounds(bench.words[np.minimum(s[:, None] + np.arange(bench.window), len(bench.words) - 1)], w)
    n = high - low
    place = array.suffixes[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    reach, where = bench.longest(words, place)
    part = reach < bench.window  # less than a window of a long item is no match: the short item found here is
    reach, where = np.where(part, np.repeat(w, n), reach), np.where(part, np.repeat(s, n), where)
    place = kept[place]
    doc = np.searchsorted(ends, place, side="right")
    return doc, place - (ends - lengths)[doc], np.repeat(w, n), np.repeat(np.arange(len(s)), n), reach, where


def _match(bench: Benchmark, texts: list[str | None]) -> Iterator[tuple[int, list[str], list[dict], dict | None]]:
    """By text: words, items, hit stretches and the longest match (the first of equals)."""
    get, at = bench.vocabulary.get, 0
    while at < len(texts):
        shard, size = [], 0
        while at < len(texts) and (not shard or size < SHARD_WORDS):
            w = text_words(texts[at])
            shard.append(np.array([get(x, 0) for x in w], dtype=np.int32))
            size += len(w)
            at += 1
        doc, start, width, window, reach, where = search(bench, shard)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(shard) + 1))
        for d, words in enumerate(shard):
            own = order[cuts[d] : cuts[d + 1]]
            if not len(own):
                yield len(words), [], [], None
                continue
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, start[own], 1)
            np.add.at(edge, start[own] + width[own], -1)
            hit = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
            turns = np.flatnonzero(np.diff(hit))
            spans = [{"first": a, "end": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
            items = sorted({bench.ids[k] for x in np.unique(window[own]) for k in bench.items_of[x]})
            best = own[np.lexsort((start[own], -reach[own]))[0]]
            k = int(np.searchsorted(bench.item_at, where[best], side="right")) - 1
            longest = {"words": int(reach[best]), "at": int(start[best]), "item": bench.ids[k], "item_at": int(where[best] - bench.item_at[k])}
            yield len(words), items, spans, longest


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, str | None]]]:
    """The items, streamed to the driver in blocks of BLOCK_WORDS words."""
    block, size = [], 0
    for r in bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((r["i"] if r["i"] is not None else "", r["t"]))
        size += len(text_words(r["t"]))
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _hits(shared):
    """A function of a text column for one broadcast block."""

    @F.pandas_udf("n_words long, items array<string>, spans array<struct<first: long, end: long>>, longest struct<words: long, at: long, item: string, item_at: long>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = list(_match(shared.value, s.tolist()))
            none = {"words": None, "at": None, "item": None, "item_at": None}
            out = pd.DataFrame([r[:3] for r in rows], columns=["n_words", "items", "spans"])
            out["longest"] = [r[3] or none for r in rows]
            yield out

    return hits.asNondeterministic()  # else a filter on what it returns would run it twice


def n_words(text):
    """The number of words of a text column; none where it is null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def match(docs: DataFrame, bench: DataFrame, text_col: str = "text", name: str = "_al_hits") -> DataFrame:
    """docs with a struct column: n_words, items (ids as text, sorted, each once), spans (first hit word, the
    word after the last) and longest, the longest verbatim match of a window or more: its words, its place in the document, its
    item and its place there (nulls without a match; of equals the first in the document). Spans of the benchmark's blocks are
    joined.

    Null texts have no words and no hits; texts of any length are searched whole; null or wordless items have no window, items
    without an id count as the empty one; repeated rows are matched each by itself; an empty benchmark hits nothing; an
    empty table gives an empty result; other columns pass through, but one of this name is an error."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name}; give another name")
    spark: SparkSession = docs.sparkSession
    parts = blocks(bench)
    block, more = next(parts, []), next(parts, None)
    if more is None:
        return docs.withColumn(name, _hits(spark.sparkContext.broadcast(Benchmark(block)))(F.col(text_col)))
    scratch, found, i = common.Scratch(spark, "decontam"), [], 0
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    keyed = plain.withColumn("key", common.row_key(plain))
    text = F.col(names[docs.columns.index(text_col)])
    while block is not None:
        shared = spark.sparkContext.broadcast(Benchmark(block))
        hits = keyed.select("key", _hits(shared)(text).alias("h")).where(F.size("h.spans") > 0)
        found.append(scratch.write(hits, f"block{i}"))
        shared.destroy()
        block, more, i = more, next(parts, None), i + 1
    every = found[0]
    for other in found[1:]:
        every = every.union(other)
    longest = F.struct(F.col("h.longest.words").alias("words"), (-F.col("h.longest.at")).alias("back"), F.col("h.longest").alias("own"))
    merged = every.groupBy("key").agg(F.flatten(F.collect_set("h.items")).alias("items"), F.flatten(F.collect_set("h.spans")).alias("spans"), F.max(longest)["own"].alias("longest"))
    merged = merged.select(F.col("key").alias("own"), F.array_sort(F.array_distinct("items")).alias("items"), _union(F.sort_array("spans")).alias("spans"), "longest")
    joined = keyed.join(scratch.write(merged, "merged"), F.col("key") == F.col("own"), "left")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<first: bigint, end: bigint>>")
    none = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("words", "long"), ("at", "long"), ("item", "string"), ("item_at", "long"))])
    whole = F.struct(n_words(text).alias("n_words"), F.coalesce("items", no_items).alias("items"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("longest", none).alias("longest"))
    return joined.select(*names, whole.alias(name)).toDF(*docs.columns, name)


def _union(spans):
    """Sorted spans with those that meet joined, newest last."""
    empty = F.filter(spans, lambda _: F.lit(False))

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["first"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, empty, step)


def n_hit(hits):
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By document: its id, n_words, n_hit, n_items, items_sha256 and contaminated; then the words of its longest match with
    the benchmark and the place where that begins, null without one."""
    found = match(docs.select(F.col(id_col), F.col(text_col)), bench, text_col)
    h = F.col("_al_hits")
    return found.select(
        id_col, h["n_words"].alias("n_words"), n_hit(h).alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        (F.size(h["spans"]) > 0).alias("contaminated"), h["longest"]["words"].alias("longest_match"), h["longest"]["at"].alias("longest_at"),
    )
