"""Packed back-off models: the bit-packed trie file, read in ranges by many tasks and written from a table, and the older dump.

A trie file holds, in this order: a mark, the order, the number of n-grams of each order, tables of 65,536 probabilities and
back-offs that middle and longest n-grams are rounded to, unigrams (probability, back-off, first bigram), the n-grams of
each higher order side by side in as many bits as their fields take, and the words. N-grams stand sorted by last word, then the
one before, and so on, and each knows only its own word and where its children begin.

Every order is one packed array, so a task reads any run of entries by its bytes. What an entry's words are comes from joins: a
parent's children are a run of places, and place by place they meet the entries of the next order. Probabilities are logs in a
small base that the file doesn't say."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..operators import lm_edit, order

# What the files begin with, and the sizes of the format.
TRIE, DUMP = b"Trie Language Model", b"Darpa Trigram LM"
BINS, BASE = 1 << 16, 1.0001
MOST = 1 << 25
SEGMENT_BITS = 9
#: Entries that a task reads or packs at a time; whole bytes, whatever their bits.
RUN = 1 << 16


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _read(path: str, start: int, n: int) -> bytes:
    files, at = _files(path)
    with files.open_input_file(at) as f:
        f.seek(start)
        return f.read(n)


@dataclass(frozen=True)
class Layout:
    """Where everything is in a trie file with these counts."""

    counts: tuple[int, ...]

    @property
    def order(self) -> int:
        return len(self.counts)

    @property
    def tables_at(self) -> int:
        return len(TRIE) + 1 + 4 * self.order + (4 if self.order > 1 else 0)

    @property
    def n_tables(self) -> int:
        return 2 * (self.order - 2) + 1 if self.order > 1 else 0

    @property
    def unigrams_at(self) -> int:
        return self.tables_at + self.n_tables * BINS * 4

    def fields(self, k: int) -> tuple[int, int, int]:
        """Bits of an entry of order k: its word, its values, and where its children begin."""
        return self.counts[0].bit_length(), 32 if k < self.order else 16, self.counts[k].bit_length() if k < self.order else 0

    def size(self, k: int) -> int:
        """Bytes of order k: an entry more than there are, and eight over."""
        return ((1 + self.counts[k - 1]) * sum(self.fields(k)) + 7) // 8 + 8

    def at(self, k: int) -> int:
        return self.unigrams_at + 12 * (self.counts[0] + 1) + sum(self.size(j) for j in range(2, k))

    @property
    def words_at(self) -> int:
        return self.at(self.order + 1)


def layout(path: str) -> Layout:
    head = _read(path, 0, len(TRIE) + 1 + 4 * 16)
    if head[: len(TRIE)] != TRIE:
        raise ValueError(f"{path} isn't a trie file")
    n = head[len(TRIE)]
    if not 1 <= n <= 5:
        raise ValueError(f"{path} says that its order is {n}")
    lay = Layout(struct.unpack(f"<{n}I", head[len(TRIE) + 1 : len(TRIE) + 1 + 4 * n]))
    files, at = _files(path)
    if not lay.counts[0] or files.get_file_info(at).size < lay.words_at + 4:
        raise ValueError(f"{path} is cut off: a packed model of {lay.counts} n-grams is longer")
    return lay


def unpack(data: bytes, fields: tuple[int, ...], n: int) -> list[np.ndarray]:
    """The fields of the first n entries of packed bytes."""
    width = sum(fields)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, count=(n * width + 7) // 8), bitorder="little")[: n * width].reshape(n, width)
    out, at = [], 0
    for w in fields:
        out.append(bits[:, at : at + w].astype(np.int64) @ (np.int64(1) << np.arange(w, dtype=np.int64)) if w else np.zeros(n, np.int64))
        at += w
    return out


def pack(fields: tuple[int, ...], values: list[np.ndarray]) -> bytes:
    bits = np.concatenate([((v.astype(np.int64)[:, None] >> np.arange(w)) & 1).astype(np.uint8) for w, v in zip(fields, values, strict=True) if w], axis=1)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _ranges(spark: SparkSession, n: int, run: int) -> DataFrame:
    tasks = max(1, -(-n // run))
    return spark.range(0, tasks, 1, tasks).select((F.col("id") * run).alias("first"), F.least(F.lit(run), F.lit(n) - F.col("id") * run).alias("n"))


def _unigrams(spark: SparkSession, path: str, lay: Layout) -> DataFrame:
    """(place, log10_p, log10_bo, child, child_end)."""
    unit, start = math.log10(BASE), lay.unigrams_at

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, n in zip(b["first"].tolist(), b["n"].tolist(), strict=True):
                x = np.frombuffer(_read(path, start + 12 * first, 12 * (n + 1)), np.dtype([("p", "<f4"), ("bo", "<f4"), ("next", "<u4")]))
                yield pd.DataFrame({"place": first + np.arange(n), "log10_p": x["p"][:-1] * unit, "log10_bo": x["bo"][:-1] * unit, "child": x["next"][:-1].astype(np.int64), "child_end": x["next"][1:].astype(np.int64)})

    return _ranges(spark, lay.counts[0], RUN).mapInPandas(read, "place long, log10_p double, log10_bo double, child long, child_end long")


def _entries(spark: SparkSession, path: str, lay: Layout, k: int) -> DataFrame:
    """(place, wid, log10_p, log10_bo, child, child_end) of order k."""
    unit, fields, top = math.log10(BASE), lay.fields(k), k == lay.order
    width, bins, start, table = sum(fields), BINS, lay.at(k), lay.tables_at + (2 * (k - 2)) * BINS * 4

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.frombuffer(_read(path, table, bins * 4 * (1 if top else 2)), "<f4").reshape(-1, bins) * unit
        for b in batches:
            for first, n in zip(b["first"].tolist(), b["n"].tolist(), strict=True):
                word, value, child = unpack(_read(path, start + first * width // 8, ((n + 1) * width + 7) // 8), fields, n + 1)
                p, bo = (values[0][value], np.full(n + 1, np.nan)) if top else (values[0][value >> 16], values[1][value & 0xFFFF])
                yield pd.DataFrame({"place": first + np.arange(n), "wid": word[:-1], "log10_p": p[:-1], "log10_bo": bo[:-1], "child": child[:-1], "child_end": child[1:]})

    rows = _ranges(spark, lay.counts[k - 1], RUN).mapInPandas(read, "place long, wid long, log10_p double, log10_bo double, child long, child_end long")
    return rows.withColumn("log10_bo", F.lit(None).cast("double")) if top else rows


def _words(spark: SparkSession, path: str, start: int, run: int = 1 << 22) -> DataFrame:
    """(wid, word) of the zero-ended strings that a count of bytes comes before. Each task takes the words that begin in its
    bytes; how many begin before comes from a first pass, one number a task."""
    (size,) = struct.unpack("<i", _read(path, start, 4))
    begin = start + 4

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, n in zip(b["first"].tolist(), b["n"].tolist(), strict=True):
                yield pd.DataFrame({"first": [first], "ends": [_read(path, begin + first, n).count(b"\0")]})

    ranges = _ranges(spark, size, run)
    ends = {r["first"]: r["ends"] for r in ranges.mapInPandas(count, "first long, ends long").collect()}
    before, total = {}, 0
    for first in sorted(ends):
        before[first], total = total, total + ends[first]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, n in zip(b["first"].tolist(), b["n"].tolist(), strict=True):
                data, skip = _read(path, begin + max(0, first - 1), n + (first > 0)), 0
                if first:  # a word that began before belongs to the task before, all but its end
                    skip = data.find(b"\0", 0, n) + 1
                    if not skip:
                        continue
                data, at = data[skip:], first - (first > 0) + skip
                whole, more = data, at + len(data)
                while more < size and not whole.endswith(b"\0"):
                    piece = _read(path, begin + more, 4096)
                    cut = piece.find(b"\0")
                    whole += piece if cut < 0 else piece[: cut + 1]
                    more += len(piece) if cut < 0 else cut + 1
                words = whole.split(b"\0")[:-1]
                began = before[first] + (1 if first and skip > 1 else 0)
                yield pd.DataFrame({"wid": began + np.arange(len(words)), "word": [w.decode("utf-8", "replace") for w in words]})

    return ranges.mapInPandas(read, "wid long, word string")


def _named(entries: DataFrame, parents: DataFrame, words: DataFrame, before: bool) -> DataFrame:
    """entries with the array of their words: their own word in front of (or behind) their parent's. Parents give a row for each
    place of a child, which meets the child's."""
    kids = parents.where("child < child_end").select(F.col("words").alias("_rest"), F.explode(F.sequence(F.col("child"), F.col("child_end") - 1)).alias("place"))
    own = entries.join(words.select("wid", F.array("word").alias("_w")), "wid")
    return own.join(kids, "place").withColumn("words", F.concat("_w", "_rest") if before else F.concat("_rest", "_w")).drop("_w", "_rest")


def _union(levels: list[DataFrame]) -> DataFrame:
    out = None
    for k, level in enumerate(levels, 1):
        rows = level.select(F.lit(k).alias("ord"), "words", F.col("log10_p").cast("double").alias("log10_p"), F.col("log10_bo").cast("double").alias("log10_bo"))
        out = rows if out is None else out.union(rows)
    return out


def read_trie(spark: SparkSession, path: str) -> DataFrame:
    """(ord, words, log10_p, log10_bo) of a trie file. N-grams that were only put in to make longer ones reachable are there, with
    the probability that backing off gives them. Files are read where tasks see them; compressed ones aren't."""
    lay = layout(path)
    words = _words(spark, path, lay.words_at)
    first = _unigrams(spark, path, lay).join(words, F.col("place") == F.col("wid")).withColumn("words", F.array("word"))
    if lay.order == 1:
        first = first.withColumn("log10_bo", F.lit(None).cast("double"))
    levels = [first]
    for k in range(2, lay.order + 1):
        levels.append(_named(_entries(spark, path, lay, k), levels[-1], words, before=True))
    return _union(levels)


def _summed(rows: DataFrame, name: str) -> DataFrame:
    """rows (place, n) with the sum of n over the places before: blocks of places add up first, of which there are few."""
    blocks = rows.withColumn("_b", F.floor(F.col("place") / RUN))
    sums = blocks.groupBy("_b").agg(F.sum("n").alias("_s"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_a"))
    return blocks.withColumn("_i", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "_b").withColumn(name, F.col("_a") + F.col("_i")).drop("_b", "_i", "_a", "n")


def _centres(values: DataFrame, folder: str) -> np.ndarray:
    """The BINS values that a column `v` is rounded to: its different values where these are no more, else the means of as many equal shares of
    them in order."""
    values = tables.stored(values.where("v is not null").distinct(), folder)
    n = values.count()
    if n > BINS:
        placed = order.place(values.withColumn("_g", F.lit(0)), ["_g"], ["v"], "_at")
        values = placed.groupBy(F.floor(F.col("_at") * BINS / n).alias("b")).agg(F.avg("v").alias("v"))
    got = np.sort(np.array([r["v"] for r in values.select("v").collect()], dtype=np.float32))
    return np.concatenate([got, np.full(BINS - len(got), got[-1] if len(got) else 0.0, dtype=np.float32)])


def _nearest(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.clip(np.searchsorted(centres, x), 1, len(centres) - 1)
    return np.where(x - centres[at - 1] < centres[at] - x, at - 1, at)


def write_trie(ngrams: DataFrame, path: str, top: int) -> None:
    """Writes a table (ord, words, log10_p, log10_bo) of order `top` as a trie file. Suffixes that the model lacks are put in as
    `lm_edit.close_suffixes` does. Orders are sorted, numbered and packed by many tasks; the file is one stream in the end, which the format
    keeps below 2**25 n-grams an order. The file appears under its name when it is whole."""
    spark, folder = ngrams.sparkSession, tables.new_folder(ngrams.sparkSession, "trie")
    if not 1 <= top <= 5:
        raise ValueError("trie files have an order of 1 to 5")
    unit = math.log10(BASE)
    closed = tables.stored(lm_edit.close_suffixes(ngrams, top) if top > 1 else ngrams.where("ord = 1").withColumn("is_blank", F.lit(False)), f"{folder}/closed")
    words = tables.stored(lm_edit.numbered_vocabulary(closed.where("ord = 1").select(F.col("words")[0].alias("word"))), f"{folder}/words")
    levels: list[DataFrame] = []
    for k in range(1, top + 1):
        rows = closed.where(F.col("ord") == k).select("words", (F.col("log10_p") / unit).cast("float").alias("p"), (F.coalesce("log10_bo", F.lit(0.0)) / unit).cast("float").alias("bo"))
        each = rows.select("words", "p", "bo", F.posexplode(F.reverse("words")).alias("_i", "word")).join(words, "word")
        keyed = each.groupBy("words").agg(F.first("p").alias("p"), F.first("bo").alias("bo"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "wid"))), lambda s: s["wid"]).alias("r"))
        placed = order.place(keyed.where(F.size("r") == k).select("r", "p", "bo").withColumn("_g", F.lit(0)), ["_g"], ["r"], "place").drop("_g")
        levels.append(tables.stored(placed, f"{folder}/level{k}"))
    counts = tuple(level.count() for level in levels)
    if max(counts) >= MOST:
        raise ValueError(f"trie files hold fewer than {MOST} n-grams of an order")
    lay = Layout(counts)
    centres: list[np.ndarray] = []
    for k in range(2, top + 1):
        centres.append(_centres(levels[k - 1].select(F.col("p").alias("v")), f"{folder}/p{k}"))
        if k < top:
            centres.append(_centres(levels[k - 1].select(F.col("bo").alias("v")), f"{folder}/bo{k}"))

    def packed(k: int):
        fields, mine = lay.fields(k) if k > 1 else None, centres[2 * (k - 2) : 2 * (k - 2) + 2] if k > 1 else []

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            p, bo, child = rows["p"].to_numpy(np.float32), rows["bo"].to_numpy(np.float32), rows["child"].to_numpy()
            if k == 1:
                body = np.rec.fromarrays([p.astype("<f4"), bo.astype("<f4"), child.astype("<u4")]).tobytes()
            else:
                value = _nearest(mine[0], p) if k == top else _nearest(mine[0], p) << 16 | _nearest(mine[1], bo)
                body = pack(fields, [rows["wid"].to_numpy(), value, child])
            return pd.DataFrame({"section": [k], "block": [int(rows["place"].iloc[0])], "body": [body]})

        return run

    parts = None
    for k in range(1, top + 1):
        level = levels[k - 1]
        if k < top:
            kids = levels[k].groupBy(F.slice("r", 1, k).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
            level = _summed(level.join(kids, F.col("r") == F.col("_r"), "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_r", "_n"), "child")
        else:
            level = level.withColumn("child", F.lit(0).cast("long"))
        level = level.select("place", F.element_at("r", -1).alias("wid"), "p", "bo", "child")
        end = spark.createDataFrame([(counts[k - 1], 0, 0.0, 0.0, counts[k] if k < top else 0)], "place long, wid long, p float, bo float, child long")
        bodies = level.union(end).withColumn("_b", F.floor(F.col("place") / RUN)).groupBy("_b").applyInPandas(packed(k), "section int, block long, body binary")
        parts = bodies if parts is None else parts.union(bodies)
    strings = words.withColumn("_b", F.floor(F.col("wid") / RUN)).groupBy("_b").applyInPandas(lambda x: pd.DataFrame({"section": [99], "block": [int(x["wid"].min())], "body": [b"".join(w.encode() + b"\0" for w in x.sort_values("wid")["word"])]}), "section int, block long, body binary")
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + 1), F.lit(0)).alias("n")).first()["n"]
    head = TRIE + bytes([top]) + struct.pack(f"<{top}I", *counts) + (struct.pack("<i", 1) + b"".join(c.astype("<f4").tobytes() for c in centres) if top > 1 else b"")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = _files(path)
        with files.open_output_stream(f"{at}.part") as f:
            f.write(head)
            now, written = 1, 0
            for b in batches:
                for section, body in zip(b["section"].tolist(), b["body"].tolist(), strict=True):
                    while section != now:
                        if now > 1:
                            f.write(bytes(lay.size(now) - written))
                        now, written = (now + 1 if now < top else 99), 0
                        if now == 99:
                            f.write(struct.pack("<i", size))
                    f.write(body)
                    written += len(body)
            if now != 99:
                f.write(bytes(lay.size(now) - written) if now > 1 else b"")
                f.write(struct.pack("<i", size))
        files.move(f"{at}.part", at)
        yield pd.DataFrame({"n": [1]})

    tables.stored(parts.union(strings), f"{folder}/parts").repartition(1).sortWithinPartitions("section", "block").mapInPandas(stream, "n int").count()


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(ord, words, log10_p, log10_bo) of the older dump of up to three words, in either byte order. Its n-grams stand by first word:
    unigrams know where their bigrams begin, bigrams, by a table of segments, where their trigrams do."""
    mark = _read(path, 0, 4)
    swap = next((o for o in "<>" if struct.unpack(f"{o}i", mark)[0] == len(DUMP) + 1), None)
    if swap is None or _read(path, 4, len(DUMP)) != DUMP:
        raise ValueError(f"{path} isn't a dump file")

    def number(at: int) -> int:
        data = _read(path, at, 4)
        if len(data) < 4:
            raise ValueError(f"{path} is cut off: a packed model goes on here")
        return struct.unpack(f"{swap}i", data)[0]

    at = 4 + len(DUMP) + 1
    at += 4 + number(at)  # the name of the file it came from
    first, at = number(at), at + 4
    if first <= 0:  # a version: a time stamp and lines of description follow
        at += 4
        while (n := number(at)) != 0:
            at += 4 + n
        at += 4
        first, at = number(at), at + 4
    counts = (first, number(at), number(at + 4))
    if counts[0] <= 0:
        raise ValueError(f"{path} is a packed model without unigrams")
    unigrams_at = at + 8
    top = 3 if counts[2] else 2 if counts[1] else 1
    bigrams_at = unigrams_at + 16 * (counts[0] + 1)
    trigrams_at = bigrams_at + (8 * (counts[1] + 1) if top > 1 else 0)
    at = trigrams_at + (4 * counts[2] if top > 2 else 0)
    arrays = {}
    for name in ("p2", "bo2", "p3")[: {1: 0, 2: 1, 3: 3}[top]]:
        n = number(at)
        arrays[name] = np.frombuffer(_read(path, at + 4, 4 * n), f"{swap}f4").astype(float)
        at += 4 + 4 * n
    if top > 2:
        n = number(at)
        segments_at, at = at + 4, at + 4 + 4 * n
    words = _words(spark, path, at) if swap == "<" else None
    if words is None:
        raise ValueError("dumps of the other byte order have to be converted first")

    def records(kind: list, start: int, of, extra: int):
        dtype = np.dtype([(n, f"{swap}{t}") for n, t in kind])

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for a, n in zip(b["first"].tolist(), b["n"].tolist(), strict=True):
                    x = np.frombuffer(_read(path, start + a * dtype.itemsize, (n + extra) * dtype.itemsize), dtype)
                    yield pd.DataFrame({"place": a + np.arange(n), **of(x, a, n)})

        return read

    number_of = lambda x: x.astype(np.int64)
    uni = lambda x, a, n: {"log10_p": x["p"][:-1], "log10_bo": x["bo"][:-1], "child": number_of(x["next"][:-1]), "child_end": number_of(x["next"][1:])}
    level = _ranges(spark, counts[0], RUN).mapInPandas(records([("id", "i4"), ("p", "f4"), ("bo", "f4"), ("next", "i4")], unigrams_at, uni, 1), "place long, log10_p double, log10_bo double, child long, child_end long")
    levels = [level.join(words, F.col("place") == F.col("wid")).withColumn("words", F.array("word"))]
    if top > 1:

        def bi(x: np.ndarray, a: int, n: int) -> dict:
            places = a + np.arange(n + 1)
            base = np.zeros(n + 1, np.int64)
            if top > 2:
                seg = places >> SEGMENT_BITS
                table = np.frombuffer(_read(path, segments_at + 4 * int(seg[0]), 4 * int(seg[-1] - seg[0] + 1)), f"{swap}i4").astype(np.int64)
                base = table[seg - seg[0]]
            child = base + number_of(x["next"])
            return {"wid": number_of(x["wid"][:-1]), "log10_p": arrays["p2"][x["p"][:-1]], "log10_bo": arrays["bo2"][x["bo"][:-1]] if top > 2 else np.nan, "child": child[:-1], "child_end": child[1:]}

        rows = _ranges(spark, counts[1], RUN).mapInPandas(records([("wid", "u2"), ("p", "u2"), ("bo", "u2"), ("next", "u2")], bigrams_at, bi, 1), "place long, wid long, log10_p double, log10_bo double, child long, child_end long")
        levels.append(_named(rows, levels[-1], words, before=False))
    if top > 2:
        tri = lambda x, a, n: {"wid": number_of(x["wid"]), "log10_p": arrays["p3"][x["p"]]}
        rows = _ranges(spark, counts[2], RUN).mapInPandas(records([("wid", "u2"), ("p", "u2")], trigrams_at, tri, 0), "place long, wid long, log10_p double")
        levels.append(_named(rows.withColumn("log10_bo", F.lit(None).cast("double")), levels[-1], words, before=False))
    if top < 3:
        levels[-1] = levels[-1].withColumn("log10_bo", F.lit(None).cast("double"))
    return _union(levels)
