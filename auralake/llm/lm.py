"""An interpolated modified Kneser-Ney n-gram model of any order: counted in Spark, kept as sorted hash arrays, memory-mapped.

The hashes are those of the words, 64 bits each, and sorted. Keys of n-grams are the places of their words in that order, side by
side: in one whole number where they fit, else as a run of bytes. Either sorts as the words do, and two n-grams never share
a key.

Words are numbered by the place of their hash among all word hashes, in sorted arrays (shards). N-grams are counted with a
map-side combine in each task and dealt to shards by their context; contexts of frequent words only, which alone would
fill shards, are dealt by the whole n-gram. A shard streams, sorted, into an array of keys and one of counts; the task that
writes it passes on what the next lower order needs: how often each context continues, and how many words stand before each
suffix. Nothing of the model goes through the driver but totals, and no task holds a shard.

    p(w | c) = max(a(cw) - D(a), 0) / a(c.) + gamma(c) * p(w | c without its first word)
    p(w) = max(a(w) - D(a), 0) / a(.) + gamma / (V + 1)

a is the count at the highest order and the number of different words before at lower ones; D are the three
discounts of modified Kneser-Ney, of each order, from the numbers of n-grams with a = 1 to 4. Texts begin with order - 1 start
marks. An unknown word has the last term of p(w) alone; a context with an unknown word in it, or never seen, passes
to the next shorter one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrays import SharedArrays, Writer

ORDER = 2
#: Entries of one shard, about, as long as there are no more shards than MAX_BITS allows.
WORD_SHARD = 1 << 20
GRAM_SHARD = 1 << 19
#: Shards, and the tasks that write them, are 2^8 of words and 2^12 of n-grams at most, fewer of the middle orders, so a model is some
#: ten thousand files at any size; beyond that shards grow, and stream through their tasks as before.
MAX_WORD_BITS, MAX_GRAM_BITS = 8, 12
#: A word is frequent if its tokens alone are over one in so many of a shard's.
HOT = 8
#: Tokens that a task handles at a time.
CHUNK = 1 << 20
#: Bytes of the words that a worker keeps; it starts afresh beyond that.
CACHE_BYTES = 32 << 20
#: Words hold no white space, so this isn't one.
END = b"\n"
_TOP = np.uint64(1 << 63)


def text_words(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` after A-Z became lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _signed(x: np.ndarray) -> np.ndarray:
    """Whole numbers as longs of the same order."""
    return (x ^ _TOP).view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ _TOP


def _to_rows(keys: np.ndarray) -> np.ndarray | list[bytes]:
    """Keys as Spark holds and sorts them: longs, or all bytes of a run, zeros at the end included."""
    if keys.dtype.kind != "S":
        return _signed(keys)
    width, flat = keys.dtype.itemsize, keys.tobytes()
    return [flat[i : i + width] for i in range(0, len(flat), width)]


@dataclass
class Model:
    """What tasks need besides the arrays: sizes, totals, discounts. Words are numbered from 0; `types` is the start mark."""

    arrays: SharedArrays
    order: int = ORDER
    bits: int = 0
    offsets: list[int] = field(default_factory=lambda: [0])
    tokens: int = 0
    types: int = 0
    gram_bits: dict[int, int] = field(default_factory=dict)
    shards: dict[int, list[int]] = field(default_factory=dict)
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    #: Keys that need more bits than that are runs of bytes.
    key_bits: int = 64
    unseen: float = 1.0
    start: tuple[float, float] = (0.0, 0.0)

    @property
    def bos(self) -> int:
        return self.types

    @property
    def word_bits(self) -> int:
        return self.types.bit_length()

    def packed(self, n: int) -> bool:
        """True if keys of n words are whole numbers."""
        return n == 1 or self.word_bits * n <= self.key_bits

    def key_kind(self, n: int) -> np.dtype:
        return np.dtype(np.uint64) if self.packed(n) else np.dtype(f"S{n * -(-self.word_bits // 8)}")

    def key(self, words: list[np.ndarray]) -> np.ndarray:
        """The keys of n-grams, one array of numbers for each place: their numbers, each in as many bits or bytes as it takes."""
        w = [x.astype(np.uint64) for x in words]
        if self.packed(len(w)):
            out = w[0]
            for x in w[1:]:
                out = (out << np.uint64(self.word_bits)) | x
            return out
        size = -(-self.word_bits // 8)
        parts = [x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :] for x in w]
        return np.ascontiguousarray(np.concatenate(parts, axis=1)).reshape(-1).view(self.key_kind(len(w)))

    def words_of(self, key: np.ndarray, n: int) -> list[np.ndarray]:
        if self.packed(n):
            b = self.word_bits
            return [((key >> np.uint64(b * (n - 1 - i))) & np.uint64((1 << b) - 1)).astype(np.int64) for i in range(n)]
        size = -(-self.word_bits // 8)
        parts = np.zeros((len(key), n, 8), dtype=np.uint8)
        parts[:, :, 8 - size :] = np.frombuffer(key.tobytes(), dtype=np.uint8).reshape(len(key), n, size)
        return list(parts.reshape(-1, 8).view(">u8").reshape(len(key), n).astype(np.int64).T)

    def from_rows(self, keys: pd.Series, n: int) -> np.ndarray:
        """Keys of n words as a task gets them from Spark."""
        return _unsigned(keys.to_numpy()) if self.packed(n) else np.array(keys.tolist(), dtype=self.key_kind(n))

    def key_type(self, n: int) -> str:
        return "long" if self.packed(n) else "binary"

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words; -1 for unknown ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), dtype=np.int64)
        for s in np.unique(shard):
            if self.offsets[s + 1] > self.offsets[s]:
                own = np.flatnonzero(shard == s)
                known = self.arrays.load(f"words-{s}", np.uint64)
                at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
                out[own] = np.where(known[at] == hashes[own], at + self.offsets[s], -1)
        return out

    def values(self, name: str, ids: np.ndarray) -> np.ndarray:
        """An array's values for sorted distinct numbers of words."""
        out, cuts = np.zeros(len(ids)), np.searchsorted(ids, self.offsets)
        for s in range(len(self.offsets) - 1):
            if cuts[s + 1] > cuts[s]:
                out[cuts[s] : cuts[s + 1]] = self.arrays.load(f"{name}-{s}", np.float64)[ids[cuts[s] : cuts[s + 1]] - self.offsets[s]]
        return out

    def shard_of(self, words: list[np.ndarray]) -> np.ndarray:
        """The shard of each n-gram; of a single word the one that its number lies in, -1 for the start mark."""
        n = len(words)
        if n == 1:
            return np.where(words[0] == self.bos, -1, np.searchsorted(self.offsets, words[0], side="right") - 1).astype(np.int32)
        bits = self.gram_bits[n]
        if not bits:
            return np.zeros(len(words[0]), dtype=np.int32)
        ids, back = np.unique(np.concatenate(words[:-1]), return_inverse=True)
        hot = self.values("counts", ids) * HOT * (1 << bits) > self.tokens
        hot[ids == self.bos] = True
        spread = np.logical_and.reduce(hot[back].reshape(n - 1, -1))
        by = np.zeros(len(words[0]), dtype=np.uint64)
        for x in words[:-1]:
            by = _mix(by + x.astype(np.uint64) + np.uint64(1))
        by = np.where(spread, _mix(by ^ _mix(words[-1].astype(np.uint64) + np.uint64(7))), by)
        return (_mix(by) >> np.uint64(64 - bits)).astype(np.int32)

    def lookup(self, words: list[np.ndarray], names: dict[str, type]) -> list[np.ndarray]:
        """The values of distinct n-grams under these names; zeros where the model hasn't the n-gram."""
        n, key, shard = len(words), self.key(words), self.shard_of(words)
        out, order = [np.zeros(len(key)) for _ in names], np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], self.shards[n])
        ends = np.searchsorted(shard[order], self.shards[n], side="right")
        for s, a, b in zip(self.shards[n], cuts, ends, strict=True):
            if b > a:
                own, known = order[a:b], self.arrays.load(f"keys{n}-{s}", self.key_kind(n))
                at = np.minimum(np.searchsorted(known, key[own]), len(known) - 1)
                hit = known[at] == key[own]
                for x, (name, kind) in zip(out, names.items(), strict=True):
                    x[own] = np.where(hit, self.arrays.load(f"{name}{n}-{s}", kind)[at], 0)
        return out


class Numberer:
    """Numbers the words of texts, with a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.known, self.held = model, {}, 0
        self.end = int(model.find(np.array([_hash(END)], dtype=np.uint64))[0]) if model.types else -1

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all tokens, the end included, and how many each text has."""
        words = [text_words(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        known[END] = self.end
        new = list({w for ws in words for w in ws if w not in known})
        if new:
            known.update(zip(new, self.model.find(np.array([_hash(w) for w in new], dtype=np.uint64)).tolist() if self.model.types else [-1] * len(new), strict=True))
            self.held += sum(map(len, new)) + 120 * len(new)
        sizes = np.array([len(ws) + 1 for ws in words], dtype=np.int64)
        get = known.__getitem__
        ids = np.fromiter((i for ws in words for i in (*map(get, ws), self.end)), dtype=np.int64, count=int(sizes.sum()))
        return ids, sizes


def _chunks(texts: Iterator[pd.Series]) -> Iterator[list[str | None]]:
    """The texts in parts of about CHUNK tokens; a longer text is a part of its own."""
    for s in texts:
        part, size = [], 0
        for t in s:
            part.append(t)
            size += len(t or "") // 6 + 1
            if size >= CHUNK:
                yield part
                part, size = [], 0
        if part:
            yield part


def _grams(ids: np.ndarray, sizes: np.ndarray, model: Model) -> list[np.ndarray]:
    """For each token the words before it, start marks before the text, and the token itself, as columns."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [ids]
    for k in range(1, model.order):
        back = np.concatenate([np.full(min(k, len(ids)), model.bos), ids[:-k]]) if len(ids) else ids
        out.append(np.where(place >= k, back, model.bos))
    return out[::-1]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counter = Counter()

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"h": np.array([_hash(w) for w in found], dtype=np.uint64).view(np.int64), "n": np.fromiter(found.values(), dtype=np.int64, count=len(found))})
        found.clear()
        return out

    for b in batches:
        for t in b["text"]:
            found.update(text_words(t))
            found[END] += 1
            if len(found) > 800_000:
                yield flush()
    yield flush()


def _parts(batches: Iterator[pd.DataFrame], size: int = 0) -> Iterator[tuple[int, pd.DataFrame, bool]]:
    """Rows sorted by shard, as (shard, rows, whether these are its last) with about so many rows at a time."""
    held: list[pd.DataFrame] = []
    size = size or CHUNK
    for b in batches:
        for shard, rows in b.groupby("shard", sort=True):
            if held and held[0]["shard"].iloc[0] != shard:
                yield int(held[0]["shard"].iloc[0]), pd.concat(held), True
                held = []
            elif held and sum(map(len, held)) >= size:
                yield int(shard), pd.concat(held), False
                held = []
            held.append(rows)
    if held:
        yield int(held[0]["shard"].iloc[0]), pd.concat(held), True


class _Files:
    """The arrays of one shard at a time, open for writing."""

    def __init__(self, arrays: SharedArrays):
        self.arrays, self.open = arrays, {}

    def append(self, last: bool, **values: np.ndarray) -> None:
        for name, x in values.items():
            if name not in self.open:
                self.open[name] = Writer(self.arrays, name)
            self.open[name].append(x)
        if last:
            for w in self.open.values():
                w.close()
            self.open = {}


def _write_words(arrays: SharedArrays):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, n = _Files(arrays), 0
        for shard, rows, last in _parts(batches):
            n += len(rows)
            files.append(last, **{f"words-{shard}": _unsigned(rows["h"].to_numpy()), f"counts-{shard}": rows["n"].to_numpy().astype(np.float64)})
            if last:
                yield pd.DataFrame({"shard": [shard], "n": [n]})
                n = 0

    return write


def _count_grams(model: Model):
    n = model.order

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = Numberer(model)
        held, size = [], 0

        def flush() -> pd.DataFrame:
            words = [np.concatenate(x) for x in zip(*held, strict=True)]
            keys, at, times = np.unique(model.key(words), return_index=True, return_counts=True)
            words = [w[at] for w in words]
            held.clear()
            return pd.DataFrame({"shard": model.shard_of(words), "key": _to_rows(keys), "n": times.astype(np.int64)})

        for texts in _chunks(b["text"] for b in batches):
            ids, sizes = number(texts)
            held.append(_grams(ids, sizes, model))
            size += len(ids)
            if size * n >= 12 * CHUNK:
                yield flush()
                size = 0
        if held:
            yield flush()

    return count


def _write_grams(model: Model, n: int):
    """Writes the arrays of the n-grams of one order, and gives the rows of the next lower one: for each of its n-grams what
    follows it (total, n1, n2, n3) and how many words stand before it (cont). Shard -2 has the numbers of n-grams with a
    count of one to four, and which shards there are."""
    top = n == model.order

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Files(model.arrays)
        for shard, rows, last in _parts(batches):
            key, a = model.from_rows(rows["key"], n), rows["n" if top else "cont"].to_numpy()
            values = {f"keys{n}-{shard}": key, f"counts{n}-{shard}": a.astype(np.uint64)}
            if not top:
                values |= {f"totals{n}-{shard}": rows["total"].to_numpy().astype(np.float64), f"gammas{n}-{shard}": _gamma(rows, model.discounts[n + 1])}
            files.append(last, **values)
            seen = np.flatnonzero(a > 0)  # others are contexts only
            words, a = [w[seen] for w in model.words_of(key, n)], a[seen]
            none_key = 0 if model.packed(n - 1) else b""
            out = [pd.DataFrame({"shard": [-2], "key": [none_key], "total": [0], "n1": [(a == 1).sum()], "n2": [(a == 2).sum()], "n3": [(a == 3).sum()], "n4": [(a == 4).sum()], "cont": [0], "at": [shard]})]
            for part, follows in ((words[:-1], True), (words[1:], False)):
                k, first, back = np.unique(model.key(part), return_index=True, return_inverse=True)
                part = [w[first] for w in part]
                by = lambda x, size=len(k), b=back: np.bincount(b, weights=x, minlength=size).astype(np.int64)
                none = np.zeros(len(k), dtype=np.int64)
                sums = {"total": by(a), "n1": by(a == 1), "n2": by(a == 2), "n3": by(a >= 3), "n4": none, "cont": none} if follows else {"total": none, "n1": none, "n2": none, "n3": none, "n4": none, "cont": by(np.ones(len(a)))}
                out.append(pd.DataFrame({"shard": model.shard_of(part), "key": _to_rows(k), **sums}))
            got = pd.concat(out)
            got["at"] = got["at"].astype("Int32")
            yield got

    return write


def _gamma(rows: pd.DataFrame, d: tuple[float, float, float]) -> np.ndarray:
    return (d[0] * rows["n1"] + d[1] * rows["n2"] + d[2] * rows["n3"]).to_numpy() / np.maximum(rows["total"].to_numpy(), 1)


def _write_values(model: Model, total: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Files(model.arrays)
        for shard, rows, last in _parts(batches):  # every word follows something, so none is missing
            c = rows["cont"].to_numpy()
            p = np.maximum(c - _discount(c, model.discounts[1]), 0) / max(total, 1) + model.unseen
            files.append(last, **{f"totals-{shard}": rows["total"].to_numpy().astype(np.float64), f"gammas-{shard}": _gamma(rows, model.discounts[2]), f"cont-{shard}": p})
            yield pd.DataFrame({"n": [len(rows)]})

    return write


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The discounts of counts of one, two and more, from the numbers of things counted once to four times."""
    if not n1 or not n2:
        return (0.5, 0.5, 0.5) if n1 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.1), k) for d, k in zip(raw, (0.95, 1.9, 2.9), strict=True))


def _discount(n: np.ndarray, d: tuple) -> np.ndarray:
    return np.where(n >= 3, d[2], np.where(n == 2, d[1], np.where(n == 1, d[0], 0.0)))


def _bits(entries: int, size: int, most: int) -> int:
    return min(most, max(0, (-(-entries // size) - 1).bit_length()))


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, key_bits: int = 64) -> Model:
    """The model of all these texts; each ends with an end token. Null texts count as empty. Keys are whole numbers
    where those of the words side by side need no more than key_bits, else runs of bytes; both are exact."""
    if order < 2:
        raise ValueError("an order of two or more, please")
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "lm")
    train = docs.select(F.col(text_col).alias("text"))
    words = scratch.write(train.mapInPandas(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    model = Model(SharedArrays(scratch.path("arrays")), order, tokens=int(sums["n"] or 0), types=int(sums["v"]), key_bits=key_bits)
    if not model.tokens:
        return model
    model.bits = _bits(model.types, WORD_SHARD, MAX_WORD_BITS)
    shard = F.shiftrightunsigned("h", 64 - model.bits).cast("int") if model.bits else F.lit(0)
    flipped = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # so that longs order as the hashes do
    sized = words.select(shard.alias("shard"), flipped.alias("h"), "n").repartition("shard").sortWithinPartitions("shard", "h")
    sizes = {r["shard"]: r["n"] for r in sized.mapInPandas(_write_words(model.arrays), "shard int, n long").collect()}
    model.offsets = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(1 << model.bits)])]).tolist()
    for n in range(2, order + 1):  # fewer files of each order where there are more orders
        model.gram_bits[n] = _bits(model.tokens, GRAM_SHARD, MAX_GRAM_BITS - (0 if order == 2 else 1 if n == order else 2 + (order - 3).bit_length()))
    names = ["total", "n1", "n2", "n3", "n4", "cont"]
    counted = train.mapInPandas(_count_grams(model), f"shard int, key {model.key_type(order)}, n long").repartition("shard").groupBy("shard", "key").agg(F.sum("n").alias("n"))
    for n in range(order, 1, -1):
        written = counted.sortWithinPartitions("shard", "key").mapInPandas(_write_grams(model, n), f"shard int, key {model.key_type(n - 1)}, {', '.join(f'{x} long' for x in names)}, at int")
        stats = scratch.write(written.groupBy("shard", "key").agg(*[F.sum(x).alias(x) for x in names], F.collect_set("at").alias("at")), f"stats{n - 1}")
        all_ = stats.where("shard = -2").first()  # at most 2^MAX_GRAM_BITS shards
        model.shards[n] = sorted(all_["at"])
        model.discounts[n] = _discounts(all_["n1"], all_["n2"], all_["n3"], all_["n4"])
        counted = stats.where("shard >= 0").drop("at").repartition("shard")
    bos = stats.where("shard = -1").first()
    times = lambda k: F.sum(F.when(F.col("cont") == k, 1).otherwise(0)).alias(f"m{k}")
    m = stats.where("shard >= 0").agg(F.sum("cont").alias("all"), *[times(k) for k in (1, 2, 3, 4)], F.sum(F.when(F.col("cont") >= 3, 1).otherwise(0)).alias("more")).first()
    model.discounts[1] = cont = _discounts(m["m1"], m["m2"], m["m3"], m["m4"])
    model.unseen = (cont[0] * m["m1"] + cont[1] * m["m2"] + cont[2] * m["more"]) / m["all"] / (model.types + 1)
    d = model.discounts[2]
    model.start = (float(bos["total"]), (d[0] * bos["n1"] + d[1] * bos["n2"] + d[2] * bos["n3"]) / bos["total"])
    done = counted.sortWithinPartitions("shard", "key").mapInPandas(_write_values(model, int(m["all"])), "n long").agg(F.sum("n")).first()[0]
    if done != model.types:
        raise RuntimeError(f"{model.types} words were counted, but {done} as the last ones of pairs")
    return model


def _contexts(model: Model, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How often distinct contexts continue, and the weight of the shorter context."""
    if len(words) > 1:
        return tuple(model.lookup(words, {"totals": np.float64, "gammas": np.float64}))
    ids = words[0]
    total, gamma, inside = np.zeros(len(ids)), np.zeros(len(ids)), ids < model.bos
    total[inside], gamma[inside] = model.values("totals", ids[inside]), model.values("gammas", ids[inside])
    total[~inside], gamma[~inside] = model.start
    return total, gamma


def _distinct(model: Model, words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct n-grams, in order of their first words, and the place of each row's."""
    _, at, back = np.unique(model.key(words), return_index=True, return_inverse=True)
    return [w[at] for w in words], back


def probabilities(model: Model, grams: list[np.ndarray]) -> np.ndarray:
    """p(last word | those before) of n-grams, a column for each place; -1 is an unknown word."""
    ids = grams[-1]
    if not model.tokens:
        return np.ones(len(ids))
    known, back = np.unique(ids, return_inverse=True)
    inside = known >= 0
    p = np.full(len(known), model.unseen)
    p[inside] = model.values("cont", known[inside])
    p = p[back]
    for n in range(2, model.order + 1):
        context = grams[-n:-1]
        rows = np.flatnonzero(np.logical_and.reduce([w >= 0 for w in context]))
        if not len(rows):
            continue
        distinct, back = _distinct(model, [w[rows] for w in context])
        total, gamma = (x[back] for x in _contexts(model, distinct))
        rows, total, gamma = rows[total > 0], total[total > 0], gamma[total > 0]
        p[rows] *= gamma
        rows, total = rows[ids[rows] >= 0], total[ids[rows] >= 0]
        if len(rows):
            distinct, back = _distinct(model, [w[rows] for w in grams[-n:]])
            c = model.lookup(distinct, {"counts": np.uint64})[0]
            p[rows] += np.maximum(c - _discount(c, model.discounts[n]), 0)[back] / total
    return p


def _scorer(model: Model):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = Numberer(model)
        for b in batches:
            done = 0
            for texts in _chunks(iter([b["text"]])):
                ids, sizes = number(texts)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                distinct, back = np.unique(ids, return_inverse=True)
                c = np.zeros(len(distinct))
                if model.types:
                    c[distinct >= 0] = model.values("counts", distinct[distinct >= 0])
                base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.types + 1)))[back]
                p = np.log10(probabilities(model, _grams(ids, sizes, model)))
                out = b.iloc[done : done + len(texts)][["doc_id", "held_out"]].copy()
                done += len(texts)
                out["n_tokens"], out["n_known"] = sizes, np.add.reduceat((ids >= 0).astype(np.int64), starts)
                out["train_tokens"] = model.tokens
                out["base_score"], out["score"] = np.add.reduceat(base, starts), np.add.reduceat(p, starts)
                yield out

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text, held_out. Adds the counts, base_score and score of each row. Null and empty texts have
    the end token alone; texts of any length are scored whole; nulls in other columns and repeated rows pass through, and other
    columns of docs don't matter; with no training text every token has base and model probability one; an empty table
    gives an empty result."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", "held_out", "text").mapInPandas(_scorer(model), schema)
