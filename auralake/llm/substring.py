"""Removal of long repeated word sequences by compaction of a De Bruijn graph.

Edges are sequences of K words. Of each window of WINDOW words the edge of least hash is its anchor, so equal windows have equal
anchors at equal places, and only anchors become rows: about one edge in (WINDOW - K) / 2. Each anchor comes with
the links to the anchors before and after it in its document, a link being a hash of all words from one to the other.

1. Edges in two documents or more are repeated. An edge branches ahead (behind) if its occurrences have different links there.
2. A repeated edge's successor is the one that a join on links finds: the only link ahead of the one is the only link behind the
   other. Pointer doubling over predecessors, a self-join a round, gives every edge the head of its nonbranching path and its
   distance from it, in about the logarithm of the longest path; edges on cycles are paths by themselves. So the table of
   paths has a row for each edge: its head, its place, and where it begins; every occurrence of an edge lies in a whole
   occurrence of its path.
3. Documents get the heads of their paths with the paths' length in words, not their edges. Where the text has a head, the path lies
   from there on. A path of WINDOW words and more becomes one row: a 128-bit digest of the words at its source coordinates. The windows
   that no path holds whole, and whose anchor is in a path, get a 128-bit hash each.
4. Rows with the same digest belong together; the least document keeps its words. If the occurrences of a path have different
   digests, or a text's paths don't hold all its repeated edges (link hashes that met by chance), the paths of these texts are
   opened, each edge its own path, and step 3 runs again until nothing differs, so a hash never decides what the words don't
   bear out.
5. The texts meet their removed stretches.

Texts move twice, by document; all else are rows of a few numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
K = 12
#: Bits of an edge's hash. Fewer make more edges share a hash, which costs time and changes nothing else.
BITS = 64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
#: Bytes of the words in a worker's hash cache; it starts afresh beyond that.
CACHE_BYTES = 32 << 20
_cache: dict[bytes, tuple[int, int]] = {}
_held = 0


def text_words(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as two rows."""
    global _held
    if _held > CACHE_BYTES:
        _cache.clear()
        _held = 0
    for w in words:
        if w not in _cache:
            h = xxhash.xxh3_128_intdigest(w)
            _cache[w] = (h >> 64, h & (1 << 64) - 1)
            _held += len(w) + 160
    return np.array([_cache[w] for w in words], dtype=np.uint64).reshape(-1, 2).T


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them; one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a document's words, from sums of powers of an odd number modulo 2^64."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        self.n = n = len(hashes)
        powers = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, dtype=np.uint64)]), dtype=np.uint64)
        self.inverse = powers(_INVERSES[which])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(_BASES[which])[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of words start .. end - 1, the same wherever they stand."""
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def anchors(roll: Rolling, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each K-word sequence and, for each window, the start of its anchor (the first of equals)."""
    n = roll.n
    at = np.arange(n - K + 1)
    grams = roll.of(at, at + K) >> np.uint64(64 - bits)
    reach, width = WINDOW - K + 1, 1
    least = grams.copy()
    place = at.copy()
    while width < reach:  # minima of doubled stretches
        step = min(width, reach - width)
        a, b = least[:-step], least[step:]
        later = b < a
        least, place = np.where(later, b, a), np.where(later, place[step:], place[:-step])
        width += step
    return grams, place


def _anchor_rows(roll: Rolling, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of each window, anchors, their rows): a row is edge, link behind, link ahead (0 where there is none) and the words to the next
    anchor."""
    grams, place = anchors(roll, bits)
    starts = np.unique(place)
    links = np.concatenate([[0], roll.of(starts[:-1], starts[1:] + K) | np.uint64(1), [0]]).astype(np.uint64)
    return place, starts, np.column_stack([grams[starts].view(np.int64), links[:-1].view(np.int64), links[1:].view(np.int64), np.append(np.diff(starts), 0)])


def edges(text: str | None, bits: int = BITS) -> np.ndarray:
    """The rows of the document's anchors, each once."""
    words = text_words(text)
    if len(words) < WINDOW:
        return np.zeros((0, 4), dtype=np.int64)
    return np.unique(_anchor_rows(Rolling(word_hashes(words)[0]), bits)[2], axis=0)


def _edge_rows(bits: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [edges(t, bits) for t in b["text"]]
            sizes = [len(x) for x in found]
            rows = np.concatenate([np.zeros((0, 4), dtype=np.int64), *found])
            out = {c: b[c].repeat(sizes).to_numpy() for c in ("id", "r")}
            yield pd.DataFrame({**out, "edge": rows[:, 0], "behind": rows[:, 1], "ahead": rows[:, 2], "step": rows[:, 3].astype(np.int32)})

    return find


def _path_rows(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Of rows with text, the heads of its paths, the paths' words and the number of rows of its repeated edges: a row for each path and each
    window that may be repeated. head is the first edge of a path, null for a window. A text whose paths hold another
    number of rows gives one at place -1."""
    for b in batches:
        out, sizes = [], []
        for text, heads, spans, n in zip(b["text"], b["heads"], b["spans"], b["n"], strict=True):
            words = text_words(text)
            hashes = word_hashes(words)
            one, two = Rolling(hashes[0], 0), Rolling(hashes[1], 1)
            place, starts, own = _anchor_rows(one, bits)
            heads, spans = np.asarray(heads, dtype=np.int64), np.asarray(spans, dtype=np.int64)
            order = np.argsort(heads)
            at = np.minimum(np.searchsorted(heads[order], own[:, 0]), max(0, len(heads) - 1))
            first = np.flatnonzero(heads[order][at] == own[:, 0]) if len(heads) else np.zeros(0, dtype=np.int64)
            a = starts[first]
            e = np.minimum(a + spans[order][at[first]], len(words))
            long = e - a >= WINDOW
            held, inside = np.zeros(len(words) + 1, dtype=np.int64), np.zeros(len(place) + 1, dtype=np.int64)
            np.add.at(held, a, 1)
            np.add.at(held, e - K + 1, -1)
            np.add.at(inside, a[long], 1)
            np.add.at(inside, e[long] - WINDOW + 1, -1)
            shared = np.cumsum(held)[starts] > 0
            wrong = len(np.unique(own[shared], axis=0)) != n
            alone = np.flatnonzero(shared[np.searchsorted(starts, place)] & (np.cumsum(inside[:-1]) == 0))
            rows = [(int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)) for x, y in zip(a[long], e[long], strict=True) for h in [hashlib.blake2b(b" ".join(words[x:y]), digest_size=16).digest()]]
            out.append(pd.DataFrame({"k1": [x for x, _ in rows], "k2": [y for _, y in rows], "start": a[long], "size": (e - a)[long], "head": own[first[long], 0]}, dtype="int64"))
            out.append(pd.DataFrame({"k1": one.of(alone, alone + WINDOW).view(np.int64), "k2": two.of(alone, alone + WINDOW).view(np.int64), "start": alone, "size": WINDOW}))
            if wrong:
                out.append(pd.DataFrame({"k1": [0], "k2": [0], "start": [-1], "size": [0]}))
            sizes.append(len(rows) + len(alone) + wrong)
        got = pd.concat(out) if out else pd.DataFrame({"k1": [], "k2": [], "start": [], "size": []}, dtype="int64")
        got["head"] = got["head"].astype("Int64") if "head" in got else pd.array([None] * len(got), dtype="Int64")
        for c in ("id", "r"):
            got[c] = b[c].repeat(sizes).to_numpy()
        yield got[["id", "r", "k1", "k2", "start", "size", "head"]].astype({"start": "int32", "size": "int32"})


def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    out = []
    for text, a, e in zip(texts, starts, ends, strict=True):
        words = text_words(text)
        if a is not None and len(a):
            turn = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(turn, a, 1)
            np.add.at(turn, e, -1)
            kept = [w for w, c in zip(words, np.cumsum(turn[:-1]).tolist(), strict=True) if not c]
        else:
            kept = words
        out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"]).astype({"n_words": "int64", "n_removed": "int64"})


def _ids() -> list:
    """The least and the greatest id of a group, and whether it has a row without an id, which comes before all others."""
    return [F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("unnamed")]


#: More than one document.
SPREAD = "least < most or unnamed and most is not null"


def compacted(groups: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The table of paths (edge, head, place, at): of each edge the head of its nonbranching path, how many edges and how many words lie between.

    groups: edge, behind and ahead, its only link there or null, and step, the words to the next anchor by the link ahead.
    Predecessors come from a join on links; a link that more than one edge has on one side joins nothing."""
    only = lambda link, name: groups.where(F.col(link).isNotNull()).groupBy(F.col(link).alias("link")).agg(F.min("edge").alias(name), F.max("edge").alias("_most"), F.max("step").alias(f"step_{name}")).where(F.col(name) == F.col("_most")).drop("_most")
    pairs = only("ahead", "before").join(only("behind", "own"), "link").where("before <> own").select(F.col("own").alias("_e"), "before", F.col("step_before").alias("_step"))
    begun = groups.select("edge").join(pairs, F.col("edge") == F.col("_e"), "left")
    state = scratch.write(begun.select("edge", F.coalesce("before", "edge").alias("to"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("place"), F.coalesce("_step", F.lit(0)).cast("long").alias("at"), F.col("before").isNotNull().alias("moved")), "pointers0")
    left, i = None, 0
    while True:
        ahead = state.select(F.col("edge").alias("_to"), F.col("to").alias("_next"), F.col("place").alias("_place"), F.col("at").alias("_at"))
        moved = F.col("_place") > 0
        met = state.join(ahead, F.col("to") == F.col("_to")).select("edge", F.col("_next").alias("to"), (F.col("place") + F.col("_place")).alias("place"), (F.col("at") + F.col("_at")).alias("at"), moved.alias("moved"))
        nxt = scratch.write(met, f"pointers{i + 1}")
        scratch.drop(f"pointers{i}")
        state, i, n = nxt, i + 1, nxt.where("moved").count()
        if not n or n == left:  # pointers on paths all reach their heads in the end; what still moves goes round
            break
        left = n
    whole = lambda c, alone: F.when(F.col("moved"), alone).otherwise(F.col(c))
    return state.select("edge", whole("to", F.col("edge")).alias("head"), whole("place", F.lit(0)).cast("long").alias("place"), whole("at", F.lit(0)).cast("long").alias("at"))


def graph(rows: DataFrame, scratch: common.Scratch, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(anchors, paths) of rows (id, r, text): the rows of all anchors, and the compacted paths of the repeated ones."""
    kind = rows.schema["id"].dataType.simpleString()
    found = scratch.write(rows.mapInPandas(_edge_rows(bits), f"id {kind}, r long, edge long, behind long, ahead long, step int"), "edges")
    sides = [f(c).alias(f"{n}_{c}") for c in ("behind", "ahead") for f, n in ((F.min, "low"), (F.max, "high"))]
    groups = found.groupBy("edge").agg(*_ids(), F.max("step").alias("step"), *sides).where(SPREAD)
    link = lambda c: F.when((F.col(f"low_{c}") == F.col(f"high_{c}")) & (F.col(f"low_{c}") != 0), F.col(f"low_{c}")).alias(c)
    groups = scratch.write(groups.select("edge", link("behind"), link("ahead"), "step"), "groups")
    return found, scratch.write(compacted(groups, scratch), "paths")


def _lists(found: DataFrame, paths: DataFrame) -> DataFrame:
    """By id and r: the heads of a text's paths, the paths' words, and the number of rows of its repeated edges."""
    spans = paths.groupBy("head").agg((F.max("at") + K).alias("span"))
    marked = paths.join(spans, "head").select("edge", F.when(F.col("edge") == F.col("head"), F.col("span")).alias("span"))
    shared = found.select("id", "r", "edge", F.xxhash64("edge", "behind", "ahead").alias("row")).join(marked, "edge")
    sets = shared.groupBy("id", "r").agg(F.collect_set(F.when(F.col("span").isNotNull(), F.struct("edge", "span"))).alias("own"), F.collect_set("row").alias("rows"))
    return sets.select("id", "r", F.col("own.edge").alias("heads"), F.col("own.span").alias("spans"), F.size("rows").cast("long").alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """By row: its id, n_words, n_removed and `kept`, the words that stay, joined by single spaces.

    A null text has no words. Ids may have any ordered type. Rows of one id are one document: none of them makes another
    lose words; rows without an id are one document that comes before all others. Texts of any length are taken whole, and
    fewer than WINDOW words lose none. Ties can't occur, since the least id is one document. Other columns of docs don't
    matter. An empty table gives an empty result."""
    scratch = common.Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("r"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found, paths = graph(rows, scratch, bits)
    same = lambda a, b: a.id.eqNullSafe(b.id) & (a.r == b.r)
    attempt = 0
    while True:
        lists = scratch.write(_lists(found, paths), f"lists{attempt}")
        met = rows.join(lists, same(rows, lists)).select(rows.id, rows.r, rows.text, "heads", "spans", "n")
        pieces = scratch.write(met.mapInPandas(lambda batches: _path_rows(batches, bits), f"id {kind}, r long, k1 long, k2 long, start int, size int, head long"), f"pieces{attempt}")
        digest = F.struct("k1", "k2")
        unlike = pieces.where("head is not null").groupBy("head").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("head")
        wrong = pieces.join(unlike, "head", "left_semi").select("id", "r").union(pieces.where("start < 0").select("id", "r")).distinct()
        wrong = wrong.select(F.col("id").alias("i"), F.col("r").alias("q"))
        if not wrong.limit(1).count():
            break
        # rare: all paths of such texts are opened, so their texts take the long way
        met = found.join(wrong, found.id.eqNullSafe(wrong.i) & (found.r == wrong.q), "left_semi").select("edge").distinct()
        heads = paths.join(met, "edge", "left_semi").select("head").distinct().withColumn("open", F.lit(True))
        single = lambda c, alone: F.when(F.col("open"), alone).otherwise(F.col(c)).alias(c)
        if not paths.where("place > 0").join(heads, "head", "left_semi").limit(1).count():
            raise RuntimeError("texts differ though all of their paths are open")
        opened = paths.join(heads.withColumnRenamed("head", "_h"), F.col("head") == F.col("_h"), "left")
        attempt += 1
        paths = scratch.write(opened.select("edge", single("head", F.col("edge")), single("place", F.lit(0).cast("long")), single("at", F.lit(0).cast("long"))), f"paths{attempt}")
    groups = pieces.groupBy("k1", "k2").agg(*_ids()).where(SPREAD).select("k1", "k2", "least", "unnamed")
    hits = pieces.join(scratch.write(groups, "repeated"), ["k1", "k2"]).where("unnamed and id is not null or id > least")
    gone = hits.groupBy("id", "r").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("gone"))
    without = F.pandas_udf(_without, "n_words long, n_removed long, kept string")
    out = rows.join(gone, same(rows, gone), "left").select(rows.id.alias(id_col), without(rows.text, F.col("gone.start"), F.col("gone.end")).alias("w"))
    return out.select(id_col, "w.*")
