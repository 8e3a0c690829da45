"""Language identification with spans.

The model is fitted on a sample of labelled texts of a documented bound. It holds log-probabilities of
character n-grams (1 to MAX_N, with word ends) for each language, and the scripts each language writes in. A
word's script range narrows the candidate languages; Viterbi over the word scores, with a penalty for each
switch of language, labels the words of a text, mixed or not; the label with the most letters wins.

Viterbi itself runs only where it can change the answer: if no stretch of words prefers other languages
to the best single one by more than the switches would cost, the best path is that language throughout.

N-grams are 64-bit hashes in one sorted array, each with the few languages it occurs in, so the model grows with the n-grams
of the sample and not with n-grams times languages. Distinct new words of a batch are scored together. Stretches of letters
beyond MAX_WORD go in pieces of that length, and long texts in blocks of words, so no text is too long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The fit reads about so many labelled texts of each language, and so many of all, chosen by a hash; whole texts.
TRAIN_DOCS = 2000
TRAIN_TOTAL = 50_000
#: Bytes of the sample's texts, about, shared evenly by the languages; a text of over one in SAMPLE_SHARE of a language's bytes
#: isn't taken where the language has others.
TRAIN_BYTES = 96 << 20
SAMPLE_SHARE = 16
#: More labels than this aren't languages: an error.
MAX_LANGS = 5000
MAX_N = 4
MAX_WORD = 1000
SMOOTHING = 0.5
#: Cost of a switch of language, in units of a word's score.
SWITCH = 12.0
#: Scripts with less than this share of a language's letters aren't its own.
SCRIPT_SHARE = 0.01
#: A word fits a language that knows this share of its n-grams and its script.
KNOWN_SHARE = 0.25
#: Bytes of the word scores that a worker keeps; it starts afresh beyond that.
CACHE_BYTES = 32 << 20
#: Words that are looked at together, but for a longer single text.
BLOCK = 1 << 16

# The first and last code points of writing systems, from the public Unicode block list.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("latin", 0x1E00, 0x1EFF),
)
OTHER = "other"

_word = re.compile(rf"[^\W\d_]{{1,{MAX_WORD}}}").findall
_FIRST = np.array([a for _, a, _ in SCRIPTS])
_LAST = np.array([b for _, _, b in SCRIPTS])
NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), OTHER]
_NUMBER = np.array([NAMES.index(name) for name, _, _ in SCRIPTS] + [len(NAMES) - 1])
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(MAX_N)]


def text_words(text: str | None) -> list[str]:
    """The lower-case words with a letter."""
    words = _word(text.lower()) if text else []
    return words if all(map(str.isalpha, words)) else [w for w in words if any(map(str.isalpha, w))]


def scripts_of(words: list[str]) -> np.ndarray:
    """The number in NAMES of the script of each word's first letter."""
    c = np.array([ord(w[0]) for w in words], dtype=np.int64)
    inside = (c[:, None] >= _FIRST) & (c[:, None] <= _LAST)
    return _NUMBER[np.where(inside.any(axis=1), inside.argmax(axis=1), len(_FIRST))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, words): the n-grams of all these words, each word between two marks, and the place of each one's word."""
    line = "^" + "$^".join(words) + "$"
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(c))  # characters to the word's end, this one included
    mark = (left == 1) | (left == sizes[owner])
    hashes, owners, sums = [], [], np.zeros(len(c), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        sums = sums.copy()
        sums[: len(c) - n + 1] += (c[n - 1 :] + np.uint64(n)) * _FACTORS[n - 1]
        own = left >= n if n > 1 else ~mark
        h = sums[own] + np.uint64(n)
        hashes.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        owners.append(owner[own])
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class LanguageModel:
    """langs in order; the sorted hashes of the n-grams, with the range of `lang` and `gain` that belongs to each: by how much
    an n-gram's log-probability in that language lies above that of unseen ones (`unseen`); which languages use a
    script (a row for each of NAMES)."""

    langs: list[str]
    keys: np.ndarray
    at: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    unseen: np.ndarray
    scripts: np.ndarray

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) twice: the mean log-probability of the n-gram orders, and whether the word fits. Languages of
        other scripts are out, unless all are."""
        n, many = len(self.langs), len(words)
        h, owner = grams(words)
        place = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[place] == h) if len(self.keys) else np.zeros(0, dtype=np.int64)
        first, size = self.at[place[hit]], self.at[place[hit] + 1] - self.at[place[hit]]
        each = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(owner[hit], size) * n + self.lang[each]
        total = np.bincount(owner, minlength=many)[:, None]
        s = (np.bincount(cell, weights=self.gain[each], minlength=many * n).reshape(many, n) + total * self.unseen) / MAX_N
        known = np.bincount(cell, minlength=many * n).reshape(many, n)
        top = s.max(axis=1, keepdims=True)
        s = np.maximum(s, top - SWITCH)
        own = self.scripts[scripts_of(words)]
        fits = own & (known >= KNOWN_SHARE * total)
        out = ~own & own.any(axis=1, keepdims=True)
        return np.where(out, top - 2 * SWITCH, s), fits


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, total: int = TRAIN_TOTAL, train_bytes: int = TRAIN_BYTES) -> LanguageModel:
    """Counts the n-grams of a bounded sample of the rows with text and language: about train_docs texts a language, or
    fewer where there are so many languages that these were over total, or where their texts have so many bytes that these were over
    train_bytes in all. Texts of over one in SAMPLE_SHARE of a language's bytes aren't taken, unless
    a language has no others: then its shortest one is. All n-grams of the sample count, so what reaches the driver is bounded by train_bytes."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.octet_length(text_col).cast("long").alias("size"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        none = np.zeros(0, dtype=np.int64)
        return LanguageModel([], none.astype(np.uint64), np.zeros(1, dtype=np.int64), none, none.astype(float), none.astype(float), np.zeros((len(NAMES), 0), dtype=bool))
    most, share = min(train_docs, max(1, total // len(sizes))), train_bytes // len(sizes)
    fits = F.col("size") <= share // SAMPLE_SHARE
    of = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count(F.when(fits, 1)).alias("n"), F.sum(F.when(fits, F.col("size"))).alias("bytes"), F.min(F.struct("size", "h")).alias("least")).collect()}
    rate = {g: min(1.0, most / r["n"], share / max(1, r["bytes"])) if r["n"] else 0.0 for g, r in of.items()}
    part = F.create_map(*[F.lit(x) for g, p in rate.items() for x in (g, p)])[F.col("lang")]
    taken = fits & (F.pmod("h", F.lit(1_000_000)) < part * 1_000_000)
    alone = [g for g, r in of.items() if not r["n"]]
    for g in alone:
        taken = taken | ((F.col("lang") == g) & (F.col("h") == of[g]["least"]["h"]) & (F.col("size") == of[g]["least"]["size"]))
    sample = labelled.where(taken).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                seen = Counter(w for t in texts for w in text_words(t))
                every = list(seen)
                for a in range(0, len(every), BLOCK):
                    words = every[a : a + BLOCK]
                    times = np.array([seen[w] for w in words], dtype=np.int64)
                    h, owner = grams(words)
                    keys, back = np.unique(h, return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "script": -1, "gram": keys.view(np.int64), "n": np.bincount(back, weights=times[owner]).astype(np.int64)})
                    letters = np.bincount(scripts_of(words), weights=times * np.array([len(w) for w in words]), minlength=len(NAMES)).astype(np.int64)
                    yield pd.DataFrame({"lang": lang, "script": np.arange(len(NAMES)), "gram": 0, "n": letters})

    counted = sample.mapInPandas(count, "lang string, script int, gram long, n long").groupBy("lang", "script", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # what occurs in the sample, which is bounded
    langs = sorted(r["lang"] for r in sizes)
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in got["lang"].to_pylist()], dtype=np.int64)
    script, gram, n = (got[c].to_numpy() for c in ("script", "gram", "n"))
    letters = np.zeros((len(NAMES), len(langs)))
    np.add.at(letters, (script[script >= 0], lang[script >= 0]), n[script >= 0])
    lang, gram, n = lang[script < 0], gram[script < 0].view(np.uint64), n[script < 0]
    order = np.lexsort((lang, gram))
    lang, gram, n = lang[order], gram[order], n[order]
    keys, first = np.unique(gram, return_index=True)
    whole = np.bincount(lang, weights=n, minlength=len(langs)) + SMOOTHING * (len(keys) + 1)
    return LanguageModel(langs, keys, np.append(first, len(gram)), lang, np.log1p(n / SMOOTHING), np.log(SMOOTHING / whole), letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def viterbi(scores: np.ndarray | Callable[[int, int], np.ndarray], switch: float = SWITCH, n: int | None = None) -> np.ndarray:
    """The labels of the best path over (words, languages) scores, `switch` less for each change of label. Of
    equal paths it stays with the label of the lower number and changes late. scores: an array, or a function that gives
    the rows from a to b - 1 of n, so that a long text's scores needn't be there all at once."""
    if isinstance(scores, np.ndarray):
        whole, n = scores, len(scores)
        scores = lambda a, b: whole[a:b]
    blocks = [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
    best = int(sum(scores(a, b).sum(axis=0) for a, b in blocks).argmax())
    if scores(0, 1).shape[1] > 1:
        lead = []
        for a, b in blocks:
            s = scores(a, b)
            lead.append((np.delete(s, best, axis=1) - s[:, best : best + 1]).max(axis=1))
        gain = np.cumsum(np.concatenate(lead))
        before = np.concatenate([[0.0], gain])
        inner = (gain - np.minimum.accumulate(before)[:-1]).max()  # a stretch inside the text costs two switches
        if max(gain.max(), gain[-1] - before.min()) > switch or inner > 2 * switch:
            return _path((row for a, b in blocks for row in scores(a, b).tolist()), switch, n)
    return np.full(n, best)


def _path(rows: Iterator[list[float]], switch: float, n: int) -> np.ndarray:
    value = next(rows)
    k = len(value)
    back, stay = np.empty((n, k), dtype=np.uint16), range(k)
    for i, row in enumerate(rows, 1):
        top = max(value)
        j, top = value.index(top), top - switch
        back[i] = [c if value[c] >= top else j for c in stay]
        value = [(v if v >= top else top) + s for v, s in zip(value, row, strict=True)]
    out = np.empty(n, dtype=np.int64)
    out[-1] = value.index(max(value))
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


class Detector:
    """Labels texts; keeps the scores of words it has met."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        n = max(1, len(model.langs))
        self.most = max(1000, CACHE_BYTES // (5 * n))
        self.matrix, self.fits = np.zeros((1024, n), dtype=np.float32), np.zeros((1024, n), dtype=bool)

    def ids(self, words: list[list[str]]) -> list[np.ndarray]:
        """The rows of the words of some texts in the matrix of scores."""
        if len(self.known) > self.most:
            self.known.clear()
        known, held = self.known, len(self.known)
        new = list({w for ws in words for w in ws if w not in known})
        known.update(zip(new, range(held, held + len(new)), strict=True))
        while len(self.matrix) < len(known):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.fits = np.concatenate([self.fits, np.zeros_like(self.fits)])
        step = max(1, min(BLOCK, (4 << 20) // self.matrix.shape[1]))
        for a in range(0, len(new), step):
            part = slice(held + a, held + min(a + step, len(new)))
            self.matrix[part], self.fits[part] = self.model.score(new[a : a + step])
        get = known.__getitem__
        return [np.fromiter(map(get, ws), dtype=np.int64, count=len(ws)) for ws in words]

    def _paths(self, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, their rows, their labels) of each text."""
        at = 0
        while at < len(texts):
            words, size = [], 0
            while at < len(texts) and (not words or size < BLOCK):
                words.append(text_words(texts[at]) if self.model.langs else [])
                size += len(words[-1])
                at += 1
            for ws, ids in zip(words, self.ids(words), strict=True):
                yield ws, ids, viterbi(lambda a, b, i=ids: self.matrix[i[a:b]].astype(np.float64), n=len(ids)) if len(ids) else ids

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, first word, words) of each stretch."""
        _, ids, path = next(self._paths([text]))
        cuts = np.flatnonzero(np.diff(path, prepend=-1)) if len(ids) else []
        return [(self.model.langs[path[a]], int(a), int(b - a)) for a, b in zip(cuts, [*cuts[1:], len(path)], strict=True)]

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, int]]:
        """By text: language, the share of the letters in words that have its label and fit it, number of spans."""
        for words, ids, path in self._paths(texts):
            if not words:
                yield "und", 0.0, 0
                continue
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            best = int(np.bincount(path, weights=sizes, minlength=len(self.model.langs)).argmax())
            good = sizes[(path == best) & self.fits[ids, best]].sum()
            yield self.model.langs[best], float(good / sizes.sum()), int((np.diff(path) != 0).sum()) + 1


def detect(model: LanguageModel):
    """A function of a text column: struct(lang_pred, score, n_spans)."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_spans int")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = Detector(shared.value)
        for s in batches:
            yield pd.DataFrame(detector.label(s.tolist()), columns=["lang_pred", "score", "n_spans"]).astype({"score": "float64", "n_spans": "int32"})

    return label


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", name: str = "_al_lang") -> DataFrame:
    """docs with a struct column of lang_pred, score and n_spans. Null texts and texts without a letter are
    `und` with score 0 and no span, as is every text if nothing was learned; texts of any length are read whole; ties go to the
    language that comes first by name; other columns, nulls and repeated rows pass through; an empty table gives an
    empty result. A column of docs with this name is an error."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name}; give another name")
    return docs.withColumn(name, detect(model)(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model here learns from."""
    return common.id_remainder(doc_id, 4) == 2
