"""Token ids of whole texts, a slice of an Arrow column at a time.

A text is cut before spaces where no token of either kind of tokenizer can lie across; the words between are told apart by Arrow's
dictionary encoding, each different one is encoded once for a worker's cache, and the ids of texts are gathered from
there as arrays. Cuts are made

- before a space or line feed behind a character that isn't white space: byte-level pre-tokenizers begin a piece there; a sentence
  piece has its word mark in front only and no line feed, which `Pieces` checks when it loads a vocabulary;
- before a single space between white space and a character that isn't, for the same reasons.

Texts that aren't words with single spaces or line feeds between are cut by a slower expression, at places of the first kind only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one slice, and of words in a worker's cache, which starts afresh beyond that.
SLICE_BYTES, CACHE_BYTES = 8 << 20, 128 << 20
#: Bytes in one call to a library, about.
CALL_BYTES = 1 << 20
#: Words in one text of a call.
RUN = 50
# What counts as white space to Unicode or to Python.
WHITE = "\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Texts with such a place aren't words with single spaces or line feeds between.
_UNEVEN = f"^[ \\n]| $|  |[{WHITE}] [{WHITE}]|[{WHITE}]\\n"
#: The character that stands for a space in sentence pieces.
MARK = "\u2581"
_cuts = re.compile(r"(?<=\S)(?=[ \n])").split


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes are themselves, the others
    follow from 256 on in their order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def in_calls(texts: list[str], encode) -> list:
    """encode over texts, in calls of about CALL_BYTES."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 16
        if size >= CALL_BYTES:
            out += encode(texts[at : i + 1])
            at, size = i + 1, 0
    return out + (encode(texts[at:]) if at < len(texts) else [])


class ByteLevel:
    """A byte-level tokenizer of a .json file. With `plain`, strings of special tokens are ordinary text; else they are what
    the library makes of them by default."""

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        spaced = any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in added)
        #: Whether encoding falls apart at the cuts.
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spaced
        alphabet, special = byte_alphabet(), {t["content"] for t in added}
        size = self.model.get_vocab_size(with_added_tokens=True)
        pieces = [self.model.id_to_token(i) or "" for i in range(size)]
        self.bytes = [p.encode() if p in special else bytes(map(alphabet.__getitem__, p)) if all(c in alphabet for c in p) else p.encode() for p in pieces]
        self.sizes = np.array([len(b) for b in self.bytes])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return in_calls(texts, lambda some: [x.ids for x in self.model.encode_batch_fast(some, add_special_tokens=False)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end to end, number of each). Words that can stand behind each other are encoded RUN at a time, since a
        call costs more for each text than for its bytes; the bytes of tokens tell where a word ends."""
        run = np.fromiter((self.splits and t[:1] in (" ", "\n") and not t[-1].isspace() for t in texts), bool, len(texts))
        words = [t for t, r in zip(texts, run, strict=True) if r]
        found = self._ids(["".join(words[i : i + RUN]) for i in range(0, len(words), RUN)])
        ids = np.fromiter((i for x in found for i in x), np.int32)
        ends = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words)))
        after = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1 if len(ids) else np.zeros(0, np.int64)
        counts = np.zeros(len(texts), np.int64)
        counts[run] = np.diff(after, prepend=0)
        if run.all():
            return ids, counts
        others = self._ids([t for t, r in zip(texts, run, strict=True) if not r])
        counts[~run] = [len(x) for x in others]
        out, of_run = np.empty(int(counts.sum()), np.int32), np.repeat(run, counts)
        out[of_run], out[~of_run] = ids, np.fromiter((i for x in others for i in x), np.int32)
        return out, counts


class Pieces:
    """A sentence-piece model of a .model file. Its bytes of a text are those of a space and the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        mark = MARK
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(mark, " ").encode() for i, p in enumerate(pieces)]
        alone = self.model.piece_to_id(mark)
        #: Whether encoding falls apart at the cuts: no piece goes on after a mark behind another character.
        self.splits = not any(mark in p.lstrip(mark) or "\n" in p for p in pieces) and alone != self.model.unk_id() and self.model.encode("\n")[:1] == [alone]
        self.alone = [alone] if alone != self.model.unk_id() else []

    def _some(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode([t[1:] if t.startswith(" ") else t for t in texts], num_threads=1)
        return [(ids or self.alone) if t.startswith(" ") else ids[1:] for t, ids in zip(texts, found, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids, end to end, and their numbers, of texts that begin with the model's own space (alone, it is the piece of a mark), or with a line feed and go on
        from another text."""
        found = in_calls(texts, self._some)
        return np.fromiter((i for x in found for i in x), np.int32), np.fromiter(map(len, found), np.int64, len(found))


class Ragged:
    """Arrays of different lengths, end to end, to which more can be added."""

    def __init__(self, kind=np.int64):
        self.flat, self.start, self.n, self.rows = np.empty(1024, kind), np.zeros(1, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.n + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.n + len(flat)))
        self.flat[self.n : self.n + len(flat)] = flat
        self.start = np.concatenate([self.start, self.n + np.cumsum(sizes)])
        self.n, self.rows = self.n + len(flat), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the arrays of these rows end to end, their lengths)."""
        first, sizes = self.start[rows], self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        return self.flat[at], sizes


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The column in runs of rows of about SLICE_BYTES; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield column.slice(at, end - at)
        at = end


class Words:
    """A worker's cache of words: a number for each different one. `learn` is called with new ones, in the order of their numbers."""

    def __init__(self, learn, forget, splits: bool, whole: str = ""):
        self.learn, self.forget, self.splits, self.whole = learn, forget, splits, whole
        self.known: dict[str, int] = {}
        self.held = 0

    def _numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.held += sum(map(len, new)) * 2 + 200 * len(new)
            self.learn(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def of(self, texts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, end to end, number of words of each text); texts are not null. A text's first
        word has `lead` in front, the others their space or line feed. Texts that hold the string `whole` aren't cut."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
            self.forget()
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False) if self.splits else np.ones(len(texts), dtype=bool)
        never = pc.match_substring(texts, self.whole).to_numpy(zero_copy_only=False) if self.whole else np.zeros(len(texts), dtype=bool)
        uneven = uneven | never
        even = np.flatnonzero(~uneven)
        sizes = np.zeros(len(texts), np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        sizes[even] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        different, which = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        spaced = [w if w.startswith("\n") else " " + w for w in different]
        firsts = np.concatenate([[0], np.cumsum(sizes[even])[:-1]]).astype(np.int64) if len(even) else np.zeros(0, np.int64)
        if lead == " " or not len(even):
            numbers = self._numbers(spaced)[which] if len(which) else np.zeros(0, np.int64)
        else:
            inner = np.ones(len(which), dtype=bool)
            inner[firsts] = False
            used = np.zeros(len(different), dtype=bool)
            used[which[inner]] = True
            table = np.zeros(len(different), np.int64)
            table[used] = self._numbers([spaced[i] for i in np.flatnonzero(used)])
            numbers = table[which]
            numbers[firsts] = self._numbers([lead + different[i] for i in which[firsts]])
        if not uneven.any():
            return numbers, sizes
        odd = np.flatnonzero(uneven)
        cut = [([w for w in _cuts(lead + t) if w] if self.splits and not never[i] else [lead + t]) for i, t in zip(odd, texts.take(pa.array(odd)).to_pylist(), strict=True)]
        sizes[odd] = [len(c) for c in cut]
        out, ends = np.empty(int(sizes.sum()), np.int64), np.cumsum(sizes)
        of_text = np.repeat(uneven, sizes)
        out[~of_text], out[of_text] = numbers, self._numbers([w for c in cut for w in c])
        return out, sizes


class Encoder:
    """Token ids of texts under one tokenizer."""

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Pieces(path) if path.endswith(".model") else ByteLevel(path, plain)
        self.piece = isinstance(self.tokenizer, Pieces)
        self.words = Words(self._learn, self._forget, self.tokenizer.splits, MARK if self.piece else "")
        self._forget()

    def _forget(self) -> None:
        self.ids = Ragged(np.int32)

    def _learn(self, words: list[str]) -> None:
        self.ids.add(*self.tokenizer.encode(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end to end, number of ids of each); null texts are empty."""
        texts = pc.fill_null(texts, "")
        numbers, sizes = self.words.of(texts, " " if self.piece else "")
        ids, lengths = self.ids.take(numbers)
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, np.repeat(np.arange(len(texts)), sizes), lengths)
        if self.piece:  # an empty text has no pieces, though a space alone has one
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            ids, counts = ids[np.repeat(~empty, counts)], np.where(empty, 0, counts)
        return ids, counts


_encoders: dict = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """This worker's encoder of a file."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]
