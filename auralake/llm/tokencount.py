"""Token counts under a public tokenizer.

A pandas function encodes in batches and returns lengths only. Texts split at safe boundaries, before a
space that has a non-space on at least one side, where byte-level pre-tokenizers always begin a new piece; so a very
long text never becomes one call, and a short piece that recurs is encoded once for each worker's cache. A long piece (of
a writing without spaces) splits once more, between a letter and a punctuation mark, where a new piece begins as well.
Calls to the library are balanced by bytes. Tokenizers without such a boundary (word ends, sentence pieces) take
whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes in one call to the library, about.
CALL_BYTES = 1 << 20
#: Bytes of the pieces in a worker's cache; it starts afresh beyond that.
CACHE_BYTES = 32 << 20
#: Longer pieces aren't cached, and split between letters and punctuation.
LONG = 48
# Punctuation that is neither a letter, a number nor a space in any version of Unicode; no apostrophe, which
# may begin a contraction's piece with the letters after it.
MARKS = ",.:;!?()[]{}<>/\\|\"-_=+*&%$#@~^\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b\u300c\u300d\u0964\u060c\u061f"
_state: dict = {}


def _load(path: str):
    if _state.get("path") != path:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            encode, byte_level = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
        else:
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            special = any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or [])
            byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not special
            encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        _state.update(path=path, encode=encode, byte_level=byte_level, cache={}, held=0, added=[t["content"] for t in spec.get("added_tokens") or []] if not path.endswith(".model") else [])
    return _state["encode"], _state["byte_level"]


_unsafe = re.compile(r"\s (?!\S)").search


def split_safely(text: str) -> list[str]:
    """Pieces that encode apart as they do together: before single spaces."""
    if _unsafe(text):
        return [x for x in re.split(r"(?<=\S)(?= )", text) if x]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


_inside = regex.compile(rf"(?<=\p{{L}})(?=[{re.escape(MARKS)}])").split


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _encode_all(encode, texts: list[str]) -> list[int]:
    out, call, size = [], [], 0
    for t in texts:
        call.append(t)
        size += n_bytes(t) + 16
        if size >= CALL_BYTES:
            out += encode(call)
            call, size = [], 0
    return out + (encode(call) if call else [])


def lengths(texts: list[str], path: str, sizes: list[int] | None = None) -> list[int]:
    """The number of tokens of each text; sizes are their bytes, where they are known."""
    encode, byte_level = _load(path)
    if not byte_level:
        return _encode_all(encode, texts)
    cache, out, at = _state["cache"], [], 0
    sizes = sizes or [n_bytes(t) for t in texts]
    while at < len(texts):
        if _state["held"] > CACHE_BYTES:
            cache.clear()
            _state["held"] = 0
        pieces, size = [], 0
        while at + len(pieces) < len(texts) and (not pieces or size < CALL_BYTES):
            size += sizes[at + len(pieces)]
            pieces.append(split_safely(texts[at + len(pieces)]))
        new = {p for x in pieces for p in x if p not in cache}
        long = {p: [p] if any(a in p for a in _state["added"]) else _inside(p) for p in new if len(p) > LONG}
        short = list(new - long.keys())
        cache.update(zip(short, _encode_all(encode, short), strict=True))
        _state["held"] += sum(map(len, short)) * 2 + 100 * len(short)
        if long:
            counts = iter(_encode_all(encode, [q for parts in long.values() for q in parts]))
            once = {p: sum(next(counts) for _ in parts) for p, parts in long.items()}
            out += [sum(once[p] if p in once else cache[p] for p in x) for x in pieces]
        else:
            get = cache.__getitem__
            out += [sum(map(get, x)) for x in pieces]
        at += len(pieces)
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for each row. A null text counts as empty: no bytes, no tokens. Texts of any
    length count whole; repeated rows, null ids and ids of any type pass through; other columns of docs don't matter; an
    empty table gives an empty result."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            yield pd.Series(lengths(texts.tolist(), path, sizes.tolist()), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    out = docs.select(F.col(id_col), size.alias("n_bytes"), n_tokens(text, size).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
