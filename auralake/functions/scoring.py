"""`lm_score`, a table function for SQL that scores each word of a text under a back-off model:

    scoring.register(spark, ngrams, 3)
    spark.sql("SELECT t.id, s.* FROM turns t, LATERAL lm_score(t.text) s")

Every worker holds the whole model, so its size is checked first: a model of more than `most` n-grams is an error, and texts are then
scored by the joins of `operators.ngram` or `operators.numbered`, which give the same values and hold no model in memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: N-grams that a worker may hold.
MOST = 2_000_000
COLUMNS = "pos int, word string, history array<string>, is_oov boolean, n_hist int, n_used int, log10_p double"
BLANK = re.compile(r"[ \t\n\r]+")

#: By the words of an n-gram: log10 of its probability (or null) and its back-off.
Grams = dict[tuple[str, ...], tuple[float | None, float]]


def score_line(words: list[str], grams: Grams, order: int, unknown: str | None = None) -> Iterator[tuple]:
    """The rows of COLUMNS for the words of a line, by the rule of `operators.ngram.score`. history: the words before that count,
    at most order - 1, the oldest first; a word out of vocabulary cuts it. Probability and order used are null out of vocabulary."""
    known = lambda g: grams[g][0] if g in grams else None
    before: tuple[str, ...] = ()
    for pos, word in enumerate(words):
        w = word if known((word,)) is not None else unknown if unknown is not None and known((unknown,)) is not None else None
        if w is None:
            yield pos, word, list(before), True, len(before), None, None
            before = ()
            continue
        used = next(k for k in range(len(before) + 1, 0, -1) if known((*before[len(before) - k + 1 :], w)) is not None)
        backed = 0.0
        for n in range(used, len(before) + 1):
            context = before[len(before) - n :]
            if known(context) is None:
                break
            backed += grams[context][1]
        yield pos, word, list(before), False, len(before), used, known((*before[len(before) - used + 1 :], w)) + backed
        before = (*before, w)[max(len(before) + 2 - order, 0) :]


def register(spark: SparkSession, ngrams: DataFrame, order: int, name: str = "lm_score", unknown: str | None = None, most: int = MOST) -> None:
    """Makes the function known under this name. ngrams: ord, words, log10_p, log10_bo. The text's words are those of `text.words`; a null
    or empty text has no row."""
    kept = ngrams.where(F.col("ord") <= order).select("words", "log10_p", F.coalesce("log10_bo", F.lit(0.0)).alias("bo"))
    rows = kept.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the model has more than {most} n-grams: score by joins")
    held = spark.sparkContext.broadcast({tuple(r.words): (r.log10_p, r.bo) for r in rows})

    @F.udtf(returnType=COLUMNS)
    class Score:
        def eval(self, text: str) -> Iterator[tuple]:
            if text:
                yield from score_line([w for w in BLANK.split(text) if w], held.value, order, unknown)

    spark.udtf.register(name, Score)
