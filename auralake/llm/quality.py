"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule reads text statistics and votes good (1), bad (-1) or nothing (0). A document's votes form a
pattern; with R rules there are at most 3^R patterns, so their counts are a bounded table however large the
corpus (177,147 rows for the eleven rules here). Spark counts them, and EM runs on those counts where the job is planned.

The hidden class of a document is good, or one of a few kinds of bad. Several rules look at each kind from different
sides. EM estimates how often each rule, where it votes, votes bad in each kind it looks at, and how often elsewhere, good
documents included: its accuracies. It starts from the shares of bad votes, alike for every rule, so none is trusted
or ignored beforehand. Rules of one kind that disagree are weighed by these accuracies: a single bad vote of a noisy rule
is outvoted. A document is kept if its posterior probability of being good is at least one half.

Texts stay in the JVM and are read once, by built-in functions; a table of statistics serves both passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The prior of each estimate counts as so many documents: this share of them good, these shares of votes bad elsewhere and in
#: a rule's own kinds; the same for all rules.
PRIOR, GOOD, BAD_VOTES = 10.0, 0.9, (0.02, 0.5)
ITERATIONS = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more among grams."""

    def covered(p: Column) -> Column:
        flags = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.when(F.coalesce((F.get(p, j).g == F.get(p, j - 1).g), F.lit(False)) | F.coalesce((F.get(p, j).g == F.get(p, j + 1).g), F.lit(False)), F.get(p, j).i))
        at = F.sort_array(F.filter(flags, lambda x: x.isNotNull()))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(WINDOW), x - a.last)).alias("n"))
        return F.aggregate(at, start, step, lambda a: a.n)

    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(pairs, covered))


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    gram = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: gram(h, i)))
    return F.when(F.size(words) > WINDOW, let(grams, _repeated)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts that the rules read. A null text has no words and no lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    letters = F.regexp_replace(text, r"\P{L}+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, common.SPACES, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_types"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    out = docs.select(
        F.col(id_col).alias("doc_id"),
        let(common.words(F.col(text_col)), of_words).alias("_al_w"),
        let(lines, of_lines).alias("_al_l"),
        (F.length(text) - count(text, common.SPACES)).cast("long").alias("word_chars"),
        count(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(letters, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}")).cast("long").alias("n_mark_runs"),
        F.regexp_count(text, F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")).cast("long").alias("n_lone_marks"),
        count(text, "!").cast("long").alias("n_shouts"),
    )
    return out.select("doc_id", "_al_w.*", "_al_l.*", "word_chars", "n_symbols", "n_letters", "n_upper", "n_mark_runs", "n_lone_marks", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains. kinds: what sort of bad it looks at."""

    name: str
    kinds: tuple[str, ...]
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0).cast("int").alias(self.name)


#: Thresholds are parameters: shares of words, letters or lines, the same for every language and size.
RULES = (
    Rule("symbols", ("debris", "fragments"), "n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    Rule("letters", ("debris",), "n_letters < 0.8 * word_chars", "n_words >= 10 and n_letters > 0.9 * word_chars"),
    Rule("mark_runs", ("debris", "shouting"), "n_mark_runs > 0.05 * n_words", "n_words >= 10 and n_mark_runs < 0.01 * n_words"),
    Rule("lone_marks", ("fragments",), "n_lone_marks > 0.05 * n_words", "n_words >= 10 and n_lone_marks < 0.01 * n_words"),
    Rule("capitals", ("shouting",), "n_upper > 0.3 * n_letters", "n_words >= 10 and n_upper < 0.15 * n_letters"),
    Rule("shouts", ("shouting",), "n_shouts > 0.05 * n_words", "n_words >= 10 and n_shouts < 0.01 * n_words"),
    Rule("repeats", ("repetition",), "n_repeat_words > 0.15 * n_words", "n_words >= 20 and n_repeat_words < 0.02 * n_words"),
    Rule("dup_lines", ("repetition",), "n_dup_lines > 0.1 * n_lines", "n_lines >= 2 and n_dup_lines = 0"),
    Rule("variety", ("repetition",), "n_words between 12 and 60 and n_types <= 0.5 * n_words or n_words between 61 and 2000 and n_types < 0.25 * n_words", "n_words between 12 and 2000 and n_types > 0.4 * n_words"),
    Rule("types", ("repetition",), "n_words >= 30 and n_types < 0.15 * n_words or n_words >= 12 and n_types <= 4", "n_words between 30 and 5000 and n_types > 0.2 * n_words"),
    Rule("word_length", ("fragments", "debris"), "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
)


@dataclass
class VoteModel:
    """The shares of good (first) and of each kind; how often a rule's vote is bad elsewhere, and in its own kinds (nan in
    others)."""

    kinds: list[str]
    shares: np.ndarray
    elsewhere: np.ndarray
    own: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """The probability of good and of each kind, of each row of votes; an abstention says nothing."""
        rates = np.vstack([self.elsewhere, np.where(np.isnan(self.own), self.elsewhere, self.own)])
        log = np.log(self.shares) + (votes == -1) @ np.log(rates).T + (votes == 1) @ np.log1p(-rates).T
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def quality(self, rules: tuple[Rule, ...]) -> Column:
        """The probability of good over the rules' votes, as a column: only a kind's own rules tell it from good."""
        against = F.lit(0.0)
        for share, own in zip(self.shares[1:], self.own, strict=True):
            odds = F.lit(float(np.log(share / self.shares[0])))
            for r, here, there in zip(rules, own.tolist(), self.elsewhere.tolist(), strict=True):
                if not np.isnan(here):
                    odds = odds + F.when(F.col(r.name) == -1, float(np.log(here / there))).when(F.col(r.name) == 1, float(np.log((1 - here) / (1 - there)))).otherwise(0.0)
            against = against + F.exp(F.least(odds, F.lit(600.0)))
        return 1 / (1 + against)


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = ITERATIONS) -> VoteModel:
    """EM over the counts of vote patterns (a column n beside one of each rule); 3^len(rules) rows at most, which are
    collected and put in order, so reruns agree. Ends when no estimate moves by 1e-9, or after so many iterations."""
    rows = sorted(tuple(r) for r in patterns.select(*[r.name for r in rules], "n").collect())
    votes = np.array([r[:-1] for r in rows], dtype=np.int64).reshape(-1, len(rules))
    n = np.array([r[-1] for r in rows], dtype=np.float64)
    kinds = sorted({k for r in rules for k in r.kinds})
    looks = np.array([[k in r.kinds for r in rules] for k in kinds])
    bad, cast = (votes == -1).astype(float), (votes != 0).astype(float)
    share = (bad @ looks.T) / np.maximum(cast @ looks.T, 1)
    p = np.column_stack([1 - share.max(axis=1), share])
    p /= p.sum(axis=1, keepdims=True)
    prior, last = np.array([GOOD] + [(1 - GOOD) / len(kinds)] * len(kinds)), None
    for _ in range(iterations):
        w = p * n[:, None]
        shares = (w.sum(axis=0) + PRIOR * prior) / (n.sum() + PRIOR)
        hits, seen = w.T @ bad, w.T @ cast
        away = np.vstack([np.ones(len(rules), dtype=bool), ~looks])
        elsewhere = ((hits * away).sum(axis=0) + PRIOR * BAD_VOTES[0]) / ((seen * away).sum(axis=0) + PRIOR)
        own = np.where(looks, (hits[1:] + PRIOR * BAD_VOTES[1]) / (seen[1:] + PRIOR), np.nan)
        model, now = VoteModel(kinds, shares, elsewhere, own), np.concatenate([shares, elsewhere, own[looks]])
        if last is not None and np.abs(now - last).max() < 1e-9:
            break
        last, p = now, model.classes(votes)
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes, `quality` (posterior) and the verdicts of each row.

    A null or empty text has no words, so it fails the base rules; texts of any length are read whole; repeated rows vote
    each time; a posterior of exactly one half keeps; other columns of docs don't matter; an empty table gives an
    empty result."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    stats = scratch.write(statistics(common.spread(docs.select(id_col, text_col)), id_col, text_col), "statistics")
    votes = stats.select("*", *[r.vote() for r in rules])
    model = fit(votes.groupBy(*[r.name for r in rules]).agg(F.count(F.lit(1)).alias("n")), rules)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = votes.withColumn("quality", model.quality(rules)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
