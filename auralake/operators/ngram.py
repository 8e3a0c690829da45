"""Scoring tokens under back-off n-gram models by equi-joins.

A model is a table (ord, words array<string>, log10_p, log10_bo). A token's history are the words before it in its
line, cut at the first word outside the vocabulary. One left join for each order looks up the n-gram that ends in the
token, with its back-off; the back-off of a context is the one found at the token before, so a lag fetches it. A coalesce
chain then applies

    log p = log p(longest known n-gram) + the back-offs of the longer contexts, up to the first unknown one.

Spark chooses each join's strategy by size; keys are the joined words, so no join is a range or a cross product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logmath

#: Between the words of a key; no token holds it.
SEP = "\x01"
CUE, UNKNOWN = "<s>", "<UNK>"


def _key(*words: Column) -> Column:
    """The words of a key in order; null if any is."""
    return F.concat(*[x for w in words for x in (w, F.lit(SEP))])


def counts(ngrams: DataFrame) -> DataFrame:
    return ngrams.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))


def of_order(ngrams: DataFrame, k: int) -> DataFrame:
    return ngrams.where(F.col("ord") == k)


def successors(ngrams: DataFrame, context: list[str]) -> DataFrame:
    """The n-grams one longer than the context that continue it."""
    n = len(context)
    return ngrams.where((F.col("ord") == n + 1) & (F.slice("words", 1, n) == F.array(*[F.lit(w) for w in context])))


def sort_by_reversed(ngrams: DataFrame) -> DataFrame:
    """By last word, then the one before, shorter first."""
    return ngrams.orderBy(F.reverse("words"))


def score(tokens: DataFrame, ngrams: DataFrame, line: list[str], order: int, pos: str = "pos", word: str = "word", unknown: str | None = None) -> DataFrame:
    """tokens with is_oov, n_hist, n_used and log10_p (null out of vocabulary).

    unknown: the model's word for words that it doesn't know; without it they are out of vocabulary and cut histories."""
    by = Window.partitionBy(*line).orderBy(pos)
    history = lambda k: [F.col(f"_h{i}") for i in range(k, 0, -1)]
    t = tokens
    for k in range(1, order + 1):
        key = _key(*[F.get("words", F.lit(i)) for i in range(k)]).alias("_k")
        own = ngrams.where(F.col("ord") == k).select(key, F.col("log10_p").alias(f"_p{k}"), F.coalesce("log10_bo", F.lit(0.0)).alias(f"_o{k}"))
        asked = _key(F.col(word)) if k == 1 else _key(*history(k - 1), F.col("_w"))
        t = t.join(own, asked == F.col("_k"), "left").drop("_k")
        if k == 1:
            t = t.withColumn("_w", F.when(F.col("_p1").isNotNull(), F.col(word)).otherwise(F.lit(unknown)))
            if unknown is not None:  # words that stand for the model's unknown word have its values
                own = ngrams.where((F.col("ord") == 1) & (F.col("words")[0] == unknown)).select("log10_p", F.coalesce("log10_bo", F.lit(0.0))).first()
                p, bo = (F.lit(x).cast("double") for x in (own or (None, None)))
                t = t.withColumns({"_p1": F.coalesce("_p1", p), "_o1": F.coalesce("_o1", bo)})
                t = t.withColumn("_w", F.when(F.col("_p1").isNotNull(), F.col("_w")))
        if k < order:
            t = t.withColumns({f"_h{k}": F.lag("_w", k).over(by), f"_b{k}": F.lag(f"_o{k}").over(by)})
            if k > 1:
                t = t.withColumn(f"_h{k}", F.when(F.col(f"_h{k - 1}").isNotNull(), F.col(f"_h{k}")))
    n_hist = sum((F.when(F.col(f"_h{k}").isNotNull(), 1).otherwise(0) for k in range(1, order)), F.lit(0))
    used = F.coalesce(*[F.when(F.col(f"_p{k}").isNotNull(), k) for k in range(order, 0, -1)])

    def backed(k: int) -> Column:
        """The back-offs of contexts of k words and more, as far as they are known."""
        total, ok = F.lit(0.0), F.lit(True)
        for n in range(k, order):
            ok = ok & F.col(f"_b{n}").isNotNull()
            total = total + F.when(ok, F.col(f"_b{n}")).otherwise(0.0)
        return total

    p = F.coalesce(*[F.col(f"_p{k}") + backed(k) for k in range(order, 0, -1)])
    return t.select(*tokens.columns, F.col("_w").isNull().alias("is_oov"), n_hist.alias("n_hist"), used.alias("n_used"), p.alias("log10_p"))


def weighted(log10_p: Column, lw: float = 1.0, wip: float = 1.0, math: logmath.LogMath | None = None) -> Column:
    """The integer model score: log p times the language weight, plus the insertion penalty, truncated."""
    m = math or logmath.LogMath()
    return (m.from_log10(log10_p) * F.lit(lw) + m.log(F.lit(wip))).cast("int")


def unweighted(score: Column, lw: float = 1.0, wip: float = 1.0, math: logmath.LogMath | None = None) -> Column:
    m = math or logmath.LogMath()
    return ((score - m.log(F.lit(wip))) / F.lit(lw)).cast("int")


def perplexity(scored: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """By keys: words scored, context cues and words out of vocabulary (neither is scored), cross-entropy in bits and
    perplexity. With nothing scored the entropy is 0."""
    cue, hit = F.col(word) == CUE, (F.col(word) != CUE) & ~F.col("is_oov")
    bits = -F.sum(F.when(hit, F.col("log10_p"))) / F.lit(0.30102999566398119521) / F.sum(hit.cast("int"))
    out = scored.groupBy(*keys).agg(F.sum(hit.cast("int")).alias("n_scored"), F.sum(cue.cast("int")).alias("n_cues"), F.sum((~cue & F.col("is_oov")).cast("int")).alias("n_oov"), F.coalesce(bits, F.lit(0.0)).alias("entropy"))
    return out.withColumn("perplexity", F.pow(F.lit(2.0), F.col("entropy")))


def perplexity_parity(scored: DataFrame, line: list[str], math: logmath.LogMath | None = None, word: str = "word") -> DataFrame:
    """As `perplexity`, by line, with the integer arithmetic of older tools: whole-number logs and quotient."""
    m = math or logmath.LogMath()
    hit = (F.col(word) != CUE) & ~F.col("is_oov")
    sums = scored.groupBy(*line).agg(F.sum(F.when(hit, -m.from_log10(F.col("log10_p")))).alias("_s"), F.sum(hit.cast("int")).alias("n_scored"))
    return sums.select(*line, "n_scored", (F.when(F.col("n_scored") > 0, F.expr("_s div n_scored")).otherwise(0) * F.lit(m.step * 1.4426950408889634)).alias("entropy"))


def without_ids(tokens: DataFrame, line: list[str], pos: str = "pos", word: str = "word") -> DataFrame:
    """tokens without the last word of each line where that is in parentheses: an utterance's id, which isn't evaluated."""
    last = F.lead(word).over(Window.partitionBy(*line).orderBy(pos)).isNull()
    return tokens.withColumn("_last", last).where(~(F.col("_last") & F.col(word).startswith("(") & F.col(word).endswith(")"))).drop("_last")


def totals(scored: DataFrame, keys: list[str] | None = None, lw: float = 1.0, wip: float = 1.0, math: logmath.LogMath | None = None) -> DataFrame:
    """The evaluation of scored tokens (word, is_oov, is_unknown if there is one, log10_p): by keys (one row for everything,
    without any), n_words, n_oov and their percentage, n_cues, the log10 probability of what is scored, the sum of its
    integer scores under the language weight and insertion penalty, and cross-entropy in bits and perplexity, which take the weights in, too.
    Context cues aren't scored, nor are words that the model doesn't know, whether or not another word stands for them."""
    missing = F.col("is_oov") | F.col("is_unknown") if "is_unknown" in scored.columns else F.col("is_oov")
    cue, hit = F.col("word") == CUE, (F.col("word") != CUE) & ~missing
    n = F.count(F.when(hit, 1))
    total = F.sum(F.when(hit, F.col("log10_p")))
    bits = -F.sum(F.when(hit, F.col("log10_p") * F.lit(lw) + F.log10(F.lit(wip)))) / F.lit(0.30102999566398119521) / n
    out = scored.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_words"), F.count(F.when(~cue & missing, 1)).alias("n_oov"), F.count(F.when(cue, 1)).alias("n_cues"),
        F.coalesce(total, F.lit(0.0)).alias("log10_p"), F.coalesce(F.sum(F.when(hit, weighted(F.col("log10_p"), lw, wip, math).cast("long"))), F.lit(0)).alias("score"), F.coalesce(bits, F.lit(0.0)).alias("entropy"),
    )
    return out.withColumns({"oov_percent": F.when(F.col("n_words") > 0, 100 * F.col("n_oov") / F.col("n_words")).otherwise(0.0), "perplexity": F.pow(F.lit(2.0), F.col("entropy"))})


def evaluate(tokens: DataFrame, ngrams: DataFrame, line: list[str], order: int, keys: list[str] | None = None, unknown: str | None = None) -> DataFrame:
    """The `totals` of transcripts under a plain model. Ids at the ends of lines don't count."""
    return totals(score(without_ids(tokens, line), ngrams, line, order, unknown=unknown), keys)


def class_tokens(tokens: DataFrame, classes: DataFrame, word: str = "word", of: str | None = None) -> DataFrame:
    """tokens with their word replaced by its class tag and log10_class, the word's share in the class; both words of a
    class and others pass. classes: class, word, log10_p; a word in several classes counts for the first by name.

    of: a column that names the class that a token is meant as, or null. Such a token is scored as its class, and log-zero
    (minus infinity) where the class doesn't have the word."""
    first = classes.groupBy(F.col("word").alias("_cw")).agg(F.min(F.struct("class", "log10_p")).alias("_c"))
    t = tokens.join(first, F.col(word) == F.col("_cw"), "left").drop("_cw")
    tag, share = F.col("_c.class"), F.col("_c.log10_p")
    if of is not None:
        own = classes.groupBy(F.col("class").alias("_cc"), F.col("word").alias("_cw")).agg(F.max("log10_p").alias("_own"))
        t = t.join(own, (F.col(of) == F.col("_cc")) & (F.col(word) == F.col("_cw")), "left").drop("_cc", "_cw")
        tag, share = F.coalesce(F.col(of), tag), F.when(F.col(of).isNotNull(), F.coalesce("_own", F.lit(float("-inf")))).otherwise(share)
    named = t.withColumns({"surface": F.col(word), "log10_class": F.coalesce(share, F.lit(0.0)), "_tag": F.coalesce(tag, F.col(word))})
    return named.withColumn(word, F.col("_tag")).drop("_c", "_own", "_tag")


def interpolate(scores: list[DataFrame], weights: list[float], keys: list[str], column: str = "log10_p") -> DataFrame:
    """By keys, log10 of the weighted mean of the models' probabilities. A model without the word adds nothing; where
    none has it the score is null."""
    if len(scores) != len(weights) or abs(sum(weights) - 1) > 1e-6 or min(weights) < 0:
        raise ValueError("each model needs a weight, and they sum to one")
    ln10 = F.lit(2.302585092994046)
    parts = [s.select(*keys, (F.col(column) * ln10 + F.log(F.lit(float(w)))).alias("_x")) for s, w in zip(scores, weights, strict=True) if w > 0]
    every = reduce(DataFrame.union, parts)
    summed = logmath.log_sum_exp(every, keys, "_x", "_y")
    return every.select(*keys).distinct().join(summed, keys, "left").select(*keys, (F.col("_y") / ln10).alias(column))


def mixed_unigrams(unigrams: DataFrame, weights: dict[str, float], model: str = "model") -> DataFrame:
    """One table (word, log10_p) for any number of unigram models (model, word, log10_p): each word's weighted mean probability
    over the models. A model without the word adds nothing; a model without a weight has none. Scoring a token under
    the mixture is then one join, whatever the number of models."""
    if abs(sum(weights.values()) - 1) > 1e-6 or min(weights.values()) < 0:
        raise ValueError("each model needs a weight, and they sum to one")
    ln10, table = F.lit(2.302585092994046), F.create_map(*[F.lit(x) for m, w in weights.items() if w > 0 for x in (m, float(w))])
    parts = unigrams.where(F.col(model).isin([m for m, w in weights.items() if w > 0]))
    summed = logmath.log_sum_exp(parts.select("word", (F.col("log10_p") * ln10 + F.log(table[F.col(model)])).alias("_x")), ["word"], "_x", "_y")
    return summed.select("word", (F.col("_y") / ln10).alias("log10_p"))


def relative_frequency_model(tokens: DataFrame, line: list[str], least: int = 2, backoff: float = -0.4) -> DataFrame:
    """A stand-in model for data that comes without one: relative frequencies of words and of pairs seen `least`
    times, and one back-off for all contexts. Not normalised; for exercise of the scoring, not a trainer."""
    by = Window.partitionBy(*line).orderBy("pos")
    pairs = tokens.select("word", F.lead("word").over(by).alias("next"))
    uni = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = tokens.agg(F.count(F.lit(1)).alias("_all"))
    one = uni.crossJoin(F.broadcast(total)).select(F.lit(1).alias("ord"), F.array("word").alias("words"), F.log10(F.col("n") / F.col("_all")).alias("log10_p"), F.lit(backoff).alias("log10_bo"))
    two = pairs.where("next is not null").groupBy("word", "next").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).join(uni, "word")
    two = two.select(F.lit(2).alias("ord"), F.array("word", "next").alias("words"), F.log10(F.col("c") / F.col("n")).alias("log10_p"), F.lit(None).cast("double").alias("log10_bo"))
    return one.union(two)
