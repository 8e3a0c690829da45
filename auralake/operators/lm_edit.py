"""Editing models: vocabularies, classes, model sets and suffix closure, as joins and unions of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, ascii_upper
from ..tables import cut

UNKNOWN = "<UNK>"


def normalise_classes(classes: DataFrame) -> DataFrame:
    """classes (class, word, weight): weight becomes its share where the class's sum is outside 0.9 .. 1.1. The sums are
    aggregated first, so a large class is one row when it joins back."""
    sums = classes.groupBy(F.col("class").alias("_c")).agg(F.sum("weight").alias("_sum"))
    off = (F.col("_sum") < 0.9) | (F.col("_sum") > 1.1)
    return classes.join(sums, F.col("class") == F.col("_c")).withColumn("weight", F.when(off, F.col("weight") / F.col("_sum")).otherwise(F.col("weight"))).select(*classes.columns)


def add_class_word(classes: DataFrame, name: str, word: str, weight: float) -> DataFrame:
    """A new word of a class: its share is weight over the words there are with it; the others shrink by that."""
    n = classes.where(F.col("class") == name).agg((F.count(F.lit(1)) + 1).alias("_n"))
    p = F.lit(weight) / F.col("_n")
    old = classes.crossJoin(F.broadcast(n)).withColumn("weight", F.when(F.col("class") == name, F.col("weight") * (1 - p)).otherwise(F.col("weight"))).select("class", "word", "weight")
    return old.union(n.select(F.lit(name), F.lit(word), p))


def add_words(ngrams: DataFrame, words: DataFrame) -> DataFrame:
    """Unigrams for new words (word, weight): weight over the number of unigrams with it, no back-off. Words that the
    model has stay as they are; nothing is renormalised."""
    known = ngrams.where("ord = 1").select(F.col("words")[0].alias("_w"))
    n = known.agg(F.count(F.lit(1)).alias("_n"))
    new = words.join(known, F.col("word") == F.col("_w"), "left_anti").crossJoin(F.broadcast(n))
    return ngrams.unionByName(new.select(F.lit(1).alias("ord"), F.array("word").alias("words"), F.log10(F.col("weight") / (F.col("_n") + 1)).alias("log10_p"), F.lit(0.0).alias("log10_bo")))


def _folded(word: Column, upper: bool) -> Column:
    return F.when(word.rlike(r"^[<\[]"), word).otherwise(ascii_upper(word) if upper else ascii_lower(word))


def fold_vocabulary(vocab: DataFrame, upper: bool = False) -> DataFrame:
    """vocab (wid, word) with ASCII case folded; words that begin with < or [ stay. Of words that meet, the one of the
    least id stays."""
    return vocab.groupBy(_folded(F.col("word"), upper).alias("word")).agg(F.min("wid").alias("wid")).select("wid", "word")


def fold_model(ngrams: DataFrame, upper: bool = False) -> DataFrame:
    """Every word of the n-grams folded; of n-grams that meet, the first by their words stays."""
    folded = ngrams.withColumn("_f", F.transform("words", lambda w: _folded(w, upper)))
    best = folded.groupBy("ord", "_f").agg(F.min(F.struct("words", "log10_p", "log10_bo")).alias("_b"))
    return best.select("ord", F.col("_f").alias("words"), "_b.log10_p", "_b.log10_bo")


def union_vocabulary(models: dict[str, DataFrame]) -> DataFrame:
    """(word, model, own): each word of any model with its word in each model, that model's unknown word where it has
    no other, or null."""
    named = reduce(DataFrame.union, [v.select("word", F.lit(m).alias("model")) for m, v in models.items()]).distinct()
    words = named.select("word").distinct()
    names = words.select("word", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    unknown = named.where(F.col("word") == UNKNOWN).select(F.col("model").alias("_m"), F.lit(UNKNOWN).alias("_u"))
    own = names.join(named.withColumn("own", F.col("word")), ["word", "model"], "left")
    return own.join(F.broadcast(unknown), F.col("model") == F.col("_m"), "left").select("word", "model", F.coalesce("own", "_u").alias("own"))


def vocabularies(words: DataFrame, models: list[str], model: str = "model") -> DataFrame:
    """One row for each word of words (model, word), with a 0/1 column for each model that tells whether it has the word, or
    stands its unknown word in for it: `union_vocabulary` turned sideways, from one pass over the words."""
    has = [F.max(F.when(F.col(model) == m, 1).otherwise(0)).alias(m) for m in models]
    rows = words.where(F.col(model).isin(models)).groupBy("word").agg(*has)
    unknown = rows.where(F.col("word") == UNKNOWN).select(*[F.col(m).alias(f"_{i}") for i, m in enumerate(models)])
    either = [F.greatest(F.col(m), F.coalesce(F.col(f"_{i}"), F.lit(0))).alias(m) for i, m in enumerate(models)]
    return rows.join(F.broadcast(unknown.limit(1)), F.lit(True), "left").select("word", *either)


def numbered_vocabulary(words: DataFrame) -> DataFrame:
    """(wid, word) with the unknown word first, then by byte order. The numbers come from a sort by range and the sizes
    of its parts, not from one task."""
    parts = cut(words.select("word").distinct().repartitionByRange(F.col("word") != UNKNOWN, "word").withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p").orderBy(F.col("word") != UNKNOWN, "word")
    return parts.withColumn("_r", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_p").select((F.col("_start") + F.col("_r")).alias("wid"), "word")


def remap_vocabulary(mapped: DataFrame, words: DataFrame, most: int = 1000) -> DataFrame:
    """The rows of a union vocabulary for just the given words; those that no model has get nulls. A set has a few models,
    whose names go into the plan; more than `most` are an error."""
    names = [r["model"] for r in mapped.select("model").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} models in a set")
    each = words.select("word").distinct().select("word", F.explode(F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")).alias("model"))
    return each.join(mapped, ["word", "model"], "left")


def add_model(weights: DataFrame, model: str, weight: float) -> DataFrame:
    """weights (model, weight) with a new model; the others shrink to make room."""
    return weights.select("model", (F.col("weight") * (1 - weight)).alias("weight")).union(weights.sparkSession.createDataFrame([(model, weight)], "model string, weight double"))


def remove_model(weights: DataFrame, model: str) -> DataFrame:
    """weights without a model; the others grow to sum to what all did."""
    gone = weights.where(F.col("model") == model).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_g"))
    rest = weights.where(F.col("model") != model).crossJoin(F.broadcast(gone))
    return rest.select("model", (F.col("weight") / (1 - F.col("_g"))).alias("weight"))


def close_suffixes(ngrams: DataFrame, order: int) -> DataFrame:
    """ngrams with `is_blank`: for each n-gram whose own suffix is missing, that suffix, with the probability of the next
    shorter one plus the unigram back-off of the word in front, and no back-off. Orders fill from the longest down, so
    blanks get their suffixes too; probabilities then come from the shortest up. Words may be numbers: joins and shuffles
    carry them as columns, and only blanks are joined for their probabilities."""
    at = lambda a, b: [f"_w{i}" for i in range(a, b)]
    split = lambda k: [F.col("words")[i].alias(f"_w{i}") for i in range(k)]
    own = {k: ngrams.where(F.col("ord") == k).select(*split(k), "log10_p", "log10_bo") for k in range(1, order + 1)}
    blank: dict[int, DataFrame] = {}
    for k in range(order, 2, -1):
        longer = own[k].select(*at(1, k))
        longer = longer.union(blank[k].select(*at(1, k))) if k in blank else longer
        needed = longer.toDF(*at(0, k - 1)).distinct()
        missing = needed.join(own[k - 1].select(*at(0, k - 1)), at(0, k - 1), "left_anti")
        blank[k - 1] = cut(missing) if k > 3 else missing
    backs = own[1].select("_w0", F.coalesce("log10_bo", F.lit(0.0)).alias("_bo"))
    shorter = own[1].select("_w0", "log10_p")
    closed: dict[int, DataFrame] = {}
    for k in range(2, order):
        met = blank[k].join(shorter.toDF(*at(1, k), "_sp"), at(1, k), "left").join(backs, "_w0", "left")
        found = met.select(*at(0, k), (F.col("_sp") + F.coalesce("_bo", F.lit(0.0))).alias("log10_p"))
        closed[k] = cut(found) if k < order - 1 else found
        shorter = own[k].select(*at(0, k), "log10_p").union(closed[k])
    words = lambda k: [F.lit(k).alias("ord"), F.array(*at(0, k)).alias("words"), "log10_p"]
    parts = [df.select(*words(k), "log10_bo", F.lit(False).alias("is_blank")) for k, df in own.items()]
    parts += [df.select(*words(k), F.lit(0.0).alias("log10_bo"), F.lit(True).alias("is_blank")) for k, df in closed.items()]
    return reduce(DataFrame.unionByName, parts)
