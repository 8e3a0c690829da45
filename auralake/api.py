"""Models and graphs as objects: thin handles on tables, for users who think in models rather than in joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as text_functions
from .functions.logmath import LogMath
from .operators import graph, lm_edit, ngram, numbered
from .sources import graphs, models
from .tables import cut


@dataclass(frozen=True)
class NGramModel:
    """A back-off model: its n-grams, classes (class, word, log10_p) and weights."""

    ngrams: DataFrame
    order: int
    classes: DataFrame | None = None
    unknown: str | None = None
    lw: float = 1.0
    wip: float = 1.0
    math: LogMath = field(default_factory=LogMath)
    store: numbered.Numbered | None = None

    def numbered(self) -> NGramModel:
        """The model with its words and n-grams numbered once, for many scorings: see `operators.numbered`."""
        return replace(self, store=numbered.number(self.ngrams, self.order))

    @classmethod
    def read(cls, spark: SparkSession, path: str, kind: str = "auto") -> NGramModel:
        table = models.read_model(spark, path, kind)
        if not path.rstrip("/").endswith(".parquet"):  # text is parsed once, however many orders are scored
            table = cut(table)
        order = table.agg(F.max("ord")).first()[0] or 1
        closed = table.where((F.col("ord") == 1) & (F.col("words")[0] == lm_edit.UNKNOWN)).limit(1).count()
        return cls(table, order, unknown=lm_edit.UNKNOWN if closed else None)

    def write(self, path: str, kind: str = "auto") -> None:
        models.write_model(self.ngrams, path, kind)

    @classmethod
    def convert(cls, spark: SparkSession, source: str, target: str, source_kind: str = "auto", target_kind: str = "auto", fold: str | None = None) -> NGramModel:
        """Reads a model, folds its case if asked (`lower` or `upper`), and writes it in the other form."""
        if fold not in (None, "lower", "upper"):
            raise ValueError("case folds to lower or upper")
        model = cls.read(spark, source, source_kind)
        model = model if fold is None else model.casefolded(fold == "upper")
        model.write(target, target_kind)
        return model

    def evaluate(self, texts: DataFrame, line: list[str], keys: list[str] | None = None, text: str = "text") -> DataFrame:
        """Totals over lines of text, by keys or over all, with the model's classes and weights: see `operators.ngram.totals`. Ids at the
        ends of lines don't count."""
        tokens = ngram.without_ids(text_functions.tokens(texts, text, line), line)
        return ngram.totals(self.score(tokens, line), keys, self.lw, self.wip, self.math)

    def weighted(self, lw: float, wip: float) -> NGramModel:
        return replace(self, lw=lw, wip=wip)

    def casefolded(self, upper: bool = False) -> NGramModel:
        return replace(self, ngrams=lm_edit.fold_model(self.ngrams, upper), store=None)

    def with_words(self, words: DataFrame) -> NGramModel:
        return replace(self, ngrams=lm_edit.add_words(self.ngrams, words), store=None)

    def with_classes(self, definitions: DataFrame) -> NGramModel:
        """definitions: class, word, weight. A class tag that the model lacks becomes a unigram."""
        shares = lm_edit.normalise_classes(definitions)
        tags = shares.select(F.col("class").alias("word"), F.lit(1.0).alias("weight")).distinct()
        return replace(self, store=None, ngrams=lm_edit.add_words(self.ngrams, tags), classes=shares.select("class", "word", F.log10("weight").alias("log10_p")))

    def counts(self) -> DataFrame:
        return ngram.counts(self.ngrams)

    def score(self, tokens: DataFrame, line: list[str]) -> DataFrame:
        """tokens (line, pos, word) with is_oov, is_unknown, n_hist, n_used, log10_p (of the class, too) and the integer score."""
        named = tokens if self.classes is None else ngram.class_tokens(tokens, self.classes)
        out = numbered.score(named, self.store or numbered.number(self.ngrams, self.order), line, self.order, unknown=self.unknown)
        if self.classes is not None:
            out = out.withColumn("log10_p", F.col("log10_p") + F.col("log10_class"))
        return out.withColumn("score", ngram.weighted(F.col("log10_p"), self.lw, self.wip, self.math))

    def perplexity(self, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """By keys, which name a line each."""
        return ngram.perplexity(self.score(text_functions.tokens(texts, text, keys), keys), keys)


@dataclass(frozen=True)
class NGramModelSet:
    """Models by name, interpolated by weight or one at a time."""

    models: dict[str, NGramModel]
    weights: dict[str, float]

    @classmethod
    def of(cls, named: dict[str, NGramModel], weights: dict[str, float] | None = None) -> NGramModelSet:
        return cls(named, weights or {n: 1 / len(named) for n in named})

    def with_model(self, name: str, model: NGramModel, weight: float) -> NGramModelSet:
        return NGramModelSet(self.models | {name: model}, {n: w * (1 - weight) for n, w in self.weights.items()} | {name: weight})

    def without(self, name: str) -> NGramModelSet:
        rest = 1 - self.weights[name]
        return NGramModelSet({n: m for n, m in self.models.items() if n != name}, {n: w / rest for n, w in self.weights.items() if n != name})

    def select(self, name: str) -> NGramModel:
        return self.models[name]

    def weighted(self, lw: float, wip: float) -> NGramModelSet:
        """The same language weight and insertion penalty for every model."""
        return replace(self, models={n: m.weighted(lw, wip) for n, m in self.models.items()})

    def with_words(self, words: DataFrame) -> NGramModelSet:
        """Every model with these words (word, weight), those that it has already as they are."""
        return replace(self, models={n: m.with_words(words) for n, m in self.models.items()})

    def vocabulary(self) -> DataFrame:
        return lm_edit.union_vocabulary({n: ngram.of_order(m.ngrams, 1).select(F.col("words")[0].alias("word")) for n, m in self.models.items()})

    def score(self, tokens: DataFrame, line: list[str]) -> DataFrame:
        """(line, pos, log10_p) under the mixture."""
        names = list(self.models)
        return ngram.interpolate([self.models[n].score(tokens, line) for n in names], [self.weights[n] for n in names], [*line, "pos"])


@dataclass(frozen=True)
class FsgModel:
    """One or more graphs: their table and their arcs."""

    graphs: DataFrame
    arcs: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> FsgModel:
        return cls(*graphs.read_fsg(spark, path))

    @classmethod
    def of_grammar(cls, spark: SparkSession, path: str, rule: str | None = None, search: list[str] | None = None) -> FsgModel:
        return cls(*graphs.grammar_arcs(spark, graphs.load(spark, path, search), rule))

    def closed(self) -> FsgModel:
        return FsgModel(self.graphs, graph.close_epsilon(self.arcs))

    def with_silence(self, logp: float, word: str = "<sil>", state: int | None = None) -> FsgModel:
        return FsgModel(self.graphs, graph.add_silence(self.arcs, logp, word, state))

    def with_alternative(self, word: str, alternative: str) -> FsgModel:
        return FsgModel(self.graphs, graph.add_alternative(self.arcs, word, alternative))

    def vocabulary(self) -> DataFrame:
        return graph.vocabulary(self.arcs)
