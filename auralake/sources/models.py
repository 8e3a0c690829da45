"""Language models, word classes and model lists as tables, and models as text.

The text form of back-off models is read line by line, so files split: the few section headers are found first and
place every line in its order's section by position."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import trie
from .lines import clean, numbered, read_lines

#: Orders above this aren't models of this kind.
MAX_ORDER = 16


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """(ord, words, log10_p, log10_bo) of one back-off model.

    Probabilities above one become one; a missing back-off is 0, and null for the longest n-grams; lines without the right
    number of fields go, as do n-grams with a word that isn't a unigram. Headers that don't count 1, 2, ... are an error."""
    lines = read_lines(spark, path)
    marks = lines.where(F.col("line").rlike(r"^\\(data|end|\d+-grams:?)") | F.col("line").rlike(r"^ngram \d+\s*=")).orderBy("at").limit(4 * MAX_ORDER).collect()
    sections = [(int(m[1]), r["at"]) for r in marks if (m := re.match(r"\\(\d+)-grams", r["line"]))]
    stated = [int(m[1]) for r in marks if (m := re.match(r"ngram (\d+)\s*=", r["line"]))]
    if not sections or [k for k, _ in sections] != list(range(1, len(sections) + 1)) or stated != list(range(1, len(stated) + 1)):
        raise ValueError(f"{path} isn't a back-off model: its sections are {[k for k, _ in sections]}")
    end = next((r["at"] for r in marks if r["line"].startswith("\\end")), None)
    place = lambda at: F.struct(F.lit(at["block"]).cast("long").alias("block"), F.lit(at["place"]).cast("long").alias("place"))
    order = F.when(F.col("at") >= place(end), 0) if end else F.when(F.lit(False), 0)
    for k, at in reversed(sections):
        order = order.when(F.col("at") > place(at), k)
    longest = sections[-1][0]
    f = F.array_remove(F.split("line", r"[ \t\r]+"), "")
    rows = lines.select(order.alias("ord"), f.alias("f")).where(F.col("ord") > 0)
    n = F.size("f") - F.col("ord")
    rows = rows.where((n == 1) | ((n == 2) & (F.col("ord") < longest))).select("ord", F.slice("f", F.lit(2), F.col("ord")).alias("words"), F.least(F.expr("try_cast(f[0] as double)"), F.lit(0.0)).alias("log10_p"), F.when(F.col("ord") < longest, F.coalesce(F.when(n == 2, F.expr("try_cast(element_at(f, -1) as double)")), F.lit(0.0))).alias("log10_bo"))
    rows = rows.where("log10_p is not null")
    known = rows.where("ord = 1").select(F.col("words")[0].alias("_w")).distinct()
    strange = rows.where("ord > 1").select("words", F.explode("words").alias("_w")).join(known, "_w", "left_anti").select("words").distinct()
    return rows.join(strange, "words", "left_anti").select("ord", "words", "log10_p", "log10_bo")


def rejected(spark: SparkSession, path: str) -> int:
    """How many lines of the sections read_arpa leaves out."""
    inside = read_lines(spark, path).where(F.col("line").rlike(r"^\s*-?[0-9.]+(e[+-]?\d+)?\s+\S")).count()
    return inside - read_arpa(spark, path).count()


def arpa_lines(ngrams: DataFrame) -> DataFrame:
    """(ord, seq, line) whose lines in order are the text form: by last word, then the one before, and so on."""
    orders = [r["ord"] for r in ngrams.select("ord").distinct().orderBy("ord").limit(MAX_ORDER).collect()]
    spark = ngrams.sparkSession
    counts = {r["ord"]: r["n"] for r in ngrams.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).limit(MAX_ORDER).collect()}
    heads = [(0, -3, "\\data\\"), *[(0, k - MAX_ORDER, f"ngram {k}={counts[k]}") for k in orders], *[(k, -1, f"\n\\{k}-grams:") for k in orders], (MAX_ORDER + 1, -1, "\n\\end\\")]
    heads = [(o, s if o else i, x) for i, (o, s, x) in enumerate(heads)]
    number = lambda c: F.format_string("%.4f", c)
    line = F.concat_ws(" ", number(F.col("log10_p")), F.array_join("words", " "), F.when(F.col("log10_bo").isNotNull(), number(F.col("log10_bo"))))
    keyed = ngrams.select("ord", F.reverse("words").alias("k"), line.alias("line"))
    body = keyed.select("ord", "k", "line").unionByName(spark.createDataFrame([(o, [], x) for o, _, x in heads if o], "ord int, k array<string>, line string"))
    top = spark.createDataFrame([(0, [f"{s:04d}"], x) for o, s, x in heads if not o], "ord int, k array<string>, line string")
    return body.unionByName(top)


def write_arpa(ngrams: DataFrame, path: str) -> None:
    """Writes the text form. The parts' names are in order, so their concatenation is the model."""
    arpa_lines(ngrams).orderBy("ord", "k").select("line").write.mode("overwrite").text(path)


def kind_of(path: str) -> str:
    """arpa, dmp, bin or parquet, by name, whatever its compression."""
    stem = re.sub(r"\.(gz|bz2)$", "", path.lower())
    return next((k for k in ("arpa", "dmp", "bin", "parquet") if stem.endswith(f".{k}")), "arpa")


# What packed files begin with, within their first bytes.
PACKED = {b"PAR1": "parquet", b"Trie Language Model": "bin", b"Darpa Trigram LM": "dmp"}


def kind_by_content(spark: SparkSession, path: str) -> str:
    """The kind of a file, or of the first file of a folder, by its first bytes; text where they tell nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.isDirectory(at):
        inside = [f.getPath() for f in files.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        if not inside:
            raise ValueError(f"{path} has no files")
        at = min(inside, key=lambda f: f.getName())
    stream = files.open(at)
    try:
        head = bytes(stream.readNBytes(64))
    finally:
        stream.close()
    return next((kind for mark, kind in PACKED.items() if mark in head), "arpa")


def read_model(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """kind auto goes by the name, and where that says nothing by the contents."""
    if kind == "auto":
        kind = kind_of(path) if re.search(r"\.(arpa|dmp|bin|parquet)(\.(gz|bz2))?$", path.lower()) else kind_by_content(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "bin":
        return trie.read_trie(spark, path)
    if kind == "dmp":
        return trie.read_dump(spark, path)
    return read_arpa(spark, path)


def write_model(ngrams: DataFrame, path: str, kind: str = "auto") -> None:
    """Text, Parquet or a trie file, by the path's name or as kind says."""
    kind = kind_of(path) if kind == "auto" else kind
    if kind == "parquet":
        ngrams.write.mode("overwrite").parquet(path)
    elif kind == "bin":
        trie.write_trie(ngrams, path, ngrams.agg(F.max("ord")).first()[0] or 1)
    elif kind == "dmp":
        raise ValueError("dumps are only read")
    else:
        write_arpa(ngrams, path)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(class, word, weight) of definitions `LMCLASS name`, `word [weight]` lines, `END name`; a weight left out is 1, and
    lines outside a class are ignored."""
    lines = clean(numbered(spark, path)).withColumn("f", F.split("line", r"\s+"))
    by = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("f")[0] == "LMCLASS", F.col("f")[1]).when(F.col("f")[0] == "END", F.lit(""))
    inside = lines.withColumn("class", F.last(mark, ignorenulls=True).over(by)).where(mark.isNull() & (F.coalesce("class", F.lit("")) != ""))
    return inside.select("class", F.col("f")[0].alias("word"), F.coalesce(F.expr("try_cast(get(f, 1) as double)"), F.lit(1.0)).alias("weight"))


@dataclass
class ModelList:
    """What a control file names: class definition files, then models with the classes each uses."""

    class_files: list[str] = field(default_factory=list)
    models: list[tuple[str, str, list[str]]] = field(default_factory=list)


def read_model_list(spark: SparkSession, path: str) -> ModelList:
    """`[{ files }]`, then `file name [{ classes }]`...; relative paths start at the list's folder. A list is a few lines."""
    text = " ".join(r["line"] for r in clean(numbered(spark, path)).orderBy("line_no").select("line").toLocalIterator())
    tokens, out, folder = re.findall(r"[{}]|[^\s{}]+", text), ModelList(), posixpath.dirname(path)
    at = lambda f: f if re.match(r"[a-z0-9]+:|/", f) else posixpath.join(folder, f)

    def block() -> list[str]:
        if tokens[:1] != ["{"]:
            return []
        end = tokens.index("}") if "}" in tokens else len(tokens)
        inside = tokens[1:end]
        del tokens[: end + 1]
        return inside

    out.class_files = [at(f) for f in block()]
    while tokens:
        file, name = tokens[0], tokens[1] if len(tokens) > 1 else ""
        del tokens[:2]
        if not name or "{" in (file, name) or "}" in (file, name):
            raise ValueError(f"{path}: a model needs a file and a name")
        out.models.append((at(file), name, block()))
    return out
