"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n, last): the 128-bit hash of a line's key, the number of documents that hold it and the
largest of their ids. Runs are bucketed and sorted by hash, one file for each bucket, and Spark knows it, so a batch meets
them by merge joins that neither deal nor sort the runs anew. Each new batch merge-anti-joins the runs: what is settled there
(in enough documents, with an id no smaller than the batch's) adds nothing and stays out; the rest becomes a run of
level 0. FAN runs of one level merge, bucket by bucket, into one of the next. A manifest lists the runs, so that a later
call or session opens them again and adds its batches, in any order of ids.

Settled keys of the merged runs decide: all their lines go, except in the keeper. Only hashes move for this. The texts move
once, to meet the hashes of their dropped lines.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN = 2
#: Buckets of a run at most; a run has as many as the session has shuffle partitions when the runs are made.
MAX_BUCKETS = 8192
#: The seed under which the second hash reads a key: the hash of the integer 1.
SECOND_SEED = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    key = F.btrim(line, F.lit(common.SPACES))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


class LineRuns:
    """The runs, level by level, under a folder that all executors share. `LineRuns(spark, folder)` opens what is there, or
    starts afresh; documents of different `add` calls must have different ids."""

    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # a bucket of one file counts as sorted

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fan: int = FAN):
        self.spark, self.folder, self.min_docs, self.fan = spark, folder.rstrip("/"), min_docs, fan
        self.levels: list[list[str]] = [[]]
        self.schema, self.version, self.tables = None, 0, {}
        self.buckets = max(1, min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        if (found := self._newest()) is not None:
            self.version, state = found
            self.levels, self.schema, self.buckets, self.min_docs, self.fan = (state[k] for k in ("levels", "schema", "buckets", "min_docs", "fan"))

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, dict] | None:
        path, files = self._path("manifest")
        if not files.exists(path):
            return None
        done = [int(f.getPath().getName()) for f in files.listStatus(path) if files.exists(self._path(f"manifest/{f.getPath().getName()}/_SUCCESS")[0])]
        return (max(done), json.loads(self.spark.read.text(f"{self.folder}/manifest/{max(done)}").first()[0])) if done else None

    def _commit(self, old: list[str]) -> None:
        """Writes a new manifest, and only then removes the runs and the manifest that it replaces."""
        self.version += 1
        state = {"levels": self.levels, "schema": self.schema, "buckets": self.buckets, "min_docs": self.min_docs, "fan": self.fan}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/{self.version}")
        for name in [*old, f"manifest/{self.version - 1}"]:
            if table := self.tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            path, files = self._path(name)
            files.delete(path, True)

    def _table(self, name: str) -> DataFrame:
        """A run as Spark's bucketed and sorted table."""
        if name not in self.tables:
            table = f"al_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({self.schema}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def _write(self, run: DataFrame) -> str:
        name, table = f"run-{uuid.uuid4().hex[:12]}", f"al_{uuid.uuid4().hex}"
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in run.schema.fields)
        run.write.option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(table)
        self.tables[name] = table
        return name

    def _sorted(self, make) -> object:
        """make(), planned and run with bucket files known as sorted."""
        before = self.spark.conf.get(self.ORDERED, "false")
        self.spark.conf.set(self.ORDERED, "true")
        try:
            return make()
        finally:
            self.spark.conf.set(self.ORDERED, before)

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("m"), F.col("last").alias("other"))
        met = a.hint("merge").join(other, (a.h1 == other.g1) & (a.h2 == other.g2), "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return met.select(F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2"), n.alias("n"), F.greatest("last", "other").alias("last"))

    def add(self, keys: DataFrame) -> None:
        """keys: h1, h2 and d, the struct of an id, of one batch."""
        own = keys.groupBy("h1", "h2").agg(F.countDistinct("d").alias("n"), F.max("d").alias("last"))

        def fresh() -> str:
            new = own
            for name in [x for level in self.levels for x in level]:
                done = self._table(name).where(F.col("n") >= self.min_docs).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("last").alias("kept"))
                new = new.join(done.hint("merge"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("last") <= F.col("kept")), "left_anti")
            return self._write(new.repartition(self.buckets, "h1", "h2"))

        self.levels[0].append(self._sorted(fresh))
        old, level = [], 0
        while len(self.levels[level]) >= self.fan:
            merged, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._sorted(lambda names=merged: self._write(reduce(self._merge, [self._table(x) for x in names]))))
            old += merged
            level += 1
        self._commit(old)

    def decided(self, scratch: common.Scratch) -> DataFrame:
        """h1, h2 and last of every key in enough documents, as a written table."""
        def merged() -> DataFrame:
            runs = [self._table(x) for level in self.levels for x in level]
            return scratch.write(reduce(self._merge, runs).where(F.col("n") >= self.min_docs).select("h1", "h2", "last"), "decided")

        return self._sorted(merged)


def text_keys(text: str) -> list[tuple[int, int]]:
    """The hash of each line's key, as the table has them."""
    keys = [x.strip(common.SPACES).encode("utf-8", "surrogatepass").lower() for x in text.split("\n")]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [(signed(xxhash.xxh64_intdigest(k, 42)), signed(xxhash.xxh64_intdigest(k, SECOND_SEED))) for k in keys]


def _without(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    out = []
    for text, keys in zip(texts, gone, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        drop, lines = {(k["h1"], k["h2"]) for k in keys}, text.split("\n")
        kept = [x for x, k in zip(lines, text_keys(text), strict=True) if k not in drop]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["kept", "n"]).astype({"n": "int64"})


def line_keys(docs: DataFrame) -> DataFrame:
    """docs: d (a struct of the id), r (a print of the text) and text. Gives d, r, h1 and h2 of each key of a row, once."""
    keyed = docs.select("d", "r", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= MIN_CHARS).select("d", "r", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= MIN_CHARS).select("d", "r", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, runs: str | None = None) -> DataFrame:
    """id, n_lines, n_dropped and `kept`, the text without its dropped lines.

    runs: a folder of runs of earlier calls, which count and which this call adds to; lines whose keeper came earlier go,
    but earlier documents aren't changed. Without it only these documents count.

    A null or empty text is one empty line. Ids may have any ordered type. Rows of one id count as one document, and rows
    without an id as one that is below all others. Lines of fewer than MIN_CHARS characters have no key. Ties can't occur,
    since a key's largest id is one document. Long texts are split whole; other columns of docs don't matter. An empty table
    gives an empty result."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("d"), F.xxhash64(text).alias("r"), text.alias("text"))
    pairs = scratch.write(line_keys(rows), "pairs")
    kept = LineRuns(spark, runs or scratch.path("runs"))
    for i in range(batches):
        kept.add(pairs.where(F.pmod(F.xxhash64("d"), F.lit(batches)) == i))
    losing = pairs.join(kept.decided(scratch), ["h1", "h2"]).where(F.col("d") < F.col("last"))
    gone = losing.groupBy("d", "r").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))  # as many as a text has lines
    without = F.pandas_udf(_without, "kept string, n long")
    joined = rows.join(gone, ["d", "r"], "left").withColumn("w", without(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return joined.select(F.col("d.id").alias(id_col), n_lines.cast("long").alias("n_lines"), F.col("w.n").alias("n_dropped"), F.coalesce("w.kept", "text").alias("kept"))
