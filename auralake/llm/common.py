"""Helpers shared by the corpus operators: scratch tables, row keys and text expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where it is unset, a local run uses a folder of this
    machine; a cluster has no other folder that is known to be shared, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/auralake/{spark.sparkContext.applicationId}"


class Scratch:
    """Written tables of one operator call. They cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet under this name and returns it as read again."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Removes one table, or all of this call's."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt over all cores where the input comes in too few parts (a small file of one row group) to use them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() * 2 <= cores else docs


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none where it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def _value_print(x: Column, kind: T.DataType, seed: int) -> Column:
    """A hash of one value by its type; never null. Nested values hash with their sizes and the places of their nulls."""
    inner = lambda y, k: _value_print(y, k, seed)
    if isinstance(kind, T.ArrayType):
        h = F.xxhash64(F.lit(seed), F.size(x), F.transform(x, lambda y: inner(y, kind.elementType)))
    elif isinstance(kind, T.StructType):
        h = F.xxhash64(F.lit(seed), *[inner(x.getField(f.name), f.dataType) for f in kind.fields])
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(x), lambda e: F.xxhash64(inner(e["key"], kind.keyType), inner(e["value"], kind.valueType)))
        h = F.xxhash64(F.lit(seed), F.size(x), F.array_sort(pairs))
    elif isinstance(kind, T.VariantType):
        h = F.xxhash64(F.lit(seed), F.to_json(x))
    else:
        h = F.xxhash64(F.lit(seed), x)
    return F.when(x.isNull(), F.lit(seed).cast("long")).otherwise(h)


def row_print(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of all columns of a row, of any type; equal rows have equal prints."""
    return F.xxhash64(F.lit(seed), *[_value_print(F.col(f"`{f.name}`"), f.dataType, seed) for f in df.schema.fields])


def row_key(df: DataFrame) -> Column:
    """128 bits of hash of all columns of a row, which stand for the row in joins."""
    return F.struct(row_print(df, 0).alias("a"), row_print(df, 1).alias("b"))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def few(df: DataFrame, most: int) -> bool:
    """True if df has at most so many rows; the check before a broadcast."""
    return df.limit(most + 1).count() <= most


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind as it takes for no column of df to have it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with over one in so many of the rows is a hot one; there can't be more hot keys than that.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, group_key: str, n: str) -> DataFrame:
    """rows joined with the one row of groups that has their key, null keys among themselves; `n` in groups counts their rows.

    Hot keys, at most HOT_SHARE of them, are broadcast, so that no task gets all rows of one; the others meet in a shuffled
    join. Both tables are read twice, so they should be written ones or cheap."""
    total = groups.agg(F.sum(n).alias("t")).first()["t"] or 0
    hot = F.broadcast(groups.where(F.col(n) * HOT_SHARE > total).limit(HOT_SHARE))
    same = lambda g: F.col(key).eqNullSafe(g[group_key])
    cold = groups.where(F.col(n) * HOT_SHARE <= total)
    met = rows.join(hot, same(hot)).drop(group_key, n)
    rest = rows.join(hot.select(group_key), same(hot), "left_anti")
    return met.unionByName(rest.join(cold, same(cold)).drop(group_key, n))
