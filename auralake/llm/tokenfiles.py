"""Token-id files: ORC in the order of document ids.

A file holds a run of documents in ascending id (`doc_id`, `row`, `ids`): ids and row numbers are integers under ORC's run-length
encodings, in stripes that are read apart from each other, with row indexes and a Bloom filter on `doc_id` in every stripe, so
a reader that wants some documents skips files, stripes and row groups by their metadata.

`row` is the file's number times 2**33 plus the place in the file, so it ascends over all files; a document's place in the
whole stream of ids comes from the files' totals and running sums within files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, encoding

#: Rows of a file share the bits of `row` above these.
FILE_BITS = 33
#: Bytes of a stripe, and rows of a row group: the least documents that a reader takes, and the fewest that ORC allows.
STRIPE_BYTES, GROUP_ROWS = 8 << 20, 1000


def token_ids(text: Column, path: str, end_id: int | None) -> Column:
    """The ids of a whole text under the tokenizer at path, as the library gives them without special tokens of its own, and
    end_id behind. A null text counts as empty."""

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoding.encoder(path)
        for column in columns:
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            lists = []
            for some in encoding.slices(column):
                flat, n = coder.encode(some)
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(n), np.int32(end_id))
                    n = n + 1
                lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat, pa.int32())))
            yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    return ids(F.coalesce(text, F.lit("")))


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every document to ORC files under folder, in ascending id; null ids come first, and rows of equal
    ids are ordered by a hash of their texts. Texts are dealt out by ranges of (id, hash, row), so copies of one row can
    fill any number of files. Ids of documents may be of any type that sorts; those that ORC has no Bloom filter for get
    row indexes only. An empty table gives a folder that reads as an empty table; a file is replaced as a whole."""
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")).withColumn("at", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("doc_id", "tie", "at").sortWithinPartitions("doc_id", "tie", "at")
    rows = dealt.select("doc_id", F.monotonically_increasing_id().alias("row"), token_ids(F.col("text"), tokenizer, end_id).alias("ids"))
    out = rows.write.mode("overwrite").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", GROUP_ROWS).option("orc.create.index", "true").option("compression", "zstd")
    if rows.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long", "string", "date"):
        out = out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    out.orc(folder)


def read(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """(doc_id, row, ids) of the files under folder. Conditions on `doc_id` reach the files' metadata."""
    return (spark.read.schema(schema) if schema else spark.read).orc(folder)


def checksum(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = memoryview(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        ends = 4 * np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())

    return crc(ids)


def located(files: DataFrame) -> DataFrame:
    """The table that `read` gives, with `n_tokens`, `ids_crc32` and `start`, the number of ids of all documents before, in place of the
    ids. Running sums stay within a file; over files there is one row for each."""
    rows = files.select("doc_id", "row", F.size("ids").cast("long").alias("n_tokens"), checksum(F.col("ids")).alias("ids_crc32"))
    rows = rows.withColumn("file", F.shiftright("row", FILE_BITS))
    totals = files.groupBy(F.shiftright("row", FILE_BITS).alias("file")).agg(F.sum(F.size("ids").cast("long")).alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(bases, "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "row")


def tokens_between(files: DataFrame, placed: DataFrame, start: int, end: int) -> DataFrame:
    """The ids at places start to end of the whole stream, as one row a document (`start`, `ids`): what a trainer reads as
    one block. `placed` is what `located` gives; only the files' rows that are met are read again by their range of ids."""
    met = placed.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start)).select("row", "start")
    ends = met.agg(F.min("row").alias("a"), F.max("row").alias("b")).first()
    rows = files.where(F.col("row").between(ends["a"], ends["b"])) if ends["a"] is not None else files.where(F.lit(False))
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    size = F.least(F.lit(end) - F.col("start"), F.size("ids")) - first
    return rows.join(met, "row").select((F.col("start") + first).alias("start"), F.slice("ids", (first + 1).cast("int"), size.cast("int")).alias("ids"))
