"""The corpus queries over the tables of a folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, common, decontam, langid, linededup, lm, mixing, quality, sharding, simhash, substring, tokencount, tokenfiles, vectorcodes

SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.documents(spark, sf_dir).select("doc_id", "text", "lang"))
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "_al_lang.lang_pred", "_al_lang.score", "_al_lang.n_spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(common.spread(common.documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", simhash.as_hex(F.col("f")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(common.spread(common.documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(common.spread(common.documents(spark, sf_dir).select("doc_id", "text")), bench)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.documents(spark, sf_dir).select("doc_id", "text")).withColumn("held_out", common.id_remainder(F.col("doc_id"), 5) == 1)
    return lm.score(docs, lm.fit(docs.where(~F.col("held_out"))))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(common.spread(common.documents(spark, sf_dir).select("doc_id", "text")), public_tokenizers.path(TOKENIZER))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(common.spread(common.documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir).select("doc_id", "text", "source"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    books, coded = vectorcodes.compress(rows)
    coded = coded.select("vec_id", "label", vectorcodes.code_string(F.col("_al_code.codes"), 4).alias("code"), "_al_code.error")
    out = vectorcodes.with_group_errors(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    folder = common.Scratch(spark, "token_files").path("tokens")
    tokenfiles.write(docs, folder, public_tokenizers.path(TOKENIZER), end_id=END_ID)
    placed = tokenfiles.located(tokenfiles.read(spark, folder, "doc_id long, row long, ids array<int>"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.spread(common.documents(spark, sf_dir).select("doc_id", "text"))
    return alignment.align_corpus(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))[0]


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_language_id, op3_simhash, op4_line_dedup, op5_decontamination, op6_quality_rules, op7_lm_scoring, op8_token_counts, op9_substring_dedup, op10_mixing, op11_vector_codes, op12_token_files, op13_alignment)}


ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, {ASCII_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), keys AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT doc_id, pos, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN keys USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT item_id, n, i AS j, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), found AS (
    SELECT doc_id, i, g.n, array_to_string(list_slice(w, i, i + g.n - 1), ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n) AS g
), hits AS (
    SELECT doc_id, i, n, item_id, j FROM found JOIN windows USING (n, win)
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), diagonals AS (
    SELECT doc_id, i, n, item_id, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j, n ORDER BY i) AS run FROM hits
), matches AS (
    SELECT doc_id, min(i) - 1 AS place, n + count(*) - 1 AS words FROM diagonals GROUP BY doc_id, item_id, diagonal, n, run
), longest AS (
    SELECT doc_id, max(words) AS longest_match, arg_min(place, (-words, place)) AS longest_at FROM matches GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, longest_match, longest_at
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


OP9_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS win
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), first AS (
    SELECT win, min(doc_id) AS least FROM windows GROUP BY win
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM windows JOIN first USING (win) WHERE least < doc_id
), words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY doc_id
), counts AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op9_substring_dedup": OP9_SQL}
