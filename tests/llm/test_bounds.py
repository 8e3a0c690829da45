"""What keeps work bounded or from being done twice: samples by bytes, one search a block, parts by count; long texts everywhere."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auralake.llm import decontam, langid, linededup, lm, mixing, quality, sharding, simhash, substring
from auralake.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_a_sample_of_bounded_bytes_keeps_every_language(spark):
    r = random.Random(1)
    prose = lambda alphabet, n: " ".join("".join(r.choice(alphabet) for _ in range(5)) for _ in range(n))
    rows = [(i, prose("abcdefg", 50), "en") for i in range(400)] + [(1000, prose("абвгд", 60_000), "ru"), (1001, prose("αβγδ", 50_000), "el"), (1002, prose("αβγδ", 70_000), "el")] + [(2000, prose("xyzw", 200_000), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, train_bytes=48_000)
    assert model.langs == ["el", "en", "ru"]
    got = {x.doc_id: x["_al_lang"].lang_pred for x in langid.identify(docs, model).collect()}
    assert got[1000] == "ru" and got[1001] == got[1002] == "el" and sum(got[i] == "en" for i in range(400)) == 400
    few, many = len(langid.fit(docs.where("lang = 'en'"), train_bytes=3000).keys), len(langid.fit(docs.where("lang = 'en'")).keys)
    assert 0 < few < many / 3


def test_each_block_is_searched_once(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 30)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(4)], "item_id long, text string")
    plans = []
    real = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(self, df, name))[1])
    decontam.contamination(docs, bench).count()
    found = [p for n, p in plans if n.startswith("block")]
    assert len(found) >= 2 and all(p.count("ArrowEvalPython") == 1 for p in found)


def test_parts_grow_with_the_units_of_one_cell(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("s").alias("source"))
    written = {}
    real = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.setdefault(name, real(self, df, name)))
    monkeypatch.setattr(mixing, "PART_UNITS", 100)
    assert mixing.mix(rows).where("taken = 0 and size = 0").count() == 20_000
    sizes = written["parts"].agg(F.count(F.lit(1)).alias("parts"), F.max("_al_n").alias("most")).first()
    assert sizes.parts > 190 and sizes.most < 200


def test_rates_have_the_greatest_entropy(spark):
    """The mix's rates against a plain solver: for each source, min(3, exp(lambda * size / mean)) that meets the target."""
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), r.choice("abcd")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    by = {}
    for x in got:
        by.setdefault(dict((i, s) for i, _, s in rows)[x.doc_id], []).append(x)
    for docs_of in by.values():
        mean, target = sum(x["size"] for x in docs_of) / len(docs_of), docs_of[0].target
        rate = lambda lam, x, m=mean: min(3.0, 2.718281828459045 ** (lam * x["size"] / m))
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(rate(mid, x) * x["size"] for x in docs_of) < target else (low, mid)
        # copies are whole; over documents of near sizes they add up to the rates
        ranked = sorted(docs_of, key=lambda x: x["size"])
        for a in range(0, len(ranked) - 20, 20):
            part = ranked[a : a + 20]
            assert abs(sum(x.copies for x in part) - sum(rate(low, x) for x in part)) <= 2


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 400,000 words, a word of a megabyte, many blank lines, among short ones and repeated rows."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(["the", "er", "on", "in", "re", "st", "ly"]) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(80))
    rows = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 3}") for i in range(20)]
    rows += [(100, passage + " " + " ".join(word() for _ in range(400_000)), "en", "s1"), (101, passage, "en", "s2"), (102, "x" * 1_000_000, None, None), (103, "\n" * 100_000, "en", "s0"), (104, None, None, None), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).repartition(3).cache()


def test_long_texts(spark, long_docs):
    rows, docs = long_docs
    n = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert Counter(r.doc_id for r in sharding.shard_documents(docs, 5).collect()) == Counter(r[0] for r in rows)
    prints = {r.doc_id: r.f for r in simhash.classes(docs).collect()}
    assert prints[100] == simhash.fingerprint(next(t for i, t, *_ in rows if i == 100)) and prints[103] == prints[104] == 0
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped").collect()}
    assert lines[103] == (100_001, 0) and lines[100] == (1, 0)
    bench = spark.createDataFrame([(1, rows[21][1])], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontam.contamination(docs, bench).collect()}
    assert hits[100] >= 80 and hits[101] == 80 and hits[102] == 0
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert judged[100].n_words == n[100] and judged[102].word_chars == 1_000_000 and judged[103].base_failed
    marked = docs.withColumn("held_out", F.lit(False))
    scored = {r.doc_id: r for r in lm.score(marked, lm.fit(docs)).collect()}
    assert scored[100].n_tokens == n[100] + 1 == scored[100].n_known and scored[104].n_tokens == 1 and scored[100].score < scored[101].score < 0
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert kept[100] == (n[100], 0) and kept[101] == (80, 80)
    mixed = {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}
    assert mixed == n
    model = langid.fit(docs)
    assert {r.doc_id: r["_al_lang"].lang_pred for r in langid.identify(docs, model).collect()}[100] == "en"


def test_long_texts_through_the_pipeline(spark, long_docs, tmp_path):
    _, docs = long_docs
    (tmp_path / "b").mkdir()
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/d/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/d/benchmark.parquet")
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        got = Scratch(spark, "t").write(stage(spark, got, f"{tmp_path}/d"), name)
        assert got.count() > 0
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    assert 100 in kept and not kept & {103, 104} and zlib is not None


def test_a_repeated_batch_of_lines(spark, docs, tmp_path):
    """A batch that is added twice counts its documents twice, as any rows with other ids would; within one call rows of
    one id are one document."""
    line = "a line of over twenty characters"
    batch = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(3)], "doc_id long, text string")
    once = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(batch.union(batch)).select("doc_id", "n_dropped").collect()}
    assert once == {0: 1, 1: 1, 2: 0}
