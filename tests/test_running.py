"""Estimates that run over utterances, places in order, and numbered models, each against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import ARPA, brute_score, table

from auralake import api
from auralake.functions import text
from auralake.operators import activity, dynamic, graph, ngram, numbered, order, running
from auralake.plans import queries
from auralake.sources import models
from auralake.streaming import live


@pytest.fixture(scope="module")
def streams(spark):
    r = random.Random(2)
    rows = []
    for s in ("a", "b", None):
        for u in range(20):
            for f in range(r.randint(0, 150)):
                rows.append((s, u, f, [r.gauss(1, 2), r.gauss(0, 1)]))
    frames = spark.createDataFrame(rows, "stream_id string, utt_seq int, frame_no int, c array<double>")
    last = frames.groupBy("stream_id", "utt_seq").agg(F.max("frame_no").alias("m")).select(F.col("stream_id").alias("s"), F.col("utt_seq").alias("u"), "m")
    met = frames.join(last, frames.stream_id.eqNullSafe(last.s) & (frames.utt_seq == last.u))
    return met.withColumn("last", F.col("frame_no") == F.col("m")).drop("s", "u", "m").cache()


@pytest.mark.parametrize("gain", [None, 5.0])
def test_two_levels_are_the_live_machines(streams, gain):
    want = {(r.stream_id, r.utt_seq, r.frame_no): r.c for r in live.over_batch(streams, lambda: live.Normaliser([0.5, 0.0], gain)).collect()}
    got = running.normalise(streams, "stream_id", "utt_seq", [0.5, 0.0], gain).collect()
    assert len(got) == len(want) > 2000
    for r in got:
        assert r.c == pytest.approx(want[r.stream_id, r.utt_seq, r.frame_no])


def test_the_recurrence_sees_one_row_an_utterance(streams):
    plan = running.mean_norm(streams, "stream_id", "utt_seq", [0.0, 0.0])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Window" not in plan


def test_an_utterance_without_voiced_frames(spark):
    frames = spark.createDataFrame([(1, 0, 0, [-1.0, 3.0]), (1, 1, 0, [1.0, 1.0]), (1, 2, 0, [1.0, 1.0])], "stream_id int, utt_seq int, frame_no int, c array<double>")
    got = {r.utt_seq: r.c for r in running.mean_norm(frames, "stream_id", "utt_seq", [0.0, 0.0]).collect()}
    assert got[0] == [-1.0, 3.0] and got[1] == [1.0, 1.0] and got[2] == pytest.approx([1 - 1 / 501, 1 - 1 / 501])
    assert running.normalise(frames.limit(0), "stream_id", "utt_seq", [0.0, 0.0], 5.0).count() == 0


def test_places_of_a_hot_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 3000 == 0, None).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 20_000).alias("o"))
    got = order.place(rows, ["g"], ["o"], "p").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("a"), F.max("p").alias("b"), F.countDistinct("p").alias("d"), F.sort_array(F.collect_list(F.struct("p", "o"))).alias("l")).collect()
    assert len(got) == rows.select("g").distinct().count()
    for r in got:
        assert (r.a, r.b, r.d) == (0, r.n - 1, r.n) and [x.o for x in r.l] == sorted(x.o for x in r.l)
    assert order.place(rows.limit(0), ["g"], ["o"], "p").count() == 0


@pytest.mark.parametrize("kind", [*dynamic.TYPES, "6,7:2"])
def test_features_in_blocks(spark, kind):
    r = random.Random(4)
    frames = spark.createDataFrame([(u, f, [r.random() for _ in range(13)]) for u, n in ((0, 23), (1, 1), (2, 8)) for f in range(n)], "u int, frame_no int, c array<double>")
    of = lambda df: {(x.u, x.frame_no): x.feat for x in df.collect()}
    assert of(dynamic.features(frames, kind, ["u"], block=5)) == of(dynamic.features(frames, kind, ["u"]))
    if dynamic.reach(kind):
        with pytest.raises(ValueError, match="shorter"):
            dynamic.features(frames, kind, ["u"], block=1)


@pytest.mark.parametrize("noise", [True, False])
@pytest.mark.parametrize("silence", [True, False])
def test_live_activity_by_flags(spark, noise, silence):
    r = np.random.RandomState(3)
    rows = [("s", 0, i, (r.rand(6) * (1e6 if 30 <= i < 90 else 10) + 1).tolist(), i == 179) for i in range(180)] + [("s", 1, i, (r.rand(6) * 1e6).tolist(), i == 4) for i in range(5)]
    frames = spark.createDataFrame(rows, "stream_id string, utt_seq int, frame_no int, c array<double>, last boolean")
    batch = activity.track(frames.withColumnRenamed("c", "mel"), remove_noise=noise, remove_silence=silence).where("emitted").collect()
    alive = live.over_batch(frames, lambda: live.Activity(remove_noise=noise, remove_silence=silence)).collect()
    want = {(x.utt_seq, x.frame_no): x.mel for x in batch}
    got = {(x.utt_seq, x.frame_no): x.c for x in alive}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert silence or len(got) == 185


@pytest.fixture(scope="module")
def arpa(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("m") / "m.arpa"
    path.write_text(ARPA)
    return models.read_arpa(spark, str(path))


def test_numbered_scores(spark, arpa, tmp_path):
    grams = table(arpa)
    lines = ["<s> a b c a b c", "b c zzz a b", "a a a c b", "zzz", "<s> zzz b c (utt1)", "c (x) (u)"]
    tokens = text.tokens(spark.createDataFrame(list(enumerate(lines)), "line int, text string"), keys=["line"])
    model = numbered.number(arpa, 3, f"{tmp_path}/m")
    assert table(model.ngrams()) == grams
    for m in (model, numbered.read(spark, f"{tmp_path}/m", 3)):
        for unknown in (None, "<UNK>", "nowhere"):
            got = {(r.line, r.pos): r for r in numbered.score(tokens, m, ["line"], unknown=unknown).collect()}
            plain = {(r.line, r.pos): r for r in ngram.score(tokens, arpa, ["line"], 3, unknown=unknown).collect()}
            for i, line in enumerate(lines):
                for k, p in enumerate(brute_score(grams, line.split(), unknown if unknown != "nowhere" else None)):
                    r = got[i, k]
                    assert (r.log10_p is None) == (p is None) and (p is None or r.log10_p == pytest.approx(p))
                    assert (r.is_oov, r.n_hist, r.n_used) == (plain[i, k].is_oov, plain[i, k].n_hist, plain[i, k].n_used)
                    assert r.is_unknown == ((line.split()[k],) not in grams or line.split()[k] == unknown)
    assert {r.word for r in numbered.words_of(model.orders[2].select("wid"), model).collect()} <= {g[0] for g in grams if len(g) == 1}


def test_contexts_that_a_model_lacks(spark):
    rows = [(1, [w], -1.0, -0.1) for w in "abc"] + [(3, ["a", "b", "c"], -0.2, None), (3, ["a", "zz", "c"], -0.3, None)]
    grams = spark.createDataFrame(rows, "ord int, words array<string>, log10_p double, log10_bo double")
    model = numbered.number(grams, 3)
    tokens = text.tokens(spark.createDataFrame([(0, "a b c"), (1, "b c")], "line int, text string"), keys=["line"])
    got = {(r.line, r.pos): (r.log10_p, r.n_used) for r in numbered.score(tokens, model, ["line"]).collect()}
    assert got[0, 2] == (-0.2, 3) and got[0, 1] == (pytest.approx(-1.1), 1) and got[1, 1] == (pytest.approx(-1.1), 1)
    assert model.ngrams().where("ord = 2").count() == 0 and model.ngrams().where("ord = 3").count() == 1


def test_models_of_texts(spark):
    docs = spark.createDataFrame([("a b a b",), ("b a b",), (None,), ("",), ("c",)], "text string")
    model = numbered.of_texts(docs)
    want = ngram.relative_frequency_model(text.tokens(docs.withColumn("d", F.monotonically_increasing_id()), keys=["d"]), ["d"])
    assert table(model.ngrams()) == table(want) and numbered.of_texts(docs.limit(0)).ngrams().count() == 0


def test_runs_are_counted_in_slices(spark, monkeypatch):
    """Against plain Python, over slices of any size; the words of a long text never become rows of their own."""
    from collections import Counter

    from auralake.operators import runs

    texts = ["a b a b a\tb", None, "", "  é\n\rb  a b a ", "c", "x\x0by z"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    lists = [[w for w in (t or "").translate({9: 32, 10: 32, 13: 32}).split(" ") if w] for t in texts]
    for least in (1, 1 << 20):
        monkeypatch.setattr(runs, "SLICE_BYTES", least)
        assert {r.word: r.n for r in runs.words(docs, "text").collect()} == Counter(w for ws in lists for w in ws)
        number = {r.word: r.h for r in runs.words(docs, "text").select("word", numbered.hashed(F.col("word"), 0).alias("h")).collect()}
        for size in (2, 3):
            want = Counter(tuple(number[w] for w in ws[i : i + size]) for ws in lists for i in range(len(ws) - size + 1))
            assert {tuple(r)[:size]: r.n for r in runs.counted(docs, "text", size, "").collect()} == want


def test_words_whose_hashes_meet_get_another_salt(spark, monkeypatch):
    plain = numbered.hashed
    monkeypatch.setattr(numbered, "hashed", lambda word, salt: plain(word, salt) if salt else F.lit(7).cast("long"))
    model = numbered.of_texts(spark.createDataFrame([("a b a b",)], "text string"))
    assert model.salt == 1 and {tuple(r.words) for r in model.ngrams().where("ord = 2").collect()} == {("a", "b")}


def test_models_of_the_texts_that_are_asked(spark, monkeypatch):
    """Scores are those of the whole model, though words and pairs that no scored text has don't leave the tasks; also with a set
    of few bits, over slices of any size, and after hashes have met."""
    from auralake.operators import runs

    r = random.Random(5)
    some = lambda words, n: [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(n)]
    near, far = [f"w{i}" for i in range(12)] + ["é", "<s>"], [f"x{i}" for i in range(3000)]
    docs = spark.createDataFrame([(t,) for t in [*some(near, 60), *some(far, 3000), *some(near + far, 200), None, ""]], "text string").repartition(3)
    turns = spark.createDataFrame(list(enumerate([*some([*near, "nowhere"], 40), None, "", " w1\tw2\nw1 w2 "])), "line int, text string").repartition(3)
    tokens = text.tokens(turns, keys=["line"])
    rows = lambda m: sorted(map(tuple, numbered.score(tokens, m, ["line"]).collect()), key=str)
    plain, whole = numbered.hashed, numbered.of_texts(docs)
    want = rows(whole)
    assert whole.words.count() > 2000 and {x[6] for x in want} == {None, 1, 2}
    for slice_bytes, bits, salt in ((1 << 20, 28, 0), (50, 15, 0), (1 << 20, 15, 1)):
        with monkeypatch.context() as m:
            m.setattr(runs, "SLICE_BYTES", slice_bytes)
            m.setattr(runs, "LEAST_BITS", 15)
            m.setattr(runs, "MOST_BITS", bits)
            if salt:
                m.setattr(numbered, "hashed", lambda word, salt: plain(word, salt) if salt else F.lit(7).cast("long"))
            model = numbered.of_texts(docs, asked=turns)
            assert rows(model) == want and model.salt == salt
            assert model.words.count() < 100 and model.orders[2].count() <= whole.orders[2].count()
    assert rows(numbered.of_texts(docs, asked=turns, order=1)) == rows(numbered.of_texts(docs, order=1))
    few, full = runs.asked(turns, "text", ""), spark.sparkContext.broadcast(~np.zeros(runs.PAGE, np.uint8))
    assert sorted(map(str, runs.together(docs, "text", 2, "", full).collect())) == sorted(map(str, runs.together(docs, "text", 2, "").collect()))
    out = {(x.ord, x.word or (x["_w0"], x["_w1"])): x.n for x in runs.together(docs, "text", 2, "", few).collect()}
    every = {(x.ord, x.word or (x["_w0"], x["_w1"])): x.n for x in runs.together(docs, "text", 2, "").collect()}
    assert out.items() <= every.items() and len(out) < len(every) / 10  # fewer, with whole counts
    assert {w: n for (k, w), n in every.items() if k == 2} == {(x["_w0"], x["_w1"]): x.n for x in runs.counted(docs, "text", 2, "").collect()}
    held = np.zeros(1 << 25, np.uint8)  # the most bits: every bit of a full set is found, none of an empty one
    keys = np.array([0, 1 << 63, (1 << 64) - 1], np.uint64)
    assert not runs._held(held, keys).any() and runs._held(~held, keys).all()


def test_texts_are_scored_without_a_window(spark, monkeypatch):
    """As tokens are under the whole model, whether a task can hold all its counts, some, or none."""
    from auralake.operators import runs

    r = random.Random(6)
    some = lambda words, n: [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(n)]
    near = [f"w{i}" for i in range(9)] + ["é", "<s>"]
    docs = spark.createDataFrame([(t,) for t in [*some([*near, *(f"x{i}" for i in range(90))], 400), *some(near, 30), None, ""]], "text string").repartition(2)
    turns = spark.createDataFrame([*enumerate([*some([*near, "nowhere", "gone"], 60), None, "", " w1\tw2\nw1 w2 "]), (None, "w1 w1 gone w1")], "line int, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(numbered.score(text.tokens(turns, keys=["line"]), numbered.of_texts(docs), ["line"]))
    assert {x[5] for x in want} == {0, 1} and {x[6] for x in want} == {None, 1, 2}
    with monkeypatch.context() as m:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
        for held in (64 << 20, 2000, 0):
            m.setattr(runs, "SUMS", held)
            scored = numbered.score_texts(turns, numbered.of_texts(docs, asked=turns), ["line"])
            assert rows(scored) == want
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in scored._jdf.queryExecution().executedPlan().toString()


def test_hashes_tell_unknown_words_of_texts_apart(spark, monkeypatch):
    plain = numbered.hashed
    monkeypatch.setattr(numbered, "hashed", lambda word, salt: plain(word, salt) if salt else F.lit(7).cast("long"))
    turns = spark.createDataFrame([(1, "a b")], "line int, text string")
    model = numbered.of_texts(spark.createDataFrame([("a c",)], "text string"), asked=turns)
    assert model.salt == 1 and {x.word: x.is_oov for x in numbered.score_texts(turns, model, ["line"]).collect()} == {"a": False, "b": True}


def test_weighted_scores_move_hashes_only(spark, tmp_path):
    """No window, and no join on words: tokens are looked up by whole numbers."""
    folder = _folder(spark, tmp_path, [(1, 0, "user", "a b z9 w3 b the"), (1, 1, "user", "b a zz a"), (None, 0, "user", None)])
    plan = queries.QUERIES["lm_weighted_score"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(word" not in plan and "SortMergeJoin" not in plan


def _asking(monkeypatch, name, spark, folder):
    """The rows of a query and the model that it built."""
    made, plain = [], numbered.of_texts
    with monkeypatch.context() as m:
        m.setattr(numbered, "of_texts", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
        rows = sorted(map(tuple, queries.QUERIES[name](spark, folder).collect()), key=str)
    return rows, made[0]


def _folder(spark, tmp_path, turns):
    spark.createDataFrame([(i, f"w{i} w{i} z{i} a b a b the b") for i in range(50)] * 2, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["lm_nused_hist", "lm_class_score", "lm_weighted_score"])
def test_queries_count_the_pairs_that_turns_ask_for(spark, monkeypatch, tmp_path, name):
    folder = _folder(spark, tmp_path, [(1, 0, "user", "a b z9 w3 b the"), (1, 1, "user", "b a zz a"), (None, 0, "user", None)])
    rows, model = _asking(monkeypatch, name, spark, folder)
    assert model.orders[2].count() < 10 and model.words.count() < 20  # 204 and 103 in the whole model
    with monkeypatch.context() as m:
        m.setattr(queries, "_asked", lambda *_: None)
        assert _asking(monkeypatch, name, spark, folder)[0] == rows


def test_turns_of_one_key_ask_for_the_whole_model(spark, tmp_path):
    """Their words are scored as one line, so that pairs may have a word of each."""
    once, twice = [(1, 0, "user", "a"), (None, 0, "user", "b")], [(None, 0, "user", "a"), (None, 0, "user", "b")]
    assert queries._asked(spark, _folder(spark, tmp_path / "once", once)) is not None
    assert queries._asked(spark, _folder(spark, tmp_path / "twice", twice)) is None


def test_shuffled_bytes_of_scores(spark):
    """Joins and windows carry numbers where the plain form carries joined words."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    tokens = spark.range(10).select(F.col("id").alias("line"), F.lit(0).alias("pos"), F.lit("a").alias("word"))
    model = numbered.of_texts(spark.createDataFrame([("a b a b",)], "text string"))
    text_plan = plan(numbered.score(tokens, model, ["line"]))
    assert "concat" not in text_plan and "words#" not in text_plan.split("ReadSchema")[0]


def test_evaluation_with_classes_and_weights(spark, tmp_path):
    (tmp_path / "m.arpa").write_text(ARPA)
    m = api.NGramModel.read(spark, str(tmp_path / "m.arpa"))
    m = api.replace(m, unknown=None)
    names = spark.createDataFrame([("[NAME]", "bob", 0.5), ("[NAME]", "eve", 0.5)], "class string, word string, weight double")
    turns = spark.createDataFrame([(1, "a bob c (utt)"), (2, "<s> a b c"), (3, "zzz eve"), (4, None)], "line int, text string")
    for model in (m.with_classes(names), m.with_classes(names).weighted(9.5, 0.7), m.weighted(2.0, 0.5), m.with_classes(names).weighted(9.5, 0.7).numbered()):
        whole, by = model.evaluate(turns, ["line"]).first(), {r.line: r for r in model.evaluate(turns, ["line"], ["line"]).collect()}
        tokens = ngram.without_ids(text.tokens(turns, keys=["line"]), ["line"])
        rows = model.score(tokens, ["line"]).collect()
        hit = [r for r in rows if r.word != "<s>" and not r.is_oov]
        assert (whole.n_words, whole.n_cues, whole.n_oov) == (9, 1, len(rows) - len(hit) - 1) and set(by) == {1, 2, 3}
        assert whole.score == sum(r.score for r in hit) == sum(r.score for r in by.values()) and whole.log10_p == pytest.approx(sum(r.log10_p for r in hit))
        bits = -sum(model.lw * r.log10_p + math.log10(model.wip) for r in hit) / math.log10(2) / len(hit)
        assert whole.entropy == pytest.approx(bits) and whole.perplexity == pytest.approx(2**bits)
        assert by[1].n_oov == (0 if model.classes is not None else 1)
    closed = api.replace(m, unknown="<UNK>").evaluate(turns, ["line"]).first()
    assert closed.n_oov == 3  # bob, zzz and eve have a word that stands for them, and aren't scored


def test_tokens_meant_as_a_class(spark):
    classes = spark.createDataFrame([("N", "bob", -0.3), ("M", "bob", -0.6), ("N", "eve", -0.9)], "class string, word string, log10_p double")
    tokens = spark.createDataFrame([(0, "bob", None), (1, "bob", "N"), (2, "eve", "M"), (3, "x", None), (4, "eve", None)], "pos int, word string, as string")
    got = {r.pos: (r.word, r.surface, r.log10_class) for r in ngram.class_tokens(tokens, classes, of="as").collect()}
    assert got == {0: ("M", "bob", -0.6), 1: ("N", "bob", -0.3), 2: ("M", "eve", -math.inf), 3: ("x", "x", 0.0), 4: ("N", "eve", -0.9)}


def test_closure_joins_only_what_changed(spark):
    n = 40
    arcs = spark.createDataFrame([("g", i, i + 1, -1.0, None) for i in range(n)] + [("g", 3, 1, -0.5, None)], "fsg string, from_state int, to_state int, logp double, word string")
    changed: list[int] = []
    got = {(r.from_state, r.to_state): r.logp for r in graph.close_epsilon(arcs, seen=changed).collect()}
    best = {(r.from_state, r.to_state): r.logp for r in arcs.collect()}
    for k in range(n + 1):
        for i in range(n + 1):
            for j in range(n + 1):
                if i != j and (i, k) in best and (k, j) in best:
                    best[i, j] = max(best.get((i, j), -1e9), best[i, k] + best[k, j])
    assert got == pytest.approx(best)
    assert changed[0] == n + 1 and changed[-1] == 0 and len(changed) <= 9 and sum(changed) <= 1.2 * len(best)


@pytest.fixture(scope="module")
def speech(spark):
    r = np.random.RandomState(8)
    rows = []
    for s, lengths in (("a", (300, 5, 90)), ("b", (140,)), (None, (61, 61)), ("c", (1,))):
        for u, n in enumerate(lengths):
            loud = np.zeros(n, dtype=bool)
            for at in range(15, n, 110):
                loud[at : at + r.randint(12, 60)] = True
            rows += [(s, u if u != 2 else None, i, (r.rand(5) * (1e6 if loud[i] else 10) + 1).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "stream_id string, utt_seq int, frame_no int, mel array<double>").cache()


def by_frame(tracked):
    return {(r.stream_id, r.utt_seq, r.frame_no): (r.mel, r.speech, r.emitted) for r in tracked.collect()}


@pytest.mark.parametrize("chunk, flags", [(7, (True, True)), (50, (True, True)), (1000, (True, True)), (33, (False, True)), (33, (True, False))])
def test_chunks_are_the_whole(spark, speech, chunk, flags):
    whole = by_frame(activity.track(speech, remove_noise=flags[0], remove_silence=flags[1]))
    tracked = activity.track_in_chunks(speech, remove_noise=flags[0], remove_silence=flags[1], chunk=chunk)
    got = by_frame(tracked)
    assert got.keys() == whole.keys() and tracked.count() == len(whole) and any(x[2] for x in whole.values())
    for k, (mel, speaks, emitted) in whole.items():
        assert got[k][1:] == (speaks, emitted) and got[k][0] == pytest.approx(mel, rel=1e-12)
    if flags[1]:
        segs = activity.segments(tracked).collect()
        assert sum(r.n_frames for r in segs) == sum(x[2] for x in whole.values())
        for r in segs:
            assert r.start_frame <= r.opened < r.start_frame + r.n_frames and r.opened - r.start_frame <= activity.PRE_SPEECH
    assert activity.track_in_chunks(speech.limit(0)).count() == 0


def test_a_stopped_run_goes_on_at_its_chunk(spark, speech, tmp_path, monkeypatch):
    folder, real = f"{tmp_path}/f", activity._chunk_step

    def failing(*args):
        step = real(*args)

        def run(key, frames, state):
            if len(state) and key[0] == "a" and len(frames) and frames["frame_no"].max() > 130:
                raise RuntimeError("lost")
            return step(key, frames, state)

        return run

    monkeypatch.setattr(activity, "_chunk_step", failing)
    with pytest.raises(Exception, match="lost"):
        activity.track_in_chunks(speech, folder, chunk=50)
    done = {p: (tmp_path / "f" / p / "_SUCCESS").stat().st_mtime_ns for p in ("frames", "step=0", "step=1")}
    assert not (tmp_path / "f" / "step=3" / "_SUCCESS").exists()
    monkeypatch.setattr(activity, "_chunk_step", real)
    got, whole = by_frame(activity.track_in_chunks(speech, folder, chunk=50)), by_frame(activity.track(speech))
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in whole.items()}
    assert all((tmp_path / "f" / p / "_SUCCESS").stat().st_mtime_ns == t for p, t in done.items())


def test_start_index(spark):
    size, shift = 410, 160
    rows = spark.createDataFrame([(9,), (30,)], "o long").select(activity.start_index(F.col("o"), size, shift).alias("i")).collect()
    assert [r.i for r in rows] == [(size + 8 * shift) // shift - 20, (size + 29 * shift) // shift - 20]
