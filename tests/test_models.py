import math

import pytest
from pyspark.sql import functions as F

from auralake.functions import text
from auralake.operators import lm_edit, ngram
from auralake.sources import models

ARPA = """a comment
\\data\\
ngram 1=5
ngram 2=4
ngram 3=2

\\1-grams:
-1.0 <UNK>
-0.7 <s> -0.3
-0.5 a -0.2
-0.6 b -0.1
0.4 c

\\2-grams:
-0.2 <s> a -0.05
-0.4 a b -0.15
-0.3 b c
-0.3 b stranger

\\3-grams:
-0.1 <s> a b
-0.11 a b c
broken line that has too many words in it

\\end\\
"""


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lm") / "m.arpa"
    path.write_text(ARPA)
    return models.read_model(spark, str(path)).cache(), str(path)


def table(df):
    return {tuple(r.words): (r.log10_p, r.log10_bo) for r in df.collect()}


def test_reading(spark, model):
    got = table(model[0])
    assert len(got) == 10 and got["c",] == (0.0, 0.0) and got["b", "c"] == (-0.3, 0.0) and got["a", "b", "c"] == (-0.11, None)
    assert ("b", "stranger") not in got


def test_round_trip(spark, model, tmp_path):
    lines = [r.line for r in models.arpa_lines(model[0]).orderBy("ord", "k").collect()]
    path = tmp_path / "again.arpa"
    path.write_text("\n".join(lines))
    assert table(models.read_arpa(spark, str(path))) == table(model[0])


def test_a_file_without_sections_is_an_error(spark, tmp_path):
    (tmp_path / "x.arpa").write_text("nothing\n\\2-grams:\n-1 a b\n")
    with pytest.raises(ValueError):
        models.read_arpa(spark, str(tmp_path / "x.arpa"))


def brute(grams, words, order, i):
    h = []
    for w in reversed(words[max(0, i - order + 1) : i]):
        if (w,) not in grams:
            break
        h.insert(0, w)
    if (words[i],) not in grams:
        return None, None
    for k in range(min(len(h), order - 1), -1, -1):
        g = (*h[len(h) - k :], words[i])
        if g in grams:
            p = grams[g][0]
            for n in range(k, len(h)):
                c = tuple(h[len(h) - n - 1 :])
                if c not in grams:
                    break
                p += grams[c][1] or 0.0
            return p, k + 1


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, model, order):
    grams = table(model[0])
    lines = ["<s> a b c", "a b x a b c", "c b a", "x", "<s> a b b c"]
    tokens = text.tokens(spark.createDataFrame(list(enumerate(lines)), "line int, text string"))
    got = {(r.line, r.pos): (r.log10_p, r.n_used) for r in ngram.score(tokens, model[0], ["line"], order).collect()}
    for i, line in enumerate(lines):
        w = line.split()
        for j in range(len(w)):
            p, used = brute({k: v for k, v in grams.items() if len(k) <= order}, w, order, j)
            assert got[i, j][1] == used and (got[i, j][0] is None if p is None else got[i, j][0] == pytest.approx(p))


def test_perplexity_and_weights(spark, model):
    tokens = text.tokens(spark.createDataFrame([(1, "<s> a b x")], "line int, text string"))
    s = ngram.score(tokens, model[0], ["line"], 3)
    r = ngram.perplexity(s, ["line"]).first()
    assert (r.n_scored, r.n_cues, r.n_oov) == (2, 1, 1) and r.entropy == pytest.approx(0.3 / math.log10(2) / 2) and r.perplexity == pytest.approx(2**r.entropy)
    assert ngram.perplexity_parity(s, ["line"]).first().entropy == pytest.approx(r.entropy, abs=1e-3)
    closed = ngram.score(tokens, model[0], ["line"], 3, unknown="<UNK>").where("word = 'x'").first()
    assert closed.log10_p == pytest.approx(-1.0 - 0.1 - 0.15)
    w = s.where("word = 'b'").select(ngram.weighted(F.col("log10_p"), 2.0, 0.5).alias("w")).first().w
    assert abs(w - (2 * -0.1 * math.log(10) + math.log(0.5)) / math.log(1.0001)) < 3


def test_interpolation(spark):
    keys = "k int, log10_p double"
    a, b = spark.createDataFrame([(1, -1.0), (2, None), (3, None)], keys), spark.createDataFrame([(1, -2.0), (2, -1.0), (3, None)], keys)
    got = {r.k: r.log10_p for r in ngram.interpolate([a, b], [0.5, 0.5], ["k"]).collect()}
    assert got == {1: pytest.approx(math.log10(0.055)), 2: pytest.approx(math.log10(0.05)), 3: None}


def test_suffix_closure(spark):
    rows = [(1, [w], -1.0, -0.1) for w in "abcd"] + [(3, ["a", "b", "c"], -0.2, None), (4, ["d", "a", "b", "c"], -0.3, None), (2, ["b", "d"], -0.4, 0.0)]
    got = {tuple(r.words): (r.is_blank, r.log10_p) for r in lm_edit.close_suffixes(spark.createDataFrame(rows, "ord int, words array<string>, log10_p double, log10_bo double"), 4).collect()}
    assert got["b", "c"] == (True, pytest.approx(-1.1)) and got["a", "b", "c"] == (False, -0.2) and len(got) == 8


def test_suffix_closure_of_numbers(spark):
    """Words can be numbers, and no join or shuffle carries arrays."""
    rows = [(1, [w], -1.0, -0.1) for w in range(4)] + [(3, [0, 1, 2], -0.2, None), (4, [3, 0, 1, 2], -0.3, None), (2, [1, 3], -0.4, 0.0)]
    closed = lm_edit.close_suffixes(spark.createDataFrame(rows, "ord int, words array<bigint>, log10_p double, log10_bo double"), 4)
    got = {tuple(r.words): (r.is_blank, r.log10_p) for r in closed.collect()}
    assert got[1, 2] == (True, pytest.approx(-1.1)) and got[0, 1, 2] == (False, -0.2) and len(got) == 8
    closed = lm_edit.close_suffixes(spark.createDataFrame(rows, closed.select("ord", "words", "log10_p", "log10_bo").schema).where("ord < 4"), 3)
    plan = closed.groupBy("ord").count()._jdf.queryExecution().executedPlan().toString()
    assert not any("words" in line for line in plan.splitlines() if "Exchange" in line or "Join" in line)


def test_classes_vocabularies_and_sets(spark, tmp_path):
    (tmp_path / "c.def").write_text("ignored\nLMCLASS x\none 3\ntwo\nEND x\nLMCLASS y\nthree 1.05\nEND y\n")
    c = models.read_classes(spark, str(tmp_path / "c.def"))
    assert sorted(map(tuple, c.collect())) == [("x", "one", 3), ("x", "two", 1), ("y", "three", 1.05)]
    n = lm_edit.normalise_classes(c)
    assert sorted(r.weight for r in n.collect()) == [0.25, 0.75, 1.05]
    assert sorted(round(r.weight, 4) for r in lm_edit.add_class_word(n, "x", "four", 0.6).where("class = 'x'").collect()) == [0.2, 0.2, 0.6]
    v = spark.createDataFrame([(0, "<S>"), (1, "Aé"), (2, "aé"), (3, "B")], "wid int, word string")
    assert sorted(map(tuple, lm_edit.fold_vocabulary(v).collect())) == [(0, "<S>"), (1, "aé"), (3, "b")]
    words = spark.createDataFrame([("b",), ("<UNK>",), ("a",), ("b",)], "word string")
    assert sorted(map(tuple, lm_edit.numbered_vocabulary(words).collect())) == [(0, "<UNK>"), (1, "a"), (2, "b")]
    both = lm_edit.union_vocabulary({"m": spark.createDataFrame([("a",), ("<UNK>",)], "word string"), "n": spark.createDataFrame([("b",)], "word string")})
    got = {(r.word, r.model): r.own for r in both.collect()}
    assert got["b", "m"] == "<UNK>" and got["a", "n"] is None and got["b", "n"] == "b" and len(got) == 6
    w = lm_edit.add_model(spark.createDataFrame([("m", 0.5), ("n", 0.5)], "model string, weight double"), "o", 0.2)
    assert {r.model: round(r.weight, 6) for r in w.collect()} == {"m": 0.4, "n": 0.4, "o": 0.2}
    assert {r.model: round(r.weight, 6) for r in lm_edit.remove_model(w, "m").collect()} == {"n": round(0.4 / 0.6, 6), "o": round(0.2 / 0.6, 6)}
    (tmp_path / "l.ctl").write_text("{ c.def }\nm.arpa first { x y }\nn.arpa second\n")
    got = models.read_model_list(spark, str(tmp_path / "l.ctl"))
    assert [(n, c) for _, n, c in got.models] == [("first", ["x", "y"]), ("second", [])] and got.class_files == [str(tmp_path / "c.def")]


def brute_score(grams, words, unknown=None):
    """By token: log10 p, by the definition of back-off."""
    known = [w if (w,) in grams else unknown for w in words]
    for i, w in enumerate(known):
        if w is None:
            yield None
            continue
        history = []
        for h in reversed(known[max(0, i - 2) : i]):
            if h is None:
                break
            history.insert(0, h)

        def p(context):
            if (*context, w) in grams:
                return grams[*context, w][0]
            bo = grams[tuple(context)][1] or 0 if tuple(context) in grams else None
            return p(context[1:]) + (bo if bo is not None else 0)

        def known_back(context):  # an unknown context ends the chain of back-offs for shorter ones found with it
            return tuple(context) in grams

        total, at = None, history
        for n in range(len(history), -1, -1):
            at = history[len(history) - n :]
            if (*at, w) in grams:
                total = grams[*at, w][0]
                for k in range(n + 1, len(history) + 1):
                    if not known_back(history[len(history) - k :]):
                        break
                    total += grams[tuple(history[len(history) - k :])][1] or 0
                break
        yield total


def test_scores_against_the_definition(spark, model):
    grams = table(model[0])
    lines = ["<s> a b c a b c", "b c zzz a b", "a a a c b", "zzz", "<s> zzz b c (utt1)", "c (x) (u)"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line int, text string")
    tokens = text.tokens(docs, keys=["line"])
    for unknown in (None, "<UNK>", "nowhere"):
        got = {(r.line, r.pos): r.log10_p for r in ngram.score(tokens, model[0], ["line"], 3, unknown=unknown).collect()}
        want = {(i, k): p for i, t in enumerate(lines) for k, p in enumerate(brute_score(grams, t.split(), unknown if unknown != "nowhere" else None))}
        assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {k: v if v is None else round(v, 9) for k, v in want.items()}
    e = ngram.evaluate(tokens, model[0], ["line"], 3).first()
    kept = [t.split()[:-1] if t.endswith(")") else t.split() for t in lines]
    scores = [(w, p) for t in kept for w, p in zip(t, brute_score(grams, t), strict=True)]
    hit = [p for w, p in scores if w != "<s>" and p is not None]
    assert (e.n_words, e.n_cues, e.n_oov) == (len(scores), 2, sum(p is None for _, p in scores)) and e.log10_p == pytest.approx(sum(hit))
    assert e.entropy == pytest.approx(-sum(hit) / math.log10(2) / len(hit)) and e.perplexity == pytest.approx(2**e.entropy) and e.oov_percent == pytest.approx(100 * e.n_oov / e.n_words)
    by = ngram.evaluate(tokens, model[0], ["line"], 3, keys=["line"]).collect()
    assert {r.line: r.n_words for r in by} == {i: len(t) for i, t in enumerate(kept) if t}


def test_conversion(spark, model, tmp_path):
    from auralake.api import NGramModel, NGramModelSet

    upper = NGramModel.convert(spark, model[1], f"{tmp_path}/up.parquet", target_kind="parquet", fold="upper")
    assert ("A", "B") in table(upper.ngrams) and table(models.read_model(spark, f"{tmp_path}/up.parquet", "parquet")) == table(upper.ngrams)
    both = NGramModelSet.of({"x": NGramModel(model[0], 3), "y": upper}).weighted(9.5, 0.7).with_words(spark.createDataFrame([("new", 1.0)], "word string, weight double"))
    assert all(m.lw == 9.5 and ("new",) in table(m.ngrams) for m in both.models.values())


def test_kinds_by_content(spark, model, tmp_path):
    (tmp_path / "plain").write_text(ARPA)
    assert table(models.read_model(spark, f"{tmp_path}/plain")) == table(model[0])
    model[0].write.parquet(f"{tmp_path}/columns")
    assert table(models.read_model(spark, f"{tmp_path}/columns")) == table(model[0])
    for name, head in (("x", b"Trie Language Model\x03"), ("y", b"\x11\0\0\0Darpa Trigram LM\0")):
        (tmp_path / name).write_bytes(head + bytes(80))
        with pytest.raises(ValueError, match="packed"):
            models.read_model(spark, f"{tmp_path}/{name}")


def test_remapped_vocabulary(spark):
    v = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    mapped = lm_edit.union_vocabulary({"m": v("a", "<UNK>"), "n": v("b")})
    got = {(r.word, r.model): r.own for r in lm_edit.remap_vocabulary(mapped, v("a", "b", "z", "a")).collect()}
    assert got == {("a", "m"): "a", ("a", "n"): None, ("b", "m"): "<UNK>", ("b", "n"): "b", ("z", "m"): None, ("z", "n"): None}
