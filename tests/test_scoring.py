"""The table function against the joins, on random models and lines."""

import random

import pytest

from auralake.functions import scoring, text
from auralake.operators import ngram


def made(spark, order, seed):
    r = random.Random(seed)
    vocabulary = ["<s>", "<UNK>", *"abcde"]
    grams = {}
    for k in range(1, order + 1):
        for _ in range(60 if k > 1 else 0):
            grams[tuple(r.choice(vocabulary) for _ in range(k))] = (-r.random() * 4, r.choice([None, -r.random()]))
        if k == 1:
            grams |= {(w,): (-r.random() * 4, -r.random()) for w in vocabulary}
    rows = [(len(g), list(g), p, bo) for g, (p, bo) in grams.items()]
    model = spark.createDataFrame(rows, "ord int, words array<string>, log10_p double, log10_bo double")
    lines = [(i, " ".join(r.choice(["<s>", *"abcdex", "é"]) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(90, None), (91, " \t "), (92, "a\tb \n c")]
    return model, spark.createDataFrame(lines, "line int, text string")


@pytest.mark.parametrize("order, unknown", [(1, None), (2, None), (3, None), (3, "<UNK>"), (4, "missing")])
def test_equals_the_joins(spark, order, unknown):
    model, lines = made(spark, order, order)
    scoring.register(spark, model, order, unknown=unknown)
    lines.createOrReplaceTempView("lines")
    got = {(r.line, r.pos): r for r in spark.sql("SELECT l.line, s.* FROM lines l, LATERAL lm_score(l.text) s").collect()}
    want = ngram.score(text.tokens(lines, keys=["line"]), model, ["line"], order, unknown=unknown).collect()
    assert len(got) == len(want) > 100
    for w in want:
        g = got[w.line, w.pos]
        assert (g.word, g.is_oov, g.n_hist, g.n_used) == (w.word, w.is_oov, w.n_hist, w.n_used)
        assert g.log10_p == (None if w.log10_p is None else pytest.approx(w.log10_p, abs=1e-12)) and len(g.history) == g.n_hist < order


def test_a_model_over_the_bound_is_an_error(spark):
    model, _ = made(spark, 2, 1)
    with pytest.raises(ValueError, match="joins"):
        scoring.register(spark, model, 2, most=10)
    rows = list(scoring.score_line(["a", "zz", "a"], {("a",): (-1.0, -0.5), ("a", "a"): (-0.1, 0.0)}, 2))
    assert [(x[2], x[4], x[5], x[6]) for x in rows] == [([], 0, 1, -1.0), (["a"], 1, None, None), ([], 0, 1, -1.0)]
