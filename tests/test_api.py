import math

import pytest
from test_models import ARPA

from auralake import api
from auralake.functions import text


def test_model(spark, tmp_path):
    (tmp_path / "m.arpa").write_text(ARPA)
    m = api.NGramModel.read(spark, str(tmp_path / "m.arpa"))
    assert m.order == 3 and m.unknown == "<UNK>" and {r.ord: r.n for r in m.counts().collect()} == {1: 5, 2: 3, 3: 2}
    turns = spark.createDataFrame([(1, "<s> a b c")], "line int, text string")
    r = m.perplexity(turns, ["line"]).first()
    assert r.n_scored == 3 and r.entropy == pytest.approx((0.2 + 0.1 + 0.11) / 3 / math.log10(2))
    classes = spark.createDataFrame([("c", "x", 0.5), ("c", "y", 0.5)], "class string, word string, weight double")
    s = m.with_classes(classes).score(text.tokens(spark.createDataFrame([(1, "a b x")], "line int, text string")), ["line"]).where("surface = 'x'").first()
    assert s.log10_p == pytest.approx(-0.11 + math.log10(0.5)) and abs(s.score - s.log10_p * math.log(10) / math.log(1.0001)) < 2
    up = m.casefolded(upper=True)
    assert {tuple(r.words) for r in up.ngrams.where("ord = 3").collect()} == {("<s>", "A", "B"), ("A", "B", "C")}
    both = api.NGramModelSet.of({"m": m, "n": m})
    got = both.score(text.tokens(turns), ["line"]).orderBy("pos").collect()
    assert got[3].log10_p == pytest.approx(-0.11)
    three = both.with_model("o", m, 0.5)
    assert three.weights == {"m": 0.25, "n": 0.25, "o": 0.5} and three.without("o").weights == both.weights and both.vocabulary().count() == 10
    m.write(str(tmp_path / "m.parquet"))
    assert api.NGramModel.read(spark, str(tmp_path / "m.parquet")).ngrams.count() == 10
