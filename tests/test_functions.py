import math

import pytest
from pyspark.sql import functions as F

from auralake.functions import logmath, text, vectors


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize("base, shift, p, x", [(1.0001, 0, 1e-150, -3454050), (1.0001, 0, 42.0, 37378), (1.003, 0, 1e-48, -36896), (1.003, 0, 42.0, 1247), (1.0001, 8, 1e-150, -13493), (1.0001, 8, 42.0, 146)])
def test_integer_logs(spark, base, shift, p, x):
    m = logmath.LogMath(base, shift)
    r = one(spark, x=m.log(F.lit(p)), back=m.exp(m.log(F.lit(p))), zero=m.log(F.lit(0.0)), nothing=m.exp(F.lit(m.zero)))
    assert abs(r.x - x) <= 20 and r.zero == m.zero and r.nothing == 0
    assert math.log(r.back) == pytest.approx(math.log(p), abs=2 * m.step * (1 << shift))


def test_log_add(spark):
    m = logmath.LogMath()
    r = one(spark, s=m.add(m.log(F.lit(0.25)), m.log(F.lit(0.5))), e=m.add_exact(m.log(F.lit(0.25)), m.log(F.lit(0.5))), w=m.log(F.lit(0.75)), z=m.add(F.lit(m.zero), F.lit(-5)), l=m.from_log10(F.lit(-2.302)), n=m.from_log10(F.lit(-2.7884)))
    assert abs(r.s - r.w) <= 2 and abs(r.e - r.w) <= 2 and r.z == -5 and (r.l, r.n) == (-53008, -64208)
    q = one(spark, a=logmath.ln_add(F.lit(-1000.0), F.lit(-1000.0)), b=logmath.ln_add(F.lit(None).cast("double"), F.lit(-3.0)))
    assert q.a == pytest.approx(-1000 + math.log(2)) and q.b == -3


def test_log_sum_exp_of_far_values(spark):
    rows = spark.createDataFrame([("a", -3000.0), ("a", -3001.0), ("a", -9.0), ("a", None), ("b", 700.0), ("b", 710.0)], "k string, x double")
    got = {r.k: r.y for r in logmath.log_sum_exp(rows, ["k"], "x", "y").collect()}
    assert got["a"] == pytest.approx(-9) and got["b"] == pytest.approx(710 + math.log1p(math.exp(-10)))


def test_text(spark):
    s = F.lit(" \tÉa B\n")
    w = text.next_word(F.lit("  ab;cd"), " ;")
    r = one(spark, w=text.words(s), u=text.ascii_upper(F.lit("éa")), l=text.ascii_lower(F.lit("ÉA")), t=text.trim(s), a=text.trim(s, "start"), z=text.trim(s, "end"), n=w, d=text.number(F.lit(" -1.5e2x")), d0=text.number(F.lit("x")), c=text.compare_ignoring_case(F.lit("ab"), F.lit("AC")), e=text.same_ignoring_case(F.lit("aB"), F.lit("Ab")), b=text.file_stem(F.lit("x/y.z/a.b.c")), p=text.dir_name(F.lit("x/y/a")), p0=text.dir_name(F.lit("a")))
    assert r.w == ["Éa", "B"] and (r.u, r.l) == ("éA", "Éa") and (r.t, r.a, r.z) == ("Éa B", "Éa B\n", " \tÉa B")
    assert (r.n.word, r.n.delimiter, r.n.rest) == ("ab", ";", "cd") and (r.d, r.d0) == (-150, 0) and r.c == -1 and r.e and (r.b, r.p, r.p0) == ("a.b", "x/y", ".")


def test_matrices(spark):
    m = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ((4, 2, 0), (2, 3, 0), (0, 0, 2))])
    odd = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))
    r = one(spark, d=vectors.determinant(m), n=vectors.determinant(odd), s=vectors.solve(m, F.array(F.lit(2.0), F.lit(3.0), F.lit(4.0))), i=vectors.multiply(m, vectors.invert(m)), none=vectors.invert(odd), f=vectors.floor_nonzero(F.array(F.lit(0.0), F.lit(0.1)), 0.5), b=vectors.band_nonzero(F.array(F.lit(-0.1), F.lit(0.0), F.lit(2.0)), 0.5), o=vectors.outer(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0))))
    assert r.d == pytest.approx(16) and r.n == -1 and r.s == pytest.approx([0, 1, 2]) and r.none is None
    assert [x for row in r.i for x in row] == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1]) and r.f == [0, 0.5] and r.b == [-0.5, 0, 2] and r.o == [[3], [6]]
    cells = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 0.0)], "k string, v double")
    assert sorted(x.s for x in vectors.normalise(cells, ["k"], "v", "s").collect()) == [0, 0.25, 0.75]
