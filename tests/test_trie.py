"""Packed models: what is written is read, whatever the sizes of ranges; the older dump, built by hand."""

import random
import struct

import numpy as np
import pytest
from test_models import table

from auralake.operators import lm_edit, ngram
from auralake.sources import models, trie

KIND = "ord int, words array<string>, log10_p double, log10_bo double"


def random_model(order, n_words=40, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(n_words)]
    rows = [(1, [w], -r.random() * 4, -r.random()) for w in vocab]
    for k in range(2, order + 1):
        grams = {tuple(r.choice(vocab) for _ in range(k)) for _ in range(n_words * 2)}
        rows += [(k, list(g), -r.random() * 3, -r.random() if k < order else None) for g in grams]
    return rows


@pytest.mark.parametrize("fields", [(3, 16), (7, 32, 5), (25, 32, 25), (1, 16, 0)])
def test_bits(fields):
    r = np.random.RandomState(1)
    values = [r.randint(0, 1 << w, 50) if w else np.zeros(50, int) for w in fields]
    got = trie.unpack(trie.pack(fields, values), fields, 50)
    assert all((a == b).all() for a, b in zip(got, values, strict=True))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_round_trip(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(trie, "RUN", 16)
    rows = spark.createDataFrame(random_model(order), KIND)
    path = f"file://{tmp_path}/m.bin"
    models.write_model(rows, path)
    want = table(lm_edit.close_suffixes(rows, order).select("ord", "words", "log10_p", "log10_bo")) if order > 1 else table(rows)
    got = table(models.read_model(spark, path))
    assert got.keys() == want.keys()
    for g, (p, bo) in want.items():
        assert got[g][0] == pytest.approx(p, abs=1e-5) and (got[g][1] or 0) == pytest.approx((bo or 0) if len(g) < order else 0, abs=1e-5)
    lay = trie.layout(path)
    raw = (tmp_path / "m.bin").read_bytes()
    assert lay.order == order and len(raw) == lay.words_at + 4 + sum(len(g[0].encode()) + 1 for g in want if len(g) == 1)
    (tmp_path / "unnamed").write_bytes(raw)
    assert table(models.read_model(spark, f"file://{tmp_path}/unnamed")) == got  # told by content


def test_scores_are_those_of_the_text(spark, tmp_path):
    rows = spark.createDataFrame(random_model(3), KIND)
    models.write_model(rows, f"file://{tmp_path}/m.bin")
    tokens = spark.createDataFrame([(i, j, f"w{(i * 5 + j * j) % 44}") for i in range(30) for j in range(9)], "line int, pos int, word string")
    of = lambda m: {(r.line, r.pos): r.log10_p for r in ngram.score(tokens, m, ["line"], 3).collect()}
    text, packed = of(rows), of(models.read_model(spark, f"file://{tmp_path}/m.bin"))
    assert text.keys() == packed.keys() and all((a is None) == (packed[k] is None) and (a is None or packed[k] == pytest.approx(a, abs=1e-4)) for k, a in text.items())


def test_many_values_share_bins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BINS", 64)
    rows = spark.createDataFrame(random_model(2, 200), KIND)
    models.write_model(rows, f"file://{tmp_path}/m.bin")
    got, want = table(models.read_model(spark, f"file://{tmp_path}/m.bin")), table(rows)
    off = [abs(got[g][0] - p) for g, (p, _) in want.items() if len(g) == 2]
    assert got.keys() == want.keys() and 0 < max(off) < 3 / 16 and len({got[g][0] for g in got if len(g) == 2}) <= 64


def test_dump(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 8)
    words = ["<s>", "a", "bé", "c"]
    uni = [(-1.0, -0.1, 0), (-1.1, -0.2, 2), (-1.2, -0.3, 3), (-1.3, -0.4, 3), (0.0, 0.0, 4)]
    bi = [(1, 0, 0, 0), (2, 1, 1, 2), (2, 2, 0, 3), (1, 0, 1, 3), (0, 0, 0, 4)]  # word, p, bo, first trigram
    tri = [(2, 0), (3, 1), (1, 1), (3, 0)]
    p2, bo2, p3 = [-0.5, -0.6, -0.7], [0.0, -0.05], [-0.01, -0.02]
    array = lambda x: struct.pack(f"<i{len(x)}f", len(x), *x)
    name = b"Darpa Trigram LM\0"
    body = struct.pack("<i", len(name)) + name + struct.pack("<i", 4) + b"x.l\0"
    for head in (struct.pack("<ii", -1, 0) + struct.pack("<i", 5) + b"note\0" + struct.pack("<i", 0), b""):
        data = body + head + struct.pack("<iii", 4, 4, 4)
        data += b"".join(struct.pack("<iffi", i, *u) for i, u in enumerate(uni)) + b"".join(struct.pack("<4H", *b) for b in bi) + b"".join(struct.pack("<2H", *t) for t in tri)
        text = b"".join(w.encode() + b"\0" for w in words)
        data += array(p2) + array(bo2) + array(p3) + struct.pack("<ii", 1, 0) + struct.pack("<i", len(text)) + text
        (tmp_path / "m.dmp").write_bytes(data)
        got = table(models.read_model(spark, f"file://{tmp_path}/m.dmp"))
        want = {(w,): (uni[i][0], uni[i][1]) for i, w in enumerate(words)}
        heads = [("<s>", "a"), ("<s>", "bé"), ("a", "bé"), ("c", "a")]
        want |= {h: (p2[b[1]], bo2[b[2]]) for h, b in zip(heads, bi, strict=False)}
        want |= {(*heads[h], words[t[0]]): (p3[t[1]], None) for h, t in zip((0, 0, 1, 3), tri, strict=True)}
        assert got.keys() == want.keys() and all(got[g][0] == pytest.approx(p) and (got[g][1] == pytest.approx(bo) if bo is not None else got[g][1] is None) for g, (p, bo) in want.items())
    with pytest.raises(ValueError, match="only read"):
        models.write_model(spark.createDataFrame(random_model(1), KIND), f"{tmp_path}/y.dmp")


@pytest.mark.parametrize("run", [1, 3, 7, 1 << 20])
def test_words_by_ranges_of_bytes(spark, tmp_path, run):
    words = ["", "a", "bb", "", "long-word-é", "z"]
    text = b"".join(w.encode() + b"\0" for w in words)
    (tmp_path / "w").write_bytes(b"xx" + struct.pack("<i", len(text)) + text)
    got = {r.wid: r.word for r in trie._words(spark, f"file://{tmp_path}/w", 2, run).collect()}
    assert got == dict(enumerate(words))


def test_damaged_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"nothing" * 30)
    (tmp_path / "x.dmp").write_bytes(b"nothing" * 30)
    for name in ("x.bin", "x.dmp"):
        with pytest.raises(ValueError, match="isn't"):
            models.read_model(spark, f"file://{tmp_path}/{name}")
