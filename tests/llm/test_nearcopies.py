"""Near copies at a Jaccard similarity of 0.8 against brute force over all pairs."""

import random

import numpy as np
import pytest
from test_operators import brute_fingerprint


def sets(text):
    words = (text or "").split(" ")
    words = [w.lower() for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) >= 0.8 if x | y else True


def brute(rows):
    """The groups of ids by texts alike, or whose fingerprints differ in two bits at most."""
    marks = [int(brute_fingerprint(t), 16) if isinstance(brute_fingerprint(t), str) else brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ((marks[i] ^ marks[j]) & (1 << 64) - 1).bit_count() <= 2 or alike(rows[i][1], rows[j][1]):
                root[top(i)] = top(j)
    groups = {}
    for i, (n, _) in enumerate(rows):
        groups.setdefault(top(i), set()).add(n)
    return {frozenset(g) for g in groups.values()}


def made():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for n in (30, 60, 90, 180, 400, 2500):
        base = [word() for _ in range(n)]
        for edits in (0, 1, 2, n // 60, n // 45, n // 30, n // 20):
            t = list(base)
            for _ in range(edits):
                t[r.randrange(n)] = word()
            texts.append(" ".join(t))
        texts.append(" ".join(base + [word() for _ in range(n // 12)]).upper())
    shared = [word() for _ in range(40)]  # a passage of many texts, which are no copies
    texts += [" ".join([word() for _ in range(40)] + shared + [word() for _ in range(20)]) for _ in range(30)]
    texts += ["one", "ONE", "two words", "", "  ", None, texts[4], texts[4], texts[9]]
    return list(enumerate(texts))


def test_classes_hold_all_similar_texts(spark):
    from auralake.llm import simhash

    rows = made()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(5)
    groups = {}
    for r in simhash.classes(docs, similarity=0.8).collect():
        groups.setdefault(r.root, set()).add(r.doc_id)
        assert r.component_id <= r.doc_id
    assert {frozenset(g) for g in groups.values()} == brute(rows)
    plain = simhash.classes(docs).select("root").distinct().count()
    assert plain > len(groups)  # fingerprints alone leave near copies apart


def test_a_large_group_of_near_copies_is_one_class(spark):
    from auralake.llm import nearcopies, simhash

    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(400):
        t = list(base)
        t[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.classes(docs, similarity=0.8)
    assert {x.component_id for x in got.collect()} == {0}
    keys = docs.select(nearcopies.bands("text").alias("b")).collect()
    assert {len(k.b) for k in keys} == {nearcopies.BANDS}


def test_empty_and_wordless_tables(spark):
    from auralake.llm import simhash

    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(none, similarity=0.8).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, " \n"), (3, "a")], "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in simhash.classes(odd, similarity=0.8).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (3, 3)}


def test_the_stage_keeps_one_text_of_each_class(spark):
    import corpus_pipeline as p

    rows = made()
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    kept = [r.doc_id for r in p.near_duplicates(spark, docs, "", similarity=0.8).collect()]
    assert sorted(kept) == sorted(min(g) for g in brute(rows))


def test_minima_in_blocks(monkeypatch):
    from auralake.llm import nearcopies

    h = np.random.default_rng(1).integers(0, 2**63, 10_000, dtype=np.uint64)
    whole = [min((int(x) * int(a) + int(b)) % 2**64 for x in h) for a, b in zip(nearcopies.FACTORS[:3], nearcopies.SUMMANDS[:3], strict=True)]
    assert nearcopies.minima(h)[:3].tolist() == whole
    assert nearcopies.jaccard("a b c d e f", "a b c d e g") == pytest.approx(1 / 3)
    assert nearcopies.jaccard(None, " ") == 1.0 and nearcopies.jaccard("a", None) == 0.0
