"""The table of compacted paths against plain compaction, and texts whose hashes meet by chance."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import substring
from auralake.llm.common import Scratch


def brute_paths(groups):
    """(edge -> (head, place, words from the head)) by walking predecessors."""
    ahead, behind = defaultdict(list), defaultdict(list)
    for e, b, a, step in groups:
        if a is not None:
            ahead[a].append((e, step))
        if b is not None:
            behind[b].append(e)
    before = {}
    for link, es in behind.items():
        if len(es) == 1 and len(ahead[link]) == 1 and ahead[link][0][0] != es[0]:
            before[es[0]] = ahead[link][0]
    out = {}
    for e, *_ in groups:
        at, place, words, seen = e, 0, 0, set()
        while at in before and at not in seen:
            seen.add(at)
            at, step = before[at][0], before[at][1]
            place, words = place + 1, words + step
        out[e] = (e, 0, 0) if at in before else (at, place, words)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_compaction(spark, seed):
    r = random.Random(seed)
    groups, link, edge = [], iter(range(1000, 99_999)), iter(range(-500, 9999))
    for n in (1, 1, 2, 3, 7, 40, 65):  # paths
        es, ls = [next(edge) for _ in range(n)], [next(link) for _ in range(n - 1)]
        groups += [(e, ls[i - 1] if i else None, ls[i] if i < n - 1 else None, r.randint(1, 38)) for i, e in enumerate(es)]
    for n in (1, 2, 5, 16):  # cycles
        es, ls = [next(edge) for _ in range(n)], [next(link) for _ in range(n)]
        groups += [(e, ls[i - 1], ls[i], r.randint(1, 38)) for i, e in enumerate(es)]
    shared = next(link)  # a link that two edges have ahead joins nothing
    groups += [(next(edge), None, shared, 3), (next(edge), None, shared, 4), (next(edge), shared, None, 5)]
    groups.append((next(edge), next(link), next(link), 7))  # links of edges that aren't repeated
    r.shuffle(groups)
    df = spark.createDataFrame(groups, "edge long, behind long, ahead long, step int").repartition(3)
    got = {x.edge: (x.head, x.place, x.at) for x in substring.compacted(df, Scratch(spark, "t")).collect()}
    assert got == brute_paths(groups)
    assert not substring.compacted(df.limit(0), Scratch(spark, "t")).count()


def test_paths_of_texts(spark):
    """Each path's words lie in every document that has one of its edges, as long as the table says."""
    r = random.Random(4)
    word = lambda: f"w{r.randint(0, 5000)}"
    passage = [word() for _ in range(300)]
    texts = [(i, [word() for _ in range(r.randint(0, 80))] + passage[a:b] + [word() for _ in range(40)]) for i, (a, b) in enumerate([(0, 300), (0, 300), (50, 300), (0, 120), (200, 300), (10, 20)])]
    rows = spark.createDataFrame([(i, i, " ".join(t)) for i, t in texts], "id long, r long, text string")
    found, paths = substring.graph(rows, Scratch(spark, "t"))
    table = {x.edge: x for x in paths.collect()}
    span = defaultdict(int)
    for x in table.values():
        span[x.head] = max(span[x.head], x.at + substring.K)
    assert Counter(x.head for x in table.values()).most_common(1)[0][1] >= 3  # something was compacted
    words_of = defaultdict(set)
    for _, t in texts:
        if len(t) < substring.WINDOW:
            continue
        roll = substring.Rolling(substring.word_hashes([w.encode() for w in t])[0])
        _, starts, own = substring._anchor_rows(roll, 64)
        place = {int(e): int(s) for s, e in zip(starts, own[:, 0], strict=True)}
        for e, s in place.items():
            if e in table:
                head = table[e].head
                assert place[head] == s - table[e].at
                words_of[head].add(" ".join(t[place[head] : place[head] + span[head]]))
    assert words_of and all(len(x) == 1 for x in words_of.values())
    assert {x.id for x in found.select("id").distinct().collect()} == {i for i, t in texts if len(t) >= substring.WINDOW}


def test_links_that_meet_by_chance(spark, monkeypatch, tmp_path):
    """With links of a few bits, paths join what the words don't: they are opened until all digests agree."""
    (tmp_path / "own.py").write_text("")
    r = random.Random(6)
    rng = np.random.default_rng(5)
    passages = [[f"w{x}" for x in rng.integers(0, 900, 140)] for _ in range(5)]
    texts = []
    for i in range(30):
        t = [f"w{x}" for x in rng.integers(0, 900, int(rng.integers(0, 70)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            t += p[r.randint(0, 30) :] + [f"w{x}" for x in rng.integers(0, 900, 9)]
        texts.append((i, t))
    first, want = {}, Counter()
    for i, t in texts:
        for k in range(len(t) - 49):
            first.setdefault(tuple(t[k : k + 50]), i)
    for i, t in texts:
        gone = {k + j for k in range(len(t) - 49) if first[tuple(t[k : k + 50])] < i for j in range(50)}
        want[i, len(t), len(gone), " ".join(x for k, x in enumerate(t) if k not in gone)] += 1
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(2)
    real = substring.graph
    asked = []

    def few_links(rows, scratch, bits):
        found, paths = real(rows, scratch, bits)
        # as if links had met: pairs of heads become one path each
        heads = [x.edge for x in paths.where("edge = head").orderBy("edge").limit(6).collect()]
        swap = F.create_map(*[F.lit(v) for a, b in zip(heads[::2], heads[1::2], strict=False) for v in (b, a)]) if len(heads) > 1 else F.create_map(F.lit(0), F.lit(0))
        joined = paths.withColumn("_h", swap[F.col("head")])
        asked.append(len(heads))
        return found, scratch.write(joined.select("edge", F.coalesce("_h", "head").alias("head"), "place", (F.col("at") + F.when(F.col("_h").isNotNull(), 30).otherwise(0)).alias("at")), "wrong_paths")

    monkeypatch.setattr(substring, "graph", few_links)
    got = substring.remove_repeats(docs)
    assert Counter(map(tuple, got.collect())) == want and asked[0] >= 2 and any(k[2] for k in want)
