"""Each operator against a brute-force version on one fixture, and on an empty table."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auralake.llm import decontam, langid, linededup, lm, mixing, quality, sharding, simhash, substring, tokencount
from auralake.llm.components import components
from auralake.llm.common import Scratch, row_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
words = lambda t: WORD.findall(t or "")


def bag(df, *cols):
    return Counter(map(tuple, df.select(*cols).collect()))


def test_sharding(spark, docs, rows, none):
    got = sharding.shard_rows(docs.select("doc_id", "text"), 5).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.shard_rows(docs.repartition(7).select("doc_id", "text"), 5).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    whole = sharding.shard_documents(docs, 5)
    assert whole.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert Counter(r[:5] for r in map(tuple, whole.select("doc_id", "text", "lang", "source", "n").collect())) == Counter((r[0], r[1], r[2], r[3], r[8]) for r in rows)
    assert sharding.shard_rows(none.select("doc_id"), 5).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 100, 1000])
def test_permutation_and_its_inverse(spark, n):
    x = spark.range(n).select("id", sharding.permute(F.col("id"), n, 9).alias("y"))
    got = x.select("id", "y", sharding.permute(F.col("y"), n, 9, inverse=True).alias("z")).collect()
    assert sorted(r["y"] for r in got) == list(range(n)) and all(r["z"] == r["id"] for r in got)


def test_many_equal_rows_are_numbered_in_runs(spark):
    many = spark.range(10_000).select(F.lit(1).alias("a"))
    assert sorted(r[1] for r in sharding.number_rows(many).collect()) == list(range(10_000))


def test_language(spark, docs, rows, none):
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    assert model.langs == ["en", "fr"]
    got = langid.identify(docs, model).select("doc_id", "text", "lang", "_al_lang.*").collect()
    assert len(got) == len(rows)
    for r in got:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["n_spans"]) == ("und", 0.0, 0)
        else:
            assert r["lang_pred"] in model.langs and 0 <= r["score"] <= 1
    held = [r for r in got if r["lang"] and r["text"] and len(words(r["text"])) > 20]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    nothing = langid.fit(none)
    assert langid.identify(none, model).count() == 0
    assert {r["_al_lang"]["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    en, fr = (next(r[1] for r in rows if r[2] == g and len(words(r[1])) > 60) for g in ("en", "fr"))
    spans = langid.Detector(model).spans(f"{en} {fr}")
    assert {s[0] for s in spans} == {"en", "fr"} and sum(s[2] for s in spans) == len(langid.text_words(f"{en} {fr}"))


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.normal(0, 2, (rng.integers(1, 9), 3))
        n = len(s)
        best = max(sum(s[i, (p // 3**i) % 3] for i in range(n)) - 3.0 * sum((p // 3**i) % 3 != (p // 3 ** (i - 1)) % 3 for i in range(1, n)) for p in range(3**n))
        path = langid.viterbi(s, 3.0)
        assert s[np.arange(n), path].sum() - 3.0 * (np.diff(path) != 0).sum() == pytest.approx(best)


def test_scripts_narrow():
    scripts = np.zeros((len(langid.NAMES), 2), dtype=bool)
    scripts[langid.NAMES.index("latin"), 0] = scripts[langid.NAMES.index("cyrillic"), 1] = True
    none = np.zeros(0, dtype=np.int64)
    model = langid.LanguageModel(["en", "ru"], none.astype(np.uint64), np.zeros(1, dtype=np.int64), none, none.astype(float), np.zeros(2), scripts)
    s, fits = model.score(["привет", "hello", "γειά"])
    assert s[:2].argmax(axis=1).tolist() == [1, 0] and not fits.any()  # narrowed by script, but no n-gram is known


def test_ngrams_and_scores(spark):
    docs = spark.createDataFrame([(1, "ab ab c", "x"), (2, "ab d", "y")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    gram = lambda w: [f"^{w}$"[i : i + n] for n in range(1, 5) for i in range(len(w) + 3 - n) if n > 1 or 0 < i < len(w) + 1]
    seen = {"x": Counter(g for w in ["ab", "ab", "c"] for g in gram(w)), "y": Counter(g for w in ["ab", "d"] for g in gram(w))}
    every = set(seen["x"]) | set(seen["y"])
    assert len(model.keys) == len(every)
    words = ["ab", "abd", "zz", "ab" * 30]
    raw = [[sum(math.log((seen[g][q] + 0.5) / (sum(seen[g].values()) + 0.5 * (len(every) + 1))) for q in gram(w)) / 4 for g in "xy"] for w in words]
    want = [[max(v, max(r) - langid.SWITCH) for v in r] for r in raw]
    assert model.score(words)[0] == pytest.approx(np.array(want))


def test_language_of_odd_texts(spark, docs):
    model = langid.fit(docs)
    odd = [(1, "word" * 300_000, 0), (2, "Ελληνικά γράμματα μόνο " * 20, 0), (3, "12 34 ...", 0), (4, None, 0), (5, "the and on there " * 30_000, 0)]
    got = {r.doc_id: r.v for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string, _al_lang int"), model, name="v").collect()}
    assert got[2].score == 0 and got[3].lang_pred == got[4].lang_pred == "und" and got[1].lang_pred != "und" and (got[5].lang_pred, got[5].score) == ("en", 1.0)
    with pytest.raises(ValueError, match="_al_lang"):
        langid.identify(spark.createDataFrame(odd, "doc_id long, text string, _al_lang int"), model)


def test_many_languages(spark):
    many = spark.range(2400).select("id", F.concat(F.lit("l"), (F.col("id") % 1200).cast("string")).alias("lang"), F.concat_ws(" ", *[F.concat(F.lit("qz"), F.translate(((F.col("id") % 1200) * 7919 + k).cast("string"), "0123456789", "abcdefghij")) for k in range(20)]).alias("text"))
    model = langid.fit(many, id_col="id", total=10_000)
    assert len(model.langs) == 1200
    got = langid.identify(many, model).select("lang", "_al_lang.lang_pred").collect()
    assert sum(a == b for a, b in got) > 0.9 * len(got)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(spark.range(langid.MAX_LANGS + 1).select("id", F.col("id").cast("string").alias("lang"), F.lit("x").alias("text")), id_col="id")


def brute_fingerprint(text):
    w = words((text or "").translate(LOW))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(items):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(items))]


def test_simhash(spark, docs, rows, none):
    got = simhash.classes(docs).select("doc_id", simhash.as_hex(F.col("f")).alias("x"), "component_id")
    items = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(items, brute_classes(items), strict=True))
    assert bag(got, "doc_id", "x", "component_id") == want
    assert simhash.classes(none).count() == 0


def test_simhash_links_in_crowds(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 30)}
    for _ in range(40):
        fps.add(list(fps)[int(rng.integers(len(fps)))] ^ (1 << int(rng.integers(64))))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    scratch = Scratch(spark, "t")
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "f long"), scratch)
    roots = dict(map(tuple, components(links.select(F.col("f").alias("a"), F.col("g").alias("b")), scratch).collect()))
    want = brute_classes([(x, x & (1 << 64) - 1) for x in signed])
    assert [roots.get(x, x) for x in signed] == want


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["b"] for r in components(links, Scratch(spark, "t")).collect()} == {0}


def test_line_dedup(spark, docs, rows, none):
    got = bag(linededup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept")
    low = -(1 << 63)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(low if r[0] is None else r[0])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != (low if r[0] is None else r[0]))]
        want[(r[0], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert got == want and sum(n for (_, _, n, _) in want) > 0
    assert linededup.dedup_lines(none).count() == 0
    strings = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("%05d", F.col("doc_id") + 10)))
    name = lambda d: None if d is None else f"{d + 10:05d}"
    assert bag(linededup.dedup_lines(strings, batches=2), "doc_id", "n_lines", "n_dropped", "kept") == Counter({(name(d), a, b, t): n for (d, a, b, t), n in want.items()})


def test_line_runs_open_again(spark):
    line = [f"A line that is long enough, number {i}" for i in range(6)]
    texts = ["\n".join([line[i % 6], line[(i + 1) % 6], f"only here {i} and nowhere else"]) for i in range(12)]
    rows = [(f"d{(i * 5) % 12:02d}", t) for i, t in enumerate(texts)]
    frame = lambda x: spark.createDataFrame(x, "doc_id string, text string")
    whole = Counter(map(tuple, linededup.dedup_lines(frame(rows)).collect()))
    for fan in (2, 3):
        runs = Scratch(spark, "t").path("runs")
        first = linededup.LineRuns(spark, runs, fan=fan)
        keys = lambda x: linededup.line_keys(frame(x).select(F.struct(F.col("doc_id").alias("id")).alias("d"), F.lit(0).cast("long").alias("r"), "text"))
        for k in range(3):
            first.add(keys(rows[k * 2 : k * 2 + 2]))
        again = linededup.LineRuns(spark, runs)
        assert again.levels == first.levels and again.fan == fan
        again.add(keys(rows[6:]))
        decided = Counter(map(tuple, again.decided(Scratch(spark, "t")).select("h1", "h2", "last.id").collect()))
        other = linededup.LineRuns(spark, Scratch(spark, "t").path("runs"))
        other.add(keys(rows))
        assert decided == Counter(map(tuple, other.decided(Scratch(spark, "t")).select("h1", "h2", "last.id").collect())) and len(decided) == 6
        plan = again._sorted(lambda: again._merge(again._table(again.levels[0][0] if again.levels[0] else again.levels[-1][0]), again._table([x for level in again.levels for x in level][-1]))._jdf.queryExecution().executedPlan().toString())
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs = Scratch(spark, "t").path("runs")
    linededup.dedup_lines(frame(rows[:7]), runs=runs, batches=1).collect()
    later = linededup.dedup_lines(frame(rows[7:]), runs=runs, batches=1).collect()
    assert all(tuple(r) in whole for r in later)


def brute_contamination(rows, items):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pat.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    for r in rows:
        w, hit, found = pat.findall((r[1] or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit |= set(range(k, k + n))
        yield r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [4_000_000, 15])
def test_decontamination(spark, docs, rows, none, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    long_ = words(rows[0][1])
    items = [(1, " ".join(long_[3:25])), (2, "Two words"), (10, " ".join(long_[10:30])), (3, ""), (4, None), (5, " ".join(words(rows[5][1])[-30:])), (6, "not there at all in any of them")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench)
    want = Counter(brute_contamination(rows, items))
    assert bag(got, *got.columns[:6]) == want and any(x[-1] for x in want)
    assert decontam.contamination(none, bench).count() == 0
    assert not decontam.contamination(docs, bench.limit(0)).where("contaminated").count()


def test_longest_matches():
    rng = np.random.default_rng(8)
    for window in (3, 10):
        items = [(str(i), " ".join(rng.choice(["a", "b", "c", "d"], int(n)))) for i, n in enumerate(rng.integers(1, 40, 12))]
        texts = [" ".join(rng.choice(["a", "b", "c", "d", "x"], int(n), p=[0.24] * 4 + [0.04])) for n in rng.integers(0, 80, 25)]
        texts += [f"x {items[0][1]} x", items[3][1]]
        b = decontam.Benchmark(items, window)
        for text, (_, found, _, longest) in zip(texts, decontam._match(b, texts), strict=True):
            w, best = text.split(), (0, 0)
            for item, t in items:
                v, least = t.split(), min(window, len(t.split()))
                for i in range(len(w)):
                    for j in range(len(v)):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if n >= least and j + least <= len(v):
                            best = max(best, (n, -i))
            assert (best[0] > 0) == bool(found)
            if found:
                assert (longest["words"], longest["at"]) == (best[0], -best[1])
                v = dict(items)[longest["item"]].split()
                assert v[longest["item_at"] : longest["item_at"] + best[0]] == w[-best[1] : best[0] - best[1]]


def brute_statistics(t):
    w = words(t)
    g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, rows, none):
    got = quality.judge(docs)
    want = Counter()
    for r in rows:
        s = brute_statistics(r[1])
        want[(r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not got.where("base_failed and kept").count() and not got.where("quality not between 0 and 1").count()
    by = {r["doc_id"]: r["kept"] for r in got.collect()}
    junk = next(r[0] for r in rows if r[1] and r[1].startswith("a***"))
    assert not by[junk] and by[rows[3][0]]
    assert quality.judge(none).count() == 0


def brute_em(counts, rules, rounds):
    kinds = sorted({k for r in rules for k in r.kinds})
    own = {(k, j) for k in kinds for j, r in enumerate(rules) if k in r.kinds}
    p = {}
    for v in counts:
        share = [sum(v[j] == -1 for j in range(len(rules)) if (k, j) in own) / max(1, sum(v[j] != 0 for j in range(len(rules)) if (k, j) in own)) for k in kinds]
        x = [1 - max(share), *share]
        p[v] = [y / sum(x) for y in x]
    for i in range(rounds):
        n = sum(counts.values())
        share = [(sum(c * p[v][k] for v, c in counts.items()) + 10 * (0.9 if k == 0 else 0.1 / len(kinds))) / (n + 10) for k in range(len(kinds) + 1)]
        rate = {}
        for j in range(len(rules)):
            away = [0, *[k + 1 for k, name in enumerate(kinds) if (name, j) not in own]]
            for at, ks, prior in [(None, away, 0.02), *[(k, [k + 1], 0.5) for k, name in enumerate(kinds) if (name, j) in own]]:
                rate[at, j] = (sum(c * p[v][k] for v, c in counts.items() for k in ks if v[j] == -1) + 10 * prior) / (sum(c * p[v][k] for v, c in counts.items() for k in ks if v[j]) + 10)
        if i == rounds - 1:
            return share, rate
        for v in counts:
            joint = [share[k] * math.prod((r if v[j] == -1 else 1 - r) for j in range(len(rules)) if v[j] for r in [rate[k - 1 if (k - 1, j) in rate else None, j]]) for k in range(len(kinds) + 1)]
            p[v] = [x / sum(joint) for x in joint]


def test_em_weighs_noisy_rules(spark):
    rng = np.random.default_rng(7)
    rules = (quality.Rule("a", ("x",), "", ""), quality.Rule("b", ("x",), "", ""), quality.Rule("noisy", ("x",), "", ""), quality.Rule("c", ("y",), "", ""), quality.Rule("d", ("y", "x"), "", ""))
    kind = rng.choice(3, 6000, p=[0.85, 0.1, 0.05])
    hit = {0: (0.01, 0.01, 0.2, 0.01, 0.01), 1: (0.95, 0.9, 0.3, 0.01, 0.9), 2: (0.01, 0.01, 0.2, 0.9, 0.9)}
    votes = np.where(rng.random((6000, 5)) < 0.1, 0, np.where(rng.random((6000, 5)) < np.array([hit[k] for k in kind.tolist()]), -1, 1))
    counts = Counter(map(tuple, votes.tolist()))
    frame = spark.createDataFrame([(*k, n) for k, n in counts.items()], ", ".join(f"{r.name} int" for r in rules) + ", n long").repartition(3)
    for rounds in (1, 7):
        model = quality.fit(frame, rules, rounds)
        share, rate = brute_em(counts, rules, rounds)
        assert model.shares == pytest.approx(share, abs=1e-9)
        assert all((model.elsewhere[j] if k is None else model.own[k, j]) == pytest.approx(x, abs=1e-9) for (k, j), x in rate.items())
    model = quality.fit(frame, rules)
    judged = {tuple(r[x.name] for x in rules): r["q"] for r in frame.withColumn("q", model.quality(rules)).collect()}
    patterns = np.array(list(judged))
    assert model.classes(patterns)[:, 0] == pytest.approx(np.array(list(judged.values())), abs=1e-9)
    assert np.mean([(judged[tuple(v)] >= 0.5) == (k == 0) for v, k in zip(votes.tolist(), kind, strict=True)]) > 0.97
    assert judged[1, 1, -1, 1, 1] > 0.9 and judged[-1, -1, -1, 1, -1] < 0.1  # the noisy rule alone is outvoted
    assert abs(model.elsewhere[2] - 0.2) < 0.03


def brute_kneser_ney(train, order):
    tokens = [[*(t or "").translate(LOW).split(), "\n"] for t in train]
    uni = Counter(w for t in tokens for w in t)
    grams = {order: Counter(tuple(p[i : i + order]) for t in tokens for p in [["<s>"] * (order - 1) + t] for i in range(len(t)))}
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    d = {n: lm._discounts(*[sum(c == k for c in g.values()) for k in (1, 2, 3, 4)]) for n, g in grams.items()}
    off = lambda c, n: 0 if not c else d[n][min(c, 3) - 1]
    unseen = sum(off(c, 1) for c in grams[1].values()) / sum(grams[1].values()) / (len(uni) + 1)
    total, mass = Counter(), Counter()
    for n, found in grams.items():
        for g, c in found.items():
            total[n, g[:-1]] += c
            mass[n, g[:-1]] += off(c, n)

    def p(v, context):
        n = len(context) + 1
        if n == 1:
            return (grams[1][v,] - off(grams[1][v,], 1)) / sum(grams[1].values()) + unseen
        low = p(v, context[1:])
        if not total[n, context]:
            return low
        c = grams[n][*context, v]
        return (c - off(c, n)) / total[n, context] + mass[n, context] / total[n, context] * low

    return uni, p


@pytest.mark.parametrize("order, shard, hashed", [(2, 1 << 19, False), (2, 64, False), (3, 64, False), (3, 64, True), (4, 1 << 19, True)])
def test_language_model(spark, docs, rows, none, monkeypatch, order, shard, hashed):
    monkeypatch.setattr(lm, "WORD_SHARD", shard)
    monkeypatch.setattr(lm, "GRAM_SHARD", shard)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    marked = docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out"))
    model = lm.fit(marked.where(~F.col("held_out")), order=order, key_bits=16 if hashed else 64)
    assert len(os.listdir(model.arrays.local)) < 1000
    got = defaultdict(list)
    for r in lm.score(marked, model).collect():
        got[r["doc_id"], r["n_tokens"]].append(r)
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
    uni, p = brute_kneser_ney([" ".join(split(r[1])) for r in rows if not held(r[0])], order)
    n, v = sum(uni.values()), len(uni)
    context = ("<s>",) * (order - 2) + ("the",)
    assert sum(p(w, context) for w in uni) + p("unknown", context) == pytest.approx(1)
    for r in rows:
        t = [*split(r[1]), "\n"]
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        padded = ["<s>"] * (order - 1) + t
        score = sum(math.log10(p(w, tuple(padded[i : i + order - 1]))) for i, w in enumerate(t))
        assert any(
            g["n_known"] == sum(uni[w] > 0 for w in t) and g["train_tokens"] == n and g["base_score"] == pytest.approx(base) and g["score"] == pytest.approx(score) and g["held_out"] == held(r[0])
            for g in got[r[0], len(t)]
        )
    if order == 2:
        empty = marked.limit(0)
        assert lm.score(empty, model).count() == 0
        assert {r["score"] for r in lm.score(marked, lm.fit(empty)).collect()} == {0.0}


def test_token_counts(spark, docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False))) for r in rows)
    got = tokencount.count_tokens(docs, path)
    assert bag(got, "doc_id", "n_bytes", "n_tokens") == want
    assert not got.where("over_limit <> (n_tokens > 1024)").count() and tokencount.count_tokens(none, path).count() == 0
    odd = ["a  b", " a", "a ", "a \n", "a\n b", "a \nb", "a\n \n b", "x  ", "  x", "a  b", "don 't 's", "<|endoftext|> a", "a <|endoftext|>", " ", "  ", "\n ", "a\t b\r\n c", "é è", "1 2  3 !  ?"]
    assert tokencount.lengths(odd, path) == [len(t.encode(x, add_special_tokens=False)) for x in odd]
    rng = np.random.default_rng(2)
    odd = ["".join(rng.choice(list("ab'1!. \n\t  é"), 12)) for _ in range(3000)]
    odd += ["".join(rng.choice(list("语言模型，。！、ab'1<|>"), 200)) for _ in range(300)] + ["语言。" * 40_000, "x<|endoftext|>y" * 20]
    assert tokencount.lengths(odd, path) == [len(t.encode(x, add_special_tokens=False)) for x in odd]
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    assert tokencount.lengths(odd[:50], model) == [len(pieces.encode(x)) for x in odd[:50]]


def test_substring(spark, docs, rows, none):
    low = -(1 << 63)
    first = {}
    for r in rows:
        w, d = words(r[1]), low if r[0] is None else r[0]
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, d), d)
    want = Counter()
    for r in rows:
        w, d = words(r[1]), low if r[0] is None else r[0]
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for j in range(50)}
        want[(r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    for bits in (64, 4):  # with few bits nearly all edges share a hash with others
        got = substring.remove_repeats(docs, bits=bits)
        assert bag(got, *got.columns) == want and any(x[2] for x in want)
    assert substring.remove_repeats(none).count() == 0
    strings = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("%05d", F.col("doc_id") + 10)))
    name = lambda d: None if d is None else f"{d + 10:05d}"
    got = substring.remove_repeats(strings)
    assert bag(got, *got.columns) == Counter({(name(d), *rest): n for (d, *rest), n in want.items()})


def test_substring_over_random_passages(spark):
    rng = np.random.default_rng(6)
    passages = [rng.integers(0, 40, int(n)).tolist() for n in rng.integers(45, 160, 6)]
    texts = []
    for i in range(40):
        t = rng.integers(0, 40, int(rng.integers(0, 60))).tolist()
        for _ in range(int(rng.integers(0, 4))):
            x = passages[int(rng.integers(6))]
            a = int(rng.integers(0, 20))
            t += x[a : len(x) - int(rng.integers(0, 20))] + rng.integers(0, 40, int(rng.integers(0, 30))).tolist()
        texts.append((i, " ".join(f"w{x}" for x in t)))
    texts += [(40 + i, "la " * (60 + i)) for i in range(3)]
    first, want = {}, set()
    for i, t in texts:
        for k in range(len(t.split()) - 49):
            first.setdefault(tuple(t.split()[k : k + 50]), i)
    for i, t in texts:
        w = t.split()
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        want.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for bits in (64, 5):
        assert {tuple(r) for r in substring.remove_repeats(docs, bits=bits).collect()} == want


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 100, None: 0}, {"x": 0}, {"a": 1, "b": 1, "c": 1, "d": 900, None: 40}, {f"s{i}": i * i for i in range(30)}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark, "t")).collect()
    want = brute_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_mix_says_when_it_misses_its_targets(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ITERATIONS", 1)
    with pytest.raises(RuntimeError, match="off their targets"):
        mixing.mix(docs)


def test_row_keys_tell_nested_rows_apart(spark):
    schema = "doc_id long, text string, source string, tags array<string>, m map<string,int>, s struct<a: string, b: string>, _al_key int, c0 string"
    rows = [(1, "one two", "s", ["a, b"], {"x": 1}, ("p", None), 1, "k"), (1, "one two", "s", ["a", "b"], {"x": 1}, ("p", None), 1, "k"), (1, "one two", "s", ["a", None, "b"], {"x": 1}, ("p", None), 1, "k"), (1, "one two", "s", [None, "a", "b"], {"x": 1}, ("p", None), 1, "k"), (1, "one two", "s", None, {"x": 1}, (None, "p"), 1, "k"), (1, "one two", "s", None, {"x": 1, "y": 2}, None, 1, "k"), (1, "one two", "s", [], None, None, 1, "k"), (1, "one two", "s", [], None, None, 1, "k")]
    docs = spark.createDataFrame(rows, schema)
    show = lambda d: Counter(repr(r[:6]) for r in map(tuple, d.collect()))
    assert show(sharding.shard_documents(docs, 3)) == show(docs)
    assert set(show(mixing.mixed_documents(docs))) <= set(show(docs)) and mixing.mixed_documents(docs).columns == docs.columns
    keys = docs.select(row_key(docs).alias("k")).distinct().count()
    assert keys == 7
    with pytest.raises(ValueError, match="_al_"):
        sharding.shard_rows(docs.select("doc_id", "_al_key"), 3)


def test_mix(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target, taken = brute_targets(sizes), Counter()
    assert {round(r["target"], 6) for r in got} == {round(x, 6) for x in target.values()}
    for r in got:
        taken[round(r["target"], 6)] += r["taken"]
    biggest = max(len(words(r[1])) for r in rows)
    assert all(abs(taken[t] - t * sum(round(x, 6) == t for x in target.values())) <= biggest for t in taken)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(6)).collect()))
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert mixing.mixed_documents(docs).columns == docs.columns and sum(copies.values()) > 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mix_meets_targets_over_many_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(n), f"s{i % 5}") for i, n in enumerate(np.minimum(rng.lognormal(3, 1, 3000), 500))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] / r["target"] - 1) < 0.01 for r in got)


def test_queries(spark, docs, rows, tmp_path):
    """The registered queries, over a folder of tables, with the columns of their contracts."""
    from auralake.llm import queries

    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    items = [(1, " ".join(words(rows[0][1])[3:25])), (2, "two words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    q = queries.queries()
    one = q["op1_sharding"](spark, at)
    assert bag(one, "doc_id", "size", "text_crc32", "law", "grown_shard") == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), "rows", None) for r in rows)
    assert dict(one.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    remainder = lambda d, n: zlib.crc32(("" if d is None else str(d)).encode()) % n
    two = q["op2_language_id"](spark, at).collect()
    assert Counter((r.doc_id, r.held_out) for r in two) == Counter((r[0], remainder(r[0], 4) == 2) for r in rows)
    assert Counter(r.doc_id for r in two if r.lang_pred == "und") == Counter(r[0] for r in rows if not any(map(str.isalpha, r[1] or "")))
    known = {r[0]: r[2] for r in rows if r[2] and len(words(r[1])) > 20}
    held = [r for r in two if r.held_out and r.doc_id in known]
    assert held and sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.9 * len(held)
    marks = [(r[0], brute_fingerprint(r[1])) for r in rows]
    assert bag(q["op3_simhash"](spark, at), "doc_id", "fingerprint", "component_id") == Counter((d, f"{f:016x}", c) for (d, f), c in zip(marks, brute_classes(marks), strict=True))
    assert bag(q["op5_decontamination"](spark, at), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == Counter(brute_contamination(rows, items))
    for name in ("op4_line_dedup", "op9_substring_dedup"):
        got, low = q[name](spark, at).collect(), -(1 << 63)
        assert len(got) == len(rows) and all(len(r.kept_sha256) == 64 for r in got)
    assert Counter(r.doc_id for r in q["op6_quality_rules"](spark, at).where("kept and base_failed").collect()) == Counter()
    seven = q["op7_lm_scoring"](spark, at)
    assert Counter((r.doc_id, r.held_out, r.n_tokens) for r in seven.collect()) == Counter((r[0], remainder(r[0], 5) == 1, len(words(r[1])) + 1) for r in rows)
    assert bag(q["op10_mixing"](spark, at), "doc_id", "size") == Counter((r[0], len(words(r[1]))) for r in rows)
    pytest.importorskip("public_tokenizers")
    assert bag(q["op8_token_counts"](spark, at), "doc_id", "n_bytes") == Counter((r[0], len((r[1] or "").encode())) for r in rows)
