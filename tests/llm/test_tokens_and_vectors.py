"""Vector codes, token files and alignment, each against a brute-force version."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auralake.llm import alignment, common, encoding, tokenfiles, vectorcodes

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def odd_texts(n=1500):
    r = random.Random(9)
    parts = [*" \t\n\r\x0b\x1c\x85\xa0　ab'st1é,.<|>", "  ", "\n\n", "<|endoftext|>", "<s>", "<0x41>", "'s ", " \n", "\U0001f600", "中", "word ", " Other", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]
    return [*texts, None, "", " ", "  ", "▁", "a▁ b", "x" * 5000, "word " * 3000, "\n" * 400, "a b c", "a b c"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i % 700 if i % 50 else None, t, "z") for i, t in enumerate(odd_texts())]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, _al string").repartition(3).cache()


@pytest.mark.parametrize("path, plain", [(A, False), (A, True), (B, False)])
def test_encoding_is_the_librarys(path, plain, rows):
    all_texts = odd_texts() + [r[1] for r in rows]
    want_of = [t or "" for t in all_texts]
    if path == A:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = plain
        want = [x.ids for x in t.encode_batch(want_of, add_special_tokens=False)]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(want_of)
    coder = encoding.Encoder(path, plain)
    for _ in range(2):  # the second time from the cache
        ids, n = coder.encode(pa.array(all_texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want
    assert encoding.byte_alphabet()["Ġ"] == 32 and len(encoding.byte_alphabet()) == 256


def test_encoding_survives_a_full_cache(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_BYTES", 2000)
    monkeypatch.setattr(encoding, "SLICE_BYTES", 300)
    monkeypatch.setattr(encoding, "CALL_BYTES", 100)
    column, coder, whole = pa.array(odd_texts()), encoding.Encoder(A), encoding.Encoder(A)
    got = [coder.encode(s) for s in encoding.slices(column)]
    ids, n = whole.encode(column)
    assert len(got) > 20 and (np.concatenate([i for i, _ in got]) == ids).all() and (np.concatenate([x for _, x in got]) == n).all()
    assert list(encoding.slices(pa.array([], pa.string()))) == []


def brute_files(rows):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(A), [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    return out


def test_token_files(spark, rows, docs, texts, none, tmp_path):
    rows = [r for r in rows if r[0] is not None]
    unique = list({r[0]: r for r in rows}.values())
    tokenfiles.write(spark.createDataFrame(unique, docs.schema).repartition(3), f"{tmp_path}/t", A, end_id=2)
    files = tokenfiles.read(spark, f"{tmp_path}/t")
    placed = tokenfiles.located(files)
    want = brute_files(unique)
    assert sorted(map(tuple, placed.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(w[:4] for w in want)
    assert {r.doc_id: r.ids for r in files.collect()} == {w[0]: w[4] for w in want}
    stream = [i for w in want for i in w[4]]
    for a, b in ((0, 5), (100, 700), (len(stream) - 3, len(stream) + 50), (len(stream) + 1, len(stream) + 2)):
        got = sorted(tokenfiles.tokens_between(files, placed, a, b).collect(), key=lambda r: r.start)
        assert [i for r in got for i in r.ids] == stream[a:b] and (not got or got[0].start == a)
    tokenfiles.write(none, f"{tmp_path}/none", A)
    assert tokenfiles.located(tokenfiles.read(spark, f"{tmp_path}/none", "doc_id long, row long, ids array<int>")).count() == 0
    # repeated ids and null ids: sums stay gapless whatever the order of equal ids
    many, df = texts
    tokenfiles.write(df, f"{tmp_path}/many", A, end_id=2)
    got = sorted(tokenfiles.located(tokenfiles.read(spark, f"{tmp_path}/many")).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((w[0], w[2], w[3]) for w in brute_files(many))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)


def test_token_files_of_one_hot_row_fill_many_files(spark, tmp_path):
    many = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).cast("string").alias("doc_id"), F.lit("the same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfiles.write(many, f"{tmp_path}/t", A)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = tokenfiles.read(spark, f"{tmp_path}/t")
    by = files.where("doc_id = '5'").groupBy(F.shiftright("row", tokenfiles.FILE_BITS)).count().collect()
    assert len(by) >= 2 and sum(r["count"] for r in by) == 4000 + 0 * len(by)
    got = sorted(tokenfiles.located(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and [r.start for r in got] == [3 * i for i in range(6000)]


def test_readers_skip_by_metadata(spark, tmp_path):
    """A reader of one document takes one row group of one file: min/max, row index and Bloom filter leave the others out."""
    docs = spark.range(0, 40_000, 1, 4).select((F.col("id") * 2).alias("doc_id"), F.lit("a few words").alias("text"))
    tokenfiles.write(docs, f"{tmp_path}/t", A)

    def taken(value):
        df = tokenfiles.read(spark, f"{tmp_path}/t").where(F.col("doc_id") == value)
        plan = df._jdf.queryExecution().executedPlan()
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan()
        rows, text = None, df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in text
        node = plan
        while not node.children().isEmpty():
            node = node.children().head()
        rows = node.metrics().get("numOutputRows").get().value()
        return n, rows

    n, rows = taken(30_000)
    assert n == 1 and 0 < rows <= 2 * tokenfiles.GROUP_ROWS
    n, rows = taken(30_001)  # no document: the Bloom filters say so
    assert n == 0 and rows <= tokenfiles.GROUP_ROWS
    import pyarrow.orc as orc

    name = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".orc")
    assert orc.ORCFile(str(name)).compression == "ZSTD" and orc.ORCFile(str(name)).row_index_stride == tokenfiles.GROUP_ROWS


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t, m = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    alphabet = encoding.byte_alphabet()
    docs, held = [], Counter()
    for doc_id, text, *_ in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)) if text else ([], [])
        a_bytes = [bytes(alphabet[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]
        links, groups = [], []
        if text and b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            ends = lambda x: np.cumsum([len(y) for y in x]).tolist()
            ea, eb = ends(a_bytes), ends(b_bytes)
            span = lambda e, i: set(range(e[i - 1] if i else 0, e[i]))
            if len(text) < 3000:
                links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if span(ea, i) & span(eb, j)]
            else:
                links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if (ea[i - 1] if i else 0) < eb[j] and (eb[j - 1] if j else 0) < ea[i]]
            cuts = sorted(set(ea) & set(eb))
            for lo, hi in zip([0, *cuts], cuts, strict=False):
                groups.append(",".join(str(x) for x, e in zip(a, ea, strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, eb, strict=True) if lo < e <= hi))
        else:
            a = b = []
        held.update(set(links))
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], held[x, _])
    return held, Counter((i, x, y, g, len(l), sum(held[k] == best[k[0]] for k in l), sum(held[k] for k in l), h) for i, x, y, g, l, h in docs)  # noqa: E741


def test_alignment(spark, texts, rows, docs, none):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    many, df = texts
    many = [r for r in many if not r[1] or len(r[1]) < 5000]
    for some, table in ((many, df.where("text is null or length(text) < 5000")), ([r for r in rows if len(r[1] or "") < 5000], docs.where("text is null or length(text) < 5000"))):
        held, want = brute_alignment(some)
        for limit in (alignment.BROADCAST_PAIRS, 0):  # pairs broadcast, and joined
            got, pairs = alignment.align_corpus(table, A, B, broadcast_pairs=limit)
            assert Counter(map(tuple, got.select(*cols).collect())) == want
            assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.n for r in pairs.collect()} == held
    assert alignment.align_corpus(none, A, B)[0].count() == 0


def test_overlaps_by_bisection():
    r = np.random.RandomState(0)
    for _ in range(50):
        n = r.randint(1, 40)
        cut = lambda: np.r_[np.sort(r.choice(n, r.randint(0, n), replace=False))[1:], n] if n > 1 else np.array([n])
        a, b = (np.unique(x[x > 0]) for x in (cut(), cut()))
        first, last, closes = alignment.overlaps(a, b)
        sa, sb = np.r_[0, a[:-1]], np.r_[0, b[:-1]]
        for i in range(len(a)):
            met = [j for j in range(len(b)) if sa[i] < b[j] and sb[j] < a[i]]
            assert (first[i], last[i]) == (met[0], met[-1]) and closes[i] == (a[i] in b)


def brute_codes(rows, entries=256, parts=4, rounds=4, scale=1024):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    good = [r for r in kept if len(r[1]) == dim]
    x = [[math.floor(scale * v) for v in r[1]] for r in good]
    cuts = [i * dim // parts for i in range(parts + 1)]
    books = [[v[cuts[p] : cuts[p + 1]] for v in x[:entries]] for p in range(parts)]
    dist = lambda u, v: sum((a - b) ** 2 for a, b in zip(u, v, strict=True))
    near = lambda u, book: min((dist(u, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in x:
                own[near(v[cuts[p] : cuts[p + 1]], books[p])[1]].append(v[cuts[p] : cuts[p + 1]])
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = []
    for r, v in zip(good, x, strict=True):
        found = [near(v[cuts[p] : cuts[p + 1]], books[p]) for p in range(parts)]
        error = sum(f[0] for f in found)
        out.append((r[0], "".join(f"{f[1]:02x}" for f in found), error if error < 1 << 63 else None, r[2]))
    out += [(r[0], None, None, r[2]) for r in kept if len(r[1]) != dim]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vector_rows(kind):
    r = random.Random(kind)
    dim = {"plain": 8, "ties": 4, "large": 4, "odd": 6, "few": 8}[kind]
    draw = {"plain": lambda: r.gauss(0, 1), "ties": lambda: r.randint(-1, 1) / 1024, "large": lambda: r.choice([r.gauss(0, 1e5), r.gauss(0, 1e9), -0.5]), "odd": lambda: r.gauss(0, 1), "few": lambda: r.random()}[kind]
    rows = [(i, [draw() for _ in range(dim)], r.choice([1, 1, 1, 2, None])) for i in range(9 if kind == "few" else 400)]
    return rows + [(1000, None, 1), (1001, [None] * dim, 1), (1002, [math.nan] * dim, 2), (1003, [math.inf] + [0.0] * (dim - 1), 2), (None, rows[0][1], None), rows[3], (1004, [1.0], 7), (1005, [], 7)]


@pytest.mark.parametrize("kind, entries", [("plain", 32), ("ties", 32), ("large", 16), ("odd", 16), ("few", 256)])
def test_vector_codes(spark, kind, entries):
    rows = vector_rows(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("x")).repartition(3)
    books, coded = vectorcodes.compress(df, entries=entries)
    want, digest = brute_codes(rows, entries)
    got = coded.select("vec_id", vectorcodes.code_string(F.col("_al_code.codes"), 4).alias("code"), "_al_code.error", "label", "v").collect()
    assert Counter((r.vec_id, r.code, r.error, r.label) for r in got) == Counter(want) and books.digest() == digest and {r.v for r in got} == {"x"}
    again = vectorcodes.encode(df, books).select("vec_id", vectorcodes.code_string(F.col("_al_code.codes"), 4).alias("code"), "_al_code.error", "label")
    assert Counter(map(tuple, again.collect())) == Counter(want)
    plain = common.Scratch(spark, "t").write(coded.select("vec_id", "label", "_al_code.error"), "c")
    sums = defaultdict(int)
    for _, _, e, label in want:
        sums[label] += e or 0
    whole = vectorcodes.with_group_errors(plain, "label", "error", "label_error").collect()
    assert len(whole) == len(want)
    for r in whole:
        has = [w[2] for w in want if w[3] == r.label and w[1] is not None]
        if not has:
            assert not r.label_error
        elif None not in has and sums[r.label] < 1 << 63:
            assert r.label_error == sums[r.label]


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for table in (df, df.limit(0)):
        books, coded = vectorcodes.compress(table)
        assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest() and vectorcodes.encode(table, books).count() == 0
    same = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5).cast("float")] * 4).alias("embedding"), F.lit(1).alias("label"))
    assert {r[0] for r in vectorcodes.compress(same)[1].select(vectorcodes.code_string(F.col("_al_code.codes"), 4)).collect()} == {"00000000"}


@pytest.mark.parametrize("size", [1, 1 << 12, 1 << 30, 1 << 51])
def test_the_radius_suffices(size):
    """From any start the search finds the lowest of the nearest entries, without a scan of the others."""
    r = np.random.RandomState(1)
    centres = r.randint(-size, size + 1, (12, 3)).astype(object)
    book = np.concatenate([c + r.randint(-2, 3, (8, 3)).astype(object) for c in centres] + [centres[:3]])
    x = np.concatenate([c + r.randint(-3, 4, (20, 3)).astype(object) for c in centres])
    want = np.array([min((sum((a - b) ** 2 for a, b in zip(u, e, strict=True)), i) for i, e in enumerate(book)) for u in x], dtype=object)
    near = vectorcodes.Neighbours(book)
    for start in (want[:, 1].astype(int), np.zeros(len(x), int), r.randint(0, len(book), len(x))):
        at, best, scanned = near.nearest(x, start)
        assert (at == want[:, 1]).all() and (best == want[:, 0]).all()
        if size > 1 << 10 and (start == want[:, 1]).all():
            assert scanned < 20 * len(x)


def test_rows_of_a_hot_group_are_split(spark):
    rows = common.Scratch(spark, "t").write(spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 300 == 0, None).otherwise(F.col("id")).alias("k")), "r")
    groups = rows.groupBy(F.col("k").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("m"))
    got = common.join_groups(rows, groups, "k", "g", "n")
    assert Counter(map(tuple, got.select("k", "m").collect())) == Counter((r.k, r.k) for r in rows.collect()) and got.columns == ["k", "m"]
