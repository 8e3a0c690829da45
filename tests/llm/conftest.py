import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size double, key string, n int"


def make_rows():
    """Texts with copies, near copies, shared lines and passages, junk, a long one, nulls and repeated rows."""
    r = random.Random(5)
    sylls = {"en": "the th an er on in re st ou and ly".split(), "fr": "le la que é è eau ç oi ent une ou".split()}
    word = lambda lang: "".join(r.choice(sylls[lang]) for _ in range(r.randint(1, 3)))
    prose = lambda lang, n: " ".join(word(lang) + ("." if i % 9 == 8 else "") for i in range(n)).replace(". ", ".\n", 2)
    passage = prose("en", 70)
    line = "A Line That Very Many Documents Share, é."
    texts = []
    for i in range(24):
        lang = "en" if i % 3 else "fr"
        t = prose(lang, r.randint(12, 90))
        if i % 4 == 0:
            t = f"{line if i % 8 else line.upper().replace('É', 'é')}\n{t}"
        if i % 5 == 0:
            t = f"{t} {passage} {prose(lang, 7)}"
        texts.append((t, lang))
    texts += [texts[3], texts[3], texts[7]]
    texts.append((texts[7][0] + " more", "en"))
    texts += [("", "en"), (" \t\n ", "en"), (None, "en"), ("One", None), ("two words", "en"), ("... 123 !!!", "fr")]
    texts.append(("Te " * 30 + "la la", "fr"))
    texts.append(((passage + "\n") * 3 + prose("en", 3000) + " x" * 60, "en"))
    texts.append(("a*** b&&& c### " * 9, "en"))
    texts.append(("<|endoftext|> foo  bar\n \n\tbaz 's don't x ", "en"))
    rows = [(i * 3, t, g, f"s{i % 4}" if i % 7 else None, len(t or ""), "q", 1.5, "k", i) for i, (t, g) in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, texts[2][0], "en", None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    rows.append((-4, texts[9][0], "fr", "s1", 3, "q", 2.5, "k", 3))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
