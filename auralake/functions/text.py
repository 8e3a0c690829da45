"""Text expressions of the token layer. Case folds A-Z only: letters with accents stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\r\f"


def words(text: Column) -> Column:
    """The words between spaces, tabs and line ends."""
    return F.array_remove(F.split(text, r"[ \t\n\r]+"), "")


def ascii_lower(s: Column) -> Column:
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def ascii_upper(s: Column) -> Column:
    return F.when(F.octet_length(s) == F.length(s), F.upper(s)).otherwise(F.translate(s, LOWER, UPPER))


def trim(s: Column, side: str = "both") -> Column:
    cut = {"both": F.btrim, "start": lambda c, t: F.ltrim(c, t), "end": lambda c, t: F.rtrim(c, t)}[side]
    return cut(s, F.lit(BLANKS))


def join(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def same_ignoring_case(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def compare_ignoring_case(a: Column, b: Column, n: int | None = None) -> Column:
    """-1, 0 or 1; of the first n bytes' characters where n is given."""
    x, y = ascii_lower(a), ascii_lower(b)
    if n is not None:
        x, y = F.substring(x, 1, n), F.substring(y, 1, n)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def next_word(s: Column, delimiters: str) -> Column:
    """The first word, the delimiter after it (empty at the end) and the rest."""
    inside = "".join(f"\\x{ord(c):02x}" for c in delimiters)
    pattern = f"(?s)^[{inside}]*([^{inside}]*)([{inside}]?)(.*)$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    return F.struct(part(1).alias("word"), part(2).alias("delimiter"), part(3).alias("rest"))


def number(s: Column) -> Column:
    """The number that a text starts with, the same in every locale; 0 where there is none."""
    found = F.regexp_extract(F.ltrim(s, F.lit(BLANKS)), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
    return F.when(found == "", 0.0).otherwise(found.cast("double"))


def tokens(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row for each word: the keys, pos from 0, and word. Texts without words give none."""
    kept = keys if keys is not None else [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(words(F.col(text))).alias("pos", "word"))


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
