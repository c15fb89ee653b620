"""Column expressions over text, all evaluated inside the JVM.

The character classes spell out what a Unicode-aware `\\w`, `\\s` and `\\d` mean in the
specification (letters, numbers and underscore; white space with the separators; decimal digits),
because engines disagree about the shorthands.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
DIGIT = r"\p{Nd}"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def strip(c: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return all_matches(F.lower(c), WORD + "{2,}")


def search_tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return all_matches(F.lower(c), "[a-z0-9]+")


def words(c: Column) -> Column:
    """White-space separated words, without empty ones."""
    return all_matches(c, r"[^\s\x0B\x1C-\x1F\x85\p{Z}]+")


def seeded_order(seed: int | str, *keys: str) -> Column:
    """A reproducible shuffle key: the same on every engine, run and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
