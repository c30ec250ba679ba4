"""Words and lines as native column expressions.

A word is a longest run of characters other than space and the controls 9 to 13.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    bare = F.trim(squeezed)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " ", -1))


def word_count(text: Column) -> Column:
    """Number of words as a long, without keeping them: 0 for null and blank texts."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, SPACES, -1)).cast("bigint")
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    blank = lambda c: F.translate(c, SPACE_CHARACTERS, "") == ""
    edges = blank(first).cast("bigint") + blank(last).cast("bigint")
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(pieces - edges)


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` evaluated once, also where it stands inside further lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_name(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores after it until no column of `taken` has it in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
