"""String functions by name, for those who think in terms of a C string library; each is one expression of Spark. Positions count from 0 and -1 is "not found"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid(s: Column, at: int, n: int) -> Column:
    return F.substring(s, at + 1, n)


def delete(s: Column, at: int, n: int) -> Column:
    return F.overlay(s, F.lit(""), at + 1, n)


def insert(s: Column, at: int, other: Column) -> Column:
    return F.overlay(s, other, at + 1, 0)


def replace_at(s: Column, at: int, n: int, other: Column) -> Column:
    return F.overlay(s, other, at + 1, n)


def find(s: Column, other: Column, at: int = 0) -> Column:
    return F.position(other, s, F.lit(at + 1)) - 1


def find_last(s: Column, other: Column) -> Column:
    back = F.instr(F.reverse(s), F.reverse(other))
    return F.when(back == 0, -1).otherwise(F.length(s) - back - F.length(other) + 1)


def find_any(s: Column, letters: str) -> Column:
    """Where the first of the letters stands."""
    return F.length(F.regexp_extract(s, f"^[^{escaped(letters)}]*", 0)) - F.when(s.rlike(f"[{escaped(letters)}]"), 0).otherwise(F.length(s) + 1)


def find_none(s: Column, letters: str) -> Column:
    """Where the first letter stands that is none of these."""
    return F.length(F.regexp_extract(s, f"^[{escaped(letters)}]*", 0)) - F.when(s.rlike(f"[^{escaped(letters)}]"), 0).otherwise(F.length(s) + 1)


def escaped(letters: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in letters)


def same_caseless(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def stem_caseless(s: Column, stem: Column) -> Column:
    return F.startswith(F.lower(s), F.lower(stem))


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def find_replace_caseless(s: Column, what: str, by: str) -> Column:
    import re

    return F.regexp_replace(s, "(?i)" + re.escape(what), by.replace("\\", "\\\\").replace("$", "\\$"))


def pattern(s: Column, n: int) -> Column:
    """s repeated until it has n letters, the last time in part."""
    return F.substring(F.repeat(s, n), 1, n)


def join(parts: Column, by: str) -> Column:
    return F.array_join(parts, by)


def split(s: Column, mark: str) -> Column:
    import re

    return F.split(s, re.escape(mark))


def split_any(s: Column, letters: str) -> Column:
    return F.split(s, f"[{escaped(letters)}]")


def app_title(app: Column, version: Column, misc: Column) -> Column:
    """app version (misc), without the parts that are empty."""
    full = lambda c: F.when(c.isNotNull() & (c != ""), c)
    return F.concat_ws(" ", full(app), full(version), F.concat(F.lit("("), full(misc), F.lit(")")))


#: White space that is trimmed.
BLANKS = " \t\n\x0b\x0c\r"


def trimmed(s: Column, left: bool = True, right: bool = True) -> Column:
    """The text without white space at its ends."""
    trim = F.btrim if left and right else F.ltrim if left else F.rtrim
    return trim(s, F.lit(BLANKS))


def formatted(said: str, *of: Column) -> Column:
    """A text in which %s, %d and the like stand for columns."""
    return F.format_string(said, *of)


def split_each(s: Column, mark: str, each) -> Column:
    """The list of what each (a function of a column) makes of the parts of a text between marks."""
    return F.transform(split(s, mark), each)
