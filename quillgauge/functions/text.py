"""Text helpers with Python string semantics, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() and regex \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regex character class (Java and RE2 both read it).
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Inside of a character class for Python's Unicode \w.
WORD = r"\p{L}\p{N}_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def fence(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer copies a plain projection into every filter above it and, inside a
    lambda, evaluates it per element. A one-element generator keeps its output fixed.
    """
    packed = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, packed.alias("_fenced")).select(*kept, "_fenced.*")


def strip(text: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(text, F.lit(WHITESPACE))


def stripped_lines(text: Column) -> Column:
    """Array of the text's lines, each stripped."""
    return F.transform(F.split(text, "\n", -1), strip)


def words(text: Column) -> Column:
    """Lower-cased runs of word characters in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]+)"), F.lit(1))


def long_words(text: Column) -> Column:
    """Lower-cased word runs of two characters and more."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]{{2,}})"), F.lit(1))


def space_tokens(text: Column) -> Column:
    """``text.lower().split()``."""
    return F.filter(F.split(F.lower(text), f"[{WS}]+", -1), lambda t: t != "")


def capitalize(word: Column) -> Column:
    """``str.capitalize()``."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def any_of(fragments: list[str]) -> str:
    """Regex that finds any of the plain fragments."""
    return "|".join(fragments)


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
