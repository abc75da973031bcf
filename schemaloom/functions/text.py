"""Tokens, flattening and small string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that separate words in the two punctuation tokenisers.
WIDE_SEPARATORS = "?,.!'\"():;_-"
NARROW_SEPARATORS = "?,.!'\"():;"

# Characters that count as white space.
WHITE_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space (that of Unicode) at both ends; linear in the text, whatever runs of it are inside."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _punctuation_words(text: Column, separators: str) -> Column:
    spaced = F.translate(F.lower(text), separators, " " * len(separators))
    return F.array_distinct(F.filter(F.split(spaced, r"\s+"), lambda t: t != ""))


def words_wide(text: Column) -> Column:
    """Distinct words; ``_`` and ``-`` separate too."""
    return _punctuation_words(text, WIDE_SEPARATORS)


def words_narrow(text: Column) -> Column:
    """Distinct words; ``_`` and ``-`` stay inside a word."""
    return _punctuation_words(text, NARROW_SEPARATORS)


def words_ascii(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and ``_``."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def flatten_text(text: Column, limit: int = 40) -> Column:
    """One short line: control characters become spaces, long values end in an ellipsis."""
    line = strip(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "))
    return F.when(
        F.length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))
    ).otherwise(line)


def after_first(text: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.substr(text, F.locate(mark, text) + F.lit(len(mark)))


def clean_sql(sql: Column) -> Column:
    """Drop code fences and make sure the statement ends in one ``;``."""
    bare = strip(F.regexp_replace(strip(sql), r"(?i)```sql|```", ""))
    return F.when(bare.endswith(";"), bare).otherwise(F.concat(bare, F.lit(";")))


def normal_sql(sql: Column) -> Column:
    """Form in which two statements are compared for equality."""
    spaced = F.regexp_replace(F.lower(clean_sql(sql)), r"\s+", " ")
    return F.trim(F.replace(spaced, F.lit(" ;"), F.lit(";")))


def plain_name(name: Column) -> Column:
    return F.lower(F.replace(strip(name), F.lit("`"), F.lit("")))
