"""Text expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?iuU)\b[a-z0-9][a-z0-9'\-]*\b"
BOILERPLATE = ("tbd", "todo", "placeholder", "draft", "n/a", "to be determined", "agenda", "action items: none")


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.btrim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-case words, with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def boilerplate_hits(c: Column | str) -> Column:
    """The boilerplate phrases that a text contains, as substrings."""
    # the text is folded once, as a lambda's argument, not for each phrase
    return F.get(F.transform(F.array(F.lower(c)), lambda low: F.filter(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(low, p))), 0)


def stem(c: Column | str) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(c, r".(\.[^./]+)$", 1))


def normalised_key(c: Column) -> Column:
    """Lower case, with runs of spaces, underscores and hyphens as one space."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))
