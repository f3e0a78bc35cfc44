"""Date signals and ages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
ISO = r"(?uU)\b(\d{4})-(\d{2})-(\d{2})\b"
QUARTER = r"(?iuU)\bQ([1-4])\s*(\d{4})\b"
FISCAL = r"(?iuU)\bFY\s*(\d{4})\b"
MONTH = rf"(?iuU)\b(?:as of\s+)?({MONTHS})\s+(?:(\d{{1,2}}),\s+)?(\d{{4}})\b"
VERSION = r"(?iuU)\b(?:version|v)\s*\d+(?:\.\d+)+\b"
CUES = r"(?iuU)\b(?:currently|this year|recently|at this time|as of now|today|current)\b"
# what every match holds, found in one quick reading: of the date patterns, and of VERSION
YEAR_DIGITS, VERSION_DIGITS = r"(?U)\d{4}", r"(?U)\d\.\d"
_DATE = "struct<raw:string,date:date>"


def _hits(c: Column, pattern: str, year: int, month, day) -> Column:
    """array<struct<raw, y, m, d>> of a pattern's matches; month and day take a function of the pattern's groups."""

    def one(raw: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(raw, pattern, k), F.lit(""))
        return F.struct(raw.alias("raw"), part(year).cast("int").alias("y"), month(part).cast("int").alias("m"), day(part).cast("int").alias("d"))

    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), one)


def dates(c: Column | str) -> Column:
    """array<struct<raw, date>>: ISO dates, quarters, fiscal years, then months, each distinct in lower case and date.

    A day is cut to its month's length; a year or day 0 or a month out of
    range makes no date. A quarter means the first of its last month.
    """
    c = F.col(c) if isinstance(c, str) else c
    names = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    first_day = lambda p: F.lit(1)
    found = F.concat(
        _hits(c, ISO, 1, lambda p: p(2), lambda p: p(3)),
        _hits(c, QUARTER, 2, lambda p: p(1).cast("int") * 3, first_day),
        _hits(c, FISCAL, 1, lambda p: F.lit(12), first_day),
        _hits(c, MONTH, 3, lambda p: F.floor((F.instr(names, F.lower(F.substring(p(1), 1, 3))) - 1) / 3) + 1, lambda p: F.coalesce(p(2), F.lit("1"))),
    )
    valid = F.filter(found, lambda x: (x["y"] >= 1) & x["m"].between(1, 12) & (x["d"] >= 1))
    begun = F.transform(valid, lambda x: F.struct(x["raw"].alias("raw"), F.make_date(x["y"], x["m"], F.lit(1)).alias("first"), x["d"].alias("d")))
    whole = F.transform(begun, lambda x: F.struct(x["raw"].alias("raw"), F.date_add(x["first"], F.least(x["d"], F.day(F.last_day(x["first"]))) - 1).alias("date")))
    # the first of each (lower-case text, date) keeps its own spelling
    kept = F.aggregate(
        whole,
        F.array().cast(f"array<{_DATE}>"),
        lambda acc, x: F.when(F.exists(acc, lambda a: (F.lower(a["raw"]) == F.lower(x["raw"])) & (a["date"] == x["date"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(~c.rlike(YEAR_DIGITS), F.array().cast(f"array<{_DATE}>")).otherwise(kept)


def sorted_hits(c: Column | str, pattern: str) -> Column:
    """The distinct lower-case matches of a pattern in order."""
    c = F.col(c) if isinstance(c, str) else c
    hits = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lower)))
    return F.when(~c.rlike(VERSION_DIGITS), F.array().cast("array<string>")).otherwise(hits) if pattern == VERSION else hits


def whole_months(then: Column, now: Column) -> Column:
    """Whole months from a date to now, none for the future; the time of day counts for nothing."""
    months = (F.year(now) - F.year(then)) * 12 + F.month(now) - F.month(then)
    return F.greatest(months - F.when(F.day(now) < F.day(then), 1).otherwise(0), F.lit(0))


def age_score(months: Column) -> Column:
    """1 - e^(-months / 12), to three places."""
    return F.when(months <= 0, F.lit(0.0)).otherwise(F.round(F.least(1 - F.exp(-months / 12.0), F.lit(1.0)), 3))


def parsed_datetime(c: Column) -> Column:
    """A timestamp from ISO, then year/month/day, month/day/year and day/month/year text."""
    c = F.btrim(c)
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))
    return F.coalesce(iso, *(F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy/M/d", "M/d/yyyy", "d/M/yyyy")))


def document_datetime(c: Column) -> Column:
    """A timestamp from ISO or a PDF date, D: with 14, 12 or 8 digits, whose zone is not read."""
    digits = F.regexp_extract(c, r"^D:(\d{14}|\d{12}|\d{8})", 1)
    pdf = [F.when(F.length(digits) == len(f), F.try_to_timestamp(digits, F.lit(f))) for f in ("yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMdd")]
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))
    return F.coalesce(iso, *pdf)
