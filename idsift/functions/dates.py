"""Date text handling with NULL, never an error, for unreadable input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _as_date(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def parse_printed(text: Column) -> Column:
    """Read a printed date in one of five layouts.

    The layouts exclude each other by shape, so one cheap test picks the single
    pattern that is tried.
    """
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    return (
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _as_date(t, "yyyy-M-d"))
        .when(t.rlike(r"(?i)^\d{1,2} [a-z]{3} \d{4}$"), _as_date(t, "d MMM yyyy"))
        .when(t.rlike(r"(?i)^\d{1,2} [a-z]{4,9} \d{4}$"), _as_date(t, "d MMMM yyyy"))
        .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _as_date(t, "d/M/yyyy"))
        .when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), _as_date(t, "d.M.yyyy"))
    )


def century_date(text: Column, reference: Column, shift: int) -> Column:
    """``YYMMDD`` read in the reference's century moved by ``shift`` centuries."""
    base = (F.floor(F.year(reference) / 100) + shift) * 100
    year = F.lpad((base + F.substring(text, 1, 2).cast("int")).cast("string"), 4, "0")
    return F.when(
        text.rlike(r"^\d{6}$"), _as_date(F.concat(year, F.substring(text, 3, 4)), "yyyyMMdd")
    )


def century_candidates(text: Column, reference: Column) -> Column:
    """All valid calendar dates for ``YYMMDD`` in the three nearest centuries."""
    dates = [century_date(text, reference, shift) for shift in (-1, 0, 1)]
    return F.array_compact(F.array(*dates))


def age_on(reference: Column, born: Column) -> Column:
    """Full years completed on the reference day."""
    before_birthday = (F.month(reference) * 100 + F.dayofmonth(reference)) < (
        F.month(born) * 100 + F.dayofmonth(born)
    )
    return F.year(reference) - F.year(born) - before_birthday.cast("int")
