"""Machine-readable-zone text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the travel-document standard: the check-digit alphabet is
# 0-9, then A=10 .. Z=35, filler = 0, with repeating weights 7, 3, 1.
WEIGHTS = (7, 3, 1)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Each letter's value modulo ten, so that a text becomes a digit string.
_RESIDUES = "".join(str((10 + i) % 10) for i in range(26)) + "0"
# Fixed confusion pairs of optical readers.
TO_DIGIT = ("OIB", "018")
TO_LETTER = ("018", "OIB")

LEGAL = r"^[A-Z0-9<]*$"


def clean(text: Column) -> Column:
    """Strip every whitespace character and upper-case."""
    return F.upper(F.regexp_replace(text, r"(?U)\s+", ""))


def digits_only(text: Column) -> Column:
    return F.translate(text, LETTERS + "<", _RESIDUES)


def check_digit(text: Column) -> Column:
    """Check digit of a text of any length; NULL when a character is illegal.

    The text appears once in the expression, so nested uses stay linear in size.
    """
    legal = F.regexp_extract(F.concat(text, F.lit("!")), "^([A-Z0-9<]*)!$", 0)
    digits = F.split(digits_only(F.nullif(legal, F.lit(""))), "")
    first, second, third = WEIGHTS
    terms = F.transform(
        digits,
        lambda d, i: (F.ascii(d) - 48)
        * F.when(i % 3 == 0, first).when(i % 3 == 1, second).otherwise(third),
    )
    return (F.aggregate(F.filter(terms, lambda v: v >= 0), F.lit(0), lambda s, v: s + v) % 10).cast("string")


def to_digits(text: Column) -> Column:
    return F.translate(text, *TO_DIGIT)


def to_letters(text: Column) -> Column:
    return F.translate(text, *TO_LETTER)


def readable(text: Column) -> Column:
    """Fillers become blanks; runs collapse to one blank."""
    return F.trim(F.regexp_replace(text, "<+", " "))
