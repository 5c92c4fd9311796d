"""Printed-field extraction from labelled text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The supported English labels.
LABELS = {
    "name": r"FULL\s+NAME|NAME|SURNAME",
    "number": r"(?:PASSPORT|DOCUMENT|ID|LICEN[CS]E)\s*(?:NO\.?|NUMBER)",
    "nationality": r"NATIONALITY",
    "dob": r"DATE\s+OF\s+BIRTH|DOB",
    "expiry": r"DATE\s+OF\s+EXPIRY|EXPIRY|EXPIRATION\s+DATE",
    "issue": r"DATE\s+OF\s+ISSUE|ISSUE\s+DATE",
    "gender": r"SEX|GENDER",
    "visa_number": r"VISA\s*(?:NO\.?|NUMBER)",
    "visa_type": r"VISA\s+TYPE",
    "valid_from": r"VALID\s+FROM",
    "valid_until": r"VALID\s+(?:UNTIL|TO)",
    "stay_duration": r"DURATION\s+OF\s+STAY|STAY\s+DURATION",
}
# Type keywords in order of precedence.
KEYWORDS = (
    ("visa", r"\bVISA\b"),
    ("license", r"\bDRIV(?:ING|ER)\b"),
    ("permit", r"\bPERMIT\b"),
    ("passport", r"\bPASSPORT\b"),
    ("id", r"\b(?:IDENTITY|NATIONAL\s+ID)\b"),
)
FIELDS = tuple(LABELS)

# One expression finds the line and tells the label by the group that matched:
# no two labels can open the same line.
_ANY = r"(?iuU)^\s*(?:" + "|".join(f"({p})" for p in LABELS.values()) + r")\s*[:\-]?\s+(.+?)\s*$"


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), r"(?U)\s+", " "))


_MARK = "\u0001"
_GROUPS = _MARK.join(f"${i + 1}" for i in range(len(FIELDS) + 1))


def groups_of(text: Column) -> Column:
    """All groups of a labelled line in one evaluation, separated by marks; other
    lines come back without a mark.

    Exactly one label group is filled, so the number of leading marks names the
    label, and the value follows the last mark.
    """
    return F.regexp_replace(F.translate(text, _MARK, " "), _ANY, _GROUPS)


def label_from(groups: Column) -> Column:
    index = F.length(groups) - F.length(F.ltrim(groups, F.lit(_MARK)))
    names = F.array(*[F.lit(n) for n in FIELDS])
    return F.when(F.contains(groups, F.lit(_MARK)), F.get(names, index))


def value_from(groups: Column) -> Column:
    return F.substring_index(groups, _MARK, -1)


def extract(lines: DataFrame) -> DataFrame:
    """Labelled lines only, as ``field, raw, value, corrections``; no shuffle."""
    marked = lines.withColumn("_g", groups_of(F.col("text"))).filter(F.contains("_g", F.lit(_MARK)))
    hit = marked.select(*lines.columns, label_from(F.col("_g")).alias("field"), value_from(F.col("_g")).alias("raw"))
    valued = hit.withColumn("value", tidy(F.col("raw")))
    return valued.withColumn(
        "corrections",
        F.when(F.col("raw") != F.col("value"), F.array(F.lit("Read in capitals, with single blanks.")))
        .otherwise(F.array().cast("array<string>")),
    )


def preference() -> Column:
    """Highest confidence first (unknown counts as zero), earliest line on ties."""
    return F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("line_no"))


def best(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document and field, combined before the shuffle."""
    return (
        fields.groupBy(*keys, "field")
        .agg(F.max_by(F.struct("raw", "value", "confidence", "line_no"), preference()).alias("b"))
        .select(*keys, "field", "b.*")
    )


# One cheap test that no line without a keyword passes.
ANY_KEYWORD = "VISA|DRIV|PERMIT|PASSPORT|IDENTITY|NATIONAL"


def classify(text: Column, hint: Column | None = None) -> Column:
    """Document type by keyword; a known hint wins."""
    upper = F.upper(text)
    out = None
    for kind, pattern in KEYWORDS:
        hit = upper.rlike("(?U)" + pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    found = out.otherwise("unknown")
    if hint is None:
        return found
    return F.when(hint.isNotNull() & (hint != "unknown"), hint).otherwise(found)
