"""Printed-versus-zone validation rules as one chain of Column expressions.

Input is one row per document: the parsed zone (``fmt``, ``f_*``, ``checks``,
``limitations``, ``corrections``; all NULL without a zone), the printed fields
``v_*`` and ``document_type``. The only join is the reference-list lookup.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from idsift import policy
from idsift.functions import dates as D
from idsift.functions.tables import explode_rows
from idsift.operators import lists

FINDINGS = "array<struct<code:string,severity:string,field:string,detail:string>>"
COMPARED = ("dob", "expiry", "name", "number")

# Finding code -> severity.
SEVERITY = {
    "MRZ_UNAVAILABLE": "info",
    "MRZ_CHECK_FAILED": "medium",
    "MRZ_VARIANT_UNSUPPORTED": "info",
    "MRZ_OCR_CORRECTED": "low",
    "DATE_UNREADABLE": "medium",
    "INVALID_MRZ_DATE": "medium",
    "EXPIRY_CENTURY_INFERRED": "info",
    "DOB_CENTURY_AMBIGUOUS": "info",
    "FIELD_MISMATCH": "medium",
    "DOCUMENT_EXPIRED": "medium",
    "EXPIRY_IMPLAUSIBLE": "medium",
    "DOB_IMPLAUSIBLE": "medium",
    "CROSS_CHECK_INCOMPLETE": "info",
    "ISSUE_EXPIRY_ORDER": "medium",
    "FUTURE_ISSUE": "medium",
    "ISSUE_BEFORE_BIRTH": "medium",
    "VISA_WINDOW_INVALID": "medium",
    "VISA_NOT_YET_VALID": "medium",
    "VISA_ENTRY_WINDOW_EXPIRED": "medium",
    "VISA_STAY_INVALID": "medium",
    "VISA_STAY_POLICY_REVIEW": "info",
    "COUNTRY_CODE_UNKNOWN": "medium",
    "NUMBER_FORMAT": "medium",
    "COUNTRY_NUMBER_FORMAT": "medium",
    "LOOKUP_UNAVAILABLE": "info",
    "MOCK_BLACKLIST_HIT": "high",
    "PREVIOUSLY_SEEN": "info",
}


def country_codes(spark: SparkSession) -> list[str]:
    """ISO 3166-1 alpha-3 codes as the JVM knows them, plus the extra codes."""
    locale = spark.sparkContext._jvm.java.util.Locale
    iso = locale.getISOCountries(getattr(locale, "IsoCountryCode").PART1_ALPHA3)
    return sorted(set(iso) | set(policy.EXTRA_COUNTRY_CODES))


def _finding(code: str, field: str | None, test: Column, detail: Column | None = None) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(SEVERITY[code]).alias("severity"),
            F.lit(field).cast("string").alias("field"),
            (detail if detail is not None else F.lit(None).cast("string")).alias("detail"),
        ),
    )


def normalize(text: Column, kind: str) -> Column:
    """Comparable form: names as a sorted bag of words, the rest without blanks."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " "), " +", " "))
    if kind == "name":
        return F.array_join(F.array_sort(F.split(words, " ")), " ")
    return F.translate(words, " ", "")


def _zone(name: str) -> Column:
    return F.nullif(F.col(f"f_{name}.corrected"), F.lit(""))


def _printed(name: str) -> Column:
    return F.nullif(F.col(f"v_{name}"), F.lit(""))


def observed(df: DataFrame, reference: Column) -> DataFrame:
    """Plain columns for every observed value and date candidate."""
    base = df.select(
        "*",
        reference.alias("ref"),
        *[_zone(n).alias(f"m_{n}") for n in ("dob", "expiry", "name", "number", "issuing_country", "nationality")],
        *[_printed(n).alias(f"p_{n}") for n in ("dob", "expiry", "name", "number", "issue", "valid_from", "valid_until", "stay_duration")],
    )
    return base.select(
        "*",
        *[
            D.parse_printed(F.col(f"p_{n}")).alias(f"d_{n}")
            for n in ("dob", "expiry", "issue", "valid_from", "valid_until")
        ],
        *[
            F.coalesce(
                D.century_candidates(F.col(f"m_{n}"), F.col("ref")), F.array().cast("array<date>")
            ).alias(f"all_{n}")
            for n in ("dob", "expiry")
        ],
    )


def resolve_dob(df: DataFrame) -> DataFrame:
    """Plausible birth dates; a single one, or the printed one, resolves."""
    ref = F.col("ref")
    plausible = F.filter(
        F.col("all_dob"),
        lambda d: (d <= ref) & (D.age_on(ref, d) <= policy.VALIDATION_RULES["max_age"]),
    )
    with_candidates = df.withColumn("cand_dob", plausible)
    printed = F.array_contains(F.col("cand_dob"), F.col("d_dob"))
    return with_candidates.withColumn(
        "src_dob",
        F.when(printed, F.col("d_dob")).when(F.size("cand_dob") == 1, F.col("cand_dob")[0]),
    ).withColumn("dob_ambiguous", F.col("src_dob").isNull() & (F.size("cand_dob") > 1))


def resolve_expiry(df: DataFrame) -> DataFrame:
    """The printed expiry if it is a candidate, else the nearest candidate."""
    nearest = F.array_min(
        F.transform(
            F.col("all_expiry"),
            lambda d: F.struct(F.abs(F.date_diff(d, F.col("ref"))).alias("gap"), d.alias("d")),
        )
    )["d"]
    printed = F.coalesce(F.array_contains(F.col("all_expiry"), F.col("d_expiry")), F.lit(False))
    return df.withColumn("src_expiry", F.when(printed, F.col("d_expiry")).otherwise(nearest)).withColumn(
        "expiry_inferred", ~printed & (F.size("all_expiry") > 0)
    )


def cross_checks(df: DataFrame) -> DataFrame:
    """Tri-state comparison per field: NULL when a side is missing."""
    dob = F.when(
        F.col("m_dob").isNotNull() & F.col("d_dob").isNotNull() & (F.size("cand_dob") > 0),
        F.array_contains("cand_dob", F.col("d_dob")),
    )
    expiry = F.when(
        F.col("m_expiry").isNotNull() & F.col("d_expiry").isNotNull() & (F.size("all_expiry") > 0),
        F.array_contains("all_expiry", F.col("d_expiry")),
    )
    text = {
        n: F.when(
            F.col(f"m_{n}").isNotNull() & F.col(f"p_{n}").isNotNull(),
            normalize(F.col(f"m_{n}"), n) == normalize(F.col(f"p_{n}"), n),
        )
        for n in ("name", "number")
    }
    return df.select(
        "*", dob.alias("x_dob"), expiry.alias("x_expiry"), text["name"].alias("x_name"),
        text["number"].alias("x_number"),
        F.coalesce("src_dob", "d_dob").alias("resolved_dob"),
        F.coalesce("src_expiry", "d_expiry").alias("resolved_expiry"),
    )


def _observed_twice(name: str) -> list[Column]:
    """The resolved date, and the printed one where it is a different date."""
    src, printed = F.col(f"src_{name}"), F.col(f"d_{name}")
    return [src, F.when(~printed.eqNullSafe(src), printed)]


def date_findings(name: str) -> list[Column]:
    ref = F.col("ref")
    out = [
        _finding("DATE_UNREADABLE", name, F.col(f"p_{name}").isNotNull() & F.col(f"d_{name}").isNull()),
        _finding("INVALID_MRZ_DATE", name, F.col(f"m_{name}").isNotNull() & (F.size(f"all_{name}") == 0)),
        _finding("FIELD_MISMATCH", name, F.col(f"x_{name}") == F.lit(False)),
    ]
    for day in _observed_twice(name):
        text = day.cast("string")
        if name == "expiry":
            horizon = F.year(ref) + policy.VALIDATION_RULES["max_expiry_horizon_years"]
            out.append(_finding("DOCUMENT_EXPIRED", name, day < ref, text))
            out.append(_finding("EXPIRY_IMPLAUSIBLE", name, F.year(day) > horizon, text))
        else:
            too_old = D.age_on(ref, day) > policy.VALIDATION_RULES["max_age"]
            out.append(_finding("DOB_IMPLAUSIBLE", name, (day > ref) | too_old, text))
    if name == "expiry":
        out.append(_finding("EXPIRY_CENTURY_INFERRED", name, F.col("expiry_inferred")))
    else:
        out.append(_finding("DOB_CENTURY_AMBIGUOUS", name, F.col("dob_ambiguous")))
    return out


def issue_findings() -> list[Column]:
    issue = F.col("d_issue")
    return [
        _finding("DATE_UNREADABLE", "issue", F.col("p_issue").isNotNull() & issue.isNull()),
        _finding("ISSUE_EXPIRY_ORDER", "issue", issue >= F.col("resolved_expiry")),
        _finding("FUTURE_ISSUE", "issue", issue > F.col("ref")),
        _finding("ISSUE_BEFORE_BIRTH", "issue", issue < F.col("resolved_dob")),
    ]


def visa_findings() -> list[Column]:
    start, end, ref = F.col("d_valid_from"), F.col("d_valid_until"), F.col("ref")
    stay = F.trim(F.col("p_stay_duration"))
    # Leading zeros aside, nineteen digits or more exceed any window.
    digits = F.regexp_extract(stay, r"(?i)^0*(\d*)\s*(?:DAYS?)?$", 1)
    shaped = stay.rlike(r"(?i)^\d+\s*(?:DAYS?)?$")
    positive = shaped & (F.length(digits) > 0)
    longer = (F.length(digits) > 9) | (
        F.coalesce(F.substring(digits, 1, 9).try_cast("int"), F.lit(0)) > F.date_diff(end, start) + 1
    )
    return [
        _finding("DATE_UNREADABLE", "valid_from", F.col("p_valid_from").isNotNull() & start.isNull()),
        _finding("DATE_UNREADABLE", "valid_until", F.col("p_valid_until").isNotNull() & end.isNull()),
        _finding("VISA_WINDOW_INVALID", None, start > end),
        _finding("VISA_NOT_YET_VALID", None, ref < start),
        _finding("VISA_ENTRY_WINDOW_EXPIRED", None, ref > end),
        _finding("VISA_STAY_INVALID", None, stay.isNotNull() & ~positive),
        _finding(
            "VISA_STAY_POLICY_REVIEW", None,
            positive & start.isNotNull() & end.isNotNull() & longer,
        ),
    ]


def country_findings(codes: list[str]) -> list[Column]:
    return [
        _finding("COUNTRY_CODE_UNKNOWN", name, ~F.col(f"m_{name}").isin(codes), F.col(f"m_{name}"))
        for name in ("issuing_country", "nationality")
    ]


def number_findings(patterns: dict[str, str]) -> list[Column]:
    number, country = F.col("number"), F.col("country")
    broken = F.lit(False)
    for code, pattern in patterns.items():
        broken = broken | ((country == code) & ~number.rlike(rf"^(?:{pattern})\z"))
    return [
        _finding("NUMBER_FORMAT", "number", ~number.rlike(r"^[A-Z0-9]{5,20}\z")),
        _finding(
            "COUNTRY_NUMBER_FORMAT", "number",
            number.isNotNull() & (F.col("document_type") == "passport") & F.coalesce(broken, F.lit(False)),
        ),
    ]


def zone_findings() -> Column:
    """Array of findings that come straight from the parsed zone."""
    has_zone = F.col("fmt").isNotNull()
    empty = F.array().cast(FINDINGS)

    def of(code: str, field: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"),
            field.alias("field"), detail.alias("detail"),
        )

    failed = F.transform(
        F.filter("checks", lambda c: ~c["valid"]),
        lambda c: of(
            "MRZ_CHECK_FAILED", c["field"],
            F.concat(F.lit("observed "), c["observed"], F.lit(", expected "), c["expected"]),
        ),
    )
    variants = F.transform(
        "limitations", lambda t: of("MRZ_VARIANT_UNSUPPORTED", F.lit(None).cast("string"), t)
    )
    single = F.array_compact(
        F.array(
            _finding("MRZ_UNAVAILABLE", None, ~has_zone),
            _finding("MRZ_OCR_CORRECTED", None, has_zone & (F.size("corrections") > 0)),
        )
    )
    return F.concat(F.coalesce(failed, empty), F.coalesce(variants, empty), single)


# The codes of the rules that belong together.
ZONE_CODES = ("MRZ_UNAVAILABLE", "MRZ_CHECK_FAILED", "MRZ_VARIANT_UNSUPPORTED", "MRZ_OCR_CORRECTED")
DATE_CODES = (
    "DATE_UNREADABLE", "INVALID_MRZ_DATE", "FIELD_MISMATCH", "DOCUMENT_EXPIRED", "EXPIRY_IMPLAUSIBLE",
    "DOB_IMPLAUSIBLE", "EXPIRY_CENTURY_INFERRED", "DOB_CENTURY_AMBIGUOUS",
)
ISSUE_CODES = ("DATE_UNREADABLE", "ISSUE_EXPIRY_ORDER", "FUTURE_ISSUE", "ISSUE_BEFORE_BIRTH")
VISA_CODES = (
    "DATE_UNREADABLE", "VISA_WINDOW_INVALID", "VISA_NOT_YET_VALID", "VISA_ENTRY_WINDOW_EXPIRED",
    "VISA_STAY_INVALID", "VISA_STAY_POLICY_REVIEW",
)
LOOKUP_CODES = ("LOOKUP_UNAVAILABLE", "MOCK_BLACKLIST_HIT", "PREVIOUSLY_SEEN")


def _reference(reference: Column | None) -> Column:
    return reference if reference is not None else F.lit(policy.REFERENCE_DATE).cast("date")


def _compared(records: DataFrame, ref: Column) -> DataFrame:
    seen = cross_checks(resolve_expiry(resolve_dob(observed(records, ref))))
    return seen.select(
        "*", F.col("m_issuing_country").alias("country"),
        F.coalesce("m_number", "p_number").alias("number"),
    )


def _rules(codes: list[str], patterns: dict[str, str] | None, only: Collection[str] | None = None) -> list[Column]:
    """The findings of all rules but the zone's own; with ``only``, of those alone that can
    have one of these codes, so that what the others read is not computed."""
    compared = [F.col(f"x_{n}") for n in COMPARED]
    any_null = compared[0].isNull()
    for c in compared[1:]:
        any_null = any_null | c.isNull()
    groups = [
        (DATE_CODES, [*date_findings("dob"), *date_findings("expiry")]),
        (("FIELD_MISMATCH",), [
            _finding("FIELD_MISMATCH", "name", ~F.col("x_name")),
            _finding("FIELD_MISMATCH", "number", ~F.col("x_number")),
        ]),
        (("CROSS_CHECK_INCOMPLETE",), [_finding("CROSS_CHECK_INCOMPLETE", None, any_null)]),
        (ISSUE_CODES, issue_findings()),
        (VISA_CODES, visa_findings()),
        (("COUNTRY_CODE_UNKNOWN",), country_findings(codes)),
        (("NUMBER_FORMAT", "COUNTRY_NUMBER_FORMAT"), number_findings(policy.NUMBER_PATTERNS if patterns is None else patterns)),
        (LOOKUP_CODES, [
            _finding("LOOKUP_UNAVAILABLE", None, ~F.col("database_available")),
            _finding("MOCK_BLACKLIST_HIT", None, F.col("blacklist_hit")),
            _finding(
                "PREVIOUSLY_SEEN", None, F.col("previously_seen") > 0, F.col("previously_seen").cast("string")
            ),
        ]),
    ]
    return [r for its, rules in groups if only is None or set(its) & set(only) for r in rules]


def findings_of(
    records: DataFrame,
    ref_list: DataFrame | None,
    codes: list[str],
    only: Collection[str],
    reference: Column | None = None,
    patterns: dict[str, str] | None = None,
) -> DataFrame:
    """``findings(run(...))`` of the codes in ``only``, with no work for the other rules;
    the reference list is read for its own codes alone."""
    compared = _compared(records, _reference(reference))
    if set(only) & set(LOOKUP_CODES):
        compared = lists.lookup(compared, ref_list)
    found = F.array_compact(F.array(*_rules(codes, patterns, only)).cast(FINDINGS))
    if set(only) & set(ZONE_CODES):
        found = F.concat(zone_findings(), found)
    return findings(compared.select("doc_id", found.alias("findings"))).filter(F.col("code").isin(*only))


def run(
    records: DataFrame,
    ref_list: DataFrame | None,
    codes: list[str],
    reference: Column | None = None,
    patterns: dict[str, str] | None = None,
) -> DataFrame:
    """Full rule set: one row per document with ``findings`` and tri-state results."""
    ref = _reference(reference)
    looked = lists.lookup(_compared(records, ref), ref_list)
    compared = [F.col(f"x_{n}") for n in COMPARED]
    rules = _rules(codes, patterns)
    mismatches = sum(
        (F.coalesce((~c).cast("int"), F.lit(0)) for c in compared[1:]),
        F.coalesce((~compared[0]).cast("int"), F.lit(0)),
    )
    keep = [c for c in records.columns if c not in ("o1", "o2", "o3")]
    return looked.select(
        *keep,
        *[f"x_{n}" for n in COMPARED],
        *[f"m_{n}" for n in COMPARED],
        *[f"p_{n}" for n in COMPARED],
        "country",
        "number",
        "resolved_dob",
        "resolved_expiry",
        "database_available",
        "blacklist_hit",
        "previously_seen",
        ref.cast("string").alias("reference_date"),
        mismatches.alias("mismatch_count"),
        F.concat(zone_findings(), F.array_compact(F.array(*rules))).alias("findings"),
        F.when(F.col("fmt").isNotNull() & (F.size("limitations") == 0), "ok")
        .otherwise("insufficient_evidence")
        .alias("validation_status"),
    )


def findings(validated: DataFrame) -> DataFrame:
    """Long form: one row per finding."""
    return explode_rows(validated, ["doc_id"], "findings")


def comparisons(validated: DataFrame) -> DataFrame:
    """Long form: one row per compared field."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"), F.col(f"m_{n}").alias("mrz_value"),
                F.col(f"p_{n}").alias("viz_value"), F.col(f"x_{n}").alias("consistent"),
            )
            for n in COMPARED
        ]
    )
    return explode_rows(validated.select("doc_id", rows.alias("c")), ["doc_id"], "c")
