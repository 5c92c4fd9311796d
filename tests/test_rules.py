"""Golden validation outcomes, lookups, constraints."""

import pytest
from pyspark.sql import functions as F

from idsift.operators import lists, mrz, ocr, quality, validation
from idsift.policy import RiskPolicy
from idsift.operators import risk

BASE = {
    "surname": "EXAMPLE", "given_names": "ALEX", "number": "Z9000000", "country": "UTO", "dob": "1988-04-12",
    "expiry": "2031-10-03", "gender": "X",
}
PRINTED = {"NAME": "EXAMPLE ALEX", "DOCUMENT NUMBER": "Z9000000", "DATE OF BIRTH": "1988-04-12", "DATE OF EXPIRY": "2031-10-03", "DATE OF ISSUE": "2021-10-04"}
# name -> (changes to the encoded record, changes to the printed fields, edit of line two)
CASES = {
    "plain": ({}, {}, None),
    "printed_dob": ({}, {"DATE OF BIRTH": "1998-04-12"}, None),
    "expired": ({"expiry": "2020-10-03"}, {"DATE OF EXPIRY": "2020-10-03"}, None),
    "bad_date": ({}, {}, (13, "881332")),
    "future_birth": ({}, {"DATE OF BIRTH": "2030-04-12"}, None),
    "century": ({"dob": "2010-04-12"}, {"DATE OF BIRTH": None}, None),
    "nothing_printed": ({}, dict.fromkeys(PRINTED), None),
    "listed": ({"number": "Z9000001"}, {"DOCUMENT NUMBER": "Z9000001"}, None),
    "seen": ({"number": "Z9000002"}, {"DOCUMENT NUMBER": "Z9000002"}, None),
    "country": ({"country": "ZZZ"}, {}, None),
    "short_number": ({"number": "12345"}, {}, None),
    "check_digit": ({}, {}, (43, "?")),
}
VISA = ["VALID FROM: 2026-10-01", "VALID UNTIL: 2026-10-10", "STAY DURATION: 30 DAYS"]


@pytest.fixture(scope="module")
def reference_list(spark):
    raw = spark.createDataFrame(
        [("UTO", "Z9000001", True, 2), ("UTO", "Z9000002", False, 3)], "c string, n string, blacklisted boolean, seen_count int"
    )
    return raw.select(lists.document_key(F.col("c"), F.col("n")).alias("document_key"), "blacklisted", "seen_count")


@pytest.fixture(scope="module")
def documents(spark):
    ids = spark.createDataFrame(
        [tuple({"case": k, **BASE, **v[0]}.values()) for k, v in CASES.items()],
        "`case` string, surname string, given_names string, number string, country string, dob string, expiry string, gender string",
    ).withColumn("dob", F.col("dob").cast("date")).withColumn("expiry", F.col("expiry").cast("date"))
    rows = []
    for r in mrz.encode(ids, F.lit("TD3")).collect():
        _, printed, edit = CASES[r["case"]]
        second = r.r2
        if edit:
            at, text = edit
            text = str((int(second[at]) + 1) % 10) if text == "?" else text
            second = second[:at] + text + second[at + len(text):]
        texts = ["PASSPORT", *[f"{k}: {v}" for k, v in {**PRINTED, **printed}.items() if v], r.r1, second]
        rows += [(r["case"], "full", i, t, 0.9) for i, t in enumerate(texts)]
    rows += [("visa", "full", i, t, 0.9) for i, t in enumerate(["VISA", *VISA])]
    df = spark.createDataFrame(rows, "doc_id string, pass string, line_no int, text string, confidence double")
    return ocr.resolve(df)


@pytest.fixture(scope="module")
def outcome(spark, documents, reference_list):
    rows = validation.run(documents, reference_list, validation.country_codes(spark)).collect()
    return {r.doc_id: r for r in rows}


def codes(row):
    return {f.code for f in row.findings}


def test_plain(outcome):
    r = outcome["plain"]
    assert r.validation_status == "ok" and r.mismatch_count == 0 and r.blacklist_hit is False
    assert str(r.resolved_dob) == "1988-04-12" and not {f.severity for f in r.findings} & {"medium", "high"}


@pytest.mark.parametrize(
    "case,expected",
    [
        ("printed_dob", {"FIELD_MISMATCH"}), ("expired", {"DOCUMENT_EXPIRED", "ISSUE_EXPIRY_ORDER"}),
        ("bad_date", {"INVALID_MRZ_DATE"}), ("future_birth", {"DOB_IMPLAUSIBLE"}),
        ("century", {"DOB_CENTURY_AMBIGUOUS"}), ("nothing_printed", {"CROSS_CHECK_INCOMPLETE"}),
        ("listed", {"MOCK_BLACKLIST_HIT", "PREVIOUSLY_SEEN"}), ("country", {"COUNTRY_CODE_UNKNOWN"}),
        ("short_number", {"COUNTRY_NUMBER_FORMAT"}), ("check_digit", {"MRZ_CHECK_FAILED"}),
        ("visa", {"VISA_STAY_POLICY_REVIEW", "MRZ_UNAVAILABLE", "LOOKUP_UNAVAILABLE"}),
    ],
)
def test_findings(outcome, case, expected):
    assert expected <= codes(outcome[case])


def test_details(outcome):
    assert outcome["printed_dob"].mismatch_count == 1
    assert outcome["century"].resolved_dob is None
    assert all(outcome["nothing_printed"][f"x_{n}"] is None for n in validation.COMPARED)
    assert (outcome["listed"].blacklist_hit, outcome["listed"].previously_seen) == (True, 2)
    assert (outcome["seen"].blacklist_hit, outcome["seen"].previously_seen) == (False, 3)
    assert outcome["check_digit"].validation_status == "ok"
    assert outcome["visa"].document_type == "visa" and outcome["visa"].blacklist_hit is None


def test_absent_list_answers_nothing(spark, documents):
    rows = validation.run(documents, None, validation.country_codes(spark)).collect()
    assert all(r.blacklist_hit is None and r.previously_seen is None for r in rows)
    assert all("LOOKUP_UNAVAILABLE" in codes(r) for r in rows)


def test_country_codes(spark):
    known = validation.country_codes(spark)
    assert {"DEU", "USA", "UTO", "D", "XXX"} <= set(known) and "ZZZ" not in known and len(known) > 250


def test_insert_missing(spark, reference_list):
    incoming = reference_list.limit(1).withColumn("seen_count", F.lit(99)).unionByName(
        spark.createDataFrame([("new", False, 1), ("new", False, 1)], reference_list.schema)
    )
    fresh = lists.insert_missing(reference_list, incoming).collect()
    assert [r.document_key for r in fresh] == ["new"]


def test_regions(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.5], [0.0, 0.0, 0.5, -0.1], [-0.1, 0.0, 0.5, 0.5], [0.6, 0.0, 0.5, 0.5],
           [0.0, 0.6, 0.5, 0.5], [nan, 0.0, 0.5, 0.5], [0.0, 0.0, inf, 0.5], [0.0, 0.0, 0.5, 0.5, 0.5]]
    rows = spark.createDataFrame([(r,) for r in [[0.0, 0.0, 1.0, 1.0], *bad]], "r array<double>")
    got = [r[0] for r in rows.select(quality.valid_region(F.col("r"))).collect()]
    assert got == [True] + [False] * len(bad)


# ------------------------------------------------------------------------ risk
NAMES = list(RiskPolicy().weights)


def score(spark, **values):
    """Signals by name; a value may be a pair with its completeness."""
    rows = []
    for n, v in values.items():
        value, complete = v if isinstance(v, tuple) else (v, True)
        rows.append((1, n, value, complete, "Controlled evidence.", "test", False))
    df = spark.createDataFrame(
        rows, "doc_id int, name string, value double, complete boolean, explanation string, source string, experimental boolean"
    )
    return risk.score(df).first()


def complete(**changes):
    return {**{n: 0.0 for n in NAMES}, **changes}


def test_no_evidence(spark):
    r = risk.score_wide(spark.createDataFrame([(1,)], "doc_id int")).first()
    assert r.score is None and r.category is None and (r.score_lo, r.score_hi) == (0, 100)
    assert r.coverage == 0 and r.risk_status == "insufficient_evidence" and r.missing_signals == NAMES


@pytest.mark.parametrize(
    "changes,total,category",
    [({}, 0, "Low"), ({"mrz": 1.0}, 8, "Low"), ({"face": 1.0}, 15, "Medium"), ({"blacklist": 1.0}, 35, "High"), ({n: 1.0 for n in NAMES}, 100, "High")],
)
def test_boundaries(spark, changes, total, category):
    r = score(spark, **complete(**changes))
    assert (r.score, r.category, r.score_lo, r.score_hi, r.coverage) == (total, category, total, total, 1)
    assert sum(c.points for c in r.contributions) == total and r.risk_status == "ok"
    if not changes:
        assert r.reasons == [risk.NO_POSITIVE]


def test_gaps(spark):
    r = score(spark, blacklist=1.0)
    assert (r.score, r.category, r.score_lo, r.score_hi, r.risk_status) == (35, "High", 35, 100, "insufficient_evidence")
    r = score(spark, **complete(face=(None, False)))
    assert r.category is None and (r.score_lo, r.score_hi) == (0, 15) and r.coverage == 0.85 and r.missing_required == ["face"]
    r = score(spark, **complete(tampering=(0.3, False)))
    assert r.score == 1.5 and (r.score_lo, r.score_hi) == (1.5, 5) and r.category is None
    r = score(spark, face=(None, True))
    assert r.score is None and "face" in r.missing_required
    r = score(spark, liveness=(0.5, False))
    assert r.score == 2 and "liveness" in r.missing_required
    assert r.reasons[0] == "liveness: +2.00/4 points. Controlled evidence."


def test_invalid_values_are_quarantined(spark):
    rows = [(1, "mrz", v, True) for v in (-0.1, 1.01, float("nan"), float("inf"), 0.5, None)] + [(1, "other", 0.1, True)]
    good, bad = risk.constraints(spark.createDataFrame(rows, "doc_id int, name string, value double, complete boolean"))
    assert (good.count(), bad.count()) == (2, 5)


@pytest.mark.parametrize(
    "changes",
    [
        {"weights": {"mrz": 100}}, {"weights": {**RiskPolicy().weights, "mrz": 9}}, {"medium_threshold": 40.0},
        {"required_signals": []}, {"required_signals": ["mrz", "mrz"]}, {"version": ""},
        {"weights": {**RiskPolicy().weights, "mrz": -1, "face": 24}}, {"high_threshold": 101.0},
    ],
)
def test_policy_refuses(changes):
    with pytest.raises(ValueError):
        RiskPolicy(**changes)


def test_policy_digest():
    assert RiskPolicy().digest == RiskPolicy().digest != RiskPolicy(version="other").digest


def test_findings_of_some_codes(spark, documents, reference_list):
    known = validation.country_codes(spark)
    every = validation.findings(validation.run(documents, reference_list, known)).select("doc_id", "code", "field", "detail")
    want = [tuple(r) for r in every.collect()]
    for only in (["COUNTRY_CODE_UNKNOWN"], ["DATE_UNREADABLE", "PREVIOUSLY_SEEN", "MRZ_CHECK_FAILED"]):
        got = validation.findings_of(documents, reference_list, known, only).select("doc_id", "code", "field", "detail")
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(r) for r in want if r[1] in only)


def test_country_rule_reads_stored_lines_and_no_list(spark, sf_dir):
    from idsift.plans import records

    files = records.QUERIES["j2_unknown_country"](spark, sf_dir).inputFiles()
    assert files and not any("customer" in f for f in files)
