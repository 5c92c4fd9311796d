"""Golden zone texts, printed labels and the reading cascade."""

import pytest
from pyspark.sql import functions as F

from idsift.functions import mrz as M
from idsift.operators import mrz, ocr, viz

TD3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
TD1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]


def parse(spark, *cases):
    rows = [(i, *(list(c) + [None, None])[:3]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "doc_id int, r1 string, r2 string, r3 string")
    return {r.doc_id: r for r in mrz.parse(df).collect()}


def patch(line, at, text):
    return line[:at] + text + line[at + len(text):]


@pytest.fixture(scope="module")
def record(spark):
    row = spark.sql(
        "SELECT 1 AS doc_id, 'EXAMPLE' AS surname, 'ALEX' AS given_names, 'Z9000000' AS number, 'UTO' AS country, "
        "date'1988-04-12' AS dob, date'2031-10-03' AS expiry, date'2021-10-04' AS issue, 'X' AS gender"
    )
    out = mrz.encode(row, F.lit("TD3")).first()
    return [out.r1, out.r2]


def test_check_digits(spark):
    rows = spark.createDataFrame([("",), ("<<<<",), ("520727",), ("L898902C3",), ("a",), ("A B",)], "t string")
    got = [r[0] for r in rows.select(M.check_digit(F.col("t"))).collect()]
    assert got == ["0", "0", "3", "6", None, None]


def test_standard_samples(spark):
    out = parse(spark, TD3, TD1)
    for r, fmt in ((out[0], "TD3"), (out[1], "TD1")):
        assert r.fmt == fmt and r.reason is None
        assert all(c.valid for c in r.checks) and not r.limitations and not r.corrections
        assert r.f_name.corrected == "ERIKSSON ANNA MARIA"
    assert out[0].f_number.corrected == "L898902C3"
    assert out[1].f_number.corrected == "D23145890"


def test_noise_is_repaired_only_where_the_slot_allows(spark, record):
    l1, l2 = record
    wrong = str((int(l2[-1]) + 1) % 10)
    out = parse(
        spark, [l1, patch(l2, 13, "BBO4I2")], [l1, l2[:-1] + wrong], [l1, patch(l2, 6, "B")],
        [f" {l1.lower()}", l2],
    )
    dob = out[0].f_dob
    assert (dob.raw, dob.corrected) == ("BBO4I2", "880412") and all(c.valid for c in out[0].checks)
    assert "Line 2, column 14: B->8 (numeric field)." in out[0].corrections
    checks = {c.field: c.valid for c in out[1].checks}
    assert checks["composite"] is False and out[1].o2 == l2[:-1] + wrong
    assert out[2].f_number.corrected[6] == "B" and {c.field: c.valid for c in out[2].checks}["number"] is False
    assert out[3].corrections == [mrz.CLEANED_NOTE] and out[3].reason is None


def test_extended_number_is_unknown(spark):
    r = parse(spark, [patch(TD1[0], 14, "<"), *TD1[1:]])[0]
    assert r.f_number.corrected is None and r.limitations == [mrz.EXTENDED_NUMBER]
    assert r.checks[0].valid is None and r.checks[0].expected is None


def test_refused_zones(spark, record):
    l1, l2 = record
    out = parse(spark, [l1, l2[:-1]], ["V" + l1[1:], l2], [l1, patch(l2, 30, "?")], [l1], [l1, l2, l2])
    assert [out[i].reason for i in range(5)] == [
        "unsupported_length", "visa_zone", "unsupported_character", "unsupported_length", "unsupported_length",
    ]


def test_sex_marker(spark, record):
    l1, l2 = record
    out = parse(spark, [l1, patch(l2, 20, "<")], [l1, patch(l2, 20, "K")])
    assert out[0].f_gender.corrected == "X" and not out[0].limitations
    assert out[1].limitations == [mrz.BAD_SEX_MARKER]


def lines(spark, texts, which="full"):
    return spark.createDataFrame(
        [("d", which, i, t, None) for i, t in enumerate(texts)],
        "doc_id string, pass string, line_no int, text string, confidence double",
    )


@pytest.mark.parametrize("block", [1, 2, 3, 5, 65536])
def test_find_inside_noise_with_any_block_size(spark, monkeypatch, block):
    monkeypatch.setattr(mrz, "BLOCK", block)
    texts = ["HEADER", "", TD3[0], "  ", "", "", *TD3[1:], "FOOTER", "", *TD1, "END"]
    found = mrz.find(lines(spark, texts), ["doc_id"]).collect()
    assert [(r.r1, r.r2, r.r3) for r in found] == [(TD3[0], TD3[1], None)]
    led = mrz.with_next_lines(lines(spark, texts), ["doc_id"]).orderBy("line_no").collect()
    kept = [t for t in texts if t.strip()]
    assert [(r.text, r.n1, r.n2) for r in led] == [
        (t, *(kept[i + 1 : i + 3] + [None, None])[:2]) for i, t in enumerate(kept)
    ]


def test_cascade_order(spark):
    full = lines(spark, ["HEADER", *TD3])
    cases = {
        "rows": [full, lines(spark, TD3, "rows")],
        "rows_by_length": [full, lines(spark, [TD3[0], "X", TD3[1]], "rows")],
        "combined_td3": [full, lines(spark, ["X", TD3[1]], "rows")],
        "full": [full, lines(spark, ["X"], "rows")],
        "crop": [lines(spark, ["HEADER"]), lines(spark, TD3, "crop")],
    }
    for source, parts in cases.items():
        row = ocr.find_any(parts[0].unionByName(parts[1])).collect()
        assert [r.source for r in row] == [source]


def test_printed_fields_and_types(spark):
    df = lines(spark, ["VISA NUMBER: TEST42", "VISA TYPE: TOURIST", "VALID FROM: 2026-01-01", "STAY DURATION: 30 DAYS", "nothing"])
    got = {r.field: r.value for r in viz.extract(df).collect()}
    assert got == {"visa_number": "TEST42", "visa_type": "TOURIST", "valid_from": "2026-01-01", "stay_duration": "30 DAYS"}
    texts = {"PASSPORT": "passport", "VISA": "visa", "NATIONAL ID": "id", "DRIVING LICENSE": "license", "ENTRY PERMIT": "permit", "INVISAGE": "unknown"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", viz.classify(F.col("t"))).collect()} == texts


def test_split_keyword_and_corpus(spark):
    row = ocr.resolve(lines(spark, ["NATIONAL", " ID 7"])).first()
    assert row.document_type == "id" and row.ocr_status == "insufficient_evidence"
    assert row.ocr_codes == ["MRZ_NOT_EXTRACTED", "VIZ_NOT_EXTRACTED"]
    records, checks, corrections, quarantine = mrz.parse_corpus(lines(spark, TD3))
    assert (records.count(), checks.count(), corrections.count(), quarantine.count()) == (1, 5, 0, 0)
