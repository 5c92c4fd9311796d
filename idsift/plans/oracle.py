"""DuckDB SQL that checks the queries: named common table expressions.

Each expression states its result independently of the Spark operators; only
the derived input views and the fixed layout tables are shared.
"""

from __future__ import annotations

import re

from idsift.operators import mrz, viz
from idsift.plans import views
from idsift.policy import EXTRA_COUNTRY_CODES, REFERENCE_DATE

CTES: dict[str, str] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def define(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def query(final: str, **local: str) -> str:
    """``final`` preceded by every expression it needs, in dependency order."""
    pool = {**CTES, **local}
    ordered: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text, flags=re.I):
            if name in pool and name not in entered:
                entered.add(name)
                visit(pool[name])
                ordered.append(name)

    visit(final)
    if not ordered:
        return final.strip()
    return "WITH " + ",\n".join(f"{n} AS ({pool[n]})" for n in ordered) + "\n" + final.strip()


def check_digit(x: str) -> str:
    return (
        "CAST(CAST(coalesce(list_sum(list_transform(range(1, length(" + x + ") + 1), lambda i: "
        "greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(" + x + ", i, 1)) - 1, 0) * "
        "CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END)), 0) AS BIGINT) % 10 AS VARCHAR)"
    )


def clean(x: str) -> str:
    return rf"upper(regexp_replace({x}, '\s+', '', 'g'))"


_names = {t: t for t in TABLES}
define("ids", views.IDS_SQL.format(**_names))
define("ref_raw", views.REF_SQL.format(**_names))
define("ref_list", "SELECT sha256(country || ':' || number) AS document_key, blacklisted, seen_count FROM ref_raw")
define("scored", views.SCORED_SQL.format(**_names))
define("log_scans", views.SCANS_SQL.format(**_names))
define("log_decisions", views.DECISIONS_SQL.format(**_names))
define("manifest", views.MANIFEST_SQL.format(**_names))
define("cells", views.CELLS_SQL.format(**_names))
define("glyphs", views.GLYPHS_SQL.format(**_names))
define("features", views.FEATURES_SQL.format(**_names))
define("frames", views.FRAMES_SQL.format(**_names))
define(
    "signals",
    """
SELECT c_custkey AS doc_id, s.name,
  CASE WHEN (c_custkey + s.k) % 7 = 0 THEN NULL WHEN (c_custkey * s.k) % 11 = 0 THEN CAST(1.0 AS DOUBLE)
       WHEN (c_custkey * s.k) % 13 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS value,
  (c_custkey + s.k) % 7 <> 0 AND NOT (s.k = 8 AND c_custkey % 2 = 0) AS complete
FROM customer CROSS JOIN (VALUES ('blacklist',1),('duplicate_identity',2),('face',3),('mrz',4),('cross_fields',5),
  ('dates',6),('tampering',7),('liveness',8),('metadata',9),('format',10)) AS s(name, k)""",
)
define(
    "detectors",
    f"""
SELECT p_partkey AS doc_id, s.name,
  CASE WHEN (p_partkey * s.k + s.k) % 23 = 0 THEN 'unavailable' ELSE 'ok' END AS status,
  CASE WHEN (p_partkey * s.k + s.k) % 23 <> 0 THEN CAST((p_partkey * (s.k + 6)) % 101 AS DOUBLE) / 100 END AS score
FROM part CROSS JOIN (VALUES {', '.join(f"('{n}',{k})" for k, n in enumerate(views.DETECTOR_NAMES, 1))}) AS s(name, k)""",
)

# ------------------------------------------------------------------ encoding
define(
    "zone0",
    """
SELECT *, CASE (doc_id // 20) % 3 WHEN 0 THEN 'TD3' WHEN 1 THEN 'TD1' ELSE 'TD2' END AS fmt,
  rpad(number, 9, '<') AS num, strftime(dob, '%y%m%d') AS db, strftime(expiry, '%y%m%d') AS ex,
  CASE WHEN gender IN ('M', 'F') THEN gender ELSE '<' END AS sx,
  replace(surname, ' ', '<') || '<<' || replace(given_names, ' ', '<') AS nm
FROM ids""",
)
define(
    "zone1",
    f"""
SELECT *,
  CASE fmt WHEN 'TD1' THEN 'I<' || country || num || {check_digit('num')} || repeat('<', 15)
           WHEN 'TD3' THEN 'P<' || country || rpad(nm, 39, '<')
           ELSE 'I<' || country || rpad(nm, 31, '<') END AS a,
  CASE fmt WHEN 'TD1' THEN db || {check_digit('db')} || sx || ex || {check_digit('ex')} || country || repeat('<', 11)
           ELSE num || {check_digit('num')} || country || db || {check_digit('db')} || sx || ex || {check_digit('ex')}
                || CASE fmt WHEN 'TD3' THEN repeat('<', 14) || '0' ELSE repeat('<', 7) END END AS b
FROM zone0""",
)
define(
    "zone2",
    """
SELECT *, CASE fmt WHEN 'TD1' THEN substr(a, 6, 25) || substr(b, 1, 7) || substr(b, 9, 7) || substr(b, 19, 11)
  ELSE substr(b, 1, 10) || substr(b, 14, 7) || substr(b, 22) END AS covered FROM zone1""",
)
define(
    "encoded",
    f"""
SELECT doc_id, surname, given_names, number, country, dob, expiry, issue, gender, variant, fmt,
  a AS r1, b || {check_digit('covered')} AS r2, CASE fmt WHEN 'TD1' THEN rpad(nm, 30, '<') END AS r3 FROM zone2""",
)
define(
    "zones",
    """
SELECT doc_id, surname, given_names, number, country, dob, expiry, issue, gender, variant, fmt,
  CASE WHEN variant = 4 THEN lower(substr(r1, 1, 5) || ' ' || substr(r1, 6))
       WHEN variant = 6 THEN 'V' || substr(r1, 2)
       WHEN variant = 10 AND fmt <> 'TD1' THEN substr(r1, 1, 5) || translate(substr(r1, 6), 'OI', '01')
       WHEN variant = 12 AND fmt = 'TD1' THEN substr(r1, 1, 14) || '<' || substr(r1, 16)
       ELSE r1 END AS r1,
  CASE WHEN variant = 1 THEN substr(r2, 1, length(r2) - 1) || CAST((CAST(right(r2, 1) AS INT) + 1) % 10 AS VARCHAR)
       WHEN variant = 2 AND fmt = 'TD1' THEN replace(substr(r2, 1, 6), '0', 'O') || substr(r2, 7)
       WHEN variant = 2 THEN substr(r2, 1, 13) || replace(substr(r2, 14, 6), '0', 'O') || substr(r2, 20)
       WHEN variant = 4 THEN lower(substr(r2, 1, 5) || ' ' || substr(r2, 6))
       WHEN variant = 5 THEN substr(r2, 1, length(r2) - 1)
       WHEN variant = 11 AND fmt = 'TD1' THEN substr(r2, 1, 7) || 'K' || substr(r2, 9)
       WHEN variant = 11 THEN substr(r2, 1, 20) || 'K' || substr(r2, 22)
       WHEN variant = 12 AND fmt <> 'TD1' THEN substr(r2, 1, 9) || '<' || substr(r2, 11)
       ELSE r2 END AS r2,
  CASE WHEN variant = 4 THEN lower(substr(r3, 1, 5) || ' ' || substr(r3, 6))
       WHEN variant = 10 THEN translate(r3, 'OI', '01') ELSE r3 END AS r3
FROM encoded""",
)

# --------------------------------------------------------------------- lines


def printed_date(x: str) -> str:
    return (
        f"CASE doc_id % 5 WHEN 0 THEN strftime({x}, '%Y-%m-%d') WHEN 1 THEN strftime({x}, '%-d %b %Y') "
        f"WHEN 2 THEN strftime({x}, '%d/%m/%Y') WHEN 3 THEN strftime({x}, '%d.%m.%Y') "
        f"ELSE upper(strftime({x}, '%-d %B %Y')) END"
    )


_DOB = "CASE WHEN variant = 0 THEN CAST(dob + INTERVAL 10 YEAR AS DATE) ELSE dob END"
_EXP = "CASE WHEN variant = 7 THEN DATE '2020-10-03' ELSE expiry END"
_HEADER = (
    "CASE WHEN variant = 8 THEN 'VISA' WHEN doc_id % 9 = 4 THEN 'SPECIMEN' WHEN fmt = 'TD3' THEN 'PASSPORT' "
    "WHEN fmt = 'TD1' THEN 'NATIONAL' WHEN doc_id % 2 = 0 THEN 'DRIVING LICENCE' ELSE 'ENTRY PERMIT' END"
)
_LINES = [
    ("full", 0, _HEADER, "true"),
    ("full", 1, "'ID CARD'", f"fmt = 'TD1' AND {_HEADER} = 'NATIONAL'"),
    ("full", 2, "'Name:  ' || surname || '  ' || given_names", "variant <> 3"),
    ("full", 3, "'  Document No. ' || number", "variant <> 3"),
    ("full", 4, "'NATIONALITY - ' || country", "variant <> 3"),
    ("full", 5, f"'Date of Birth: ' || CASE WHEN doc_id % 37 = 0 THEN '31.02.1990' ELSE {printed_date(_DOB)} END", "variant <> 3"),
    ("full", 6, f"'EXPIRY: ' || {printed_date(_EXP)}", "variant <> 3"),
    ("full", 7, f"'Date of issue: ' || {printed_date('issue')}", "variant <> 3"),
    ("full", 8, "'SEX: ' || gender", "variant <> 3"),
    ("full", 9, "'VALID FROM: ' || CASE WHEN doc_id % 3 = 0 THEN '2026-10-20' ELSE '2026-10-01' END", "variant = 8"),
    ("full", 10, "'Valid until: ' || CASE WHEN doc_id % 4 = 0 THEN '2026-09-10' ELSE '2026-10-10' END", "variant = 8"),
    ("full", 11, "'STAY DURATION: 30 days'", "variant = 8"),
    ("full", 12, "'FULL NAME: ALIAS ' || surname", "variant <> 3 AND doc_id % 11 = 0"),
    ("full", 13, "'   '", "true"),
    ("full", 14, "r1", "doc_id % 7 <> 3"),
    ("full", 15, "CASE WHEN doc_id % 41 = 8 THEN r2 || '|' ELSE r2 END", "doc_id % 7 <> 3"),
    ("full", 16, "r3", "doc_id % 7 <> 3 AND fmt = 'TD1'"),
    ("full", 17, "r1", "doc_id % 7 <> 3 AND doc_id % 41 = 8"),
    ("full", 18, "r2", "doc_id % 7 <> 3 AND doc_id % 41 = 8"),
    ("full", 19, "r3", "doc_id % 7 <> 3 AND doc_id % 41 = 8 AND fmt = 'TD1'"),
    ("full", 20, "'FOOTER'", "true"),
    ("rows", 0, "r1", "doc_id % 7 NOT IN (0, 2, 3)"),
    ("rows", 1, "'X1'", "doc_id % 7 = 1"),
    ("rows", 2, "r2", "doc_id % 7 NOT IN (2, 3)"),
    ("rows", 3, "r3", "doc_id % 7 NOT IN (2, 3) AND fmt = 'TD1'"),
    ("crop", 0, "r1", "doc_id % 7 = 3"),
    ("crop", 1, "r2", "doc_id % 7 = 3"),
    ("crop", 2, "r3", "doc_id % 7 = 3 AND fmt = 'TD1'"),
]
define(
    "ocr_lines0",
    "\nUNION ALL ".join(
        f"SELECT doc_id, '{p}' AS pass, CAST({n} AS INT) AS line_no, {text} AS text FROM zones WHERE {keep}{'' if n == 13 else ' AND doc_id % 43 <> 11'}"
        for p, n, text, keep in _LINES
    ),
)
define(
    "ocr_lines",
    """
SELECT *, CASE WHEN (doc_id + line_no) % 13 <> 0 THEN CAST((doc_id * 31 + line_no * 7 + length(pass)) % 101 AS DOUBLE) / 100 END AS confidence
FROM ocr_lines0""",
)
define(
    "ocr_words",
    """
SELECT doc_id, CAST(line - 1 AS INT) AS line, CAST(word - 1 AS INT) AS word_no, text, CAST((doc_id * 31 + word - 1) % 101 - 1 AS DOUBLE) AS conf
FROM (SELECT doc_id, line, unnest(string_split(t, ' ')) AS text, generate_subscripts(string_split(t, ' '), 1) AS word
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) x) y
WHERE trim(text) <> ''""",
)

# ------------------------------------------------------------------- finding
define(
    "kept_lines",
    f"SELECT *, {clean('text')} AS c FROM ocr_lines WHERE {clean('text')} <> ''",
)


def _candidates(source: str, keys: str) -> str:
    ok = "regexp_full_match({0}, '[A-Z0-9<]*')"
    return f"""
SELECT {keys}, line_no, rank, r1, r2, CASE WHEN rank = 0 THEN r3 END AS r3 FROM (
  SELECT {keys}, line_no, r1, r2, r3,
    CASE WHEN length(c1) = 30 AND length(c2) = 30 AND length(c3) = 30 AND {ok.format('c1 || c2 || c3')} THEN 0
         WHEN length(c1) = 44 AND length(c2) = 44 AND {ok.format('c1 || c2')} THEN 1
         WHEN length(c1) = 36 AND length(c2) = 36 AND {ok.format('c1 || c2')} THEN 2 END AS rank, c1
  FROM (SELECT {keys}, line_no, text AS r1, c AS c1,
          lead(text, 1) OVER w AS r2, lead(text, 2) OVER w AS r3, lead(c, 1) OVER w AS c2, lead(c, 2) OVER w AS c3
        FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY line_no)) led) ranked
WHERE rank IS NOT NULL AND substr(c1, 1, 1) IN ('P', 'A', 'C', 'I') AND contains(c1, '<')"""


define("tagged_lines", """
SELECT *, pass AS source FROM kept_lines
UNION ALL SELECT *, 'rows_by_length' AS source FROM kept_lines WHERE pass = 'rows' AND length(c) IN (30, 36, 44)""")
define("pass_candidates", _candidates("tagged_lines", "doc_id, source"))
define(
    "pass_found",
    """SELECT * FROM pass_candidates
QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY line_no, rank) = 1""",
)
define(
    "headers",
    """SELECT doc_id, length(c) AS w, arg_min(text, line_no) AS r1, arg_min(c, line_no) AS c1 FROM kept_lines
WHERE pass = 'full' AND length(c) IN (30, 36, 44) AND substr(text, 1, 1) IN ('P', 'A', 'C', 'I') GROUP BY ALL""",
)
define(
    "bodies",
    """SELECT doc_id, length(c) AS w, list(text ORDER BY line_no DESC) AS t, list(c ORDER BY line_no DESC) AS cs FROM kept_lines
WHERE pass = 'rows' AND length(c) IN (30, 36, 44) GROUP BY ALL""",
)
define(
    "combined",
    """
SELECT doc_id, CASE w WHEN 44 THEN 'combined_td3' WHEN 36 THEN 'combined_td2' ELSE 'combined_td1' END AS source, 0 AS line_no, 0 AS rank,
  r1, CASE w WHEN 30 THEN t[2] ELSE t[1] END AS r2, CASE w WHEN 30 THEN t[1] END AS r3
FROM headers JOIN bodies USING (doc_id, w)
WHERE (w <> 30 OR len(t) >= 2) AND contains(c1, '<')
  AND regexp_full_match(c1 || cs[1] || CASE w WHEN 30 THEN cs[2] ELSE '' END, '[A-Z0-9<]*')""",
)
define(
    "found",
    f"""
SELECT doc_id, source, line_no, r1, r2, r3 FROM (
  SELECT doc_id, source, line_no, rank, r1, r2, r3 FROM pass_found
  UNION ALL SELECT doc_id, source, line_no, rank, r1, r2, r3 FROM combined) u
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['rows', 'rows_by_length', 'combined_td3', 'combined_td2', 'combined_td1', 'full', 'crop'], source), line_no, rank) = 1""",
)

# ------------------------------------------------------------------- parsing


def _sub(prefix: str, line: int, start: int, end: int) -> str:
    return f"substr({prefix}{line + 1}, {start + 1}, {end - start})"


def _case(pick) -> str:
    return "CASE fmt " + " ".join(f"WHEN '{n}' THEN {pick(lay)}" for n, lay in mrz.LAYOUTS.items()) + " END"


def _fixed_line(line: int) -> str:
    def pick(lay) -> str:
        if line >= lay.lines:
            return "NULL"
        kind = ["-"] * lay.width
        for at, start, end, letters in lay.slots:
            if at == line:
                kind[start:end] = ["A" if letters else "N"] * (end - start)
        return (
            f"array_to_string(list_transform(range(1, {lay.width + 1}), lambda i: CASE substr('{''.join(kind)}', i, 1) "
            f"WHEN 'A' THEN translate(substr(c{line + 1}, i, 1), '018', 'OIB') "
            f"WHEN 'N' THEN translate(substr(c{line + 1}, i, 1), 'OIB', '018') ELSE substr(c{line + 1}, i, 1) END), '')"
        )

    return _case(pick)


def _parse(source: str, name: str) -> None:
    """Expressions ``<name>_detected``, ``<name>_fixed``, ``<name>``."""
    define(
        f"{name}_detected",
        f"""
SELECT *, CASE WHEN fmt IS NULL THEN 'unsupported_length' WHEN NOT regexp_full_match(c1 || c2 || coalesce(c3, ''), '[A-Z0-9<]*')
  THEN 'unsupported_character' WHEN c1 LIKE 'V%' THEN 'visa_zone' END AS reason
FROM (SELECT *, CASE WHEN length(c1) = 30 AND length(c2) = 30 AND length(c3) = 30 THEN 'TD1'
             WHEN length(c1) = 36 AND length(c2) = 36 AND c3 IS NULL THEN 'TD2'
             WHEN length(c1) = 44 AND length(c2) = 44 AND c3 IS NULL THEN 'TD3' END AS fmt
      FROM (SELECT * EXCLUDE (fmt), {clean('r1')} AS c1, {clean('r2')} AS c2, {clean('r3')} AS c3
            FROM (SELECT * FROM {source}) s0) s1) s2""".replace(" EXCLUDE (fmt)", " EXCLUDE (fmt)" if source == "zones" else ""),
    )
    define(
        f"{name}_fixed",
        f"SELECT *, {', '.join(f'{_fixed_line(i)} AS o{i + 1}' for i in range(3))} FROM {name}_detected WHERE reason IS NULL",
    )
    fields = []
    for f in mrz.FIELDS:
        raw = _case(lambda lay: _sub("c", *lay.fields[f]))
        fixed = _case(lambda lay: _sub("o", *lay.fields[f]))
        value = f"trim(regexp_replace({fixed}, '<+', ' ', 'g'))"
        if f == "gender":
            value = f"CASE WHEN {fixed} = '<' THEN 'X' ELSE {value} END"
        fields.append(f"{raw} AS {f}_raw, {value} AS {f}_value, {fixed} AS {f}_fixed")
    define(
        name,
        f"""
SELECT * REPLACE (CASE WHEN extended THEN NULL ELSE number_value END AS number_value) FROM (
SELECT *, {_case(lambda lay: _sub('o', *lay.checks[0][2]))} = '<' AS extended, {', '.join(fields)} FROM {name}_fixed) p""",
    )
    rows = []
    for n, lay in mrz.LAYOUTS.items():
        for order, (check, parts, digit) in enumerate(lay.checks):
            value = " || ".join(_sub("o", *p) for p in parts)
            rows.append(
                f"SELECT doc_id, {order} AS ord, '{check}' AS field, {value} AS input, {_sub('o', *digit)} AS observed, "
                f"extended FROM {name} WHERE fmt = '{n}'"
            )
    define(f"{name}_checks0", "\nUNION ALL ".join(rows))
    define(
        f"{name}_checks",
        f"""
SELECT doc_id, ord, field, input, observed,
  CASE WHEN ord = 0 AND extended THEN NULL ELSE expected END AS expected,
  CASE WHEN ord = 0 AND extended THEN NULL ELSE observed = expected OR (field = 'optional_data' AND observed = '<' AND regexp_full_match(input, '<*')) END AS valid
FROM (SELECT *, {check_digit('input')} AS expected FROM {name}_checks0) c""",
    )
    define(
        f"{name}_limits",
        f"""
SELECT doc_id, 0 AS ord, '{mrz.EXTENDED_NUMBER}' AS text FROM {name} WHERE extended
UNION ALL SELECT doc_id, 1, '{mrz.BAD_DOCUMENT_CODE}' FROM {name} WHERE NOT regexp_full_match(substr(o1, 1, 2), '[A-Z<]+')
UNION ALL SELECT doc_id, 2, '{mrz.BAD_SEX_MARKER}' FROM {name} WHERE gender_fixed NOT IN ('M', 'F', '<')""",
    )
    slots = []
    for n, lay in mrz.LAYOUTS.items():
        for order, (line, start, end, letters) in enumerate(lay.slots):
            kind = "alphabetic" if letters else "numeric"
            c, o = f"substr(c{line + 1}, CAST(pos AS INT), 1)", f"substr(o{line + 1}, CAST(pos AS INT), 1)"
            slots.append(
                f"SELECT doc_id, {order + 1} AS slot, pos, 'Line {line + 1}, column ' || pos || ': ' || {c} || '->' || {o} || ' ({kind} field).' AS note "
                f"FROM (SELECT doc_id, c{line + 1}, o{line + 1}, unnest(range({start + 1}, {end + 1})) AS pos FROM {name} WHERE fmt = '{n}') q WHERE {c} <> {o}"
            )
    define(
        f"{name}_notes",
        f"SELECT doc_id, 0 AS slot, 0 AS pos, '{mrz.CLEANED_NOTE}' AS note FROM {name} "
        "WHERE r1 <> c1 OR r2 <> c2 OR r3 IS DISTINCT FROM c3\nUNION ALL " + "\nUNION ALL ".join(slots),
    )


_parse("zones", "parsed_zone")
_parse("found", "parsed")

# ------------------------------------------------------------- printed fields
_LABEL_SQL = " ".join(
    rf"WHEN regexp_full_match(text, '(?i)\s*(?:{p})\s*[:\-]?\s+(.+?)\s*') THEN '{n}'" for n, p in viz.LABELS.items()
)
_VALUE_SQL = "coalesce(" + ", ".join(
    rf"nullif(regexp_extract(text, '(?i)^\s*(?:{p})\s*[:\-]?\s+(.+?)\s*$', 1), '')" for p in viz.LABELS.values()
) + ")"
define(
    "viz_rows",
    rf"""
SELECT *, trim(regexp_replace(upper(raw), '\s+', ' ', 'g')) AS value FROM (
  SELECT *, CASE {_LABEL_SQL} END AS field, {_VALUE_SQL} AS raw FROM ocr_lines WHERE pass = 'full') l WHERE field IS NOT NULL""",
)
define(
    "viz_best",
    "SELECT doc_id, field, raw, value, confidence, line_no FROM viz_rows "
    "QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY coalesce(confidence, 0) DESC, line_no) = 1",
)
define(
    "viz_wide",
    "SELECT doc_id, "
    + ", ".join(f"max(value) FILTER (field = '{n}') AS v_{n}" for n in viz.FIELDS)
    + " FROM viz_best GROUP BY doc_id",
)


def classify(x: str) -> str:
    # RE2 has no lookaround; its ASCII word boundary equals the rule for ASCII text.
    cases = " ".join(rf"WHEN regexp_matches(upper({x}), '{p}') THEN '{k}'" for k, p in viz.KEYWORDS)
    return f"CASE {cases} ELSE 'unknown' END"


define(
    "doc_text",
    "SELECT doc_id, string_agg(text, chr(10) ORDER BY CASE pass WHEN 'full' THEN 0 WHEN 'rows' THEN 1 ELSE 2 END, line_no) AS txt, "
    "min(confidence) FILTER (pass = 'rows') AS rows_confidence, min(confidence) FILTER (pass = 'crop') AS crop_confidence, "
    "min(confidence) FILTER (pass = 'full' AND contains(text, '<')) AS filler_confidence FROM ocr_lines GROUP BY doc_id",
)
define(
    "resolved",
    f"""
SELECT d.doc_id, f.source, p.fmt, {classify('txt')} AS keyword_type,
  CASE WHEN {classify('txt')} <> 'unknown' THEN {classify('txt')} WHEN p.fmt = 'TD3' THEN 'passport' WHEN p.fmt IS NOT NULL THEN 'id' ELSE 'unknown' END AS document_type,
  CASE WHEN p.fmt IS NOT NULL THEN coalesce(CASE WHEN f.source LIKE 'rows%' OR f.source LIKE 'combined%' THEN rows_confidence WHEN f.source = 'crop' THEN crop_confidence END, filler_confidence) END AS mrz_confidence,
  p.fmt IS NOT NULL AS has_zone, v.doc_id IS NOT NULL AS has_viz,
  EXISTS (SELECT 1 FROM parsed_notes n WHERE n.doc_id = d.doc_id) AS has_notes
FROM doc_text d LEFT JOIN parsed p ON p.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id LEFT JOIN viz_wide v ON v.doc_id = d.doc_id""",
)

# ---------------------------------------------------------------- validation
REF = f"DATE '{REFERENCE_DATE}'"


def parse_date(x: str) -> str:
    return (
        f"CAST(try_strptime({x}, ['%Y-%m-%d', '%d %b %Y', '%d %B %Y', '%d/%m/%Y', '%d.%m.%Y']) AS DATE)"
    )


def candidates(x: str) -> str:
    years = ", ".join(
        f"CAST(try_strptime(CAST({c} + CAST(substr({x}, 1, 2) AS INT) AS VARCHAR) || substr({x}, 3, 4), '%Y%m%d') AS DATE)"
        for c in (1900, 2000, 2100)
    )
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{6}}') THEN list_filter([{years}], lambda d: d IS NOT NULL) ELSE [] END"


def _norm(x: str, kind: str) -> str:
    words = f"trim(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    if kind == "name":
        return f"array_to_string(list_sort(string_split({words}, ' ')), ' ')"
    return f"replace({words}, ' ', '')"


define(
    "val0",
    f"""
SELECT r.doc_id, r.fmt, r.document_type, r.has_notes,
  nullif(p.dob_value, '') AS m_dob, nullif(p.expiry_value, '') AS m_expiry, nullif(p.name_value, '') AS m_name,
  nullif(p.number_value, '') AS m_number, nullif(p.issuing_country_value, '') AS m_country, nullif(p.nationality_value, '') AS m_nationality,
  v.v_dob AS p_dob, v.v_expiry AS p_expiry, v.v_name AS p_name, v.v_number AS p_number, v.v_issue AS p_issue,
  v.v_valid_from AS p_from, v.v_valid_until AS p_until, v.v_stay_duration AS p_stay
FROM resolved r LEFT JOIN parsed p ON p.doc_id = r.doc_id LEFT JOIN viz_wide v ON v.doc_id = r.doc_id""",
)
define(
    "val1",
    f"""
SELECT *, {', '.join(f"{parse_date('p_' + n)} AS d_{n}" for n in ('dob', 'expiry', 'issue', 'from', 'until'))},
  {candidates('m_dob')} AS all_dob, {candidates('m_expiry')} AS all_expiry FROM val0""",
)
define(
    "val2",
    f"""
SELECT *, list_filter(all_dob, lambda d: d <= {REF} AND date_sub('year', d, {REF}) <= 120) AS cand_dob,
  list_sort(list_transform(all_expiry, lambda d: {{'gap': abs(date_diff('day', {REF}, d)), 'd': d}}))[1].d AS nearest FROM val1""",
)
define(
    "val3",
    f"""
SELECT *,
  CASE WHEN list_contains(cand_dob, d_dob) THEN d_dob WHEN len(cand_dob) = 1 THEN cand_dob[1] END AS src_dob,
  CASE WHEN list_contains(all_expiry, d_expiry) THEN d_expiry ELSE nearest END AS src_expiry,
  CASE WHEN m_dob IS NOT NULL AND d_dob IS NOT NULL AND len(cand_dob) > 0 THEN list_contains(cand_dob, d_dob) END AS x_dob,
  CASE WHEN m_expiry IS NOT NULL AND d_expiry IS NOT NULL AND len(all_expiry) > 0 THEN list_contains(all_expiry, d_expiry) END AS x_expiry,
  CASE WHEN m_name IS NOT NULL AND p_name IS NOT NULL THEN {_norm('m_name', 'name')} = {_norm('p_name', 'name')} END AS x_name,
  CASE WHEN m_number IS NOT NULL AND p_number IS NOT NULL THEN {_norm('m_number', 'number')} = {_norm('p_number', 'number')} END AS x_number,
  coalesce(m_number, p_number) AS number
FROM val2""",
)
define(
    "val",
    """
SELECT v.*, coalesce(src_dob, d_dob) AS resolved_dob, coalesce(src_expiry, d_expiry) AS resolved_expiry,
  m_country IS NOT NULL AND number IS NOT NULL AS available,
  CASE WHEN m_country IS NOT NULL AND number IS NOT NULL THEN coalesce(l.blacklisted, false) END AS blacklist_hit,
  CASE WHEN m_country IS NOT NULL AND number IS NOT NULL THEN coalesce(l.seen_count, 0) END AS previously_seen
FROM val3 v LEFT JOIN ref_list l ON l.document_key = sha256(upper(trim(v.m_country)) || ':' || upper(trim(v.number)))""",
)
# The derived records carry UTO and ZZZ only, and neither is an ISO code, so the
# extra codes alone decide the country rule here.
_EXTRA = ", ".join(f"'{c}'" for c in EXTRA_COUNTRY_CODES)


def _rule(code: str, field: str | None, test: str, source: str = "val") -> str:
    name = f"'{field}'" if field else "CAST(NULL AS VARCHAR)"
    return f"SELECT doc_id, '{code}' AS code, {name} AS field FROM {source} WHERE {test}"


_RULES = [
    _rule("MRZ_UNAVAILABLE", None, "fmt IS NULL"),
    "SELECT doc_id, 'MRZ_CHECK_FAILED' AS code, field FROM parsed_checks WHERE NOT valid",
    "SELECT doc_id, 'MRZ_VARIANT_UNSUPPORTED' AS code, CAST(NULL AS VARCHAR) AS field FROM parsed_limits",
    _rule("MRZ_OCR_CORRECTED", None, "has_notes"),
    _rule("CROSS_CHECK_INCOMPLETE", None, "x_dob IS NULL OR x_expiry IS NULL OR x_name IS NULL OR x_number IS NULL"),
    _rule("DATE_UNREADABLE", "issue", "p_issue IS NOT NULL AND d_issue IS NULL"),
    _rule("ISSUE_EXPIRY_ORDER", "issue", "d_issue >= resolved_expiry"),
    _rule("FUTURE_ISSUE", "issue", f"d_issue > {REF}"),
    _rule("ISSUE_BEFORE_BIRTH", "issue", "d_issue < resolved_dob"),
    _rule("DATE_UNREADABLE", "valid_from", "p_from IS NOT NULL AND d_from IS NULL"),
    _rule("DATE_UNREADABLE", "valid_until", "p_until IS NOT NULL AND d_until IS NULL"),
    _rule("VISA_WINDOW_INVALID", None, "d_from > d_until"),
    _rule("VISA_NOT_YET_VALID", None, f"{REF} < d_from"),
    _rule("VISA_ENTRY_WINDOW_EXPIRED", None, f"{REF} > d_until"),
    _rule("VISA_STAY_INVALID", None, r"p_stay IS NOT NULL AND NOT coalesce(regexp_full_match(p_stay, '(?i)\d+\s*(DAYS?)?') AND TRY_CAST(regexp_extract(p_stay, '\d+') AS HUGEINT) > 0, false)"),
    _rule("VISA_STAY_POLICY_REVIEW", None, r"regexp_full_match(p_stay, '(?i)\d+\s*(DAYS?)?') AND TRY_CAST(regexp_extract(p_stay, '\d+') AS HUGEINT) > date_diff('day', d_from, d_until) + 1"),
    _rule("COUNTRY_CODE_UNKNOWN", "issuing_country", f"m_country NOT IN ({_EXTRA})"),
    _rule("COUNTRY_CODE_UNKNOWN", "nationality", f"m_nationality NOT IN ({_EXTRA})"),
    _rule("NUMBER_FORMAT", "number", "NOT regexp_full_match(number, '[A-Z0-9]{5,20}')"),
    _rule("COUNTRY_NUMBER_FORMAT", "number", "document_type = 'passport' AND m_country = 'UTO' AND NOT regexp_full_match(number, '[A-Z][0-9]{7}')"),
    _rule("LOOKUP_UNAVAILABLE", None, "NOT available"),
    _rule("MOCK_BLACKLIST_HIT", None, "blacklist_hit"),
    _rule("PREVIOUSLY_SEEN", None, "previously_seen > 0"),
    _rule("EXPIRY_CENTURY_INFERRED", "expiry", "len(all_expiry) > 0 AND NOT coalesce(list_contains(all_expiry, d_expiry), false)"),
    _rule("DOB_CENTURY_AMBIGUOUS", "dob", "src_dob IS NULL AND len(cand_dob) > 1"),
    _rule("FIELD_MISMATCH", "name", "NOT x_name"),
    _rule("FIELD_MISMATCH", "number", "NOT x_number"),
]
for _n in ("dob", "expiry"):
    _RULES += [
        _rule("DATE_UNREADABLE", _n, f"p_{_n} IS NOT NULL AND d_{_n} IS NULL"),
        _rule("INVALID_MRZ_DATE", _n, f"m_{_n} IS NOT NULL AND len(all_{_n}) = 0"),
        _rule("FIELD_MISMATCH", _n, f"NOT x_{_n}"),
    ]
    define(
        f"seen_{_n}",
        f"SELECT doc_id, unnest(list_distinct([src_{_n}, d_{_n}])) AS day FROM val",
    )
_RULES += [
    _rule("DOCUMENT_EXPIRED", "expiry", f"day < {REF}", "seen_expiry"),
    _rule("EXPIRY_IMPLAUSIBLE", "expiry", f"year(day) > year({REF}) + 20", "seen_expiry"),
    _rule("DOB_IMPLAUSIBLE", "dob", f"day > {REF} OR date_sub('year', day, {REF}) > 120", "seen_dob"),
]
define("findings", "\nUNION ALL ".join(_RULES))
define("codes", "SELECT doc_id, list_distinct(list(code)) AS codes FROM findings GROUP BY doc_id")


def _any(codes: list[str]) -> str:
    return "list_has_any(coalesce(codes, []), [" + ", ".join(f"'{c}'" for c in codes) + "])"


from idsift.operators.risk import DATE_FLAGS, DATE_UNKNOWN, FORMAT_FLAGS  # noqa: E402

define(
    "check_counts",
    "SELECT doc_id, count(*) AS n, count(valid) AS known, count(*) FILTER (NOT valid) AS failed FROM parsed_checks GROUP BY doc_id",
)
define(
    "val_signals0",
    f"""
SELECT v.doc_id, coalesce(k.n, 0) AS n, coalesce(k.known, 0) AS known, coalesce(k.failed, 0) AS failed,
  NOT {_any(['MRZ_VARIANT_UNSUPPORTED'])} AS supported,
  (x_dob IS NOT NULL)::INT + (x_expiry IS NOT NULL)::INT + (x_name IS NOT NULL)::INT + (x_number IS NOT NULL)::INT AS compared,
  coalesce((NOT x_dob)::INT, 0) + coalesce((NOT x_expiry)::INT, 0) + coalesce((NOT x_name)::INT, 0) + coalesce((NOT x_number)::INT, 0) AS mismatches,
  {_any(DATE_FLAGS)} AS date_flag,
  resolved_dob IS NOT NULL AND resolved_expiry IS NOT NULL AND NOT {_any(DATE_UNKNOWN)} AS dates_known,
  {_any(FORMAT_FLAGS)} AS format_flag, available, blacklist_hit
FROM val v LEFT JOIN check_counts k ON k.doc_id = v.doc_id LEFT JOIN codes c ON c.doc_id = v.doc_id""",
)
define(
    "val_signals",
    """
SELECT doc_id, 'mrz' AS name, CASE WHEN known > 0 THEN CAST(failed > 0 AS DOUBLE) END AS value, n > 0 AND known = n AND supported AS complete FROM val_signals0
UNION ALL SELECT doc_id, 'cross_fields', CASE WHEN compared > 0 THEN least(mismatches / 2.0, 1.0)::DOUBLE END, compared = 4 FROM val_signals0
UNION ALL SELECT doc_id, 'dates', CASE WHEN date_flag THEN 1.0::DOUBLE WHEN dates_known THEN 0.0::DOUBLE END, dates_known FROM val_signals0
UNION ALL SELECT doc_id, 'blacklist', CASE WHEN available THEN CAST(blacklist_hit AS DOUBLE) END, available FROM val_signals0
UNION ALL SELECT doc_id, 'format', CASE WHEN (known > 0 AND supported) OR format_flag THEN CAST(format_flag AS DOUBLE) END, known > 0 AND supported FROM val_signals0""",
)

# -------------------------------------------------------------------- scoring
POLICY = [("blacklist", 35), ("duplicate_identity", 15), ("face", 15), ("mrz", 8), ("cross_fields", 8),
          ("dates", 5), ("tampering", 5), ("liveness", 4), ("metadata", 2), ("format", 3)]
REQUIRED = "'blacklist', 'face', 'mrz', 'cross_fields', 'dates', 'tampering', 'liveness'"
define(
    "policy",
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, {w}.0::DOUBLE)" for i, (n, w) in enumerate(POLICY)) + ") AS t(name, ord, weight)",
)


def scoring(source: str, docs: str) -> dict[str, str]:
    """Expressions ``contrib`` and ``scored_docs`` over a signal expression."""
    return {
        "contrib": f"""
SELECT d.doc_id, p.name, p.ord, p.weight, s.value, round(p.weight * coalesce(s.value, 0), 4) AS points,
  coalesce(s.complete, false) AND s.value IS NOT NULL AS complete
FROM (SELECT DISTINCT doc_id FROM {docs}) d CROSS JOIN policy p LEFT JOIN {source} s ON s.doc_id = d.doc_id AND s.name = p.name""",
        "scored_docs": f"""
SELECT *, CASE WHEN observed AND score_lo >= 35 THEN 'High' WHEN observed AND missing_required = '' THEN CASE WHEN score_lo >= 15 THEN 'Medium' ELSE 'Low' END END AS category,
  CASE WHEN missing_required = '' THEN 'ok' ELSE 'insufficient_evidence' END AS risk_status, CASE WHEN observed THEN score_lo END AS score
FROM (SELECT doc_id, round(sum(points), 4) AS score_lo, round(sum(CASE WHEN complete THEN points ELSE weight END), 4) AS score_hi,
  round(coalesce(sum(weight) FILTER (complete), 0) / 100, 4) AS coverage, bool_or(value IS NOT NULL) AS observed,
  coalesce(string_agg(name, ',' ORDER BY ord) FILTER (NOT complete), '') AS missing,
  coalesce(string_agg(name, ',' ORDER BY ord) FILTER (NOT complete AND name IN ({REQUIRED})), '') AS missing_required
FROM contrib GROUP BY doc_id) g""",
    }
