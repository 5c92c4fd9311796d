"""Machine-readable-zone jobs: find, parse, check and encode at corpus scale.

``find`` needs one shuffle on the document; everything after it is a chain of
narrow projections over the one row a document keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from idsift.functions import mrz as M
from idsift.functions.tables import explode_rows, explode_texts

# Lines of one document are ordered in blocks of this many line numbers, so that
# a single huge document is spread over many tasks.
BLOCK = 65536


# Fixed values of the travel-document standard (0-based, end exclusive).
@dataclass(frozen=True)
class Layout:
    lines: int
    width: int
    slots: tuple  # (line, start, end, letters?) in correction order
    fields: dict  # name -> (line, start, end)
    checks: tuple  # (name, input slices, check-digit slice)


TD1 = Layout(
    lines=3,
    width=30,
    slots=(
        (0, 2, 5, True), (1, 0, 7, False), (1, 8, 15, False), (1, 29, 30, False),
        (0, 14, 15, False), (1, 15, 18, True), (2, 0, 30, True),
    ),
    fields={
        "number": (0, 5, 14), "issuing_country": (0, 2, 5), "nationality": (1, 15, 18),
        "dob": (1, 0, 6), "expiry": (1, 8, 14), "gender": (1, 7, 8), "name": (2, 0, 30),
    },
    checks=(
        ("number", ((0, 5, 14),), (0, 14, 15)),
        ("dob", ((1, 0, 6),), (1, 6, 7)),
        ("expiry", ((1, 8, 14),), (1, 14, 15)),
        ("composite", ((0, 5, 30), (1, 0, 7), (1, 8, 15), (1, 18, 29)), (1, 29, 30)),
    ),
)
TD2 = Layout(
    lines=2,
    width=36,
    slots=(
        (0, 2, 5, True), (1, 9, 10, False), (1, 13, 20, False), (1, 21, 28, False),
        (1, 10, 13, True), (0, 5, 36, True), (1, 35, 36, False),
    ),
    fields={
        "number": (1, 0, 9), "issuing_country": (0, 2, 5), "nationality": (1, 10, 13),
        "dob": (1, 13, 19), "expiry": (1, 21, 27), "gender": (1, 20, 21), "name": (0, 5, 36),
    },
    checks=(
        ("number", ((1, 0, 9),), (1, 9, 10)),
        ("dob", ((1, 13, 19),), (1, 19, 20)),
        ("expiry", ((1, 21, 27),), (1, 27, 28)),
        ("composite", ((1, 0, 10), (1, 13, 20), (1, 21, 35)), (1, 35, 36)),
    ),
)
TD3 = Layout(
    lines=2,
    width=44,
    slots=(
        (0, 2, 5, True), (1, 9, 10, False), (1, 13, 20, False), (1, 21, 28, False),
        (1, 10, 13, True), (0, 5, 44, True), (1, 43, 44, False), (1, 42, 43, False),
    ),
    fields={
        "number": (1, 0, 9), "issuing_country": (0, 2, 5), "nationality": (1, 10, 13),
        "dob": (1, 13, 19), "expiry": (1, 21, 27), "gender": (1, 20, 21), "name": (0, 5, 44),
    },
    checks=(
        ("number", ((1, 0, 9),), (1, 9, 10)),
        ("dob", ((1, 13, 19),), (1, 19, 20)),
        ("expiry", ((1, 21, 27),), (1, 27, 28)),
        ("optional_data", ((1, 28, 42),), (1, 42, 43)),
        ("composite", ((1, 0, 10), (1, 13, 20), (1, 21, 43)), (1, 43, 44)),
    ),
)
LAYOUTS = {"TD1": TD1, "TD2": TD2, "TD3": TD3}
FIELDS = ("number", "issuing_country", "nationality", "dob", "expiry", "gender", "name")
# Format preference when several start on the same line.
SEARCH_ORDER = ("TD1", "TD3", "TD2")
DOCUMENT_LETTERS = ("P", "A", "C", "I")

EXTENDED_NUMBER = "The number goes on in the optional field; it is not put together."
BAD_DOCUMENT_CODE = "The document code has an unknown form."
BAD_SEX_MARKER = "Sex marker is none of M, F and <; look at the reading."
CLEANED_NOTE = "Read without white space and in capitals."

_TEXTS = "array<string>"


def _slice(prefix: str, line: int, start: int, end: int) -> Column:
    return F.substring(F.col(f"{prefix}{line + 1}"), start + 1, end - start)


def _by_format(pick) -> Column:
    out = None
    for name, layout in LAYOUTS.items():
        value = pick(layout)
        if value is None:
            continue
        test = F.col("fmt") == name
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


# --------------------------------------------------------------------- detect


def detect(df: DataFrame) -> DataFrame:
    """Format and quarantine reason for rows with raw lines ``r1, r2, r3``.

    ``r3`` is NULL for two-line documents. Nothing is padded or cut.
    """
    cleaned = df.select(
        "*", *[M.clean(F.col(f"r{i}")).alias(f"c{i}") for i in (1, 2, 3)]
    )
    lengths = [F.length(F.col(f"c{i}")) for i in (1, 2, 3)]
    fmt = None
    for name, layout in LAYOUTS.items():
        test = (lengths[0] == layout.width) & (lengths[1] == layout.width)
        test = test & (lengths[2] == layout.width if layout.lines == 3 else F.col("c3").isNull())
        fmt = F.when(test, name) if fmt is None else fmt.when(test, name)
    whole = F.concat("c1", "c2", F.coalesce("c3", F.lit("")))
    return cleaned.withColumn("fmt", fmt).withColumn(
        "reason",
        F.when(F.col("fmt").isNull(), "unsupported_length")
        .when(~whole.rlike(M.LEGAL), "unsupported_character")
        .when(F.col("c1").startswith("V"), "visa_zone"),
    )


# ----------------------------------------------------------------- correction


def correct(df: DataFrame) -> DataFrame:
    """Position-bound confusion repair of ``c1..c3`` into ``o1..o3`` with a log."""

    def line_after(layout: Layout, line: int) -> Column | None:
        if line >= layout.lines:
            return None
        pieces, at = [], 0
        for _, start, end, letters in sorted(s for s in layout.slots if s[0] == line):
            if start > at:
                pieces.append(_slice("c", line, at, start))
            repair = M.to_letters if letters else M.to_digits
            pieces.append(repair(_slice("c", line, start, end)))
            at = end
        if at < layout.width:
            pieces.append(_slice("c", line, at, layout.width))
        return F.concat(*pieces)

    def slot_log(line: int, start: int, end: int, letters: bool) -> Column:
        before, after = _slice("c", line, start, end), _slice("o", line, start, end)
        kind = "alphabetic" if letters else "numeric"
        notes = F.transform(
            F.sequence(F.lit(1), F.lit(end - start)),
            lambda i: F.when(
                F.substring(before, i, F.lit(1)) != F.substring(after, i, F.lit(1)),
                F.concat(
                    F.lit(f"Line {line + 1}, column "), (i + start).cast("string"), F.lit(": "),
                    F.substring(before, i, F.lit(1)), F.lit("->"),
                    F.substring(after, i, F.lit(1)), F.lit(f" ({kind} field)."),
                ),
            ),
        )
        # Most slots are unchanged; only changed ones pay for the position scan.
        return F.when(before == after, F.array().cast(_TEXTS)).otherwise(F.array_compact(notes))

    repaired = df.select(
        "*",
        *[
            _by_format(lambda lay, line=line: line_after(lay, line)).alias(f"o{line + 1}")
            for line in range(3)
        ],
    )
    as_read = (F.col("r1") == F.col("c1")) & (F.col("r2") == F.col("c2")) & (
        F.col("r3").eqNullSafe(F.col("c3"))
    )
    unchanged = (F.col("o1") == F.col("c1")) & (F.col("o2") == F.col("c2")) & (
        F.col("o3").eqNullSafe(F.col("c3"))
    )
    notes = F.when(as_read, F.array().cast(_TEXTS)).otherwise(F.array(F.lit(CLEANED_NOTE)))
    log = _by_format(lambda lay: F.flatten(F.array(*[slot_log(*slot) for slot in lay.slots])))
    return repaired.withColumn(
        "corrections", F.when(unchanged, notes).otherwise(F.concat(notes, log))
    )


# ------------------------------------------------------------- fields, checks


def fields(df: DataFrame) -> DataFrame:
    """Seven named slots as structs ``f_<name>(raw, corrected, corrections)``."""
    out = []
    for name in FIELDS:
        before = _by_format(lambda lay: _slice("c", *lay.fields[name]))
        after = _by_format(lambda lay: _slice("o", *lay.fields[name]))
        value = M.readable(after)
        if name == "gender":
            value = F.when(after == "<", "X").otherwise(value)
        note = F.concat(
            F.lit("Read anew by its place: "), before, F.lit(" -> "), after
        )
        out.append(
            F.struct(
                before.alias("raw"),
                value.alias("corrected"),
                F.when(before == after, F.array().cast(_TEXTS))
                .otherwise(F.array(note))
                .alias("corrections"),
            ).alias(f"f_{name}")
        )
    return df.select("*", *out)


def checks(df: DataFrame) -> DataFrame:
    """Check table as ``checks: array<struct<field,input,observed,expected,valid>>``."""

    def table(layout: Layout) -> Column:
        rows = []
        for name, parts, digit in layout.checks:
            pieces = [_slice("o", *p) for p in parts]
            value = pieces[0] if len(pieces) == 1 else F.concat(*pieces)
            observed = _slice("o", *digit)
            expected = M.check_digit(value)
            valid = observed == expected
            if name == "optional_data":
                valid = valid | (value.rlike("^<*$") & (observed == "<"))
            rows.append(
                F.struct(
                    F.lit(name).alias("field"),
                    value.alias("input"),
                    observed.alias("observed"),
                    expected.alias("expected"),
                    valid.alias("valid"),
                )
            )
        return F.array(*rows)

    return df.withColumn("checks", _by_format(table))


def abstain(df: DataFrame) -> DataFrame:
    """An extended document number cannot be checked: unknown, never invalid."""
    first = F.col("checks")[0]
    extended = first["observed"] == "<"
    blank = F.array(
        F.struct(
            first["field"].alias("field"),
            first["input"].alias("input"),
            first["observed"].alias("observed"),
            F.lit(None).cast("string").alias("expected"),
            F.lit(None).cast("boolean").alias("valid"),
        )
    )
    rest = F.slice(F.col("checks"), 2, F.size("checks") - 1)
    number = F.struct(
        F.col("f_number.raw").alias("raw"),
        F.when(~F.col("extended"), F.col("f_number.corrected")).alias("corrected"),
        F.col("f_number.corrections").alias("corrections"),
    )
    return (
        df.withColumn("extended", extended)
        .withColumn(
            "checks", F.when(F.col("extended"), F.concat(blank, rest)).otherwise(F.col("checks"))
        )
        .withColumn("f_number", number)
    )


def limitations(df: DataFrame) -> DataFrame:
    sex = _by_format(lambda lay: _slice("o", *lay.fields["gender"]))
    return df.withColumn(
        "limitations",
        F.array_compact(
            F.array(
                F.when(F.col("extended"), EXTENDED_NUMBER),
                F.when(~F.substring("o1", 1, 2).rlike("^[A-Z<]+$"), BAD_DOCUMENT_CODE),
                F.when(~sex.isin("M", "F", "<"), BAD_SEX_MARKER),
            )
        ),
    )


def parse(df: DataFrame) -> DataFrame:
    """All parsing stages over rows ``(…, r1, r2, r3)``; narrow, no shuffle.

    Rows with a ``reason`` keep NULL results.
    """
    return limitations(abstain(checks(fields(correct(detect(df))))))


def parse_corpus(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, checks, corrections and quarantine of a whole line table."""
    parsed = parse(find(lines, ["doc_id"]))
    good = parsed.filter(F.col("reason").isNull())
    records = good.drop("checks", "corrections", "reason")
    check_rows = explode_rows(good, ["doc_id"], "checks")
    correction_rows = explode_texts(good, "corrections", "note")
    refused = parsed.filter(F.col("reason").isNotNull()).select("doc_id", F.col("reason").alias("_reason"))
    quarantine = (
        lines.select("doc_id").distinct().join(good.select("doc_id"), "doc_id", "left_anti")
        .join(refused, "doc_id", "left")
        .select("doc_id", F.coalesce("_reason", F.lit("no_supported_zone")).alias("reason"))
    )
    return records, check_rows, correction_rows, quarantine


# ----------------------------------------------------------------------- find


def with_next_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add the next two non-blank lines ``n1, n2`` of the same document.

    Lines are windowed in blocks of line numbers, so one huge document is not
    sorted by one task. Only blocks after a document's first one contribute
    rows to the small table that carries lines over a block edge.
    """
    kept = lines.filter(F.col("text").rlike(r"(?U)\S")).withColumn(
        "_block", F.floor(F.col("line_no") / BLOCK)
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("line_no")
    led = kept.select(
        "*",
        F.lead("text", 1).over(inside).alias("n1"),
        F.lead("text", 2).over(inside).alias("n2"),
        F.row_number().over(inside).alias("_rn"),
    )
    # First two lines of every later block, then of the blocks after it. The plain
    # comparison lets file statistics skip nearly everything.
    heads = (
        kept.filter(F.col("line_no") >= BLOCK)
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") <= 2)
    )
    over_blocks = Window.partitionBy(*keys).orderBy("line_no")
    ahead = heads.select(
        *keys, "_block", "_rn", F.col("text").alias("h1"),
        F.lead("text", 1).over(over_blocks).alias("h2"),
        F.lag("_block", 1).over(over_blocks).alias("_before"),
    ).filter(F.col("_rn") == 1)
    # A block's followers are the head of the next block that holds any line.
    edge = ahead.select(
        *keys, F.coalesce("_before", F.lit(0)).alias("_block"), "h1", "h2"
    )
    joined = led.join(edge, [*keys, "_block"], "left")
    last = F.col("n1").isNull()
    return joined.select(
        *[c for c in lines.columns],
        F.coalesce("n1", "h1").alias("n1"),
        F.when(last, F.col("h2")).otherwise(F.coalesce("n2", "h1")).alias("n2"),
    )


def zone_pattern(layout: Layout) -> str:
    """The layout's lines, each on a line of its own; more lines may follow a two-line
    zone. Cleaned text has no white space, so a line break separates and nothing else."""
    line = f"[A-Z0-9<]{{{layout.width}}}"
    head = rf"\A(?=[{''.join(DOCUMENT_LETTERS)}])(?=[^\n]*<)"
    return head + r"\n".join([line] * layout.lines) + (r"(?:\n|\z)" if layout.lines == 2 else r"\z")


def zone_at(text: Column, n1: Column, n2: Column) -> Column:
    """``struct(rank, r1, r2, r3)`` if a parseable zone opens with this line.

    A test of the first line alone comes first; nearly all lines end there.
    """
    widths = "|".join(str(lay.width) for lay in LAYOUTS.values())
    c1 = M.clean(text)
    opens = F.contains(text, F.lit("<")) & c1.rlike(
        "|".join(f"^[A-Z0-9<]{{{w}}}$" for w in widths.split("|"))
    )

    def fitting(joined: Column) -> Column:
        out = None
        for rank, name in enumerate(SEARCH_ORDER):
            layout = LAYOUTS[name]
            third = n2 if layout.lines == 3 else F.lit(None).cast("string")
            zone = F.struct(F.lit(rank).alias("rank"), text.alias("r1"), n1.alias("r2"), third.alias("r3"))
            test = joined.rlike(zone_pattern(layout))
            out = F.when(test, zone) if out is None else out.when(test, zone)
        return out

    # The one-element array binds the joined text once; generated code for three
    # copies of it would be too long for the JVM to compile.
    joined = F.array(F.concat_ws("\n", c1, M.clean(n1), M.clean(n2)))
    return F.when(opens, F.get(F.transform(joined, fitting), F.lit(0)))


def candidates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every line that opens a parseable zone."""
    led = with_next_lines(lines, keys)
    zoned = led.select(*keys, "line_no", zone_at(F.col("text"), F.col("n1"), F.col("n2")).alias("zone"))
    return zoned.filter(F.col("zone").isNotNull())


def find(lines: DataFrame, keys: list[str]) -> DataFrame:
    """First parseable zone of each document: ``keys, line_no, r1, r2, r3``.

    Picking the first one is an aggregate, combined before the shuffle.
    """
    best = candidates(lines, keys).groupBy(*keys).agg(
        F.min_by(F.struct("line_no", "zone"), "line_no").alias("best")
    )
    return best.select(*keys, "best.line_no", "best.zone.r1", "best.zone.r2", "best.zone.r3")


# --------------------------------------------------------------------- encode


def encode(df: DataFrame, fmt: Column) -> DataFrame:
    """Identity columns to zone lines ``r1, r2, r3`` with check digits.

    Rows that cannot be encoded get a ``reason`` and no lines.
    """
    name = F.concat(
        F.translate("surname", " ", "<"), F.lit("<<"), F.translate("given_names", " ", "<")
    )
    base = df.select(
        "*",
        fmt.alias("fmt"),
        F.rpad("number", 9, "<").alias("_num"),
        F.date_format("dob", "yyMMdd").alias("_dob"),
        F.date_format("expiry", "yyMMdd").alias("_exp"),
        F.when(F.col("gender").isin("M", "F"), F.col("gender")).otherwise("<").alias("_sex"),
        name.alias("_name"),
        F.when(F.length("number") > 9, "number_too_long")
        .when(F.length("country") != 3, "country_length")
        .when(~F.col("gender").isin("M", "F", "X", "<"), "sex_marker")
        .when(~fmt.isin(*LAYOUTS), "format")
        .alias("encode_reason"),
    )
    cd = M.check_digit
    digits = base.select(
        "*",
        cd(F.col("_num")).alias("_cn"), cd(F.col("_dob")).alias("_cd"),
        cd(F.col("_exp")).alias("_ce"),
    )
    is1, is3 = F.col("fmt") == "TD1", F.col("fmt") == "TD3"
    opened = digits.select(
        "*",
        F.when(is1, F.concat(F.lit("I<"), "country", "_num", "_cn", F.lit("<" * 15)))
        .when(is3, F.concat(F.lit("P<"), "country", F.rpad("_name", 39, "<")))
        .otherwise(F.concat(F.lit("I<"), "country", F.rpad("_name", 31, "<")))
        .alias("_a"),
        F.when(is1, F.concat("_dob", "_cd", "_sex", "_exp", "_ce", "country", F.lit("<" * 11)))
        .otherwise(
            F.concat(
                "_num", "_cn", "country", "_dob", "_cd", "_sex", "_exp", "_ce",
                # The check digit of fourteen fillers is zero.
                F.when(is3, F.lit("<" * 14 + "0")).otherwise(F.lit("<" * 7)),
            )
        )
        .alias("_b"),
    )
    s = F.substring
    covered = F.when(
        is1, F.concat(s("_a", 6, 25), s("_b", 1, 7), s("_b", 9, 7), s("_b", 19, 11))
    ).otherwise(F.concat(s("_b", 1, 10), s("_b", 14, 7), s("_b", 22, 22)))
    good = F.col("encode_reason").isNull()
    return opened.select(
        *df.columns,
        "fmt",
        "encode_reason",
        F.when(good, F.col("_a")).alias("r1"),
        F.when(good, F.concat("_b", cd(covered))).alias("r2"),
        F.when(good & is1, F.rpad("_name", 30, "<")).alias("r3"),
    )
