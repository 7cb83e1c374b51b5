"""Text rules for table cells as column functions. Character classes are spelled out, so
that they mean the same in every regular-expression dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that define results.
DASHES = "—–−¬ー―─－"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
CM_TILDE = "(?i)cm[ \\t\\n\\r]*[~～][ \\t\\n\\r]*1"
ROMAN_MISREAD = "(?i)\\b(?:111|11[il]|ll[il1]|lii)[ \\t\\n]*[-－][ \\t\\n]*([0-9]+)\\b"
GRADE_GLUED = r"(?i)^([<>]?[0-9]+(?:\.[0-9]+)?)[ \t]*([AB]\+?)$"
GRADE_REVERSED = r"(?i)^([AB]\+?)([<>]?[0-9]{2,}(?:\.[0-9]+)?)$"
GRADE_PLUS = r"^([<>]?[0-9]+(?:\.[0-9]+)?)[ \t]*\+$"
ROW_INDEX = "^[0-9]{1,3}$"
DASH_ONLY = "^[-–—―−－]+$"
LETTER_DATA = "^(?:[A-Za-z][+＋]?|[A-Z]{2,3}|[A-Za-z][0-9]{1,2})$"
DATA_VALUE = r"^(?:[-–—−~～]|[-–—−]?[0-9]+(?:\.[0-9]+)?(?:[/／][0-9]+(?:\.[0-9]+)?)?|[A-Za-z][+＋]?|[A-Z]{2,3}|[A-Za-z][0-9]{1,2})$"
UNIT_LINE = r"^[(（][A-Za-z0-9_%°℃²³/.\-μ]+[)）]$"
TWO_IDEOGRAPHS = r"^[\x{4e00}-\x{9fff}]{2}$"
COUNT_WORD = "^[0-9一二三四五六七八九十]+$"
NUMERIC = r"^[0-9.\-+×x/^%()\[\]{}<>Ω□cmgAJB ]+$"
EXAMPLE_ROW = "合成例|实施例|実施例|比較例|比较例"
DASH_VALUE = "^(?:[-—–−~～]|[-—–−]{2,})$"
PLAIN_NUMBER = r"^[0-9]+(?:\.[0-9]+)?$"
CHEMICAL = r"^[A-Za-z][A-Za-z0-9\-+']{1,24}(?:[(（][0-9]+(?:\.[0-9]+)?[)）])?$"
CODE = r"^[A-Za-z][A-Za-z0-9\-+']{1,24}$"
PAREN_AMOUNT = r"^[(（][0-9]+(?:\.[0-9]+)?[)）]$"
WEIGHED = r"(?i)[0-9](?:g|mol)"
CAPTION = r"^\[?[ \t]*表[ \t]*[0-9\-ー－]+[ \t]*\]?$"
IDEOGRAPH = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}]"
OPENING, CLOSING = "([{（【「『", ")]}）】」』，。、；：,.!?;:"
WIDE, NARROW, SPACE = 1.0, 0.55, 0.3


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(text), F.lit("")) == ""


def no_spaces(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\x0b\x0c]+", "")


def value_grade(text: Column) -> Column:
    """``struct(value, grade)`` of a number with a grade, written in either order; null for all else."""
    t = F.trim(text)
    grade = lambda g: F.upper(g)
    return (
        F.when(t.contains("\n"), None)
        .when(t.rlike(GRADE_GLUED), F.struct(F.regexp_extract(t, GRADE_GLUED, 1).alias("value"), grade(F.regexp_extract(t, GRADE_GLUED, 2)).alias("grade")))
        .when(t.rlike(GRADE_REVERSED), F.struct(F.regexp_extract(t, GRADE_REVERSED, 2).alias("value"), grade(F.regexp_extract(t, GRADE_REVERSED, 1)).alias("grade")))
        .when(t.rlike(GRADE_PLUS), F.struct(F.regexp_extract(t, GRADE_PLUS, 1).alias("value"), F.lit("A+").alias("grade")))
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once however often it is asked for: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def normalised(text: Column) -> Column:
    """Recognised text with control characters, dash variants, units, misread numerals and
    stacked grades put right."""
    t = F.translate(F.regexp_replace(text, CONTROL, ""), DASHES, "-" * len(DASHES))

    def graded(roman: Column) -> Column:
        prefixed = F.regexp_replace(roman, "(^|[^jJ])ER828", "$1jER828")
        pair = lambda p: F.when(p.isNotNull(), F.concat_ws("\n", p["value"], p["grade"])).otherwise(prefixed)
        return F.when(roman.isin("+0", "0+"), "0\nA+").otherwise(bound(value_grade(roman), pair))

    # the steps are long and each is asked for by several others: unbound they would be made hundreds of times
    return bound(F.regexp_replace(t, CM_TILDE, "cm-1"), lambda t: F.when(t.rlike(r"^[-\s]+$"), "-").otherwise(bound(F.regexp_replace(t, ROMAN_MISREAD, "iii-$1"), graded)))


def skeleton(text: Column) -> Column:
    """Template of a text: digits 9, Latin letters A, ideographs C, runs of these once."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[ \t\n\r\x0b\x0c]", "")
    t = F.regexp_replace(t, "[A-Za-z]+", "A")
    t = F.regexp_replace(t, "[0-9]+", "9")
    return F.regexp_replace(t, r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]+", "C")


def is_row_index(text: Column) -> Column:
    return no_spaces(text).rlike(ROW_INDEX)


def html_escaped(text: Column) -> Column:
    """For a cell of an HTML table; line breaks become br."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    t = F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(t, F.lit("\n"), F.lit("<br>"))


def md_escaped(text: Column) -> Column:
    """For a cell of a Markdown table."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.trim(F.replace(t, F.lit("\n"), F.lit("<br>")))


def is_fragment(text: Column) -> Column:
    """Nothing, or so short that it may be the tail of a neighbour: up to two characters or a bare
    count. Codes of letters, and two ideographs, are words."""
    t = no_spaces(text)
    short = (F.length(t) <= 2) & ~t.rlike(TWO_IDEOGRAPHS)
    return (t == "") | (~t.rlike(LETTER_DATA) & (short | t.rlike(COUNT_WORD)))


def is_unit_line(text: Column) -> Column:
    """Nothing but a unit in parentheses."""
    return no_spaces(text).rlike(UNIT_LINE)


def is_data_value(text: Column) -> Column:
    """A dash, a number or ratio, a grade or a code."""
    return no_spaces(text).rlike(DATA_VALUE)


def is_body_value(text: Column) -> Column:
    """What stands in the body of a table and never in its header: an example's label, a dash, a
    number, a code with or without an amount, a weighed amount."""
    t = no_spaces(text)
    return t.rlike(EXAMPLE_ROW) | t.rlike(DASH_VALUE) | t.rlike(PLAIN_NUMBER) | t.rlike(CHEMICAL) | t.rlike(PAREN_AMOUNT) | t.rlike(WEIGHED)


def is_caption(text: Column) -> Column:
    """The number of a table, alone."""
    return F.coalesce(F.trim(text), F.lit("")).rlike(CAPTION)


def looks_numeric(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")).rlike(NUMERIC)


def header_category(text: Column) -> Column:
    """Rough kind of a header below another, so that unlike ones do not swallow each other."""
    # The words of each kind, first match first.
    rules = {"ene": "烯键式|烯属不饱和|不饱和双键", "cap": "封端剂"}
    kinds = {"acid": "四羧酸|二羧酸|酸酐", "amine": "二胺|双氨基|硅烷|羟基二胺", "copoly": "共聚成分|有机硅烷", "cjk": r"[\x{4e00}-\x{9fff}]"}
    t = F.coalesce(text, F.lit(""))
    silane = "([一二三四五六七八九十0-9]+)官能"
    out = F.when(t.rlike(rules["ene"]), "ene").when(t.rlike(rules["cap"]), "cap")
    out = out.when(t.rlike(silane) & t.contains("硅烷"), F.concat(F.lit("silane_"), F.regexp_extract(t, silane, 1)))
    for kind, pattern in kinds.items():
        out = out.when(t.rlike(pattern), kind)
    return out.otherwise("other")


def char_widths(text: Column) -> Column:
    """Width of every character: ideographs 1, blanks less, all others between."""
    chars = F.split(F.coalesce(text, F.lit("")), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.when(c.rlike(r"^[ \t\n\r]$"), SPACE).when(c.rlike(f"^{IDEOGRAPH}$"), WIDE).otherwise(NARROW))


def prefix_widths(text: Column) -> Column:
    """Widths of all beginnings of a text, from the empty one on."""
    return F.aggregate(char_widths(text), F.array(F.lit(0.0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + w))


def char_index(text: Column, share: Column) -> Column:
    """Number of characters whose width comes nearest to a share of the whole, the first of equals."""
    sums = prefix_widths(text)
    target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * F.element_at(sums, -1)
    ranked = F.array_sort(F.transform(sums, lambda w, k: F.struct(F.abs(w - target).alias("d"), k.alias("k"))))
    return F.get(ranked, 0)["k"]


def joined_pieces(left: Column, right: Column) -> Column:
    """Two pieces of a line: no blank between ideographs, after an opening or before a closing mark,
    or beside nothing."""
    a, b = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    tight = (left == "") | (right == "") | (a.rlike(IDEOGRAPH) & b.rlike(IDEOGRAPH)) | a.isin(*OPENING) | b.isin(*CLOSING)
    return F.when(tight, F.concat(left, right)).otherwise(F.concat_ws(" ", left, right))


def garbage(text: Column, score: Column, ink: Column, median_ink: Column) -> Column:
    """Text that recognition made up in an empty place: little trusted, with next to no ink. Crosses and
    dashes are never garbage. Without ink, only short texts of very low score without letters or
    digits, and lone ideographs."""
    t = F.coalesce(F.trim(text), F.lit(""))
    lone = t.rlike(r"^[\x{3400}-\x{9fff}\x{f900}-\x{faff}]$")
    blind = ((score < 0.40) & (F.length(t) <= 4) & ~t.rlike("[0-9A-Za-z]")) | (lone & (score < 0.70))
    faint = (ink < F.when(median_ink > 1e-6, 0.012).otherwise(0.008)) & (score < 0.50)
    seen = faint | (lone & (score < 0.75) & (ink < 0.45 * median_ink))
    safe = (t == "") | t.isin("×", "x", "X") | t.rlike(DASH_ONLY) | (score >= 0.85)
    return F.when(safe, False).when(ink.isNull() | median_ink.isNull(), blind).otherwise(seen)
