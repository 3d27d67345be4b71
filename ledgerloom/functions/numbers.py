"""Printed numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import c

# Shapes of printed numbers.
PLAIN = r"\(?-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?"
NUMBER = f"^{PLAIN}$"
FOOTNOTE_MARK = r"(?:\(\d\)|\*+|†|‡)"
#: A number and one footnote mark. As `$` does, the number may end before a line's end.
MARKED_NUMBER = rf"^({PLAIN}){FOOTNOTE_MARK}$|^({PLAIN}(?:\r\n|[\n\r\u0085\u2028\u2029])){FOOTNOTE_MARK}\z"
DASHES = ["-", "—", "–", "−"]
NUMBER_OR_DASH = f"{NUMBER}|^[{''.join(DASHES)}]\\z"
YEAR = r"^(19|20)\d{2}$"
FOOTNOTE_REFERENCE = r"^\(\d\)$"
NUMERIC_TOKEN = r"\(?-?\$?\d[\d,]*(?:\.\d+)?\)?%?"
JUNK_TOKEN = "\\(cid:\\d+\\)|�"


def cell_token(cell: str | Column) -> Column:
    """The cell without '$' and spaces, and without one footnote mark if a number is left then."""
    return F.regexp_replace(F.trim(F.translate(c(cell), "$ ", "")), MARKED_NUMBER, "$1$2")


def is_number(cell: str | Column) -> Column:
    return cell_token(cell).rlike(NUMBER_OR_DASH)


def full_value(cell: str | Column, scale: float | Column = 1.0) -> Column:
    """Value in full units. Any parenthesis or a leading minus is negative, a dash is 0, what is no number is null."""
    return token_value(cell_token(cell), scale)


def token_value(token: Column, scale: float | Column = 1.0) -> Column:
    """full_value of a cell_token."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    size = F.regexp_replace(token, "[(),-]", "").try_cast("double")
    sign = F.when(token.contains("(") | token.contains(")") | token.startswith("-"), -1.0).otherwise(1.0)
    return F.when(token.isin(DASHES), F.lit(0.0)).when(token.rlike(NUMBER), F.round(sign * size * scale, 6))


def scorer_value(folded: str | Column) -> Column:
    """The scorer's stricter reading of a folded cell: negative needs both parentheses or a leading minus."""
    text = F.trim(F.translate(c(folded), "$,%", ""))
    wrapped = text.startswith("(") & text.endswith(")")
    inner = F.when(wrapped, F.substring(text, F.lit(2), F.char_length(text) - 2)).otherwise(text)
    minus = inner.startswith("-")
    size = F.trim(F.when(minus, F.substring(inner, F.lit(2), F.char_length(inner))).otherwise(inner)).try_cast("double")
    return F.when(text != "", F.when(wrapped | minus, -size).otherwise(size))


def numeric_tokens(folded: str | Column) -> Column:
    return F.regexp_extract_all(c(folded), F.lit(NUMERIC_TOKEN), F.lit(0))


def closed_paren(cell: str | Column, page_text: str | Column) -> Column:
    """Gives a cut-off ')' back where the page prints the closed form."""
    token = cell_token(cell)
    cut_off = token.startswith("(") & ~token.contains(")") & token.rlike(NUMBER)
    return F.when(cut_off & F.replace(c(page_text), F.lit(" "), F.lit("")).contains(F.concat(token, F.lit(")"))), F.concat(F.rtrim(c(cell)), F.lit(")"))).otherwise(c(cell))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), computing value once: inside a lambda, Spark computes an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_year_row(labels: Column, numbers: Column) -> Column:
    return (F.size(labels) == 0) & F.forall(numbers, lambda x: cell_token(x).rlike(YEAR))


def is_data_line(line: str | Column) -> Column:
    """A label and at least one number that is neither a year nor a footnote reference."""
    kinds = F.transform(F.filter(F.split(c(line), UNQUOTED_SPACE), lambda x: x != ""), is_counted)
    return F.array_contains(kinds, True) & F.array_contains(kinds, False)


def is_counted(token: str | Column) -> Column:
    """Is a token of a line a number that makes it a data line?"""
    x = c(token)
    return is_number(x) & ~cell_token(x).rlike(YEAR) & ~x.rlike(FOOTNOTE_REFERENCE)


UNQUOTED_SPACE = r"\s+"


def ocr_measures(text: str | Column) -> tuple[Column, Column]:
    """Characters that are no white space, and the share of tokens with junk."""
    x = c(text)
    tokens = F.filter(F.split(x, UNQUOTED_SPACE), lambda t: t != "")
    junk = F.size(F.filter(tokens, lambda t: t.rlike(JUNK_TOKEN)))
    return F.char_length(F.regexp_replace(x, r"\s", "")).cast("long"), F.when(F.size(tokens) > 0, junk / F.size(tokens)).otherwise(F.lit(0.0))


def ocr_reasons(text: str | Column, min_chars: int = 20, max_junk: float = 0.3) -> Column:
    """Why a page needs OCR, joined by ';'; empty if it doesn't."""
    chars, junk = ocr_measures(text)
    return F.concat_ws(";", F.when(chars < min_chars, F.lit("low_char_count")), F.when(junk > max_junk, F.lit("high_junk_ratio")))


def gray_level(values: str | Column) -> Column:
    """Gray of a colour of 0 to 4 numbers: none is black, four are CMYK."""
    v = c(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return (
        F.when(v.isNull() | (F.size(v) == 0), F.lit(0.0))
        .when(F.size(v) == 4, F.greatest(F.lit(0.0), 1.0 - F.element_at(v, 4) - total(F.slice(v, 1, 3)) / 3))
        .otherwise(total(v) / F.size(v))
    )


def header_unit(header: str | Column, share_scale: Column | float) -> Column:
    """Scale that a column header states for its values; null if none."""
    from ledgerloom.functions.text import key_form

    h = key_form(header)
    share = share_scale if isinstance(share_scale, Column) else F.lit(float(share_scale))
    return (
        F.when(h.contains("pershare") | h.contains("price"), F.lit(1.0))
        .when(h.contains("inthousands"), F.lit(1e3))
        .when(h.contains("inmillions"), F.lit(1e6))
        .when(h.contains("numberofshares") | h.contains("sharespurchased"), share)
    )


def page_scale(page_text: str | Column) -> tuple[Column, Column]:
    """Scale that the page states, and that of share counts."""
    from ledgerloom.functions.text import key_form

    page = key_form(page_text)
    table = F.when(page.contains("inmillions"), F.lit(1e6)).when(page.contains("inthousands"), F.lit(1e3)).otherwise(F.lit(1.0))
    return table, F.when(page.contains("reflectedinthousands"), F.lit(1e3)).otherwise(table)


def row_scale(section: str | Column, label: str | Column, table_scale: Column, share_scale: Column) -> Column:
    from ledgerloom.functions.text import key_form

    s = key_form(section)
    return F.when(s.contains("sharesused"), share_scale).when(s.contains("pershare") | key_form(label).contains("pershare"), F.lit(1.0)).otherwise(table_scale)
