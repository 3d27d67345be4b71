"""Label and text functions, as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The folding of printed signs in scored text, in this order.
CONVENTIONS = [
    ("®", ""),
    ("™", ""),
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("—", "-"),
    ("–", "-"),
    ("−", "-"),
    ("☒", "[X]"),
    ("☑", "[X]"),
    ("☐", "[ ]"),
    (" ", " "),
]
#: White space as the scored texts know it: the Unicode property, which includes no-break spaces.
UNICODE_SPACE = r"(?U)\s+"
#: White space as the SQL of the blocks knows it: a run of these inside a text, and the Unicode spaces (Zs) that its trim takes off the ends.
PLAIN_SPACE = r"[\t\n\f\r ]+"
ENDS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
ITEM = r"(?i)^\s*item\s+\d+[a-z]?\b"
RUNNING_FOOTER = r"(?i)form\s+10-[kq]\s*\|\s*\d+\s*$"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def key_form(x: str | Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c(x)), "[^a-z0-9]", "")


def label_form(x: str | Column) -> Column:
    """Straight quotes, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c(x), "‘’“”", "''\"\""), UNICODE_SPACE, " ")))


def line_part(x: str | Column) -> Column:
    """The part behind the last ': '."""
    return F.element_at(F.split(c(x), ": ", -1), -1)


def clean_text(x: str | Column) -> Column:
    """Single spaces; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c(x), UNICODE_SPACE, " ")), F.lit(""))


def plain_text(x: str | Column) -> Column:
    """Single spaces for plain white space; no-break and other spaces stay, but not at the ends. Nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c(x), PLAIN_SPACE, " "), F.lit(ENDS)), F.lit(""))


def fold_signs(x: str | Column) -> Column:
    """The substitutions of CONVENTIONS, without composition and entities (see fold_conventions)."""
    out = c(x)
    for sign, plain in CONVENTIONS:
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


@F.pandas_udf(StringType())
def fold_conventions(texts: pd.Series) -> pd.Series:
    """Character references, compatibility composition, then CONVENTIONS. Spark has no function for the first two."""

    def fold(text: str | None) -> str | None:
        if text is None:
            return None
        out = unicodedata.normalize("NFKC", html.unescape(text))
        for sign, plain in CONVENTIONS:
            out = out.replace(sign, plain)
        return out

    return texts.map(fold, na_action="ignore")


def scored_form(folded: str | Column) -> Column:
    """Folded text in lower case with single spaces. Punctuation stays: without its parentheses a negative number looks positive."""
    return F.trim(F.regexp_replace(F.lower(c(folded)), UNICODE_SPACE, " "))


def forward_slashes(x: str | Column) -> Column:
    return F.translate(c(x), "\\", "/")


def stem(ticker: str | Column, form: str | Column, period: str | Column) -> Column:
    return F.concat_ws("_", c(ticker), F.replace(c(form), F.lit("-"), F.lit("")), c(period))


def is_running_footer(x: str | Column) -> Column:
    return F.trim(F.element_at(F.split(F.trim(c(x)), "\n"), -1)).rlike(RUNNING_FOOTER)


def section_key(x: str | Column) -> Column:
    """'Item 7. ...' -> 'Item 7'; null where the text is no item heading."""
    return F.when(c(x).rlike(ITEM), F.trim(F.split_part(F.trim(c(x)), F.lit("."), F.lit(1))))


def word_tokens(x: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(c(x), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def header_lines(lines: str | Column) -> Column:
    """Lines of a header run without section labels (those that end in a colon)."""
    return F.filter(c(lines), lambda x: ~F.rtrim(x).endswith(":"))


def sha256(content: str | Column) -> Column:
    return F.sha2(c(content).cast("binary"), 256)


def format_measures(text: str | Column, comment: str = "<!--") -> dict[str, Column]:
    """Bytes, characters, tokens (a fourth of the characters) and provenance comments of an exported text."""
    x = c(text)
    chars = F.char_length(x).cast("long")
    return {"n_bytes": F.octet_length(x).cast("long"), "n_chars": chars, "approx_tokens": F.floor(chars / 4), "n_provenance": F.regexp_count(x, F.lit(comment)).cast("long")}
