"""Reporting periods, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import named
from ledgerloom.functions.text import c, label_form

MONTHS = "January February March April May June July August September October November December".split()
# Duration phrases of headers, squeezed, and their tags.
PHRASES = [("threemonthsended", "3M"), ("sixmonthsended", "6M"), ("ninemonthsended", "9M"), ("twelvemonthsended", "FY"), ("yearsended", "FY"), ("yearended", "FY")]
DAYS_PER_MONTH = 30.44


def period_fields(start: str | Column, end: str | Column) -> dict[str, Column]:
    """Type, months and label of a period that ends on the given last day; no start: an instant; no end: forever."""
    s, e = c(start), c(end)
    months = F.bround(F.datediff(e, s) / DAYS_PER_MONTH).cast("int")
    duration = s.isNotNull() & e.isNotNull()
    day = F.date_format(e, "yyyy-MM-dd")
    return {
        "period_type": F.when(duration, "duration").when(e.isNotNull(), "instant").otherwise("forever"),
        "months": F.when(duration, months),
        "period_label": F.when(duration, F.concat(F.when(months == 12, F.lit("FY")).otherwise(F.concat(months.cast("string"), F.lit("M"))), F.lit(" ended "), day)).otherwise(day),
    }


def instant_of_label(label: str | Column) -> Column:
    """'opening', 'end' or '' by the words of a balance line."""
    x = label_form(label)
    return F.when(x.rlike(r"\b(beginning|opening)\b"), "opening").when(x.rlike(r"\b(ending|closing)\b"), "end").otherwise("")


def period_options(period: str | Column, start: str | Column, end: str | Column) -> Column:
    """The column's own period; of a duration also its last day and the day before it began."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return F.when(c(start).isNull(), F.array(c(period))).otherwise(F.array(c(period), day(c(end)), day(F.date_sub(c(start), 1))))


def instant_options(options: str | Column, instant: str | Column) -> Column:
    """The options that a line may refer to, settled before any value is looked at."""
    o = c(options)
    return F.when(F.size(o) == 1, o).when(c(instant) == "end", F.slice(o, 2, 1)).when(c(instant) == "opening", F.slice(o, 3, 1)).otherwise(o)


def column_labels(cells: str | Column, n_cols: int | Column) -> Column:
    """Period labels of n_cols columns from header cells; col1 to coln where dates don't add up."""
    n = n_cols if isinstance(n_cols, Column) else F.lit(n_cols)
    joined = F.regexp_replace(F.array_join(c(cells), "|"), r"\s+", "|")
    return named(joined, lambda j: named(F.replace(j, F.lit("|"), F.lit("")), lambda s: _labels(j, s, n)))


def _labels(joined: Column, squeezed: Column, n: Column) -> Column:
    month = "(" + "|".join(MONTHS) + r")(\d{1,2})"
    names, days = F.regexp_extract_all(squeezed, F.lit(month), F.lit(1)), F.regexp_extract_all(squeezed, F.lit(month), F.lit(2))
    years = F.regexp_extract_all(joined, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    numbers = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])
    day_of = lambda names, days, years: F.transform(F.arrays_zip(names.alias("m"), days.alias("d"), years.alias("y")), lambda x: F.concat_ws("-", x["y"], F.element_at(numbers, x["m"]), F.lpad(x["d"], 2, "0")))
    low = F.lower(squeezed)
    found = F.array_sort(F.filter(F.array(*[F.struct(F.instr(low, p).alias("at"), F.lit(tag).alias("tag")) for p, tag in PHRASES]), lambda x: x["at"] > 0))
    with_tag = lambda tag, d: F.concat(tag, F.lit(" ended "), d)

    def tagged(tags: Column, dates: Column) -> Column:
        return (
            F.when(F.size(tags) == 1, F.transform(dates, lambda d: with_tag(F.get(tags, F.lit(0)), d)))
            .when((F.size(tags) == 2) & (n % 2 == 0), F.transform(dates, lambda d, i: with_tag(F.get(tags, F.when(i < n / 2, 0).otherwise(1)), d)))
            .otherwise(dates)
        )

    tags = F.array_distinct(F.transform(found, lambda x: x["tag"]))
    plain = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("col"), i.cast("string")))
    parts = F.struct(names.alias("m"), days.alias("d"), years.alias("y"))
    labelled = lambda p: named(tags, lambda t: named(day_of(p["m"], p["d"], p["y"]), lambda d: tagged(t, d)))
    return named(parts, lambda p: F.when((F.size(p["m"]) == n) & (F.size(p["y"]) == n), labelled(p)).otherwise(plain))
