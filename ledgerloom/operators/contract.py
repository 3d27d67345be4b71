"""The contract table: one row per cell of a page's grid.

All that a page needs is one row of the input, so the plan is a projection without a shuffle: a page's lines, grid rows and word lines
are arrays, and what depends on order (headers in force, the cursor of the match, open sections) is a fold over one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.boxes import distance_to_span, word_lines
from ledgerloom.functions.numbers import cell_token, closed_paren, full_value, header_unit, is_counted, is_data_line, is_number, is_year_row, named, page_scale, row_scale, token_value
from ledgerloom.functions.periods import MONTHS, column_labels
from ledgerloom.functions.text import c, key_form

# Distances in points, and letters that a label must share to count as evidence.
NEAR_COLUMN, HEADER_GAP, PROSE_GAP, LABEL_MARGIN = 45, 30, 6, 20
LEAST_FRAGMENT, LEAST_LABEL = 3, 6
DATED = "(" + "|".join(MONTHS) + r")\d{1,2}"


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def amount(cell: Column) -> Column:
    """full_value, for use in a lambda (a lambda's second parameter is the place, not the scale)."""
    return named(cell_token(cell), lambda token: token_value(token))


def last_of(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


# ---------------------------------------------------------------- lines and grid


def text_lines(page_text: str | Column) -> Column:
    """Lines of a page: text, label, key of the label, values at its end, and whether it is a data line."""

    def line(text: Column) -> Column:
        tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")

        def cut(parts: Column) -> Column:
            wordy = F.transform(parts, lambda t, i: F.when(is_number(t) | (t == "$"), 0).otherwise(i + 1))
            return named(F.coalesce(F.array_max(wordy), F.lit(0)), lambda n: named(F.array_join(F.slice(parts, F.lit(1), n), " "), lambda label: told(parts, n, label)))

        def told(parts: Column, n: Column, label: Column) -> Column:
            values = F.transform(F.filter(F.slice(parts, n + 1, F.size(parts)), lambda t: t != "$"), amount)
            data = named(F.transform(parts, is_counted), lambda kinds: F.array_contains(kinds, True) & F.array_contains(kinds, False))
            return F.struct(text.alias("text"), label.alias("label"), key_form(label).alias("key"), values.alias("values"), data.alias("data"))

        return named(tokens, cut)

    return F.transform(F.split(F.coalesce(c(page_text), F.lit("")), "\n"), line)


def modal_width(data: Column) -> Column:
    """Most common number of values of the data rows, the first seen on ties; null without rows."""

    def most(widths: Column, kinds: Column) -> Column:
        counts = F.transform(kinds, lambda k: F.size(F.filter(widths, lambda w: w == k)))
        return F.get(kinds, named(counts, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int")))

    return named(F.transform(data, lambda r: F.size(r["numbers"])), lambda widths: named(F.array_distinct(widths), lambda kinds: most(widths, kinds)))


def header_blocks(lines: str | Column, n: Column) -> Column:
    """For each line the period labels in force (null: none) and the number of the header block they come from, 0 above all of them.

    A run of lines that aren't data heads the data line below it. Its end is read as a header from the longest part that parses; a run with
    dates that don't fit the columns ends the header before, as those of another table would be wrong."""
    start = F.struct(empty("string").alias("run"), F.lit(None).cast("array<string>").alias("periods"), F.lit(0).alias("block"), empty("struct<periods:array<string>,block:int>").alias("out"))

    def headed(state: Column) -> Column:
        return named(F.filter(state["run"], lambda t: ~F.rtrim(t).endswith(":")), read)

    def read(heads: Column) -> Column:
        tails = F.transform(heads, lambda _, i: column_labels(F.slice(heads, i + 1, F.size(heads)), n))
        found = F.get(F.filter(tails, lambda x: ~F.get(x, F.lit(0)).startswith("col")), F.lit(0))
        dated = F.regexp_replace(F.array_join(heads, ""), r"\s", "").rlike(DATED)
        return F.struct(found.alias("found"), dated.alias("dated"))

    def step(state: Column, line: Column) -> Column:
        none = F.struct(F.lit(None).cast("array<string>").alias("found"), F.lit(False).alias("dated"))

        def after(h: Column) -> Column:
            new = h["found"].isNotNull()
            periods = F.when(new, h["found"]).when(~h["dated"], state["periods"])
            block = state["block"] + new.cast("int")
            run = F.when(line["data"], empty("string")).otherwise(F.array_append(state["run"], line["text"]))
            return F.struct(run.alias("run"), periods.alias("periods"), block.alias("block"), F.array_append(state["out"], F.struct(periods.alias("periods"), block.alias("block"))).alias("out"))

        return named(F.when(line["data"] & (F.size(state["run"]) > 0), headed(state)).otherwise(none), after)

    return F.aggregate(c(lines), start, step, lambda state: state["out"])


def matched(rows: str | Column, lines: str | Column, n: Column) -> Column:
    """Grid rows (labels, numbers) with the page lines that carry their values, met in order: met (first line that was free, line, numbers), and
    how many rows were skipped. Where several lines have the values, the row's own label decides, else the line must be the only one."""
    rows, lines = c(rows), c(lines)
    start = F.struct(F.lit(0).alias("free"), F.lit(0).alias("skipped"), empty("struct<free:int,at:int,numbers:array<string>>").alias("met"))

    def step(state: Column, row: Column) -> Column:
        numbers = F.slice(row["numbers"], F.greatest(F.size(row["numbers"]) - n, F.lit(0)) + 1, F.greatest(n, F.lit(0)))

        def chosen(same: Column, own: Column) -> Column:
            def fits(i: Column) -> Column:
                line, above = F.get(lines, i), F.get(lines, i - 1)
                before = F.when((i > 0) & (F.size(above["values"]) == 0), above["key"]).otherwise(F.lit(""))
                return F.concat(before, line["key"]).contains(own) | (F.char_length(line["key"]) >= LEAST_LABEL) & own.contains(line["key"])

            evident = F.when(F.char_length(own) >= LEAST_FRAGMENT, F.get(F.filter(same, fits), F.lit(0)))
            return F.coalesce(evident, F.when(F.size(same) == 1, F.get(same, F.lit(0))))

        def alike(want: Column) -> Column:
            return F.filter(F.transform(lines, lambda x, i: F.when((i >= state["free"]) & (x["values"] == want), i)), lambda i: i.isNotNull())

        def place(numbers: Column) -> Column:
            own = key_form(F.array_join(row["labels"], ""))
            same = named(F.transform(numbers, amount), alike)
            at = F.when(F.size(numbers) == n, named(same, lambda s: named(own, lambda o: chosen(s, o))))
            return named(at, lambda i: after(i, numbers))

        def after(i: Column, numbers: Column) -> Column:
            hit = F.struct(state["free"].alias("free"), i.alias("at"), numbers.alias("numbers"))
            return F.struct(
                F.coalesce(i + 1, state["free"]).alias("free"), (state["skipped"] + i.isNull().cast("int")).alias("skipped"), F.when(i.isNull(), state["met"]).otherwise(F.array_append(state["met"], hit)).alias("met")
            )

        return named(numbers, place)

    counted = F.filter(rows, lambda r: (F.size(r["numbers"]) > 0) & ~is_year_row(r["labels"], r["numbers"]))
    return F.aggregate(counted, start, step)


def labelled(met: str | Column, lines: str | Column, heads: str | Column) -> Column:
    """rows (section, label, numbers, block, periods) of the matches, and how many have no label. Lines passed on the way open sections (those
    that end in a colon) or begin a label of two lines; a total closes its section, and a new header block all."""
    lines, heads = c(lines), c(heads)
    row = "struct<section:string,label:string,numbers:array<string>,block:int,periods:array<string>>"
    start = F.struct(F.lit("").alias("section"), F.lit(-1).alias("block"), F.lit(0).alias("bare"), empty(row).alias("rows"))

    def step(state: Column, m: Column) -> Column:
        passed = F.filter(F.slice(lines, m["free"] + 1, m["at"] - m["free"]), lambda x: (F.size(x["values"]) > 0) | (x["label"] != ""))
        return named(F.get(heads, m["at"]), lambda head: named(passed, lambda p: labelled_by(state, m, head, p)))

    def labelled_by(state: Column, m: Column, head: Column, passed: Column) -> Column:
        bare = lambda x: F.size(x["values"]) == 0
        opened = last_of(F.filter(passed, lambda x: bare(x) & x["label"].endswith(":")))["label"]
        section = F.coalesce(F.trim(F.substring(opened, F.lit(1), F.char_length(opened) - 1)), F.when(head["block"] == state["block"], state["section"]).otherwise(F.lit("")))
        last = last_of(passed)
        begun = F.when((m["free"] > 0) & bare(last) & ~last["label"].endswith(":"), last["label"])
        label = F.concat_ws(" ", begun, F.nullif(F.get(lines, m["at"])["label"], F.lit("")))

        def after(x: Column) -> Column:
            done = F.struct(x["section"].alias("section"), x["label"].alias("label"), m["numbers"].alias("numbers"), head["block"].alias("block"), head["periods"].alias("periods"))
            none = x["label"] == ""
            return F.struct(
                F.when(key_form(x["label"]).startswith("total"), F.lit("")).otherwise(x["section"]).alias("section"),
                head["block"].alias("block"),
                (state["bare"] + none.cast("int")).alias("bare"),
                F.when(none, state["rows"]).otherwise(F.array_append(state["rows"], done)).alias("rows"),
            )

        return named(F.struct(section.alias("section"), label.alias("label")), after)

    return F.aggregate(c(met), start, step)


# ---------------------------------------------------------------- units of columns, from word boxes


def lines_met(lines: str | Column, word_rows: str | Column) -> Column:
    """For each text line the place (from 1) of the next line of words that reads the same, in order; null if there is none."""
    keys = F.transform(c(word_rows), lambda line: key_form(F.array_join(F.transform(line, lambda w: w["text"]), "")))
    start = F.struct(F.lit(0).alias("free"), empty("int").alias("at"))

    def step(state: Column, line: Column) -> Column:
        key = key_form(line["text"])
        place = F.array_position(F.slice(keys, state["free"] + 1, F.size(keys)), key).cast("int")
        at = F.when((key != "") & (place > 0), state["free"] + place)
        return F.struct(F.coalesce(at, state["free"]).alias("free"), F.array_append(state["at"], at).alias("at"))

    return F.aggregate(c(lines), start, step, lambda s: s["at"])


def trailing_numbers(line: Column) -> Column:
    """The number words at a line's end, '$' left out."""
    words = F.filter(line, lambda w: w["text"] != "$")
    wordy = F.transform(words, lambda w, i: F.when(is_number(w["text"]), 0).otherwise(i + 1))
    n = F.coalesce(F.array_max(wordy), F.lit(0))
    return F.slice(words, n + 1, F.size(words))


def column_units(word_rows: str | Column, rows: Column, n: Column, share_scale: Column) -> Column:
    """Scale that the words above a block's first row state for each of its columns, or null. rows: places (from 1) of its lines of words.

    A column spans its numbers. Header lines are those above, up to a wide gap, a line of prose or another data line; each word of
    theirs that isn't above the labels belongs to the nearest column, if that is near."""
    every = c(word_rows)
    tails = F.filter(F.transform(rows, lambda r: trailing_numbers(F.get(every, r - 1))), lambda t: F.size(t) >= n)

    def span(k: Column) -> Column:
        own = F.transform(tails, lambda t: F.get(t, F.size(t) - n + k))
        return F.struct(F.array_min(F.transform(own, lambda w: w["x0"])).alias("low"), F.array_max(F.transform(own, lambda w: w["x1"])).alias("high"))

    spans = F.transform(F.sequence(F.lit(0), n - 1), span)
    first = F.array_min(rows)
    middle = lambda w: (w["x0"] + w["x1"]) / 2

    def units(columns: Column) -> Column:
        edge = F.get(columns, F.lit(0))["low"] - LABEL_MARGIN
        top = lambda line: F.get(line, F.lit(0))["top"]
        above = F.transform(F.sequence(F.lit(1), first), lambda i: F.get(every, first - i))  # the first row, and lines upwards

        def ends(line: Column, i: Column) -> Column:
            gaps = F.transform(F.slice(line, F.lit(2), F.size(line)), lambda w, k: w["x0"] - F.get(line, k)["x1"])
            prose = (F.size(line) >= 4) & F.forall(gaps, lambda g: g < PROSE_GAP)
            told = F.exists(line, lambda w: middle(w) >= edge) & (prose | is_data_line(F.array_join(F.transform(line, lambda w: w["text"]), " ")))
            return (i > 0) & ((top(F.get(above, i - 1)) - top(line) > HEADER_GAP) | told)

        stop = F.array_position(F.transform(above, ends), F.lit(True)).cast("int")
        heads = F.slice(above, F.lit(2), F.when(stop > 0, stop - 2).otherwise(F.size(above) - 1))
        words = F.filter(F.flatten(heads), lambda w: middle(w) >= edge)

        def nearest(w: Column) -> Column:
            far = F.transform(columns, lambda s: distance_to_span(middle(w), s["low"], s["high"]))
            return F.when(F.array_min(far) <= NEAR_COLUMN, F.array_position(far, F.array_min(far)))

        placed = F.transform(words, lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["text"].alias("text"), nearest(w).alias("k")))
        said = lambda k: F.array_join(F.transform(F.array_sort(F.filter(placed, lambda w: w["k"] == k + 1)), lambda w: w["text"]), " ")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: header_unit(said(k), share_scale))

    return F.when(F.size(tails) > 0, named(spans, units))


# ---------------------------------------------------------------- the table


def to_long(pages: DataFrame, keys: list[str], grid: str = "grid", page_text: str = "page_text", words: str | None = None) -> DataFrame:
    """One row per cell of each accepted grid: keys, row_no, row_label, col_no, col_label, raw, value, scale, and rows skipped on the page.
    Numbers come from the grid; labels, sections and periods from the page's own lines. Columns of pages other than the keys may have any names.

    Null or empty grids and grids without data rows give nothing; a null page text matches nothing; equal rows give equal cells."""
    from ledgerloom.operators.tables import data_rows, row_parts

    at = lambda name: F.col(f"_{name}")
    df = pages.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(grid).alias("_grid"), F.coalesce(F.col(page_text), F.lit("")).alias("_text"), *([F.col(words).alias("_words")] if words else []))
    df = df.withColumn("_rows", row_parts("_grid")).withColumn("_n", modal_width(data_rows("_rows")))
    first = F.array_position(F.transform("_rows", lambda r: (F.size(r["numbers"]) >= 2) & ~is_year_row(r["labels"], r["numbers"])), F.lit(True)).cast("int")
    above = F.filter(F.flatten(F.slice(at("grid"), F.lit(1), F.greatest(first - 1, F.lit(0)))), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    table, share = page_scale("_text")
    df = df.withColumns({"_fallback": column_labels(above, at("n")), "_scale": table, "_share": share, "_lines": text_lines("_text")})
    df = df.withColumns({"_heads": header_blocks("_lines", at("n")), "_match": matched("_rows", "_lines", at("n"))})
    df = df.withColumn("_labelled", labelled("_match.met", "_lines", "_heads"))
    if words:
        df = df.withColumn("_word_rows", word_lines(F.coalesce(at("words"), F.array().cast(pages.schema[words].dataType)))).withColumn("_place", lines_met("_lines", "_word_rows"))
        of_block = lambda b: F.filter(F.transform(F.filter("_match.met", lambda m: F.get(at("heads"), m["at"])["block"] == b), lambda m: F.get(at("place"), m["at"])), lambda p: p.isNotNull())
        blocks = F.array_distinct(F.transform("_match.met", lambda m: F.get(at("heads"), m["at"])["block"]))
        df = df.withColumn("_units", F.map_from_entries(F.transform(blocks, lambda b: F.struct(b, column_units("_word_rows", of_block(b), at("n"), at("share"))))))
    # the filter that Spark infers from the explode isn't pushed below a column that isn't deterministic, where it would repeat all of the above
    df = df.withColumn("_once", F.spark_partition_id()).withColumn("_skipped", F.col("_match.skipped") + F.col("_labelled.bare"))
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*ks, "_text", "_n", "_scale", "_share", "_fallback", (F.col("_skipped") + F.least("_once", F.lit(0))).alias("_skipped"), *(["_units"] if words else []), F.posexplode("_labelled.rows").alias("row_no", "_row"))
    cells = rows.select("*", F.posexplode("_row.numbers").alias("col_no", "raw"))
    row = F.col("_row")
    plain = F.concat(F.lit("col"), (F.col("col_no") + 1).cast("string"))
    names = F.coalesce(F.get(row["periods"], F.col("col_no")), F.when(row["block"] == 0, F.get(at("fallback"), F.col("col_no"))), plain)
    base = row_scale(row["section"], row["label"], at("scale"), at("share"))
    scale = F.coalesce(F.get(F.element_at("_units", row["block"]), F.col("col_no")), base) if words else base
    cells = cells.withColumn("scale", scale)
    label = F.when(row["section"] != "", F.concat(row["section"], F.lit(": "), row["label"])).otherwise(row["label"])
    return cells.select(
        *[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "row_no", label.alias("row_label"), "col_no", names.alias("col_label"), closed_paren("raw", "_text").alias("raw"), full_value("raw", F.col("scale")).alias("value"), "scale", F.col("_skipped").alias("skipped")
    )
