"""Scores of extracted text and cells against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import c


def ratios(tp: Column, n_ref: Column, n_hyp: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    p, r = F.coalesce(F.try_divide(tp, n_hyp), F.lit(0.0)), F.coalesce(F.try_divide(tp, n_ref), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2.0 * tp, n_ref + n_hyp), F.lit(0.0))}


def multiset_score(pairs: DataFrame, ref: str, hyp: str, keys: list[str]) -> DataFrame:
    """Counting repeats: an item counts as often as both sides have it. ref and hyp are arrays; counts are combined before the shuffle."""
    rows = pairs.select(*keys, F.explode(ref).alias("item"), F.lit(1).alias("r"), F.lit(0).alias("h")).unionByName(pairs.select(*keys, F.explode(hyp).alias("item"), F.lit(0).alias("r"), F.lit(1).alias("h")))
    counted = rows.groupBy(*keys, "item").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    total = counted.groupBy(*keys).agg(F.sum(F.least("r", "h")).alias("tp"), F.sum("r").alias("ref_n"), F.sum("h").alias("hyp_n"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    out = pairs.select(*keys).distinct().join(total, keys, "left").select(*keys, zero("tp"), zero("ref_n"), zero("hyp_n"))
    return out.withColumns(ratios(F.col("tp"), F.col("ref_n"), F.col("hyp_n")))


def set_score(ref: str | Column, hyp: str | Column) -> dict[str, Column]:
    """On arrays of one row, as sets."""
    r, h = F.array_distinct(c(ref)), F.array_distinct(c(hyp))
    tp, n, m = (F.size(x).cast("long") for x in (F.array_intersect(r, h), r, h))
    return {"tp": tp, "ref_n": n, "hyp_n": m, **ratios(tp, n, m)}


def word_errors(ref: str | Column, hyp: str | Column) -> Column:
    """Edits between word sequences. Each distinct word of the pair becomes one character, so the built-in edit distance counts words."""
    r, h = c(ref), c(hyp)
    names = F.array_distinct(F.concat(r, h))
    # CJK from U+4E00, then the private plane by surrogate-free code points: up to 20,000 distinct words
    char = lambda w: F.decode(F.unhex(F.lpad(F.hex(19967 + F.array_position(names, w)), 4, "0")), "UTF-16BE")
    text = lambda ws: F.array_join(F.transform(ws, char), "")
    return F.levenshtein(text(r), text(h))


def error_rates(ref: str | Column, hyp: str | Column) -> dict[str, Column]:
    """Word and character error rates of scored text; a lost page is all wrong, without reference there is no rate."""
    r, h = c(ref), c(hyp)
    rw, hw = (F.filter(F.split(x, " "), lambda w: w != "") for x in (r, h))
    lost = F.coalesce(h, F.lit("")) == ""
    rate = lambda errors, n: F.when(r != "", F.when(lost, F.lit(1.0)).otherwise(errors / n))
    return {"wer": rate(word_errors(rw, hw), F.size(rw)), "cer": rate(F.levenshtein(r, h), F.char_length(r)), "ref_words": F.size(rw).cast("long"), "hyp_words": F.size(hw).cast("long")}


def page_outcomes(expected: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """measured, missing (the document has an export, this page has none) or unmeasured (no export at all)."""
    own = pages.select(doc, page).distinct().withColumn("_page", F.lit(True))
    docs = pages.select(doc).distinct().withColumn("_doc", F.lit(True))
    out = expected.join(own, [doc, page], "left").join(docs, doc, "left")
    return out.withColumn("outcome", F.when(F.col("_page"), "measured").when(F.col("_doc"), "missing").otherwise("unmeasured")).drop("_page", "_doc")


def strata(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean, best and worst of each value per stratum and over all ('ALL')."""
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    g = metrics.rollup(*by).agg(F.count("*").alias("n"), *aggs, F.grouping_id().alias("_g"))
    names = [F.when(F.col("_g").bitwiseAND(1 << (len(by) - 1 - i)) > 0, F.lit("ALL")).otherwise(F.col(x).cast("string")).alias(x) for i, x in enumerate(by)]
    return g.select(*names, "n", *[a for v in values for a in (f"{v}_mean", f"{v}_min", f"{v}_max")])


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics: metric, value. thresholds: metric, op ('<=' or '>='), threshold (a short table). A metric that was not measured fails."""
    rows = thresholds.join(metrics, "metric", "left")
    passed = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return rows.withColumn("passed", F.coalesce(passed, F.lit(False)))


def strip_section(label: str | Column, headings: str | Column) -> Column:
    """Without the longest of the table's own headings that it starts with."""
    x = c(label)
    ordered = F.array_sort(c(headings), lambda a, b: (F.char_length(b) - F.char_length(a)).cast("int"))
    hit = F.get(F.filter(ordered, lambda h: F.startswith(x, F.concat(h, F.lit(" ")))), F.lit(0))
    return F.when(hit.isNotNull(), F.substring(x, F.char_length(hit) + 2, F.char_length(x))).otherwise(x)


def section_headings(rows: DataFrame, table: list[str], label: str, value: str) -> DataFrame:
    """Labels of a table that end in a colon and never have a value."""
    g = rows.groupBy(*table, label).agg(F.max(F.col(value).isNotNull()).alias("has"))
    return g.where(~F.col("has") & F.col(label).endswith(":")).groupBy(*table).agg(F.collect_set(label).alias("headings"))


# ---------------------------------------------------------------- deliberate faults

FAULTS = ("none", "no-scale", "drop-parens", "no-ocr", "strip-prefix", "drop-words")


def degrade(records: DataFrame, fault: str) -> DataFrame:
    """Break one behaviour of records (text, ocr, rows, raw_cells), to see that the scores notice."""
    if fault not in FAULTS:
        raise ValueError(f"unknown fault {fault}")
    no_parens = lambda x: F.translate(x, "()", "")
    grid = lambda name, f: F.transform(name, lambda row: F.transform(row, f))
    if fault == "no-ocr":
        return records.where(~F.coalesce("ocr", F.lit(False)))
    if fault == "no-scale":
        raw = F.coalesce("raw_cells", "rows")
        return records.withColumn("rows", F.transform("rows", lambda row, i: F.transform(row, lambda x, j: F.when(j == 0, x).otherwise(F.trim(F.translate(F.coalesce(F.get(F.get(raw, i), j), x), ",$", ""))))))
    if fault == "drop-parens":
        return records.withColumns({"text": no_parens("text"), "rows": grid("rows", no_parens), "raw_cells": grid("raw_cells", no_parens)})
    if fault == "strip-prefix":
        last = lambda x, i: F.when(i == 0, F.element_at(F.split(x, ": "), -1)).otherwise(x)
        return records.withColumns({"rows": grid("rows", last), "raw_cells": grid("raw_cells", last)})
    if fault == "drop-words":
        words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
        return records.withColumn("text", F.array_join(F.filter(words, lambda w, i: (i + 1) % 5 != 0), " "))
    return records


def length_histogram(df: DataFrame, length: str, bins: int = 40, top: int = 2000) -> DataFrame:
    """Counts by bin of lengths 0 to top; the last bin includes top, longer ones are left out."""
    width = top // bins
    inside = df.where(F.col(length).between(0, top))
    return inside.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(length) / width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def metric_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    a, b = old.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    return a.join(b, keys, "full_outer").withColumn("change", F.col("new") - F.col("old"))


def _agreement(found: DataFrame, truth: DataFrame, table: list[str], key: list[str], name: str) -> DataFrame:
    """F1 of the cells of each table by key, repeats counted. Both sides become counts with a sign in one aggregate, so no join is needed."""
    both = found.select(*table, *key, F.lit(1).alias("h"), F.lit(0).alias("r")).unionByName(truth.select(*table, *key, F.lit(0).alias("h"), F.lit(1).alias("r")))
    counts = both.groupBy(*table, *key).agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    return counts.groupBy(*table).agg((2.0 * F.sum(F.least("h", "r")) / F.sum(F.col("h") + F.col("r"))).alias(name))


def cell_scores(found: DataFrame, truth: DataFrame, table: list[str]) -> DataFrame:
    """cell_f1 (label, column, value in full units), raw_f1 (label, column, printed value) and value_f1 (value alone) of each table, from cells with
    label, col_index, raw and scale. A table that one side lacks scores 0; null labels equal each other."""
    full = [x.withColumn("value", F.col("raw") * F.col("scale")) for x in (found, truth)]
    out = _agreement(*full, table, ["label", "col_index", "value"], "cell_f1")
    out = out.join(_agreement(*full, table, ["label", "col_index", "raw"], "raw_f1"), table)
    return out.join(_agreement(*full, table, ["value"], "value_f1"), table)


def side_by_side(scores: DataFrame, table: list[str], path: str, score: str, paths: list[str], only: str) -> DataFrame:
    """A column for each path, for the tables that the path `only` has."""
    one = lambda p: F.max(F.when(F.col(path) == p, F.col(score))).alias(p)
    has = F.count_if(F.col(path) == only).alias("_has")
    return scores.groupBy(*table).agg(*[one(p) for p in paths], has).where("_has > 0").drop("_has")
