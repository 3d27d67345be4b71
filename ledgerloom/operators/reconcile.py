"""Reconciliation of printed cells with tagged facts: label layers, resolution, status, missing cells, rates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.periods import instant_of_label, instant_options, period_options
from ledgerloom.functions.text import label_form, line_part

SCALE_EXPONENTS = (3, 6, 9)
NEGATED_CAUSE = "presentation: negated label in _pre.xml"
LAYERS = ["manual", "label", "fuzzy"]


def tolerance(decimals: str | Column) -> Column:
    """Half a unit of the last reported digit; 0.5 for exact or missing decimals."""
    d = F.col(decimals) if isinstance(decimals, str) else decimals
    n = d.try_cast("double")
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return F.when(finite, 0.5 * F.pow(F.lit(10.0), -n)).otherwise(F.lit(0.5))


def status(printed: str | Column, tagged: str | Column, tol: str | Column) -> Column:
    """First rule that holds: missing, match, sign, scale, mismatch. Zero is never a scale error."""
    p, x, t = (F.col(v) if isinstance(v, str) else v for v in (printed, tagged, tol))
    out = F.when(p.isNull() | F.isnan(p), "pdf_missing").when(x.isNull() | F.isnan(x), "xbrl_missing").when(F.abs(p - x) <= t, "match").when(F.abs(F.abs(p) - F.abs(x)) <= t, "sign")
    both = (p != 0) & (x != 0)
    for e in SCALE_EXPONENTS:
        k = float(10**e)
        out = out.when(both & (F.abs(F.abs(p) * k - F.abs(x)) <= F.greatest(t, F.lit(k / 2))), f"scale_x1e{e}")
        out = out.when(both & (F.abs(F.abs(p) - F.abs(x) * k) <= F.greatest(t * k, F.lit(k / 2))), f"scale_x1e-{e}")
    return out.otherwise("mismatch")


def curated_matches(cells: DataFrame, label_map: DataFrame, key: str = "cell_id") -> DataFrame:
    """Layer 1. cells: key, statement, label. label_map: entry_no, statement, pdf, match, prefix, concept, dims, instant. An equi join for exact labels, another on
    the length-free statement key for prefix entries (few by construction); the first entry wins."""
    entries = label_map.withColumn("entry_key", label_form("pdf"))
    own = cells.withColumn("cell_key", label_form("label"))
    take = [key, "entry_no", "prefix", "concept", "dims", "instant", "pdf"]
    exact = own.join(entries, (own["cell_key"] == entries["entry_key"]) & (own["statement"] == entries["statement"])).select(*take)
    by_prefix = entries.where(F.col("match") == "prefix")
    starts = own.join(by_prefix, (own["statement"] == by_prefix["statement"]) & F.startswith(own["cell_key"], by_prefix["entry_key"])).select(*take)
    best = exact.unionByName(starts).groupBy(key).agg(F.min_by(F.struct("prefix", "concept", "dims", "instant", "pdf"), "entry_no").alias("e"))
    return best.select(
        key, F.lit("manual").alias("mapping"), F.coalesce("e.prefix", F.lit("us-gaap")).alias("prefix"), F.col("e.concept").alias("concept"), F.coalesce("e.dims", F.lit("")).alias("dims"), F.coalesce(F.nullif(F.col("e.instant"), F.lit("")), instant_of_label("e.pdf")).alias("instant"), F.lit(0).alias("rank")
    )


def linkbase_matches(cells: DataFrame, labels: DataFrame, key: str = "cell_id") -> DataFrame:
    """Layer 2. labels: stem, text_key, prefix, concept, ord. The full label first, else the part behind the last ': '."""
    full = cells.withColumn("k", label_form("label")).join(labels, (F.col("k") == labels["text_key"]) & (cells["stem"] == labels["stem"]))
    part = cells.withColumn("k", label_form(line_part("label"))).join(labels, (F.col("k") == labels["text_key"]) & (cells["stem"] == labels["stem"]))
    rows = full.select(key, F.lit(1).alias("way"), "prefix", "concept", "ord", "label").unionByName(part.select(key, F.lit(2).alias("way"), "prefix", "concept", "ord", "label"))
    first = rows.withColumn("least", F.min("way").over(Window.partitionBy(key))).where("way = least")
    return first.select(key, F.lit("label").alias("mapping"), "prefix", "concept", F.lit("").alias("dims"), instant_of_label("label").alias("instant"), F.col("ord").alias("rank"))


def fuzzy_best(labels: DataFrame, choices: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """Layer 3: the most similar choice of each label by matching blocks (2 M / T), at least cutoff. labels: stem, label_key; choices: stem, text_key.

    Choices meet labels by stem and a length band that the measure allows (2 min / (a + b) >= cutoff), so the pairs compared are bounded
    by what can match; the measure itself runs over Arrow batches."""
    a, b = labels.select("stem", "label_key").distinct(), choices.select("stem", "text_key").distinct()
    width = 8
    low, high = F.ceil(F.char_length("label_key") * cutoff / (2 - cutoff)), F.floor(F.char_length("label_key") * (2 - cutoff) / cutoff)
    banded = a.withColumn("band", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    pairs = banded.join(b.withColumn("band", F.floor(F.char_length("text_key") / width)), ["stem", "band"]).where(F.char_length("text_key").between(low, high))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, t, s).ratio() for s, t in zip(x, y, strict=True)], dtype=float)

    scored = pairs.select("stem", "label_key", "text_key", ratio("label_key", "text_key").alias("ratio")).where(F.col("ratio") >= cutoff)
    return scored.groupBy("stem", "label_key").agg(F.max(F.struct("ratio", "text_key")).alias("m")).select("stem", "label_key", F.col("m.text_key").alias("text_key"), F.col("m.ratio").alias("ratio"))


def layered(*layers: DataFrame, key: str = "cell_id") -> DataFrame:
    """Candidates of the first layer that has any for a cell."""
    rows = None
    for i, layer in enumerate(layers):
        layer = layer.withColumn("layer", F.lit(i))
        rows = layer if rows is None else rows.unionByName(layer)
    return rows.withColumn("_first", F.min("layer").over(Window.partitionBy(key))).where("layer = _first").drop("_first")


def resolve(cells: DataFrame, candidates: DataFrame, index: DataFrame, bounds: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row per cell: match before sign before the only concept with a fact; several concepts without agreement are 'ambiguous'; no candidate is 'none'."""
    options = cells.join(bounds, "period_label", "left").join(candidates, key).select(
        key, "stem", "value", "mapping", "prefix", "concept", "dims", "rank", F.posexplode(instant_options(period_options("period_label", "start", "end"), "instant")).alias("option_no", "xbrl_period")
    )
    facts = index.select("stem", "prefix", "concept", "dims", F.col("period_label").alias("xbrl_period"), F.col("value").alias("xbrl_value"), "decimals")
    tried = options.join(facts, ["stem", "prefix", "concept", "dims", "xbrl_period"], "left")
    st = F.when(F.col("xbrl_value").isNotNull(), status("value", "xbrl_value", tolerance("decimals")))
    tried = tried.withColumn("st", st)
    choice = F.struct("mapping", "prefix", "concept", "dims", "xbrl_period", "xbrl_value", "decimals")
    order = F.struct("rank", "prefix", "concept", "option_no")
    picked = tried.groupBy(key).agg(
        F.min_by(F.when(F.col("st") == "match", choice), F.when(F.col("st") == "match", order)).alias("match"),
        F.min_by(F.when(F.col("st") == "sign", choice), F.when(F.col("st") == "sign", order)).alias("sign"),
        F.min_by(F.when(F.col("st").isNotNull(), choice), F.when(F.col("st").isNotNull(), order)).alias("found"),
        F.min_by(choice, order).alias("first"),
        F.count_distinct("prefix", "concept", "dims").alias("concepts"),
    )
    best = F.coalesce("match", "sign", F.when(F.col("concepts") == 1, F.coalesce("found", F.col("first"))))
    out = cells.join(picked, key, "left").withColumn("best", best)
    none = F.col("concepts").isNull()
    own = lambda name, empty: F.when(F.col("best").isNotNull(), F.col(f"best.{name}")).otherwise(empty)
    tagged = F.col("best.xbrl_value")
    out = out.select(
        *cells.columns,
        F.when(none, "none").when(F.col("best").isNull(), "ambiguous").otherwise(F.col("best.mapping")).alias("mapping"),
        own("prefix", F.lit("")).alias("prefix"),
        own("concept", F.lit("")).alias("concept"),
        own("dims", F.lit("")).alias("dims"),
        F.when(tagged.isNotNull(), F.col("best.xbrl_period")).otherwise(F.col("period_label")).alias("xbrl_period"),
        tagged.alias("xbrl_value"),
        F.col("best.decimals").alias("decimals"),
    )
    tol = tolerance("decimals")
    return out.withColumns({"tolerance": tol, "status": F.when(F.col("xbrl_value").isNull(), "xbrl_missing").otherwise(status("value", "xbrl_value", tol))})


def with_cause(compared: DataFrame, negated: DataFrame) -> DataFrame:
    """Why a sign differs: the filing presents the concept negated."""
    hit = negated.select("stem", "prefix", "concept").distinct().withColumn("_negated", F.lit(True))
    return compared.join(hit, ["stem", "prefix", "concept"], "left").withColumn("cause", F.when((F.col("status") == "sign") & F.col("_negated"), NEGATED_CAUSE).otherwise("")).drop("_negated")


def missing_cells(entries: DataFrame, periods: DataFrame, index: DataFrame, bounds: DataFrame, seen: DataFrame) -> DataFrame:
    """Curated lines with a fact for a table's period but no cell: the first option not seen. entries: statement, entry_no, prefix, concept, dims, instant. periods: stem,
    statement, period_label. seen: stem, statement, concept, dims, xbrl_period, period_label."""
    options = (
        periods.join(bounds, "period_label", "left")
        .join(entries, "statement")
        .select("stem", "statement", "period_label", "entry_no", F.coalesce("prefix", F.lit("us-gaap")).alias("prefix"), "concept", F.coalesce("dims", F.lit("")).alias("dims"), F.posexplode(instant_options(period_options("period_label", "start", "end"), "instant")).alias("option_no", "xbrl_period"))
    )
    facts = index.select("stem", "prefix", "concept", "dims", F.col("period_label").alias("xbrl_period"), F.col("value").alias("xbrl_value"), "decimals")
    open_ = options.join(facts, ["stem", "prefix", "concept", "dims", "xbrl_period"]).join(seen, ["stem", "statement", "concept", "dims", "xbrl_period", "period_label"], "left_anti")
    first = open_.withColumn("turn", F.row_number().over(Window.partitionBy("stem", "statement", "period_label", "entry_no").orderBy("option_no"))).where("turn = 1").drop("turn", "option_no")
    once = Window.partitionBy("stem", "statement", "concept", "dims", "xbrl_period", "period_label").orderBy("entry_no")
    return first.withColumn("turn", F.row_number().over(once)).where("turn = 1").drop("turn").withColumn("status", F.lit("pdf_missing"))


def match_rates(compared: DataFrame, by: list[str]) -> DataFrame:
    """Cells, matches, sign differences and rates for each combination of `by` and all its margins ('ALL')."""
    g = compared.rollup(*by).agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "match").alias("matches"), F.count_if(F.col("status") == "sign").alias("signs"), F.grouping_id().alias("_g"))
    names = [F.when(F.col("_g").bitwiseAND(1 << (len(by) - 1 - i)) > 0, F.lit("ALL")).otherwise(F.col(x).cast("string")).alias(x) for i, x in enumerate(by)]
    return g.select(*names, "cells", "matches", "signs", (F.col("matches") / F.col("cells")).alias("match_rate"), ((F.col("matches") + F.col("signs")) / F.col("cells")).alias("agreement"))


def require(df: DataFrame, wanted: DataFrame, keys: list[str], what: str) -> None:
    """Raises if a wanted key is missing: dropping it would silently shrink the denominator."""
    gone = wanted.join(df.select(*keys).distinct(), keys, "left_anti").limit(20).collect()
    if gone:
        raise ValueError(f"missing {what}: " + ", ".join("/".join(map(str, r)) for r in gone))


def mapping_precision(reference: DataFrame, automatic: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and precision of an automatic mapping against a reference one, per cell."""
    auto = automatic.select(*keys, F.col("concept").alias("_auto"))
    rows = reference.join(auto, keys, "left").withColumn("_auto", F.coalesce("_auto", F.lit("")))
    mapped, right = F.col("_auto") != "", F.col("_auto") == F.col("concept")
    return rows.agg(
        F.count("*").alias("cells"), F.count_if(mapped).alias("mapped"), F.count_if(mapped & right).alias("right"), F.try_divide(F.count_if(mapped), F.count("*")).alias("coverage"), F.try_divide(F.count_if(mapped & right), F.count_if(mapped)).alias("precision"),
        F.array_join(F.array_sort(F.collect_set(F.when(mapped & ~right, F.col("label")))), "; ").alias("wrong"), F.array_join(F.array_sort(F.collect_set(F.when(~mapped, F.col("label")))), "; ").alias("unmapped"),
    )
