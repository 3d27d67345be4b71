"""Tagged facts: exact-copy dedup, lookup keys, period bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["stem", "prefix", "concept", "period_type", "start", "end", "unit", "dims"]


def precision(decimals: str | Column) -> Column:
    """INF is exact, more decimals are finer, anything else is least."""
    d = F.col(decimals) if isinstance(decimals, str) else decimals
    return F.when(d == "INF", F.lit(float("inf"))).otherwise(F.coalesce(d.try_cast("int").cast("double"), F.lit(float("-inf"))))


def most_precise(facts: DataFrame, key: list[str], decimals: str = "decimals", order: str = "ord", value: str = "value") -> DataFrame:
    """The most precise copy of each key (first in order on ties), with the copies and the distinct values of its key. One shuffle, with map-side combine."""
    rows = facts.select(*key, F.struct(*[x for x in facts.columns if x not in key]).alias("_rest"), F.struct(precision(decimals).alias("p"), (-F.col(order)).alias("o")).alias("_rank"), F.col(value).alias("_value"))
    best = rows.groupBy(*key).agg(F.max_by("_rest", "_rank").alias("_rest"), F.count("*").alias("n_copies"), F.count_distinct("_value").alias("n_values"))
    return best.select(*key, "_rest.*", "n_copies", "n_values")


def conflicts(facts: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """One row: keys with more than one value."""
    return facts.groupBy(*key).agg(F.count_distinct(value).alias("n")).agg(F.count_if(F.col("n") > 1).alias("conflicts"))


def face(facts: DataFrame) -> DataFrame:
    """Facts without dimensions."""
    return facts.where(F.col("n_dims") == 0)


def numeric_facts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("concept").isNotNull() & F.col("is_numeric") & ~F.col("is_nil") & F.col("value").isNotNull())


def fact_index(facts: DataFrame, order: str = "ord") -> DataFrame:
    """(stem, prefix, concept, dims, period_label) -> value, decimals. Of several, the last in order."""
    dims = F.when(F.col("n_dims") == 0, F.lit("")).otherwise(F.col("dims"))
    rows = facts.withColumn("dims", dims)
    best = rows.groupBy("stem", "prefix", "concept", "dims", "period_label").agg(F.max_by(F.struct("value", "decimals"), order).alias("f"))
    return best.select("stem", "prefix", "concept", "dims", "period_label", "f.value", "f.decimals")


def period_bounds(facts: DataFrame, order: str = "ord") -> DataFrame:
    """period_label -> start, end of its first duration."""
    return facts.where(F.col("period_type") == "duration").groupBy("period_label").agg(F.min_by(F.struct("start", "end"), order).alias("b")).select("period_label", "b.start", "b.end")


def canonical_dims(dims: str) -> Column:
    """Map of axis to member -> 'axis=member;...' in order."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(dims), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def latest(df: DataFrame, by: list[str], when: str) -> DataFrame:
    """Newest row of each key; ties go to the greatest row."""
    rest = [x for x in df.columns if x not in by]
    return df.groupBy(*by).agg(F.max(F.struct(when, *[x for x in rest if x != when])).alias("r")).select(*by, "r.*")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
