"""Read-only lookups, sweeps and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def locate(labels: DataFrame, values: DataFrame, page: list[str], key: str, most: float = 6.0, band: float = 20.0) -> DataFrame:
    """The value nearest in height to each label of its page, at most `most` points away. Both sides meet by page and bands of height, never all with all."""
    near = labels.withColumn("_band", F.explode(F.sequence(F.floor((F.col("top") - most) / band), F.floor((F.col("top") + most) / band))))
    other = values.select(*page, F.col("id").alias("value_id"), F.col("top").alias("value_top"), F.floor(F.col("top") / band).alias("_band"))
    pairs = near.join(other, [*page, "_band"]).withColumn("gap", F.abs(F.col("top") - F.col("value_top"))).where(F.col("gap") <= most)
    best = pairs.groupBy(*page, key).agg(F.min(F.struct("gap", "value_id")).alias("b"))
    return best.select(*page, key, "b.value_id", "b.gap")


def sweep(df: DataFrame, thresholds: list[float], name: str, keep: Column, by: list[str] | None = None) -> DataFrame:
    """How many rows pass at each of a short list of thresholds (column `name` in `keep`)."""
    rows = df.withColumn(name, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return rows.groupBy(name, *(by or [])).agg(F.count_if(keep).alias("passed"), F.count("*").alias("n"))


def cell_correctness(cells: DataFrame, found: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per method: cells whose label is found, whose value is right, and whose value stands anywhere in the method's output."""
    methods = [m[0] for m in found.select("method").distinct().orderBy("method").collect()]  # a handful by nature
    own = found.select("method", *keys, F.col(value).alias("_got"), F.lit(True).alias("_label"))
    anywhere = found.select("method", F.col(value)).distinct().withColumn("_any", F.lit(True))
    rows = cells.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    rows = rows.join(own, ["method", *keys], "left").join(anywhere, ["method", value], "left")
    return rows.groupBy("method").agg(F.count("*").alias("cells"), F.count_if(F.coalesce(F.col("_got") == F.col(value), F.lit(False))).alias("correct"), F.count_if("_label").alias("label_found"), F.count_if("_any").alias("value_anywhere"))


def preferred(paths: DataFrame, key: list[str], order: list[str], path: str = "path") -> DataFrame:
    """Row of the first path in `order` that has the key."""
    rank = F.coalesce(*[F.when(F.col(path) == p, F.lit(i)) for i, p in enumerate(order)], F.lit(len(order)))
    w = Window.partitionBy(*key).orderBy(rank, path)
    return paths.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def shares(records: DataFrame, by: list[str], flag: Column, length: Column) -> DataFrame:
    """Share of flagged documents, mean length and count of their blocks."""
    return records.groupBy(*by).agg(F.avg(flag.cast("int")).alias("share"), F.avg(length).alias("mean_length"), F.count("*").alias("n"))


def table_shape(grids: DataFrame, grid: str = "rows") -> DataFrame:
    """Rows, widest row, empty cells and whether all cells are empty, of each grid."""
    cells = F.flatten(grid)
    empty = F.size(F.filter(cells, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""))
    return grids.withColumns({"n_rows": F.size(grid), "width": F.array_max(F.transform(grid, F.size)), "empty_cells": empty, "all_empty": empty == F.size(cells)})
