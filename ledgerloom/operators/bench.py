"""Timings, percentiles, projected cost, and cached calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# List prices and load of the cost model.
PAGES_PER_YEAR, WORKERS = 500_000, 4
USD_PER_HOUR = {"cpu": 0.357, "gpu": 0.752}
USD_PER_PAGE = {"ocr": 0.0015, "tables": 0.015}
OPTIONS = [("traditional", ["parse", "tables", "layout"], "cpu"), ("converter", ["converter"], "cpu"), ("converter-gpu", ["converter_gpu"], "gpu")]


def summary(rows: DataFrame, stage: str = "stage", seconds: str = "seconds", rss: str = "rss_mb", status: str = "status") -> DataFrame:
    """Pages, percentiles (interpolated), mean, total, peak memory, errors and empty pages of each stage."""
    good = F.col(status).isin("ok", "empty")
    s = F.when(good, F.col(seconds))
    return rows.groupBy(stage).agg(
        F.count_if(good).alias("pages"), F.percentile(s, F.lit(0.5)).alias("p50"), F.percentile(s, F.lit(0.95)).alias("p95"), F.avg(s).alias("mean"), F.sum(s).alias("total"), F.max(rss).alias("peak_rss_mb"), F.count_if(F.col(status).startswith("error")).alias("errors"), F.count_if(F.col(status) == "empty").alias("empty")
    )


def cost(means: DataFrame) -> DataFrame:
    """means: stage, mean, errors, pages -> cost of each option all of whose stages were measured without errors, and of the managed prices."""
    spark = means.sparkSession
    needs = spark.createDataFrame([(o, s, float(USD_PER_HOUR[m]), len(ss)) for o, ss, m in OPTIONS for s in ss], "option string, stage string, usd_per_hour double, needed int")
    ok = means.where((F.col("errors") == 0) & (F.col("pages") > 0))
    g = needs.join(ok, "stage").groupBy("option", "usd_per_hour", "needed").agg(F.count("*").alias("n"), F.sum("mean").alias("s_per_page")).where("n = needed")
    hours = F.col("s_per_page") * 1000 / 3600 / WORKERS
    own = g.select("option", "s_per_page", hours.alias("hours_per_1000"), (hours * F.col("usd_per_hour")).alias("usd_per_1000"), (hours * F.col("usd_per_hour") * PAGES_PER_YEAR / 1000).alias("usd_per_year"))
    managed = spark.createDataFrame([(f"managed {k}", None, None, v * 1000, v * PAGES_PER_YEAR) for k, v in USD_PER_PAGE.items()], "option string, s_per_page double, hours_per_1000 double, usd_per_1000 double, usd_per_year double")
    return own.unionByName(managed)


def cache_probe(requests: DataFrame, cache: DataFrame, key: str, enabled: bool) -> DataFrame:
    """Status of each request: cache, or api where the service is on, else miss. Nothing is called here: api rows go to a caller."""
    hit = cache.select(key).distinct().withColumn("_hit", F.lit(True))
    return requests.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), "cache").otherwise("api" if enabled else "miss")).drop("_hit")
