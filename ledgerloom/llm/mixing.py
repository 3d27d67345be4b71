"""Operator 1, mixing sources to target weights by pivotal dependent rounding.

Each document starts with the copy number target / source size, of which the whole part is taken and the fraction is a
probability. Two documents of a source are paired and mass moves from one to the other, weighed by their sizes so that the expected
words don't change, until one fraction becomes 0 or 1; which way is drawn with the odds that keep both expectations. A leaf (some
thousand documents of one source, by hash) leaves one fractional document; leaves of a source meet in a tree of fan-in FAN_IN until one is
left, which is rounded by its own draw. That draw moves the words of the source by up to one document, maybe its longest; documents that the
last round made integral go back, longest first, as long as they bring the words nearer to the target (`settle`). What a draw upwards
takes from them and one downwards gives them is equal in expectation.

Only ids, sizes and fractions are moved, never texts. A source is split into leaves by its count, so a hot source is many groups.
Leaves, pairs and draws follow from hashes of the rows alone: reruns agree, whatever the partitioning.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 get the whole part and
an independent draw; a source without words has rate 1 (its documents cost nothing); an empty table gives an empty result; equal
rows are separate documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import body, n_words
from ledgerloom.session import cut, fresh

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
LEAF = 4096
FAN_IN = 64
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs) -> these with target. Sources are ranked with a range sort, so no task holds all of them.

    The budget fills all sources in proportion to their weight; those above `most` times their size stop there and the rest is
    shared anew until none is above. Each round is one aggregate."""
    spark = sizes.sparkSession
    ranked = cut(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()),
        "sources",
    )
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in ranked.groupBy(part.alias("p")).count().collect())  # one row a partition
    starts, seen = [], 0
    for p, n in counts:
        starts.append((p, seen))
        seen += n
    rank = within + (F.coalesce(*[F.when(part == p, F.lit(s)) for p, s in starts]) if starts else F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", "n_docs", weight.alias("weight")), "weights") if starts else ranked.select("source", "source_size", "n_docs", F.lit(1.0).alias("weight"))
    limit = F.col("source_size") * F.lit(float(most))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = float(total) * share, 0.0, -1
    while True:
        capped = limit <= F.col("weight") * level if full >= 0 else F.lit(False)
        n, used, free = table.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not free:
            break
        full, level = n, max(level, (budget - used) / free)
    return table.select("source", "source_size", "n_docs", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def _draw(key: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit keys."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(m)
    return (x >> np.uint64(11)) / float(1 << 53)


def pivot(size: np.ndarray, fraction: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in the order given. Returns them and the place of the one left fractional, or -1."""
    p, open_at = fraction.tolist(), -1
    sizes, draws = size.tolist(), draw.tolist()
    for i in range(len(p)):
        if p[i] < EPS or p[i] > 1 - EPS:
            p[i] = round(p[i])
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = p[open_at], p[i]
        sa, sb = sizes[open_at], sizes[i]
        up = min((1 - a) * sa, b * sb)  # words that can move from i to open_at
        down = min(a * sa, (1 - b) * sb)
        if draws[i] * (up + down) < down:
            a, b = a + up / sa, b - up / sb
        else:
            a, b = a - down / sa, b + down / sb
        p[open_at], p[i] = a, b
        if EPS <= b <= 1 - EPS:
            p[open_at], open_at = round(a), i
        else:
            p[i] = round(b)
            if a < EPS or a > 1 - EPS:
                p[open_at], open_at = round(a), -1
    return np.array(p), open_at


def settle(size: np.ndarray, fraction: np.ndarray, rounded: np.ndarray) -> np.ndarray:
    """Rounded fractions, some turned over, the longest first, until no single turn brings their words nearer to those of `fraction`."""
    out, sizes, turned = rounded.copy(), size.tolist(), True
    missing = float((size * (fraction - rounded)).sum())
    loose = np.flatnonzero((fraction > EPS) & (fraction < 1 - EPS))
    longest_first = loose[np.argsort(-size[loose], kind="stable")].tolist()
    while turned:
        turned = False
        for i in longest_first:
            step = sizes[i] if out[i] == 0 else -sizes[i]
            if abs(missing - step) < abs(missing) - EPS:
                out[i], missing, turned = 1 - out[i], missing - step, True
    return out


def _rounder(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "size", "fraction"], kind="stable").reset_index(drop=True)
        key = rows["key"].to_numpy() + rows.index.to_numpy() * (rows["key"].duplicated().to_numpy())
        size, fraction = rows["size"].to_numpy(np.float64), rows["fraction"].to_numpy(np.float64)
        out, left = pivot(size, fraction, _draw(key, level + 1))
        done = np.ones(len(rows), bool)
        if left >= 0:
            if last:
                out[left] = float(_draw(key[left : left + 1], level + 101)[0] < out[left])
                out = settle(size, fraction, out)
            else:
                done[left] = False
        return rows.assign(fraction=out, done=done)

    return run


def copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """id, row (hash of the text), source, size, source_size, target, copies of each row of docs."""
    size = n_words(body(text)) if size is None else size
    rows = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(body(text)).alias("row"), F.col(source).alias("source"), size.alias("size")), "sizes")
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most=most), "targets")
    most_docs = goals.agg(F.max("n_docs")).first()[0] or 0
    key = F.xxhash64("id", "row")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    # sort-merge or broadcast by size, as Spark sees it: sources are as many as the input has
    joined = rows.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    joined = joined.select("id", "row", "source", "size", "source_size", "target", key.alias("key"), F.floor(rate + F.lit(EPS)).alias("whole"), F.greatest(F.lit(0.0), rate - F.floor(rate + F.lit(EPS))).alias("fraction"), F.pmod(F.xxhash64(F.lit(7), key), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / LEAF))).alias("leaf"))
    by_chance = (F.col("size") == 0) | (F.col("fraction") < EPS)
    draw = F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) / float(1 << 30)
    easy = joined.where(by_chance).withColumn("fraction", F.when(draw < F.col("fraction"), 1.0).otherwise(0.0)).withColumn("done", F.lit(True))
    schema = joined.schema.add("done", "boolean", False)
    todo, parts = joined.where(~by_chance), [easy]
    levels = 1 + (math.ceil(math.log(max(1, math.ceil(most_docs / LEAF)), FAN_IN) - 1e-9) if most_docs > LEAF else 0)
    for level in range(levels):
        last = level == levels - 1
        done = todo.groupBy("source", "leaf").applyInPandas(_rounder(level, last), schema)
        if not last:
            done = cut(done, f"pivot-{level}")
        parts.append(done.where("done"))
        todo = done.where("not done").drop("done").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("id", "row", "source", "size", "source_size", "target", (F.col("whole") + F.col("fraction")).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows with equal id and text share their copies out one by one."""
    got = copies(docs, id_col, text, source, weights=weights).groupBy("id", "row", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    mid, mrow, msrc, n, times = fresh(docs, "_id", "_row", "_source", "_copies", "_times")
    got = got.select(F.col("id").alias(mid), F.col("row").alias(mrow), F.col("source").alias(msrc), F.col("copies").alias(n), F.col("rows").alias(times))
    df = docs.join(got, docs[id_col].eqNullSafe(got[mid]) & (F.xxhash64(body(docs[text])) == got[mrow]) & docs[source].eqNullSafe(got[msrc]))
    # equal rows: all get the mean, rounded so that the sum is kept by a draw-free split over the rows of one key
    share = F.when(F.col(times) == 1, F.col(n)).otherwise(F.floor(F.col(n) / F.col(times)))
    plain = df.withColumn(n, share).withColumn(mid, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
    rest = df.where(F.col(times) > 1).dropDuplicates([mid, mrow, msrc]).withColumn(n, F.col(n) % F.col(times)).withColumn(mid, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))))
    return plain.unionByName(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))
