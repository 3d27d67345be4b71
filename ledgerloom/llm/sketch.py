"""Count-min sketch of 64-bit items, built per task and merged in Spark, cut down to what a prefilter asks: is the count 2 or more?

Cells saturate at 2, so a task sends its cells as two packed lists (met once, met more often) by block of cells, and a merged block is a
bitmap. Merging never lowers a cell, so an item's estimate, the least of its DEPTH cells, is never below its true count. The bitmaps hold
8 cells per expected item, 2 ** MAX_BITS at most: DEPTH * 2 ** MAX_BITS / 8 bytes (128 MB) bound what is broadcast. Beyond that the
filter lets more through; what passes is counted exactly afterwards, so results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import lean, mix

DEPTH = 2
MIN_BITS, MAX_BITS = 20, 29
BLOCK_BITS = 20
FLUSH = 1_000_000


def bits_for(items: float) -> int:
    return min(MAX_BITS, max(MIN_BITS, int(8 * max(items, 1)).bit_length()))


def cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5 * (row + 1) % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)


def build(texts: DataFrame, items: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> list[np.ndarray]:
    """Bitmaps, one per row of the sketch, of the cells that reach 2. items: batches of texts -> arrays of items."""
    blocks = 1 << (bits - BLOCK_BITS)

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        all_items = np.concatenate(held)
        for row in range(DEPTH):
            cell, count = np.unique(cells(all_items, row, bits), return_counts=True)
            edges = np.arange(1, blocks) << BLOCK_BITS
            once, more = cell[count == 1], cell[count > 1]
            parts = [
                (row, i, (a & ((1 << BLOCK_BITS) - 1)).astype(np.uint32).tobytes(), (b & ((1 << BLOCK_BITS) - 1)).astype(np.uint32).tobytes())
                for i, (a, b) in enumerate(zip(np.split(once, np.searchsorted(once, edges)), np.split(more, np.searchsorted(more, edges)), strict=True))
                if len(a) or len(b)
            ]
            cols = list(zip(*parts, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["row", "block", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for got in items(batches):
            held.append(got)
            n += len(got)
            if n >= FLUSH:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    def merge(rows: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
        for a, b in zip(rows.column("once"), rows.column("more"), strict=True):
            cell = np.frombuffer(a.as_py(), np.uint32)
            twice[cell] |= once[cell]
            once[cell] = True
            twice[np.frombuffer(b.as_py(), np.uint32)] = True
        return pa.table({"row": rows.column("row")[:1], "block": rows.column("block")[:1], "bitmap": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    merged = texts.mapInArrow(lean(run), "row int, block int, once binary, more binary").groupBy("row", "block").applyInArrow(merge, "row int, block int, bitmap binary")
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(DEPTH)]
    size = 1 << (BLOCK_BITS - 3)
    for row, block, bitmap in zip(*(c.to_pylist() for c in merged.toArrow().columns), strict=True):
        out[row][block * size : (block + 1) * size] = np.frombuffer(bitmap, np.uint8)
    return out


def repeated(bitmaps: list[np.ndarray], items: np.ndarray) -> np.ndarray:
    """Which items may occur more than once; never False for one that does."""
    bits = (len(bitmaps[0]) * 8).bit_length() - 1
    out = np.ones(len(items), bool)
    for row, bitmap in enumerate(bitmaps):
        cell = cells(items, row, bits)
        out &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
    return out


def of_keys(keys: DataFrame, n: int) -> list[np.ndarray]:
    """Bitmaps of a column of about n distinct long keys."""

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield np.repeat(np.unique(batch.column(0).to_numpy()).view(np.uint64), 2)

    return build(keys, twice, bits_for(n))


def among(keys: DataFrame, key: str | Column) -> Column:
    """May the key be among the keys (one long column)? Never False for one that is. Rows that it rules out need no join with the keys' table,
    so are not moved; what it lets through besides, the join takes out."""
    spark = keys.sparkSession
    maps = spark.sparkContext.broadcast(of_keys(keys, keys.count()))

    @F.pandas_udf("boolean")
    def may(column: pd.Series) -> pd.Series:
        return pd.Series(repeated(maps.value, column.to_numpy().view(np.uint64)))

    return may(key)


_LOW = np.uint64((1 << 22) - 1)


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each `window` consecutive hashes the place of the least (leftmost of equals), as content alone decides."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, step = np.empty(n, np.int64), 1 << 20
    for lo in range(0, n, step):
        m = min(step, n - lo)
        key = (hashes[lo : lo + m + window - 1] & ~_LOW) | np.arange(m + window - 1, dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        out[lo : lo + m] = (np.minimum(key[:m], key[window - span : window - span + m]) & _LOW).astype(np.int64) + lo
    return out
