"""Text conventions that all operators of this subpackage share: words, lines, and hashes of both, for columns and for numpy."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def body(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text that is not null; no words: an empty array."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RE))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() does the same on pure ASCII and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


# ---------------------------------------------------------------- numpy

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT2 = np.uint64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(4)
def _powers(mult: int, n: int) -> np.ndarray:
    out = np.full(n, mult, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(mult: np.uint64, n: int) -> np.ndarray:
    """mult ** 0, 1, ... below n, modulo 2 ** 64; built for the next power of two and kept."""
    return _powers(int(mult), max(4096, 1 << (max(n, 1) - 1).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, at least one row each: bounds what numpy holds at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return freed memory to the machine: between tasks a worker stays alive beside those that run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A function over batches that gives back its memory at its end."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return lean_run


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and len(offsets) word offsets by document. Words end with their document."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = np.empty(n + 1, bool)
    solid[n] = False
    np.logical_not(IS_SPACE[raw], out=solid[:n])
    starts = solid[:n].copy()
    starts[1:] &= ~solid[: n - 1]
    cuts = offsets[:-1][offsets[:-1] < n]
    starts[cuts] = solid[cuts]
    ends = solid[:n] & ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


#: Random numbers by place in the word and byte, for two independent hashes; longer words are hashed by blake2b.
SHORT = 32
PLACE_BYTE = _rng.integers(0, 2**64, (2, SHORT * 256), dtype=np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of each word: the sum of a random number for each byte at each place (no power of a base, so words built of repeated
    patterns don't meet). salt 1 is a hash independent of salt 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    cut = np.minimum(lengths, SHORT)
    base = np.concatenate(([0], np.cumsum(cut)))
    within = np.arange(base[-1]) - np.repeat(base[:-1], cut)
    at = within + np.repeat(starts, cut)
    within <<= 8
    within += raw[at]
    out = mix(np.add.reduceat(PLACE_BYTE[salt][within], base[:-1]) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([salt])).digest(), "little")
    return out


def rolling(values: np.ndarray, k: int, mult: np.uint64 = MULT) -> np.ndarray:
    """Hash of each k consecutive values; len(values) - k + 1 of them."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = values[: n - k + 1].copy()
        for j in range(1, k):
            out *= mult
            out += values[j : n - k + 1 + j]
        return mix(out)
    inverse = np.uint64(pow(int(mult), -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(mult, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(inverse, n - k + 1))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of `buckets` equal ranges of 64 bits each hash lies in: ascending hashes have ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def same_document(offsets: np.ndarray, k: int) -> np.ndarray:
    """For each start of k consecutive items: do all lie in one document? offsets: item offsets by document."""
    n = int(offsets[-1])
    ok = np.zeros(max(n, 0) + 1, np.int8)
    lo, hi = offsets[:-1], np.maximum(offsets[1:] - k + 1, offsets[:-1])
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.cumsum(ok[:-1], dtype=np.int8)[: max(0, n - k + 1)] > 0
