"""Operator 5, substring dedup: words covered by a window of 35 words that occurs more than once.

1. Each window is represented by the least of its runs of GRAM words, which equal windows share at the same place. Tasks sketch the distinct
   places of those runs; merged, the count-min sketch overestimates how often each run, hence each window, occurs.
2. Only windows estimated repeated are hashed (128 bits, from two independent hashes of each word) and grouped exactly, by ranges of the hash. A task first groups its own, and sends one
   record for a window it met several times, so the records of a window number the tasks at most.
3. Places found go back packed by part of the documents, and meet the texts there, which are moved once.

Defined cases: null and empty texts have no words; texts shorter than the window lose nothing; equal rows repeat each other; rows of one
doc_id are separate texts; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import sketch
from ledgerloom.llm.text import MULT, MULT2, body, bucket_of, pieces, rolling, same_document, utf8, word_hashes, word_spans

WINDOW = 35
#: About half a window: shorter runs repeat by chance.
GRAM = 18
BUCKET_BYTES = 8_000_000
#: Text of the documents that are finished together.
PART_BYTES = 12_000_000
FLUSH = 500_000


def anchors(batch: pa.Array, window: int = WINDOW) -> tuple[Callable[[int], np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (by salt), word offsets, run hashes, start of each whole window, and the place of its least run."""
    raw, offsets = utf8(batch)
    starts, ends, at = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    gram = min(GRAM, window)
    runs = rolling(hashes, gram)
    place = sketch.minimizers(runs, window - gram + 1)
    ok = np.flatnonzero(same_document(at, window))
    return lambda salt: word_hashes(raw, starts, ends, salt) if salt else hashes, at, runs, ok, place[ok]


def with_key(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, text, and key and row: two hashes that together name the row (equal rows share them, and their result)."""
    row = F.xxhash64(body(text))
    return docs.select(F.col(id_col).alias("id"), body(text).alias("text"), F.xxhash64(F.lit(3), F.col(id_col), row).alias("key"), row.alias("row"))


def pack(kind: str, **cols: list) -> pa.RecordBatch:
    kinds = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in zip(kind, cols.values(), strict=True)], names=list(cols))


SENT = "bucket int, h1 binary, h2 binary, doc binary, pos binary, keys binary, rows binary, key binary, row binary, size binary, places binary"
NAMES = [x.split()[0] for x in SENT.split(", ")]
FIELDS = ["key", "row", "size", "places"]
FOUND = "g int, key binary, row binary, size binary, places binary"


def packed(owner: np.ndarray, pos: np.ndarray, keys: np.ndarray, rows: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Places by document, packed into one record per part of the documents (by key): part, keys, rows, numbers of places, places."""
    part = np.mod(keys[owner], parts)
    order = np.lexsort((pos, owner, part))
    owner, pos, part = owner[order], pos[order].astype(np.uint32), part[order]
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(owner))).astype(np.int32)
    docs, doc_part = owner[at], part[at]
    for p in np.unique(doc_part).tolist():
        lo, hi = np.searchsorted(doc_part, [p, p + 1])
        begin, end = at[lo], at[hi] if hi < len(at) else len(owner)
        yield p, keys[docs[lo:hi]].tobytes(), rows[docs[lo:hi]].tobytes(), size[lo:hi].tobytes(), pos[begin:end].tobytes()


def repeated_places(rows: DataFrame, window: int, parts: int) -> DataFrame:
    """Starts of windows that occur more than once, packed by part of the documents."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(total / 6 * 2 / (window - min(GRAM, window) + 2))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in pieces(batches, "text"):
            _, _, runs, _, place = anchors(batch.column(0), window)
            yield runs[np.unique(place)]

    maps = spark.sparkContext.broadcast(sketch.build(rows.select("text"), items, bits))
    buckets = int(total // BUCKET_BYTES) + 1

    def emit(held: list[tuple[np.ndarray, ...]], keys: list[np.ndarray]) -> pa.RecordBatch:
        anchor, h1, h2, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        names = np.concatenate(keys)
        order = np.lexsort((h2, h1, anchor))
        anchor, h1, h2, doc, pos = anchor[order], h1[order], h2[order], doc[order], pos[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        many = ~(new & np.append(new[1:], True))
        out = [(p % buckets, *[None] * 6, *rest) for p, *rest in packed(doc[many], pos[many], names[:, 0], names[:, 1], parts)]
        first, known = np.flatnonzero(new), many[new]
        doc = np.where(known, -1, doc[first])
        # equal windows have equal least runs, so the buckets may be ranges of those
        to = bucket_of(anchor[first], buckets)
        for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(to)) + 1):
            if len(part):
                i = int(to[part[0]])
                own, local = np.unique(doc[part], return_inverse=True)
                lead = int(len(own) and own[0] == -1)
                at = first[part]
                out.append((i, h1[at].tobytes(), h2[at].tobytes(), (local - lead).astype(np.int32).tobytes(), pos[at].astype(np.uint32).tobytes(), names[own[lead:], 0].tobytes(), names[own[lead:], 1].tobytes(), *[None] * 4))
        return pack("i" + "b" * 10, **dict(zip(NAMES, zip(*out, strict=True), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, n, docs = [], [], 0, 0
        for batch in pieces(batches, "text"):
            hashes, at, runs, starts, place = anchors(batch.column(0), window)
            if len(starts):
                # a run is looked up once, however many windows it stands for
                near = np.ones(len(place), bool)
                near[1:] = place[1:] != place[:-1]
                hit = sketch.repeated(maps.value, runs[place[near]])
                hit = hit[np.cumsum(near) - 1]
                starts, place = starts[hit], place[hit]
            if len(starts):
                doc = np.searchsorted(at, starts, "right") - 1
                held.append((runs[place], rolling(hashes(0), window, MULT)[starts], rolling(hashes(1), window, MULT2)[starts], doc + docs, starts - at[doc]))
                keys.append(np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1))
                docs += batch.num_rows
                n += len(starts)
            if n >= FLUSH:
                yield emit(held, keys)
                held, keys, n, docs = [], [], 0, 0
        if n:
            yield emit(held, keys)

    def meet(table: pa.Table) -> pa.Table:
        sent = table.filter(table.column("h1").is_valid())
        through = table.filter(table.column("h1").is_null())
        out = list(zip(*(through.column(c).to_pylist() for c in FIELDS), strict=True))
        out = [(int(np.mod(np.frombuffer(k, np.int64)[0], parts)), k, r, n, p) for k, r, n, p in out]
        if sent.num_rows:
            cols = {c: [np.frombuffer(x.as_py(), k) for x in sent.column(c)] for c, k in (("h1", np.uint64), ("h2", np.uint64), ("doc", np.int32), ("pos", np.uint32), ("keys", np.int64), ("rows", np.int64))}
            base = np.cumsum([0, *(len(k) for k in cols["keys"])])
            doc = np.concatenate([np.where(d < 0, -1, d.astype(np.int64) + b) for d, b in zip(cols["doc"], base[:-1].tolist(), strict=True)])
            h1, h2, pos = (np.concatenate(cols[c]) for c in ("h1", "h2", "pos"))
            order = np.lexsort((h2, h1))
            h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            group = np.cumsum(new) - 1
            many = np.bincount(group, np.where(doc < 0, 2, 1)) >= 2
            hit = many[group] & (doc >= 0)
            out += packed(doc[hit], pos[hit], np.concatenate(cols["keys"]), np.concatenate(cols["rows"]), parts)
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("g", *FIELDS), cols, [pa.int32()] + [pa.binary()] * 4, strict=True)})

    return rows.select("text", "key", "row").mapInArrow(run, SENT).groupBy("bucket").applyInArrow(meet, FOUND)


def covered(length: int, places: list[bytes], window: int) -> np.ndarray:
    """Which of `length` items a window at one of the places covers."""
    marks = np.zeros(length + 1, np.int32)
    for p in places:
        at = np.unique(np.frombuffer(p, np.uint32))
        marks[at] += 1
        marks[at + window] -= 1
    return np.cumsum(marks[:-1]) > 0


def places_of(found: pa.Table) -> dict[tuple[int, int], list[bytes]]:
    """(key, row) -> packed places, from the records of a part."""
    out: dict[tuple[int, int], list[bytes]] = {}
    for k, r, n, p in zip(*(found.column(c).to_pylist() for c in FIELDS), strict=True):
        ends = np.cumsum(np.frombuffer(n, np.int32)) * 4
        for a, b, lo, hi in zip(np.frombuffer(k, np.int64).tolist(), np.frombuffer(r, np.int64).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out.setdefault((a, b), []).append(p[lo:hi])
    return out


def kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept (words that stay, with single spaces) of each row of docs."""
    rows = with_key(docs, id_col, text)
    parts = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES) + 1
    found = repeated_places(rows, window, parts)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        places = places_of(found)
        n_words, n_removed, texts = [], [], []
        for value, key, row in zip(rows.column("text"), rows.column("key").to_pylist(), rows.column("row").to_pylist(), strict=True):
            words = value.as_py().encode().split()  # splits at the same six characters
            n_words.append(len(words))
            own = places.get((key, row))
            if own:
                gone = covered(len(words), own, window)
                n_removed.append(int(gone.sum()))
                words = compress(words, (~gone).tolist())
            else:
                n_removed.append(0)
            texts.append(b" ".join(words))
        return pa.table({"id": rows.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(texts, pa.binary()).cast(pa.string())})

    parted = rows.withColumn("g", F.pmod("key", F.lit(parts)).cast("int"))
    out = parted.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
