"""Operator 9, suffix-array dedup: bytes covered by a string of 400 bytes that occurs more than once are removed; those covered by a
repeated string of REPORT bytes, shorter passages that are too short to remove, are counted besides (n_repeated).

1. Each string of REPORT bytes is represented by the least of its runs of GRAM bytes; a count-min sketch (see sketch.py) of the distinct places of those
   runs overestimates how often each occurs. Neighbouring strings that may be repeated make a segment of their text.
2. Equal segments are one: if there are several, all of it is repeated. A run that stands at one place of one segment only represents no repeated
   string. The others lead back to the least segment that holds them, and a segment is cut into pieces, strings whose runs lead to one
   segment: equal strings have one run, so their pieces meet in one group. (Chains of shared runs tie a share of the corpus together that grows
   with it; a group holds no chains.) Groups are dealt to shards; one above 2 * SHARD_BYTES is cut into tiles, and each two of them are a shard
   with one array. A shard is searched in parts of whole groups.
3. A shard's suffix array is refined by prefix doubling of the groups not yet sorted (Larsson and Sadakane), in numpy; common prefixes follow by Kasai's
   algorithm, run in lanes. Strings with a common prefix of 400 (or REPORT) bytes are repeated. Two tiles of a component are merged by binary
   search of one's suffixes in the other's array.
4. Runs of repeated places, each found in the one piece that its string starts in, go back to all texts that hold the segment, and are joined with those texts; the others aren't moved.

Defined cases: null and empty texts have no bytes; texts under 400 bytes lose nothing; equal rows repeat each other; rows of one doc_id are
separate texts; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import sketch
from ledgerloom.llm.substrings import with_key
from ledgerloom.llm.text import BYTE, give_back, lean, pieces, rolling, same_document, utf8
from ledgerloom.session import cut

WINDOW = 400
#: Some 50 words in a language of short ones.
REPORT = 256
#: Half of that: shorter runs (a licence line) would tie together texts that share no whole string.
GRAM = 128
SHARD_BYTES = 1_500_000
#: Groups of about so many bytes share an array: a bound on memory where none is larger.
PART_BYTES = 1_000_000
#: Bytes of pieces that leave a task at once.
SENT_BYTES = 2_000_000


def byte_anchors(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, run hashes, start of each whole window, and the place of its least run."""
    raw, offsets = utf8(column)
    gram = min(GRAM, window)
    runs = rolling(BYTE[raw], gram) if len(raw) else np.zeros(0, np.uint64)
    place = sketch.minimizers(runs, window - gram + 1)
    starts = np.flatnonzero(same_document(offsets, window))
    return raw, offsets, runs, starts, place[starts]


# ---------------------------------------------------------------- suffix arrays


def words8(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number; zeros follow the text."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | wide[j : n + j]
    return out


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of the text in the order of their suffixes, or of their next `depth` bytes at least; equals then stay in the order of places."""
    n = len(text)
    key = words8(text)
    small = np.int32 if n < 2**31 - 1 else np.int64
    order = np.argsort(key, kind="stable").astype(small)
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    del key, sorted_key
    first = np.flatnonzero(head).astype(small)
    rank = np.empty(n + 1, small)
    rank[order] = first[np.cumsum(head, dtype=small) - 1] + 1  # a group's number is its first place; 0 is the end of the text
    rank[n] = 0
    h = 8
    while depth is None or h < depth:
        single = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        at = order[open_]
        pair = rank[at].astype(np.uint64) << np.uint64(32)
        pair |= rank[np.minimum(at + h, n)].astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[open_] = new
        place = open_[new].astype(small)
        rank[at] = place[np.cumsum(new, dtype=small) - 1] + 1
        h *= 2
    return order


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit differences."""
    # without neighbouring ones a number isn't rounded up to the next power of two, so the exponent is its length in bits
    return (64 - np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1]) >> 3


def kasai(text: np.ndarray, order: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Common prefix, up to `most`, of each suffix in order with the one before it. Lanes of neighbouring places advance together. A place starts
    from its predecessor's prefix less one, as in Kasai's algorithm, where both are compared with neighbours; in an order that is cut at some
    depth the one before may be another, and the place starts anew."""
    n = len(text)
    wide = words8(np.concatenate([text, np.zeros(most + 16, np.uint8)]))
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int32)
    starts = np.arange(0, n, lane)
    h, last = np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
    for t in range(lane):
        p = starts + t
        p = p[p < n]
        q = before[p]
        h = np.where(q == last[: len(p)] + 1, np.maximum(h[: len(p)] - 1, 0), 0)
        last = q
        limit = np.minimum(most, n - np.maximum(p, q))
        h = np.where(q < 0, 0, np.minimum(h, limit))
        live = np.flatnonzero((q >= 0) & (h < limit))
        while len(live):
            step = _equal_bytes(wide[p[live] + h[live]] ^ wide[q[live] + h[live]])
            h[live] = np.minimum(h[live] + step, limit[live])
            live = live[(step == 8) & (h[live] < limit[live])]
        prefix[p] = h
    return prefix[order]


def repeated_in(text: np.ndarray, valid: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each length of strings, which of its valid places start one that another valid place starts too; and the suffix array of the text."""
    order = suffix_array(text, max(valid))
    common = kasai(text, order, max(valid))
    out = {}
    for window, ok in valid.items():
        group = np.cumsum(common < window, dtype=np.int32)
        counts = np.bincount(group[ok[order]], minlength=int(group[-1]) + 1 if len(group) else 0)
        out[window] = np.zeros(len(text), bool)
        out[window][order] = ok[order] & (counts[group] >= 2)
    return out, order


def merge(a: np.ndarray, a_order: np.ndarray, a_places: np.ndarray, b: np.ndarray, b_places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a and of b whose strings occur in the other: binary search of b's strings in a's suffix array."""
    own = a_order[a_places[a_order]]
    if not len(own) or not len(b_places):
        return own[:0], b_places[:0]
    wa, wb = words8(np.concatenate([a, np.zeros(16, np.uint8)])), words8(np.concatenate([b, np.zeros(16, np.uint8)]))

    def below(i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        """Is the string at a's place i less than (or equal to) that at b's place j?"""
        out, live = np.full(len(i), or_equal), np.arange(len(i))
        for k in range(0, window, 8):
            x, y = wa[i[live] + k], wb[j[live] + k]
            if k + 8 > window:
                drop = np.uint64(8 * (k + 8 - window))
                x, y = x >> drop, y >> drop
            differ = x != y
            out[live[differ]] = x[differ] < y[differ]
            live = live[~differ]
            if not len(live):
                break
        return out

    def bound(or_equal: bool) -> np.ndarray:
        lo, hi = np.zeros(len(b_places), np.int64), np.full(len(b_places), len(own))
        while (lo < hi).any():
            live = np.flatnonzero(lo < hi)
            mid = (lo[live] + hi[live]) // 2
            less = below(own[mid], b_places[live], or_equal)
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
        return lo

    left, right = bound(False), bound(True)
    hit = right > left
    marks = np.zeros(len(own) + 1, np.int64)
    np.add.at(marks, left[hit], 1)
    np.add.at(marks, right[hit], -1)
    return own[np.cumsum(marks[:-1]) > 0], b_places[hit]


# ---------------------------------------------------------------- segments


def segments(rows: DataFrame, window: int) -> DataFrame:
    """seg (two hashes), key, row, start, data, runs (packed hashes of the strings' least runs, in their order) and at (packed, the first
    string of each) of each segment."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(total * 2 / (window - min(GRAM, window) + 2))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in pieces(batches, "text"):
            _, _, runs, _, place = byte_anchors(batch.column(0), window)
            yield runs[np.unique(place)]

    maps = spark.sparkContext.broadcast(sketch.build(rows.select("text"), items, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, offsets, runs, starts, place = byte_anchors(batch.column(0), window)
            if len(starts):
                near = np.ones(len(place), bool)
                near[1:] = place[1:] != place[:-1]
                hit = sketch.repeated(maps.value, runs[place[near]])[np.cumsum(near) - 1]
                starts, place = starts[hit], place[hit]
            if not len(starts):
                continue
            doc = np.searchsorted(offsets, starts, "right") - 1
            cuts = np.flatnonzero((np.diff(starts) > 1) | (np.diff(doc) > 0)) + 1
            out: dict[str, list] = {k: [] for k in ("s1", "s2", "key", "row", "start", "data", "runs", "at")}
            keys, names = batch.column(1), batch.column(2)
            for s, p, d in zip(np.split(starts, cuts), np.split(place, cuts), doc[np.concatenate(([0], cuts))].tolist(), strict=True):
                data = raw[s[0] : s[-1] + window].tobytes()
                digest = np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64)
                new = np.flatnonzero(np.diff(p, prepend=-1))
                for k, v in zip(out, (int(digest[0]), int(digest[1]), keys[d].as_py(), names[d].as_py(), int(s[0] - offsets[d]), data, runs[p[new]].tobytes(), new.astype(np.uint32).tobytes()), strict=True):
                    out[k].append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.select("text", "key", "row").mapInArrow(lean(run), "s1 long, s2 long, key long, row long, start long, data binary, runs binary, at binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seg, run, several (places of that segment?)"""
    for batch in batches:
        values = [np.unique(np.frombuffer(x.as_py(), np.int64), return_counts=True) for x in batch.column(1)]
        if values:
            seg = np.repeat(batch.column(0).to_numpy(), [len(v) for v, _ in values])
            run, times = (np.concatenate(x) for x in zip(*values, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(run), pa.array(times > 1)], names=["seg", "run", "several"])


def _cut_up(window: int, most: int):
    """Segments with the groups of their runs -> pieces: the group (root), at which place of the segment it begins, how many strings start in it,
    and its bytes, up to the end of the longest string (`most`)."""

    names = ("s1", "s2", "alone", "root", "first", "starts", "data", "length")
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())

    def cut_up(row: dict) -> Iterator[tuple]:
        data, runs, at = row["data"].as_py(), np.frombuffer(row["runs"].as_py(), np.int64), np.frombuffer(row["at"].as_py(), np.uint32).astype(np.int64)
        heads, roots = row["heads"].values.to_numpy(), row["roots"].values.to_numpy()
        order = np.argsort(heads)
        near = order[np.minimum(np.searchsorted(heads, runs, sorter=order), len(heads) - 1)]
        known, root = heads[near] == runs, roots[near]
        new = np.ones(len(runs), bool)
        new[1:] = (root[1:] != root[:-1]) | (known[1:] != known[:-1])
        begin = np.flatnonzero(new)
        ends = np.append(at[begin[1:]], len(data) - window + 1)
        for g, lo, hi in zip(root[begin][known[begin]].tolist(), at[begin][known[begin]].tolist(), ends[known[begin]].tolist(), strict=True):
            part = data[lo : hi - 1 + most]
            yield g, lo, hi - lo, part, len(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out, size = [], 0
        for batch in batches:
            for row in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*batch.columns, strict=True)):
                name = tuple(row[n].as_py() for n in names[:3])
                for part in cut_up(row):
                    out.append(name + part)
                    size += part[-1]
                if size >= SENT_BYTES:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    return lean(run)


def runs_of(places: np.ndarray) -> np.ndarray:
    """Ascending places as (first, number) of each run."""
    begin = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return np.stack([places[begin], np.diff(np.append(begin, len(places)))], 1).astype(np.uint32)


def search(windows: tuple[int, ...]):
    def run(rows: pa.Table) -> pa.Table:
        """Runs of repeated places of the pieces of a shard, for each length of strings. Where its rows are of several tiles, each tile has its
        own array."""
        # rows that are equal hold equal segments at one place: they count once
        name = np.stack([rows.column(c).to_numpy() for c in ("tile", "s1", "s2", "first")], 1)
        rows = rows.take(pa.array(np.sort(np.unique(name, axis=0, return_index=True)[1])))
        roots, at = np.unique(rows.column("root").to_numpy(), return_inverse=True)
        size = np.bincount(at, [len(x.as_buffer()) for x in rows.column("data")], len(roots))
        part = ((np.cumsum(size) - size) // PART_BYTES)[at]
        found = []
        for k in np.unique(part):
            found.append(searched(rows.take(pa.array(np.flatnonzero(part == k)))))
            give_back()
        return pa.concat_tables(found)

    def searched(rows: pa.Table) -> pa.Table:
        tiles, firsts = rows.column("tile").to_numpy(), rows.column("first").to_pylist()
        out: list[list[bytes]] = [[b""] * rows.num_rows for _ in windows]
        done = []
        for tile in np.unique(tiles).tolist():
            own = np.flatnonzero(tiles == tile)
            data = [np.frombuffer(rows.column("data")[i].as_py(), np.uint8) for i in own.tolist()]
            ends = np.cumsum(np.array([len(d) for d in data]))
            text = np.concatenate(data)
            sizes = np.diff(ends, prepend=0)
            where = np.repeat(ends.astype(np.int32), sizes) - np.arange(len(text), dtype=np.int32)  # bytes from each place to the end of its piece
            starts = where > np.repeat((sizes - rows.column("starts").to_numpy()[own]).astype(np.int32), sizes)  # what follows starts in another piece
            valid = {w: starts & (where >= w) for w in windows}
            del data, where, starts
            hit, order = repeated_in(text, valid)
            for other in done:
                for w in windows:
                    a, b = merge(other[0], other[1], other[2][w], text, np.flatnonzero(valid[w]), w)
                    other[3][w][a] = True
                    hit[w][b] = True
            done.append((text, order.astype(np.int32), valid, hit, own, ends))
        for _, _, _, hit, own, ends in done:
            for k, w in enumerate(windows):
                places = np.flatnonzero(hit[w])
                for i, part in zip(own.tolist(), np.split(places, np.searchsorted(places, ends[:-1])), strict=True):
                    if len(part):
                        out[k][i] = runs_of(part).tobytes()
            for i, begin in zip(own.tolist(), [0, *ends[:-1].tolist()], strict=True):
                for k in range(len(windows)):
                    if out[k][i]:
                        moved = np.frombuffer(out[k][i], np.uint32).reshape(-1, 2) + np.array([firsts[i] - begin, 0])
                        out[k][i] = moved.astype(np.uint32).tobytes()
        # of several equal segments all is repeated, without a search
        alone = rows.column("alone").to_pylist()
        took = [i for i in range(rows.num_rows) if alone[i] and any(x[i] for x in out)]
        at = pa.array(took, pa.int64())
        return pa.table({"s1": rows.column("s1").take(at), "s2": rows.column("s2").take(at), **{f"w{k}": pa.array([x[i] for i in took], pa.binary()) for k, x in enumerate(out)}})

    return run


def repeated_places(rows: DataFrame, windows: tuple[int, ...] = (WINDOW, REPORT)) -> DataFrame:
    """key, row, start, length, w0, w1: of each segment, where it lies and the runs of starts of repeated strings of each length in it; null for
    all of it."""
    held = cut(segments(rows, min(windows)), "segments")
    where = held.select("s1", "s2", "key", "row", "start", F.length("data").alias("length"))
    kinds = held.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("key", "row", "start")).alias("at"))
    kinds = cut(kinds.select("s1", "s2", (F.col("n") == 1).alias("alone"), F.xxhash64("s1", "s2").alias("seg"), "at.*"), "segment-kinds")
    runs = cut(held.select(F.xxhash64("s1", "s2").alias("seg"), "runs").mapInArrow(lean(_unpacked), "seg long, run long, several boolean").distinct(), "runs")
    heads = runs.groupBy("run").agg(F.min("seg").alias("root"), F.max("seg").alias("last"), F.max("several").alias("several")).where("root <> last or several")
    heads = runs.select("seg", "run").join(heads.select("run", "root"), "run").groupBy("seg").agg(F.collect_list(F.struct("run", "root")).alias("heads"))
    plan = kinds.join(heads.select("seg", "heads.run", "heads.root"), "seg").select("s1", "s2", "key", "row", "start", "alone", F.col("run").alias("heads"), F.col("root").alias("roots"))
    cover = held.join(plan, ["s1", "s2", "key", "row", "start"]).select("s1", "s2", "alone", "data", "runs", "at", "heads", "roots")
    parts = cut(cover.mapInArrow(_cut_up(min(windows), max(windows)), "s1 long, s2 long, alone boolean, root long, first long, starts long, data binary, length long"), "pieces")
    total = parts.agg(F.sum("length")).first()[0] or 0
    shards = int(total // SHARD_BYTES) + 1
    # a shard holds whole groups, or two tiles of one that is too large
    # two tiles share an array, which is then as large as that of the largest part: PART_BYTES and a group of 2 * SHARD_BYTES
    large = parts.groupBy("root").agg(F.sum("length").alias("bytes")).where(F.col("bytes") > 2 * SHARD_BYTES)
    tiles = F.coalesce(F.ceil(F.col("bytes") * 3 / (4 * SHARD_BYTES)), F.lit(1))
    work = parts.join(large, "root", "left").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("s1", "s2", "first"), F.col("tiles")))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")))).where("tiles = 1 or tile <> other")
    shard = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(shards))).otherwise(F.xxhash64("root", F.least("tile", "other"), F.greatest("tile", "other")))
    # two tiles are sorted together, which costs less than to merge their arrays
    work = work.select("s1", "s2", "alone", "first", "starts", "data", "root", shard.alias("shard"), F.lit(0).cast("long").alias("tile"))
    names = [f"w{k}" for k in range(len(windows))]
    found = work.groupBy("shard").applyInArrow(search(windows), ", ".join(["s1 long, s2 long", *(f"{n} binary" for n in names)]))
    # a segment that is met in several shards has runs from each
    several = kinds.where("not alone").select("s1", "s2", *[F.lit(None).cast("binary").alias(n) for n in names])
    return where.join(several.unionByName(found), ["s1", "s2"]).select("key", "row", "start", "length", *names)


def gone(length: int, found: list[dict], name: str, window: int) -> np.ndarray:
    """Which of `length` bytes the strings that the runs start cover."""
    marks = np.zeros(length + 1, np.int32)
    for f in found:
        runs = np.array([[0, f["length"] - window + 1]]) if f[name] is None else np.frombuffer(f[name], np.uint32).reshape(-1, 2).astype(np.int64)
        runs = runs[runs[:, 1] > 0]
        np.add.at(marks, f["start"] + runs[:, 0], 1)
        np.add.at(marks, f["start"] + runs[:, 0] + runs[:, 1] + window - 1, -1)
    return np.cumsum(marks[:-1]) > 0


def kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, report: int = REPORT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, n_repeated, kept (bytes that stay) of each row of docs."""
    rows = with_key(docs, id_col, text)
    places = cut(repeated_places(rows, (window, report)), "places")
    found = places.groupBy("key", "row").agg(F.collect_list(F.struct("start", "length", "w0", "w1")).alias("found"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, offsets = utf8(batch.column(1))
            n_removed, n_spans, n_repeated, texts = [], [], [], []
            for lo, hi, found in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                own, off, near = raw[lo:hi], np.zeros(hi - lo, bool), 0
                if found:
                    off, near = gone(hi - lo, found, "w0", window), int(gone(hi - lo, found, "w1", report).sum())
                n_removed.append(int(off.sum()))
                n_spans.append(int(off[:1].sum()) + int((off[1:] & ~off[:-1]).sum()))
                n_repeated.append(near)
                texts.append((own[~off] if n_removed[-1] else own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), *(pa.array(x, pa.int64()) for x in (n_removed, n_spans, n_repeated)), pa.array(texts, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept"])

    # texts without repeated strings are known by a sketch of the others' keys and not moved
    may = sketch.among(places.select("key").distinct(), "key")
    none = F.lit(None).cast(found.schema["found"].dataType).alias("found")
    joined = rows.where(may).join(found, ["key", "row"], "left").select("id", "text", "found").unionByName(rows.where(~may).select("id", "text", none))
    return joined.mapInArrow(lean(run), f"id {kind}, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary").withColumnRenamed("id", id_col)
