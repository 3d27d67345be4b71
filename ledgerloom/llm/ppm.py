"""Operator 7, LM scoring by prediction by partial matching (PPM).

Training counts, over all training documents, the byte that follows each context of ORDER bytes and fewer. The trie of contexts of ORDER
to 0 bytes gives each byte its probability: in the longest context that the trie has, a byte seen there has (count -
1/2) / total, the rest escapes to the next shorter context (method D), in which the bytes seen before are excluded; below order 0 all bytes that are
left are equal. The trie keeps every context of the training texts.

A group of documents asks for its distinct words and its distinct n-grams (context and byte), by hash bucket; buckets add up what all groups
counted and answer in the order asked: counts of words, code lengths of n-grams. A bucket of n-grams holds all that share the last SHARED bytes of
the context, so it has every context longer than that whole; the shorter ones (at most 65,793 of 2, 1 and 0 bytes, whatever the input) are
counted first and broadcast. So a frequent word or n-gram is one record per group, not per occurrence; a bucket that a group asks nothing of
gets no row from it.

Defined cases: a null or empty text is the end symbol alone; without training documents the trie is uniform and all counts are 0; a null id counts as
the text '' for the split; repeated rows are trained on and scored as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.grouped import grouped
from ledgerloom.llm.text import LOWER, body, pieces, utf8, word_hashes, word_spans
from ledgerloom.session import cut

#: Longest context in bytes.
ORDER = 5
#: Contexts of fewer bytes are broadcast; longer ones lie in buckets by their last SHARED bytes.
SHARED = 3
#: Stands before each text, and after it as the byte to predict; never part of UTF-8.
EDGE = 255
FOLDS, HELD_OUT = 5, 1
RECORDS_PER_BUCKET = 1_000_000
END = np.uint64(0x5851F42D4C957F2D)


def held_out(id_col: str = "id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def contexts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context (the last ORDER bytes as a number, EDGE before the text), byte and document of each byte to predict, the end of each text last."""
    sizes = np.diff(offsets)
    n = len(sizes)
    ends = np.cumsum(sizes + 1)
    doc = np.repeat(np.arange(n), sizes + 1)
    symbols = np.full(int(ends[-1]) if n else 0, EDGE, np.uint8)
    is_end = np.zeros(len(symbols), bool)
    is_end[ends - 1] = True
    symbols[~is_end] = raw
    # the bytes before are those of the text, and EDGE in its front, which the end of the text before also is
    context = np.zeros(len(symbols), np.uint64)
    within = np.arange(len(symbols)) - np.repeat(ends - sizes - 1, sizes + 1)
    for j in range(1, ORDER + 1):
        before = np.full(len(symbols), EDGE, np.uint8)
        before[j:] = symbols[:-j]
        before[within < j] = EDGE
        context |= before.astype(np.uint64) << np.uint64(8 * (j - 1))
    return context, symbols, doc


def lower(x: np.ndarray) -> np.ndarray:
    return LOWER[x] if len(x) else x


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, a text's end last, and its document."""
    starts, ends, at = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    n = np.diff(at)
    out = np.full(len(hashes) + len(n), END, np.uint64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(n + 1) - 1] = True
    out[~last] = hashes
    return out, np.repeat(np.arange(len(n)), n + 1)


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()


def _asked(grams: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and how often each occurs in training."""
    own, times = np.unique(grams[train], return_counts=True)
    names = np.union1d(own, grams[~train])
    n = np.zeros(len(names), np.int64)
    n[np.searchsorted(names, own)] = times
    return names, n


def _dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the n-grams by bucket, and where the next bucket begins."""
    edge = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    shared = (grams >> np.uint64(8)) & np.uint64((1 << (8 * SHARED)) - 1)
    bucket = np.searchsorted(edge, shared * np.uint64(0x9E3779B97F4A7C15), "right")
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(1, buckets))


def count(groups: DataFrame, buckets: int) -> DataFrame:
    """Per group and bucket: its distinct words and its distinct n-grams (context << 8 | byte), each with its training counts."""

    def run(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        g = rows.column("g")[0].as_py()
        raw, offsets = utf8(rows.column("text").combine_chunks())
        raw, train = lower(raw), ~rows.column("out").to_numpy()
        hashes, doc = tokens(raw, offsets)
        words, at = np.unique(hashes, return_inverse=True)
        seen = np.bincount(at[train[doc]], minlength=len(words))
        context, symbol, doc = contexts(raw, offsets)
        grams, n = _asked((context << np.uint64(8)) | symbol, train[doc])
        edge = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
        cut_w = np.searchsorted(words, edge)
        order, cut_g = _dealt(grams, buckets)
        cols = [
            pa.array(np.arange(buckets, dtype=np.int32)),
            pa.array(np.full(buckets, g, np.int32)),
            *(pa.array([x.tobytes() for x in np.split(v, c)], pa.binary()) for v, c in ((words, cut_w), (seen.astype(np.uint32), cut_w), (grams[order], cut_g), (n.astype(np.uint32)[order], cut_g))),
        ]
        asked = np.diff(np.concatenate([[0], cut_w, [len(words)]])) + np.diff(np.concatenate([[0], cut_g, [len(grams)]])) > 0
        return pa.table(cols, names=["bucket", "g", "words", "seen", "grams", "n"]).filter(pa.array(asked))

    return groups.groupBy("g").applyInArrow(run, "bucket int, g int, words binary, seen binary, grams binary, n binary")


def short_counts(docs: DataFrame, id_col: str, text: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, byte, count) of all training contexts below SHARED bytes."""
    width = np.uint64((1 << (8 * SHARED)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw, offsets = utf8(batch.column(0))
            context, symbol, _ = contexts(lower(raw), offsets)
            grams, n = np.unique(((context << np.uint64(8)) | symbol) & width, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    train = docs.where(~held_out(id_col)).select(body(text).alias("text"))
    rows = train.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    grams, n = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    return {order: shortened(grams, n, order) for order in range(SHARED)}


def shortened(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, byte, count) of the last `order` bytes of n-grams."""
    keys, at = np.unique(grams & np.uint64((1 << (8 * order + 8)) - 1), return_inverse=True)
    return keys >> np.uint64(8), keys & np.uint64(255), np.bincount(at, n, len(keys)).astype(np.int64)


class Trie:
    """Counts of each order as sorted n-grams; orders below those given are those of `below`."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], below: Trie | None = None):
        self.levels = dict(below.levels) if below else {}
        for order in sorted(counts):
            context, symbol, n = counts[order]
            grams = (np.asarray(context).astype(np.uint64) << np.uint64(8)) | np.asarray(symbol).astype(np.uint64)
            by = np.argsort(grams)
            grams, n = grams[by], np.asarray(n).astype(np.float64)[by]
            keys, start = np.unique(grams >> np.uint64(8), return_index=True)
            total, shorter = (np.add.reduceat(n, start) if len(n) else n), np.zeros(len(keys))
            if order and len(n):  # what the bytes seen here count in the next shorter context
                names, times = self.levels[order - 1][:2]
                shorter = np.add.reduceat(times[np.searchsorted(names, grams & np.uint64((1 << (8 * order)) - 1))], start)
            self.levels[order] = (grams, n, keys, total, np.diff(np.append(start, len(grams))), shorter)

    def score(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each byte in its context."""
        wanted = (context.astype(np.uint64) << np.uint64(8)) | symbol.astype(np.uint64)
        p, todo = np.ones(len(wanted)), np.arange(len(wanted))
        # chance of all that is not seen in longer contexts; number of bytes seen there, and their count in this one
        mass, out, gone = np.ones(len(wanted)), np.zeros(len(wanted)), np.zeros(len(wanted))
        for order in range(max(self.levels), -1, -1):
            grams, n, keys, totals, distinct, shorter = self.levels[order]
            if not len(keys):
                continue
            gram = wanted[todo] & np.uint64((1 << (8 * order + 8)) - 1)
            row = np.minimum(np.searchsorted(keys, gram >> np.uint64(8)), len(keys) - 1)
            known = keys[row] == gram >> np.uint64(8)
            place = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            seen = grams[place] == gram
            total, fresh = totals[row] - gone, distinct[row] - out
            some = known & (fresh > 0)
            share = np.divide(mass, total, out=np.zeros(len(todo)), where=some)
            p[todo[seen]] = ((n[place] - np.where(distinct[row] < 256, 0.5, 0.0)) * share)[seen]
            mass = np.where(some, share * np.where(distinct[row] < 256, 0.5 * fresh, 0.0), mass)[~seen]
            out, gone = np.where(known, distinct[row], 0)[~seen], np.where(known, shorter[row], 0)[~seen]
            todo = todo[~seen]
        p[todo] = np.divide(mass, 256 - out, out=np.zeros(len(todo)), where=out < 256)
        return np.log10(p)

    @property
    def rows(self) -> np.ndarray:
        """Code lengths of all bytes in each context, longest contexts first (small tries only)."""
        out = []
        for order in sorted(self.levels, reverse=True):
            upto = Trie.__new__(Trie)
            upto.levels = {k: v for k, v in self.levels.items() if k <= order}
            keys = self.levels[order][2]
            out.append(upto.score(np.repeat(keys, 256), np.tile(np.arange(256, dtype=np.uint64), len(keys))))
        return np.concatenate(out)


def add_up(counted: DataFrame, short) -> DataFrame:
    """Answers (g, bucket, counts and code lengths aligned with the words and n-grams asked for), and per bucket (known, total) of its words."""

    def run(rows: pa.Table) -> pa.Table:
        arrays = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in rows.column(c)]
        apart = lambda v, like: np.split(v, np.cumsum([len(x) for x in like])[:-1])
        words, seen = arrays("words", np.uint64), arrays("seen", np.uint32)
        names, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate(seen), len(names)).astype(np.int64)
        answers = apart(total[at], words)
        asked = arrays("grams", np.uint64)
        grams, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(at, np.concatenate(arrays("n", np.uint32)), len(grams))
        trained = {order: shortened(grams[n > 0], n[n > 0], order) for order in range(SHARED, ORDER + 1)}
        codes = apart(Trie(trained, short.value).score(grams >> np.uint64(8), grams & np.uint64(255)).astype(np.float32)[at], asked)
        return pa.table(
            {
                "g": pa.array([*rows.column("g").to_pylist(), None], pa.int32()),
                "bucket": pa.array([rows.column("bucket")[0].as_py()] * (len(answers) + 1), pa.int32()),
                "counts": pa.array([*(a.tobytes() for a in answers), None], pa.binary()),
                "codes": pa.array([*(a.tobytes() for a in codes), None], pa.binary()),
                "known": pa.array([*[None] * len(answers), int((total > 0).sum())], pa.int64()),
                "total": pa.array([*[None] * len(answers), int(total.sum())], pa.int64()),
            }
        )

    return counted.groupBy("bucket").applyInArrow(run, "g int, bucket int, counts binary, codes binary, known long, total long")


def scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    groups, n_groups = grouped(docs, id_col, text)
    groups = groups.withColumn("out", held_out())
    buckets = n_groups * 250_000 // RECORDS_PER_BUCKET + 1
    short = spark.sparkContext.broadcast(Trie(short_counts(docs, id_col, text)))
    added = cut(add_up(count(groups, buckets), short), "counts")
    known, total = added.agg(F.sum("known"), F.sum("total")).first()
    known, total = known or 0, total or 0
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        n = rows.num_rows
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not n:
            return pa.table({k: pa.nulls(0) for k in names})
        raw, offsets = utf8(rows.column("text").combine_chunks())
        raw = lower(raw)
        hashes, doc = tokens(raw, offsets)
        _, at = np.unique(hashes, return_inverse=True)
        order = np.argsort(answers.column("bucket").to_numpy())
        counts = np.concatenate([np.frombuffer(answers.column("counts")[i].as_py(), np.int64) for i in order.tolist()])[at]
        base = np.bincount(doc, np.log10((counts + 0.5) / (total + 0.5 * (known + 1))), n)
        context, symbol, d = contexts(raw, offsets)
        grams, at = np.unique((context << np.uint64(8)) | symbol, return_inverse=True)
        codes = np.empty(len(grams))
        codes[_dealt(grams, buckets)[0]] = np.concatenate([np.frombuffer(answers.column("codes")[i].as_py(), np.float32) for i in order.tolist()])
        score = np.bincount(d, codes[at], n)
        cols = [rows.column("id"), rows.column("out"), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[counts > 0], minlength=n)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)]
        return pa.table(cols, names=names)

    answers = added.where("g is not null").select("g", "bucket", "counts", "codes")
    out = groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
