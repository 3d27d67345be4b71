"""Operator 3, line dedup (DataFrame functions only).

Occurrences of line keys (128-bit hashes) are range-partitioned by hash and sorted by document and position within it; a running
window streams over them and marks all but the first document's lines. What comes back is not text but, per document, a
run-length bitmap: lengths of alternating runs of kept and dropped lines, kept first, a kept tail left out.

A key that holds a large share of all lines would fill one range. Such keys are found with approx_top_k, a sketch of bounded
size; for those alone the first document comes from a minimum with map-side combine, and goes back by broadcast (at most HOT_KEYS rows).
The sketch only picks the way of computing; either way gives the same rows.

Defined cases: a null or empty text is one empty line; rows with the same doc_id are one document; a null doc_id comes after all
others; equal rows get equal bitmaps; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import ascii_lower, body, trimmed
from ledgerloom.session import cut, fresh

MIN_CHARS = 10
HOT_KEYS = 1000
#: A key with more than this share of all eligible lines is hot.
HOT_SHARE = 1 / 1000


def occurrences(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """doc, row (hash of the text), pos, h1, h2 of each eligible line."""
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(body(text)).alias("row"), F.posexplode(F.split(body(text), "\n")).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", ascii_lower(trimmed(F.col("line"))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, row, n_dropped, runs for each document that loses lines."""
    occ = cut(occurrences(docs, id_col, text, min_chars), "lines")
    top, total = occ.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, 10000)"), F.count("*")).first()
    hot = [x["item"] for x in top or [] if x["count"] > max(HOT_SHARE * total, 1000)]
    first = F.first("doc").over(Window.partitionBy("h1", "h2").orderBy(F.col("doc").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, 0))
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    dropped = occ.where(~is_hot).repartitionByRange("h1").withColumn("first", first)
    if hot:
        firsts = occ.where(is_hot).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
        dropped = dropped.unionByName(occ.where(is_hot).join(F.broadcast(firsts), ["h1", "h2"]))
    dropped = dropped.where(~F.col("doc").eqNullSafe(F.col("first")))
    return (
        dropped.groupBy("doc", "row")
        .agg(F.sort_array(F.collect_set("pos")).alias("p"))
        .select("doc", "row", "p", _edges(-1).alias("starts"), _edges(1).alias("ends"))
        .select(
            "doc",
            "row",
            F.size("p").cast("long").alias("n_dropped"),
            F.flatten(F.transform("starts", lambda s, i: F.array(s - F.coalesce(F.get(F.col("ends"), i - 1) + 1, F.lit(0)), F.get(F.col("ends"), i) - s + 1))).alias("runs"),
        )
    )


def _edges(step: int):
    return F.filter("p", lambda p, i: F.coalesce(F.get(F.col("p"), i + step) != p + step, F.lit(True)))


def with_kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> tuple[DataFrame, dict[str, str]]:
    """docs with the kept text, its bitmap and counts; the dict gives the names of these four columns."""
    names = dict(zip(("kept", "runs", "n_dropped", "n_lines"), fresh(docs, "kept_text", "keep_runs", "n_dropped", "n_lines"), strict=True))
    extra = docs.select("*", *[F.lit(0).alias(v) for v in names.values()])
    doc, row, flags, lines = fresh(extra, "_doc", "_row", "_flags", "_lines")
    maps = bitmaps(docs, id_col, text, min_chars).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("n_dropped").alias(names["n_dropped"]), F.col("runs").alias(names["runs"]))
    df = docs.join(maps, docs[id_col].eqNullSafe(maps[doc]) & (F.xxhash64(body(docs[text])) == maps[row]), "left").drop(doc, row)
    df = df.withColumn(flags, F.flatten(F.transform(names["runs"], lambda n, i: F.array_repeat(i % 2 == 0, n))))
    df = df.withColumn(lines, F.when(F.col(names["runs"]).isNotNull(), F.split(body(text), "\n")))
    kept = F.when(F.col(lines).isNull(), body(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get(F.col(flags), i), F.lit(True))), "\n"))
    return df.withColumns(
        {
            names["kept"]: kept,
            names["n_lines"]: (F.char_length(body(text)) - F.char_length(F.replace(body(text), F.lit("\n"), F.lit(""))) + 1).cast("long"),
            names["n_dropped"]: F.coalesce(F.col(names["n_dropped"]), F.lit(0).cast("long")),
        }
    ).drop(flags, lines), names


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated lines taken out of the text; a document that loses all lines gets an empty text. n_chars follows the text."""
    df, names = with_kept(docs, id_col, text)
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    changed = F.col(names["n_dropped"]) > 0
    out[text] = F.when(changed, F.col(names["kept"])).otherwise(F.col(f"`{text}`"))
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.char_length(names["kept"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.select(*[v.alias(k) for k, v in out.items()])
