"""Readers and writers of stage artifacts: word boxes, contract tables, records, manifests, responses of managed services and converters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


WORDS = "doc_id string, page int, text string, bbox array<double>, ocr_conf double, ocr boolean"
CONTRACT = "row_label string, col_label string, raw string, value double, scale double"
MANIFEST = "doc_id string, accession string, cik string, source_file string, ticker string, form string, period string, stem string, pdf_path string, renderer string, renderer_version string, page_width_pt double, page_height_pt double"
NAME = r"^(.*)_p(\d{4})_t(\d+)\.csv$"
LETTER = (612.0, 792.0)
# Converter labels and the block types they mean.
LABEL_TYPES = {"title": "Title", "section_header": "Title", "list_item": "List", "table": "Table", "picture": "Figure", "footnote": "Footnote"}


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(schema).json(path).where(F.expr(" or ".join(f"`{f.split()[0]}` is not null" for f in [schema.split(",")[0]])))


def contract_tables(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a folder of {stem}_p{NNNN}_t{K}.csv files, with stem, page, table number and row order."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = spark.read.schema(CONTRACT).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select("*", name.alias("file"), F.monotonically_increasing_id().alias("ord"))
    part = lambda i: F.regexp_extract("file", NAME, i)
    return rows.where(F.col("file").rlike(NAME)).select(part(1).alias("stem"), part(2).cast("int").alias("page"), part(3).cast("int").alias("table_no"), "ord", *[x.split()[0] for x in CONTRACT.split(", ")])


def manifest(spark: SparkSession, path: str, companies: DataFrame | None = None) -> DataFrame:
    """Manifest rows; page sizes default to Letter; company names by ticker, else the ticker."""
    m = spark.read.schema(MANIFEST).option("header", True).csv(path)
    m = m.withColumns({"page_width_pt": F.coalesce("page_width_pt", F.lit(LETTER[0])), "page_height_pt": F.coalesce("page_height_pt", F.lit(LETTER[1]))})
    if companies is None:
        return m.withColumn("company", F.col("ticker"))
    return m.join(companies.select("ticker", "company"), "ticker", "left").withColumn("company", F.coalesce("company", "ticker"))


def with_manifest(rows: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Rows with their manifest entry; fails on a stem that the manifest lacks."""
    extra = [c for c in manifest_rows.columns if c not in rows.columns or c == "stem"]
    joined = rows.join(manifest_rows.select(*extra, F.lit(True).alias("_known")), "stem", "left")
    return joined.where(F.coalesce("_known", F.raise_error(F.concat(F.lit("not in the manifest: "), "stem")).cast("boolean"))).drop("_known")


def ocr_lines(words: DataFrame, dpi: float = 300.0) -> DataFrame:
    """OCR words (stem, page, block, par, line, word_no, text, conf and pixel box) to lines in points with mean confidence; words with a negative confidence are dropped."""
    k = 72.0 / dpi
    good = words.where(F.col("conf") >= 0)
    order = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return good.groupBy("stem", "page", "block", "par", "line").agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"), F.avg("conf").alias("mean_conf"), *[(f(c) * k).alias(c) for c, f in (("x0", F.min), ("top", F.min), ("x1", F.max), ("bottom", F.max))])


def extracted(files: DataFrame, extract: Callable[[bytes, int], list[dict]], schema: str, keys: tuple[str, ...] = ("stem", "page")) -> DataFrame:
    """Rows of a page extractor (PDF text, OCR, layout model, converter), called per page with (content, page) over Arrow batches. A page that fails gives one row
    with its error, never a failed task. `schema` adds to the keys; it needs a field `error`."""
    full = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys) + f", {schema}"
    names = [f.strip().split()[0] for f in full.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    found = extract(r["content"], r["page"])
                except Exception as e:  # noqa: BLE001  the extractor is foreign code: its failure is data
                    found = [{"error": f"{type(e).__name__}: {e}"}]
                rows += [{n: (r | x).get(n) for n in names} for x in found]
            yield pa.RecordBatch.from_pylist(rows, schema=target) if rows else pa.RecordBatch.from_pylist([], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(full))
    return files.select(*keys, "content").mapInArrow(run, full)


def managed_text(blocks: DataFrame) -> DataFrame:
    """(doc, id) -> text of lines, cells and other blocks of a response graph: WORD children in order. blocks: doc, id, kind, text, children array."""
    kids = blocks.select("doc", "id", F.posexplode("children").alias("pos", "child"))
    words = blocks.where(F.col("kind").isin("WORD", "LINE")).select("doc", F.col("id").alias("child"), F.col("text").alias("word"))
    joined = kids.join(words, ["doc", "child"]).groupBy("doc", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("joined"))
    return blocks.join(joined, ["doc", "id"], "left").withColumn("text", F.coalesce("text", "joined", F.lit(""))).drop("joined")


def managed_grids(blocks: DataFrame) -> DataFrame:
    """Grid of each TABLE block of a response, from its CELL children (row, col from 1)."""
    from ledgerloom.operators.tables import dense_grid

    text = managed_text(blocks)
    cells = text.where(F.col("kind") == "CELL").select("doc", F.col("id").alias("child"), "row", "col", "text")
    owned = blocks.where(F.col("kind") == "TABLE").select("doc", F.col("id").alias("table"), F.explode("children").alias("child")).join(cells, ["doc", "child"])
    return dense_grid(owned, ["doc", "table"])


def anchored_text(text: str | Column, anchors: str | Column) -> Column:
    """Text at offset slices (array of structs start, end), in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(anchors, lambda a: F.substring(t, (a["start"] + 1).cast("int"), (a["end"] - a["start"]).cast("int"))), "")


def converter_blocks(items: DataFrame) -> DataFrame:
    """items: stem, page, item_no, label, text, box (from below), page_height. Blocks with type, box from above and ids; items without a place are left out."""
    from ledgerloom.functions.boxes import flip
    from ledgerloom.operators.sections import block_ids

    kind = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in LABEL_TYPES.items()], F.lit("Text"))
    rows = items.where(F.col("box").isNotNull()).select("stem", "page", "item_no", kind.alias("block_type"), "text", flip("box", F.col("page_height")).alias("box"))
    return block_ids(rows, ["stem"], "page", ["item_no"])


# ---------------------------------------------------------------- sinks


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines by stem, in reading order within a file; a page's output is replaced as a whole."""
    ordered = rows.repartition("stem").sortWithinPartitions("stem", "page", F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").json(path)


def write_contract(cells: DataFrame, path: str) -> None:
    """Contract tables by stem and page; pages not in `cells` stay as they are."""
    cells.repartition("stem", "page").sortWithinPartitions("stem", "page", "table_no", "ord").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("stem", "page").csv(path)


def write_texts(docs: DataFrame, path: str) -> None:
    """One text per stem (Markdown or plain)."""
    docs.select("stem", "text").write.mode("overwrite").partitionBy("stem").option("lineSep", "\n").text(path)


def metrics_json(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of metrics as one JSON text per first key. Metrics are a report: its rows don't grow with the corpus."""
    rest = [c for c in metrics.columns if c != keys[0]]
    return metrics.groupBy(keys[0]).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("json"))


def archive_key(files: DataFrame) -> DataFrame:
    """One hash for a set of files: over names and content hashes, in order."""
    each = files.select("name", F.sha2("content", 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat(x["name"], F.lit(" "), x["h"])), "\n"), 256).alias("key"))


def latest_accepted(log: DataFrame) -> DataFrame:
    """(stem, page) -> method accepted last in the decision log."""
    w = Window.partitionBy("stem", "page").orderBy(F.desc("ord"))
    return log.where("accepted").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("stem", "page", "method")


