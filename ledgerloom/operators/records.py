"""Provenance records: checks, adaptation, page text and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import c, plain_text
from ledgerloom.operators.tables import table_text

VERSION = "1.0"
BLOCK_TYPES = ["Text", "Title", "List", "Table", "Figure", "Footnote"]
BOX = "array<double>"
TABLE = "struct<columns:array<string>,rows:array<array<string>>,raw_cells:array<array<string>>,scale:string>"
SCHEMA = (
    "schema string, doc_id string, company string, ticker string, cik string, form string, fiscal_year int, fiscal_period string, page int, section string, block_id string, block_type string, "
    f"bbox {BOX}, units string, origin string, text string, table {TABLE}, extractor string, extractor_version string, ocr boolean, ocr_conf double, source_path string, sha256 string"
)
REQUIRED = ["company", "ticker", "form", "fiscal_year", "fiscal_period", "extractor", "extractor_version"]


def errors(version: str = VERSION) -> Column:
    """What is wrong with a record, as an array; empty if nothing is."""
    x = F.col
    at = lambda i: F.get(F.col("bbox"), F.lit(i))
    ok = lambda cond: F.coalesce(cond, F.lit(False))
    checks = {
        "schema version": ok(x("schema") == version),
        "doc_id form": ok(x("doc_id").rlike(r"^\d{10}-\d{2}-\d{6}$")),
        "cik form": ok(x("cik").rlike(r"^\d{10}$")),
        "page below 1": ok(x("page") >= 1),
        "block_id form": ok(x("block_id").rlike(r"^p\d{4}_b\d{3}$")),
        "block_type": ok(x("block_type").isin(BLOCK_TYPES)),
        "bbox": ok((F.size("bbox") == 4) & (at(2) > at(0)) & (at(3) > at(1))),
        "units": ok(x("units") == "pt"),
        "origin": ok(x("origin") == "top-left"),
        "text or table": x("text").isNotNull() | x("table").isNotNull(),
        "table of a Table": (x("block_type") != "Table") | x("table").isNotNull(),
        "table row width": x("table").isNull() | F.forall(F.coalesce(x("table.rows"), F.array().cast("array<array<string>>")), lambda r: F.size(r) == F.size(x("table.columns"))),
        "ocr_conf range": x("ocr_conf").isNull() | x("ocr_conf").between(0, 1),
        "ocr_conf of ocr": ~F.coalesce(x("ocr"), F.lit(False)) | x("ocr_conf").isNotNull(),
        "source_path": ok((x("source_path") != "") & ~x("source_path").contains("\\")),
        "sha256 form": ok(x("sha256").rlike("^[0-9a-f]{64}$")),
        **{f"{name} missing": x(name).isNotNull() for name in REQUIRED},
    }
    return F.filter(F.array(*[F.when(~v, F.lit(k)) for k, v in checks.items()]), lambda e: e.isNotNull())


def validated(records: DataFrame) -> DataFrame:
    return records.withColumn("errors", errors())


def with_text(blocks: DataFrame) -> DataFrame:
    """Blocks that say something; table placeholders are not theirs to emit."""
    return blocks.withColumn("text", plain_text("text")).where(F.col("text").isNotNull() & (F.col("block_type") != "Table"))


def page_status(n_blocks: str | Column, n_words: str | Column) -> Column:
    return F.when(c(n_blocks) > 0, "ok").when(c(n_words) == 0, "blank").otherwise("missed")


def table_scale(rows: DataFrame, table: list[str]) -> DataFrame:
    """The one scale of a table, else null."""
    return rows.groupBy(*table).agg(F.when(F.count_distinct(F.nullif(F.col("scale").cast("string"), F.lit(""))) == 1, F.max(F.nullif(F.col("scale").cast("string"), F.lit("")))).alias("scale"))


def page_texts(records: DataFrame, page: list[str], top: str = "top", left: str = "x0", tie: str = "block_id") -> DataFrame:
    """Text of each page in reading order, tables by tabs."""
    words = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.when(F.col("block_type") == "Table", table_text(F.coalesce("raw_cells", "rows"))))
    rows = records.withColumn("_t", words).where(F.col("_t") != "")
    return rows.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(top, left, tie, "_t"))), lambda x: x["_t"]), "\n").alias("page_text"))


def block_markdown(kind: str | Column, text: str | Column, columns: str | Column | None = None, rows: str | Column | None = None) -> Column:
    """Body of a block: headings, list items, quotes and pipe tables."""
    k, t = c(kind), F.coalesce(c(text), F.lit(""))
    out = F.when(k == "Title", F.concat(F.lit("## "), t))
    if columns is not None and rows is not None:
        line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.transform(c(columns), lambda _: F.lit("---")), " | "), F.lit(" |"))
        out = out.when((k == "Table") & c(rows).isNotNull(), F.array_join(F.concat(F.array(line(c(columns)), rule), F.transform(c(rows), line)), "\n"))
    items = F.array_join(F.transform(F.filter(F.split(t, "\n"), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    return out.when(k == "List", items).when(k == "Footnote", F.concat(F.lit("> "), t)).otherwise(t)


def markdown(blocks: DataFrame, doc: list[str], page: str, order: list[str], provenance: list[str], body: Column, title: Column) -> DataFrame:
    """One text per document: title, page marks, and each block behind a comment with its provenance."""
    new_page = F.coalesce(F.lag(page).over(Window.partitionBy(*doc).orderBy(page, *order)) != F.col(page), F.lit(True))
    comment = F.concat(F.lit("<!-- "), F.to_json(F.struct(*provenance)), F.lit(" -->\n"))
    mark = F.when(new_page, F.concat(F.lit("\n<!-- page "), F.col(page).cast("string"), F.lit(" -->\n\n"))).otherwise(F.lit(""))
    rows = blocks.withColumns({"_title": title, "_part": F.concat(mark, comment, body)})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, *order, "_part"))), lambda x: x["_part"]), "\n\n")
    return rows.groupBy(*doc).agg(F.concat(F.lit("# "), F.first("_title"), F.lit("\n\n\n\n"), joined, F.lit("\n")).alias("markdown"))


def absorbed(blocks: DataFrame, in_table: Column, page: list[str], block: str, tokens: str, share: float = 0.8) -> DataFrame:
    """Text blocks of which at least `share` of the tokens stand in the page's tables. A block without tokens stays.
    in_table: is this row a table's. Rows that are dealt by page are not moved again."""
    rows = blocks.select(*page, block, F.coalesce(in_table, F.lit(False)).cast("int").alias("_in"), F.explode(tokens).alias("_token"))
    hits = rows.withColumn("_hit", F.max("_in").over(Window.partitionBy(*page, "_token")))
    return hits.groupBy(*page, block).agg(F.avg("_hit").alias("share")).where(F.col("share") >= share)
