"""Readers of filings: submissions with embedded documents, tagged values in HTML, label and presentation linkbases."""

from __future__ import annotations

import binascii
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Header fields of a submission and marks of its documents.
HEADER_FIELDS = {"cik": r"(?m)^\s*CENTRAL INDEX KEY:\s*(\S+)", "accession": r"(?m)^ACCESSION NUMBER:\s*(\S+)", "period": r"(?m)^CONFORMED PERIOD OF REPORT:\s*(\S+)", "filing_date": r"(?m)^FILED AS OF DATE:\s*(\S+)"}
DOCUMENT = r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"
SAFE_NAME = r"^(?!\.{1,2}$)[^/\\]+$"


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each submission file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def headers(subs: DataFrame) -> DataFrame:
    """Header fields; the cik has ten digits. Fails on a submission that lacks one."""
    head = F.split_part("text", F.lit("<DOCUMENT>"), F.lit(1))
    found = {k: F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for k, p in HEADER_FIELDS.items()}
    need = lambda k: F.coalesce(found[k], F.raise_error(F.concat(F.lit(f"missing header field {k} in "), F.col("path"))).cast("string"))
    return subs.select("path", F.lpad(need("cik"), 10, "0").alias("cik"), *[need(k).alias(k) for k in HEADER_FIELDS if k != "cik"])


@F.pandas_udf(BinaryType())
def decode_uu(payloads: pd.Series) -> pd.Series:
    """Bytes of uuencoded payloads; others as they are. A line with padding too long is read for its stated length; a bad payload is null."""

    def decode(text: str | None) -> bytes | None:
        if text is None or not text.startswith("begin "):
            return None if text is None else f"{text}\n".encode()
        lines = text.splitlines()
        if not re.fullmatch("begin [0-7]{3} .+", lines[0]) or lines[-1] != "end":
            return None
        out = []
        try:
            for raw in (x.encode("ascii") for x in lines[1:-1] if x):
                stated = ((raw[0] - 32) % 64 * 4 + 2) // 3 + 1
                try:
                    out.append(binascii.a2b_uu(raw))
                except binascii.Error:
                    out.append(binascii.a2b_uu(raw[:stated]))
        except (binascii.Error, UnicodeEncodeError):
            return None
        return b"".join(out)

    return payloads.map(decode, na_action="ignore")


def documents(subs: DataFrame) -> DataFrame:
    """path, document number, file name, payload and content of each embedded document."""
    docs = subs.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(DOCUMENT), F.lit(1))).alias("doc_no", "doc"))
    name = F.trim(F.regexp_extract("doc", r"<FILENAME>([^\n\r<]*)", 1))
    # up to the last closing mark: content may hold one itself
    payload = F.trim(F.regexp_extract("doc", r"(?s)<TEXT>(.*)</TEXT>", 1))
    payload = F.regexp_replace(F.regexp_replace(payload, r"^\s+", ""), r"\s+$", "")
    out = docs.select("path", "doc_no", F.nullif(name, F.lit("")).alias("filename"), payload.alias("payload")).where(F.col("filename").isNotNull())
    return out.withColumn("content", decode_uu("payload"))


def document_problems(docs: DataFrame) -> DataFrame:
    """path, problem: unsafe or repeated names, undecodable payloads, and submissions without a schema document."""
    unsafe = docs.where(~F.col("filename").rlike(SAFE_NAME)).select("path", F.concat(F.lit("unsafe name "), "filename").alias("problem"))
    twice = docs.groupBy("path", "filename").count().where("count > 1").select("path", F.concat(F.lit("repeated name "), "filename").alias("problem"))
    bad = docs.where(F.col("content").isNull()).select("path", F.concat(F.lit("cannot decode "), "filename").alias("problem"))
    bare = docs.groupBy("path").agg(F.max(F.col("filename").endswith(".xsd")).alias("has")).where("not has").select("path", F.lit("no schema document").alias("problem"))
    return unsafe.unionByName(twice).unionByName(bad).unionByName(bare)


def unwrapped(text: str | F.Column) -> F.Column:
    """Without the XBRL or XML envelope, where it is at both ends."""
    x = F.trim(F.col(text) if isinstance(text, str) else text)
    inner = F.regexp_extract(x, r"(?s)^\s*<(XBRL|XML)>(.*)</\1>\s*$", 2)
    return F.when(inner != "", F.concat(F.trim(F.regexp_replace(F.regexp_replace(inner, r"^\s+", ""), r"\s+$", "")), F.lit("\n"))).otherwise(F.col(text) if isinstance(text, str) else text)


def tagged_value(html: str, name: str) -> F.Column:
    """Text of the first inline tag with that name, without markup; null if none."""
    inner = F.regexp_extract(html, rf'(?s)<ix:non(?:Numeric|Fraction)[^>]*\bname="{name}"[^>]*>(.*?)</ix:non(?:Numeric|Fraction)>', 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), r"\s+", " ")), F.lit(""))


def _attribute(el: F.Column, name: str) -> F.Column:
    return F.regexp_extract(el, rf'\b{name}="([^"]*)"', 1)


def _elements(xml: DataFrame, tag: str) -> DataFrame:
    """stem, number and source of each element; namespaces may have any prefix."""
    return xml.select("stem", F.posexplode(F.regexp_extract_all("xml", F.lit(rf"(?s)<(?:\w+:)?{tag}\b[^>]*?(?:/>|>(?:[^<]*</(?:\w+:)?{tag}>)?)"), F.lit(0))).alias("ord", "el"))


def _locators(xml: DataFrame) -> DataFrame:
    fragment = F.element_at(F.split(_attribute(F.col("el"), "xlink:href"), "#"), -1)
    return _elements(xml, "loc").select("stem", _attribute(F.col("el"), "xlink:label").alias("loc"), F.split_part(fragment, F.lit("_"), F.lit(1)).alias("prefix"), F.regexp_extract(fragment, "^[^_]*_(.*)$", 1).alias("concept"))


def linkbase_labels(xml: DataFrame) -> DataFrame:
    """xml: stem, xml. (stem, text_key, prefix, concept, ord): which concepts a label text names."""
    from ledgerloom.functions.text import label_form

    arcs = _elements(xml, "labelArc").select("stem", "ord", _attribute(F.col("el"), "xlink:from").alias("loc"), _attribute(F.col("el"), "xlink:to").alias("label"))
    texts = _elements(xml, "label").select("stem", _attribute(F.col("el"), "xlink:label").alias("label"), label_form(F.regexp_extract("el", ">([^<]*)<", 1)).alias("text_key"))
    rows = arcs.join(_locators(xml), ["stem", "loc"]).join(texts, ["stem", "label"]).where("text_key <> ''")
    return rows.groupBy("stem", "text_key", "prefix", "concept").agg(F.min("ord").alias("ord"))


def negated_concepts(xml: DataFrame) -> DataFrame:
    """(stem, prefix, concept) that a presentation linkbase shows with a negated label."""
    arcs = _elements(xml, "presentationArc").where(_attribute(F.col("el"), "preferredLabel").contains("negated")).select("stem", _attribute(F.col("el"), "xlink:to").alias("loc"))
    return arcs.join(_locators(xml), ["stem", "loc"]).select("stem", "prefix", "concept").distinct()


def require_inputs(found: DataFrame, pinned: DataFrame, key: str) -> None:
    """The inputs must be exactly the pinned ones."""
    gone, extra = (sorted(r[0] for r in a.select(key).exceptAll(b.select(key)).limit(20).collect()) for a, b in ((pinned, found), (found, pinned)))
    if gone or extra:
        raise ValueError(f"inputs differ from the pinned ones: missing {gone}, unexpected {extra}")
