"""Documents in groups of a bounded number of bytes, for operators that visit them twice.

Groups follow from hashes of id and text alone, so both visits see the same rows, in the same order after sorting, whatever the
partitioning or retries; what other tasks answer to a group can then be aligned with what it asked, without naming documents.
A group holds about GROUP_BYTES of text, or one longer document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import body

GROUP_BYTES = 4_000_000


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(g, id, row, text) and the number of groups. row: hash of the text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(total // group_bytes) + 1
    row = F.xxhash64(body(text))
    return docs.select(F.pmod(F.xxhash64(F.lit(5), F.col(id_col), row), F.lit(n)).cast("int").alias("g"), F.col(id_col).alias("id"), row.alias("row"), body(text).alias("text")), n
