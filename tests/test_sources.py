import binascii

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import artifacts, filings
from ledgerloom.streaming import events

HEAD = "ACCESSION NUMBER:\t0000320193-25-000079\nCONFORMED PERIOD OF REPORT:\t20250927\nFILED AS OF DATE:\t20251031\n CENTRAL INDEX KEY:\t320193\n"


def submission(*docs):
    return HEAD + "".join(f"<DOCUMENT>\n<TYPE>X\n<FILENAME>{n}\n<TEXT>\n{t}\n</TEXT>\n</DOCUMENT>\n" for n, t in docs)


def test_submissions(spark, tmp_path):
    data = bytes(range(100))
    coded = "begin 644 x.zip\n" + "".join(binascii.b2a_uu(data[i : i + 45]).decode() for i in range(0, 100, 45)) + "`\nend"
    (tmp_path / "a.txt").write_text(submission(("a.htm", "<p>x</TEXT>y"), ("a.xsd", "s"), ("x.zip", coded)))
    subs = filings.submissions(spark, str(tmp_path))
    assert filings.headers(subs).select("cik", "period").first() == ("0000320193", "20250927")
    docs = {r["filename"]: bytes(r["content"]) for r in filings.documents(subs).collect()}
    assert docs == {"a.htm": b"<p>x</TEXT>y\n", "a.xsd": b"s\n", "x.zip": data}
    assert filings.document_problems(filings.documents(subs)).count() == 0


def test_bad_submissions_are_told(spark, tmp_path):
    (tmp_path / "b.txt").write_text(submission(("../x", "a"), ("y", "1"), ("y", "2"), ("z", "begin 644 z\n!!\nend2")))
    docs = filings.documents(filings.submissions(spark, str(tmp_path)))
    assert sorted(r["problem"] for r in filings.document_problems(docs).collect()) == ["cannot decode z", "no schema document", "repeated name y", "unsafe name ../x"]


def test_envelopes_and_tags(spark):
    df = spark.createDataFrame([("<XBRL>\n<x/>\n</XBRL>", '<ix:nonNumeric name="dei:Period">F<b>Y</b></ix:nonNumeric>'), ("<y/>", "")], "x string, h string")
    out = df.select(filings.unwrapped("x"), filings.tagged_value("h", "dei:Period")).collect()
    assert [tuple(r) for r in out] == [("<x/>\n", "FY"), ("<y/>", None)]


LABELS = """<link:loc xlink:href="a.xsd#us-gaap_Cash" xlink:label="l1"/><link:label xlink:label="t1">Cash  and  Equivalents</link:label><link:labelArc xlink:from="l1" xlink:to="t1"/>
<link:loc xlink:href="a.xsd#us-gaap_Tax" xlink:label="l2"/><link:presentationArc preferredLabel="http://x/negatedLabel" xlink:to="l2"/><link:presentationArc preferredLabel="http://x/label" xlink:to="l1"/>"""


def test_linkbases(spark):
    xml = spark.createDataFrame([("s", LABELS)], "stem string, xml string")
    assert [tuple(r) for r in filings.linkbase_labels(xml).select("text_key", "prefix", "concept").collect()] == [("cash and equivalents", "us-gaap", "Cash")]
    assert [tuple(r) for r in filings.negated_concepts(xml).collect()] == [("s", "us-gaap", "Tax")]


def test_contract_round_trip(spark, tmp_path):
    (tmp_path / "S_10K_20250927_p0003_t1.csv").write_text('row_label,col_label,raw,value,scale\n"Cash, net",2025,"(1,234)",-1234000,1000\n')
    r = artifacts.contract_tables(spark, str(tmp_path)).first()
    assert (r["stem"], r["page"], r["table_no"], r["row_label"], r["value"]) == ("S_10K_20250927", 3, 1, "Cash, net", -1234000.0)


def test_extractor_errors_are_rows(spark):
    def extract(content, page):
        if page == 2:
            raise ValueError("broken")
        return [{"text": content.decode()}]

    files = spark.createDataFrame([("s", 1, b"a"), ("s", 2, b"b")], "stem string, page int, content binary")
    out = artifacts.extracted(files, extract, "text string, error string").orderBy("page").collect()
    assert [(r["text"], r["error"]) for r in out] == [("a", None), (None, "ValueError: broken")]


def test_managed_graph(spark):
    rows = [("d", "w1", "WORD", "Net", [], None, None), ("d", "w2", "WORD", "sales", [], None, None), ("d", "c1", "CELL", None, ["w1", "w2"], 1, 1), ("d", "c2", "CELL", None, [], 2, 2), ("d", "t", "TABLE", None, ["c1", "c2"], None, None)]
    blocks = spark.createDataFrame(rows, "doc string, id string, kind string, text string, children array<string>, row int, col int")
    assert artifacts.managed_grids(blocks).first()["rows"] == [["Net sales", None], [None, ""]]


def test_anchors(spark):
    df = spark.createDataFrame([("abcdef", [(0, 2), (4, 6)])], "t string, a array<struct<start:int,end:int>>")
    assert df.select(artifacts.anchored_text("t", "a")).first()[0] == "abef"


def test_records_are_written_by_stem(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, [0.0, 5.0, 1.0, 6.0], "b"), ("s", 1, [0.0, 1.0, 1.0, 2.0], "a")], "stem string, page int, bbox array<double>, text string")
    artifacts.write_records(df, str(tmp_path / "out"))
    back = artifacts.jsonl(spark, str(tmp_path / "out"), "page int, text string")
    assert [r["text"] for r in back.collect()] == ["a", "b"]


def test_pinned_inputs(spark):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("x",), ("y",)], "k string")
    filings.require_inputs(a, a, "k")
    with pytest.raises(ValueError, match="missing"):
        filings.require_inputs(a, b, "k")


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("a", "x", 1.0, 0), ("a", "x", 2.0, 60), ("b", "y", 3.0, 4000)], "k string, body string, v double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("w", events.windowed(stream, "ts", "k", "v"), "complete", 2), ("c", events.new_content(stream, "body", "ts"), "append", 2), ("s", events.sessions(stream, "ts", "k"), "complete", 2)):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
