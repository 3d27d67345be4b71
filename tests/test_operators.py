from datetime import date

import pytest

from ledgerloom.operators import bench, facts, reconcile, records, scoring, sections, tables


@pytest.mark.parametrize(
    ("pdf", "fact", "tol", "status"),
    [
        (112010e6, 112010e6 + 400000, 500000.0, "match"), (-11778e6, 11778e6, 500000.0, "sign"), (112010.0, 112010e6, 500000.0, "scale_x1e6"), (112010e9, 112010e6, 500000.0, "scale_x1e-3"),
        (20342e6, 25417e6, 500000.0, "mismatch"), (float("nan"), 5.0, 0.5, "pdf_missing"), (None, 5.0, 0.5, "pdf_missing"), (5.0, None, 0.5, "xbrl_missing"), (0.0, 300.0, 0.5, "mismatch"),
    ],
)
def test_status(spark, pdf, fact, tol, status):
    df = spark.createDataFrame([(pdf, fact, tol)], "p double, x double, t double")
    assert df.select(reconcile.status("p", "x", "t")).first()[0] == status


def test_tolerance_and_precision(spark):
    df = spark.createDataFrame([("-6",), ("INF",), (None,), ("2",), ("x",)], "d string")
    assert [r[0] for r in df.select(reconcile.tolerance("d")).collect()] == [500000.0, 0.5, 0.5, 0.005, 0.5]
    assert [r[0] for r in df.select(facts.precision("d")).collect()] == [-6.0, float("inf"), float("-inf"), 2.0, float("-inf")]


FACTS = "stem string, prefix string, concept string, dims string, n_dims int, period_type string, start date, end date, period_label string, value double, decimals string, ord int"


def fact_rows(spark):
    day = date(2025, 9, 27)
    return spark.createDataFrame(
        [
            ("s", "g", "Cash", "", 0, "instant", None, day, "2025-09-27", 100.0, "0", 1), ("s", "g", "Cash", "", 0, "instant", None, date(2024, 9, 28), "2024-09-28", 80.0, "0", 2),
            ("s", "g", "Sales", "", 0, "duration", date(2024, 9, 29), day, "FY ended 2025-09-27", 500.0, "0", 3), ("s", "g", "Sales", "", 0, "duration", date(2024, 9, 29), day, "FY ended 2025-09-27", 501.0, "0", 4),
            ("s", "g", "Costs", "", 0, "duration", date(2024, 9, 29), day, "FY ended 2025-09-27", -300.0, "0", 5),
        ],
        FACTS,
    )


def test_resolution(spark):
    f = fact_rows(spark)
    index, bounds = facts.fact_index(f), facts.period_bounds(f)
    fy = "FY ended 2025-09-27"
    cells = spark.createDataFrame([(1, "s", fy, 501.0), (2, "s", fy, 300.0), (3, "s", fy, 80.0), (4, "s", fy, 100.0), (5, "s", fy, 7.0), (6, "s", fy, 7.0)], "cell_id int, stem string, period_label string, value double")
    cand = spark.createDataFrame(
        [(1, "manual", "g", "Sales", "", "", 0), (2, "label", "g", "Costs", "", "", 0), (3, "manual", "g", "Cash", "", "opening", 0), (4, "manual", "g", "Cash", "", "opening", 0), (5, "label", "g", "Sales", "", "", 0), (5, "label", "g", "Costs", "", "", 1)],
        "cell_id int, mapping string, prefix string, concept string, dims string, instant string, rank int",
    )
    out = {r["cell_id"]: r for r in reconcile.resolve(cells, cand, index, bounds).collect()}
    assert out[1]["status"] == "match" and out[1]["xbrl_value"] == 501.0  # the last fact of a key counts
    assert out[2]["status"] == "sign"
    assert out[3]["status"] == "match" and out[3]["xbrl_period"] == "2024-09-28"
    assert out[4]["status"] == "mismatch"  # the date is fixed before values are compared
    assert out[5]["mapping"] == "ambiguous" and out[5]["concept"] == "" and out[5]["status"] == "xbrl_missing"
    assert out[6]["mapping"] == "none"


def test_missing_cells_take_the_next_option(spark):
    f = fact_rows(spark)
    entries = spark.createDataFrame([("b", 1, "g", "Cash", None, None)], "statement string, entry_no int, prefix string, concept string, dims string, instant string")
    periods = spark.createDataFrame([("s", "b", "FY ended 2025-09-27")], "stem string, statement string, period_label string")
    seen = spark.createDataFrame([("s", "b", "Cash", "", "2025-09-27", "FY ended 2025-09-27")], "stem string, statement string, concept string, dims string, xbrl_period string, period_label string")
    found = reconcile.missing_cells(entries, periods, facts.fact_index(f), facts.period_bounds(f), seen).collect()
    assert [(r["xbrl_period"], r["xbrl_value"]) for r in found] == [("2024-09-28", 80.0)]


def test_layers(spark):
    cells = spark.createDataFrame([(1, "s", "i", "Net  sales"), (2, "s", "i", "Products: Other items"), (3, "s", "i", "Cash, beginning balances and more")], "cell_id int, stem string, statement string, label string")
    entries = spark.createDataFrame([(1, "i", "net sales", None, None, "Sales", None, None), (2, "i", "cash, beginning", "prefix", "x", "Cash", None, None)], "entry_no int, statement string, pdf string, match string, prefix string, concept string, dims string, instant string")
    curated = {r["cell_id"]: r for r in reconcile.curated_matches(cells, entries).collect()}
    assert curated[1]["prefix"] == "us-gaap" and curated[3]["instant"] == "opening" and 2 not in curated
    labels = spark.createDataFrame([("s", "other items", "g", "Other", 0), ("s", "net sales", "g", "Sales2", 1)], "stem string, text_key string, prefix string, concept string, ord int")
    base = reconcile.linkbase_matches(cells, labels)
    both = {r["cell_id"]: r["concept"] for r in reconcile.layered(reconcile.curated_matches(cells, entries), base).collect()}
    assert both == {1: "Sales", 2: "Other", 3: "Cash"}


def test_fuzzy_matches_brute_force(spark):
    import difflib

    choices = ["repayments of term debt", "proceeds from debt", "net income", "net incomes", "cash paid for interest", "x"]
    labels = ["repayment of term debt", "net incom", "nothing like it", "cash paid for taxes"]
    a = spark.createDataFrame([("s", x) for x in labels], "stem string, label_key string")
    b = spark.createDataFrame([("s", x) for x in choices], "stem string, text_key string")
    got = {r["label_key"]: (r["text_key"], r["ratio"]) for r in reconcile.fuzzy_best(a, b).collect()}
    for x in labels:
        best = max((difflib.SequenceMatcher(None, y, x).ratio(), y) for y in choices)
        assert got.get(x) == ((best[1], best[0]) if best[0] >= 0.85 else None)


def test_scores(spark):
    pairs = spark.createDataFrame([(1, ["100"] * 3, ["100"]), (2, ["100"], ["100"] * 2), (3, [], [])], "k int, r array<string>, h array<string>")
    out = {r["k"]: (r["precision"], round(r["recall"], 4), r["f1"]) for r in scoring.multiset_score(pairs, "r", "h", ["k"]).collect()}
    assert out == {1: (1.0, 0.3333, 0.5), 2: (0.5, 1.0, pytest.approx(2 / 3)), 3: (0.0, 0.0, 0.0)}


def test_error_rates(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sit on mat now"), ("a b", ""), ("", "x")], "r string, h string")
    out = df.withColumns(scoring.error_rates("r", "h")).collect()
    assert [r["wer"] for r in out] == [0.5, 1.0, None] and out[1]["cer"] == 1.0


def test_sections(spark):
    rows = [("d", 1, "Title", "Cover"), ("d", 2, "Text", "x"), ("d", 3, "Title", "Item 1. Business"), ("d", 4, "Title", "Other"), ("d", 5, "Text", "y")]
    df = spark.createDataFrame(rows, "doc string, pos int, block_type string, text string")
    assert [r["section"] for r in sections.carry_sections(df, ["doc"], ["pos"]).orderBy("pos").collect()] == ["Cover", "Cover", "Item 1", "Item 1", "Item 1"]


PAGE = """Apple Inc.
(In millions)
September 27, 2025 September 28, 2024
ASSETS:
Current assets:
Cash and equivalents $ 35,934 $ 29,943
Vendor receivables 33,180 32,833
Total current assets 69,114 62,776
Per share data (2) 7.46 6.11"""
GRID = [["", "September 27,", "2025"], ["Cash and equiv", "$", "35,934", "29,943"], ["Vendor", "33,180", "32,833"], ["Total current", "69,114", "62,776"], ["Per share", "7.46", "6.11"], ["Lost", "1", "2"], ["One", "5"]]


def test_grid_to_long(spark):
    df = spark.createDataFrame([("s", 3, GRID, PAGE)], "stem string, page int, grid array<array<string>>, page_text string")
    out = tables.to_long(df, ["stem", "page"]).orderBy("row_no", "col_no").collect()
    assert [r["row_label"] for r in out][::2] == ["Current assets: Cash and equivalents", "Current assets: Vendor receivables", "Current assets: Total current assets"]
    assert out[0]["col_label"] == "2025-09-27" and out[0]["value"] == 35934e6 and out[0]["scale"] == 1e6
    # skipped: the grid's own header row (one number), the per-share line (its "(2)" reads as a third value), a row that the page lacks, a short one
    assert {r["skipped"] for r in out} == {4}


def test_stacked_tables_keep_their_periods(spark):
    page = "Three Months Ended\nJune 28, 2025 June 29, 2024\nSales 10 20\nCosts: \nRent (5) 6\nTotal costs 5 6\nNet 1 2\nYears ended\nSeptember 27, 2025 September 28, 2024\nFirst half of a\nlong label 7 8\nLost paren (9 3\nNote (9)"
    grid = [["Sales", "10", "20"], ["Rent", "(5)", "6"], ["Total costs", "5", "6"], ["Net", "1", "2"], ["long label", "7", "8"], ["Lost", "(9", "3"], None or []]
    df = spark.createDataFrame([(1, grid, page, "x"), (2, [], page, "x"), (3, None, None, "x"), (4, [["a", "1", "2"]], None, "x")], "k int, grid array<array<string>>, page_text string, row_label string")
    out = tables.to_long(df, ["k"]).orderBy("row_no", "col_no").collect()
    assert {r["k"] for r in out} == {1} and [(r["row_label"], r["col_label"], r["value"]) for r in out][::2] == [
        ("Sales", "3M ended 2025-06-28", 10.0), ("Costs: Rent", "3M ended 2025-06-28", -5.0), ("Costs: Total costs", "3M ended 2025-06-28", 5.0), ("Net", "3M ended 2025-06-28", 1.0),
        ("First half of a long label", "FY ended 2025-09-27", 7.0), ("Lost paren", "FY ended 2025-09-27", -9.0),
    ]
    assert out[-2]["raw"] == "(9)"
    assert tables.to_long(df.limit(0), ["k"]).count() == 0


def test_repeated_values_need_label_evidence(spark):
    page = "Total assets 10 20\nTotal liabilities 10 20"
    grid = [["assets", "10", "20"], ["", "10", "20"]]
    df = spark.createDataFrame([(grid, page, 1)], "grid array<array<string>>, page_text string, k int")
    assert [r["row_label"] for r in tables.to_long(df, ["k"]).where("col_no = 0").orderBy("row_no").collect()] == ["Total assets", "Total liabilities"]
    df = spark.createDataFrame([([["", "10", "20"]], page, 1)], "grid array<array<string>>, page_text string, k int")
    assert tables.to_long(df, ["k"]).count() == 0


def test_rows_that_differ_in_their_first_number_only(spark):
    df = spark.createDataFrame([([["", "30", "20"]], "Total assets 10 20\nTotal liabilities 30 20", 1)], "grid array<array<string>>, page_text string, k int")
    assert [r["row_label"] for r in tables.to_long(df, ["k"]).where("col_no = 0").collect()] == ["Total liabilities"]


def test_column_units_from_words(spark):
    page = "Total Number Average Price\nof Shares Paid Per Share\nJuly 10 230.5\nAugust 20 240.5"
    word = lambda t, x, y: {"text": t, "x0": float(x), "x1": float(x + 6 * len(t)), "top": float(y), "bottom": float(y + 8)}
    words = [word("Number", 100, 0), word("Price", 200, 0), word("of", 100, 10), word("Shares", 115, 10), word("Per", 200, 10), word("Share", 220, 10), word("July", 0, 20), word("10", 110, 20), word("230.5", 205, 20), word("August", 0, 30), word("20", 110, 30), word("240.5", 205, 30)]
    df = spark.createDataFrame([(1, [["July", "10", "230.5"], ["August", "20", "240.5"]], f"(in thousands)\n{page}", words)], "k int, grid array<array<string>>, page_text string, words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>")
    out = tables.to_long(df, ["k"], words="words").orderBy("row_no", "col_no").collect()
    assert [r["scale"] for r in out] == [1e3, 1.0, 1e3, 1.0]


def test_candidate_scores(spark):
    good, poor = [["a", "1", "2"], ["b", "3", "4"], ["c", "5", "6"], ["", "2024", "2023"]], [["", "1", "2"]]
    df = spark.createDataFrame([(1, "camelot-stream", good), (1, "pdfplumber-text", poor), (2, "camelot-stream", [])], "page int, method string, grid array<array<string>>")
    out = {(r["page"], r["method"]): r for r in tables.candidate_scores(df, ["page"]).collect()}
    assert out[1, "camelot-stream"]["score"] == 1.0 and out[1, "camelot-stream"]["accepted"] and out[1, "camelot-stream"]["numeric_rows"] == 3
    assert out[1, "pdfplumber-text"]["score"] == 0.0 and not out[2, "camelot-stream"]["accepted"]


def test_grids_there_and_back(spark):
    cells = spark.createDataFrame([(1, "b", "y", "1", 1), (1, "a", "x", "2", 2), (1, "b", "x", "", 3), (1, "b", "y", "9", 4)], "t int, r string, c string, v string, o int")
    grid = tables.cells_to_grid(cells, ["t"], "r", "c", "v", "o")
    assert grid.select("columns", "rows").first() == (["", "y", "x"], [["b", "9", None], ["a", None, "2"]])
    assert tables.grid_to_cells(grid, ["t"]).count() == 4


def test_record_errors(spark):
    base = {"schema": "1.0", "doc_id": "0000320193-25-000079", "company": "A", "ticker": "A", "cik": "0000320193", "form": "10-K", "fiscal_year": 2025, "fiscal_period": "FY", "page": 1, "section": None, "block_id": "p0001_b001", "block_type": "Text", "bbox": [1.0, 1.0, 2.0, 2.0], "units": "pt", "origin": "top-left", "text": "t", "table": None, "extractor": "x", "extractor_version": "1", "ocr": False, "ocr_conf": None, "source_path": "a/b", "sha256": "0" * 64}
    bad = [{"schema": "2"}, {"doc_id": "x"}, {"cik": "1"}, {"page": 0}, {"block_id": "b1"}, {"block_type": "Other"}, {"bbox": [2.0, 1.0, 1.0, 2.0]}, {"units": "px"}, {"text": None}, {"ocr": True}, {"ocr_conf": 2.0}, {"source_path": "a\\b"}, {"sha256": "X"}, {"company": None}, {"block_type": "Table"}]
    df = spark.createDataFrame([base, *[base | b for b in bad]], records.SCHEMA)
    counts = [len(r["errors"]) for r in records.validated(df).collect()]
    assert counts == [0] + [1] * len(bad)


def test_page_outcomes_tell_missing_from_unmeasured(spark):
    want = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc string, page int")
    have = spark.createDataFrame([("a", 1)], "doc string, page int")
    assert {(r["doc"], r["page"]): r["outcome"] for r in scoring.page_outcomes(want, have, "doc", "page").collect()} == {("a", 1): "measured", ("a", 2): "missing", ("b", 1): "unmeasured"}


def test_bench(spark):
    rows = spark.createDataFrame([("t", 1.0, 5.0, "ok"), ("t", 2.0, 9.0, "empty"), ("t", 10.0, 1.0, "ok"), ("t", None, 1.0, "error: x")], "stage string, seconds double, rss_mb double, status string")
    r = bench.summary(rows).first()
    assert (r["pages"], r["p50"], r["p95"], r["errors"], r["empty"]) == (3, 2.0, pytest.approx(9.2), 1, 1)


def test_required_tables_fail_loudly(spark):
    have, want = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="missing tables: 2"):
        reconcile.require(have, want, ["k"], "tables")


def test_dedup_keeps_the_most_precise(spark):
    df = spark.createDataFrame([("a", 22.0, "-8", 1), ("a", 22.038, "-6", 2), ("a", 22.038, "-6", 3), ("b", 1.0, None, 4)], "k string, value double, decimals string, ord int")
    out = {r["k"]: (r["ord"], r["n_copies"], r["n_values"]) for r in facts.most_precise(df, ["k"]).collect()}
    assert out == {"a": (2, 3, 2), "b": (4, 1, 1)}
    assert facts.conflicts(df, ["k"]).first()[0] == 1


def test_html_blocks_are_all_found(spark):
    from ledgerloom.plans.catalog import QUERIES

    page = "<script>'<p>no</p>'</script><h1 class='a'>T</h1><!-- <p>no</p> --><ul><li><a href='/x'>one</a><ul><li>in</ul>more<li><p>two</p></ul><p><b>open<br>line<p id='q'>end</p>outside"
    assert [(t, " ".join(x.split())) for t, x in sections.tag_blocks(page)] == [("h1", "T"), ("li", "one more"), ("li", "in"), ("li", ""), ("p", "two"), ("p", "open line"), ("p", "end")]
    assert sections.tag_blocks(None) == []
    got = {r["block_type"]: r["count"] for r in QUERIES["html_blocks"](spark, "/root/testdata/sf0.01").groupBy("block_type").count().collect()}
    assert got == {"Title": 250, "List": 1413, "Text": 2358}


def test_cer_counts_the_whole_text(spark):
    from ledgerloom.plans.catalog import QUERIES

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    d = "/root/testdata/sf0.01"
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    some = [*sorted(texts, key=lambda i: len(texts[i]))[-3:], *[i for i, t in texts.items() if not t.isascii()][:3]]
    got = {r["item_id"]: r["cer"] for r in QUERIES["cer_pairs"](spark, d).collect()}
    for i in some:
        assert got[i] == pytest.approx(distance(texts[i], texts[i].replace("th", "t")) / len(texts[i]))


def test_queries_compare_all_rows(spark):
    from collections import Counter

    from ledgerloom.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_linestatus").collect()
    sides = [Counter(r["l_partkey"] for r in lines if r["l_linestatus"] == s) for s in "OF"]
    assert QUERIES["full_outer_paths"](spark, d).count() == sum(max(s[k] for s in sides) for k in {r["l_partkey"] for r in lines})
    assert sum(r["n"] for r in QUERIES["recon_sign_scale"](spark, d).collect()) == 6 * len(lines)
    orders = spark.read.parquet(f"{d}/orders.parquet").count()
    assert {r["cells"] for r in QUERIES["cell_correctness"](spark, d).collect()} == {orders}
