from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import boxes as B
from ledgerloom.functions import numbers as N
from ledgerloom.functions import periods as P
from ledgerloom.functions import text as T


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.mark.parametrize(
    ("raw", "scale", "value"),
    [("307,003", 1e6, 307003000000.0), ("(5,571)", 1e6, -5571000000.0), ("(14,264", 1e6, -14264000000.0), ("$ 7.46", 1, 7.46), ("1,234(1)", 1, 1234.0), ("—", 1e6, 0.0), ("Net income", 1, None), ("27,", 1, None), ("1,23", 1, None), ("", 1, None), (None, 1, None)],
)
def test_full_value(spark, raw, scale, value):
    assert column(spark, [raw], N.full_value("x", scale)) == [value]


def test_the_scorer_needs_both_parentheses(spark):
    assert column(spark, ["(5)", "(5", "-5", "5%", "$1,000", "x", ""], N.scorer_value("x")) == [-5.0, None, -5.0, 5.0, 1000.0, None, None]


def test_numeric_tokens_keep_signs(spark):
    assert column(spark, ["a (321) b $1,234.50 c 7% 321"], N.numeric_tokens("x")) == [["(321)", "$1,234.50", "7%", "321"]]


def test_cut_off_parenthesis_comes_back_only_if_printed(spark):
    assert column(spark, ["(14,264", "(14,265", "14"], N.closed_paren("x", F.lit("total ( 14,264) x"))) == ["(14,264)", "(14,265", "14"]


def test_data_lines(spark):
    assert column(spark, ["Net sales 1 2", "2025 2024", "Note (1)", "Cash 2024", "12 13"], N.is_data_line("x")) == [True, False, False, False, False]


def test_ocr_reasons(spark):
    assert column(spark, ["", "a (cid:1) (cid:2) and plenty more words than needed", "(cid:1) (cid:2) (cid:3) aaaaaaaaaaaaaaaaaaaaaa"], N.ocr_reasons("x")) == ["low_char_count", "", "high_junk_ratio"]


def test_header_units(spark):
    texts = ["Price Paid Per Share", "(in thousands)", "in millions", "Total Number of Shares Purchased", "Total"]
    assert column(spark, texts, N.header_unit("x", 1e3)) == [1.0, 1e3, 1e6, 1e3, None]


def test_conventions(spark):
    texts = ["A&amp;B® “x” — ﬁ ☒", None]
    assert column(spark, texts, T.fold_conventions("x")) == ['A&B "x" - fi [X]', None]
    assert column(spark, ["  A (1)   b "], T.scored_form("x")) == ["a (1) b"]


def test_labels(spark):
    assert column(spark, ["Net sales: Total net sales"], T.line_part("x")) == ["Total net sales"]
    assert column(spark, ["Item 7A. Risk", "item 1. X", "Items of", None], T.section_key("x")) == ["Item 7A", "item 1", None, None]
    assert column(spark, ["Apple Inc. | 2025 Form 10-K | 30", "Form 10-K | x"], T.is_running_footer("x")) == [True, False]
    assert column(spark, ["  a   b ", "  "], T.clean_text("x")) == ["a b", None]


@pytest.mark.parametrize(
    ("cells", "n", "expected"),
    [
        (["Years ended", "September 27, 2025", "September 28, 2024"], 2, ["FY ended 2025-09-27", "FY ended 2024-09-28"]),
        (["Three Months Ended", "Nine Months Ended", "June 27, 2026", "June 28, 2025", "June 27, 2026", "June 28, 2025"], 4, ["3M ended 2026-06-27", "3M ended 2025-06-28", "9M ended 2026-06-27", "9M ended 2025-06-28"]),
        (["September 27, 2025", "September 28, 2024"], 2, ["2025-09-27", "2024-09-28"]),
        ([], 2, ["col1", "col2"]),
    ],
)
def test_column_labels(spark, cells, n, expected):
    df = spark.createDataFrame([(cells,)], "x array<string>")
    assert df.select(P.column_labels("x", n)).first()[0] == expected


def test_periods(spark):
    df = spark.createDataFrame([(date(2024, 9, 29), date(2025, 9, 27)), (date(2025, 6, 29), date(2025, 9, 27)), (None, date(2025, 9, 27))], "s date, e date")
    out = df.withColumns(P.period_fields("s", "e")).select("period_label", P.period_options("period_label", "s", "e")).collect()
    assert [r[0] for r in out] == ["FY ended 2025-09-27", "3M ended 2025-09-27", "2025-09-27"]
    assert out[0][1] == ["FY ended 2025-09-27", "2025-09-27", "2024-09-28"] and out[2][1] == ["2025-09-27"]
    assert column(spark, ["Beginning balances", "ending balance", "cash"], P.instant_of_label("x")) == ["opening", "end", ""]


def test_boxes(spark):
    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 25.0, 25.0))], f"a {box}, b {box}")
    assert df.select(B.overlap("a", "b")).first()[0] == 0.25
    words = [{"text": t, "top": y, "x0": x} for t, y, x in (("b", 10.0, 5.0), ("a", 11.0, 1.0), ("c", 13.5, 2.0), ("d", 20.0, 0.0))]
    lines = spark.createDataFrame([(words,)], "w array<struct<text:string,top:double,x0:double>>").select(B.word_lines("w")).first()[0]
    assert [[w["text"] for w in line] for line in lines] == [["a", "b"], ["c"], ["d"]]


def test_suppression_is_greedy(spark):
    rows = [(0.9, 1, 0.0, 0.0, 10.0, 10.0), (0.8, 2, 1.0, 1.0, 11.0, 11.0), (0.7, 3, 9.0, 9.0, 19.0, 19.0)]
    df = spark.createDataFrame([(rows,)], "b array<struct<score:double,id:int,x0:double,top:double,x1:double,bottom:double>>")
    assert [x["id"] for x in df.select(B.suppress("b", 0.5)).first()[0]] == [1, 3]


def test_cell_tokens_lose_one_mark(spark):
    """The rule step by step: a mark goes if a number is left."""
    import itertools
    import re

    from ledgerloom.functions import numbers as N

    number, mark = re.compile(r"^\(?-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?\)?$"), re.compile(r"(\(\d\)|\*+|†|‡)$")
    cells = ["".join(x) for n in range(5) for x in itertools.product("1(-)*\n.", repeat=n)] + ["$ 1,234 (2)", "1,23*", "7†", "7‡†", "—", "—*", "12(5)", "(5)(1)", "1,234.5)**", "1\n*\n"]
    want = []
    for x in cells:
        token = x.replace("$", "").replace(" ", "")
        bare = mark.sub("", token)
        token = bare if bare and number.search(bare) else token
        want.append((token, token in N.DASHES or bool(number.search(token))))
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, x string").select("i", N.cell_token("x").alias("t"), N.is_number("x").alias("n")).orderBy("i").collect()
    assert [(r["t"], r["n"]) for r in rows] == want


def test_values_are_read_once(spark):
    """A lambda computes an expression wherever it stands: one read of a cell takes one replacement."""
    from ledgerloom.operators import contract

    df = spark.createDataFrame([(["(5)"],)], "x array<string>").select(F.transform("x", contract.amount).alias("v"))
    assert df.first()["v"] == [-5.0]
    plan = contract.text_lines(F.lit("a 1 2"))
    assert spark.range(1).select(plan)._jdf.queryExecution().analyzed().toString().count("‡") <= 16  # 108 when each use of a token read the cell anew
