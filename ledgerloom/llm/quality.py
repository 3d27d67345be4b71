"""Operator 8, quality rules (DataFrame functions only).

Weak supervision: each rule votes good (1), bad (-1) or abstains (0), and rules overlap; expectation-maximisation over the counts of vote
patterns estimates, for good and for bad texts, how often each rule gives each answer, and the share of good texts; a document
is kept when its posterior probability of being good reaches one half. So one bad vote of a rule that often errs doesn't reject a
document, and one that no rule votes against is rejected if too many abstain that answer on nearly all good texts.

The patterns number at most 3 ** RULES at any input size, so the driver holds a bounded table. The posterior of rules that are independent
given the truth is a logistic sum, so it goes back into the plan as literal weights: no join, no UDF.

Defined cases: a null text has no words and fails the base test; an empty table gives an empty result; repeated rows are judged
one by one; extra columns are passed through by `keep`, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import SPACES, body, words
from ledgerloom.session import cut, fresh

REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct", "n_bare", "n_ends")


#: A word without a letter, and an end of a sentence.
BARE_RE = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
END_RE = r"[.!?](?![^\x20\x09-\x0D])"
#: Answers of a rule, in the order of the model's tables.
ANSWERS = (-1, 0, 1)
#: What a rule is taken to answer on bad and on good texts before any text is seen, worth PRIOR_TEXTS texts of each kind.
PRIOR = ((0.5, 0.2, 0.3), (0.1, 0.2, 0.7))
PRIOR_TEXTS = 20.0


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with its measures; the dict gives the name of each, chosen so that it clashes with no column of docs."""
    names = dict(zip(FEATURES, fresh(docs, *FEATURES), strict=True))
    tmp = dict(zip("body words lines windows sorted flagged".split(), fresh(docs.select("*", *[F.lit(0).alias(v) for v in names.values()]), "_body", "_words", "_lines", "_windows", "_sorted", "_flagged"), strict=True))
    k = REPEAT_WINDOW
    df = docs.withColumn(tmp["body"], body(text))
    df = df.withColumns({tmp["words"]: words(F.col(tmp["body"])), tmp["lines"]: F.filter(F.split(tmp["body"], "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    hashes = F.transform(tmp["words"], lambda w: F.xxhash64(w))
    df = df.withColumn(tmp["sorted"], hashes)
    at = lambda i, j: F.get(F.col(tmp["sorted"]), i + j)
    df = df.withColumn(
        tmp["windows"],
        F.when(
            F.size(tmp["sorted"]) >= k,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(tmp["sorted"]) - k, F.lit(0))), lambda i: F.xxhash64(*[at(i, j) for j in range(k)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Most texts repeat no window; only the others are sorted.
    df = df.withColumn(
        tmp["sorted"],
        F.when(
            F.size(F.array_distinct(tmp["windows"])) < F.size(tmp["windows"]),
            F.sort_array(F.transform(tmp["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    near = lambda j: F.get(F.col(tmp["sorted"]), j)["h"]
    df = df.withColumn(
        tmp["flagged"],
        F.sort_array(F.transform(F.filter(tmp["sorted"], lambda x, j: F.coalesce(near(j - 1) == x["h"], F.lit(False)) | F.coalesce(near(j + 1) == x["h"], F.lit(False))), lambda x: x["i"])),
    )
    covered = F.aggregate(
        F.transform(tmp["flagged"], lambda p, j: F.least(F.lit(k), F.coalesce(F.get(F.col(tmp["flagged"]), j + 1), p + k) - p)), F.lit(0), lambda a, x: a + x
    )
    text_col = F.col(tmp["body"])
    return df.withColumns(
        {
            names["n_words"]: F.size(tmp["words"]).cast("long"),
            names["word_chars"]: F.char_length(F.array_join(tmp["words"], "")).cast("long"),
            names["n_symbols"]: F.regexp_count(text_col, F.lit("[#*$%&|<>]")).cast("long"),
            names["n_dup_lines"]: (F.size(tmp["lines"]) - F.size(F.array_distinct(tmp["lines"]))).cast("long"),
            names["n_repeat_words"]: covered.cast("long"),
            names["n_lines"]: F.size(tmp["lines"]).cast("long"),
            names["n_letters"]: (F.char_length(text_col) - F.char_length(F.regexp_replace(text_col, r"\p{L}+", ""))).cast("long"),
            names["n_distinct"]: F.size(F.array_distinct(tmp["words"])).cast("long"),
            names["n_bare"]: F.regexp_count(text_col, F.lit(BARE_RE)).cast("long"),
            names["n_ends"]: F.regexp_count(text_col, F.lit(END_RE)).cast("long"),
        }
    ).drop(*tmp.values()), names


def base_failed(n: dict[str, str]) -> Column:
    return (F.col(n["n_words"]) < MIN_WORDS) | (100 * F.col(n["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(n["n_words"]))


def votes(n: dict[str, str]) -> list[Column]:
    """One column of 1, -1 or 0 per rule. All are ratios of counts, compared in whole numbers; between its two bounds a rule abstains."""
    c = {k: F.col(v) for k, v in n.items()}

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        rule(10 * c["n_symbols"] > c["n_words"], c["n_symbols"] == 0),
        rule(100 * c["n_symbols"] > 3 * c["word_chars"], 200 * c["n_symbols"] < c["word_chars"]),
        rule(10 * c["n_letters"] < 7 * c["word_chars"], 10 * c["n_letters"] >= 8 * c["word_chars"]),
        rule(5 * c["n_bare"] > c["n_words"], 20 * c["n_bare"] <= c["n_words"]),
        rule((c["word_chars"] < 3 * c["n_words"]) | (2 * c["word_chars"] > 15 * c["n_words"]), (2 * c["word_chars"] >= 7 * c["n_words"]) & (2 * c["word_chars"] <= 13 * c["n_words"])),
        rule((100 * c["n_ends"] < c["n_words"]) | (10 * c["n_ends"] > 4 * c["n_words"]), (50 * c["n_ends"] >= c["n_words"]) & (10 * c["n_ends"] <= 3 * c["n_words"])),
        rule(10 * c["n_dup_lines"] > 3 * c["n_lines"], c["n_dup_lines"] == 0),
        rule(10 * c["n_repeat_words"] > c["n_words"], 50 * c["n_repeat_words"] <= c["n_words"]),
        rule(10 * c["n_distinct"] < 3 * c["n_words"], 2 * c["n_distinct"] >= c["n_words"]),
        rule(c["n_words"] < 2 * MIN_WORDS, c["n_words"] >= 5 * MIN_WORDS),
    ]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, ...]]]:
    """From counts of vote patterns to (bias, weights): log odds of good = bias + for each rule the weight of its answer (in the order of
    ANSWERS).

    Rules are taken as independent given the truth. A rule has a rate for each answer on good and on bad texts, and the share of good texts is
    fitted too; PRIOR, worth a few texts, says which kind is called good and keeps all rates above 0. It starts from the balance of votes.
    No patterns: no weights, everything is kept."""
    if not patterns:
        return 0.0, []
    p, n = np.array([x for x, _ in patterns]), np.array([k for _, k in patterns], float)
    answers = np.stack([p == a for a in ANSWERS], 2)  # pattern, rule, answer
    good = 1 / (1 + np.exp(-p.sum(1)))
    for _ in range(rounds):
        kinds = np.stack([(1 - good) * n, good * n])
        share = (kinds.sum(1) + PRIOR_TEXTS) / (n.sum() + 2 * PRIOR_TEXTS)
        rates = np.einsum("kp,pja->kja", kinds, answers) + PRIOR_TEXTS * np.array(PRIOR)[:, None, :]
        rates /= rates.sum(2, keepdims=True)
        weights, bias = np.log(rates[1] / rates[0]), float(np.log(share[1] / share[0]))
        last, good = good, 1 / (1 + np.exp(-np.clip(bias + (answers * weights).sum((1, 2)), -700, 700)))
        if np.abs(good - last).max() < 1e-9:
            break
    return bias, [tuple(map(float, w)) for w in weights]


def fit(measured: DataFrame, names: dict[str, str]) -> tuple[float, list[tuple[float, ...]]]:
    cols = votes(names)
    rows = measured.groupBy(*[v.alias(f"v{j}") for j, v in enumerate(cols)]).count().collect()  # at most 3 ** len(cols) rows
    return expectation_maximisation(sorted((tuple(r[:-1]), r[-1]) for r in rows))


def posterior(names: dict[str, str], model: tuple[float, list[tuple[float, ...]]]) -> Column:
    bias, weights = model
    odds = F.lit(bias)
    for vote, (bad, none, good) in zip(votes(names), weights, strict=False):
        odds = odds + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, measures, base_failed, posterior and kept of each row."""
    df, names = with_features(docs.select(F.col(id_col), F.col(text)), text)
    measured = cut(df.drop(text), "quality")
    model = fit(measured, names)
    p = posterior(names, model)
    return measured.select(
        id_col, *names.values(), base_failed(names).alias("base_failed"), p.alias("posterior"), (~base_failed(names) & (p >= 0.5)).alias("kept")
    )


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Texts are measured once to fit and once to filter, which costs less than
    to write them all, or to join their measures to them."""
    df, names = with_features(docs, text)
    model = fit(df, names)
    (once,) = fresh(df, "_once")
    # a filter isn't pushed below a column that isn't deterministic, where it would measure the text anew for each use of a measure
    df = df.withColumn(once, F.spark_partition_id())
    return df.where((F.col(once) >= 0) & ~base_failed(names) & (posterior(names, model) >= 0.5)).select(*[F.col(f"`{c}`") for c in docs.columns])
