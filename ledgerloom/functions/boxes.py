"""Boxes (x0, top, x1, bottom in points from the top left), as column expressions over structs of these four."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import c


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["bottom"] - b["top"])


def shared(a: str | Column, b: str | Column) -> Column:
    """Shared area."""
    a, b, zero = c(a), c(b), F.lit(0.0)
    width = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(zero, F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    return width * height


def overlap(a: str | Column, b: str | Column) -> Column:
    """Shared area over the smaller area."""
    smaller = F.least(area(c(a)), area(c(b)))
    return F.when(smaller > 0, shared(a, b) / smaller).otherwise(F.lit(0.0))


def suppress(boxes: str | Column, most: float) -> Column:
    """Greedy: by falling score (then id), a box stays if it overlaps each that stayed by less than `most`. boxes: array of structs with
    score, id and the four sides. It depends on order, so it is a fold over a page's boxes."""
    ordered = F.sort_array(F.transform(c(boxes), lambda b: F.struct((-b["score"]).alias("order"), b["id"].alias("tie"), b.alias("box"))))
    plain = F.transform(ordered, lambda x: x["box"])
    return F.aggregate(plain, F.slice(plain, 1, 0), lambda kept, b: F.when(F.forall(kept, lambda k: overlap(k, b) < most), F.array_append(kept, b)).otherwise(kept))


def to_points(b: str | Column, scale: float | Column, width: Column, height: Column) -> Column:
    """Pixels to points, clipped to the page, two decimals."""
    b = c(b)
    clip = lambda x, most: F.round(F.greatest(F.lit(0.0), F.least(x * scale, most)), 2)
    return F.struct(clip(b["x0"], width).alias("x0"), clip(b["top"], height).alias("top"), clip(b["x1"], width).alias("x1"), clip(b["bottom"], height).alias("bottom"))


def from_fractions(left: Column, top: Column, w: Column, h: Column, page_width: Column, page_height: Column) -> Column:
    return F.struct((left * page_width).alias("x0"), (top * page_height).alias("top"), ((left + w) * page_width).alias("x1"), ((top + h) * page_height).alias("bottom"))


def flip(b: str | Column, page_height: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Column:
    """Between bottom-left and top-left origin, with the crop's offset. Fields of b: x0, top, x1, bottom, measured from below."""
    b = c(b)
    return F.struct((b["x0"] + dx).alias("x0"), (page_height - b["top"] + dy).alias("top"), (b["x1"] + dx).alias("x1"), (page_height - b["bottom"] + dy).alias("bottom"))


def centre_inside(b: str | Column, outer: str | Column, pad: float = 0.0) -> Column:
    b, o = c(b), c(outer)
    x, y = (b["x0"] + b["x1"]) / 2, (b["top"] + b["bottom"]) / 2
    return (x >= o["x0"] - pad) & (x <= o["x1"] + pad) & (y >= o["top"]) & (y <= o["bottom"])


def distance_to_span(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - x, F.lit(0.0), x - high)


def union(boxes: str | Column) -> Column:
    b = c(boxes)
    side = lambda f, name: f(F.transform(b, lambda x: x[name])).alias(name)
    return F.struct(side(F.array_min, "x0"), side(F.array_min, "top"), side(F.array_max, "x1"), side(F.array_max, "bottom"))


def word_lines(words: str | Column, tolerance: float = 3.0) -> Column:
    """Words (structs with top, x0, ...) to lines. A line's height is that of its first word, so this folds; lag would chain."""
    ordered = F.array_sort(c(words), lambda a, b: F.when((a["top"] < b["top"]) | ((a["top"] == b["top"]) & (a["x0"] < b["x0"])), -1).when((a["top"] == b["top"]) & (a["x0"] == b["x0"]), 0).otherwise(1))
    start = F.slice(F.array(ordered), 1, 0)

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        joins = (F.size(lines) > 0) & (F.abs(w["top"] - F.get(F.get(lines, F.size(lines) - 1), F.lit(0))["top"]) <= tolerance)
        return F.when(joins, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.array_append(last, w)))).otherwise(F.array_append(lines, F.array(w)))

    left_first = lambda line: F.array_sort(line, lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] == b["x0"], 0).otherwise(1))
    return F.transform(F.aggregate(ordered, start, lambda lines, w: F.when(F.size(lines) == 0, F.array(F.array(w))).otherwise(step(lines, w))), left_first)


def table_box(n_tables: Column, detected: Column, number: Column, page_box: Column) -> Column:
    """Box of a page's number-th table and how exact it is: paired with the detections if they are as many, else their union, else the page."""
    paired = F.size(detected) == n_tables
    return (
        F.when(paired, F.struct(F.get(detected, number - 1).alias("box"), F.lit("detected").alias("precision")))
        .when(F.size(detected) > 0, F.struct(union(detected).alias("box"), F.lit("union").alias("precision")))
        .otherwise(F.struct(page_box.alias("box"), F.lit("page").alias("precision")))
    )
