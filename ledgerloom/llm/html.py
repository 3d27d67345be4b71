"""Operator 10, HTML extraction by consensus host paths.

1. Each page is read into blocks of text with the chain of block elements around them. Containers are scored by the unlinked text
   of their paragraphs (all of it for the parent, half for the grandparent), and the page votes for the path of its best container: tags
   with their classes, digits generalised.
2. Votes are added up by host and path in Spark, with map-side combine; a host's heaviest path wins.
3. Each page is read again and yields the text under the elements on its host's path. A page without that path uses its own best.

Elements that are never part of an article (menus, page headers and footers, sidebars, notices with dialogs, adverts, forms, comments, scripts)
are left out by tag, role or class word in both passes. A class word leaves out no element that holds the page's article, or, where
its name also says other things (`content has-sidebar`), most of the text; nor does a form that spans the page's article or most of its
paragraphs. Inside an article, names such as `share-price` or `related-work` leave out only what is mostly links.

Defined cases: a null or empty html, or one without text, gives an empty text; a null url is a host of its own; equal rows are extracted alike;
an empty table gives an empty result; markup may be cut off or unbalanced anywhere.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
BLOCK = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside address form fieldset details summary hr center".split()
)
#: Left out with all they hold.
NEVER = set("head title nav footer aside script style noscript template iframe svg canvas button select option textarea dialog menu audio video".split())
RAW = set("script style noscript template iframe textarea title svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("body main article section div td blockquote".split())
PARAGRAPHS = set("p pre h1 h2 h3 h4 h5 h6 li dd dt blockquote td".split())
NEVER_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NEVER_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar masthead skip".split()
)
#: Of these, words that also occur in the names of an article's own parts.
DOUBTFUL = {"share", "related", "recommended", "social", "menu", "skip"}
#: Outside an article only: a headline may stand in a header of its article.
HEADER_WORDS = {"header", "topbar"}
#: Say nothing of what an element holds.
PLAIN_WORDS = set("area section list box wrap wrapper container block inner outer item items thread post page site title text bar".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "label", "parent", "out", "body", "path", "score", "article", "worded", "mixed", "doubtful")

    def __init__(self, tag: str, label: str, parent: Element | None, out: bool, article: bool):
        self.tag, self.label, self.parent, self.out, self.article = tag, label, parent, out, article
        self.path = f"{parent.path}/{label}" if parent else label
        self.score = 0.0
        # has a class word of what is left out; has other words too; may be a part of the article all the same
        self.worded = self.mixed = self.doubtful = False

    def chain(self) -> Iterator[Element]:
        up: Element | None = self
        while up is not None:
            yield up
            up = up.parent

    @property
    def soft(self) -> bool:
        """Left out by its class word alone, or as a form."""
        return self.worded and self.tag not in ("html", "body", "article", "main")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _open(tag: str, attrs: str, parent: Element | None) -> Element:
    out = parent is not None and parent.out
    article = tag in ("article", "main") or parent is not None and parent.article
    label, worded, mixed, doubtful = tag, False, False, False
    if tag in NEVER or tag == "header" and not article:
        out = True
    if attrs.strip(" /"):
        a = _attributes(attrs)
        names = f"{a.get('class', '')} {a.get('id', '')}"
        found = {w.lower() for w in WORD.findall(names)}
        worded = bool(found & NEVER_WORDS or not article and found & HEADER_WORDS)
        mixed = bool(found - NEVER_WORDS - HEADER_WORDS - PLAIN_WORDS)
        if a.get("role", "").lower() in NEVER_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
            out = True
        if a.get("class"):
            label = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in a["class"].split())])
        doubtful = tag != "form" and mixed and bool(found & NEVER_WORDS) and found & NEVER_WORDS <= DOUBTFUL and not found & HEADER_WORDS
    element = Element(tag, label, parent, out, article)
    element.worded, element.mixed, element.doubtful = worded or tag == "form", mixed, doubtful
    return element


def _worth(element: Element, text: str, linked: int) -> float:
    return max(0, len(text) - 2 * linked) * (1.0 if element.tag in PARAGRAPHS else 0.5)


def _without_soft(found: list[tuple[Element, str, int]]) -> list[tuple[Element, str, int]]:
    """Blocks outside forms and elements that a class word leaves out, unless these hold the page's article or most of its text, or are parts
    of an article with a doubtful name and more plain than linked text."""
    if not any(x.soft for element, _, _ in found for x in element.chain()):
        return found
    plain: dict[Element, int] = {}
    for element, text, linked in found:
        for x in element.chain():
            if x.doubtful and x.article:
                plain[x] = plain.get(x, 0) + len(text) - 2 * linked
    for x, n in plain.items():
        x.worded = n <= 0
    left = [f for f in found if not any(x.soft for x in f[0].chain())]
    if not any(x.tag in ("article", "main") for element, _, _ in left for x in element.chain()):
        weight: dict[Element, float] = {}
        for f in found:
            for x in f[0].chain():
                weight[x] = weight.get(x, 0.0) + _worth(*f)
        articles = [x for x in weight if x.tag in ("article", "main") and not x.worded]
        if articles:
            largest = max(weight[x] for x in articles)
            best = [x for x in articles if weight[x] == largest]
            best = [x for x in best if not any(y in best for y in x.chain() if y is not x)][:1]
            back = set(best[0].chain())
        else:
            total = sum(_worth(*f) for f in found)
            prose: dict[Element, float] = {}
            for f in found:
                for x in f[0].chain():
                    if x.tag == "form" and f[0].tag in ("p", "pre", "blockquote"):
                        prose[x] = prose.get(x, 0.0) + _worth(*f)
            back = {x for x in weight if 2 * (prose.get(x, 0.0) if x.tag == "form" else weight[x] * x.mixed) > total}
        for x in back:
            x.worded = False
    return [f for f in found if not any(x.soft for x in f[0].chain())]


def blocks(source: str) -> list[tuple[Element, str, int]]:
    """(innermost block element, text, length of linked text) of each block outside what is left out, in page order."""
    found: list[tuple[Element, str, int]] = []
    here = Element("", "", None, False, False)
    text: list[str] = []
    linked, in_link, skip_to = 0, 0, 0
    inline_out: list[str] = []  # open inline elements that are left out

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined and not here.out:
                found.append((here, joined, linked))
            text.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() < skip_to:
            continue
        if m.start() > at and not inline_out:
            part = source[at : m.start()]
            text.append(part)
            if in_link:
                linked += len(part)
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK or tag in NEVER:
                up = here
                while up.parent is not None and up.tag != tag:
                    up = up.parent
                if up.parent is not None:
                    flush()
                    here, in_link = up.parent, 0
                    inline_out.clear()
            elif tag in inline_out:
                inline_out.remove(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(source, at)
            if tag not in ("noscript", "template", "svg", "iframe", "script", "style", "textarea", "title"):
                continue
            at = skip_to = end.end()
            continue
        if tag == "br":
            text.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK or tag in NEVER:
            flush()
            in_link = 0
            inline_out.clear()
            if tag in BLOCK and tag not in ("html", "body"):
                closing = CLOSES.get(tag, {"p"})
                up = here
                while up.parent is not None and (up.tag in PARAGRAPHS or up.tag in closing) and up.tag not in ("ul", "ol", "table", "blockquote"):
                    if up.tag in closing or up.tag == "p":
                        here = up.parent
                        break
                    up = up.parent
            if tag != "hr":
                here = _open(tag, m[3], here)
        else:
            if tag == "a":
                in_link += 1
            if m[3].strip(" /") and not m[3].rstrip().endswith("/") and ((inline := _open(tag, m[3], None)).out or inline.soft and (tag == "a" or not inline.doubtful)):
                inline_out.append(tag)
    if not inline_out and at < len(source):
        text.append(source[at:])
    flush()
    return _without_soft(found)


def best_container(found: list[tuple[Element, str, int]]) -> tuple[Element | None, float]:
    scored: dict[int, Element] = {}
    for element, text, linked in found:
        worth = _worth(element, text, linked)
        up, share = (element.parent if element.tag in PARAGRAPHS else element), 1.0
        while up is not None and up.parent is not None and share >= 0.5:
            if up.tag in CONTAINERS:
                if id(up) not in scored:
                    scored[id(up)] = up
                    up.score = 0.0
                up.score += worth * share * (1.25 if up.tag in ("article", "main") else 1.0)
                share /= 2
            up = up.parent
    best = max(scored.values(), key=lambda e: e.score, default=None)
    if best is None:
        return None, 0.0
    score = best.score
    # the headline or a lead may stand beside the container of the paragraphs: then their article is meant
    best = next((x for x in best.chain() if x.tag in ("article", "main")), best)
    above = [x for x in best.chain()][1:]
    for element, _, _ in found:
        if element.tag == "h1":
            if best in element.chain():
                break
            both = next((x for x in element.chain() if x in above), None)
            if both is not None and (both is element.parent or both.article) and both.tag in CONTAINERS - {"body"}:
                best = both
                break
    return best, score


def vote(source: str | None) -> tuple[str | None, float]:
    best, score = best_container(blocks(source or ""))
    return (best.path, 1 + math.log1p(score)) if best is not None else (None, 0.0)


def extract(source: str | None, path: str | None = None) -> str:
    found = blocks(source or "")
    best: Element | None = None
    for again in (False, True):
        if again:
            best, _ = best_container(found)
            path = best.path if best is not None else None
            if path is None:
                return "\n".join(t for _, t, _ in found)
        out = []
        for element, text, _ in found:
            up: Element | None = element
            while up is not None and up.path != path:
                up = up.parent
            if up is not None:
                out.append(text)
        if out:
            return "\n".join(out)
    return ""


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, path: the path that wins the votes of a host's pages; ties go to the first in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())], names=["host", "path", "weight"])

    votes = pages.select(host(url).alias("host"), F.col(source).alias("html")).mapInArrow(run, "host string, path string, weight double").where("path is not null")
    total = votes.groupBy("host", "path").agg(F.sum(F.round("weight", 6).cast("decimal(28,6)")).alias("weight"))
    return total.groupBy("host").agg(F.min_by("path", F.struct((-F.col("weight")).alias("w"), "path")).alias("path"))


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", source: str = "html") -> DataFrame:
    """keep columns, text and its n_chars of each page."""
    paths = host_paths(pages, url, source).select(F.col("host").alias("_host_"), "path")
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            texts = [extract(a.as_py(), b.as_py()) for a, b in zip(batch.column(n), batch.column(n + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    # a host may have a third of all pages: its pages are dealt to SALTS parts, and its one row of paths goes to each
    paths = paths.withColumn("_part_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select(*keep, F.col(source).alias("_html_"), host(url).alias("_key_"), F.pmod(F.xxhash64(source), F.lit(SALTS)).cast("int").alias("_salt_"))
    joined = rows.join(paths, (F.col("_key_") == F.col("_host_")) & (F.col("_salt_") == F.col("_part_")), "left")
    return joined.select(*keep, "_html_", "path").mapInArrow(run, schema)
