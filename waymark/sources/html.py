"""Pages as trees: a tag-soup parser and the relational node table made from it.

A page's tree is a table of nodes in document order. A node's subtree is the
interval from its own number to ``end_id``, so ancestors and descendants are range
conditions within a page, and no operator needs more than one page at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from waymark.functions._udf import in_slices
from waymark.functions import words as W
from waymark.functions.plain import SPACE, collapse, trim

#: Elements without content, with raw content, and those that end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg noscript".split())
ENDED_BY = {
    "p": "p div section ul ol h1 h2 h3 h4 h5 h6".split(),
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "tr": ["tr"],
    "td": ["td", "th", "tr"],
    "th": ["td", "th", "tr"],
    "option": ["option"],
}

NODE = "node_id int, parent_id int, end_id int, depth int, kind string, tag string, attrs map<string,string>, text string"

_COMMENT, _DOCTYPE = re.compile(r"<!--.*?-->", re.S), re.compile(r"<!doctype[^>]*>", re.I)
_TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-z][a-z0-9-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>])*?)(?P<alone>/?)>", re.I)
_ATTR = re.compile(r"([a-z_:][-a-z0-9_:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_ENTITY = re.compile(r"&(#x?[0-9a-f]+|[a-z]+);", re.I | re.A)
_ZERO_WIDTH = re.compile("[\u200b-\u200f\ufeff]")
_BEFORE_SIGN, _AFTER_OPEN = re.compile(rf"{SPACE}+([,.;:!?)\]])"), re.compile(rf"([(\[]){SPACE}+")


def decode_entities(text: str) -> str:
    """Numbers and the few names that pages use; other names stay as written."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return W.ENTITIES.get(body.lower(), m[0])
        digits = body[1:]
        try:
            code = int(digits[1:], 16) if digits[0] in "xX" else int(digits)
        except ValueError:
            return m[0]
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def tidy(text: str) -> str:
    """Single spaces, none before a closing sign or after an opening one."""
    text = collapse(_ZERO_WIDTH.sub("", text))
    return trim(_AFTER_OPEN.sub(r"\1", _BEFORE_SIGN.sub(r"\1", text)))


def attributes(text: str) -> dict[str, str]:
    """Names in lower case; of a name that is repeated the last value."""
    found = ((name.lower(), value[1:-1] if value[:1] in ('"', "'") else value) for name, value in _ATTR.findall(text))
    return {name: decode_entities(value) for name, value in found}


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, text or name, attributes) in order; a raw element's content is no token, and without an
    end tag it is all that follows."""
    html = _DOCTYPE.sub("", _COMMENT.sub("", html))
    at = 0
    while at < len(html):
        tag = _TAG.search(html, at)
        between = html[at : tag.start() if tag else len(html)]
        if trim(between):
            yield "text", decode_entities(between), {}
        if tag is None:
            return
        at, name = tag.end(), tag["name"].lower()
        if tag["close"]:
            yield "close", name, {}
        elif name in VOID or name in RAW or tag["alone"]:
            yield "leaf", name, attributes(tag["attrs"])
            if name in RAW and not tag["alone"]:
                ended = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = ended.end() if ended else len(html)
        else:
            yield "open", name, attributes(tag["attrs"])


class Page:
    """A parsed page. Node 0 is the root; elements and texts are numbered in document order."""

    def __init__(self, html: str | None) -> None:
        self.tag: list[str | None] = ["#root"]
        self.attrs: list[dict[str, str]] = [{}]
        self.text: list[str | None] = [None]
        self.parent, self.depth = [-1], [0]
        open_ = [0]
        for kind, said, attrs in tokens(html or ""):
            if kind == "close":
                # The nearest open element of that name ends, with all within; a close tag without one is noise.
                nearest = max((k for k in range(1, len(open_)) if self.tag[open_[k]] == said), default=len(open_))
                del open_[nearest:]
                continue
            if kind != "text" and said in ENDED_BY.get(self.tag[open_[-1]], ()):
                open_.pop()
            self.parent.append(open_[-1])
            self.depth.append(self.depth[open_[-1]] + 1)
            self.tag.append(None if kind == "text" else said)
            self.text.append(said if kind == "text" else None)
            self.attrs.append(attrs)
            if kind == "open":
                open_.append(len(self.tag) - 1)
        # A subtree ends with the last node of its last child.
        self.end = list(range(len(self.tag)))
        for n in range(len(self.tag) - 1, 0, -1):
            self.end[self.parent[n]] = max(self.end[self.parent[n]], self.end[n])
        self.texts = [n for n, t in enumerate(self.tag) if t is None]
        self.anchors = [n for n, t in enumerate(self.tag) if t == "a"]
        self.linked = [n for n in self.anchors if self.attrs[n].get("href")]
        self._cleaned: dict[int, str] = {}

    # -- measures of subtrees ----------------------------------------------

    def elements(self, root: int = 0):
        """Elements below ``root``, in document order."""
        return (n for n in range(root + 1, self.end[root] + 1) if self.tag[n] is not None)

    def inside(self, numbers: list[int], root: int) -> list[int]:
        """Those of sorted node numbers that lie below ``root``."""
        return numbers[bisect_right(numbers, root) : bisect_right(numbers, self.end[root])]

    def clean(self, n: int = 0) -> str:
        if n not in self._cleaned:
            own = self.texts[bisect_left(self.texts, n) : bisect_right(self.texts, self.end[n])]
            self._cleaned[n] = tidy(" ".join(self.text[t] for t in own))
        return self._cleaned[n]

    def link_density(self, n: int) -> float:
        total = len(self.clean(n))
        return min(sum(len(self.clean(a)) for a in self.inside(self.anchors, n)) / total, 1.0) if total else 1.0

    def ancestors(self, n: int):
        n = self.parent[n]
        while n >= 0:
            yield n
            n = self.parent[n]

    def labels(self, n: int) -> str:
        a = self.attrs[n]
        return f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower()

    # -- what a page says about itself --------------------------------------

    def meta(self, *names: str) -> str | None:
        """The first non-empty content, by order of names and then of the page."""
        found: dict[str, str] = {}
        for n in self.elements():
            if self.tag[n] == "meta":
                a = self.attrs[n]
                key, content = a.get("name", a.get("property", "")).lower(), trim(a.get("content", ""))
                if content:
                    found.setdefault(key, collapse(content))
        return next((found[x] for x in names if x in found), None)

    def first(self, tag: str) -> str | None:
        return next((t for n in self.elements() if self.tag[n] == tag and (t := self.clean(n))), None)

    def rel(self, rel: str, kind: str | None = None) -> str | None:
        for n in self.elements():
            a = self.attrs[n]
            if self.tag[n] == "link" and rel in re.split(r"\s+", a.get("rel", "").lower()) and a.get("href"):
                if kind is None or a.get("type", "").lower() == kind:
                    return a["href"]
        return None


# -- the node table ------------------------------------------------------------


def _parsed(part: pa.RecordBatch) -> dict:
    """A row for each node of the pages, in document order."""
    rows = {name: [] for name in ("page", "node_id", "parent_id", "end_id", "depth", "kind", "tag", "attrs", "text")}
    for at, html in enumerate(part.column("html").to_pylist()):
        page = Page(html)
        n = len(page.tag) - 1
        rows["page"] += [at] * n
        rows["node_id"] += range(1, n + 1)
        rows["parent_id"] += page.parent[1:]
        rows["end_id"] += page.end[1:]
        rows["depth"] += page.depth[1:]
        rows["kind"] += ["text" if tag is None else "el" for tag in page.tag[1:]]
        rows["tag"] += page.tag[1:]
        rows["attrs"] += [list(a.items()) for a in page.attrs[1:]]
        rows["text"] += page.text[1:]
    at = pa.array(rows.pop("page"), pa.int64())
    return {"page_id": part.column("page_id").take(at), "url": part.column("url").take(at)} | rows


def nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url`` and the columns of NODE: a row per node."""
    rows = pages.select("page_id", "url", F.col(html).alias("html"))
    return in_slices(rows, "html", _parsed, StructType([*rows.schema.fields[:2], *StructType.fromDDL(NODE).fields]))


def _linked(part: pa.RecordBatch) -> dict:
    pages, numbers, found = [], [], []
    for at, html in enumerate(part.column("html").to_pylist()):
        own = [a["href"] for kind, name, a in tokens(html or "") if name == "a" and kind in ("open", "leaf") and a.get("href")]
        pages += [at] * len(own)
        numbers += range(len(own))
        found += own
    at = pa.array(pages, pa.int64())
    return {"page_id": part.column("page_id").take(at), "url": part.column("url").take(at), "n": numbers, "href": found}


def hrefs(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url, n, href``: ``anchors`` without the tree, for what needs links only."""
    rows = pages.select("page_id", "url", F.col(html).alias("html"))
    return in_slices(rows, "html", _linked, StructType([*rows.schema.fields[:2], *StructType.fromDDL("n int, href string").fields]))


def is_html(content_type: Column, body: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).rlike("(?i)html") | F.coalesce(body, F.lit("")).rlike(r"(?i)^\s*<(!doctype|html)")


def is_truncated(body: Column, limit: int = 2_000_000) -> Column:
    return F.length(body) > limit


_TIDY = [("[\u200b-\u200f\ufeff]", ""), (SPACE + "+", " "), (rf"{SPACE}+([,.;:!?)\]])", "$1"), (rf"([(\[]){SPACE}+", "$1")]


def tidy_text(x: Column) -> Column:
    for pattern, to in _TIDY:
        x = F.regexp_replace(x, pattern, to)
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def subtree_text(table: DataFrame, keep: Column) -> DataFrame:
    """``page_id, node_id, tag, clean_text, link_chars`` of the elements that ``keep`` selects.

    Ancestors and texts meet on the page and an interval, so a page's work stays its own.
    """
    picked = table.filter((F.col("kind") == "el") & keep).select("page_id", "node_id", "end_id", "tag")
    texts = table.filter("kind = 'text'").select(F.col("page_id").alias("p"), F.col("node_id").alias("t"), "text")
    below = picked.join(texts, (F.col("page_id") == F.col("p")) & (F.col("t") > F.col("node_id")) & (F.col("t") <= F.col("end_id")), "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "text"))), lambda s: s["text"]), " ")
    return below.groupBy("page_id", "node_id", "end_id", "tag").agg(tidy_text(joined).alias("clean_text"))


def link_density(table: DataFrame, keep: Column) -> DataFrame:
    """``page_id, node_id, tag, chars, link_chars, density``; nested links count twice and an empty element is all link."""
    blocks = subtree_text(table, keep)
    anchors = subtree_text(table, F.col("tag") == "a").select(F.col("page_id").alias("p"), F.col("node_id").alias("a"), F.length("clean_text").alias("n"))
    met = blocks.join(anchors, (F.col("page_id") == F.col("p")) & (F.col("a") > F.col("node_id")) & (F.col("a") <= F.col("end_id")), "left")
    out = met.groupBy("page_id", "node_id", "tag", F.length("clean_text").alias("chars")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("link_chars"))
    return out.withColumn("density", F.when(F.col("chars") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("link_chars") / F.col("chars"))))


def first_text(table: DataFrame, tag: str) -> DataFrame:
    """``page_id, text`` of the first element of that tag that has any."""
    rows = subtree_text(table, F.col("tag") == tag).filter("clean_text <> ''")
    return rows.groupBy("page_id").agg(F.min_by("clean_text", "node_id").alias("text"))


def meta_content(table: DataFrame, names: list[str]) -> DataFrame:
    """``page_id, content``: the order of names outranks that of the page."""
    key = F.lower(F.coalesce(F.col("attrs")["name"], F.col("attrs")["property"], F.lit("")))
    content = F.regexp_replace(F.regexp_replace(F.col("attrs")["content"], f"^{SPACE}+|{SPACE}+$", ""), SPACE + "+", " ")
    rank = F.array_position(F.array(*map(F.lit, names)), key)
    rows = table.filter((F.col("tag") == "meta") & (rank > 0) & (F.coalesce(content, F.lit("")) != ""))
    return rows.groupBy("page_id").agg(F.min_by(content, F.struct(rank, "node_id")).alias("content"))


def anchors(table: DataFrame) -> DataFrame:
    """``page_id, url, node_id, href``: every link with an address, raw and in document order."""
    href = F.col("attrs")["href"]
    return table.filter((F.col("tag") == "a") & (F.coalesce(href, F.lit("")) != "")).select("page_id", "url", "node_id", href.alias("href"))


def chrome(table: DataFrame) -> DataFrame:
    """``page_id, node_id, end_id`` of elements that are furniture; what lies inside is in chrome."""
    a = F.col("attrs")
    labels = F.lower(F.concat_ws(" ", F.coalesce(a["class"], F.lit("")), F.coalesce(a["id"], F.lit("")), F.coalesce(a["role"], F.lit(""))))
    named = F.col("tag").isin("nav", "header", "footer", "aside", "form") | F.coalesce(a["role"].isin("navigation", "banner"), F.lit(False))
    return table.filter((F.col("kind") == "el") & (named | labels.rlike(W.bounded(W.CHROME_WORDS)))).select("page_id", "node_id", "end_id")


def outside_chrome(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with page_id and node_id) that neither are furniture nor lie in any."""
    c = chrome(table).select(F.col("page_id").alias("c_page"), F.col("node_id").alias("c_node"), F.col("end_id").alias("c_end"))
    held = (F.col("page_id") == F.col("c_page")) & (F.col("node_id") >= F.col("c_node")) & (F.col("node_id") <= F.col("c_end"))
    return rows.join(c, held, "left_anti")
