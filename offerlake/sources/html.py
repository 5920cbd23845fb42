"""Offers and links out of HTML pages that lie in a table."""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from offerlake.functions import titles

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Encodings that a page's bytes are tried in.
ENCODINGS = ("utf-8", "euc-jp", "shift_jis", "cp932")


class _Page(HTMLParser):
    """Collects the title, the links with their texts, and the text of blocks with a class."""

    def __init__(self, classes: frozenset[str] = frozenset(), box: str | None = None):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.blocks, self.boxes = "", [], [], []
        self._box, self._within = box, 0
        self._classes, self._open = classes, []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in ("script", "style"):
            self._skip += 1
        own = (found.get("class") or "").split()
        name = next((c for c in own if c in self._classes), None)
        opens = self._box is not None and self._box in own and tag not in _VOID
        if opens:
            self.boxes.append({})
            self._within += 1
        if tag == "a" and self._within and found.get("href"):
            self.boxes[-1].setdefault("href", found["href"])
        if tag not in _VOID:
            self._open.append((tag, name, found.get("href"), [], opens))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        if tag not in (o[0] for o in self._open):
            return
        while self._open:
            own, name, href, parts, boxed = self._open.pop()
            said = " ".join("".join(parts).split())
            if name and self._within:
                self.boxes[-1].setdefault(name, said)
            self._within -= boxed
            if own == "title" and not self.title:
                self.title = said
            if own == "a" and href is not None:
                self.links.append((href, said))
            if name:
                self.blocks.append((name, said))
            if own == tag:
                break

    def handle_data(self, data):
        if not self._skip:
            for entry in self._open:
                entry[3].append(data)


def parse(page: str | None, classes: frozenset[str] = frozenset(), box: str | None = None) -> _Page:
    parser = _Page(classes, box)
    parser.feed(page or "")
    parser.close()
    return parser


def page_facts(pages: DataFrame) -> DataFrame:
    """The title and number of links of each page (`page_id`, `html`)."""

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse(p) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "title": [p.title for p in parsed], "n_links": [len(p.links) for p in parsed]})

    return pages.select("page_id", "html").mapInPandas(facts, "page_id long, title string, n_links long")


def page_blocks(pages: DataFrame, classes: list[str]) -> DataFrame:
    """The texts of elements with one of the classes: `page_id`, `pos`, `class`, `text`."""
    wanted = frozenset(classes)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, pos, name, said)
                for page, source in zip(batch["page_id"], batch["html"], strict=True)
                for pos, (name, said) in enumerate(parse(source, wanted).blocks)
            ]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "class", "text"])

    return pages.select("page_id", "html").mapInPandas(blocks, "page_id long, pos int, class string, text string")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decoded(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """Bytes as text in the first encoding that fits, else in the first with replacements."""
    for name in encodings:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode(encodings[0], errors="replace")


@F.pandas_udf(StringType())
def decode(data: pd.Series) -> pd.Series:
    """Bytes as text in the first of `ENCODINGS` that fits, else UTF-8 with replacements."""
    return data.map(decoded, na_action="ignore")


def without_tags(column):
    return F.regexp_replace(column, "<[^>]+>", "")


def visible_text(column):
    """A page's text without tags, scripts and styles, spaces collapsed."""
    shown = F.regexp_replace(column, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(shown, "(?s)<[^>]+>", " "), r"(?U)\s+", " "))


@dataclass(frozen=True)
class OfferMarks:
    """Classes of the elements of a list page: the box of one offer, and its name, price and stock."""

    box: str
    name: str
    price: str
    stock: str = ""


def list_offers(pages: DataFrame, marks: OfferMarks, base_url: str, shop: str) -> DataFrame:
    """Offers of list pages: `page_id`, `pos`, `url`, `name`, `price`, `stock_status`, `shop`.

    An offer is what lies in a box: its first link, and the first text of each class.
    Boxes without a link are left out; `pos` keeps the order on the page.
    """
    wanted = frozenset({marks.name, marks.price, marks.stock} - {""})
    schema = "page_id long, pos int, href string, name string, price string, stock string"

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, source in zip(batch["page_id"], batch["html"], strict=True):
                for pos, box in enumerate(parse(source, wanted, marks.box).boxes):
                    if box.get("href"):
                        rows.append((page, pos, box["href"], *(box.get(c) for c in (marks.name, marks.price, marks.stock))))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href", "name", "price", "stock"])

    offers = pages.select("page_id", "html").mapInPandas(found, schema)
    said = F.upper(F.concat_ws(" ", "stock", "name"))
    return offers.select(
        "page_id",
        "pos",
        titles.canonical_url(titles.absolute(F.col("href"), base_url)).alias("url"),
        titles.ingest_title(F.col("name")).alias("name"),
        "price",
        F.when(said.rlike("SOLD OUT|売り切れ|完売|(^|[^0-9])0個"), "Sold Out").otherwise("In Stock").alias("stock_status"),
        F.lit(shop).alias("shop"),
    )
