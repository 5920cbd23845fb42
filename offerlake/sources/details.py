"""Facts of one product or producer out of its detail page.

Pages lie in a table. A page becomes a small element tree, a rule names each field's place
by selectors, and a Python UDTF gives one typed struct for each page, so detail pages join
their table laterally like any other relation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a next one of the kinds named closes, up to the block they stand in.
_CLOSES = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


@dataclass
class Element:
    """A node of the tree: its tag, attributes, and children, which are elements or texts."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def descendants(self) -> Iterator[Element]:
        """Elements below this one in document order; no recursion, so depth doesn't matter."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Element)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [c for c in reversed(node.children) if isinstance(c, Element)]

    def text(self) -> str:
        """All texts below, each trimmed, one behind the other."""
        parts: list[str] = []
        waiting: list[Element | str] = [self]
        while waiting:
            node = waiting.pop()
            if isinstance(node, str):
                parts.append(node.strip())
            else:
                waiting += reversed(node.children)
        return "".join(parts)

    def select(self, selector: str) -> Iterator[Element]:
        """Elements below that a selector fits: steps `tag.class[attr=value]`, a space for any depth."""
        steps = _steps(selector)
        return (e for e in self.descendants() if steps[-1].fits(e) and e._under(self, steps[:-1]))

    def first(self, selector: str) -> Element | None:
        return next(self.select(selector), None)

    def _under(self, top: Element, steps: tuple[Step, ...]) -> bool:
        """Whether ancestors fit the steps, from the last to the first; the nearest that fits is as good as any other."""
        above, left = self.parent, list(steps)
        while left and above is not None:
            if left[-1].fits(above):
                left.pop()
            above = above.parent
        return not left


@dataclass(frozen=True)
class Step:
    tag: str
    classes: frozenset[str]
    attrs: tuple[tuple[str, str | None], ...]

    def fits(self, e: Element) -> bool:
        if self.tag not in ("", "*", e.tag) or not self.classes <= set(e.attrs.get("class", "").split()):
            return False
        return all(name in e.attrs and value in (None, e.attrs[name]) for name, value in self.attrs)


@lru_cache(maxsize=1024)
def _steps(selector: str) -> tuple[Step, ...]:
    found = []
    for part in re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", selector):
        shape = re.fullmatch(r"([\w*-]*)((?:\.[\w-]+)*)((?:\[[^\]]*\])*)", part)
        if not shape or not part:
            raise ValueError(f"not a selector: {selector!r}")
        pairs = (p.partition("=") for p in re.findall(r"\[([^\]]*)\]", shape[3]))
        attrs = tuple((n.strip(), v.strip(" '\"") if eq else None) for n, eq, v in pairs)
        found.append(Step(shape[1].lower(), frozenset(shape[2].split(".")) - {""}, attrs))
    if not found:
        raise ValueError("an empty selector")
    return tuple(found)


class _Builder(HTMLParser):
    """Builds the tree; ends of elements that aren't open are dropped, what is open at the end is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.here = Element("")
        self._open: Counter[str] = Counter()

    def _leave(self):
        self._open[self.here.tag] -= 1
        self.here = self.here.parent

    def handle_starttag(self, tag, attrs):
        while tag in _CLOSES.get(self.here.tag, ()):
            self._leave()
        node = Element(tag, {}, self.here)
        for name, value in attrs:
            node.attrs.setdefault(name, value or "")
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node
            self._open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self._open[tag]:
            while self.here.tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data):
        if self.here.tag not in ("script", "style"):
            self.here.children.append(data)


def tree(page: str | None) -> Element:
    """The element tree of a page; a null page has nothing in it."""
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.top


@dataclass(frozen=True)
class Rule:
    """Where a field stands: the first place that holds something counts.

    A place is a selector, or a selector, `@` and an attribute. `strip` are endings and
    `trim` characters that are taken off the text.
    """

    places: tuple[str, ...]
    strip: tuple[str, ...] = ()
    trim: str = ""

    def read(self, top: Element) -> str | None:
        for place in self.places:
            selector, _, attribute = place.partition("@")
            node = top.first(selector)
            if node is None or (attribute and not node.attrs.get(attribute)):
                continue
            said = node.attrs[attribute] if attribute else node.text()
            for ending in self.strip:
                said = said.replace(ending, "")
            return said.strip(self.trim) if self.trim else said
        return None


#: Places of a product's facts on its page, and of a producer's. Fixed values of the pages' layout.
PRODUCT_RULES = {
    "product_name": Rule((".name h1",)),
    "producer_name": Rule((".name .brewery a", ".name .brewery")),
    "producer_url": Rule((".name .brewery a@href",)),
    "style": Rule((".name .style",)),
    "label": Rule((".label img@src", "meta[property=og:image]@content")),
    "abv": Rule((".details .abv",), (" ABV",)),
    "ibu": Rule((".details .ibu",), (" IBU",)),
    "rating": Rule((".details .num",), (), "()"),
    "rating_count": Rule((".details .raters",), (" Ratings", " Rating"), "()"),
}
#: Places of an offer's full name and price on its own page, and the patterns that cut them. Fixed values.
OFFER_RULES = {"name": Rule(("h2.productTitle", "h2.title")), "price": Rule(("p.sale_price",))}
AFTER_NAME, TAXED, ANY_PRICE = "¥[0-9,]+.*$", "税込:\\s*[¥￥]?\\s*([0-9,]+)", "([0-9,]+)"
PRODUCER_LOGOS = Rule((".label img@src", ".basic img@src", ".logo img@src"))
PRODUCER_COUNTS = {"total": "total_products", "unique": "unique_users", "monthly": "monthly_checkins", "ratings": "rating_count"}

PRODUCT_PAGE = ", ".join(f"{name} string" for name in PRODUCT_RULES)
PRODUCER_PAGE = "producer_name string, location string, producer_type string, logo string, website string, " + ", ".join(
    f"{name} string" for name in PRODUCER_COUNTS.values()
)


def producer_facts(top: Element) -> dict[str, str | None]:
    """A producer's facts: beside the name stand its place and, after that, its kind, in paragraphs of no fixed class."""
    facts: dict[str, str | None] = {}
    name = top.first("h1")
    if name is not None:
        facts["producer_name"] = name.text()
        said = [t for t in (p.text() for p in name.parent.select("p")) if "Subsidiary of" not in t]
        at = next((i for i, t in enumerate(said) if any(c.isalpha() for c in t)), None)
        if at is not None:
            facts["location"] = said[at]
            facts["producer_type"] = next((t for t in said[at + 1 :] if t and t != said[at]), None)
    image = top.first("meta[property=og:image]")
    shared = image.attrs.get("content", "") if image is not None else ""
    facts["logo"] = shared if "brewery_logos" in shared else PRODUCER_LOGOS.read(top)
    for a in top.select(".social a"):
        if "website" in a.text().lower() or any("globe" in v for e in (a, *a.descendants()) for v in e.attrs.values()):
            facts["website"] = a.attrs.get("href")
    box = top.first(".stats")
    for item in box.select(".item") if box is not None else ():
        title, count = item.first(".title"), item.first(".count")
        if title is not None and count is not None:
            said = title.text().lower()
            kind = next((column for word, column in PRODUCER_COUNTS.items() if word in said), None)
            if kind:
                facts[kind] = count.text().replace(",", "")
    return facts


@F.udtf(returnType=", ".join(f"{name} string" for name in OFFER_RULES))
class OfferPage:
    """One row for each page of an offer: its full name and its price, as they stand there."""

    def eval(self, page: str):
        top = tree(page)
        yield tuple(rule.read(top) for rule in OFFER_RULES.values())


@F.udtf(returnType=PRODUCT_PAGE)
class ProductPage:
    """One row for each page: the text of every field of `PRODUCT_RULES`, null where the page has none."""

    def eval(self, page: str):
        top = tree(page)
        yield tuple(rule.read(top) for rule in PRODUCT_RULES.values())


@F.udtf(returnType=PRODUCER_PAGE)
class ProducerPage:
    """One row for each page of a producer."""

    def eval(self, page: str):
        facts = producer_facts(tree(page))
        yield tuple(facts.get(column.split()[0]) for column in PRODUCER_PAGE.split(", "))


def _pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    spark.udtf.register("offer_page", OfferPage)
    spark.udtf.register("product_page", ProductPage)
    spark.udtf.register("producer_page", ProducerPage)
    return pages


def offers(pages: DataFrame, url_col: str = "url", page_col: str = "html") -> DataFrame:
    """An offer's full name and price for each page: `url_col`, `name` without a price behind it, `price` in yen.

    The price is the one with tax, else the first number. What a page lacks is null.
    """
    pages = _pages(pages.sparkSession, pages)
    rows = pages.sparkSession.sql(f"SELECT p.{url_col}, d.* FROM {{pages}} p, LATERAL offer_page(p.{page_col}) d", pages=pages)
    digits = lambda form: F.nullif(F.regexp_replace(F.regexp_extract("price", form, 1), ",", ""), F.lit(""))
    price = F.concat(F.coalesce(digits(TAXED), digits(ANY_PRICE)), F.lit("円"))
    name = F.nullif(F.trim(F.regexp_replace("name", AFTER_NAME, "")), F.lit(""))
    return rows.select(url_col, name.alias("name"), price.alias("price"))


def products(pages: DataFrame, base_url: str, url_col: str = "url", page_col: str = "html") -> DataFrame:
    """A product's facts for each page: `url_col`, the fields of `PRODUCT_RULES`, and `abv_value`, `ibu_value`, `rating_value`, `rating_count_value`.

    Numbers that can't be read are null, as is every field that a null, empty or broken page
    lacks; `producer_url` is made absolute.
    """
    pages = _pages(pages.sparkSession, pages)
    rows = pages.sparkSession.sql(f"SELECT p.{url_col}, d.* FROM {{pages}} p, LATERAL product_page(p.{page_col}) d", pages=pages)
    number = lambda c: F.regexp_replace(F.col(c), "[^0-9.]", "").try_cast("double")
    home = F.when(F.startswith("producer_url", F.lit("/")), F.concat(F.lit(base_url), "producer_url")).otherwise(F.col("producer_url"))
    return rows.withColumn("producer_url", home).withColumns(
        {"abv_value": number("abv"), "ibu_value": number("ibu"), "rating_value": number("rating"), "rating_count_value": number("rating_count").cast("long")}
    )


def producers(pages: DataFrame, url_col: str = "url", page_col: str = "html") -> DataFrame:
    """A producer's facts for each page: `url_col`, name, place, kind, logo, website and its counts, as text and as `total_products_value` and the like."""
    pages = _pages(pages.sparkSession, pages)
    rows = pages.sparkSession.sql(f"SELECT p.{url_col}, d.* FROM {{pages}} p, LATERAL producer_page(p.{page_col}) d", pages=pages)
    return rows.withColumns({f"{c}_value": F.col(c).try_cast("long") for c in PRODUCER_COUNTS.values()})
