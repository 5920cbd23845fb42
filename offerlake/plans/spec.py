"""What a search asks for, validated once."""

from __future__ import annotations

import datetime
import unicodedata
from dataclasses import dataclass

SORTS = ("newest", "price_asc", "price_desc", "rating_desc", "abv_desc", "name_asc")
STOCK = ("in_stock", "sold_out", "all")
LINK = ("linked", "missing", "all")


def pipe_list(text: str | None) -> tuple[str, ...]:
    """Split a list at |, normalise to NFC, trim, and drop blanks."""
    parts = (unicodedata.normalize("NFC", part).strip() for part in (text or "").split("|"))
    return tuple(part for part in parts if part)


@dataclass(frozen=True)
class SearchSpec:
    """Filters, sort and page of a search over offers or over groups of offers."""

    search: str = ""
    shops: tuple[str, ...] = ()
    styles: tuple[str, ...] = ()
    producers: tuple[str, ...] = ()
    min_abv: float | None = None
    max_abv: float | None = None
    min_ibu: float | None = None
    max_ibu: float | None = None
    min_rating: float | None = None
    stock: str = "in_stock"
    product_type: str | None = None
    link: str = "all"
    days: int | None = None
    as_of: datetime.datetime | None = None
    only_sale: bool = False
    sort: str = "newest"
    page: int = 1
    limit: int = 20

    def __post_init__(self) -> None:
        for value, known in ((self.sort, SORTS), (self.stock, STOCK), (self.link, LINK)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        if self.page < 1 or self.limit < 1:
            raise ValueError("page and limit start at 1")
        if self.days is not None and self.as_of is None:
            raise ValueError("days needs as_of")

    @classmethod
    def from_request(cls, params: dict[str, str], as_of: datetime.datetime) -> SearchSpec:
        """Read request parameters; what can't be read as a number counts as absent."""

        def number(name: str, kind=float):
            try:
                return kind(params[name])
            except (KeyError, ValueError):
                return None

        days = number("days", int)
        return cls(
            search=params.get("search", "").strip(),
            shops=pipe_list(params.get("shop")),
            styles=pipe_list(params.get("style_filter")),
            producers=pipe_list(params.get("brewery_filter")),
            min_abv=number("min_abv"),
            max_abv=number("max_abv"),
            min_ibu=number("min_ibu"),
            max_ibu=number("max_ibu"),
            min_rating=number("min_rating"),
            stock=params.get("stock_filter") or "in_stock",
            product_type=params.get("product_type") or None,
            link=params.get("link_status") or "all",
            days=days if days and days > 0 else None,
            as_of=as_of,
            only_sale=params.get("only_sale") == "true",
            sort=params.get("sort") or "newest",
            page=max(1, number("page", int) or 1),
            limit=max(1, number("limit", int) or 20),
        )

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit
