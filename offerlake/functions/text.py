"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these exact words and their order.
ABBREVIATIONS = {
    "ddh": "double dry hopped",
    "tdh": "triple dry hopped",
    "sdh": "single dry hopped",
    "ba": "barrel aged",
    "bba": "bourbon barrel aged",
    "lr": "limited release",
}
STYLE_SUFFIXES = [
    "Sake IPA", "Sake Ale", "Rice Ale", "Sake", "IPA", "Hazy IPA", "Double IPA", "DIPA", "Triple IPA", "TIPA", "NEIPA",
    "NE IPA", "NE-IPA", "WCIPA", "WC IPA", "West Coast IPA", "Session IPA", "DDH IPA", "TDH IPA", "Pale Ale", "Stout",
    "Imperial Stout", "Lager", "Pilsner", "Sour", "Gose", "Porter", "Ale", "Wheat", "Saison", "Barleywine", "Lambic",
    "Gueuze", "Fruit Beer",
]
PRODUCER_SUFFIXES = [
    "Beer Company", "Brewing Co.", "Brewing Company", "Brewery Co.", "Beer Co", "Brewing", "Brewery", "Beer", "Co.",
    "Company", "Corporation", "Corp.", "Brewhouse", "Brewpub", "Craft Beer", "pivovar", "pivovar a.s.", "pivovarský dům",
    "cervecería", "cerveza", "cervezas", "brauerei", "bräu", "brauhaus", "brasserie", "birrificio", "醸造所", "ブルワリー",
    "ビール",
]
VARIANTS = [
    "fresh hop", "fresh hopped", "barrel aged", "bourbon barrel aged", "rum barrel aged", "whiskey barrel aged",
    "wine barrel aged", "oak aged", "nitro", "cask", "double dry hopped", "triple dry hopped", "single dry hopped",
    "coffee", "vanilla", "coconut", "chocolate", "hazelnut", "mango", "guava", "passion fruit", "raspberry", "blueberry",
    "strawberry", "peach", "pineapple", "cherry", "lactose", "milkshake", "with brett", "brett", "reserve", "small batch",
    "collaboration", "on the rocks",
]
SALE = r"([0-9.]+%\s*OFF|SALE|セール|特価|割引|アウトレット|お試し|訳あり|賞味期限|在庫整理|処分|決算)"
SALE_TAG = r"([0-9.]+%\s*OFF|SALE!*|セール|最終特価|特価|アウトレット|訳あり|決算セール|在庫整理|お試しセット)"
EXPIRY = r"((?:賞味)?期限[^】\)]+)"
COLLABORATION = r"\s+(?:x|X|with)\s+|\s*[×&/+]\s*|\s*w/\s*"


# What a name is cleaned of, in this order.
CLEANING = [
    (r"[〜~].*$", ""),
    (r"シリーズ.*$", ""),
    (r"(?i)\b(?:TDH|DDH|SDH)\s+", ""),
    (r"(?i)\b(?:Triple|Double|Single)\s+Dry\s+Hopped\s+", ""),
    (r"\s*[(\[（]\s*(?:20)?\d{2}(?:[./-]\d{1,2})?\s*[)\]）]\s*", " "),
    (r"\s+(?:20)?\d{2}[./-]\d{1,2}$", ""),
    (r"#\d+", ""),
    (r"(?i)Vol\.?\s*\d+", ""),
    (r"(?i)Batch\s*\d+", ""),
    (r"(?i)\s*[（(][^）)]*(?:can|bottle|keg|缶|瓶|生樽)[^）)]*[）)]", ""),
    (r"（[^）]*版[^）]*）", ""),
    (r":.*$", ""),
    (r"(?i)\s*\([^)]*(?:IPA|Lager|Stout|Ale|Saison|Porter|Pilsner|Pale|Hazy|DDH|TDH|DIPA|TIPA|Imperial|Session)[^)]*\)", ""),
    (r"\s*\([^)]*w/[^)]*\)", ""),
    (r"(?i)\s+(?:Imperial|Russian Imperial|American Imperial)\s+(?:Stout|IPA|Porter|Lager|Pale Ale)\b", ""),
    (r"(?i)\s+(?:West Coast|East Coast|New England|Hazy|Session|Double|Triple)\s+(?:IPA|Pale Ale|Lager)\b", ""),
    (r"(?i)\s+(?:Sour|Fruited|Barrel-Aged|Oak-Aged)\s+(?:Ale|Beer|Stout|IPA)\b", ""),
    (
        r"(?i)\s+(?:Sake IPA|Sake Ale|Rice Ale|Sake|Hazy IPA|Double IPA|Triple IPA|West Coast IPA|Session IPA|NEIPA|IPA|DIPA|TIPA"
        r"|Stout|Porter|Lager|Pilsner|Saison|Ale)$",
        "",
    ),
    (r"-[^-]+編-?$", ""),
    (r"－[^－]+編－?$", ""),
    (r"\s+\d+[xX]\s*", " "),
    (r"(?i)\bDR\.\s*", "Dr "),
    (r"(?i)\bMR\.\s*", "Mr "),
    (r"(?i)\bST\.\s*", "St "),
    (r"\([^)]+\)", ""),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value made once for each row, also where a lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cleaned(name: Column) -> Column:
    """The name without series, dates, containers, treatments, notes and styles: `CLEANING`, rule by rule."""
    return collapse_spaces(reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), CLEANING, name))


def _literal(word: str) -> str:
    """A word as a pattern."""
    return "".join(f"\\{c}" if c in ".-()+" else c for c in word)


def price_digits(text: Column) -> Column:
    """The digits of a price as a number; null without any."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def number(text: Column) -> Column:
    """Digits and points as a number; null where they make none."""
    return F.nullif(F.regexp_replace(text, "[^0-9.]", ""), F.lit("")).try_cast("double")


def tax_included_price(text: Column) -> Column:
    """The number after the tax-included mark, else the first number."""
    marked = F.regexp_substr(text, F.lit(r"税込\s*[¥￥]?\s*[0-9][0-9,]*"))
    return price_digits(F.coalesce(marked, F.regexp_substr(text, F.lit(r"[0-9][0-9,]*"))))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def key(text: Column) -> Column:
    """Comparison key: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def expand_abbreviations(text: Column) -> Column:
    """The name with its abbreviations written out; a name that none of them matches is as it was, after one look."""
    numbered = F.regexp_replace(text, r"(?iU)\bLR\s*([0-9]+)\b", "Limited Release $1")
    whole = reduce(lambda t, a: F.regexp_replace(t, rf"(?iU)\b{a}\b", ABBREVIATIONS[a]), ABBREVIATIONS, numbered)
    return F.when(text.rlike(rf"(?iU)\b(?:LR\s*[0-9]+|{'|'.join(ABBREVIATIONS)})\b"), whole).otherwise(text)


def strip_style(text: Column) -> Column:
    """The name without the longest style it ends with; null if it ends with none."""
    longest = sorted(STYLE_SUFFIXES, key=len, reverse=True)
    pattern = f"(?i) (?:{'|'.join(map(_literal, longest))})$"
    return F.when(text.rlike(pattern), F.trim(F.regexp_replace(text, pattern, "")))


def strip_producer(text: Column) -> Column:
    """The name without the longest company suffix it ends with."""
    longest = sorted(PRODUCER_SUFFIXES, key=len, reverse=True)
    return F.trim(F.regexp_replace(text, f"(?iu) (?:{'|'.join(map(_literal, longest))})$", ""))


def variants(text: Column) -> Column:
    """Keys of the variant phrases that a name holds."""
    phrases = F.array(*(F.lit(v.replace(" ", "")) for v in VARIANTS))
    return let(key(expand_abbreviations(text)), lambda own: F.array_sort(F.filter(phrases, lambda p: F.contains(own, p))))


def without_year(text: Column) -> Column:
    return collapse_spaces(F.regexp_replace(text, r"\b20\d{2}\b", ""))


def collaborators(text: Column) -> Column:
    return F.filter(F.split(text, COLLABORATION), lambda p: F.trim(p) != "")


def is_sale(name: Column) -> Column:
    return name.rlike(f"(?i){SALE}") | name.rlike("【[^】]*特価[^】]*】")


def sale_tag(name: Column) -> Column:
    return F.regexp_substr(name, F.lit(SALE_TAG))


def expiry_notice(name: Column) -> Column:
    return F.regexp_substr(name, F.lit(EXPIRY))


def display_name(name: Column) -> Column:
    """The title without a leading sale mark; itself where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, rf"(?i)^【?{SALE}】?\s*", ""), F.lit("")), name)


def has_japanese(text: Column) -> Column:
    return text.rlike(r"[぀-ヿ一-鿿]")


def is_out(status: Column) -> Column:
    """Whether a free status text says that nothing is left."""
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.contains(low, F.lit("sold")) | F.contains(low, F.lit("out"))


#: Words that a name isn't searched by. Fixed values.
UNSEARCHED = (
    "ipa", "dipa", "tipa", "neipa", "ale", "stout", "lager", "pilsner", "sour", "porter", "saison", "gose", "hazy", "double",
    "triple", "single", "imperial", "session", "fruited", "wild", "beer", "cider", "mead", "330ml", "350ml", "500ml", "750ml",
)
#: Tokens that are tried for a name.
TRIED = 6


def search_tokens(name: Column) -> Column:
    """Up to `TRIED` parts of a name to search by: its numbers, a written-out release, its words from the last one on.

    Words of one character, Latin words of two and `UNSEARCHED` ones are left out; a number within a word comes before it.
    """
    numbers = F.regexp_extract_all(name, F.lit(r"(?i)\b(?:LR|No\.?|Batch|#|Vol\.?)?\s*([0-9]{1,4})\b"), 1)
    release = F.regexp_extract(name, r"(?i)\bLR\s*([0-9]+)\b", 1)
    released = F.when(release != "", F.array(F.concat(F.lit("Limited Release "), release))).otherwise(F.array().cast("array<string>"))
    fit = lambda w: w.rlike(r"^(?:[0-9]{2,}|\p{ASCII}{3,}|(?=.*\P{ASCII}).{2,})$") & ~F.lower(w).isin(*UNSEARCHED) & (w != name)
    words = F.reverse(F.filter(F.split(name, r"[\s/—–\-()（）\[\]]+"), fit))
    inner = F.transform(words, lambda w: F.array(F.nullif(F.regexp_extract(w, "[0-9]+", 0), F.lit("")), w))
    return F.slice(F.array_distinct(F.array_compact(F.concat(numbers, released, F.flatten(inner)))), 1, TRIED)
