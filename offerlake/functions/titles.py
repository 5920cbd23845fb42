"""Shop titles as column expressions: what they hold besides a name, and how to take it out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.text import collapse_spaces

# Results depend on these exact words and patterns.
BRACKETS = ("【】", "《》", "≪≫", "[]", "<>", "＜＞", "()", "（）")
INGEST_NOISE = (
    "入荷", "予約", "予定", "出荷", "空輸", "クール", "SALE", "売切", "新着", "ご注文", "本以上", "合計", "セット", "限定", "条件", "注意",
    "必須", "おひとり様", "同時購入", "推し", "対象", "配送", "発送", "即納", "ポイント", "送料無料",
)
PROMPT_NOISE = (
    "予定", "出荷", "入荷", "ご注文", "本以上", "合計", "セット", "限定", "条件", "注意", "必須", "おひとり様", "同時購入", "推し", "対象", "配送",
    "発送", "即納", "ポイント", "送料無料", "クール便", "予約", "空輸", "冷蔵", "常温",
)
MARKS = ("≪入荷予定≫", "《入荷予定》", "≪予約≫", "《予約》", "売切", "SOLD OUT", "SALE!!", "SALE!")
SET_PACK = (
    r"\d+本(?:パック|セット|アソート|飲み比べ)|\d+\s*Cans?\s*(?:Set|Pack)|\d+\s*Bottles?\s*(?:Set|Pack)|飲み比べ|アソート|お試しセット|"
    r"本セット|缶セット|Variety\s*Pack"
)
PURCHASE_TERMS = (
    r"[456789\d]+本(?:以上)?(?:の)?(?:ご注文|購入|注文)|ご注文は|\b以上\b|最大|まで|制限|必須|送料|お一人様|1アカウント|合算"
)
NOT_DRINKS = (
    "書籍", "単行本", "新書", "文庫", "著者", "出版", "雑誌", "ZINE", "ガイドライン", "テイスティングノート", "解体新書", "Tシャツ", "トートバッグ",
    "グラス", "ステッカー", "コースター", "キーホルダー", "服飾", "冊子", "論考集", "業界俯瞰図", "二日酔い", "防ぎ方", "治し方", "教本", "カタログ",
)
FLAGS = (
    ("japan", "🇯🇵"), ("united states|usa|america", "🇺🇸"), ("canada", "🇨🇦"),
    ("united kingdom|uk|england|scotland|wales", "🇬🇧"), ("australia", "🇦🇺"), ("new zealand", "🇳🇿"), ("germany", "🇩🇪"),
    ("belgium", "🇧🇪"), ("france", "🇫🇷"), ("italy", "🇮🇹"), ("spain", "🇪🇸"), ("netherlands", "🇳🇱"), ("denmark", "🇩🇰"),
    ("norway", "🇳🇴"), ("sweden", "🇸🇪"), ("poland", "🇵🇱"), ("czech", "🇨🇿"), ("ireland", "🇮🇪"), ("china", "🇨🇳"),
    ("hong kong", "🇭🇰"), ("taiwan", "🇹🇼"), ("korea", "🇰🇷"), ("mexico", "🇲🇽"), ("brazil", "🇧🇷"), ("estonia", "🇪🇪"),
    ("latvia", "🇱🇻"), ("lithuania", "🇱🇹"),
)
NO_FLAG = "🏳️"

#: How a shop writes its titles: a pattern of two groups, and which of them is the maker.
TITLE_FORMS = {
    "name_slash_maker": (r"【([^/]+)/([^】]+)】", 2),
    "maker_slash_name": (r"\[([^/]+)/([^\]]+)\]", 1),
    "pipe_maker_colon_name": (r"^[^|]*\|([^:|]*):([^|]*)", 1),
}


def _any(words: tuple[str, ...]) -> str:
    return "|".join(words)


def without_noise(title: Column, words: tuple[str, ...] = INGEST_NOISE, brackets: tuple[str, ...] = BRACKETS) -> Column:
    """The title without brackets of any kind that hold one of the words."""
    noise = _any(words)

    def cut(text: Column, pair: str) -> Column:
        start, end = pair
        return F.regexp_replace(text, rf"(?iu)\{start}[^\{end}]*?(?:{noise})[^\{end}]*?\{end}", "")

    return reduce(cut, brackets, title)


def ingest_title(title: Column) -> Column:
    """A title as it is stored: no tags, notices, stock marks or prices."""
    plain = without_noise(F.trim(F.regexp_replace(title, "<[^>]+>", "")))
    marked = F.regexp_replace(plain, rf"(?iu){_any(MARKS)}", "")
    return collapse_spaces(F.regexp_replace(marked, "[0-9,]+円.*", ""))


def without_marks(title: Column) -> Column:
    """A part of a title without notices and stock marks."""
    return collapse_spaces(F.regexp_replace(without_noise(title), rf"(?iu){_any(MARKS)}", ""))


def prompt_title(title: Column) -> Column:
    """A title as an extractor gets it: no notices, shipping marks, discounts or best-before dates."""
    plain = without_noise(title, PROMPT_NOISE, BRACKETS[:6])
    shipped = F.regexp_replace(plain, r"[(（](?:空輸|冷蔵|常温|クール便|空輸便)[)）]", "")
    priced = F.regexp_replace(shipped, r"(?iU)\b\d+%\s*OFF\b", "")
    return F.trim(F.regexp_replace(priced, r"[(（【]?賞味期限[/：:][^)）】]+[)）】]?", ""))


def is_set_pack(title: Column, terms_too: bool = False) -> Column:
    """Whether a title names a pack of several; with `terms_too` purchase terms don't hide it."""
    pack = title.rlike(f"(?iu){SET_PACK}")
    return pack if terms_too else pack & ~title.rlike(f"(?iu){PURCHASE_TERMS}")


def product_type(title: Column, kind: Column, is_set: Column, *names: Column) -> Column:
    """The type after the title's say: packs are sets, and what has a maker or a name is no `other`.

    Titles of what can't be drunk keep the type they have.
    """
    named = reduce(lambda a, b: a | b, (F.coalesce(~F.lower(n).isin("", "none"), F.lit(False)) for n in names), F.lit(False))
    kind = F.coalesce(kind, F.lit("beer"))
    return (
        F.when(title.rlike(f"(?iu){SET_PACK}"), "set")
        .when(title.rlike(f"(?iu){_any(NOT_DRINKS)}"), kind)
        .when((kind == "other") & named, F.when(F.coalesce(is_set, F.lit(False)), "set").otherwise("beer"))
        .otherwise(kind)
    )


def split_title(title: Column, form: Column) -> tuple[Column, Column]:
    """Maker and name out of a title of a form (a key of TITLE_FORMS); nulls where it doesn't fit."""
    maker, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, (pattern, at) in TITLE_FORMS.items():
        fits = (form == key) & title.rlike(pattern)
        maker = F.when(fits, F.trim(F.regexp_extract(title, pattern, at))).otherwise(maker)
        name = F.when(fits, F.trim(F.regexp_extract(title, pattern, 3 - at))).otherwise(name)
    return F.nullif(maker, F.lit("")), F.nullif(name, F.lit(""))


def bracketed_title(title: Column) -> tuple[Column, Column]:
    """Maker and name of a title that begins with the maker in square brackets."""
    pattern = r"^\[(.*?)\]\s*(.*)$"
    maker = F.when(title.rlike(pattern), F.nullif(F.trim(F.regexp_extract(title, pattern, 1)), F.lit("")))
    rest = F.when(maker.isNotNull(), F.trim(F.split_part(F.regexp_extract(title, pattern, 2), F.lit("/"), F.lit(1))))
    return maker, F.nullif(rest, F.lit(""))


#: Words of goods that are no drinks, those of them that come along with one, and what shows a drink after all. Fixed values.
GOODS, GOODS_ALONG, DRINKS = ("グラス", "glass", "ステッカー", "tシャツ"), "コラボグラス", ("ビール", "セット")


def is_merchandise(title: Column) -> Column:
    """Whether a title names goods only: glasses that were made with somebody, without a beer or a set."""
    low = F.lower(title)
    return low.rlike("|".join(GOODS)) & F.contains(low, F.lit(GOODS_ALONG)) & ~low.rlike("|".join(DRINKS))


def flag(location: Column) -> Column:
    """The flag of the first country whose name the location holds."""
    low = F.lower(location)
    return reduce(lambda found, rule: F.when(low.rlike(rule[0]), rule[1]).otherwise(found), reversed(FLAGS), F.lit(NO_FLAG))


def first_named(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def yen(price: Column) -> Column:
    """A raw price as whole yen; itself where it has other signs, `Unknown` where there is none."""
    whole = F.trim(F.replace(F.split_part(price, F.lit("."), F.lit(1)), F.lit(","), F.lit("")))
    return F.when(F.coalesce(price, F.lit("")) == "", "Unknown").when(whole.rlike("^[0-9]+$"), F.concat(whole, F.lit("円"))).otherwise(price)


def absolute(href: Column, base: str) -> Column:
    """An address relative to a shop's front page as a whole one."""
    rooted = F.concat(F.lit(base.rstrip("/")), F.when(href.startswith("/"), F.lit("")).otherwise("/"), href)
    return F.when(href.rlike("^https?://"), href).otherwise(rooted)


def canonical_url(url: Column) -> Column:
    """One address for each page: a product id alone of the query, no paging after a detail page, no subpages."""
    product = F.nullif(F.regexp_extract(url, r"[?&](product_id=[^&#]*)", 1), F.lit(""))
    kept = F.when(product.isNotNull(), F.concat(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("?"), product)).otherwise(url)
    detail = F.regexp_replace(kept, "(/shopdetail/[^/]+)(?:/.*)?$", "$1")
    return F.regexp_replace(detail, "/(?:beer|photos|activity)/?$", "")


def percent_encoded(text: Column) -> Column:
    """A text for a query: spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
