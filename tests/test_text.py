"""Text and matching functions give the fixed expected values."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import display, matching, text, titles
from offerlake.queries import SCORE_TABLE


def values(spark, expression, *rows):
    names = [f"c{i}" for i in range(len(rows[0]))]
    data = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in data.orderBy("i").select(expression(*map(F.col, names))).collect()]


def test_styles_and_abbreviations(spark):
    assert values(spark, text.strip_style, ("Amazing IPA",), ("Regular Beer",), ("Dark Imperial Stout",)) == ["Amazing", None, "Dark"]
    got = values(spark, text.expand_abbreviations, ("DDH Caligula",), ("TDH IPA",), ("What Rough Beast",), ("LR39",), (None,))
    assert got == ["double dry hopped Caligula", "triple dry hopped IPA", "What Rough Beast", "Limited Release 39", None]
    assert values(spark, text.strip_producer, ("Stone Brewing Co.",), ("Stone",)) == ["Stone", "Stone"]


def test_variants(spark):
    got = values(spark, text.variants, ("Fresh Hop What Rough Beast",), ("Bourbon Barrel Aged Imperial Stout",), ("What Rough Beast",), ("Nitro Milk Stout",))
    assert "freshhop" in got[0] and {"bourbonbarrelaged", "barrelaged"} <= set(got[1]) and got[2] == [] and "nitro" in got[3]


@pytest.mark.parametrize(
    ("one", "two", "differ"),
    [
        ("Fresh Hop What Rough Beast (2019)", "What Rough Beast", True),
        ("What Rough Beast", "What Rough Beast", False),
        ("Fresh Hop What Rough Beast (2019)", "Fresh Hop What Rough Beast", False),
        ("Barrel Aged Dark Star", "Dark Star", True),
        ("Nitro Milk Stout", "Milk Stout", True),
        ("Coffee Imperial Stout", "Imperial Stout", True),
    ],
)
def test_variant_mismatch(one, two, differ):
    assert matching.variants_differ(one, two) is differ


@pytest.mark.parametrize(
    ("candidate", "expected", "least", "most"),
    [
        ("What Rough Beast", "What Rough Beast", 100, 100),
        ("Fresh Hop What Rough Beast (2019)", "What Rough Beast", 0, 0),
        ("What Rough Beast (2023)", "What Rough Beast", 1, 99),
        ("Anything", "", 100, 100),
        ("Fresh Hop What Rough Beast (2019)", "Fresh Hop What Rough Beast", 1, 100),
        ("Double Dry Hopped Caligula", "DDH Caligula", 95, 95),
        ("Triple Dry Hopped Congress Street", "TDH Congress Street", 95, 95),
        ("Whisky Smoke", "Whisky Sour", 0, 0),
        ("Whisky Sour Barrel Aged Sour Ale", "Whisky Sour", 1, 100),
        ("The Realm's Remedy 11th Anniversary IPA", "The Realm's Remedy Eleventh Anniversary IPA 2026", 1, 100),
        ("My Pale Ale", "Totally Different Beer", 0, 0),
        (None, "x", 0, 0),
    ],
)
def test_score(candidate, expected, least, most):
    assert least <= matching.score(candidate, None, None, expected, None) <= most


def test_producers():
    agree = matching.producers_agree
    for candidate in ("Stone Brewing", "STONE BREWING", "Stone Brewing Co.", "Stone"):
        assert agree(candidate, "Stone Brewing")
    assert not agree("Modern Times", "Stone Brewing") and agree("Modern Times", None)


def test_prices(spark):
    assert values(spark, titles.yen, ("1,200.00",), ("572.00",), ("950",), ("ask",), (None,)) == ["1200円", "572円", "950円", "ask", "Unknown"]
    assert values(spark, text.tax_included_price, ("1,050円(税込1,155円)",), ("¥1,030",), ("none",)) == [1155, 1030, None]
    assert values(spark, text.price_digits, ("¥1,030",), ("",)) == [1030, None]
    assert values(spark, text.number, ("5.5%",), ("1.2.3",), (None,)) == [5.5, None, None]


def test_titles(spark):
    got = values(spark, titles.ingest_title, ("<b>Good</b> Ale【7/4入荷予定】 SALE!! 1,200円 (税込)",), ("(限定) Plain",), (None,))
    assert got == ["Good Ale", "Plain", None]
    assert values(spark, titles.prompt_title, ("Name (空輸) 30%OFF【賞味期限:2026/07/08】",)) == ["Name"]
    assert values(spark, titles.is_set_pack, ("6本セット",), ("Variety Pack",), ("6本以上ご注文 アソート",), ("One",)) == [True, True, False, False]
    kind = lambda t, k, n: titles.product_type(t, k, F.lit(False), n)
    got = values(spark, kind, ("飲み比べ", "beer", ""), ("グラス", "other", "Maker"), ("Ale", "other", "Maker"), ("Ale", "other", "none"), ("Ale", None, None))
    assert got == ["set", "other", "beer", "other", "beer"]


def test_title_forms(spark):
    maker = lambda t, f: F.concat_ws("|", *titles.split_title(t, f))
    got = values(
        spark,
        maker,
        ("【Good Ale / Maker】", "name_slash_maker"),
        ("jp [Maker / Good Ale]", "maker_slash_name"),
        ("jp : jp | Maker: Good Ale", "pipe_maker_colon_name"),
        ("no form", "name_slash_maker"),
        ("【a/b】", "unknown form"),
    )
    assert got == ["Maker|Good Ale"] * 3 + ["", ""]
    assert values(spark, lambda t: F.concat_ws("|", *titles.bracketed_title(t)), ("[Maker] Good Ale / kana",), ("plain",)) == ["Maker|Good Ale", ""]


def test_addresses(spark):
    got = values(spark, titles.canonical_url, ("https://s/x?mode=1&product_id=7&page=2",), ("https://s/shopdetail/12/page3/",), ("https://s/b/name/photos",))
    assert got == ["https://s/x?product_id=7", "https://s/shopdetail/12", "https://s/b/name"]
    assert values(spark, lambda h: titles.absolute(h, "https://s/"), ("/a",), ("b",), ("http://t/c",)) == ["https://s/a", "https://s/b", "http://t/c"]
    assert values(spark, titles.percent_encoded, ("a b&c",)) == ["a%20b%26c"]


def test_flags_and_display(spark):
    assert values(spark, titles.flag, ("Fukuoka Japan",), ("Wales",), ("Atlantis",), (None,)) == ["🇯🇵", "🇬🇧", titles.NO_FLAG, titles.NO_FLAG]
    assert values(spark, display.image, ("http://x/badge-beer-default.png", "http://o.png"), (None, None), ("http://p.png", None)) == ["http://o.png", display.NO_IMAGE, "http://p.png"]
    assert values(spark, display.shown_name, *[(r) for r in [("l", "beer", "P", "O"), (None, "beer", "P", "O"), ("l", "set", "P", "O"), ("l", "beer", None, "O")]]) == ["P", "O", "O", "O"]
    assert values(spark, lambda p: display.money(p.cast("double")), ("1200",), ("0",), (None,)) == ["¥1,200", "¥-", "¥-"]
    age = lambda s: display.is_new(s.cast("timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert values(spark, age, ("2024-01-01 12:00:00",), ("2023-12-31 00:00:00",), ("2024-01-03 00:00:00",), (None,)) == [True, False, False, False]


@pytest.mark.parametrize("row", SCORE_TABLE, ids=lambda r: f"{r[0]}/{r[3]}")
def test_score_table(row):
    assert matching.score(*row[:5]) == row[5]


@pytest.mark.parametrize(
    ("name", "plain"),
    [
        ("Foo West Coast IPA Reserve", "Foo Reserve"),
        ("DDH Foo 〜series〜", "Foo"),
        ("Foo シリーズ 3", "Foo"),
        ("Foo (2026.07)", "Foo"),
        ("Foo 2026.07", "Foo"),
        ("Foo #12 Batch 3", "Foo"),
        ("Foo (CAN)", "Foo"),
        ("Foo（生樽）", "Foo"),
        ("Foo（冬版）", "Foo"),
        ("Foo: Cherry/Vanilla", "Foo"),
        ("Foo (w/Cryo Fresh Hops)", "Foo"),
        ("Foo Imperial Stout Bar", "Foo Bar"),
        ("Foo Fruited Ale", "Foo"),
        ("Foo-冬編-", "Foo"),
        ("Foo 2x Bar", "Foo Bar"),
        ("DR. Foo", "Dr Foo"),
        ("Foo (toe 25th Anniversary)", "Foo"),
        ("Foo Pilsner", "Foo"),
    ],
)
def test_clean(spark, name, plain):
    assert matching.clean(name) == plain
    assert spark.createDataFrame([(name,)], "n string").select(text.cleaned(F.col("n"))).head()[0] == plain


def test_linking_guards():
    assert matching.producers_agree("Stone Garden Beer", "Stone Brewing")
    assert not matching.producers_agree("Sun", "Moon Brewing")
    assert matching.variants_differ("Golden Foo DDH", "Golden Foo") and not matching.variants_differ("Golden Foo Cask Ale", "Golden Foo")
