"""Extraction: same titles, the dictionary, a provider, and rules over all three."""

import datetime

from pyspark.sql import functions as F

from offerlake.operators import extraction, providers

FIELDS = "url string, producer_jp string, producer_en string, name_jp string, name_en string, name_core string, search_hint string, product_type string, is_set boolean"


def frames(spark):
    offers = [
        ("same", "Golden Foo", None), ("blank", " ", None), ("form", "【黒 IPA 500ml/ストーン】6本セット", "name_slash_maker"), ("unknown maker", "【黒/誰】", "name_slash_maker"),
        ("other form", "【黒/ストーン】", "pipe_maker_colon_name"), ("model", "something", None), ("goods", "コラボグラス", None), ("silent", "zzz", None), ("null", None, None),
    ]
    stored = [("s2", "Golden Foo"), ("s1", "Golden Foo"), ("s0", "Golden Foo"), ("s3", "other")]
    known = [
        ("s2", None, "Later", None, "x", None, None, "beer", False), ("s1", None, "Stone", None, "Golden Foo", "", "hint", "glass", None), ("s0", None, None, None, "no maker", None, None, "beer", False),
    ]
    entities = [(1, "Stone Brewing", "ストーン", ["the stone"]), (2, "Brewing Co", None, None)]
    return (
        spark.createDataFrame([(u, t, f, None, "shop", 1) for u, t, f in offers], "url string, title string, form string, maker string, shop string, rank int"),
        spark.createDataFrame(stored, "url string, name string"),
        spark.createDataFrame(known, FIELDS),
        spark.createDataFrame(entities, "entity int, name_en string, name_jp string, aliases array<string>"),
    )


def test_tiers_by_hand(spark):
    offers, stored, known, entities = frames(spark)
    answers = [("extract", "model", '{"beer_name_en": "A", "product_type": "other"}'), ("extract", "goods", '{"brewery_name_en": "B", "product_type": "other"}'), ("extract", "silent", '{"product_type": "beer"}')]
    table = providers.TableProvider(spark.createDataFrame(answers, "kind string, url string, answer string"))
    done = extraction.extract(offers, stored, known, entities, table, F.col("rank"), day=F.lit(datetime.date(2026, 1, 1)))
    got = {r.url: (r.how, r.producer_en, r.name_en, r.name_core, r.search_hint, r.product_type, r.is_set) for r in done.rows.collect()}
    assert got == {
        "same": ("exact", "Stone", "Golden Foo", "Golden Foo", "hint", "glass", False),
        "form": ("dictionary", "Stone Brewing", "黒 IPA 500ml", "黒", "黒 Stone Brewing", "set", True),
        "model": ("model", None, "A", None, None, "beer", False),
        "goods": ("model", "B", None, None, None, "other", False),
    }
    assert {(r.url, r.reason) for r in done.faults.collect()} == {(u, "model_no_info") for u in ("silent", "blank", "unknown maker", "other form", "null")}
    assert [tuple(r) for r in done.usage.collect()] == [("table", datetime.date(2026, 1, 1), 7)]


def test_keys_and_cores(spark):
    _, _, _, entities = frames(spark)
    keys = {r.key: r.name_en for r in extraction.dictionary_keys(entities).collect()}
    assert keys == {"stone brewing": "Stone Brewing", "stone": "Stone Brewing", "ストーン": "Stone Brewing", "the stone": "Stone Brewing", "brewing co": "Brewing Co"}
    names = spark.createDataFrame([("Foo IPA 330ml",), ("ipa",), ("Canal Street",), ("黒 瓶",)], "n string")
    assert [r[0] for r in names.select(extraction.core_of(F.col("n"))).collect()] == ["Foo", "ipa", "Canal Street", "黒"]


def test_empty_tables(spark):
    offers, stored, known, entities = frames(spark)
    table = providers.TableProvider(spark.createDataFrame([], "kind string, url string, answer string"))
    done = extraction.extract(offers.limit(0), stored.limit(0), known.limit(0), entities.limit(0), table)
    assert done.rows.count() == done.faults.count() == done.usage.count() == 0
