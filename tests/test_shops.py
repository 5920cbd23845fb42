"""List pages of shops: layouts, encodings, odd pages, and the data source that fetches them."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from offerlake.operators import ingest
from offerlake.sources import shops
from offerlake.sources.shops import LAYOUTS, ShopRule

BOX = "<div class='innerBox'><div class='imgWrap'><a href='/shopdetail/{0}/x/y'><img src='/i/{0}.jpg'></a></div><div class='detail'><p class='name'> {1} </p><p class='price'>900円</p><p class='quantity'>{2}</p></div></div>"


def read(spark, rules, *pages):
    df = spark.createDataFrame([(s, p, b if b is None else bytearray(b), "own") for s, p, b in pages], "shop string, page int, body binary, name string")
    return {(r.shop, r.page, r.pos): r for r in shops.offers(df, rules).collect()}


def rule(layout, shop):
    return replace(LAYOUTS[layout], shop=shop, base_url=f"https://{shop}.example")


def test_layouts_in_their_encodings(spark):
    rules = [rule("inner boxes", "boxes"), rule("product list", "list"), rule("photo list", "photos"), rule("link cards", "cards"), rule("collection", "shelf")]
    boxes = (BOX.format(1, "黒ビール", "残り3個") + BOX.format(2, "白ビール", "0個") + BOX.format(3, "売り切れ 赤", "10個") + "<div class='innerBox'>no link</div>").encode("euc-jp")
    listed = "<ul><li class='recommend_list'><a href='?pid=1'><img class='item_img' src='/a.png' alt='品 名'></a><span class='item_price'>800円(税込880円)</span></li><li class='recommend_list'><a href='https://x/2'>z</a><span class='item_name'>B</span> sold out</li>".encode("euc-jp")
    photos = "<div class='gods_item'><div class='listphoto'><a href='/products/detail.php?product_id=7&x=1'><img src='/p.jpg'></a></div><div class='listrightbloc'><a href='#'>Foo</a><p class='price'>税込: ¥1,234</p></div></div><div class='gods_item'><div class='listphoto'><a href='/products/detail.php?product_id=8'></a></div><p class='soldout'></p></div>".encode()
    cards = "<a class='card' href='?pid=5'><img src='//c/5.png' alt='Foo 【7/4入荷予定】 SALE!!'><span class='price'>1,000円</span></a><a class='card' href='?pid=6'><b class='name'>Bar</b><span class='soldout'></span></a>".encode()
    shelf = "<li class='--collection-product-item'><a href='/products/a'></a><b class='--item-card-title'>コラボグラス</b></li><li class='--collection-product-item'><a href='/products/b'></a><b class='--item-card-title'>[X] Y</b><i class='--item-card-brand-name'>X</i>在庫なし</li>".encode()
    got = read(spark, rules, ("boxes", 1, boxes), ("list", 1, listed), ("photos", 1, photos), ("cards", 1, cards), ("shelf", 1, shelf))
    facts = {k: (r.url, r.name, r.price, r.image, r.stock_status) for k, r in got.items()}
    assert facts == {
        ("boxes", 1, 0): ("https://boxes.example/shopdetail/1", "黒ビール", "900円", "https://boxes.example/i/1.jpg", "In Stock"),
        ("boxes", 1, 1): ("https://boxes.example/shopdetail/2", "白ビール", "900円", "https://boxes.example/i/2.jpg", "Sold Out"),
        ("boxes", 1, 2): ("https://boxes.example/shopdetail/3", "売り切れ 赤", "900円", "https://boxes.example/i/3.jpg", "Sold Out"),
        ("list", 1, 0): ("https://list.example/?pid=1", "品 名", "880円", "https://list.example/a.png", "In Stock"),
        ("list", 1, 1): ("https://x/2", "B", "Unknown", None, "Sold Out"),
        ("photos", 1, 0): ("https://photos.example/products/detail.php?product_id=7", "Foo", "1234円", "https://photos.example/p.jpg", "In Stock"),
        ("photos", 1, 1): ("https://photos.example/products/detail.php?product_id=8", "Unknown", "Unknown", None, "Sold Out"),
        ("cards", 1, 0): ("https://cards.example/?pid=5", "Foo", "1,000円", "https://c/5.png", "In Stock"),
        ("cards", 1, 1): ("https://cards.example/?pid=6", "Bar", "Unknown", None, "Sold Out"),
        ("shelf", 1, 1): ("https://shelf.example/products/b", "[X] Y", "Unknown", None, "Sold Out"),
    }


def test_json_shops_and_odd_pages(spark):
    rules = [rule("products.json by update", "a"), rule("products.json by publication", "b"), rule("inner boxes", "h")]
    products = [
        {"title": "T", "handle": "x", "tags": ["ビール"], "updated_at": "bad", "published_at": "2025-01-01T00:00:00Z", "variants": [{"price": 5, "available": False}, {"available": True}], "images": []},
        {"handle": "y", "tags": "beer", "created_at": "2025-01-03T00:00:00+09:00"}, {"title": "no handle", "tags": ["beer"]}, {"title": "U", "handle": "z", "tags": ["Beer"]},
    ]
    body = json.dumps({"products": products}).encode()
    got = read(spark, rules, ("a", 1, body), ("b", 1, body), ("b", 2, b"{broken"), ("b", 3, b""), ("b", 4, None), ("h", 1, b"\xff\xfe\x00"), ("h", 2, b""), ("other", 1, body))
    assert sorted(got) == [("a", 1, 0), ("a", 1, 3), ("b", 1, 0), ("b", 1, 3)] or sorted(got) == [("a", 1, 0), ("a", 1, 3), ("b", 1, 0), ("b", 1, 1), ("b", 1, 3)]
    assert (got["a", 1, 0].price, got["a", 1, 0].stock_status, got["a", 1, 3].price, got["a", 1, 3].stock_status) == ("5円", "In Stock", "Unknown", "Sold Out")
    assert str(got["a", 1, 0].first_seen) == str(got["b", 1, 0].first_seen) == "2025-01-01 00:00:00"
    assert read(spark, rules) == {}
    with pytest.raises(ValueError):
        ShopRule("x", "y", form="xml")


def test_data_source_fetches_each_page(spark, tmp_path):
    for page in (1, 2):
        (tmp_path / f"one-{page}.json").write_text(json.dumps({"products": [{"title": f"P{page}", "handle": f"h{page}", "tags": ["beer"]}]}))
        (tmp_path / f"two-{page}.html").write_bytes(BOX.format(page, f"名{page}", "1個").encode("euc-jp"))
    one = replace(rule("products.json by update", "one"), pages=f"file://{tmp_path}/one-{{page}}.json")
    two = replace(rule("inner boxes", "two"), pages=f"file://{tmp_path}/two-{{page}}.html")
    fetched = shops.pages(spark, [one, two], last=3)
    assert fetched.rdd.getNumPartitions() == 6
    failed = fetched.where("error IS NOT NULL").select("shop", "page", "body").collect()
    assert sorted((r.shop, r.page, r.body) for r in failed) == [("one", 3, None), ("two", 3, None)]
    found = shops.offers(fetched, [one, two]).select("shop", "page", "name", "url").collect()
    assert sorted(tuple(r) for r in found) == [
        ("one", 1, "P1", "https://one.example/products/h1"), ("one", 2, "P2", "https://one.example/products/h2"),
        ("two", 1, "名1", "https://two.example/shopdetail/1"), ("two", 2, "名2", "https://two.example/shopdetail/2"),
    ]


def test_scan_times_count_every_row(spark):
    rows = [("a", 1, 0, "u1"), ("a", 1, 1, None), ("a", 2, 0, "u2"), ("b", 1, 0, "u3")]
    df = spark.createDataFrame(rows, "shop string, page int, pos int, url string")
    base, place = F.lit("2026-01-01").cast("timestamp_ntz"), F.when(F.col("shop") == "a", 0).otherwise(3)
    got = {(r.shop, r.page, r.pos): str(r.seen) for r in ingest.scan_times(df, base, place, "shop", F.col("page"), F.col("pos")).collect()}
    day = "2026-01-01 00:00:0"
    assert got == {("a", 2, 0): f"{day}0", ("a", 1, 1): f"{day}0.000001", ("a", 1, 0): f"{day}0.000002", ("b", 1, 0): f"{day}3"}
