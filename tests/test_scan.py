"""A scan of shops in its modes, producers' pages, and the queue of stock checks."""

import datetime
import json
from dataclasses import replace

from pyspark.sql import functions as F

from offerlake.operators import dictionary, scan, stock
from offerlake.sources.shops import LAYOUTS

T = datetime.datetime
STATE = "url string, price_value double, stock_status string, first_seen timestamp_ntz, last_seen timestamp_ntz, product_url string, name string, price string, image string, shop string"
RULES = [
    replace(LAYOUTS["products.json by publication"], shop="a", base_url="https://a", stop_after=2),
    replace(LAYOUTS["products.json by publication"], shop="b", base_url="https://b", stop_after=3),
]


def page(shop, number, *handles, available=True, date=None):
    products = [{"title": f"T {h}", "handle": h, "published_at": date, "variants": [{"price": "100.00", "available": available}]} for h in handles]
    return shop, number, bytearray(json.dumps({"products": products}).encode())


def scanned(spark, pages, known, **how):
    state = spark.createDataFrame([(f"https://{u[0]}/products/{u[1:]}", 1.0, s, T(2020, 1, 1), T(2020, 1, 1), "/b/1", "old", None, None, u[0]) for u, s in known], STATE)
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    done = scan.scan(spark.createDataFrame(pages, "shop string, page int, body binary"), RULES, state, now, **how)
    rows = {r.url.replace("https://", "").replace("/products/", ""): r for r in done.state.collect()}
    return rows, {r.shop: (r.new, r.restocked, r.seen, r.written) for r in done.statistics.collect()}


PAGES = [page("a", 1, "1", "2", "3", "4"), page("a", 2, "5"), page("b", 1, "1", "2", "3", "4", "5", date="2025-05-05T00:00:00Z")]
KNOWN = [("a2", "In Stock"), ("a3", "In Stock"), ("a5", "Sold Out"), ("b1", "Sold Out"), ("b2", "In Stock"), ("b3", "In Stock"), ("a9", "In Stock")]


def test_full_scan(spark):
    rows, counts = scanned(spark, PAGES, KNOWN)
    assert {u: r.change for u, r in rows.items()} == {
        "a1": "new", "a2": "seen", "a3": "seen", "a4": "new", "a5": "restock", "a9": "absent", "b1": "restock", "b2": "seen", "b3": "seen", "b4": "new", "b5": "new"
    }
    assert counts == {"a": (2, 1, 2, 5), "b": (2, 1, 2, 5)}
    assert rows["a1"].first_seen == T(2026, 1, 1, 0, 0, 0, 4) and rows["a5"].first_seen == T(2026, 1, 1) and rows["a2"].first_seen == T(2020, 1, 1)
    assert {r.first_seen for u, r in rows.items() if u[0] == "b"} == {T(2025, 5, 5)}  # a shop's dates come first
    assert (rows["a2"].name, rows["a2"].price, rows["a2"].price_value, rows["a2"].product_url) == ("T 2", "100円", 100.0, "/b/1")
    assert (rows["a9"].name, rows["a9"].last_seen) == ("old", T(2020, 1, 1))


def test_scan_for_new_offers_stops(spark):
    rows, counts = scanned(spark, PAGES, KNOWN, only_new=True)
    # a ends before 3, the second known one on end; b before 3, the third
    assert {u: r.change for u, r in rows.items() if r.change != "absent"} == {"a1": "new", "a2": "seen", "b1": "restock", "b2": "seen"}
    assert rows["a2"].name == "old" and rows["b1"].name == "T 1"
    rows, _ = scanned(spark, PAGES, KNOWN, only_new=True, full=True)
    assert sum(r.change != "absent" for r in rows.values()) == 10 and rows["b3"].name == "old"


def test_limits_dates_and_repeats(spark):
    rows, counts = scanned(spark, PAGES, KNOWN, limit=2)
    assert {u for u, r in rows.items() if r.change != "absent"} == {"a1", "a2", "b1", "b2"} and counts["a"] == (1, 0, 1, 2)
    rows, _ = scanned(spark, PAGES, KNOWN, reset_dates=True)
    assert rows["a2"].first_seen == T(2026, 1, 1, 0, 0, 0, 3) and rows["b2"].first_seen == T(2025, 5, 5)
    rows, _ = scanned(spark, [page("a", 1, "1", "2"), page("a", 2, "1", available=False)], [])
    assert rows["a1"].stock_status == "Sold Out" and rows["a1"].first_seen == T(2026, 1, 1)
    rows, counts = scanned(spark, [("a", 1, None)], [])
    assert rows == {} and counts == {}


def test_producers_pages(spark):
    facts = "location string, producer_type string, website string, logo string"
    old = spark.createDataFrame(
        [(1, "/w/1", "Stone", "old", "t", "w", "l", None), (2, None, "Moon", None, None, None, None, None), (3, "/w/3", "Sun", None, None, None, None, None)],
        f"entity int, url string, name_en string, {facts}, updated_at timestamp",
    )
    found = spark.createDataFrame(
        [("/w/1", "Stone Two", "here", None, None, None), ("/w/2", " moon", None, None, None, None), ("/x/3", "sun", "x", None, None, None), ("/w/1", "Sun", "y", None, None, None),
         ("/n/2", "New", "b", None, None, None), ("/n/1", "new", "a", None, None, None), ("/n/3", "", "c", None, None, None), ("/n/4", None, "d", None, None, None)],
        f"url string, producer_name string, {facts}",
    )
    got = dictionary.merge_producers(old, found, F.lit("2026-01-01").cast("timestamp")).select("entity", "url", "name_en", "location", "website", "change").collect()
    # of two pages at /w/1 the greater name counts, and that is Sun's, who has another address
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(1, "/w/1", "Stone", "old", "w", "kept") if max("Stone Two", "Sun") == "Sun" else (1, "/w/1", "Stone Two", "here", None, "updated"), (2, "/w/2", " moon", None, None, "updated"), (3, "/w/3", "Sun", None, None, "kept"), (None, "/n/1", "new", "a", None, "inserted")],
        key=str,
    )
    assert dictionary.merge_producers(old, found.limit(0), F.lit("2026-01-01").cast("timestamp")).where("change = 'kept'").count() == 3


def test_queue_of_stock_checks(spark):
    rows = [("a", "s", "In Stock", 2, 1.0), ("b", "s", "Sold Out", 1, 5.0), ("c", "t", "In Stock", None, None), ("d", "s", None, 0, 9.0), ("e", "s", "In Stock", 1, 3.0)]
    df = spark.createDataFrame(rows, "url string, shop string, stock_status string, last_seen int, rating double")
    take = lambda **how: [r.url for r in stock.to_check(df, **how).collect()]
    assert take() == ["c", "e", "a"] and take(limit=1) == ["c"] and take(shops=("s",)) == ["e", "a"]
    assert take(by_rating=True) == ["e", "a", "c"] and take(sold_out=True) == ["c", "d", "b", "e", "a"]
