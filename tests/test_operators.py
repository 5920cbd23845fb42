"""Operators on small made-up tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from offerlake.operators import catalog, dictionary, ingest, linkage, search, stock
from offerlake.plans import materialize
from offerlake.plans.spec import SearchSpec
from offerlake.sources import html, json_api
from offerlake.streaming import ingest as stream

T = datetime.datetime


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def offers(spark, *items):
    """A wide view of one product with (shop, price, status) items."""
    data = [("p", f"{shop}{i}", shop, price, status, T(2024, 1, 1 + i), "n", False) for i, (shop, price, status) in enumerate(items)]
    schema = "product_url string, url string, shop string, price_value double, stock_status string, first_seen timestamp_ntz, name string, is_sale boolean"
    wide = spark.createDataFrame(data, schema)
    empty = ("product_name", "producer_name", "style", "location", "product_type")
    return wide.withColumns({c: F.lit(None).cast("string") for c in empty} | {"rating": F.lit(1.0), "is_set": F.lit(False)})


@pytest.mark.parametrize(
    ("items", "mode", "shown"),
    [
        ([("A", 1000.0, "In Stock"), ("B", 1200.0, "Sold Out")], "in_stock", ["A"]),
        ([("A", 1000.0, "In Stock"), ("B", 1200.0, "Sold Out")], "all", ["A", "B"]),
        ([("A", 1000.0, "In Stock"), ("B", 1200.0, "Sold Out")], "sold_out", ["B"]),
        ([("B", 1200.0, "Sold Out")], "in_stock", []),
        ([("A", 1200.0, "In Stock"), ("B", 890.0, "In Stock"), ("C", 1000.0, "In Stock")], "in_stock", ["B", "C", "A"]),
        ([("A", 0.0, "In Stock"), ("B", None, "In Stock"), ("C", 1000.0, "In Stock")], "in_stock", ["C", "A", "B"]),
        ([("A", 1.0, "Sold Out"), ("A", 2.0, "Sold Out"), ("A", 3.0, "In Stock")], "all", ["A"]),
    ],
)
def test_visible_items(spark, items, mode, shown):
    groups = catalog.group_view(offers(spark, *items))
    assert [r.shop for r in search.visible_items(groups, mode).orderBy("place").collect()] == shown


def test_group_search(spark):
    wide = offers(spark, ("A", 1000.0, "In Stock"), ("B", 1200.0, None))
    found = lambda **spec: search.search_groups(wide, catalog.group_view(wide), SearchSpec(**spec)).total()
    assert found() == 1 and found(shops=("B",)) == 0 and found(shops=("B",), stock="sold_out") == 1
    assert found(stock="sold_out") == 0 and found(shops=("C",), stock="all") == 0 and found(shops=("A", "B")) == 1


def test_search_spec():
    spec = SearchSpec.from_request({"shop": "A| B ||", "min_abv": "x", "page": "0", "limit": "50"}, T(2024, 1, 1))
    assert spec.shops == ("A", "B") and spec.min_abv is None and (spec.page, spec.limit, spec.stock) == (1, 50, "in_stock")
    for wrong in ({"stock": "maybe"}, {"sort": "x"}, {"page": 0}, {"days": 3}):
        with pytest.raises(ValueError):
            SearchSpec(**wrong)


def test_merge(spark):
    schema = "url string, price_value double, stock_status string, first_seen timestamp_ntz, product_url string"
    old = [("a", 1.0, "Sold Out", T(2024, 1, 1), "p"), ("b", 1.0, "In Stock", T(2024, 1, 1), None), ("c", 1.0, None, T(2024, 1, 1), None)]
    new = [("a", 2.0, "In Stock", None, None), ("b", 2.0, "In Stock", None, "q"), ("d", 2.0, "In Stock", T(2024, 2, 2), None), ("e", 2.0, "In Stock", None, None)]
    state = spark.createDataFrame(old, schema).withColumn("last_seen", F.col("first_seen"))
    now = T(2024, 3, 3)
    got = {r.url: r for r in ingest.merge_offers(state, spark.createDataFrame(new, schema), F.lit(now).cast("timestamp_ntz")).collect()}
    assert {u: r.change for u, r in got.items()} == {"a": "restock", "b": "seen", "c": "absent", "d": "new", "e": "new"}
    assert [got[u].first_seen for u in "abde"] == [now, T(2024, 1, 1), T(2024, 2, 2), now]
    assert got["a"].product_url == "p" and got["b"].product_url == "q" and got["c"].price_value == 1.0


def test_backoff(spark):
    schema = "url string, attempts long, reason string, first_at timestamp_ntz, last_at timestamp_ntz, resolved boolean"
    old, late = T(2024, 1, 1), T(2024, 1, 19)
    ledger = spark.createDataFrame([("a", 3, "r", old, old, False), ("b", 1, "r", old, late, False), ("c", 1, "r", old, old, False), ("d", 9, "r", old, late, True)], schema)
    queue = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    as_of = F.lit(T(2024, 1, 20)).cast("timestamp_ntz")
    assert [r.url for r in ingest.due(queue, ledger, as_of).orderBy("url").collect()] == ["c", "d", "e"]
    assert ingest.due(queue, ledger, as_of, force=True).count() == 5


def test_stop_after_run(spark):
    data = spark.createDataFrame([("s", i, f) for i, f in enumerate([True, None, True, True, False])] + [("t", 0, True)], "s string, i int, f boolean")
    cut = lambda keep: [r.i for r in ingest.stop_after_run(data, "s", F.col("f"), 2, ["i"], keep).where("s = 's'").orderBy("i").collect()]
    assert cut(False) == [0, 1, 2] and cut(True) == [0, 1, 2, 3]


def entities(spark):
    data = [(1, "West Coast Brewing", None, ["WCB"], "u1"), (2, "Stone Brewing", "ストーン", [], None)]
    return spark.createDataFrame(data, "entity int, name_en string, name_jp string, aliases array<string>, url string")


def test_learn_aliases(spark):
    seen = [(1, "ウエストコースト"), (1, "wcb"), (1, "Brewery"), (1, "Beer Co"), (1, "stone brewing"), (1, "A x B"), (1, "Z"), (1, "Both"), (2, "both")]
    got = {r.entity: r for r in dictionary.learn_aliases(entities(spark), spark.createDataFrame(seen, "entity int, name string")).collect()}
    assert got[1].name_jp == "ウエストコースト" and got[1].aliases == ["WCB", "ウエストコースト"] and got[2].aliases == []


def test_dictionary(spark):
    known = dictionary.entries(entities(spark))
    texts = spark.createDataFrame([(1, "new from WEST COAST BREWING (wcb)!"), (2, "stone"), (3, None), (4, "")], "id int, text string")
    assert rows(dictionary.find_in_texts(texts, "id", "text", known)) == [(1, 1, "west coast brewing")]
    assert rows(dictionary.propose_aliases(entities(spark))) == [(1, "West Coast"), (2, "Stone"), (2, "ストーン")]
    assert rows(dictionary.summary(entities(spark))) == [(2, 1, 1, 1)]
    found = spark.createDataFrame([("u1", "Other"), ("u9", "west coast brewing"), ("u2", "stone brewing "), ("u3", "New")], "url string, name_en string")
    assert rows(dictionary.match_entities(found, entities(spark)).select("url", "entity", "action")) == [
        ("u1", 1, "update"), ("u2", 2, "update"), ("u3", None, "insert"), ("u9", None, "skip")
    ]


def test_linking(spark):
    products = [("p1", "Fresh Hop What Rough Beast (2019)", "Maker Brewing", "IPA"), ("p2", "What Rough Beast", "Maker", "IPA"), ("p3", "Old Vintage 2023", "Maker", "IPA")]
    products = spark.createDataFrame(products, "product_url string, product_name string, producer_name string, style string")
    wanted = [("a", "What Rough Beast", "Maker"), ("b", "Nothing", "Maker"), ("c", None, "Maker"), ("d", "What Rough Beast 2024", "Maker x Other"), ("e", "Old Vintage", "Maker")]
    wanted = spark.createDataFrame(wanted, "url string, name string, maker string")
    got = {r.url: (r.product_url, r.reason) for r in linkage.link(wanted, products).collect()}
    assert got == {"a": ("p2", None), "b": (None, "no_results"), "c": (None, "missing_info"), "d": ("p2", None), "e": (None, "validation_failed")}
    only = linkage.link(wanted.where("url = 'a'"), products.where("product_url = 'p1'")).head()
    assert only.product_url is None


def test_validation(spark):
    data = [("Good Ale", "Good Ale", "IPA", "Maker", "Maker"), ("Good Ale", "Good Ale", "IPA", "Modern Times", "Stone Brewing"), ("Good Ale", "Good Ale 2023BY", "IPA", "M", None),
            ("Good Ale 2023", "Good Ale 2023BY", "IPA", "M", None), ("Good Ale", "Good Ale (Cask)", "IPA", "M", None), ("Good リアルエール", "Good Real Ale", None, "M", None),
            ("Good", "Good", "Hard Seltzer", "M", None), ("Good カクテル", "Good", "Cocktail", "M", None), ("", "x", "y", "M", "N")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, t string, p string, s string, m string, w string")
    got = frame.orderBy("i").select(linkage.validated(F.col("t"), F.col("p"), F.col("s"), F.col("m"), F.col("w"))).collect()
    assert [r[0] for r in got] == [True, False, False, True, False, True, False, True, True]
    fallback = linkage.plausible(F.col("t"), F.col("p"), F.col("m"))
    pairs = spark.createDataFrame([("Stone Good Ale", "Good Ale", "Stone Brewing"), ("Stone Good Ale", "Other", "Stone"), (None, "a", "b")], "t string, p string, m string")
    assert sorted(r[0] for r in pairs.select(fallback).collect()) == [False, False, True]


def test_candidate_stages(spark):
    found = [("a", f"p{i}", 1, i) for i in range(5)] + [("a", "q", 2, 0), ("b", "p", 1, 0), ("b", "p", 2, 0), ("b", "q", 2, 1), ("b", "r", 3, 0)]
    kept = linkage.in_stages(spark.createDataFrame(found, "url string, product_url string, stage int, pos int"))
    assert [r[:3] for r in rows(kept)] == [("a", f"p{i}", 1) for i in range(5)] + [("b", "p", 1), ("b", "q", 2), ("b", "r", 3)]


def test_choice(spark):
    scores = spark.createDataFrame([("a", "p", 95), ("a", "q", 90), ("b", "p", 60), ("c", "p", 60), ("d", "p", 0)], "url string, product_url string, score int")
    verdicts = spark.createDataFrame([("a", "q"), ("b", None)], "url string, product_url string")
    assert rows(linkage.decide(scores, verdicts)) == [("a", "q", 90), ("c", "p", 60)]
    assert rows(linkage.decide(scores)) == [("a", "p", 95), ("b", "p", 60), ("c", "p", 60)]


def test_repair_and_cached_links(spark):
    wanted = [("a", "[Maker] Good Ale / x", None, "old"), ("b", "Good Ale by Stone", "The Shop", None), ("c", "Plain", None, None)]
    wanted = spark.createDataFrame(wanted, "url string, title string, maker string, name string")
    hits = spark.createDataFrame([("b", "Stone", "stone"), ("b", "S", "s")], "url string, maker string, key string")
    got = {r.url: (r.maker, r.name) for r in linkage.repair(wanted, hits, ("the shop",)).collect()}
    assert got == {"a": ("Maker", "Good Ale"), "b": ("Stone", "Good Ale by Stone"), "c": (None, "Plain")}
    linked = spark.createDataFrame([("a", "p1", "Good Ale", "M"), ("b", "p1", "Other Thing", "M"), ("c", "p9", "x", "M")], "url string, product_url string, name string, maker string")
    products = spark.createDataFrame([("p1", "Good Ale", "M", None)], "product_url string, product_name string, producer_name string, style string")
    assert {r.url: r.product_url for r in linkage.keep_valid_links(linked, products).collect()} == {"a": "p1", "b": None, "c": "p9"}


PAGE = """<html><title>List</title><ul><li class="item"><a href="/shopdetail/1/p2"><p class="name">Good <b>Ale</b>【予約】</p></a>
<p class="price">1,050円(税込1,155円)</p></li><li class="item"><p class="name">No link</p></li>
<li class="item sold"><a href="https://t/2">x</a><p class="name">Two</p><p class="qty">0個</p><br></li></ul><script>var soldout = "SOLD OUT"</script></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    marks = html.OfferMarks("item", "name", "price", "qty")
    got = rows(html.list_offers(pages, marks, "https://s", "shop").select("page_id", "pos", "url", "name", "price", "stock_status"))
    assert got == [(1, 0, "https://s/shopdetail/1", "Good Ale", "1,050円(税込1,155円)", "In Stock"), (1, 2, "https://t/2", "Two", None, "Sold Out")]
    raw = [("日本".encode(c),) for c in ("utf-8", "euc-jp", "shift_jis")] + [(None,)]
    assert [r[0] for r in spark.createDataFrame(raw, "b binary").coalesce(1).select(html.decode("b")).collect()] == ["日本"] * 3 + [None]


def test_stock_pages(spark):
    at = T(2024, 1, 1)
    data = [("a", "s", 200, PAGE, at), ("b", "s", 404, None, at), ("c", "s", 500, "x", at), ("d", "s", 200, "<p>完売</p>", at), ("e", "k", 200, "<p>Ale</p>", at), ("f", "k", 200, "<a href='/cart'>完売 1,200円</a>", at)]
    pages = spark.createDataFrame(data, "url string, shop string, code int, html string, checked_at timestamp_ntz")
    rules = {"k": stock.StockRule(cart=("/cart",), needs_cart=True, cart_first=True)}
    got = {r.url: (r.status, r.price) for r in stock.check_pages(pages, rules).collect()}
    assert got == {"a": ("In Stock", 1155.0), "b": ("Dead Link", None), "d": ("Sold Out", None), "e": ("Sold Out", None), "f": ("In Stock", 1200.0)}


def test_json(spark):
    payload = '{"title":"T","handle":"h","tags":["Beer"],"updated_at":"x","published_at":"2024-01-01T00:00:00Z","variants":[{"price":"950","available":false},{"price":"1","available":true}],"images":[]}'
    got = json_api.offers(spark.createDataFrame([(payload,), ("{bad",), (None,)], "payload string"), "https://s/", "S").collect()
    assert [(r.url, r.price, r.stock_status, r.image) for r in got] == [("https://s/h", "950円", "In Stock", None)]


def test_materialize(spark, tmp_path):
    folder = str(tmp_path / "view")
    first = materialize.refresh(spark.range(3), folder, "numbers", ("id",))
    assert materialize.latest(spark, folder).count() == 3
    materialize.refresh(spark.range(5), folder)
    assert materialize.latest(spark, folder).count() == 5 and spark.table("numbers").count() == 3 and spark.read.parquet(first).count() == 3


def test_stream(spark, tmp_path):
    incoming, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "url string, price_value double, stock_status string, first_seen timestamp_ntz, product_url string, at timestamp_ntz"
    for day, status in ((1, "Sold Out"), (2, "In Stock")):
        batch = [("a", 1.0 * day, status, None, "p", T(2024, 1, day)), ("a", 0.0, "old", None, None, T(2023, 1, 1))]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(incoming)
        stream.start_ingest(spark, incoming, folder, str(tmp_path / "ck")).awaitTermination()
    state = stream.state_at(spark, folder, 1).collect()
    assert [(r.url, r.price_value, r.stock_status, r.first_seen, r.product_url) for r in state] == [("a", 2.0, "In Stock", T(2024, 1, 2), "p")]


def test_dictionary_finds_short_keys(spark):
    keys = spark.createDataFrame([("\u4eac", 1), ("\u5fd7\u8cc0", 2), ("yo", 3), ("yo-ho", 3), ("west coast", 4), ("", 5)], "key string, entity long")
    texts = [(1, "\u5fd7\u8cc0\u9ad8\u539f IPA"), (2, "YO"), (3, "\u4eac"), (4, "a yo-ho ale, \u6771\u4eac"), (5, "y"), (6, ""), (7, None), (8, "West Coast")]
    found = dictionary.find_in_texts(spark.createDataFrame(texts, "id long, t string"), "id", "t", keys)
    assert {tuple(r) for r in found.collect()} == {(1, 2, "\u5fd7\u8cc0"), (2, 3, "yo"), (3, 1, "\u4eac"), (4, 3, "yo-ho"), (4, 1, "\u4eac"), (8, 4, "west coast")}


def test_second_chance(spark):
    from offerlake.operators import linkage

    products = spark.createDataFrame(
        [("p1", "Moon Rise", "Star Brewing", "Lager"), ("p2", "Sun Set", "Star Brewing", "Lager")],
        "product_url string, product_name string, producer_name string, style string",
    )
    missed = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    inferred = spark.createDataFrame(
        [
            ("a", 0, "Star Brewing", "Moon Rise"),
            ("a", 1, "Star Brewing", "Sun Set"),
            ("b", 0, "Other", "Moon Rise"),
            ("b", 2, "Star", "Sun Set"),
            ("b", 9, "Star", "Moon Rise"),
            ("c", 1, None, "Moon Rise"),
            ("d", 0, "Star", "Moon Rise"),
        ],
        "url string, nth int, maker string, name string",
    )
    got = {(r.url, r.product_url, r.score, r.nth) for r in linkage.second_chance(missed, inferred, products).collect()}
    assert got == {("a", "p1", 100, 0), ("b", "p2", 100, 2)}
    assert linkage.second_chance(missed.limit(0), inferred, products).count() == 0


def test_search_tokens(spark):
    from pyspark.sql import functions as F

    from offerlake.functions import text

    cases = {
        "Hazy Moon IPA LR39": ["39", "Limited Release 39", "LR39", "Moon"],
        "12": ["12"],
        "夜の月 (No. 7) of Ale": ["7", "夜の月"],
        "one two three four five six seven": ["seven", "six", "five", "four", "three", "two"],
        "": [],
    }
    rows = spark.createDataFrame([(n,) for n in cases], "name string").select("name", text.search_tokens(F.col("name")).alias("t"))
    got = {r.name: r.t for r in rows.collect()}
    assert {k: v for k, v in got.items()} | {"夜の月 (No. 7) of Ale": [t for t in got["夜の月 (No. 7) of Ale"] if t != "No."]} == cases
