"""Blocks, pairs, and a linking run in its modes."""

import datetime

import pytest
from pyspark.sql import functions as F

from offerlake.operators import blocking, linkage, linking

NOW = datetime.datetime(2026, 1, 10)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_blocks_by_hand(spark):
    dictionary = spark.createDataFrame([("stone", "Stone"), ("stone brewing", "Stone"), ("モダン", "Modern"), ("modern", "Modern"), ("ale", "Ale"), ("far", "Far"), ("farlong", "Far")], "key string, entity string")
    addresses = spark.createDataFrame([("Stone", "/w/1"), ("Modern", "/w/2"), ("Far", None), ("Ale", "/w/9"), ("Ale", "/w/8")], "entity string, address string")
    wanted = spark.createDataFrame(
        [("key", " STONE Brewing", "x"), ("inside", "The Modernists", "x"), ("name", "who", "Stone IPA"), ("no address", "Far and Stone", "x"), ("far only", "Far", "x"), ("plain", "A Brewing x B", "y"),
         ("nothing", None, None), ("empty", "", ""), ("longest", "modern stone brewing", "z"), ("key", " STONE Brewing", "x")],
        "url string, maker string, name string",
    )
    assert rows(blocking.maker_blocks(wanted, dictionary, addresses)) == [
        ("far only", "far", "plain"), ("inside", "/w/2", "maker"), ("key", "/w/1", "key"), ("longest", "/w/1", "maker"), ("name", "/w/1", "name"),
        ("no address", "/w/1", "maker"), ("plain", "a", "plain"), ("plain", "b", "plain"),
    ]
    far = wanted.where("url = 'no address'").withColumn("maker", F.lit("Farlong Ale"))
    assert rows(blocking.maker_blocks(far, dictionary, addresses)) == [("no address", "/w/8", "collaborators")]


def test_hot_words_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PIECE", 20)
    left = spark.range(0, 130).select(F.col("id").alias("url"), F.lit("b").alias("block"), F.array(F.lit("ipa"), F.concat(F.lit("w"), (F.col("id") % 9).cast("string"))).alias("words"))
    right = spark.range(0, 70).select(F.col("id").alias("product"), F.lit("b").alias("block"), F.array(F.concat(F.lit("w"), (F.col("id") % 5).cast("string")), F.lit("ipa")).alias("words"))
    got = blocking.pairs_by_word(left, right, "url", "product").select("url", "product").collect()
    assert len(got) == 130 * 70 and len(set(got)) == 130 * 70
    other = right.withColumn("block", F.lit("c"))
    assert blocking.pairs_by_word(left, other, "url", "product").count() == 0


def wide(spark):
    schema = "url string, product_url string, product_name string, product_type string, stock_status string, first_seen timestamp_ntz, fetched_at timestamp_ntz"
    day = lambda n: NOW - datetime.timedelta(days=n)
    return spark.createDataFrame(
        [("new", None, None, "beer", "In Stock", day(1), None), ("old", "/search?q=x", None, None, "In Stock", day(9), None), ("set", None, None, "set", "In Stock", day(1), None),
         ("unknown", "/b/1", None, "beer", "In Stock", day(2), None), ("fresh", "/b/2", "n", "beer", "In Stock", day(2), day(1)), ("stale", "/b/3", "n", "beer", "In Stock", day(2), day(8)),
         ("out", "/b/4", "n", "beer", "Sold Out", day(2), day(8)), ("tired", None, None, "beer", "In Stock", day(3), None), ("waits", None, None, "beer", "In Stock", day(3), None)],
        schema,
    )


def ledger(spark):
    day = lambda n: NOW - datetime.timedelta(days=n)
    return spark.createDataFrame(
        [("tired", 3, "no_results", day(20), day(10), False), ("waits", 1, "no_results", day(2), day(2), False), ("old", 2, "no_results", day(20), day(8), False), ("new", 5, "x", day(20), day(1), True), ("gone", 1, "x", day(3), day(3), False)],
        "url string, attempts long, reason string, first_at timestamp_ntz, last_at timestamp_ntz, resolved boolean",
    )


def test_queues(spark):
    take = lambda mode, **how: [r.url for r in linking.queue(wide(spark), ledger(spark), mode, now(), **how).collect()]
    assert sorted(take("missing")) == ["new", "old", "unknown"] and take("missing", limit=2) == ["new", "unknown"]
    assert sorted(take("missing", force=True)) == ["new", "old", "tired", "unknown", "waits"]
    assert sorted(take("refresh")) == ["stale", "unknown"] and take("refresh", limit=1) == ["unknown"]
    assert sorted(take("refresh", force=True)) == ["fresh", "stale", "unknown"]
    assert take("retry-failures", limit=9) == ["tired", "old", "waits"]
    with pytest.raises(ValueError):
        take("all")


PRODUCTS = [("/b/1", "Golden Foo", "Stone Brewing", "/w/1", "IPA"), ("/b/2", "Dark Bar 2019", "Modern Times", "/w/2", "Stout"), ("/b/3", "Other", "Far", None, None)]


def run(spark, offers, **how):
    given = spark.createDataFrame(offers, "url string, title string, maker string, name string, name_jp string, product_url string")
    products = spark.createDataFrame(PRODUCTS, "product_url string, product_name string, producer_name string, producer_url string, style string")
    empty = spark.createDataFrame([], "url string, attempts long, reason string, first_at timestamp_ntz, last_at timestamp_ntz, resolved boolean")
    facts = {k: how.pop(k) for k in ("cached", "web", "verdicts", "inferred", "faults", "dictionary", "addresses") if k in how}
    return linking.run(given, linking.Known(products, **facts), how.pop("ledger", empty), now(), **how)


def test_run_by_hand(spark):
    offers = [
        ("found", "Golden Foo", "Stone", "Golden Foo", None, None), ("kept", "t", "Stone", "Golden Foo", None, "/b/1"), ("wrong", "Golden Foo", "Stone", "Golden Foo", None, "/b/3"),
        ("vintage", "Dark Bar", "Modern Times", "Dark Bar", None, None), ("nothing", "zzz", "Stone", "zzz", None, None), ("nameless", None, None, None, None, None), (None, "x", "y", "z", None, None),
    ]
    done = run(spark, offers)
    assert rows(done.outcomes.select("url", "product_url", "how", "reason")) == [
        ("found", "/b/1", "search", None), ("kept", "/b/1", "kept", None), ("nameless", None, None, "missing_info"), ("nothing", None, None, "no_results"),
        ("vintage", None, None, "final_validation_mismatch"), ("wrong", "/b/1", "search", None),
    ]
    assert {(r.url, r.attempts, r.resolved) for r in done.ledger.collect()} == {
        ("found", 0, True), ("kept", 0, True), ("wrong", 0, True), ("nameless", 1, False), ("nothing", 1, False), ("vintage", 1, False)
    }
    assert rows(done.seen) == [("Stone Brewing", "Stone")]


def test_offline_refresh_and_functions_as_arguments(spark):
    offers = [("a", "Golden Foo", "stone", "golden foo", None, None), ("b", "t", "Stone", "Golden", None, None)]
    assert rows(run(spark, offers, offline=True).outcomes.select("url", "how", "reason")) == [("a", "offline", None), ("b", None, "no_results")]
    linked = [("a", "t", None, None, None, "/b/1"), ("b", "t", None, None, None, "/b/404"), ("c", "t", None, None, None, None)]
    assert rows(run(spark, linked, mode="refresh").outcomes.select("url", "product_url", "how", "reason")) == [("a", "/b/1", "refreshed", None), ("b", "/b/404", None, "details_error")]
    never = lambda product, producer, style, name, maker: F.when(F.length(product) > 100, 1).otherwise(0)
    assert rows(run(spark, offers, score=never).outcomes.select("url", "reason")) == [("a", "no_results"), ("b", "no_results")]
    strict = lambda title, name, style, producer, maker=None: title == F.upper(name)
    assert rows(run(spark, offers[:1], check=strict).outcomes.select("url", "reason")) == [("a", "final_validation_mismatch")]


def test_web_and_verdicts(spark):
    offers = [("a", "Golden Foo", "Stone", "Golden Foo", None, None), ("b", "Golden Web", "Stone", "Golden Web", None, None), ("c", "Golden Foo", "Stone", "Golden Foo", None, None)]
    web = spark.createDataFrame([("b", "/b/web", "Golden Web - Stone - Pages"), ("b", "/b/no", "Golden - Stone"), ("a", "/b/extra", "Golden Foo Stone")], "url string, product_url string, title string")
    verdicts = spark.createDataFrame([("a", None), ("c", "/b/none")], "url string, product_url string")
    got = rows(run(spark, offers, web=web, verdicts=verdicts).outcomes.select("url", "product_url", "how", "reason"))
    assert got == [("a", "/b/1", "search", None), ("b", "/b/web", None, "details_error"), ("c", None, None, "no_results")]


def test_top_candidates_order(spark):
    found = [("a", f"p{i:02}", i * 37 % 100, i) for i in range(60)] + [("b", "q", 0, 0), ("b", "r", 5, 1), ("b", "s", 5, 0)]
    df = spark.createDataFrame(found, "url string, product_url string, score int, pos int")
    want = sorted(((-s, pos, p) for u, p, s, pos in found if u == "a" and pos < 50 and s > 0))[:15]
    got = linkage.best_candidates(df).where("url = 'a'").orderBy("rank").collect()
    assert [(r["rank"], r.product_url) for r in got] == [(i + 1, p) for i, (_, _, p) in enumerate(want)]
    assert [r.product_url for r in linkage.best_candidates(df).where("url = 'b'").orderBy("rank").collect()] == ["s", "r"]
    plan = linkage.best_candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(spark):
    assert run(spark, []).outcomes.count() == 0 and run(spark, [], mode="refresh").ledger.count() == 0
