"""Keyed streaming ingest against the batch merge, its timers, and the bucket table below it."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from offerlake.operators import ingest
from offerlake.plans.buckets import BucketTable
from offerlake.streaming import keyed

T = datetime.datetime


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of the state has a Python worker of its own, batch by batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "_manifest" not in d}


def test_buckets_rewrite_only_what_is_touched(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), "url string, n long", buckets=8)
    assert table.read(spark).count() == 0 and table.versions(spark) == []
    rows = spark.range(0, 200).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("n"))
    assert table.upsert(rows, 0) == list(range(8))
    before = table.places(spark)
    one = rows.where("url = 'u7'").withColumn("n", F.lit(-1).cast("long"))
    (bucket,) = table.upsert(one.unionByName(one.limit(0)), 1)
    after = table.places(spark)
    assert {b for b in after if after[b] != before[b]} == {bucket}
    assert table.read(spark).count() == 200 and table.read(spark).where("url = 'u7'").head().n == -1
    assert table.read(spark, version=0).where("url = 'u7'").head().n == 7
    assert table.upsert(rows.withColumn("n", F.lit(0).cast("long")), 1) == []  # a finished version stays
    assert table.upsert(rows.limit(0), 2) == [] and table.read(spark).count() == 200
    nameless = spark.createDataFrame([(None, 1)], "url string, n long")
    assert table.upsert(nameless, 3) == []
    kept = files(tmp_path / "t")
    table.vacuum(spark, keep=1)
    left = files(tmp_path / "t")
    assert left < kept and table.versions(spark) == [3] and table.read(spark).count() == 200
    assert len(left) == 8


def event(url, kind, at, price=None, stock=None, first=None, link=None, reason=None):
    return (url, kind, price, stock, first, link, reason, at)


BATCHES = [
    [event("a", "seen", T(2024, 1, 1), 1.0, "Sold Out"), event("b", "seen", T(2024, 1, 1), 2.0, "In Stock", T(2023, 5, 5), "p"), event("c", "seen", T(2024, 1, 1), 3.0, None), event(None, "seen", T(2024, 1, 1))],
    [event("a", "seen", T(2024, 1, 2), 1.5, "In Stock"), event("b", "seen", T(2024, 1, 2), 2.5, "sold out", None, "other"), event("d", "seen", T(2024, 1, 2), 4.0, "In Stock")],
    [event("b", "seen", T(2024, 1, 9), 2.0, "In Stock", T(2024, 1, 8)), event("c", "seen", T(2024, 1, 9), 3.0, "In Stock")],
]


def run(spark, tmp_path, batches, after=None, name="x"):
    incoming, table = str(tmp_path / f"in-{name}"), BucketTable(str(tmp_path / f"state-{name}"), keyed.STATE, buckets=4)
    schema = keyed.EVENT.replace("timestamp", "timestamp_ntz")
    for batch in batches:
        rows = spark.createDataFrame(batch, schema)
        rows.select(*(F.col(c).cast("timestamp") if c in ("first_seen", "at") else F.col(c) for c in rows.columns)).coalesce(1).write.mode("append").parquet(incoming)
        keyed.start(spark, incoming, table, str(tmp_path / f"ck-{name}"), after).awaitTermination()
    return table


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def test_stream_equals_batch(spark, tmp_path):
    seen = []
    table = run(spark, tmp_path, BATCHES, lambda batch, number: seen.append((number, sorted((r.url, r.change) for r in batch.collect()))))
    state = spark.createDataFrame([], "url string, price_value double, stock_status string, first_seen timestamp_ntz, last_seen timestamp_ntz, product_url string")
    want = []
    for batch in BATCHES:
        new = spark.createDataFrame(batch, keyed.EVENT.replace("timestamp", "timestamp_ntz")).where("url IS NOT NULL").select("url", "price_value", "stock_status", "first_seen", "product_url")
        merged = ingest.merge_offers(state, new, F.lit(batch[0][-1]).cast("timestamp_ntz"))
        want.append(sorted((r.url, r.change) for r in merged.where("change <> 'absent'").collect()))
        state = spark.createDataFrame(merged.drop("change").collect(), state.schema)
    assert [changes for _, changes in seen if changes] == want
    columns = ["url", "price_value", "stock_status", "first_seen", "last_seen", "product_url"]
    got = sorted(tuple(map(plain, r)) for r in table.read(spark).select(*columns).collect())
    assert got == sorted(tuple(r) for r in state.select(*columns).collect())
    keyed.start(spark, str(tmp_path / "in-x"), table, str(tmp_path / "ck-x")).awaitTermination()  # nothing new
    assert sorted(tuple(map(plain, r)) for r in table.read(spark).select(*columns).collect()) == got
    number = table.versions(spark)[-1]
    assert table.upsert(table.read(spark).limit(0), number) == []


def test_failures_wait_and_become_due(spark, tmp_path):
    changes = []
    batches = [
        [event("f", "failed", T(2024, 1, 1), reason="no_results"), event("g", "failed", T(2024, 1, 1), reason="x"), event("g", "failed", T(2024, 1, 2), reason="x"), event("g", "failed", T(2024, 1, 3), reason="y")],
        [event("h", "failed", T(2024, 1, 2)), event("h", "linked", T(2024, 1, 3), link="p")],
        [event("z", "seen", T(2024, 1, 20), 1.0, "In Stock")],
        [event("z", "seen", T(2024, 1, 21), 1.0, "In Stock")],
    ]
    table = run(spark, tmp_path, batches, lambda batch, _: changes.extend((r.url, r.change, plain(r.at)) for r in batch.collect()), "y")
    assert [c for c in changes if c[1] == "due"] == [("f", "due", T(2024, 1, 4))]  # g failed too often, h is linked
    state = {r.url: (r.attempts, r.reason, r.product_url) for r in table.read(spark).collect()}
    assert state == {"f": (1, "no_results", None), "g": (3, "y", None), "h": (0, None, "p"), "z": (0, None, None)}
