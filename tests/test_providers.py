"""Numbering by ranges, and providers under a day's budget."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlake.operators import providers
from offerlake.operators.order import numbered
from offerlake.sources import answers

DAY = datetime.date(2026, 1, 2)


def test_numbers_over_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 5003).alias("v"), F.when(F.col("id") % 3 != 0, F.col("id") % 5 % 4).alias("g"))
    rows = df.collect()
    want = {r.id: i for i, r in enumerate(sorted(rows, key=lambda r: -r.v))}
    assert {r.id: r.nth for r in numbered(df, F.desc("v")).collect()} == want
    got = numbered(df, F.desc("v"), F.col("id"), within="g", name="place").collect()
    for group in (None, 0, 1, 2, 3):
        inside = sorted((r for r in rows if r.g == group), key=lambda r: -r.v)
        assert [r.id for r in sorted((r for r in got if r.g == group), key=lambda r: r.place)] == [r.id for r in inside]
        assert sorted(r.place for r in got if r.g == group) == list(range(len(inside)))
    assert numbered(df.limit(0), F.col("v")).count() == 0


def echo(bad=None):
    """A provider that answers with what it was asked, and refuses batches that hold a word."""

    class Echo(providers.Provider):
        name, ready = "echo", False

        def open(self):
            self.ready = True

        def extract(self, batch):
            assert self.ready
            if bad and batch["title"].str.contains(bad).any():
                raise RuntimeError("refused")
            return '{"brewery_name_en": "' + batch["maker"] + '"}'

        def suggest(self, batch):
            return pd.Series(["{}"])  # too few

        infer = choose = extract

    return Echo()


def requests(spark, n=100):
    return spark.range(0, n, 1, 6).select(
        F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("title "), "id").alias("title"), F.concat(F.lit("m"), "id").alias("maker"),
        F.lit("s").alias("shop"), F.lit("n").alias("name"), F.lit("[]").alias("candidates"), (-F.col("id")).alias("rank"),
    )


def test_budget_and_order(spark):
    usage = spark.createDataFrame([("echo", DAY, 970), ("echo", datetime.date(2026, 1, 1), 999), ("other", DAY, 5)], "service string, day date, requests long")
    day = F.lit(DAY)
    got, after = providers.ask(requests(spark), "extract", echo(), F.col("rank"), usage=usage, day=day, budget=1000)
    asked = {r.url for r in got.collect() if r.asked}
    assert asked == {f"u{i}" for i in range(70, 100)} and got.count() == 100
    read = answers.read_answers(got.where("asked"))
    assert {r.producer_en for r in read.collect()} == {f"m{i}" for i in range(70, 100)}
    assert {tuple(r) for r in after.collect()} == {("echo", DAY, 1000), ("echo", datetime.date(2026, 1, 1), 999), ("other", DAY, 5)}
    none, same = providers.ask(requests(spark), "extract", echo(), F.col("rank"), usage=after, day=day, budget=1000)
    assert none.where("asked OR answer IS NOT NULL").count() == 0
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in after.collect()}


def test_faults_are_reasons(spark):
    got, after = providers.ask(requests(spark, 20), "extract", echo("title 3$"), day=F.lit(DAY))
    bad = [r for r in got.collect() if r.error]
    assert "u3" in {r.url for r in bad} and {r.error for r in bad} == {"RuntimeError: refused"} and {r.answer for r in bad} == {None}
    assert [tuple(r) for r in after.collect()] == [("echo", DAY, 20)]
    short, _ = providers.ask(requests(spark, 20), "suggest", echo())
    assert short.where("error LIKE 'ValueError%'").count() == 20
    with pytest.raises(ValueError):
        providers.ask(requests(spark), "guess", echo())


def test_table_of_answers(spark):
    table = spark.createDataFrame([("choose", "u1", "a"), ("choose", "u1", "b"), ("infer", "u2", "c")], "kind string, url string, answer string")
    got, after = providers.ask(requests(spark, 3), "choose", providers.TableProvider(table), F.col("rank"), day=F.lit(DAY), budget=2)
    assert {(r.url, r.answer, r.asked) for r in got.collect()} == {("u0", None, False), ("u1", "b", True), ("u2", None, True)}
    assert [tuple(r) for r in after.collect()] == [("table", DAY, 2)]
    empty, none = providers.ask(requests(spark, 0), "choose", providers.TableProvider(table), day=F.lit(DAY))
    assert empty.count() == 0 and none.count() == 0
