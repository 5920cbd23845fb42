"""Joins over rows that repeat: classes meet, pairs are written out last and travel nowhere."""

import duckdb
import pyspark.sql.functions as F

import __spark_entry__
from offerlake.operators import blocking, classes, linkage


def above_the_pairs(frame) -> str:
    """The plan's steps above the one that writes the pairs out."""
    return frame._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(")[0]


def test_blocked_pairs_are_written_out_last(spark):
    rows = spark.range(5000).select(F.col("id").alias("url"), F.lit(1).alias("block"), F.array(F.lit("hot"), F.when(F.col("id") % 2 == 0, "ring").otherwise("bolt")).alias("words"))
    pairs = blocking.pairs_by_word(rows.where("url % 100 = 0"), rows.withColumnRenamed("url", "product"), "url", "product")
    assert pairs.columns == ["url", "block", "product"]
    assert pairs.select("url", "product").distinct().count() == pairs.count() == 50 * 5000
    assert "Join" not in above_the_pairs(pairs) and "Aggregate" not in above_the_pairs(pairs)


def test_a_task_does_not_hold_all_rows_of_a_pair_of_arrays(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        members = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(-i).alias("less")) for i in (1, 2)), F.struct(F.lit(None).cast("int").alias("id"), F.lit(0).alias("less")))
        keys = F.transform(members, lambda m: F.struct(m["id"].alias("key")))
        pairs = classes.written_out(spark.range(1).select("id", members.alias("l"), keys.alias("r")), "l", "r")
        plan = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {(r["id"], r["l"]["id"], r["l"]["less"], r["r"]["key"]) for r in pairs.collect()} == {(0, i, less, k) for i, less in ((1, -1), (2, -2), (None, 0)) for k in (1, 2, None)}
    steps = [line for line in plan if "Generate explode" in line]
    assert len(steps) == 2 and "*(" in steps[0] and "*(" not in steps[1]  # of the left side, it is no part of generated code


def test_hot_words_count_classes(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PIECE", 2)
    rows = spark.range(50).select(F.lit(1).alias("block"), F.array(F.lit("ipa"), F.when(F.col("id") < 25, "a").otherwise("b")).alias("words"))
    assert blocking._pieces(rows, rows).count() == 0  # 50 rows, two classes


def test_every_part_asks_for_its_pairs(spark):
    sf = "/root/testdata/sf0.001"
    frame = __spark_entry__.queries()["blocked_pairs"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("url"))
    assert frame.select("url").distinct().count() == parts.count()
    assert frame.where("url = product_url").count() == parts.count()  # each has at least itself


def test_retrieved_pairs_are_written_out_last(spark):
    offers = spark.range(300).select(F.col("id").alias("url"), F.lit("Maker").alias("maker"), F.lit("Hot Ring").alias("name"), F.lit(None).cast("string").alias("name_jp"))
    names = F.when(F.col("id") < 4, "hot ring").when(F.col("id") < 1500, "hot bolt").otherwise("cold bolt")
    goods = spark.range(2000).select(F.col("id").alias("product_url"), names.alias("product_name"), F.lit("Maker Brewing").alias("producer_name"))
    few = linkage.retrieve(offers, goods)  # four by name are too few, so tokens count
    assert few.groupBy("stage").count().orderBy("stage").collect() == [(1, 1200), (3, 300 * 1496)]
    more = linkage.retrieve(offers, goods.withColumn("product_name", F.when(F.col("product_url") < 5, "hot ring").otherwise(F.col("product_name"))))
    assert more.groupBy("stage").count().collect() == [(1, 1500)]
    assert "Join" not in above_the_pairs(few) and "Aggregate" not in above_the_pairs(few)


def test_probes_and_keys_are_made_once_a_class(spark, monkeypatch):
    offers = spark.range(300).select((F.col("id") % 299).alias("url"), F.lit("Maker").alias("maker"), F.when(F.col("id") == 299, "Cold Bolt").otherwise("Hot Ring").alias("name"), F.lit(None).cast("string").alias("name_jp"))
    names = F.when(F.col("id") < 9, "hot ring").otherwise("cold bolt")
    goods = spark.range(2000).select(F.col("id").alias("product_url"), names.alias("product_name"), F.lit("Maker Brewing").alias("producer_name"))
    kept, numbers = linkage.checkpointed, []
    monkeypatch.setattr(linkage, "checkpointed", lambda df: numbers.append(df.count()) or kept(df))
    found = linkage.retrieve(offers, goods)
    assert numbers == [2, 2]  # of 299 offers, one of which has two names, and of 2,000 products
    assert found.groupBy("stage").count().collect() == [(1, 299 * 9 + 1991)]


def test_offline_links_meet_by_distinct_names(spark):
    rows = spark.range(3000).select(F.col("id").alias("url"), F.lit("Maker").alias("maker"), F.lit("Hot Ring").alias("name"))
    goods = rows.select(F.col("url").alias("product_url"), F.lower("name").alias("product_name"), F.lit("THE MAKER").alias("producer_name"))
    found = linkage.link_offline(rows, goods)
    assert found.groupBy("product_url").count().collect() == [(0, 3000)]
    joins = found._jdf.queryExecution().optimizedPlan().toString().split("Join")
    assert all("Aggregate" in below for below in joins[1:])  # nothing is joined before its repeats are gone


def test_four_digits_within_a_code_are_no_vintage(spark):
    title = spark.createDataFrame([("n1a2019bc8 ale",), ("n120193 ale",), ("ale 2019年",), ("ale 2019BY",)], "t string")
    got = title.select(linkage.validated(F.col("t"), F.lit("Ale 2019"), F.lit("Ale"), F.lit("Maker")))
    assert [r[0] for r in got.collect()] == [False, False, True, True]


def test_runs_over_digests_that_hold_a_year(spark, tmp_path):
    part = spark.createDataFrame([(61518, "hot ring", "Brand#7", "LARGE", 1, 1.0), (6, "hot ring", "Brand#7", "LARGE", 2, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("link_run", "link_ledger"):
        query, sql = __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]
        frame = query(spark, str(tmp_path))
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
        theirs = connection.execute(f"SELECT {', '.join(frame.columns)} FROM ({sql}) ORDER BY url").fetchall()
        assert [tuple(r) for r in frame.orderBy("url").collect()] == theirs


def test_offers_of_the_same_name_are_scored_once(spark, monkeypatch):
    offers = spark.range(2000).select(F.col("id").cast("string").alias("url"), F.lit("Maker").alias("maker"), F.lit("Hot Ring").alias("name"))
    goods = spark.createDataFrame([("/b/1", "Hot Ring", "Maker", "Ale"), ("/b/2", "Hot Bolt", "Maker", "Ale")], "product_url string, product_name string, producer_name string, style string")
    whole, asked = linkage.candidates, []
    monkeypatch.setattr(linkage, "candidates", lambda wanted, *rest: asked.append(wanted.count()) or whole(wanted, *rest))
    found = linkage.link(offers, goods)
    assert found.groupBy("product_url", "score", "reason").count().collect() == [("/b/1", 100, None, 2000)]
    assert asked == [1]


def test_variants_are_looked_for_once(spark):
    rows = spark.createDataFrame([("a", "p", "Ring Mango BA", "Ring")], "url string, product_url string, name string, product_name string")
    wrong = linkage.wrong_variants(rows)
    assert wrong.collect() == [("a", "p", "barrelaged,mango", "")]
    plan = wrong._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bourbon barrel aged") <= 4  # one chain of replacements a name


def test_small_files_are_dealt_over_all_tasks(spark):
    for name in ("product_pages", "wrong_variants", "html_offers", "suggested_queries", "text_rules"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 8, true" in plan, name


def test_a_scan_reads_its_pages_once(spark):
    frame = __spark_entry__.queries()["scan_state"](spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_searched_by_one_worker_of_a_task(spark):
    for name in ("extract_faults", "extract_offers"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("EvalPython") == 1, (name, plan.count("EvalPython"))
