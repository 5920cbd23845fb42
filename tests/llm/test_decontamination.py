import re

import harness

from offerlake.llm import decontamination, queries, tables

SF = "/root/testdata/sf0.001"


def grams(text, n):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_odd_rows_against_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(25))
    items = [(1, item), (2, "two words"), (3, None), (4, ""), (None, item), (5, "a b c d e f g h i j"), (1, item)]
    docs = [
        (10, "x " * 20_000 + item.upper() + "! y" * 500),
        (11, item.replace(" ", ", ", 9)),
        (11, item),
        (12, " ".join(item.split()[:21])),
        (13, " ".join(item.split()[:23])),
        (14, "Two -- words."),
        (15, "two words more"),
        (16, None),
        (17, ""),
        (None, item),
        (18, "a b c d e f g h " + "i j " * 3),
    ]
    left = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")

    def held(x, y):
        n = min(5, len([w for w in re.split(r"[\W_]+", (y or "").lower()) if w]))
        own, sought = grams(x, n) if n else set(), grams(y, n) if n else set()
        return len(own & sought) / len(sought) if sought else 0.0

    want = {(d, i, held(x, y)) for d, x in docs for i, y in items if d and i and held(x, y) >= 0.8}
    assert {(14, 2, 1.0), (15, 2, 1.0)} <= want  # short items lie in longer documents, too
    found = decontamination.find_contained(left, right)
    assert {tuple(r) for r in found.collect()} == want and len(want) >= 5
    assert decontamination.find_contained(left.limit(0), right).count() == 0
    assert decontamination.find_contained(left, right.limit(0)).count() == 0


def test_least_words(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "two words"), (3, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "yes, two words; one two three four five six")], "doc_id long, text string")
    found = lambda least: sorted(r.item_id for r in decontamination.find_contained(docs, items, least_words=least).collect())
    assert found(1) == [1, 2, 3] and found(2) == [2, 3] and found(5) == [3]


def test_many_items_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    harness.assert_same(spark, queries.op6_decontamination, queries.OP6_SQL, SF)


def test_every_size_class_has_enough_probes(spark):
    items = spark.range(1, 300).selectExpr("id AS item", "cast(id AS int) AS n_shingles", "sequence(1L, id) AS shingles")
    for row in decontamination.probes(items, 0.8, 1e-6).groupBy("item").count().collect():
        assert row["count"] >= min(9, row.item - -(-row.item * 8 // 10) + 1)
