import corpus_pipeline as cp
from test_decontamination import grams as item_grams
from test_jaccard_join import brute_force as similar
from test_suffix_dedup import brute_force as repeats

SF = "/root/testdata/sf0.001"


def expected(rows, items):
    """The rows that each stage keeps, as (id, text), by brute force."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    yield rows
    keep = {i for i, least, _, _ in similar(rows) if i == least}
    rows = list(dict.fromkeys((i, t) for i, t in rows if i in keep))
    yield rows
    rows = [(int(i), kept.decode(errors="ignore")) for i, _, _, kept in repeats(rows, 50) if kept.decode(errors="ignore")]
    yield rows
    sought = [s for s in (item_grams(t, 5) for t in items) if s]
    rows = [(i, t) for i, t in rows if all(len(s & item_grams(t, 5)) < 0.8 * len(s) for s in sought)]
    yield rows
    yield rows


def check(spark, docs, items, sf_dir):
    counts = []
    for (name, stage), want in zip(cp.STAGES, expected([(r.doc_id, r.text) for r in docs.collect()], items), strict=True):
        docs = stage(spark, docs, sf_dir).cache()
        if name != cp.STAGES[-1][0]:
            assert tuple(docs.columns) == cp.COLUMNS
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
        counts.append(len(want))
    return counts


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    extra = [
        (-5, None, "en", "s", 0),
        (-4, "", "en", "s", 0),
        (-3, "12 34 --", "en", "s", 8),
        (-2, "the " + items[0], "en", "s", 9),
        (-1, docs.head().text, None, None, None),
        (-1, docs.head().text, None, None, None),
    ]
    counts = check(spark, docs.union(spark.createDataFrame(extra, docs.schema)), items, SF)
    assert counts[0] > counts[1] > counts[3]


def test_run(spark):
    result = cp.run(spark, SF)
    assert result.columns == ["doc_id", "n_tokens", "ids", "text"] and result.count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
