import math
import re
from collections import Counter

import numpy as np
import pytest

from offerlake.llm import queries, ranked_search

SF = "/root/testdata/sf0.001"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute_force(docs, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = lambda text: Counter(re.findall(TERM, (text or "").translate(lower)))
    found = [(i, count(t)) for i, t in docs]
    sizes = [c.total() for _, c in found]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for (i, c), n in zip(found, sizes, strict=True):
            score = 0
            for t, q in count(text).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += q * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * n * n_docs) // n_terms)))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, nth + 1, None if none else i, -s) for nth, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(queries.op12_ranked_search(spark, SF)) == brute_force(docs, items, 10)


def odd_tables(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[(i * j) % 60] for j in range(1 + i % 23))) for i in range(700)]
    docs += [(i, "same text again") for i in range(1000, 1400)]
    docs += [(5, "same text again"), (None, "same text"), (None, "w1 W1, w2"), (2000, None), (2001, ""), (2002, "... !"), (2003, "ÄB ab été 日本"), (2004, "w3 " * 50_000)]
    items = [(1, "w1 w2 w2 W3"), (2, "same same"), (3, None), (4, ""), (5, "nowhere"), (6, "AB äb 日本"), (7, "w9"), (7, "w9"), (7, "w10"), (None, "w4 again"), (8, " ".join(words) * 2)]
    return (
        docs,
        items,
        spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, terms string, score int").repartition(5),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"),
    )


@pytest.mark.parametrize("k", [1, 10, 450])
def test_odd_rows_against_brute_force(spark, monkeypatch, k):
    docs, items, docs_df, items_df = odd_tables(spark)
    # an id with two texts is ranked twice, under one id
    assert got(ranked_search.search(docs_df, items_df, k=k)) == brute_force(docs, items, k)


def test_blocks_of_items(spark):
    docs, items, docs_df, items_df = odd_tables(spark)
    assert got(ranked_search.search(docs_df, items_df, k=5, block_bytes=200)) == brute_force(docs, items, 5)


def test_empty_tables(spark):
    _, _, docs, items = odd_tables(spark)
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_treaps_are_trees_in_both_orders():
    random = np.random.default_rng(3)
    term, ordinal = np.repeat(np.arange(4), 300), np.concatenate([random.choice(2000, 300, replace=False) for _ in range(4)])
    treaps = ranked_search.Treaps(term, ordinal, random.integers(1, 5, 1200), 2000)

    def below(node):
        if node < 0:
            return []
        left, right = treaps.left[node], treaps.right[node]
        assert all(treaps.impact[c] <= treaps.impact[node] for c in (left, right) if c >= 0)
        return [*below(left), int(treaps.ordinal[node]), *below(right)]

    for t, root in treaps.roots.items():
        assert below(root) == sorted(ordinal[term == t].tolist())
        for first, end in ((0, 2000), (500, 700), (1999, 2000), (10, 10)):
            here = treaps.descend(np.array([root]), first, end)[0]
            inside = treaps.impact[(treaps.term == t) & (treaps.ordinal >= first) & (treaps.ordinal < end)]
            assert (treaps.impact[here] == inside.max()) if len(inside) else here == -1


def test_walk_prunes():
    """One document holds the rare term: few of the intervals are scored."""
    n = 16_000
    term = np.append(np.zeros(n, np.int64), 1)
    treaps = ranked_search.Treaps(term, np.append(np.arange(n), 77), np.append(np.full(n, 10), 900_000), n)
    best = ranked_search.Best(1)
    assert ranked_search.walk(treaps, list(range(n)), {0: 1, 1: 5}, best) <= 2
    assert best.found == [(5 * 900_000 + 10, 77)]
