import random

import pytest

from offerlake.llm import jaccard_join as jj
from offerlake.llm import queries

SF = "/root/testdata/sf0.01"


def grams(text, n=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_force(rows, threshold=0.8):
    """Per row: id, class, links, copies; candidates by a shared n-gram."""
    sets = [grams(t) if i is not None else set() for i, t in rows]
    holders = {}
    for at, own in enumerate(sets):
        for g in own:
            holders.setdefault(g, []).append(at)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    out = []
    linked = []
    for at, own in enumerate(sets):
        near = {o for g in own for o in holders[g]} - {at}
        links = [o for o in near if len(own & sets[o]) >= threshold * len(own | sets[o]) - 1e-9]
        linked.append(links)
        for o in links:
            a, b = find(at), find(o)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for at, (i, _) in enumerate(rows):
        groups.setdefault(find(at), []).append(i)
    for at, (i, _) in enumerate(rows):
        ids = [x for x in groups[find(at)] if x is not None]
        out.append((i, min(ids) if ids else None, len(linked[at]), sum(sets[o] == sets[at] for o in linked[at]) + 1))
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaf", "block"), [(64, 512), (4, 5)])
def test_odd_rows_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "one two three four five six"), (4, "two words"), (5, "two  words"), (6, "two")]
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, " ".join(f"{i}u{rng.randrange(999)}" for _ in range(30))) for i in range(20)]
    rows += [(300, "long " * 20_000), (301, "long " * 20_000), (300, "long " * 20_000), (7, rows[50][1]), (7, "other text of the same id here")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, class_id string")
    got = jj.similarity_classes(docs, leaf=leaf).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=str) == brute_force(rows)
    assert jj.similarity_classes(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op2_jaccard_join(spark, SF).collect()
    want = brute_force([(r.doc_id, r.text) for r in docs])
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=str) == want
    assert any(r[2] > 1 for r in want)


def test_runs_reach_the_recall():
    assert jj.runs_for(0.8, 0.5) == 1 and jj.runs_for(0.8, 0.9999) > jj.runs_for(0.8, 0.99) > 0
