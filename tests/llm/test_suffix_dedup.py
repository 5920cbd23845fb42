import hashlib

import numpy as np
import pytest

from offerlake.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute_force(rows, width):
    """Per row (id, bytes, spans, kept bytes)."""
    first = {}
    order = lambda i: float("inf") if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in data:
        for j in range(len(raw) - width + 1):
            key = raw[j : j + width]
            first[key] = min(first.get(key, float("inf")), order(i))
    out = []
    for i, raw in data:
        gone = bytearray(len(raw))
        for j in range(len(raw) - width + 1):
            if first[raw[j : j + width]] < order(i):
                gone[j : j + width] = b"\1" * width
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((str(i), len(raw), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [2000, 1])
def test_odd_rows_against_brute_force(spark, hot_rows):
    base = "".join(chr(97 + i * i % 23) for i in range(90))
    rows = [(5, "xx" * 40 + base), (1, base + " one"), (1, base + " one"), (7, base[:19]), (3, None), (4, "")]
    rows += [(None, base), (8, "é🙂" * 20 + base + "\x00" * 30 + base), (9, "ab " * 2000), (10, "ab " * 2000)]
    rows += [(20 + i, f"{i * 977} {base[i % 7 : 60 + i % 5]} tail {i * i}") for i in range(40)]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, kept int, chunk string")
    got = suffix_dedup.remove_repeats(docs, width=20, gram=8, hot_rows=hot_rows).collect()
    assert sorted((str(r.doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == brute_force(rows, 20)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_force([(r.doc_id, r.text) for r in docs], 50)
    got = queries.op9_suffix_dedup(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_spans, r.n_bytes - r.n_removed, r.kept_sha256) for r in got) == [
        (i, n, spans, len(kept), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in want
    ]


def test_longest_previous_factors_against_brute_force():
    random = np.random.default_rng(5)
    contexts = [bytes(random.choice([97, 98, 0], n).astype(np.uint8)) for n in random.integers(6, 40, 60)]
    contexts += [b"abcabcabcabc", b"abcabcabcabc", b"a" * 30, b"a" * 6]
    ids = random.integers(0, 20, len(contexts))
    got = suffix_dedup.longest_previous_factors(contexts, ids, 6).tolist()
    suffixes = [(int(i), c[k : k + 6]) for c, i in zip(contexts, ids, strict=True) for k in range(len(c) - 5)]

    def common(a, b):
        return next((k for k in range(6) if a[k] != b[k]), 6)

    want = [max([common(s, t) for j, t in suffixes if j < i], default=0) for i, s in suffixes]
    assert got == want
