import hashlib

from offerlake.llm import queries, substring_dedup

SF = "/root/testdata/sf0.001"


def brute_force(rows, width):
    """Per row (id, kept words): remove words of windows that start in a smaller id."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    for i, words in split:
        for j in range(len(words) - width + 1):
            key = tuple(words[j : j + width])
            first[key] = min(first.get(key, float("inf")), order(i))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for j in range(len(words) - width + 1):
            if first[tuple(words[j : j + width])] < order(i):
                gone[j : j + width] = [True] * width
        out.append((str(i), len(words), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out)


def test_odd_rows_against_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [
        (5, "x " * 40 + base),
        (1, base + " tail of the first"),
        (1, base + " tail of the first"),
        (7, base[:60]),
        (3, None),
        (4, ""),
        (None, base),
        (8, "a b c " + base + "\r\n\x0b" + base),
        (9, "ab " * 3000),
        (10, "ab " * 3000),
        (11, "the " + base + " end"),
    ]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, kept int, chunk string")
    got = substring_dedup.remove_repeated_windows(docs, width=12, gram=6).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == brute_force(rows, 12)
    assert substring_dedup.remove_repeated_windows(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_force([(r.doc_id, r.text) for r in docs], 50)
    got = queries.op10_substring_dedup(spark, SF).collect()
    sha = lambda kept: hashlib.sha256(kept.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_words, r.n_words - r.n_removed, r.kept_sha256) for r in got) == [
        (i, n, len(kept.split()), sha(kept)) for i, n, kept in want
    ]
