"""Substring dedup: remove the words of repeated 50-word windows, keeping the first copy.

Two Rabin-Karp hashes, 128 bits together, name every window of `width` words that can
repeat; Spark counts them and finds the first document of each; the windows of later documents merge into maximal
runs, which are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm import shared_windows as sw
from offerlake.llm.tables import chunked

_FOUND = "window long, check long, settled boolean, id long, chunk int, doc int, start int, stop int"
_SCHEMA = "id long, n_words long, spans array<struct<start:int,end:int>>, kept string"


def _windows(docs: pa.Table, answers: pa.Table, width: int, gram: int, buckets: int) -> pa.Table:
    """A chunk's candidate windows: those settled here as ranges, the others by hash."""
    chunk = docs["chunk"][0].as_py() if len(docs) else 0
    run, hashes = sw.candidate_runs(docs, answers, True, width, gram, buckets)
    nth = np.repeat(np.arange(len(run["count"])), run["count"])
    ids, doc = run["id"][nth], run["doc"][nth]
    start = run["start"][nth] + np.arange(len(nth)) - np.repeat(np.cumsum(run["count"]) - run["count"], run["count"])
    later = ids > sw.first_holder(list(hashes), ids)
    here = np.flatnonzero(later)
    new = np.ones(len(here), bool)  # neighbouring settled windows go as one range
    new[1:] = (doc[here][1:] != doc[here][:-1]) | (start[here][1:] != start[here][:-1] + 1)
    first = here[new]
    last = here[np.append(np.flatnonzero(new)[1:] - 1, len(here) - 1)] if len(here) else here
    rest = np.flatnonzero(~later)
    n, m = len(first), len(rest)
    place = sw.mix((doc[first] << 32 | start[first]).astype(np.uint64))
    both = np.concatenate([first, rest])
    columns = [
        *(np.concatenate([place, own[rest]]).view(np.int64) for own in hashes),
        np.concatenate([np.ones(n, bool), np.zeros(m, bool)]),
        ids[both],
        np.full(n + m, chunk, np.int32),
        doc[both].astype(np.int32),
        start[both].astype(np.int32),
        (np.concatenate([start[last], start[rest]]) + 1).astype(np.int32),
    ]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _FOUND.split(", ")])


def _remove(docs: pa.Table, flags: pa.Table, width: int) -> pa.Table:
    ordered, _, texts = sw.in_order(docs)
    removed = sw.by_document(flags, width)
    n_words, spans, kept = [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        n_words.append(len(words))
        starts, ends = removed.get(i, ((), ()))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
        for a, b in zip(starts[::-1], ends[::-1], strict=True):
            del words[a:b]
        kept.append(b" ".join(words).decode())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.Table.from_arrays(
        [ordered["id"], pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
        names=["id", "n_words", "spans", "kept"],
    )


def remove_repeated_windows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    gram: int = 25,
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Returns one row
    per input row: `id_col`, `n_words`, `spans` (removed runs of words, end exclusive) and
    `kept` (the kept words joined by one space). Windows are judged on the input. Texts
    that are null, empty or shorter than `width` words lose nothing; rows with equal ids
    are no copies of each other, and a null id counts as greater than all; other columns
    are ignored.
    """
    rows, buckets = chunked(sw.read_chunks(docs, id_col, text_col), "id", "text", chunk_bytes, 64)
    answers = sw.shared_anchors(rows, True, width, gram, buckets)
    found = (
        rows.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(lambda docs, shared: _windows(docs, shared, width, gram, buckets), _FOUND)
    )
    equal = Window.partitionBy("window", "check", "settled")
    flags = (
        found.withColumn("first", F.min("id").over(equal))
        .where(F.col("settled") | (F.col("id") > F.col("first")))
        .select("chunk", "doc", "start", "stop")
    )
    result = (
        rows.groupBy("chunk")
        .cogroup(flags.groupBy("chunk"))
        .applyInArrow(lambda docs, flags: _remove(docs, flags, width), _SCHEMA)
    )
    return result.withColumnRenamed("id", id_col)
