"""Suffix-array dedup: remove byte strings that an earlier document has, keeping the first.

The longest previous factor of a suffix is the longer of its matches with the previous
and the next suffix, in suffix order, that lie in an earlier document. A byte is removed
if a suffix with a factor of at least `width` bytes covers it. Suffixes that share no
anchor (see `shared_windows`) share no `width` bytes, so they need not meet: each anchor's
suffixes are one block, with an order and an array of factors of its own.

Copies are settled before: runs of windows that are equal as a whole, by their anchor and
a second 64-bit hash, are one context, which the first document holds and every later one
repeats. Each context's bytes travel once, to their anchor's block. An anchor of more than
`hot_rows` contexts, such as at the end of a passage that many documents quote, is split
into one block for each `width` bytes that a suffix begins with, so no block grows with
the corpus; suffixes with equal `width` bytes still meet, and results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm import shared_windows as sw
from offerlake.llm.tables import chunked, parallelism

_RUNS = "anchor long, settled boolean, context long, id long, chunk int, doc int, start int, stop int"
_SOUGHT = "place long, id long, chunk int, doc int, start int, stop int, context binary"
_SCHEMA = "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
#: Rows that one suffix sort takes, where groups allow it: some 20 MB of suffixes, and as much for comparing them.
_SORTED_ROWS = 5_000
#: Suffixes whose bytes are spread out at once.
_AT_ONCE = 1 << 15


def _table(schema: str, columns: list) -> pa.Table:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.Table.from_arrays(arrays, names=[field.split()[0] for field in schema.split(", ")])


def _ranges(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Merge ranges that touch or overlap within a document."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    reach = np.maximum.accumulate(doc.astype(np.int64) << 40 | stop[order].astype(np.int64))
    new = np.concatenate([[True], (doc[1:].astype(np.int64) << 40 | start[1:].astype(np.int64)) > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], start[new], reach[last] & ((1 << 40) - 1)


def _runs(docs: pa.Table, answers: pa.Table, width: int, gram: int, buckets: int) -> pa.Table:
    """A chunk's candidate runs: those settled here as ranges, the others by hash."""
    chunk = docs["chunk"][0].as_py() if len(docs) else 0
    run, _ = sw.candidate_runs(docs, answers, False, width, gram, buckets)
    stop = run["start"] + run["count"]
    later = run["id"] > sw.first_holder([run["context"], run["anchor"]], run["id"])
    doc, start, end = _ranges(run["doc"][later], run["start"][later], stop[later])
    n, rest = len(doc), ~later
    m = int(rest.sum())
    own = sw.mix(doc.astype(np.uint64) << np.uint64(32) | start.astype(np.uint64))
    columns = [
        np.concatenate([own, run["anchor"][rest].astype(np.uint64)]).view(np.int64),
        np.concatenate([np.ones(n, bool), np.zeros(m, bool)]),
        np.concatenate([np.zeros(n, np.uint64), run["context"][rest].astype(np.uint64)]).view(np.int64),
        np.concatenate([np.zeros(n, np.int64), run["id"][rest]]),
        np.full(n + m, chunk, np.int32),
        *(np.concatenate(c).astype(np.int32) for c in ((doc, run["doc"][rest]), (start, run["start"][rest]), (end, stop[rest]))),
    ]
    return _table(_RUNS, columns)


def _hot_windows(texts: list[bytes], ids: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Windows that travel one by one: a hash of each one's bytes, whether an earlier document of the chunk has them, the bytes."""
    ends = np.cumsum([0, *map(len, texts)])
    data, at = np.frombuffer(b"".join(texts), np.uint8), ends[doc] + start
    powers = sw.mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    windows, place = np.empty((len(at), width), np.uint8), np.empty(len(at), np.uint64)
    for i in range(0, len(at), _AT_ONCE):
        part = windows[i : i + _AT_ONCE] = data[at[i : i + _AT_ONCE, None] + np.arange(width)]
        place[i : i + _AT_ONCE] = sw.mix((sw.byte_symbols()[part] * powers).sum(axis=1, dtype=np.uint64))
    later = np.zeros(len(at), bool)
    order = np.argsort(place, kind="stable")
    first = 0
    while first < len(order):  # some whole groups of equal hashes at a time
        end = int(np.searchsorted(place, place[order[min(first + 4 * _AT_ONCE, len(order)) - 1]], side="right", sorter=order))
        some = order[first:end]
        later[some] = _factors(windows[some], ids[doc[some]]) >= width
        first = end
    return place.view(np.int64), later, windows


def _binary(windows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow array."""
    n, width = windows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(windows))])


def _contexts(docs: pa.Table, asked: pa.Table, width: int) -> pa.Table:
    """Fetch the bytes of the runs that were asked for; pass on what is settled."""
    chunk = docs["chunk"][0].as_py() if len(docs) else 0
    _, ids, texts = sw.in_order(docs)
    doc, start, stop = (asked[c].to_numpy() for c in ("doc", "start", "stop"))
    flagged, hot = (asked[c].to_numpy(zero_copy_only=False) for c in ("flagged", "hot"))
    place = asked["anchor"].to_numpy()
    whole = np.flatnonzero(~flagged & ~hot)
    windows = np.flatnonzero(~flagged & hot)
    context = [texts[d][a : b + width - 1] for d, a, b in zip(doc[whole], start[whole], stop[whole], strict=True)]
    counts = (stop - start)[windows]
    one_doc = np.repeat(doc[windows], counts)
    one_start = np.repeat(start[windows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    one_place, later, one = _hot_windows(texts, ids, one_doc, one_start, width)
    done_doc, done_start, done_stop = _ranges(
        np.concatenate([doc[flagged], one_doc[later]]),
        np.concatenate([start[flagged], one_start[later]]),
        np.concatenate([stop[flagged], one_start[later] + 1]),
    )
    keep = np.flatnonzero(~later)
    done_place = sw.mix(done_doc.astype(np.uint64) << np.uint64(32) | done_start.astype(np.uint64)).view(np.int64)
    docs_of = np.concatenate([done_doc, doc[whole], one_doc[keep]]).astype(np.int32)
    columns = [
        np.concatenate([done_place, place[whole], one_place[keep]]),
        ids[docs_of] if len(docs_of) else np.zeros(0, np.int64),
        np.full(len(docs_of), chunk, np.int32),
        docs_of,
        np.concatenate([done_start, start[whole], one_start[keep]]).astype(np.int32),
        np.concatenate([done_stop, stop[whole], one_start[keep] + 1]).astype(np.int32),
        pa.concat_arrays([pa.nulls(len(done_doc), pa.binary()), pa.array(context, pa.binary()), _binary(one[keep])]),
    ]
    return _table(_SOUGHT, columns)


def nearest_smaller(positions: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Length shared with the previous entry, in suffix order, of a smaller position; 0 without one.

    `factors` holds what each suffix shares with the one before it. Every entry looks at its
    neighbour first and jumps on to where that one looks, until it finds a smaller position:
    all in between are as great as those it has jumped over.
    """
    n = len(positions)
    at, shared = np.arange(-1, n - 1), factors.copy()
    seeking = np.flatnonzero((at >= 0) & (positions[at] >= positions))
    while len(seeking):
        over = at[seeking]
        shared[seeking] = np.minimum(shared[seeking], shared[over])
        at[seeking] = at[over]
        seeking = seeking[(at[seeking] >= 0) & (positions[at[seeking]] >= positions[seeking])]
    shared[at < 0] = 0
    return shared


def longest_previous_factors(contexts: list[bytes], ids: np.ndarray, width: int) -> np.ndarray:
    """For every suffix of at least `width` bytes, end to end: the longest prefix, up to `width`
    bytes, that it shares with a suffix of a document with a smaller id.

    The suffix array and its array of common prefixes are made by sorting the first `width`
    bytes of all suffixes. In that order the nearest entries of smaller documents before and
    after a suffix, the previous and the next smaller position, have its longest match.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    counts = sizes - (width - 1)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return _factors(np.lib.stride_tricks.sliding_window_view(data, width)[at], np.repeat(ids, counts))


def _factors(suffixes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The longest previous factor of each row of bytes, by its document."""
    n, width = suffixes.shape
    if not n:
        return np.zeros(0, np.int32)
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}").ravel(), kind="stable")
    common = np.zeros(n, np.int32)
    for i in range(0, n - 1, _AT_ONCE):
        part = suffixes[order[i : i + _AT_ONCE + 1]]
        differ = part[1:] != part[:-1]
        common[i + 1 : i + 1 + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    positions = ids[order]
    before = nearest_smaller(positions, common)
    after = nearest_smaller(positions[::-1], np.append(common[1:], 0)[::-1])[::-1]
    found = np.empty(n, np.int32)
    found[order] = np.maximum(before, after)
    return found


def has_previous_factor(contexts: list[bytes], ids: np.ndarray, width: int) -> np.ndarray:
    """For every suffix of at least `width` bytes: is its longest previous factor of that length?"""
    return longest_previous_factors(contexts, ids, width) >= width


def _settle(rows: pa.Table, width: int) -> pa.Table:
    """Flag the windows of a set of whole anchors."""
    sought = rows["context"].is_valid().to_numpy() if len(rows) else np.zeros(0, bool)
    done, rows = rows.filter(pa.array(~sought)), rows.filter(pa.array(sought))
    names = ["chunk", "doc", "start", "stop"]
    if not len(rows):
        return done.select(names)
    contexts, ids = rows["context"].to_pylist(), rows["id"].to_numpy()
    found = has_previous_factor(contexts, ids, width)
    counts = (rows["stop"].to_numpy() - rows["start"].to_numpy()).astype(np.int64)
    nth = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(nth)) - np.repeat(np.cumsum(counts) - counts, counts)
    row, at = nth[found], within[found]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(row) - 1) if len(row) else first
    part = rows.take(pa.array(row[first]))
    begin = part["start"].to_numpy()
    fresh = pa.Table.from_arrays(
        [part["chunk"], part["doc"], pa.array((begin + at[first]).astype(np.int32)), pa.array((begin + at[last] + 1).astype(np.int32))],
        names=names,
    )
    return pa.concat_tables([done.select(names), fresh])


def _settle_all(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Settle rows sorted by place, as many whole groups at a time as fit."""
    held: pa.Table | None = None
    for batch in (whole.slice(i, _SORTED_ROWS) for whole in batches for i in range(0, len(whole), _SORTED_ROWS)):
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if len(held) < _SORTED_ROWS:
            continue
        places = held["place"].to_numpy()
        cut = int(np.searchsorted(places, places[-1]))
        if cut:
            yield from _settle(held.slice(0, cut), width).to_batches()
            held = held.slice(cut)
    if held is not None and len(held):
        yield from _settle(held, width).to_batches()


def _remove(docs: pa.Table, flags: pa.Table, width: int) -> pa.Table:
    ordered, _, texts = sw.in_order(docs)
    removed = sw.by_document(flags, width)
    spans, kept = [], []
    for i, text in enumerate(texts):
        starts, ends = removed.get(i, ((), ()))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
        edges = [0, *(int(x) for pair in zip(starts, ends, strict=True) for x in pair), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    sizes = pa.array(list(map(len, texts)), pa.int64())
    columns = {"id": ordered["id"], "n_bytes": sizes, "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}
    if "rest" in ordered.column_names:
        columns["rest"] = ordered["rest"]
        columns["kept_text"] = pa.array([k.decode("utf-8", errors="ignore") for k in kept], pa.string())
    return pa.table(columns)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    gram: int = 20,
    chunk_bytes: int = 8 << 20,
    hot_rows: int = 2000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Remove every byte covered by a `width`-byte string that starts in a document with a smaller id.

    Returns one row per input row: `id_col`, `n_bytes` (UTF-8), `spans` (maximal removed
    runs of bytes, end exclusive) and `kept` (the other bytes). Strings are judged on the
    input and never cross documents. Texts that are null, empty or shorter than `width`
    bytes lose nothing; rows with equal ids are no copies of each other, and a null id
    counts as greater than all; other columns are ignored. With columns named in `keep`
    the result has them too, after `kept_text`: the kept bytes as text, without the bytes
    of characters that were cut.
    """
    rows, buckets = chunked(sw.read_chunks(docs, id_col, text_col, keep), "id", "text", chunk_bytes, 64)
    tasks = max(parallelism(docs.sparkSession), buckets // 4)
    by_chunk = rows.groupBy("chunk")
    answers = sw.shared_anchors(rows, False, width, gram, buckets)
    runs = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda docs, shared: _runs(docs, shared, width, gram, buckets), _RUNS
    )
    anchor = Window.partitionBy("anchor", "settled")
    whole = anchor.orderBy("context").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = (
        runs.withColumn("low", F.min("context").over(whole))
        .withColumn("high", F.max("context").over(whole))
        .withColumn("rows", F.count(F.lit(1)).over(whole))
        .withColumn("first", F.min("id").over(Window.partitionBy("anchor", "settled", "context")))
        .withColumn("flagged", F.col("settled") | (F.col("id") > F.col("first")))
        .where(F.col("flagged") | (F.col("low") != F.col("high")))
        .select("anchor", "flagged", (F.col("rows") > hot_rows).alias("hot"), "chunk", "doc", "start", "stop")
    )
    sought = by_chunk.cogroup(judged.groupBy("chunk")).applyInArrow(
        lambda docs, asked: _contexts(docs, asked, width), _SOUGHT
    )
    flags = (
        sought.repartition(tasks, "place")
        .sortWithinPartitions("place")
        .mapInArrow(lambda batches: _settle_all(batches, width), "chunk int, doc int, start int, stop int")
    )
    kinds = ",".join(f"`{c}`:{docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{_SCHEMA}, rest struct<{kinds}>, kept_text string" if keep else _SCHEMA
    result = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(
        lambda docs, flags: _remove(docs, flags, width), schema
    )
    result = result.withColumnRenamed("id", id_col)
    return result.select(id_col, "n_bytes", "spans", "kept", "kept_text", "rest.*") if keep else result
