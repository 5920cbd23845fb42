"""Which fixed-width windows of a document also start in a document with a smaller id.

The common part of the two repeat removers. A document is a sequence of symbols (bytes
or hashed words). Every window of `width` symbols is named by the least hash of the
`gram`-symbol strings inside it, its anchor: equal windows have equal anchors, and
neighbouring windows mostly share one, so a document has far fewer anchors than windows.

Documents are dealt to chunks of bounded size by a hash of the id. Each chunk announces
its distinct anchors; only runs of windows whose anchor is in two documents can hold a
repeated window, so everything else is out before any window is shuffled. A window that
repeats within a chunk is settled there, whatever the number of copies; a chunk sends
each distinct run or window once per document that has it first in that chunk. A passage
in a third of all documents therefore costs one row for each chunk.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.tables import in_small_batches, no_model

#: Windows in one run at most; longer runs, as in periodic text, are cut.
LONGEST_RUN = 64
#: Symbols that one numpy pass handles.
_PASS = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolling(symbols: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of `width` symbols, built by doubling."""
    done, done_width, power, power_width = None, 0, symbols, 1
    while True:
        if width & 1:
            if done is None:
                done = power
            else:
                n = len(power) - done_width
                done = done[:n] * np.uint64(pow(_BASE, power_width, 1 << 64)) + power[done_width:]
            done_width += power_width
        width >>= 1
        if not width:
            return done
        power = power[:-power_width] * np.uint64(pow(_BASE, power_width, 1 << 64)) + power[power_width:]
        power_width *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), reach * 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


@lru_cache(maxsize=1)
def byte_symbols() -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    n = 4 * _PASS
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def segment_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each segment symbols[start:end], the same wherever it lies."""
    if len(symbols) >= 4 * _PASS:  # one document longer than a pass
        powers = np.multiply.accumulate(np.concatenate([[1], np.full(len(symbols), _BASE)]).astype(np.uint64))
        inverse = pow(_BASE, -1, 1 << 64)
        inverses = np.multiply.accumulate(np.concatenate([[1], np.full(len(symbols), inverse)]).astype(np.uint64))
    else:
        powers, inverses = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * powers[: len(symbols)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than 0x20 and 0x09 to 0x0D."""
    inside = np.concatenate([[False], ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def passes(texts: list[bytes], words: bool):
    """Yield (first document, symbols, document of each symbol) over some documents at a time."""
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) <= _PASS):
            size, end = size + len(texts[end]) + 1, end + 1
        lengths = np.array([len(t) + words for t in texts[first:end]])
        raw = np.frombuffer((b" " if words else b"").join([*texts[first:end], b""]), np.uint8)
        owner = np.repeat(np.arange(first, end), lengths)
        symbols = byte_symbols()[raw]
        if words:
            starts, ends = word_bounds(raw)
            owner = owner[starts]
            symbols = segment_hashes(symbols, starts, ends)
        yield first, symbols, owner
        first = end


def runs(symbols: np.ndarray, owner: np.ndarray, width: int, gram: int):
    """Runs of neighbouring windows with one anchor: starts, numbers of windows, anchors."""
    if len(symbols) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    anchors = sliding_min(mix(rolling(symbols, gram)), width - gram + 1)
    n = len(anchors)
    whole = owner[:n] == owner[width - 1 :]
    cut = (anchors[1:] != anchors[:-1]) | (whole[1:] != whole[:-1]) | (owner[1:n] != owner[: n - 1])
    starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
    counts = np.diff(np.append(starts, n))
    starts, counts = starts[whole[starts]], counts[whole[starts]]
    pieces = -(-counts // LONGEST_RUN)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        counts = np.minimum(LONGEST_RUN, np.repeat(counts, pieces) - nth * LONGEST_RUN)
        starts = np.repeat(starts, pieces) + nth * LONGEST_RUN
    return starts, counts, anchors[starts]


def in_order(docs: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A chunk's rows by id and text, so that a row's number is the same in every pass."""
    no_model()
    docs = docs.sort_by([("id", "ascending"), ("text", "ascending")])
    ids = pc.fill_null(docs["id"], np.iinfo(np.int64).max).to_numpy()
    return docs, ids, pc.fill_null(docs["text"], "").cast(pa.binary()).to_pylist()


def _bucket(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (anchors >> np.uint64(32)) % np.uint64(buckets)


def _short(anchors: np.ndarray) -> np.ndarray:
    """The half of an anchor that names it within its bucket; a clash only adds candidates."""
    return anchors.astype(np.uint32)


_ANNOUNCED = "bucket int, chunk int, anchors array<int>"


def _announce(docs: pa.Table, words: bool, width: int, gram: int, buckets: int) -> pa.Table:
    chunk = docs["chunk"][0].as_py()
    _, _, texts = in_order(docs)
    found = [np.unique(runs(s, o, width, gram)[2]) for _, s, o in passes(texts, words)]
    anchors = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
    bucket = _bucket(anchors, buckets)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.append(first, len(order)).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(_short(anchors[order]).view(np.int32)))
    chunks = pa.array(np.full(len(names), chunk, np.int32))
    return pa.Table.from_arrays([pa.array(names.astype(np.int32)), chunks, lists], names=["bucket", "chunk", "anchors"])


def _answer(announced: pa.Table) -> pa.Table:
    """For each chunk the anchors of one bucket that another chunk has too."""
    lists = announced["anchors"].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[back] > 1
    kept = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(lengths)])]
    answers = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(flat[shared]))
    return pa.Table.from_arrays([announced["bucket"], announced["chunk"], answers], names=["bucket", "chunk", "anchors"])


def shared_anchors(docs: DataFrame, words: bool, width: int, gram: int, buckets: int) -> DataFrame:
    """The anchors of each chunk that other chunks have too, listed by bucket."""
    announced = docs.groupBy("chunk").applyInArrow(
        lambda chunk: _announce(chunk, words, width, gram, buckets), _ANNOUNCED
    )
    return announced.groupBy("bucket").applyInArrow(_answer, _ANNOUNCED)


def _member(answers: pa.Table, buckets: int):
    """A test for anchors that other chunks have too."""
    lists = answers["anchors"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    bucket = np.repeat(answers["bucket"].to_numpy(), lengths).astype(np.uint64)
    names = np.sort(bucket << np.uint64(32) | lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32))

    def test(anchors: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.zeros(len(anchors), bool)
        wanted = _bucket(anchors, buckets) << np.uint64(32) | _short(anchors)
        return names[np.minimum(np.searchsorted(names, wanted), len(names) - 1)] == wanted

    return test


def candidate_runs(docs: pa.Table, answers: pa.Table, words: bool, width: int, gram: int, buckets: int):
    """Runs of a chunk whose anchor is in two documents.

    Returns a dict of columns: anchor, id, doc (row number in the chunk), start, count,
    and context (hash of the symbols that the run covers); and two hashes of all their
    windows end to end.
    """
    _, ids, texts = in_order(docs)
    elsewhere = _member(answers, buckets)
    parts = []
    for _, symbols, owner in passes(texts, words):
        starts, counts, anchors = runs(symbols, owner, width, gram)
        parts.append((starts, counts, anchors, owner[starts]))
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("anchor", "id", "doc", "start", "count", "context")}, np.zeros((2, 0), np.uint64)
    anchors, doc = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order = np.argsort(anchors, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], anchors[order][1:] != anchors[order][:-1]]))
    several = np.zeros(len(anchors), bool)
    if len(order):
        low, high = np.minimum.reduceat(doc[order], edges), np.maximum.reduceat(doc[order], edges)
        several[order] = np.repeat(low != high, np.diff(np.append(edges, len(order))))
    wanted = several | elsewhere(anchors)
    columns, windows, at = [], [], 0
    # the symbols are made once more: held since the first pass they would take many times the text
    for (starts, counts, own, docs_of), (_, symbols, owner) in zip(parts, passes(texts, words), strict=True):
        keep = wanted[at : at + len(own)]
        at += len(own)
        starts, counts, own, docs_of = starts[keep], counts[keep], own[keep], docs_of[keep]
        context = segment_hashes(symbols, starts, starts + counts + width - 1)
        first_of = np.searchsorted(owner, docs_of)  # where the run's document begins in this pass
        columns.append((own, ids[docs_of], docs_of, starts - first_of, counts, context))
        if words and len(starts):
            every = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            second = rolling(mix(symbols ^ np.uint64(_BASE)), width)
            windows.append(np.stack([mix(rolling(symbols, width))[every], mix(second)[every]]))
    merged = [np.concatenate(c) for c in zip(*columns, strict=True)]
    names = ("anchor", "id", "doc", "start", "count", "context")
    return dict(zip(names, merged, strict=True)), np.concatenate([*windows, np.zeros((2, 0), np.uint64)], axis=1)


def first_holder(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For each row the least id among the rows with equal keys."""
    if not len(ids):
        return ids
    order = np.lexsort(keys)
    change = np.zeros(len(ids), bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[order][1:] != key[order][:-1]
    edges = np.flatnonzero(change)
    least = np.empty_like(ids)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], edges), np.diff(np.append(edges, len(ids))))
    return least


def covered(starts: np.ndarray, stops: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of symbols covered by the windows that start in [start, stop)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(stops[order] + width - 1)
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def by_document(flags: pa.Table, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The covered runs of each flagged document of a chunk."""
    doc, start, stop = (flags[c].to_numpy() for c in ("doc", "start", "stop"))
    order = np.argsort(doc, kind="stable")
    names, first = np.unique(doc[order], return_index=True)
    parts = np.split(order, first[1:]) if len(names) else []
    return {int(d): covered(start[part], stop[part], width) for d, part in zip(names, parts, strict=True)}


def read_chunks(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids, whole texts and, as a struct, the columns that only pass through."""
    columns = [F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    return in_small_batches(docs).select(*columns, *([F.struct(*keep).alias("rest")] if keep else []))
