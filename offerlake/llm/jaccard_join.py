"""N-gram Jaccard self-join by chosen paths.

Texts are sets of hashed word n-grams. Equal sets are one class from the start. Every
class is embedded as `SLOTS` tokens (slot, least hash), of which two sets share about as
many as their Jaccard similarity says. A run splits all classes recursively: a bucket
samples `BRANCH` slots, and its members go on to one child bucket for each of these
tokens they have. Buckets of at most `leaf` members are compared by brute force on their
tokens. A larger one that has most of its parent's members is a group of near copies,
which no sampled token parts: its members are taken as alike, and verified later as all
are. Other large ones, such as those of a line that many texts have, are split on. Runs repeat until two sets at the threshold part in all of them with a
probability below 1 - `recall`.

What is found this way only gathers classes into clusters. Within a cluster all pairs of
classes are verified by their whole n-gram sets, in blocks of bounded size, so no pair of
a large cluster is ever emitted: a block returns link counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.components import components
from offerlake.llm.shared_windows import mix, passes, rolling, segment_hashes
from offerlake.llm.tables import checkpointed, in_small_batches, no_model

SLOTS = 64
BRANCH = 2
#: Levels at most, and the share of a bucket that goes on into one child where splitting it is of no more use.
DEPTH, DENSE = 12, 0.7
#: Equal tokens (of SLOTS) from which two members of a small bucket count as alike: four
#: standard deviations below what sets at the threshold share.
_SLACK = 4.0
#: Members of a block of a large cluster, and their n-grams (2 MB of hashes), whichever comes first.
BLOCK, BLOCK_GRAMS = 512, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which two sets at the threshold have met with probability `recall`."""
    parted = 0.0
    for _ in range(DEPTH):
        parted = (1 - threshold + threshold * parted) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(parted))) if parted > 0 else 1


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-gram hashes of each text, sorted, end to end, and their owners.

    A text of fewer than n words has one n-gram of all its words; one without words has none.
    """
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, symbols, owner in passes(texts, True):
        if not len(symbols):
            continue
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sizes = np.diff(np.append(edges, len(owner)))
        short = sizes < n
        hashes.append(segment_hashes(symbols, edges[short], edges[short] + sizes[short]))
        owners.append(owner[edges[short]])
        if len(symbols) >= n:
            grams = mix(rolling(symbols, n))
            whole = owner[: len(grams)] == owner[n - 1 :]
            hashes.append(grams[whole])
            owners.append(owner[: len(grams)][whole])
    values, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def _keys(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    return np.add.reduceat(mix(values), edges), np.add.reduceat(mix(values ^ _BASE), edges)


_SKETCHED = "id long, node long, check long, n_grams long, tokens binary"


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    no_model()
    seeds = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * _BASE)
    for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
        values, owner = shingle_sets(pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist(), n)
        if not len(values):
            continue
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        node, check = _keys(values, edges)
        tokens = np.empty((len(edges), SLOTS), np.uint32)
        for slot in range(SLOTS):
            least = np.minimum.reduceat(values * (seeds[slot] | np.uint64(1)) + seeds[SLOTS + slot], edges)
            tokens[:, slot] = mix(least) >> np.uint64(32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(owner[edges])),
                pa.array(node.view(np.int64)),
                pa.array(check.view(np.int64)),
                pa.array(np.diff(np.append(edges, len(values)))),
                pa.array([row.tobytes() for row in tokens], pa.binary()),
            ],
            names=["id", "node", "check", "n_grams", "tokens"],
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Send each member of a bucket to the child bucket of every sampled token it has."""
    slots = mix(np.arange(1, SLOTS + 1, dtype=np.uint64))
    for batch in (b.slice(i, 2000) for b in batches for i in range(0, len(b), 2000)):
        bucket = batch.column("bucket").to_numpy().view(np.uint64)
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, SLOTS)
        order = np.argsort(mix(bucket[:, None] ^ slots[None, :]), axis=1)[:, :BRANCH]
        row = np.repeat(np.arange(len(bucket)), BRANCH)
        slot = order.ravel()
        child = mix(bucket[row] * _BASE + mix(tokens[row, slot].astype(np.uint64) << np.uint64(8) | slot.astype(np.uint64)))
        brief = [t.tobytes() for t in (tokens & 0xFF).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(child.view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("node", "members")), pa.array([brief[i] for i in row], pa.binary())],
            names=["bucket", "node", "parent", "brief"],
        )


class _Forest:
    """Union-find over a few members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by their keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _compare(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Brute force in small buckets: a spanning forest of the members that are alike."""
    a, b = [], []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for group in _groups(batches, ["bucket"]):
        nodes = group["node"].to_pylist()
        brief = np.frombuffer(b"".join(group["brief"].to_pylist()), np.uint8).reshape(-1, SLOTS)
        equal = (brief[:, None, :] == brief[None, :, :]).sum(axis=2)
        forest = _Forest(len(nodes))
        for i, j in zip(*np.nonzero(np.triu(equal >= least, 1)), strict=True):
            if forest.join(int(i), int(j)):
                a.append(nodes[i])
                b.append(nodes[j])
        if len(a) > 10_000:
            yield flush()
            a, b = [], []
    yield flush()


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The whole n-gram set of each class, made from one of its texts."""
    for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
        values, owner = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), n)
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        wanted = batch.column("node").to_numpy()[owner[edges]] if len(edges) else np.zeros(0, np.int64)
        ok = _keys(values, edges)[0].view(np.int64) == wanted if len(edges) else np.zeros(0, bool)
        rows = pa.array(owner[edges][ok])
        ends = np.append(edges[1:], len(values))[ok] if len(edges) else edges
        lists = [values[s:e].view(np.int64) for s, e in zip(edges[ok], ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in ("node", "cluster", "copies", "blocks")), pa.array(lists, pa.list_(pa.int64()))],
            names=["node", "cluster", "copies", "blocks", "grams"],
        )


def _common(values: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """How many values each two of m sets share."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    del order
    new = values[1:] != values[:-1]
    shared = np.zeros(len(values), bool)  # a value that a neighbour has too
    shared[1:] = ~new
    shared[:-1] |= ~new
    names, owner = values[shared], owner[shared]
    names = np.concatenate([[0], np.cumsum(names[1:] != names[:-1])]) if len(names) else names
    total, width = np.zeros((m, m), np.float32), max(64, (4 << 20) // m)
    for start in range(0, int(names[-1]) + 1 if len(names) else 0, width):
        a, b = np.searchsorted(names, [start, start + width])
        part = np.zeros((m, min(width, int(names[-1]) + 1 - start)), np.float32)
        part[owner[a:b], names[a:b] - start] = 1
        total += part @ part.T
    return total


def _spanning(alike: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    seen, edges = np.zeros(len(alike), bool), []
    for start in range(len(alike)):
        if seen[start]:
            continue
        seen[start], reached = True, [start]
        while reached:
            one = reached.pop()
            new = np.flatnonzero(alike[one] & ~seen).tolist()
            seen[new] = True
            edges += [(one, other) for other in new]
            reached += new
    return edges


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """All pairs of a block, or between two blocks: links of each class, and a forest."""
    for group in _groups(batches, ["cluster", "one", "two"]):
        nodes, first = np.unique(group["node"].to_numpy(), return_index=True)
        group = group.take(pa.array(first))
        grams = group["grams"].combine_chunks()
        sizes = pc.list_value_length(grams).to_numpy().astype(np.int64)
        m = len(nodes)
        common = _common(grams.flatten().to_numpy(), np.repeat(np.arange(m), sizes), m)
        alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(alike, False)
        block = group["block"].to_numpy()
        one, two = group["one"][0].as_py(), group["two"][0].as_py()
        if one != two:
            alike &= (block[:, None] != block[None, :])
        links = (alike @ group["copies"].to_numpy().astype(np.float64)).astype(np.int64)
        edges = _spanning(alike)
        linked = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([nodes[linked], nodes[[i for i, _ in edges]]]) if m else nodes),
                pa.array(np.concatenate([np.zeros(len(linked), np.int64), nodes[[j for _, j in edges]]])),
                pa.array(np.concatenate([np.zeros(len(linked), bool), np.ones(len(edges), bool)])),
                pa.array(np.concatenate([links[linked], np.zeros(len(edges), np.int64)])),
            ],
            names=["node", "other", "edge", "links"],
        )


def candidate_edges(classes: DataFrame, threshold: float, recall: float, leaf: int) -> DataFrame:
    """Edges that connect all classes which chosen paths bring together: `a`, `b`."""
    spread = SLOTS * threshold - _SLACK * math.sqrt(SLOTS * threshold * (1 - threshold))
    least = max(1, math.floor(spread))
    runs = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs_for(threshold, recall)).cast("long"))).alias("bucket")
    level = classes.select(runs, "node", F.lit(np.iinfo(np.int64).max).alias("members"), "tokens")
    found = []
    for depth in range(1, DEPTH + 1):
        rows = level.mapInArrow(_split, "bucket long, node long, parent long, brief binary")
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("low")).where("members > 1")
        met = checkpointed(rows.join(sizes, "bucket"))
        small = met.where(F.col("members") <= leaf).select("bucket", "node", "brief")
        found.append(
            small.repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(lambda batches: _compare(batches, least), "a long, b long")
        )
        large = met.where(F.col("members") > leaf)
        alike = (F.col("members") >= DENSE * F.col("parent")) | F.lit(depth == DEPTH)
        found.append(large.where(alike & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b")))
        left = large.where(~alike)
        if not left.limit(1).count():
            break
        level = left.select("bucket", "node", "members").join(classes.select("node", "tokens"), "node")
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def similarity_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    leaf: int = 64,
) -> DataFrame:
    """Link texts whose word n-gram sets have a Jaccard similarity of `threshold` or more.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Returns one row
    per input row: `id_col`, `class_id` (the least id that the text is connected to by
    links), `n_links` (the other rows that link to it, copies included) and `n_copies`
    (the rows with an equal n-gram set, itself included). A text of fewer than n words
    is one n-gram; texts without words, null texts and rows with a null id have no links,
    and their own id as class. Other columns are ignored.
    """
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = checkpointed(rows.where("id IS NOT NULL").mapInArrow(lambda batches: _sketch(batches, n), _SKETCHED))
    classes = checkpointed(
        sketched.groupBy("node", "check").agg(
            F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"), F.min("n_grams").alias("n_grams"), F.min("tokens").alias("tokens")
        )
    )
    edges = candidate_edges(classes, threshold, recall, leaf)
    labels = components(edges).withColumnRenamed("label", "cluster")
    clustered = checkpointed(labels.join(classes.select("node", "copies", "rep", "n_grams"), "node"))
    sizes = clustered.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    wanted = clustered.join(sizes, "cluster").drop("n_grams")
    texts = rows.join(wanted.withColumnRenamed("rep", "id"), "id").where("text IS NOT NULL")
    sets = texts.select("node", "cluster", "copies", "blocks", "text").mapInArrow(
        lambda batches: _sets(batches, n), "node long, cluster long, copies long, blocks int, grams array<long>"
    )
    blocked = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    keyed = blocked.select(
        "cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "copies", "grams"
    )
    verified = checkpointed(
        keyed.repartition("cluster", "one", "two")
        .sortWithinPartitions("cluster", "one", "two")
        .mapInArrow(lambda batches: _verify(batches, threshold), "node long, other long, edge boolean, links long")
    )
    links = verified.where("NOT edge").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(verified.where("edge").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = linked.join(classes.select("node", "rep"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    facts = (
        classes.select("node", "check", "copies", "rep")
        .join(links, "node", "left")
        .join(named.select("node", "label").join(least, "label").select("node", "class_id"), "node", "left")
        .select(
            "node",
            "check",
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.col("copies").alias("n_copies"),
        )
    )
    known = sketched.select("id", "node", "check").join(facts, ["node", "check"]).select("id", "class_id", "n_links", "n_copies")
    alone = rows.where(F.col("id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(
        "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
    )
    return known.unionByName(alone).withColumnRenamed("id", id_col)
