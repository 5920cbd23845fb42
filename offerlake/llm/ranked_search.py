"""Ranked lexical search with inverted treaps.

Each sought term has a treap of its postings: a binary tree in search order of the document
and in heap order of the impact, so that the root of a subtree holds the largest impact of
all documents below it. A query walks the treaps of its terms at the same time. For an
interval of documents every term stands at the node with its largest impact there; the sum
of these, weighted, is a bound of every score in the interval. The interval with the
largest bound comes first; one whose bound cannot enter the k best ends the walk. Otherwise
the interval is cut at the root of its dearest term, and each treap is followed down to its
largest node on either side. Intervals of few documents are scored outright, exactly.

Documents are dealt to treaps as they are read: a task indexes some thousand documents at
a time, searches all queries in them with the thresholds it has already reached, and
returns its k best for each query. These are merged in two steps.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from offerlake.llm.tables import BROADCAST_BYTES, checkpointed, in_small_batches

#: A term: ASCII letters and digits and everything beyond ASCII. Among UTF-8 bytes this is the class of characters
#: that the contract gives, because all bytes of other characters are 0x80 or more.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents and postings that are indexed at a time.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Documents of an interval that are scored outright.
LEAF = 128
#: Bytes from which a text's terms are counted one by one instead of as a list.
LONG = 4 << 20
#: The length part of the impact: k1 = 1.2 in tenths of tf, b = 0.75 in hundredths. Fixed values.
TF_SCALE, TF_WEIGHT, LENGTH_WEIGHT = 1_000_000_000, 1000, 8


def terms_of(text: str | bytes) -> list[bytes]:
    """The terms of a text, A-Z lower-cased, in order."""
    return TERM.findall((text.encode() if isinstance(text, str) else text).lower())


def weight(n_docs: int, df: int) -> int:
    """How much a term counts that `df` of `n_docs` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting adds to a score for each unit of its term's weight."""
    m = 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)
    return (TF_SCALE * tf) // (TF_WEIGHT * tf + LENGTH_WEIGHT * m)


class Treaps:
    """The treaps of all sought terms over some documents, which have the ordinals 0, 1, ... in search order.

    Postings of a term lie together in order of the ordinal; `left` and `right` are the
    children of a posting (-1: none). Equal impacts are ordered by a hash of the ordinal,
    which keeps the trees shallow.
    """

    def __init__(self, term: np.ndarray, ordinal: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((ordinal, term))
        self.n_docs = n_docs
        self.term, self.ordinal, self.impact = term[order].astype(np.int64), ordinal[order].astype(np.int64), impact[order]
        self.place = self.term * n_docs + self.ordinal
        self.left, self.right, self.roots = self._link()

    def _link(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Build every tree in one pass from left to right over its right spine."""
        mixed = (self.ordinal * 2654435761) & 0xFFFFF
        priority = ((self.impact << 20) | mixed).tolist()
        left, right, roots = [-1] * len(priority), [-1] * len(priority), {}
        spine: list[int] = []
        current = -1
        for i, (t, p) in enumerate(zip(self.term.tolist(), priority, strict=True)):
            if t != current:
                if spine:
                    roots[current] = spine[0]
                spine, current = [], t
            below = -1
            while spine and priority[spine[-1]] < p:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        if spine:
            roots[current] = spine[0]
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), roots

    def descend(self, nodes: np.ndarray, first: int, end: int) -> np.ndarray:
        """For nodes that lead their trees in some interval, the leaders in its part [first, end); -1 where there is none."""
        nodes = nodes.copy()
        while True:
            at = self.ordinal[nodes]
            low, high = (nodes >= 0) & (at < first), (nodes >= 0) & (at >= end)
            if not (low.any() or high.any()):
                return nodes
            nodes[low], nodes[high] = self.right[nodes[low]], self.left[nodes[high]]

    def scores(self, terms: np.ndarray, weights: np.ndarray, first: int, end: int) -> np.ndarray:
        """Exact scores of the documents [first, end)."""
        a, b = np.searchsorted(self.place, terms * self.n_docs + first), np.searchsorted(self.place, terms * self.n_docs + end)
        sizes = b - a
        at = np.arange(sizes.sum()) + np.repeat(a - np.cumsum(sizes) + sizes, sizes)
        total = np.zeros(end - first, dtype=np.int64)
        np.add.at(total, self.ordinal[at] - first, self.impact[at] * np.repeat(weights, sizes))
        return total


@dataclass
class Best:
    """The k best documents so far: (score, doc_id) from the best on; a null id counts as the largest."""

    k: int
    found: list[tuple[int, int | None]] = field(default_factory=list)

    @staticmethod
    def order(entry: tuple[int, int | None]) -> tuple:
        return -entry[0], entry[1] is None, entry[1] or 0

    def admits(self, score: int, doc_id: int | None) -> bool:
        """Whether a document with that score and an id of at least `doc_id` may enter."""
        if score <= 0:
            return False
        return len(self.found) < self.k or self.order((score, doc_id)) < self.order(self.found[-1])

    def add(self, entries: list[tuple[int, int | None]]) -> None:
        self.found = sorted(self.found + entries, key=self.order)[: self.k]


def walk(treaps: Treaps, ids: list[int | None], query: dict[int, int], best: Best) -> int:
    """Search one query, `query` being its weight for each term; returns how many intervals were scored outright."""
    known = [t for t in query if t in treaps.roots]
    terms, weights = np.array(known, dtype=np.int64), np.array([query[t] for t in known], dtype=np.int64)
    scored = 0
    waiting: list[tuple[int, int, int, np.ndarray]] = []

    def push(nodes: np.ndarray, first: int, end: int) -> None:
        if first < end:
            bound = int((weights * np.where(nodes >= 0, treaps.impact[nodes], 0)).sum())
            if best.admits(bound, ids[first]):
                heappush(waiting, (-bound, first, end, nodes))

    if known:
        push(np.array([treaps.roots[t] for t in known], dtype=np.int64), 0, treaps.n_docs)
    while waiting:
        bound, first, end, nodes = heappop(waiting)
        if not best.admits(-bound, ids[first]):
            if best.found and -bound < best.found[-1][0]:
                break
            continue
        if end - first <= LEAF:
            scored += 1
            here = nodes >= 0
            total = treaps.scores(terms[here], weights[here], first, end)
            least = best.found[-1][0] if len(best.found) == best.k else 1
            hits = np.flatnonzero(total >= max(least, 1))
            if len(hits):
                hits = hits[np.argsort(-total[hits], kind="stable")][: best.k]
                best.add([(int(total[i]), ids[first + i]) for i in hits.tolist()])
            continue
        share = weights * np.where(nodes >= 0, treaps.impact[nodes], 0)
        cut, quarter = int(treaps.ordinal[nodes[int(share.argmax())]]), (end - first) // 4
        if not first + quarter <= cut < end - quarter:  # a root at the edge would leave the interval nearly whole
            cut = (first + end) // 2
        push(treaps.descend(nodes, first, cut), first, cut)
        push(treaps.descend(nodes, cut, end), cut, end)
    return scored


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """For each document its number of terms and, for the sought ones in it, their numbers and frequencies."""
    ints = ArrayType(IntegerType())
    shape = StructType([StructField("doc_id", LongType()), StructField("n", LongType()), StructField("terms", ints), StructField("tfs", ints)])
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                long = text is not None and len(text) > LONG
                counts = Counter(m[0] for m in TERM.finditer(text.lower())) if long else Counter(terms_of(text or b""))
                n.append(counts.total())
                known = [(number[t], c) for t, c in counts.items() if t in number]
                terms.append([t for t, _ in known])
                tfs.append([c for _, c in known])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return in_small_batches(docs).mapInArrow(count, shape)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Gather rows until they make an index of the size that is built at a time."""
    waiting, rows, postings = [], 0, 0
    for batch in batches:
        for start in range(0, len(batch), 1024):
            part = batch.slice(start, 1024)
            size = len(part.column("terms").flatten())
            if rows and (rows + len(part) > SHARD_DOCS or postings + size > SHARD_POSTINGS):
                yield pa.Table.from_batches(waiting)
                waiting, rows, postings = [], 0, 0
            waiting, rows, postings = [*waiting, part], rows + len(part), postings + size
    if rows:
        yield pa.Table.from_batches(waiting)


def index(shard: pa.Table, n_docs: int, n_terms: int) -> tuple[Treaps, list[int | None]]:
    """The treaps of some rows of postings, and the documents' ids in search order."""
    given = shard.column("doc_id").to_pylist()
    order = sorted(range(len(given)), key=lambda i: (given[i] is None, given[i] or 0))
    ordinal = np.empty(len(given), dtype=np.int64)
    ordinal[order] = np.arange(len(given))
    lists = shard.column("terms").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    tf = shard.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.repeat(shard.column("n").to_numpy().astype(np.int64), sizes)
    impact = impacts(tf, n, n_docs, n_terms)
    return Treaps(lists.flatten().to_numpy(zero_copy_only=False), np.repeat(ordinal, sizes), impact, len(given)), [given[i] for i in order]


def _best_of_tasks(postings: DataFrame, queries: list[dict[int, int]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    shape = StructType([StructField("query", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
    sent = postings.sparkSession.sparkContext.broadcast(queries)

    def search_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value]
        for shard in _shards(batches):
            treaps, ids = index(shard, n_docs, n_terms)
            for query, own in zip(sent.value, best, strict=True):
                walk(treaps, ids, query, own)
        rows = [(q, doc_id, score) for q, own in enumerate(best) for score, doc_id in own.found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"]
        )

    return postings.mapInArrow(search_task, shape)


def _search_block(docs: DataFrame, items: list[tuple[object, str]], item_type: StructField, k: int) -> DataFrame:
    """Search one block of queries, whose terms and weights travel with the tasks."""
    spark = docs.sparkSession
    wanted = [Counter(terms_of(text or "")) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for q in wanted for t in q}))}
    postings = checkpointed(_postings(docs, vocabulary))
    total = postings.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).head()
    holders = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
    df = {r.term: r["count"] for r in holders.collect()}  # the block's vocabulary at most
    w = {t: weight(total.n_docs, df.get(i, 0)) for t, i in vocabulary.items()}
    queries = [{vocabulary[t]: n * w[t] for t, n in q.items() if w[t] > 0} for q in wanted]
    found = _best_of_tasks(postings, queries, total.n_docs, total.n_terms, k)
    shares = math.isqrt(max(1, postings.rdd.getNumPartitions() - 1)) + 1
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("query", "share").orderBy(*order)
    shared = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares))).withColumn("nth", F.row_number().over(some))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    ranked = shared.where(F.col("nth") <= k).withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame(
        [(i, item) for i, (item, _) in enumerate(items)], StructType([StructField("query", IntegerType()), item_type])
    )
    return ranked.join(F.broadcast(names), "query").select(item_type.name, "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BROADCAST_BYTES // 8,
) -> DataFrame:
    """Rank all documents for each item by a weighted sum of saturated term frequencies.

    Returns `item_col`, `rank` (int, from 1), `doc_id`, `score`: the item's `k` best documents
    with a score above 0, equal scores by ascending id, a null id last. `id_col` is taken as a
    long. Items are searched in blocks of `block_bytes` of text, each against all documents.
    The arithmetic is that of 64-bit integers; only a term's weight takes a logarithm.

    A null or empty text has no terms: such a document is in no result, such an item has
    none. Every row of `docs` is a document of its own, also under a repeated or null id. Rows
    of `items` that are equal in id and text are one item; an id with several texts gets a
    ranking for each. Without documents or items the result is empty. Other columns are
    ignored. A term that nearly all documents hold may have the weight 0; it adds nothing.
    """
    given = items.select(F.col(item_col), F.col(item_text_col).alias("_text")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = given.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 64)).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block_of = F.pmod(F.xxhash64(F.col(item_col), F.col("_text")), F.lit(blocks))
    name, parts = given.schema[item_col], []
    for number in range(blocks):
        block = [(r[0], r[1]) for r in given.where(block_of == number).collect()]  # about block_bytes
        parts.append(_search_block(texts, block, name, k))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
