"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by looking at its symbols only: runs of one symbol are
phrases; elsewhere deterministic coin tossing turns neighbouring names into small
labels that differ from their neighbours, and a phrase begins at each local minimum of
the labels. A phrase's name is a hash of the names in it, and the names are parsed again,
level by level. Where a cut lies depends on a few symbols around it, so equal substrings
get equal phrase names in their interior, wherever they begin.

A fingerprint keeps, for each of `SLOTS` permutations, the least hash among the phrase
names of all levels; the share of equal slots estimates how alike the sets of phrases are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.shared_windows import mix, segment_hashes
from offerlake.llm.tables import checkpointed, in_small_batches, parallelism

SLOTS = 64
#: Hexadecimal digits of a slot.
SLOT_DIGITS = 4
LEVELS = 24
#: Coin tosses that bring 64-bit names down to labels below six.
TOSSES = 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = 1 << 18


@lru_cache(maxsize=1)
def _small_tosses() -> np.ndarray:
    """The toss of every pair of labels below 128: index 128 * label + label before."""
    label, before = np.divmod(np.arange(1 << 14), 128)
    differ = (label ^ before).astype(np.uint32)
    lowest = np.bitwise_count((differ & (~differ + np.uint32(1))) - np.uint32(1)) % 32
    return (2 * lowest + (label >> lowest & 1)).astype(np.uint8)


def _tosses(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Toss coins: twice the lowest bit in which a name differs from the one before, plus that bit.

    Labels that differ from their neighbours keep to differ, and become few: 64-bit ones
    fall below 128, then 14, 8 and 6. The first label of a text, which has none before
    it, becomes its lowest bit.
    """
    one = names.dtype.type(1)
    differ = np.empty_like(names)
    differ[1:] = names[1:] ^ names[:-1]
    differ[first] = one
    lowest = np.bitwise_count((differ & (~differ + one)) - one)
    labels = lowest << 1 | (names >> lowest.astype(names.dtype) & one).astype(np.uint8)
    small = _small_tosses()
    for _ in range(TOSSES - 1):
        start = labels[first] & 1
        pairs = labels.astype(np.uint16) << np.uint16(7)
        pairs[1:] |= labels[:-1]
        labels = small[pairs]
        labels[first] = start
    return labels


def _parse(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of phrases: their names, and the texts they belong to."""
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[1:] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(new)  # runs of one name come first, so that neighbours differ
    lengths = np.diff(np.append(at, len(names)))
    owner, labels = owner[at], names[at]
    runs = np.flatnonzero(lengths > 1)
    hashed = mix(labels.astype(np.uint64) + np.uint64(1)) if labels.dtype != np.uint64 else labels.copy()
    hashed[runs] = mix(hashed[runs] + lengths[runs].astype(np.uint64) * _BASE)
    if labels.dtype == np.uint64:
        labels = hashed
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    tossed = _tosses(labels, first)
    cut = np.zeros(len(labels), bool)
    cut[1:-1] = (tossed[1:-1] < tossed[:-2]) & (tossed[1:-1] <= tossed[2:])
    cut[-1] = len(tossed) > 1 and tossed[-1] < tossed[-2]
    last = first[1:] - 1
    inner = last[last > 0]
    cut[inner] = tossed[inner] < tossed[inner - 1]  # a text's last label has no right neighbour
    cut[first] = True
    starts = np.flatnonzero(cut)
    return segment_hashes(hashed, starts, np.append(starts[1:], len(labels))), owner[starts]


def phrase_names(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The phrases of some texts by level: (level, names, text of each name).

    The names of level 0 are the code points; a text is done when one phrase is left.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names = codes
    owner = np.repeat(np.arange(len(texts)), lengths)
    for level in range(1, LEVELS + 1):
        if not len(names):
            return
        names, owner = _parse(names, owner)
        yield level, names, owner
        several = np.bincount(owner, minlength=len(texts)) > 1
        keep = several[owner]
        names, owner = names[keep], owner[keep]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * _BASE)
    return seeds[:SLOTS] | np.uint64(1), seeds[SLOTS:]


def fingerprints_of(texts: list[str]) -> list[str]:
    """The fingerprint of each text; an empty text has the one of all-zero slots."""
    factors, shifts = _permutations()
    slots = np.full((len(texts), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    for _, names, owner in phrase_names(texts):
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = owner[edges]
        for slot in range(SLOTS):
            least = np.minimum.reduceat(names * factors[slot] + shifts[slot], edges)
            slots[rows, slot] = np.minimum(slots[rows, slot], least)
    kept = mix(slots) >> np.uint64(64 - 4 * SLOT_DIGITS)
    kept[np.fromiter(map(len, texts), np.int64, len(texts)) == 0] = 0
    raw = kept.astype(">u2").tobytes().hex()
    width = SLOTS * SLOT_DIGITS
    return [raw[i * width : (i + 1) * width] for i in range(len(texts))]


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots of two fingerprints, from 0 to 1."""
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    equal = F.filter(slots, lambda i: F.substr(a, i * SLOT_DIGITS + 1, F.lit(SLOT_DIGITS)) == F.substr(b, i * SLOT_DIGITS + 1, F.lit(SLOT_DIGITS)))
    return F.size(equal) / F.lit(SLOTS)


def _steps(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _STEP):
            size, end = size + len(texts[end]), end + 1
        yield texts[at:end]
        at = end


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "").to_pylist()
        found = [f for part in _steps(texts) for f in fingerprints_of(part)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[batch.schema.names[0], "fingerprint"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each whole text: `id_col`, `fingerprint`.

    One row per input row; a null text is empty; equal texts have equal fingerprints.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(_fingerprint, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by the beginning of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n] if n else text


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and place: fingerprint each, its edited text and its next."""
    held: list[tuple] = []

    def results(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own: dict[int, str] = {}
        at = 0
        for part in _steps([r[2] for r in rows]):
            own |= {at + i: f for i, f in enumerate(fingerprints_of(part))}
            at += len(part)
        todo = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][0] == rows[i + 1][0]]
        changed = [edited(rows[i][2], rows[i + 1][2]) for i in todo]
        prints = [f for part in _steps(changed) for f in fingerprints_of(part)]
        columns = [
            pa.array([rows[i][1] for i in todo], pa.int64()),
            pa.array([len(rows[i][2]) for i in todo], pa.int64()),
            pa.array(changed, pa.string()),
            pa.array([own[i] for i in todo], pa.string()),
            pa.array(prints, pa.string()),
            pa.array([own[i + 1] for i in todo], pa.string()),
        ]
        names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for i in range(0, len(batch), 1000):
            part = batch.slice(i, 1000)
            held += zip(*(part.column(c).to_pylist() for c in ("range", "id", "text", "bound")), strict=True)
            yield from results(held)
            held = held[-1:]
    if held and not held[-1][3]:
        raise AssertionError("a range must end with its bound")


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text and the next text in ascending order of ids.

    Returns `id_col`, `n_chars`, `edited`, `fingerprint`, `edited_fingerprint` and
    `next_fingerprint`, one row per input row. The edited text has its last quarter
    (rounded down) replaced by as many of the first characters of the next text, or all
    of it; after the last row comes the first, and a single row is its own next. Rows with equal ids follow each other by text;
    rows with a null id come first. Ids are dealt to ranges by their quantiles; each
    range ends with a copy of the next range's first row, so no row needs another range.
    """
    spark = docs.sparkSession
    count = ranges or 4 * parallelism(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / count for i in range(1, count)]
    cuts = sorted(set(rows.approxQuantile("id", shares, 0.2 / count))) if shares else []
    ranged = rows.withColumn("place", F.coalesce(F.col("id"), F.lit(0)).cast("double")).withColumn("range", F.lit(0.0))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        ranged = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(ranged.drop("range"))
    ranged = ranged.select("id", "text", F.when(F.col("id").isNull(), -1).otherwise(F.col("range")).cast("int").alias("range"))
    least = ranged.groupBy("range").agg(F.min("id").alias("least"))
    same = F.col("id").eqNullSafe(F.col("least"))
    # one row for each range: a bounded table
    firsts = ranged.join(F.broadcast(least.withColumnRenamed("range", "of")), same & (F.col("range") == F.col("of")))
    firsts = checkpointed(firsts.groupBy("range", "id").agg(F.min("text").alias("text")))
    present = [r[0] for r in firsts.select("range").orderBy("range").collect()]
    before = spark.createDataFrame(list(zip(present[1:] + present[:1], present, strict=True)), "range int, back int")
    bounds = firsts.join(F.broadcast(before), "range").select(
        F.col("back").alias("range"), "id", "text", F.lit(True).alias("bound")
    )
    both = ranged.select("range", "id", "text", F.lit(False).alias("bound")).unionByName(bounds)
    pairs = (
        in_small_batches(both).repartition(parallelism(spark), "range")
        .sortWithinPartitions("range", "bound", F.col("id").asc_nulls_first(), "text")
        .mapInArrow(
            _pairs,
            "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string",
        )
    )
    return pairs.withColumnRenamed("id", id_col)
