"""Benchmark decontamination: size-partitioned MinHash search for containment.

An item is a set of word n-gram hashes. Banded signatures of whole documents cannot find
a twenty-word item in a document of twenty thousand words, because their resemblance is
near zero; what does not depend on the document's size is whether the item's own least
hashes are in it. Each has a chance equal to the containment to be there. Items are
partitioned by size, and each size class takes as many least hashes as it needs to miss
an item at the threshold with a probability below `miss`: small items take all. A
document that holds one of them, and is large enough for the item, is a candidate. The
candidates are verified by the exact containment of n-grams. An item of fewer than n
words is one shorter n-gram, which is sought among the n-grams of its own length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.tables import checkpointed, small


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """Add the words as a generated column, so that no expression splits the text anew."""
    return df.select("*", F.explode(F.array(words(text))).alias("words"))


def shingles(split: Column, n: int) -> Column:
    """Hashes of the word n-grams; none if there are fewer than n words."""
    last = F.size(split) - F.lit(n)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(split, i + 1, n)))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>"))


def _own_shingles(split: Column, n: int) -> Column:
    """An item's n-grams; fewer than n words make one of all of them."""
    whole = F.when(F.size(split) > 0, F.array(F.xxhash64(split))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(split) >= n, shingles(split, n)).otherwise(whole)


def probes(items: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The least hashes that each size class of items is searched by.

    Taken from an item of q n-grams of which a document holds at least t*q, k least
    hashes are all outside the document with a probability below (1-t)**k, and k above
    q - t*q can't all be outside. A class holds the items of up to 2**c n-grams.
    """
    needed = math.ceil(math.log(miss) / math.log(1 - threshold)) if threshold < 1 else 1
    upper = F.pow(F.lit(2), F.col("size_class"))
    sure = F.floor(upper * (1 - threshold)) + 1
    return items.withColumn("size_class", F.ceil(F.log2(F.col("n_shingles"))).cast("int")).select(
        "item", "n_shingles", "size_class", F.explode(F.slice(F.array_sort("shingles"), 1, F.least(sure, F.lit(needed)).cast("int"))).alias("probe")
    )


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    miss: float = 1e-6,
    least_words: int = 1,
) -> DataFrame:
    """Find the items of which a document holds at least `threshold` of the word n-grams.

    Returns one row for each pair, `id_col`, `item_col`, `containment` (0 to 1), however
    often the rows repeat. Texts compare by lower-case words without punctuation. An item
    of fewer than `n` words is in every document that has these words one after the other;
    items of fewer than `least_words` aren't sought at all.
    Null and empty texts, texts without words, and rows with a null id are in no pair.
    Other columns are ignored.
    """
    named = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item"), F.col(item_text_col).alias("text")
    )
    split_items = with_words(named, F.col("text")).where(F.size("words") >= max(1, least_words))
    sets = checkpointed(
        split_items.select(
            "item", F.array_distinct(_own_shingles(F.col("words"), n)).alias("shingles"), F.least(F.size("words"), F.lit(n)).alias("length")
        )
        .withColumn("n_shingles", F.size("shingles"))
        .distinct()
    )
    lengths = sorted(r.length for r in sets.select("length").distinct().collect())  # n of them at most
    probe = checkpointed(probes(sets, threshold, miss))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def grams_of(split: Column) -> Column:
        """The n-grams of every length that an item asks for."""
        every = [shingles(split, length) for length in lengths]
        return F.concat(*every) if every else F.array().cast("array<bigint>")

    split = with_words(texts, F.col("text"))
    grams = split.select("id", F.size("words").alias("n_words"), F.explode(grams_of(F.col("words"))).alias("probe"))
    enough = F.greatest(F.col("n_words") - (n - 1), F.lit(1)) >= F.col("n_shingles") * threshold
    found = grams.join(small(probe, F.lit(64)), "probe").where(enough).select("id", "item").distinct()
    # a document's list has the items it may hold, as many as there are items at most, each with its own n-grams
    wanted = checkpointed(found).join(small(sets, 64 + 8 * F.col("n_shingles")), "item")
    wanted = checkpointed(wanted.groupBy("id").agg(F.collect_list(F.struct("item", "shingles")).alias("sought")))
    grams_sought = F.aggregate("sought", F.lit(0), lambda n, s: n + F.size(s.shingles))
    whole = with_words(texts.join(small(wanted, 32 + 32 * F.size("sought") + 8 * grams_sought), "id"), F.col("text"))
    own = whole.select("id", "sought", F.explode(F.array(F.array_distinct(grams_of(F.col("words"))))).alias("own"))
    held = F.transform(
        "sought", lambda s: F.struct(s.item.alias("item"), (F.size(F.array_intersect(F.col("own"), s.shingles)) / F.size(s.shingles)).alias("containment"))
    )
    verified = own.select("id", F.explode(held).alias("held")).select("id", "held.*")
    return (
        verified.where(F.col("containment") >= threshold)
        .groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col))
        .agg(F.max("containment").alias("containment"))
    )
