"""A dictionary of entities: names and aliases, lookups in texts, and learning of aliases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from offerlake.functions import text

#: Words that name no entity. Fixed values.
STOP_WORDS = ("brewery", "brewing", "beer", "beer co", "company", "co", "craft beer", "brewing co", "brewing company")
#: Words that are no alias on their own. Fixed values.
COMMON_WORDS = (
    "black", "white", "red", "blue", "green", "yellow", "gold", "silver", "west", "east", "north", "south", "central",
    "company", "co.", "corp.", "ltd.", "inc.", "the", "a", "an", "my", "our", "your", "new", "old", "big", "small", "great",
    "best", "beer", "brewery", "brewing", "craft", "ale", "lager", "ipa", "top", "one", "two", "three", "four", "five", "six",
    "seven", "eight", "nine", "ten", "triple", "el", "la", "le", "les", "de", "du", "des", "van", "von", "st.", "saint", "mt.",
    "mount",
)


def entries(entities: DataFrame) -> DataFrame:
    """One row for each lower-case name or alias: `key`, `entity`. The greatest entity owns a key."""
    names = F.filter(F.concat(F.array("name_en", "name_jp"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n != "")
    rows = entities.select("entity", F.explode(names).alias("name"))
    return rows.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max("entity").alias("entity"))


def aliases_in(documents: DataFrame, column: str) -> DataFrame:
    """Entries of alias files: each row's text is a JSON object of an entity's name to a list of aliases. `key`, `entity`.

    The name is a key as well. Unreadable texts, blank names and blank aliases give nothing.
    """
    listed = documents.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("entity", "aliases"))
    names = F.concat(F.array("entity"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = listed.where(F.trim("entity") != "").select("entity", F.explode(names).alias("name")).where(F.trim("name") != "")
    return rows.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max("entity").alias("entity"))


def lookup(texts: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Exact lookup of a column's lower-case text: adds `entity`."""
    return texts.join(dictionary, F.lower(F.trim(F.col(column))) == F.col("key"), "left").drop("key")


#: Bytes of keys that one automaton holds, which is sent to every task.
PART_BYTES = 16 << 20


def _find(batches: Iterator[pa.RecordBatch], keys: Broadcast) -> Iterator[pa.RecordBatch]:
    """The longest key of each entity in each text; `keys` holds (key, number of its entity)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, entity in keys.value:
        automaton.add_word(key, (-len(key), key, entity))
    automaton.make_automaton()
    for batch in batches:
        rows, entities, found = [], [], []
        for row, text_ in enumerate(batch.column("_text").to_pylist()):
            best: dict[int, tuple[int, str]] = {}
            for _, (size, key, entity) in automaton.iter(text_ or ""):
                if entity not in best or (size, key) < best[entity]:
                    best[entity] = (size, key)
            rows += [row] * len(best)
            entities += best
            found += [key for _, key in best.values()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id").take(pa.array(rows, pa.int64())), pa.array(entities, pa.int64()), pa.array(found, pa.string())],
            names=["_id", "_entity", "key"],
        )


def find_in_texts(texts: DataFrame, id_col: str, column: str, dictionary: DataFrame) -> DataFrame:
    """Dictionary keys that a text holds as a substring: `id_col`, `entity`, `key` (the longest).

    Keys of any length may begin and end inside words, so no split into words finds them: an
    automaton over the keys reads each text once, in Arrow batches where the text lies. The
    keys are cut into parts of bounded bytes by a hash of their entity; each part is sent to
    the tasks on its own, and the texts are read once for each part. Of keys with the same
    length the first by text is given; rows with equal ids count together; null texts hold nothing.
    """
    spark = texts.sparkSession
    keyed = dictionary.where(F.length("key") > 0).select("key", "entity").distinct()
    size = keyed.agg(F.sum(F.octet_length("key") + 64)).head()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("entity"), F.lit(parts)))
    rows = texts.select(F.col(id_col).alias("_id"), F.lower(F.col(column)).alias("_text"))
    kind = texts.schema[id_col].dataType.simpleString()
    entities = dictionary.schema["entity"].dataType
    found = None
    for part in range(parts):
        own = dealt.where(F.col("part") == part).toPandas()
        numbers, names = pd.factorize(own["entity"])
        keys = spark.sparkContext.broadcast(list(zip(own["key"], numbers.tolist(), strict=True)))
        hits = rows.mapInArrow(lambda batches, keys=keys: _find(batches, keys), f"_id {kind}, _entity long, key string")
        listed = [(i, name.item() if hasattr(name, "item") else name) for i, name in enumerate(names)]
        named = spark.createDataFrame(listed, StructType([StructField("_entity", LongType()), StructField("entity", entities)]))
        hits = hits.join(F.broadcast(named), "_entity").select("_id", "entity", "key")  # as many as the part has keys at most
        found = hits if found is None else found.unionByName(hits)
    best = F.min(F.struct((-F.length("key")).alias("n"), "key")).alias("best")
    return found.groupBy(F.col("_id").alias(id_col), "entity").agg(best).select(id_col, "entity", "best.key")


def propose_aliases(entities: DataFrame) -> DataFrame:
    """Aliases that an entity's names suggest: `entity`, `alias`.

    The English name without company suffixes, the first of several words unless it is
    common or short, and the Japanese name.
    """
    base = text.strip_producer(F.col("name_en"))
    words = F.split(base, r"\s+")
    first = F.when((F.size(words) > 1) & (F.length(words[0]) > 2) & ~F.lower(words[0]).isin(*COMMON_WORDS), words[0])
    shorter = F.when(base != F.col("name_en"), base)
    every = F.array_distinct(F.array_compact(F.array(shorter, first, F.nullif("name_jp", F.lit("")))))
    return entities.select("entity", F.explode(every).alias("alias")).where("alias <> ''")


def summary(entities: DataFrame) -> DataFrame:
    """One row of counts: entities, those with a Japanese name, those with aliases, and all aliases."""
    n = F.coalesce(F.size("aliases"), F.lit(0))
    return entities.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.coalesce("name_jp", F.lit("")) != "").alias("with_japanese"),
        F.count_if(n > 0).alias("with_aliases"),
        F.sum(n.cast("long")).alias("aliases"),
    )


def to_fetch(wanted: DataFrame, known: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The wanted addresses (`url`) that are new, or that were last fetched (`url`, `updated_at`) `days` ago or earlier."""
    fresh = known.where(F.col("updated_at") > as_of - F.make_dt_interval(F.lit(days))).select("url").distinct()
    return wanted.select("url").distinct().join(fresh, "url", "left_anti")


def match_entities(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Match found producers (`url`, `name_en`) to entities (`entity`, `url`, `name_en`), by name, else by address.

    Adds `entity` and `action`: update, insert, or skip where the name's owner has another
    address - two pages of one producer, of which the first known stays.
    """
    by_url = entities.where("url IS NOT NULL").groupBy("url").agg(F.min("entity").alias("by_url"))
    owner = F.min(F.struct("entity", F.col("url").alias("own_url"))).alias("owner")
    by_name = entities.groupBy(F.lower(F.trim("name_en")).alias("key")).agg(owner)
    joined = found.join(by_url, "url", "left").join(by_name, F.lower(F.trim(found["name_en"])) == F.col("key"), "left")
    other = F.col("owner.own_url").isNotNull() & F.col("url").isNotNull() & (F.col("owner.own_url") != F.col("url"))
    known = F.coalesce("owner.entity", "by_url")
    action = F.when(other, "skip").when(known.isNotNull(), "update").otherwise("insert")
    return joined.select(*found.columns, F.when(action == "update", known).alias("entity"), action.alias("action"))


#: What a producer's page says of it.
PRODUCER_FACTS = ("location", "producer_type", "website", "logo")


def merge_producers(producers: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Take what producers' pages say (`details.producers`: `url`, `producer_name`, facts) into the producers' table.

    `producers` has `entity`, `url`, `name_en`, the facts and `updated_at`. A page updates the
    producer it matches (`match_entities`): address, name and all facts are the page's, also where it has none. A page of nobody known
    adds a producer with a null `entity`, for its store to number. Pages without a name and those that are skipped change nothing; of several pages of
    one producer the one with the least address counts. Adds `change`: updated, inserted or kept.
    """
    named = found.where(F.trim("producer_name") != "").select("url", F.col("producer_name").alias("name_en"), *PRODUCER_FACTS)
    pages = named.groupBy("url").agg(F.max(F.struct("name_en", *PRODUCER_FACTS)).alias("p")).select("url", "p.*")
    matched = match_entities(pages, producers)
    facts = ("url", "name_en", *PRODUCER_FACTS)
    updates = matched.where("action = 'update'").groupBy("entity").agg(F.min(F.struct(*facts)).alias("new"))
    updated = F.col("new").isNotNull()
    old = producers.join(updates, "entity", "left").select(
        "entity",
        *(F.when(updated, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in facts),
        F.when(updated, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(updated, "updated").otherwise("kept").alias("change"),
    )
    inserts = matched.where("action = 'insert'").groupBy(F.lower(F.trim("name_en"))).agg(F.min(F.struct(*facts)).alias("new"))
    none = F.lit(None).cast(producers.schema["entity"].dataType)
    return old.unionByName(inserts.select(none.alias("entity"), "new.*", now.alias("updated_at"), F.lit("inserted").alias("change")))


def conflicts(entities: DataFrame) -> DataFrame:
    """Aliases that are another entity's name once company suffixes are gone: `entity`, `alias`, `owner`."""
    plain = lambda c: text.key(text.strip_producer(c))
    names = entities.select(F.col("entity").alias("owner"), plain(F.col("name_en")).alias("plain"))
    aliases = entities.select("entity", F.explode("aliases").alias("alias")).withColumn("plain", plain(F.col("alias")))
    return aliases.join(names, "plain").where((F.col("entity") != F.col("owner")) & (F.col("plain") != "")).select("entity", "alias", "owner").distinct()


def learn_aliases(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """Take up new names seen for entities (`entity`, `name`), and return all entities.

    Names of one character, collaborations, stop words, names that another entity has and
    names that are known are refused. A Japanese name also becomes `name_jp` where that is
    empty, the least of several.
    """
    known = entries(entities)
    fresh = (
        seen.where(F.length(F.trim("name")) > 1)
        .where(~F.col("name").rlike(text.COLLABORATION) & ~F.lower(F.trim("name")).isin(*STOP_WORDS))
        .join(known.select("key"), F.lower(F.trim("name")) == F.col("key"), "left_anti")
    )
    sole = fresh.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("entity").alias("entity"), F.max("entity").alias("other"), F.min(F.trim("name")).alias("name"))
    learned = sole.where("entity = other").groupBy("entity").agg(
        F.array_sort(F.collect_list("name")).alias("new"), F.min(F.when(text.has_japanese(F.col("name")), F.col("name"))).alias("jp")
    )
    none = F.array().cast("array<string>")
    return entities.join(learned, "entity", "left").select(
        "entity",
        "name_en",
        F.coalesce(F.nullif("name_jp", F.lit("")), "jp").alias("name_jp"),
        F.array_union(F.coalesce("aliases", none), F.coalesce("new", none)).alias("aliases"),
    )
