"""Makers and names out of titles: what is known already, what the dictionary tells, and what a model says."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import titles
from offerlake.operators import providers
from offerlake.sources import answers

#: What an extraction says of an offer.
FIELDS = ("producer_jp", "producer_en", "name_jp", "name_en", "name_core", "search_hint", "product_type", "is_set")
#: Sizes, containers and styles that a name's core lacks. Fixed values.
NO_CORE = ("330ml", "350ml", "355ml", "440ml", "500ml", "缶", "瓶", "can", "bottle", "ipa", "stout", "pale ale", "neipa", "dipa")


def core_of(name: Column) -> Column:
    """A name without sizes, containers and styles; itself if nothing is left."""
    short = F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?iU)\b(?:{'|'.join(NO_CORE)})\b", ""), r"(?U)\s+", " "))
    return titles.first_named(short, name)


def by_title(offers: DataFrame, stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extractions of stored offers (`url`, `name`) with the very same title: `url`, the fields, `source`.

    Of several the one of the least url counts; those without an English maker don't.
    """
    known = extracted.where("producer_en IS NOT NULL").join(stored.where("name <> ''").select("url", "name"), "url")
    best = known.groupBy("name").agg(F.min(F.struct("url", *FIELDS)).alias("e")).select(F.col("name").alias("title"), "e.*")
    met = offers.where(F.trim("title") != "").select("url", "title").join(best.withColumnRenamed("url", "source"), "title")
    core = F.coalesce(F.nullif("name_core", F.lit("")), F.col("name_en"), F.lit(""))
    hint = F.coalesce(F.nullif("search_hint", F.lit("")), F.concat_ws(" ", "name_en", "producer_en"))
    return met.withColumns({"name_core": core, "search_hint": hint}).select("url", *FIELDS, F.col("source").cast("string").alias("source"))


def dictionary_keys(entities: DataFrame) -> DataFrame:
    """Keys of entities (`entity`, `name_en`, `name_jp`, `aliases`): names, aliases, and the English name without company words."""
    plain = F.trim(F.regexp_replace(F.lower("name_en"), r"\b(?:brewing|brewery|beer|co)\b", ""))
    keys = F.concat(F.array(F.lower("name_en"), plain, F.lower("name_jp")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))
    rows = entities.select(F.explode(F.array_distinct(F.array_compact(keys))).alias("key"), "entity", "name_en", "name_jp").where("key <> ''")
    return rows.groupBy("key").agg(F.max(F.struct("entity", "name_en", "name_jp")).alias("e")).select("key", "e.name_en", "e.name_jp")


def by_dictionary(offers: DataFrame, keys: DataFrame) -> DataFrame:
    """What a title of its shop's form (`form`, a key of `titles.TITLE_FORMS`) tells, if the dictionary knows its maker."""
    maker, name = titles.split_title(F.col("title"), F.col("form"))
    split = offers.where(F.trim("title") != "").select("url", maker.alias("maker"), titles.without_marks(name).alias("name")).where("maker IS NOT NULL AND name IS NOT NULL")
    met = split.join(keys, F.lower("maker") == F.col("key"))
    core = core_of(F.col("name"))
    return met.select(
        "url",
        titles.first_named(F.col("name_jp"), F.col("maker")).alias("producer_jp"),
        titles.first_named(F.col("name_en"), F.col("maker")).alias("producer_en"),
        F.col("name").alias("name_jp"), F.col("name").alias("name_en"), core.alias("name_core"), F.concat_ws(" ", core, "name_en").alias("search_hint"),
        F.lit("beer").alias("product_type"), F.lit(False).alias("is_set"), F.col("name_en").alias("source"),
    )


@dataclass(frozen=True)
class Extracted:
    """`rows` (url, FIELDS, how, source), `faults` (url, reason) for `linking.Known`, and the provider's `usage` after it."""

    rows: DataFrame
    faults: DataFrame
    usage: DataFrame


def extract(
    offers: DataFrame,
    stored: DataFrame,
    extracted: DataFrame,
    entities: DataFrame,
    provider: providers.Provider | providers.TableProvider,
    *order: Column,
    usage: DataFrame | None = None,
    day: Column | None = None,
    budget: int = providers.DAILY,
) -> Extracted:
    """Extract offers (`url`, `title`, `form`, `maker`, `shop`; one row a url).

    The same title comes first, `how` exact; then the dictionary; then the provider, in the
    given order and as far as the day's budget goes. What the title says of packs and goods overrules all three.
    Offers beyond the budget have neither a row nor a fault; an answer with neither maker nor name, or none at all, is
    model_no_info, a provider's fault model_error.
    """
    exact = by_title(offers, stored, extracted)
    told = by_dictionary(offers.join(exact.select("url"), "url", "left_anti"), dictionary_keys(entities))
    rest = offers.join(exact.select("url"), "url", "left_anti").join(told.select("url"), "url", "left_anti")
    asked, after = providers.ask(rest, "extract", provider, *order, usage=usage, day=day, budget=budget)
    read = answers.read_answers(asked.where("asked").select("url", "title", "answer", "error"))
    named = F.greatest(*(F.col(c).isNotNull().cast("int") for c in ("producer_en", "producer_jp", "name_en", "name_jp"))) == 1
    said = read.where(named).select("url", *FIELDS, F.lit(provider.name).alias("source"))
    fault = F.when(F.col("error").isNotNull(), "model_error").when(~named, "model_no_info")
    faults = read.select("url", fault.alias("reason")).where("reason IS NOT NULL")
    found = exact.withColumn("how", F.lit("exact")).unionByName(told.withColumn("how", F.lit("dictionary"))).unionByName(said.withColumn("how", F.lit("model")))
    return Extracted(answers.extraction(found.join(offers.select("url", "title"), "url"), "title").drop("title"), faults, after)
