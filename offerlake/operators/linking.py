"""A linking run: choose offers, try one way after the other on what is left, and keep the ledger.

Each way to find a product is a pass over the offers that no earlier one settled. A pass
adds its links to one table with the way they were found (`how`); what is still open at the end
gets a reason, and both feed the ledger of failures that decides who is tried next time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text, titles
from offerlake.functions.matching import match_score
from offerlake.operators import blocking, dictionary, ingest, linkage
from offerlake.operators.catalog import has_product
from offerlake.plans.lineage import checkpointed

MODES = ("missing", "refresh", "retry-failures")
#: Why an offer has no link.
REASONS = (
    "missing_info", "no_results", "network_error", "validation_failed", "details_error", "final_validation_mismatch", "model_error", "model_no_info",
)
#: How a link was found, in the order of the passes.
WAYS = ("kept", "refreshed", "offline", "search", "web", "inferred")


def queue(wide: DataFrame, ledger: DataFrame, mode: str, now: Column, force: bool = False, limit: int | None = None) -> DataFrame:
    """The offers of a run: `wide`'s rows, in the order of `position` if there is a limit.

    `missing` takes offers without a product, or whose product is unknown, newest first,
    unless the ledger holds them back; `refresh` takes linked ones in stock whose facts are stale,
    oldest first; `retry-failures` takes those with an open entry in the ledger, longest waiting first.
    With `force` neither ledger nor age holds any back.
    """
    if mode == "missing":
        unknown = ~has_product(F.coalesce("product_url", F.lit("/search?")), any_case=True) | F.col("product_name").isNull()
        rows = wide.where(unknown & (F.coalesce("product_type", F.lit("beer")) == "beer"))
        rows, order = ingest.due(rows, ledger, now, force=force), [F.desc_nulls_last("first_seen"), F.col("url")]
    elif mode == "refresh":
        rows = wide.where(has_product(F.col("product_url")) & ~text.is_out(F.col("stock_status"))) if force else linkage.to_refresh(wide, now)
        order = [F.asc_nulls_first("fetched_at"), F.col("url")]
    elif mode == "retry-failures":
        open_ = ledger.where(~F.col("resolved")).groupBy("url").agg(F.min("last_at").alias("_waiting"))
        rows, order = wide.join(open_, "url"), [F.col("_waiting"), F.col("url")]
    else:
        raise ValueError(f"no such mode: {mode}")
    chosen = rows.orderBy(*order).limit(limit) if limit is not None else rows
    return chosen.select(*wide.columns)


@dataclass(frozen=True)
class Known:
    """What a run may use. Everything but the products may be absent.

    products: product_url, product_name, producer_name, producer_url, style - with details fetched
    dictionary, addresses: see `blocking.maker_blocks`; entities: see `dictionary.learn_aliases`
    cached: url, product_url - links found by an earlier extraction
    web: url, product_url, title; verdicts: url, product_url; inferred: url, nth, maker, name
    faults: url, reason - what the search or a model ran into
    """

    products: DataFrame
    dictionary: DataFrame | None = None
    addresses: DataFrame | None = None
    cached: DataFrame | None = None
    web: DataFrame | None = None
    verdicts: DataFrame | None = None
    inferred: DataFrame | None = None
    faults: DataFrame | None = None


@dataclass(frozen=True)
class Run:
    """What a run did: `outcomes` (url, product_url, how, score, reason), the `ledger` after it, and `seen` (producer, maker), names to learn."""

    outcomes: DataFrame
    ledger: DataFrame
    seen: DataFrame


def named(offers: DataFrame, known: Known, shops: tuple[str, ...]) -> DataFrame:
    """Offers (`url`, `title`, `maker`, `name`, `name_jp`) with makers and names mended where the dictionary allows.

    A maker that is one of the shops' own names is none.
    """
    if shops:
        offers = offers.withColumn("maker", F.when(~F.lower(F.trim("maker")).isin(*shops), F.col("maker")))
    if known.dictionary is None:
        hits = _nothing(offers, "maker string, key string")
    else:
        found = dictionary.find_in_texts(offers.select("url", "title"), "url", "title", known.dictionary)
        hits = found.select("url", F.col("entity").cast("string").alias("maker"), "key")
        offers = oriented(offers, known.dictionary)
    return linkage.repair(offers, hits, shops)


def oriented(offers: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Maker and name of titles that hold `【one/other】`, for offers that lack one of the two.

    The half in which the dictionary finds a key is the maker, the second if both do; where it finds
    none the second is the maker, if the offer has none. Both halves of all titles are searched in one pass.
    """
    pattern = r"【(.*?)[/／](.*?)】"
    half = lambda n: F.trim(F.regexp_extract("title", pattern, n))
    lacks = (F.coalesce("maker", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "")
    split = offers.withColumns({"_one": F.when(lacks & F.col("title").rlike(pattern), half(1)), "_two": F.when(lacks & F.col("title").rlike(pattern), half(2))})
    halves = split.select(F.explode(F.array("_one", "_two")).alias("half")).where("half <> ''").distinct()
    held = dictionary.find_in_texts(halves, "half", "half", known_keys).select("half").distinct().withColumn("held", F.lit(True))
    both = split.join(held.select(F.col("half").alias("_one"), F.col("held").alias("_held_one")), "_one", "left")
    both = both.join(held.select(F.col("half").alias("_two"), F.col("held").alias("_held_two")), "_two", "left")
    second = F.col("_held_two").isNotNull() | (F.col("_held_one").isNull() & (F.coalesce("maker", F.lit("")) == ""))
    first = F.col("_held_two").isNull() & F.col("_held_one").isNotNull()
    maker = F.when(F.col("_one").isNull(), F.col("maker")).when(second, F.col("_two")).when(first, F.col("_one")).otherwise(F.col("maker"))
    name = F.when(F.col("_one").isNull(), F.col("name")).when(second, F.col("_one")).when(first, F.col("_two")).otherwise(F.col("name"))
    return both.withColumns({"maker": titles.first_named(maker), "name": titles.first_named(name)}).select(*offers.columns)


def _nothing(like: DataFrame, columns: str) -> DataFrame:
    """An empty table with the url of `like` and further columns."""
    return like.sparkSession.createDataFrame([], f"url {like.schema['url'].dataType.simpleString()}, {columns}")


def _link(rows: DataFrame, how: str, score: Column | None = None) -> DataFrame:
    return rows.select("url", "product_url", F.lit(how).alias("how"), (F.lit(None) if score is None else score).cast("int").alias("score"))


def _still(open_: DataFrame, *links: DataFrame) -> DataFrame:
    for done in links:
        open_ = open_.join(done.select("url"), "url", "left_anti")
    return open_


def run(
    offers: DataFrame,
    known: Known,
    ledger: DataFrame,
    now: Column,
    mode: str = "missing",
    shops: tuple[str, ...] = (),
    offline: bool = False,
    score: linkage.Score = match_score,
    check: linkage.Check = linkage.validated,
) -> Run:
    """Link the offers of a queue (`url`, `title`, `maker`, `name`, `name_jp`, `product_url`; one row a url).

    An offer with a link keeps it if its product isn't wrong, `kept`; in `refresh` it is `refreshed`,
    and has the reason details_error if no details of its product came. Links cached by an extraction come next. Then
    follow the search among the maker's products, the web for those with too little, a model's verdict on
    both, and what a model inferred for those that found nothing; with `offline`, equal names
    alone. A new link is held against the title once more with its product's facts. `score` and `check` are
    the functions that say how well names match and whether a choice stands.

    Every url has one outcome, with a link or one of `REASONS`; details_error has both, for the link stands and only its
    product's facts are missing. Outcomes without a reason resolve the ledger's entries, reasons count on in it. Offers with a
    null url are left out; of several rows of a url any one counts.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    columns = ("url", "title", "maker", "name", "name_jp", "product_url")
    given = checkpointed(offers.where("url IS NOT NULL").select(*columns).dropDuplicates(["url"]))
    linked = given.where(has_product(F.col("product_url")))
    facts = known.products.groupBy("product_url").agg(F.max(F.struct("product_name", "producer_name", "style")).alias("p")).select("product_url", "p.*")
    if mode == "refresh":
        there = linked.join(facts.select("product_url", F.lit(True).alias("there")), "product_url", "left")
        outcome = there.select(
            "url", "product_url", F.when(F.col("there"), WAYS[1]).alias("how"), F.lit(None).cast("int").alias("score"), F.when(F.col("there").isNull(), "details_error").alias("reason")
        )
        return _finish(checkpointed(outcome), given, facts, ledger, now)

    rows = checkpointed(named(given, known, shops))
    whole = rows.where("maker IS NOT NULL AND name IS NOT NULL")
    pool = linked.select("url", "product_url")
    if known.cached is not None:
        cached = known.cached.where(has_product(F.col("product_url"))).groupBy("url").agg(F.min("product_url").alias("product_url"))
        pool = pool.unionByName(_still(cached.join(given.select("url"), "url", "left_semi"), pool))
    judged = pool.join(whole.select("url", "name", "maker"), "url")
    kept = checkpointed(_link(linkage.keep_valid_links(judged, known.products).where("product_url IS NOT NULL"), WAYS[0]))
    open_ = checkpointed(_still(whole, kept))
    if offline:
        found = [_link(linkage.link_offline(open_, known.products), WAYS[2])]
        return _finish(_outcomes(rows, [kept, *found], known, facts, check), rows, facts, ledger, now)

    blocks = None if known.dictionary is None or known.addresses is None else checkpointed(blocking.maker_blocks(open_, known.dictionary, known.addresses))
    scores = checkpointed(linkage.link_scores(open_, known.products, blocks, score).select("url", "product_url", "score").distinct())
    both = scores.withColumn("source", F.lit("search")) if known.web is None else linkage.with_web(open_, scores, known.web)
    chosen = linkage.decide(both, known.verdicts).join(both.select("url", "product_url", "source").distinct(), ["url", "product_url"])
    searched = checkpointed(chosen.select("url", "product_url", F.col("source").alias("how"), F.col("score").cast("int").alias("score")))
    found = [kept, searched]
    if known.inferred is not None:
        missed = _still(open_, searched)
        second = linkage.second_chance(missed, known.inferred, known.products)
        found.append(_link(second, WAYS[5], F.col("score")))
    return _finish(_outcomes(rows, found, known, facts, check), rows, facts, ledger, now)


def _outcomes(rows: DataFrame, found: list[DataFrame], known: Known, facts: DataFrame, check: linkage.Check) -> DataFrame:
    """One outcome for each offer: its link, if that stands against the title, or the reason for none."""
    faults = _nothing(rows, "fault string")
    if known.faults is not None:
        faults = known.faults.groupBy("url").agg(F.max("reason").alias("fault"))
    open_ = rows.select("url", "title", "maker", "name")
    for number, links in enumerate(found):  # a pass only has offers that no earlier one settled
        open_ = open_.join(links.select("url", F.struct("product_url", "how", "score").alias(f"_{number}")), "url", "left")
    first = F.coalesce(*(F.col(f"_{number}") for number in range(len(found))))
    linked = open_.withColumn("_first", first).select("url", "title", "maker", "name", "_first.*")
    joined = linked.join(facts, "product_url", "left").join(faults, "url", "left")
    stands = check(F.col("title"), F.col("product_name"), F.col("style"), F.col("producer_name"), F.col("maker"))
    new = F.col("product_url").isNotNull() & (F.col("how") != WAYS[0])
    reason = (
        F.when(F.col("maker").isNull() | F.col("name").isNull(), F.coalesce("fault", F.lit("missing_info")))
        .when(F.col("product_url").isNull(), F.coalesce("fault", F.lit("no_results")))
        .when(new & F.col("product_name").isNull(), "details_error")
        .when(new & ~stands, "final_validation_mismatch")
    )
    gone = F.col("reason").isin("missing_info", "no_results", "final_validation_mismatch") | F.col("product_url").isNull()
    return checkpointed(
        joined.withColumn("reason", reason).select(
            "url", F.when(~F.coalesce(gone, F.lit(False)), F.col("product_url")).alias("product_url"), F.when(F.col("reason").isNull(), F.col("how")).alias("how"), "score", "reason"
        )
    )


def _finish(outcomes: DataFrame, rows: DataFrame, facts: DataFrame, ledger: DataFrame, now: Column) -> Run:
    events = outcomes.select("url", F.col("reason").isNull().alias("ok"), "reason", now.alias("at"))
    new = outcomes.where("reason IS NULL AND how <> 'kept'").join(facts, "product_url")
    seen = new.join(rows.select("url", "maker"), "url").where("producer_name IS NOT NULL AND maker <> ''").select(F.col("producer_name").alias("producer"), "maker").distinct()
    return Run(outcomes, ingest.record_failures(ledger, events), seen)
