"""Link offers to products: candidates by block, scores, one choice, and reasons for none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import matching, text, titles
from offerlake.functions.matching import match_score, producers_match
from offerlake.operators import blocking, classes
from offerlake.operators.catalog import has_product
from offerlake.plans.lineage import checkpointed

# What a title says of mixed drinks and of cask ale.
MIXED_DRINKS = ("cocktail", "rtd", "ハードセイツァー", "カクテル", "チューハイ")
CASK = ("real", "リアルエール", "カスク", "cask")
REASONS = ("missing_info", "no_results", "validation_failed")


def to_link(wide: DataFrame) -> DataFrame:
    """Offers that need a link: none or a search as link, and a beer or of unknown type."""
    kind = F.coalesce("product_type", F.lit("beer")) == "beer"
    return wide.where(~has_product(F.coalesce("product_url", F.lit("/search?")), any_case=True) & kind)


def first_link(*links: Column) -> Column:
    """The first of several links that leads to a product."""
    return F.coalesce(*(F.when(has_product(link), link) for link in links))


def to_refresh(wide: DataFrame, as_of: Column, days: int = 5) -> DataFrame:
    """Linked offers in stock whose product facts are missing or stale, oldest first."""
    stale = F.col("fetched_at").isNull() | (F.col("fetched_at") < as_of - F.make_dt_interval(F.lit(days))) | F.col("product_name").isNull()
    live = has_product(F.col("product_url")) & ~text.is_out(F.col("stock_status"))
    return wide.where(live & stale).orderBy(F.asc_nulls_first("fetched_at"), "url")


block = blocking.plain_block


def candidates(wanted: DataFrame, products: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Products in the blocks of the makers of an offer (`url`, `maker`, `name`), each pair once.

    `products` has product_url, product_name, producer_name and style, and with `blocks`
    (`blocking.maker_blocks`) also producer_url; without, collaborators' plain names are the blocks.
    Names meet when they share a word, the year aside, so a large block isn't paired with itself.
    """
    rows = wanted.select("url", "maker", "name").distinct().withColumn("words", blocking.words(F.col("name")))
    facts = ("product_url", "product_name", "producer_name", "style")
    if blocks is None:
        plain = F.array_distinct(F.transform(text.collaborators(F.col("maker")), block))
        left = rows.withColumn("block", F.explode(plain))
        right = products.select(*facts, block(F.col("producer_name")).alias("block"))
    else:
        left = rows.join(blocks.select("url", "block"), "url")
        right = blocking.product_blocks(products.select(*facts, "producer_url"))
    named = right.select(*facts, "block").distinct().withColumn("words", blocking.words(F.col("product_name")))
    return blocking.pairs_by_word(left, named, "url", "product_url").drop("block")


Score = Callable[[Column, Column, Column, Column, Column], Column]
Check = Callable[..., Column]


def scored(pairs: DataFrame, score: Score = match_score) -> DataFrame:
    """Score each distinct pair of names once; `score` takes product name, producer, style, name and maker."""
    names = ["product_name", "producer_name", "style", "name", "maker"]
    scores = pairs.select(*names).distinct().withColumn("score", score(*(F.col(n) for n in ("product_name", "producer_name", "style", "name", "maker"))))
    same = [F.col(f"p.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
    return pairs.alias("p").join(scores.alias("s"), same).select("p.*", "s.score")


#: Results of a search that are looked at, and those that are kept. Fixed values.
SCANNED, KEPT = 50, 15


def best_candidates(found: DataFrame, scanned: int = SCANNED, kept: int = KEPT) -> DataFrame:
    """The best of what a search listed for an offer (`url`, `product_url`, `score`, `pos`): the same with `rank`.

    Of the first `scanned` results those with a score above 0 are ranked by score, equal
    ones in the order found, and `kept` stay. The limit stands above a row number, which
    Spark turns into a limit of each group before it shuffles: a task sends on `scanned` rows of
    an offer at most, and the second ranking needs no further shuffle.
    """
    listed = F.row_number().over(Window.partitionBy("url").orderBy("pos", "product_url"))
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "pos", "product_url"))
    first = found.withColumn("_nth", listed).where(F.col("_nth") <= scanned).drop("_nth")
    return first.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= kept)


def validated(title: Column, product_name: Column, style: Column, producer: Column, maker: Column | None = None) -> Column:
    """Whether a choice stands against the shop's title.

    The producers must agree where the maker is known; a mixed drink needs a title that
    says so; a vintage must be in the title; and so must real ale or cask.
    """
    low, name = F.lower(title), F.lower(product_name)
    says = lambda words: low.rlike("|".join(words))
    drink = ~F.coalesce(F.lower(style).rlike("rtd|cocktail|hard seltzer"), F.lit(False)) | says(MIXED_DRINKS)
    year = F.regexp_substr(name, F.lit(r"\b20\d{2}(?:by)?\b"))
    years = F.regexp_extract_all(low, F.lit(r"(?<![0-9a-z])(20[0-9]{2})(?:by)?(?![0-9a-z])"), 1)  # four digits within a code are no year
    vintage = year.isNull() | F.array_contains(years, F.left(year, F.lit(4)))
    cask = ~name.rlike("real ale|cask") | says(CASK)
    agree = F.lit(True) if maker is None else producers_match(producer, maker)
    checked = F.coalesce(drink & vintage & cask & agree, F.lit(False))
    return F.when((F.coalesce(title, F.lit("")) == "") | (F.coalesce(producer, F.lit("")) == ""), True).otherwise(checked)


def plausible(title: Column, product_name: Column, producer: Column) -> Column:
    """The verdict on a pair where no model can be asked: a word of four letters or more of each name is in the title."""
    low = F.lower(title)

    def there(name: Column) -> Column:
        words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: F.length(w) >= 4)
        return F.contains(low, F.lower(name)) | F.exists(words, lambda w: F.contains(low, w))

    full = (F.coalesce(c, F.lit("")) != "" for c in (title, product_name, producer))
    return F.coalesce(next(full) & next(full) & next(full) & there(product_name) & there(producer), F.lit(False))


def repair(wanted: DataFrame, dictionary_hits: DataFrame, shops: tuple[str, ...] = ()) -> DataFrame:
    """Mend maker and name of offers (`url`, `title`, `maker`, `name`) before they are linked.

    A maker that is one of the shops' own names is none. A title that begins with the
    maker in square brackets overrules both; a missing maker is the longest dictionary
    key that the title holds (`dictionary_hits`: url, maker, key); a missing name is the
    title. Offers that still lack one get no candidates and the reason `missing_info`.
    """
    own = F.when(F.lower(F.trim("maker")).isin(*shops), None).otherwise(F.col("maker")) if shops else F.col("maker")
    by_title, rest = titles.bracketed_title(F.col("title"))
    named = F.when(~F.lower(by_title).isin(*shops), by_title) if shops else by_title
    best = dictionary_hits.groupBy("url").agg(F.max_by("maker", F.struct(F.length("key"), "key", "maker")).alias("held"))
    mended = wanted.withColumn("_named", named)
    return mended.join(best, "url", "left").select(
        *(c for c in wanted.columns if c not in ("maker", "name")),
        titles.first_named(F.col("_named"), own, F.col("held")).alias("maker"),
        titles.first_named(F.when(F.col("_named").isNotNull(), rest), F.col("name"), F.col("title")).alias("name"),
    )


def keep_valid_links(linked: DataFrame, products: DataFrame) -> DataFrame:
    """Links that an offer already has (`url`, `product_url`, `name`, `maker`): clear those whose product scores 0.

    A product that isn't known counts as valid.
    """
    known = products.groupBy("product_url").agg(F.max(F.struct("product_name", "producer_name", "style")).alias("p"))
    pairs = linked.join(known, "product_url").select("url", "product_url", "name", "maker", "p.*")
    wrong = scored(pairs).where("score = 0").select("url", "product_url").distinct().withColumn("wrong", F.lit(True))
    return linked.join(wrong, ["url", "product_url"], "left").select(
        *(c for c in linked.columns if c != "product_url"),
        F.when(F.col("wrong").isNull(), F.col("product_url")).alias("product_url"),
    )


def in_stages(found: DataFrame, enough: int = 5, size: str | None = None) -> DataFrame:
    """Candidates (`url`, `product_url`, `stage` from 1, `pos`) of the stages that are needed.

    A stage counts only where those before it brought fewer than `enough` candidates of
    the offer; a product found twice stays with its first stage. The column `size` says how many products a candidate stands for.
    """
    number = F.lit(1).cast("long") if size is None else F.col(size)
    first = found.groupBy("url", "product_url").agg(F.min(F.struct("stage", "pos")).alias("at"), F.max(number).alias("_size"))
    counts = first.groupBy("url", "at.stage").agg(F.sum("_size").alias("n"))
    before = Window.partitionBy("url").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("had", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("had") < enough)
    kept = first.select("url", "product_url", "at.stage", "at.pos").join(needed.select("url", "stage"), ["url", "stage"], "left_semi")
    return kept.select("url", "product_url", "stage", "pos")


def retrieve(wanted: DataFrame, products: DataFrame, enough: int = 5) -> DataFrame:
    """Products of an offer's makers (`url`, `maker`, `name`, `name_jp`) by name, else by Japanese name, else by token.

    A probe meets the products of its block whose name, or a word or written-out release
    of it, has the same key. Later stages count only where the earlier ones brought too few
    (`in_stages`): `url`, `product_url`, `stage` 1 to 3, `pos` of the token.

    Offers of the same texts are one class, as are products. Probes and keys are made once a class; classes are joined and counted, tokens
    only for classes whose names brought fewer than `enough`; what they found is written out for their members last.
    """
    # the texts of an offer or a product make its class, all of them where it has several rows; offers without a url are found by nobody
    said = lambda df, key, *columns: df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("said"))
    offers = checkpointed(classes.grouped(said(wanted.where("url IS NOT NULL"), "url", "maker", "name", "name_jp"), "said"))
    goods = checkpointed(classes.grouped(said(products, "product_url", "product_name", "producer_name"), "said"))
    probe = lambda stage, pos, c: F.struct(F.lit(stage).alias("stage"), pos.alias("pos"), text.key(c).alias("probe"))
    kind = "array<struct<stage:int,pos:int,probe:string>>"
    tokens = F.concat(*(F.coalesce(text.search_tokens(F.col(c)), F.array().cast("array<string>")) for c in ("name", "name_jp")))
    tried = F.transform(F.slice(F.array_distinct(tokens), 1, text.TRIED), lambda t, i: probe(3, i, t)).cast(kind)
    whole = F.array(probe(1, F.lit(0), text.without_year(F.col("name"))), probe(2, F.lit(0), text.without_year(F.col("name_jp")))).cast(kind)
    asking = offers.select("said").distinct().select(F.col("said").alias("url"), F.explode("said").alias("s")).select("url", "s.*")
    makers = asking.select("url", F.explode(text.collaborators(F.col("maker"))).alias("one"), F.concat(whole, tried).alias("probes"))
    ours = makers.select("url", block(F.col("one")).alias("block"), F.explode("probes").alias("p")).select("url", "block", "p.*").where("block IS NOT NULL AND probe <> ''")
    name = F.col("product_name")
    release = F.regexp_extract(text.expand_abbreviations(name), r"(?i)limited release [0-9]+", 0)
    held = F.concat(F.array(text.without_year(name), release), F.split(name, r"[\s/—–\-()（）\[\]]+"), F.regexp_extract_all(name, F.lit("([0-9]+)")))
    keys = F.array_distinct(F.transform(held, text.key))
    sized = goods.groupBy("said").agg(F.sum(F.size("members").cast("long")).alias("size"))
    answering = sized.select(F.col("said").alias("product_url"), "size", F.explode("said").alias("s")).select("product_url", "size", "s.*")
    theirs = answering.select("product_url", "size", block(F.col("producer_name")).alias("block"), F.explode(keys).alias("probe")).where("block IS NOT NULL AND probe <> ''").distinct()

    by_name = ours.where("stage < 3").join(theirs, ["block", "probe"]).select("url", "product_url", "size", "stage", "pos")
    settled = by_name.select("url", "product_url", "size").distinct().groupBy("url").agg(F.sum("size").alias("n")).where(F.col("n") >= enough)
    by_token = ours.where("stage = 3").join(settled.select("url"), "url", "left_anti").join(theirs, ["block", "probe"]).select("url", "product_url", "size", "stage", "pos")
    needed = in_stages(by_name.unionByName(by_token), enough, "size")
    one, two = offers.select(F.col("said").alias("url"), F.col("members").alias("l")), goods.select(F.col("said").alias("product_url"), F.col("members").alias("r"))
    met = needed.join(one, "url").join(two, "product_url").select("stage", "pos", "l", "r")
    return classes.written_out(met, "l", "r").select("l.url", "r.product_url", "stage", "pos")


def link_offline(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """Products of the same name, case aside, whose producer's name holds the offer's maker: `url`, the least `product_url`.

    Distinct names with their makers and producers meet, so neither repeated offers nor repeated products multiply.
    """
    named = products.groupBy(F.lower("product_name").alias("_name"), F.lower("producer_name").alias("_producer")).agg(F.min("product_url").alias("product_url"))
    rows = wanted.where(F.length("maker") > 0).select("url", F.lower("name").alias("_name"), F.lower("maker").alias("_maker"))
    met = rows.select("_name", "_maker").distinct().join(named, "_name").where(F.contains("_producer", "_maker"))
    best = met.groupBy("_name", "_maker").agg(F.min("product_url").alias("product_url"))
    return rows.join(best, ["_name", "_maker"]).groupBy("url").agg(F.min("product_url").alias("product_url"))


def second_chance(missed: DataFrame, inferred: DataFrame, products: DataFrame, most: int = 5) -> DataFrame:
    """Link offers that found nothing (`url`) by what a model inferred (`url`, `nth`, `maker`, `name`).

    `nth` 0 is the inferred maker and name, 1 to `most` are other queries; the first that
    leads to a valid link counts: `url`, `product_url`, `score`, `nth`.
    """
    tries = inferred.where(F.col("nth").between(0, most)).join(missed.select("url").distinct(), "url", "left_semi")
    keyed = tries.select(F.struct("url", "nth").alias("url"), "maker", "name").distinct()
    linked = link(keyed, products).where("product_url IS NOT NULL").select("url.url", "url.nth", "product_url", "score")
    first = Window.partitionBy("url").orderBy("nth", F.desc("score"), "product_url")
    return linked.withColumn("row", F.row_number().over(first)).where("row = 1").select("url", "product_url", "score", "nth")


def variants_clash(candidate: Column, expected: Column) -> Column:
    """Whether one name has a variant that the other lacks.

    A candidate may go on after an expected name that has no variants, if what follows has
    the variants or a style.
    """
    held = F.struct(text.variants(candidate).alias("one"), text.variants(expected).alias("two"))
    return text.let(held, lambda v: _clash(candidate, expected, v["one"], v["two"]))


def _clash(candidate: Column, expected: Column, one: Column, two: Column) -> Column:
    """`variants_clash` of names whose variants are known."""
    long, short = text.key(candidate), text.key(expected)
    describing = F.array(*map(F.lit, matching.DESCRIBING))
    described = text.let(F.substr(long, F.length(short) + 1), lambda rest: F.exists(F.concat(one, describing), lambda w: F.contains(rest, w)))
    extends = (F.size(two) == 0) & (F.length(short) >= 4) & F.startswith(long, short) & described
    return (one != two) & ~extends


#: The score that a web result counts with; it comes behind every product that the search of the maker brought.
WEB_SCORE = 80


def with_web(wanted: DataFrame, scores: DataFrame, web: DataFrame) -> DataFrame:
    """All scores above 0 with their `source`, and web results for offers with too few or too weak candidates.

    `wanted` has url, maker, name and maybe name_jp; `web` has url, product_url and title.
    Offers of `wanted` with no candidate, or with fewer than three of which none scores 90,
    get the results that lead to a product and whose title holds a collaborator of the maker
    and the name, as it is, without treatments and dates, or in Japanese, and no variant that the name
    lacks. An offer without a maker or a name is held to the other one only.
    """
    good = scores.where("score > 0")
    state = good.groupBy("url").agg(F.countDistinct("product_url").alias("n"), F.max("score").alias("top"))
    offers = wanted.select("url", "maker", "name", F.col("name_jp") if "name_jp" in wanted.columns else F.lit(None).cast("string").alias("name_jp")).distinct()
    weak = offers.join(state, "url", "left").where("n IS NULL OR (n < 3 AND top < 90)").drop("n", "top")
    said = text.key(F.col("title"))
    held = lambda part: (F.length(part) > 0) & F.contains(said, part)
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    by_maker = none("maker") | F.exists(text.collaborators(F.col("maker")), lambda m: held(text.key(text.strip_producer(m))))
    plain = held(text.key(text.without_year(F.col("name")))) | held(text.key(text.cleaned(F.col("name"))))
    by_name = none("name") | plain | F.coalesce(held(text.key(F.col("name_jp"))), F.lit(False))
    fits = by_maker & by_name & (none("name") | ~variants_clash(F.col("title"), F.col("name")))
    more = web.where(has_product(F.col("product_url"))).select("url", "product_url", "title").join(weak, "url").where(fits).select("url", "product_url").distinct()
    old = good.select("url", "product_url", "score", F.lit("search").alias("source"))
    new = more.join(old, ["url", "product_url"], "left_anti")
    return old.unionByName(new.select("url", "product_url", F.lit(WEB_SCORE).alias("score"), F.lit("web").alias("source")))


def decide(scores: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Choose one candidate of each offer: `url`, `product_url`, `score`.

    `verdicts` (`url`, `product_url`; null: all rejected) are what a model said. Its
    choice stands; where it rejected all, the first is taken only if it scores 90 or is
    from the web; where it said nothing, the first. The order is search before web, then
    the score, then the product.
    """
    scores = scores if "source" in scores.columns else scores.withColumn("source", F.lit("search"))
    best = Window.partitionBy("url").orderBy(F.col("source") == "web", F.desc("score"), "product_url")
    if verdicts is None:
        verdicts = scores.select("url", "product_url").limit(0)
    said = verdicts.groupBy("url").agg(F.max("product_url").alias("chosen"), F.lit(True).alias("asked"))
    ranked = scores.where("score > 0").withColumn("nth", F.row_number().over(best)).join(said, "url", "left")
    strong = (F.col("score") >= 90) | (F.col("source") == "web")
    allowed = F.when(F.col("chosen").isNotNull(), F.col("product_url") == F.col("chosen")).otherwise((F.col("nth") == 1) & (F.col("asked").isNull() | strong))
    return ranked.where(allowed).groupBy("url", "product_url").agg(F.max("score").alias("score"))


def _scored_classes(wanted: DataFrame, products: DataFrame, blocks: DataFrame | None, score: Score) -> tuple[DataFrame, DataFrame]:
    """Offers with their `class`, which is maker, name and blocks, and the scores above 0 of each class."""
    rows = wanted.where("name IS NOT NULL AND maker IS NOT NULL").select("url", "maker", "name").distinct()
    if blocks is None:
        rows = rows.withColumn("blocks", F.array().cast("array<string>"))
    else:
        rows = rows.join(blocks.groupBy("url").agg(F.array_sort(F.collect_set("block")).alias("blocks")), "url")
    rows = rows.select("url", F.struct("maker", "name", "blocks").alias("class"))
    alike = rows.select(F.col("class").alias("url"), "class.maker", "class.name").distinct()
    pairs = candidates(alike, products, None if blocks is None else alike.select("url", F.explode("url.blocks").alias("block")))
    name = F.col("name")
    tries = F.when(name.rlike(r"\b20\d{2}\b"), F.array(name, text.without_year(name))).otherwise(F.array(name))
    tried = pairs.withColumn("tries", tries).select(*(c for c in pairs.columns if c != "name"), F.posexplode("tries").alias("retry", "name"))
    return rows, scored(tried, score).where("score > 0").withColumnRenamed("url", "class")


def link_scores(wanted: DataFrame, products: DataFrame, blocks: DataFrame | None = None, score: Score = match_score) -> DataFrame:
    """Candidates of offers (`url`, `maker`, `name`) with a score above 0, and the products' facts.

    A name with a year is also tried without it, and such scores count where the name itself
    brought none: `retry`. The candidates are the same, for years name no block. Offers of the same maker, name and blocks
    are scored as one.
    """
    rows, found = _scored_classes(wanted, products, blocks, score)
    good = rows.join(checkpointed(found), "class").drop("class")
    needed = good.groupBy("url").agg(F.min("retry").alias("retry"))
    return good.join(needed, ["url", "retry"])


def link(
    wanted: DataFrame, products: DataFrame, blocks: DataFrame | None = None, score: Score = match_score, check: Check = validated
) -> DataFrame:
    """Link offers: one row for each `url`, with `product_url`, `score`, `reason` (null for a link, else one of REASONS).

    `score` and `check` say how well names match and whether a choice stands against the
    offer's `title`, or its name where there is none. Of an offer with several names the best counts.
    """
    said = F.col("title") if "title" in wanted.columns else F.col("name")
    rows = wanted.select("url", "maker", "name", said.alias("title"))
    # the least try that brought a score, and of its candidates the best: of each class, then of the offer's classes
    best = F.min(F.struct("retry", (-F.col("score")).alias("order"), "product_url", "product_name", "producer_name", "style")).alias("best")
    offers, good = _scored_classes(rows, products, blocks, score)
    chosen = offers.join(good.groupBy("class").agg(best), "class").groupBy("url").agg(F.min("best").alias("best")).select("url", "best.*")
    told = rows.groupBy("url").agg(F.max("title").alias("title"), F.bool_or(F.col("name").isNotNull() & F.col("maker").isNotNull()).alias("whole"))
    joined = told.join(chosen, "url", "left")
    ok = check(F.col("title"), F.col("product_name"), F.col("style"), F.col("producer_name"))
    reason = F.when(~F.col("whole"), REASONS[0]).when(F.col("product_url").isNull(), REASONS[1]).when(~ok, REASONS[2])
    return joined.withColumn("reason", reason).select(
        "url", F.when(F.col("reason").isNull(), F.col("product_url")).alias("product_url"), (-F.col("order")).alias("score"), "reason"
    )


def wrong_variants(linked: DataFrame) -> DataFrame:
    """Links whose two names disagree on variants (`variants_clash`): `url`, `product_url`, and what either lacks."""
    held = F.struct(text.variants(F.col("name")).alias("ours"), text.variants(F.col("product_name")).alias("theirs"))
    # a generated column: the filter and the result don't look for the variants once more
    both = linked.select("url", "product_url", "name", "product_name", F.explode(F.array(held)).alias("v")).select("*", "v.ours", "v.theirs")
    return both.where(_clash(F.col("product_name"), F.col("name"), F.col("theirs"), F.col("ours"))).select(
        "url",
        "product_url",
        F.array_join(F.array_except("ours", "theirs"), ",").alias("only_ours"),
        F.array_join(F.array_except("theirs", "ours"), ",").alias("only_theirs"),
    )
