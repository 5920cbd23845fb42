"""URL filters from association rules.

A labelled URL is a basket of tokens: the domains it lies in, the words of its host's
name, the words of its path and the names of its parameters, and its label. FP-growth mines the token combinations that
are frequent; those that imply a label with enough confidence become rules, and a rule
that a shorter one with as much confidence covers is dropped. Rules are indexed by their
rarest token, so a URL meets only the rules whose rarest token it has, and each such rule
is then compared whole.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.tables import checkpointed, parallelism, small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares that the pages with one set of tokens are dealt to; numbers are no tokens, so a site can have a third of all pages.
SALTS = 16
_LABEL = "label="
_RULE_SCHEMA = "rule_id string, items array<string>, verdict string, confidence double, support double, rarest string"


def host(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_words(url: Column) -> Column:
    """The words of two or more letters that the host's name is made of."""
    return F.filter(F.split(host(url), r"[^\p{L}]+"), lambda w: F.length(w) > 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted: domains of two or more labels, host words, path words, parameter names."""
    labels = F.split(F.regexp_replace(host(url), r":\d*$", ""), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), ".")),
    )
    words = F.filter(F.split(F.lower(path(url)), r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.filter(F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0]), lambda n: n != "")
    every = F.concat(
        F.filter(domains, lambda d: d != "host="),
        F.transform(host_words(url), lambda w: F.concat(F.lit("word="), w)),
        F.transform(words, lambda w: F.concat(F.lit("path="), w)),
        F.transform(names, lambda n: F.concat(F.lit("query="), n)),
    )
    return F.coalesce(F.array_sort(F.array_distinct(every)), F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "label",
    min_support: float = 0.002,
    min_rows: int = 8,
    min_confidence: float = 0.8,
    min_lift: float = 1.3,
) -> DataFrame:
    """Mine rules from URLs with a label: `rule_id`, `items`, `verdict`, `confidence`, `support`, `rarest`.

    A rule's items occur together with its label in at least `min_support` of the rows and
    in `min_rows` rows, imply it in `min_confidence` of theirs, and `min_lift` times as
    often as the label occurs at all. Rows without a URL or a label teach nothing; no rows
    give no rules.
    """
    spark = labelled.sparkSession
    baskets = labelled.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).select(
        F.array_append(tokens(F.col(url_col)), F.concat(F.lit(_LABEL), F.col(label_col))).alias("items")
    )
    rows = baskets.count()
    if not rows:
        return spark.createDataFrame([], _RULE_SCHEMA)
    support = min(1.0, max(min_support, min_rows / rows))
    model = FPGrowth(minSupport=support, minConfidence=min_confidence, numPartitions=parallelism(spark)).fit(baskets)
    found = model.associationRules.where(
        F.element_at("consequent", 1).startswith(_LABEL)
        & ~F.exists("antecedent", lambda a: a.startswith(_LABEL))
        & (F.col("lift") >= min_lift)
    ).select(
        F.array_sort("antecedent").alias("items"),
        F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 1000).alias("verdict"),
        "confidence",
        "support",
    )
    found = checkpointed(found.withColumn("rule_id", F.concat_ws(" ", "verdict", F.array_join("items", " "))))
    shorter = found.select(
        F.col("items").alias("part"), F.col("confidence").alias("as_sure"), F.col("verdict").alias("same"), F.col("items")[0].alias("item")
    )
    covered = (
        found.select("rule_id", "items", "verdict", "confidence", F.explode("items").alias("item"))
        .join(shorter, "item")
        .where(
            (F.col("verdict") == F.col("same"))
            & (F.col("as_sure") >= F.col("confidence"))
            & (F.size("part") < F.size("items"))
            & (F.size(F.array_except("part", "items")) == 0)
        )
        .select("rule_id")
        .distinct()
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rarest = (
        found.select("rule_id", F.explode("items").alias("item"))
        .join(single, "item")
        .groupBy("rule_id")
        .agg(F.min_by("item", F.struct("freq", "item")).alias("rarest"))
    )
    return found.join(covered, "rule_id", "left_anti").join(rarest, "rule_id").select(
        "rule_id", "items", "verdict", "confidence", "support", "rarest"
    )


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Find the surest rule for each distinct set of tokens: `tokens`, `verdict`, `confidence`, `evidence`.

    The surest rule has the highest confidence, then support, then the last name. Sets
    that fit no rule are left out.
    """
    rules = checkpointed(rules)
    length = F.lit(128) + F.length("rule_id") * 3
    index = small(rules, length)
    sets = urls.select(tokens(F.col(url_col)).alias("tokens")).distinct()
    met = sets.select("tokens", F.explode("tokens").alias("rarest")).join(index, "rarest")
    fit = met.where(F.size(F.array_except("items", "tokens")) == 0)
    surest = F.struct("confidence", "support", "rule_id", "verdict", "items")
    return (
        fit.groupBy("tokens")
        .agg(F.max(surest).alias("best"))
        .select("tokens", "best.verdict", "best.confidence", F.col("best.items").alias("evidence"))
    )


def judge(
    urls: DataFrame,
    mined: DataFrame,
    fixed: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judge every URL: `id_col`, `host`, `path`, `rule`, `verdict`, `confidence`, `evidence`.

    `fixed` holds (verdict, "host/path") rules. One fits its host and all subdomains where
    the URL's path starts with the rule's; the longest that fits decides, and is named in
    `rule`. Elsewhere the surest mined rule decides (`confidence`, `evidence`), and where
    none fits `default` holds. One row per input row: a URL that is null or has no `://`
    has an empty host and path and gets `default`; repeated rows repeat; other columns are
    ignored.
    """
    rows = urls.select(
        F.col(id_col),
        host(F.col(url_col)).alias("host"),
        path(F.col(url_col)).alias("path"),
        tokens(F.col(url_col)).alias("tokens"),
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(fixed, key=lambda f: (len(f[1]), f[1])):
        domain, _, rest = name.partition("/")
        inside = (F.col("host") == domain) | F.col("host").endswith(f".{domain}")
        fits = inside & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    matched = match_rules(urls, mined, url_col).withColumnRenamed("verdict", "mined")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("path", F.col(id_col)), F.lit(SALTS)).cast("int"))
    known = salted.join(matched.select("*", salts), ["tokens", "salt"], "left")
    return known.select(
        id_col,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, "mined", F.lit(default)).alias("verdict"),
        "confidence",
        "evidence",
    )
