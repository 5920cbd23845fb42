import math
import re
from itertools import combinations

from pyspark.sql import functions as F

from offerlake.llm import queries
from offerlake.llm import url_filters as uf

SF = "/root/testdata/sf0.1"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"(?s)[^?#]*", rest[len(host) :])[0]


def fixed_rule(host, path, rules):
    fits = []
    for verdict, name in rules:
        domain, _, rest = name.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fits.append((len(name), name, verdict))
    return max(fits)[1:] if fits else (None, None)


def mined(rows, min_rows, min_confidence, min_lift):
    """All rules by counting every token combination."""
    count, both, labels = {}, {}, {}
    for items, label in rows:
        labels[label] = labels.get(label, 0) + 1
        for n in range(1, len(items) + 1):
            for part in combinations(sorted(items), n):
                count[part] = count.get(part, 0) + 1
                both[part, label] = both.get((part, label), 0) + 1
    sure = {}
    for (part, label), n in both.items():
        confidence = n / count[part]
        if n >= min_rows and confidence >= min_confidence and confidence / (labels[label] / len(rows)) >= min_lift:
            sure[part, label] = confidence
    return {
        k: c
        for k, c in sure.items()
        if not any(l == k[1] and set(p) < set(k[0]) and d >= c for (p, l), d in sure.items())
    }


def test_rules_against_counting(spark):
    urls = [
        (f"http://{h}.example.com/{w}/{i}?{q}=1", "block" if (h, w) in {("a", "x"), ("b", "y")} or q == "s" else "allow")
        for i, (h, w, q) in enumerate((h, w, q) for h in "abc" for w in ("xx", "yy") for q in "rst" for _ in range(3))
    ]
    urls = [(u, label) for u, label in urls] + [(None, "block"), ("http://a.example.com/zz", None)]
    table = spark.createDataFrame(urls, "url string, label string")
    rows = [
        (r.t, r.label)
        for r in table.where("url IS NOT NULL AND label IS NOT NULL").select(uf.tokens(table.url).alias("t"), "label").collect()
    ]
    want = mined(rows, 3, 0.6, 1.2)
    found = uf.mine_rules(table, min_rows=3, min_support=0.0, min_confidence=0.6, min_lift=1.2)
    got = {(tuple(r["items"]), r.verdict): r.confidence for r in found.collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    matched = {tuple(r.tokens): r for r in uf.match_rules(table, found).collect()}
    for items in {tuple(items) for items, _ in rows}:
        fits = [c for (p, _), c in want.items() if set(p) <= set(items)]
        assert (items in matched) == bool(fits)
        assert not fits or abs(matched[items].confidence - max(fits)) < 1e-9


def test_odd_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.com/en/7?x", "a://É.COM/en/", "x://net/de/8#f", "s://example.net/de/8"]
    urls += ["s://a.b.org/es/\n/x?y", "u://h.com#/en/", "u://h.com/en", "u://a://b/c", "u://h.com:80/en/7", "s://notexample.net/de/8", "nothing"]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    none = uf.mine_rules(spark.createDataFrame([], "url string, label string"))
    got = {r.page_id: r for r in uf.judge(table, none, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rule, verdict = fixed_rule(*parts(url), queries.URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (*parts(url), rule, verdict or "allow"), url
    assert uf.judge(table.limit(0), none, queries.URL_RULES).count() == 0


def test_mined_rule_changes_verdicts(spark):
    pages = [(i, f"http://s{i}.{'lucky-casino' if i % 5 == 0 else 'plain'}.example.com/en/{i}") for i in range(100)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    labelled = pages.withColumn("label", F.when(F.col("page_id") % 5 == 0, "block").otherwise("allow")).where("page_id < 60")
    judged = {r.page_id: r for r in uf.judge(pages, uf.mine_rules(labelled), []).collect()}
    assert {i for i, r in judged.items() if r.verdict == "block"} == set(range(0, 100, 5))
    assert judged[95].evidence and judged[95].confidence == 1.0


def test_query_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    labelled = queries.labelled_pages(spark, SF)
    rows = [(list(r.t), r.label) for r in labelled.select(uf.tokens(labelled.url).alias("t"), "label").collect()]
    rules = mined(rows, max(8, math.ceil(0.002 * len(rows))), 0.8, 1.3)
    assert any(label == "block" for _, label in rules)
    split = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", uf.tokens(F.col("url")).alias("t"))
    items = {r.page_id: set(r.t) for r in split.collect()}
    got = {r.page_id: r for r in queries.op1_url_filters(spark, SF).collect()}
    assert len(got) == len(pages)
    by_rule = 0
    for r in pages:
        rule, verdict = fixed_rule(*parts(r.url), queries.URL_RULES)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (*parts(r.url), rule)
        fits = {label: c for (p, label), c in sorted(rules.items(), key=lambda x: x[1]) if set(p) <= items[r.page_id]}
        surest = [label for label, c in fits.items() if c == max(fits.values())]
        assert got[r.page_id].verdict in ([verdict] if rule else surest or ["allow"]), r.url
        by_rule += not rule and got[r.page_id].verdict == "block"
    assert by_rule > 0
