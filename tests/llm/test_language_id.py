import math
import random

from pyspark.sql import functions as F

from offerlake.llm import language_id as lid
from offerlake.llm import queries

SF = "/root/testdata/sf0.01"


def plain(text):
    out = []
    for char in text or "":
        c = ord(char.lower()) if char.isalpha() and len(char.lower()) == 1 else ord(char) if char.isalpha() else 0
        if c or not out or out[-1]:
            out.append(c)
    return out


def brute_force(text, sample):
    """The language and bits by greedy longest matches, found by substring search."""
    codes = plain(text)
    if not any(codes):
        return "und", None
    costs = []
    for lang, learned in sample.texts:
        known = "".join(map(chr, plain(learned)))
        text, phrases, at = "".join(map(chr, codes)), 1, 0
        while at < len(text):
            end = at
            while end < len(text) and text[at : end + 1] in known:
                end += 1
            if end == at:  # a symbol that the language lacks is a phrase, as is what went before
                phrases, end = phrases + 1, at + 1
            elif end < len(text) and text[end] in known:
                phrases += 1
            at = end
        costs.append((phrases * math.log2(max(2, len(known))) / len(codes), lang))
    return min(costs)[::-1]


def test_against_brute_force(spark):
    train = [(i, "de", "der hund und die katze schlafen ueber nacht") for i in range(3)]
    train += [(10, "en", "the dog and the cat are sleeping all night"), (11, None, "nothing"), (12, "fr", None)]
    columns = "doc_id long, lang string, text string"
    sample = lid.learn(spark.createDataFrame(train, columns))
    assert [lang for lang, _ in sample.texts] == ["de", "en"]
    random.seed(7)
    letters = ["".join(random.choices("derhundkatzthogc ", k=k)) for k in (255, 256, 257, 600, 3000)]
    texts = [*letters, "a" * 2000, "ee" * 700 + "the", "the cat", "Die Katze!", None, "", "12 34 ...", "zzz", "a", "und the dog " * 200, "Ünder é 9 the", "the cat"]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], columns.replace("lang", "score"))
    got = {r.doc_id: r for r in lid.predict(docs, sample).collect()}
    for i, text in enumerate(texts):
        lang, bits = brute_force(text, sample)
        assert (got[i].lang_pred, got[i].bits is None) == (lang, bits is None), text
        assert bits is None or abs(got[i].bits - bits) < 1e-9, text
        assert 0 <= got[i].score <= 1
    nothing = lid.learn(spark.createDataFrame([], columns))
    assert {r.lang_pred for r in lid.predict(docs, nothing).collect()} == {"und"}
    assert lid.predict(docs.limit(0), sample).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_calibrated_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = lid.learn(docs)
    bound = lid.calibrate(docs, sample)
    random.seed(3)
    noise = [("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=400)),) for _ in range(5)]
    assert lid.predict(spark.createDataFrame(noise, "doc_id string").withColumn("text", F.col("doc_id")), sample).where(F.col("bits") > bound).count() == 5
    assert lid.predict(docs, sample).where(F.col("bits") > bound).where(F.col("n_symbols") >= lid.JUDGED_LETTERS).count() == 0
    assert lid.calibrate(docs.limit(0), sample) == float("inf")


def test_many_languages_and_clashing_names(spark):
    rows = [(i, f"l{i % 30:02d}", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 30 % 13)}x{k % 7}" for k in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, bits string, _text string")
    sample = lid.learn(docs.withColumnsRenamed({"bits": "lang", "_text": "text"}))
    assert len(sample.texts) == 30
    got = lid.predict(docs.withColumn("text", F.col("_text")), sample, keep=("_text", "text")).collect()
    assert len(got) == 60 and all(r["_text"] == r["text"] for r in got)


def test_all_texts_teach_and_calibrate(spark):
    # what only texts after the first 480 say, by the order of their ids' hashes, is learned, and their cost is in the bound
    ids = [r.id for r in spark.range(700).orderBy(F.xxhash64("id")).collect()]
    texts = [f"one text of alpha and beta, number {chr(97 + n % 26)} " * 4 for n in range(600)] + ["some gamma and delta words " * 5 for _ in range(98)]
    texts += ["kwjx qzvb fpmg hdtl " * 9, "zqpw vmxk jgbf lthd " * 9]
    docs = spark.createDataFrame([(i, "en", t) for i, t in zip(ids, texts, strict=True)], "doc_id long, lang string, text string")
    sample, bound = lid.learn_and_calibrate(docs)
    assert {"alpha", "gamma", "kwjx", "lthd"} <= set(sample.texts[0][1].split())
    assert sample == lid.learn(docs)
    dear = []
    for half in (0, 1):
        mine, others = (docs.where(lid._half("text") == h) for h in (half, 1 - half))
        known = lid.learn(others)
        dear += [brute_force(r.text, known)[1] for r in mine.select("text").distinct().collect()]
    assert abs(bound - 1.25 * max(dear)) < 1e-9
    assert lid.learn_and_calibrate(docs.limit(0)) == (lid.Sample(()), float("inf"))
