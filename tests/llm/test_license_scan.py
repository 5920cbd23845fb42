import re

import pytest
from pyspark.sql import functions as F

from offerlake.llm import license_scan as ls
from offerlake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scanner(spark):
    return ls.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark, scanner):
    rows = [
        (1, "prose of no meaning\nreleased under the  MIT license!\r\nmore prose"),
        (2, None),
        (3, ""),
        (4, "\n\n--\n"),
        (5, "the and of\n" * 20_000 + "Licensed under CC BY-NC 4.0."),
        (6, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
        (6, "Licensed under the Apache License, Version 2.0."),
        (7, "the license to drive a car is granted by the town"),
        (None, "SPDX-License-Identifier: MPL-2.0"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, family string, line string")
    got = {(r.doc_id, r.family): r for r in ls.scan(docs, scanner).collect()}
    assert {k for k in got if k[1] != ls.UNKNOWN} == {(1, "mit"), (5, "cc-by-nc"), (6, "apache-2.0"), (None, "mpl")}
    assert got[1, "mit"].first_line == 1 and got[6, "apache-2.0"].n_paragraphs == 3
    assert all(0.5 <= r.probability <= 1 and 0 <= r.likeness <= 1 for r in got.values())
    assert ls.scan(docs.limit(0), scanner).count() == 0
    empty = ls.train(docs.limit(0))
    assert ls.scan(docs, empty).count() >= 4


def test_query_finds_the_notices(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    family = {"MIT": "mit", "Apache": "apache-2.0", "GNU": "gpl", "BY-NC": "cc-by-nc"}
    want = set()
    for r in docs:
        for line in r.text.split("\n"):
            if re.search("licen[sc]e", line, re.I):
                want |= {(r.doc_id, name) for word, name in family.items() if word in line}
    got = {(r.doc_id, r.family) for r in queries.op8_license_scan(spark, SF).collect()}
    assert len(want) > 10 and want <= got and len(got - want) <= 0.05 * len(want)


def test_notices_within_long_lines(spark, scanner):
    prose = " ".join(r.text.replace("\n", " ") for r in spark.read.parquet(f"{SF}/documents.parquet").where("text NOT LIKE '%icens%'").orderBy("doc_id").head(60)).split()
    notices = [ls.TEMPLATES["mit"][1], ls.TEMPLATES["apache-2.0"][1], ls.TEMPLATES["gpl"][1], ls.TEMPLATES["cc-by-nc"][1], ls.TEMPLATES["mit"][0]]
    want, rows = set(), []
    for n in (200, 5000):
        for place in (0, 0.31, 0.5, 1):
            for notice in notices:
                cut = int(n * place)
                rows.append((len(rows), " ".join([*prose[:cut], notice, *prose[cut:n]])))
                want.add((len(rows) - 1, next(f for f, all_ in ls.TEMPLATES.items() if notice in all_)))
    docs = spark.createDataFrame([*rows, (1000, " ".join(prose[:5000]))], "doc_id long, text string")
    got = ls.scan(docs, scanner).collect()
    assert {(r.doc_id, r.family) for r in got} == want
    assert all(r.n_paragraphs == 1 and r.first_line == 0 and r.likeness == 1 for r in got)


def test_recurring_unlisted_licences_are_unknown(spark):
    notices = [
        "Distributed under the Boost Software License, Version 1.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the EUPL, Version 1.2 or later.",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    prose = docs.where("text NOT LIKE '%icens%'").orderBy("doc_id").head(60)
    # alone, so that the one sampled paragraph of each is the notice
    added = spark.createDataFrame([(10**9 + i, notices[i % 3]) for i in range(24)], docs.schema)
    corpus = docs.unionByName(added)
    got = {(r.doc_id, r.family) for r in ls.scan(added.unionByName(spark.createDataFrame(prose, docs.schema)), ls.train(corpus)).collect()}
    assert got == {(10**9 + i, ls.UNKNOWN) for i in range(24)}


def test_wrapped_notices(spark, scanner):
    prose = " ".join(r.text.replace("\n", " ") for r in spark.read.parquet(f"{SF}/documents.parquet").where("text NOT LIKE '%icens%'").orderBy("doc_id").head(20)).split()
    notices = {"mit": ls.TEMPLATES["mit"][1], "bsd": ls.TEMPLATES["bsd"][0], "apache-2.0": ls.TEMPLATES["apache-2.0"][1], "gpl": ls.TEMPLATES["gpl"][1]}
    rows, want = [], set()
    for family, notice in notices.items():
        split = notice.split()
        for width in (3, 6, 10):
            for lead in ("", "# ", " * "):
                lines = [lead + " ".join(split[i : i + width]) for i in range(0, len(split), width)]
                for before, after in (("", ""), (" ".join(prose[:90]), " ".join(prose[100:300])), (" ".join(prose[:9]) + "\n", "\n" + " ".join(prose[20:40]))):
                    want.add((len(rows), family))
                    rows.append((len(rows), "\n".join([before, *lines, after])))
    clean = [(1000 + i, "\n".join(" ".join(prose[k : k + 7]) for k in range(i, 600, 7))) for i in range(5)]
    # a border within the notice, and prose that only holds a licence's words
    clean += [(2000, "the permission to enter\nis granted by the town\nof Redistribution"), (2001, "copyright\nis a word\nof law")]
    got = ls.scan(spark.createDataFrame(rows + clean, "doc_id long, text string"), scanner).collect()
    named = {(r.doc_id, r.family) for r in got if r.family != ls.UNKNOWN}
    assert named == want
    assert all(r.n_paragraphs == 1 for r in got if r.family != ls.UNKNOWN), [r for r in got if r.n_paragraphs != 1]


def test_all_texts_train(spark):
    # what only the last of 4,600 texts say, by the order of their ids' hashes and by their lines, is known to be no licence
    said = "files of this program {} and binary forms, with or without modification, provided to any person, version {}"
    ids = [r.id for r in spark.range(4600).orderBy(F.xxhash64("id")).collect()]
    texts = [f"a plain text number {n}" for n in range(4200)] + [f"first\nsecond\n{said.format(n % 7, n)}" for n in range(400)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert ls.scan(docs, ls.train(docs)).count() == 0


def test_model_is_no_larger_than_the_templates(spark, scanner):
    # the driver gets classes x features numbers of every task in every iteration
    known = ls._known(spark)
    assert scanner.model.numFeatures == len(known)
    rows = spark.createDataFrame([([known[3], known[3], known[7], 5],), ([],)], "grams array<bigint>")
    held = [r.features for r in ls._features(rows).orderBy(F.size("grams").desc()).collect()]
    assert held[0].indices.tolist() == [3, 7] and held[0].values.tolist() == [1, 1] and held[1].numNonzeros() == 0
