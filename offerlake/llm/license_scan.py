"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Each paragraph (line) of a text is cut into overlapping windows of words, and each window
becomes a sparse vector of those word 1-, 2- and 3-grams that a template has, a place for
each of them, so that the model is no larger than the templates. A
multinomial logistic regression, trained on cut template notices, alone and within windows
of the corpus, and on all windows of half the corpus' texts, gives it a licence family or
none. Windows of equal grams count once. A family counts only above a
probability calibrated on all windows of the other half; it is confirmed if
the window holds enough of the word pairs of one of the family's templates, and is
otherwise reported as an unknown licence. A notice that is wrapped over several lines is
found in the words around its licence-like lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlake.llm.tables import checkpointed, discard, shared_folder, written

#: Short notices by family. Fixed texts: they are how the licences are usually named.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 2.",
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
NONE, UNKNOWN = "none", "unknown"
#: Words of a window, and from one window's start to the next: a notice of up to 33 words lies whole in one of them.
WINDOW, STEP = 64, 32
#: Words of a notice that lies whole in a window; a line has a word at least, so as many lines hold it.
REACH = WINDOW - STEP + 1
LINE_END = r"\r\n|\r|\n"
#: The share of a cut template's weight in training that lies in it alone; the rest lies in it within windows of the corpus.
ALONE = 1 / 6
#: What all windows of the corpus weigh in training, for each unit of weight of all cut templates.
PROSE = 3.0
#: Words that a licence of any family may have: paragraphs that hold one are no examples of prose.
LICENCE_LIKE = r"(?i)licen[sc]|copyright|copyleft|permission|permitted|redistribut|spdx"
#: Training rows of one task: each sends the driver a gradient in each iteration, however few its rows are.
TASK_ROWS = 1 << 13
#: The share of the calibrating windows that stay below the threshold, and the steps that probabilities are counted by.
QUANTILE, STEPS = 0.999, 10_000


@dataclass(frozen=True)
class Scanner:
    """A trained model, its families by class number, and the calibrated thresholds.

    `prose` is what the calibrating windows stay below. It is the threshold where a window holds
    a word that is `LICENCE_LIKE`; everywhere else it is `threshold`, which is 0.5 at least.
    """

    model: LogisticRegressionModel
    families: tuple[str, ...]
    threshold: float
    prose: float


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value made once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashed(split: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """`use` of the hashes of the word 1-, 2- and 3-grams, each by its place."""

    def less(k: int) -> Column:
        return F.greatest(F.size(split) - k, F.lit(0))

    def pairs(one: Column) -> Column:
        return F.zip_with(F.slice(one, 1, less(1)), F.slice(one, 2, less(1)), lambda a, b: F.xxhash64(a, b))

    def triples(one: Column, two: Column) -> Column:
        return F.zip_with(F.slice(two, 1, less(2)), F.slice(one, 3, less(2)), lambda a, b: F.xxhash64(a, b))

    return _let(
        F.transform(split, lambda w: F.xxhash64(w)),
        lambda one: _let(pairs(one), lambda two: _let(triples(one, two), lambda three: use(one, two, three))),
    )


def _starts(n: Column) -> Column:
    """Where the windows of `n` words start; the last one reaches the end."""
    last = F.ceil(F.greatest(n - WINDOW, F.lit(0)) / STEP).cast("int") * STEP
    return F.sequence(F.lit(0), last, F.lit(STEP))


def _window(one: Column, two: Column, three: Column, start: Column, n: Column) -> Column:
    """The window of `n` words from `start` (from 0): its grams and, of these, those of neighbouring words; nulls are left out."""
    pairs = F.slice(two, start + 1, n - 1)
    grams = F.concat(F.slice(one, start + 1, n), pairs, F.slice(three, start + 1, F.greatest(n - 2, F.lit(0))))
    held = F.array_sort(F.array_distinct(F.array_compact(grams)))
    return F.struct(start.alias("start"), (start + n).alias("end"), held.alias("grams"), F.array_distinct(F.array_compact(pairs)).alias("own"))


def _windows(split: Column, known: list[int]) -> Column:
    """All windows of a paragraph, with those of its grams that are among `known`."""

    def cut(one: Column, two: Column, three: Column) -> Column:
        places = F.transform(F.array(one, two, three), lambda grams: F.transform(grams, lambda g: F.when(g.isin(known), g)))
        return _let(places, lambda held: windows(held, F.size(split)))

    def windows(held: Column, n: Column) -> Column:
        return F.transform(_starts(n), lambda s: _window(held[0], held[1], held[2], s, F.least(n - s, F.lit(WINDOW))))

    return _hashed(split, cut)


def _features(rows: DataFrame) -> DataFrame:
    """Which of the templates' grams each row holds, by their order."""
    names = [str(gram) for gram in _known(rows.sparkSession)]
    places = CountVectorizerModel.from_vocabulary(names, inputCol="_names", outputCol="features").setBinary(True).setMinTF(1.0)
    return places.transform(rows.withColumn("_names", F.col("grams").cast("array<string>"))).drop("_names")


def _exploded(rows: DataFrame, known: list[int]) -> DataFrame:
    """One row for each window of `words`: `start`, `end`, `grams`, `own` instead of them."""
    kept = [c for c in rows.columns if c != "words"]
    return rows.select(*kept, F.explode(_windows(F.col("words"), known)).alias("window")).select(*kept, "window.*")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").withColumn("words", words(F.col("text")))


def _template_pairs(spark: SparkSession) -> list[tuple[str, list[int]]]:
    """Each template's family and hashed word pairs."""
    pairs = F.array_distinct(_hashed(F.col("words"), lambda one, two, three: two))
    return [(r.family, r.pairs) for r in _templates(spark).select("family", pairs.alias("pairs")).collect()]


def _share(own: Column, pairs: list[int]) -> Column:
    """The share of a template's word pairs that are among `own`."""
    return F.size(F.array_intersect(own, F.lit(pairs))) / len(pairs)


def _known(spark: SparkSession) -> list[int]:
    """The hashes of all words, pairs and triples of the templates: grams of no template tell none from another."""
    every = F.explode(_hashed(F.col("words"), lambda one, two, three: F.concat(one, two, three))).alias("gram")
    return sorted(r.gram for r in _templates(spark).select(every).distinct().collect())


def _cut_templates(spark: SparkSession, copies: int, known: list[int]) -> DataFrame:
    """`copies` examples of each template, cut at both ends: `cell` (from 0), `family`, `grams`."""
    nth = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("nth")
    spread = _templates(spark).select("family", "text", "words", nth)
    head = F.pmod(F.col("nth"), F.lit(3))
    tail = F.pmod(F.floor(F.col("nth") / 3), F.lit(3)).cast("int")
    kept = F.greatest(F.size("words") - head - tail, F.least(F.size("words"), F.lit(4)))
    start = F.least(head, F.size("words") - kept) + 1
    cut = spread.select("family", "text", "nth", F.slice("words", start, kept).alias("words"))
    by_hash = Window.orderBy(F.xxhash64("family", "text", "nth"), "family", "text", "nth")
    numbered = cut.withColumn("cell", F.row_number().over(by_hash) - 1)  # `copies` rows for each template
    return _exploded(numbered.select("cell", "family", "words"), known).select("cell", "family", "grams")


def _wrapped(lines: Column) -> Column:
    """The licence-like lines, each with the last and first `REACH` words of the lines before and after it.

    A line without a word is a border. Of a long line only both ends can be part of a
    notice that another line begins or ends.
    """

    def head(w: Column) -> Column:
        return F.slice(w, 1, REACH)

    def tail(w: Column) -> Column:
        return F.slice(w, F.greatest(F.size(w) - REACH, F.lit(0)) + 1, REACH)

    def unbroken(near: Column) -> Column:
        border = F.array_position(F.transform(near, lambda w: F.size(w) == 0), True).cast("int")
        return F.slice(near, 1, F.when(border == 0, F.size(near)).otherwise(border - 1))

    def around(split: Column, i: Column) -> Column:
        before = _let(F.reverse(F.slice(split, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)))), unbroken)
        after = _let(F.slice(split, i + 2, REACH), unbroken)
        first = tail(F.flatten(F.reverse(F.transform(before, tail))))
        last = head(F.flatten(F.transform(after, head)))
        return _let(F.struct(first.alias("first"), F.element_at(split, i + 1).alias("own"), last.alias("last")), lambda p: joined(p, i))

    def joined(part: Column, i: Column) -> Column:
        own = part["own"]
        whole = F.array(F.concat(part["first"], own, part["last"]))
        ends = F.array(F.concat(part["first"], head(own)), F.concat(tail(own), part["last"]))
        texts = F.when(F.size(part["first"]) + F.size(part["last"]) == 0, F.slice(whole, 1, 0)).when(F.size(own) <= 2 * REACH, whole).otherwise(ends)
        return F.transform(texts, lambda w: F.struct(i.alias("line"), F.lit(None).cast("string").alias("paragraph"), w.alias("around")))

    like = F.filter(F.transform(lines, lambda one, i: F.when(one.rlike(LICENCE_LIKE), i)), lambda i: i.isNotNull())
    return _let(F.transform(lines, words), lambda split: F.flatten(F.transform(like, lambda i: around(split, i))))


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What is scored: every line with a word, and the licence-like lines with the words `around` them.

    Gives `id`, `doc` (the text's hash), `like` (of the text), `line`, `paragraph` or `around`, and `words`.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = texts.select("id", "text", F.xxhash64("text").alias("doc"), F.col("text").rlike(LICENCE_LIKE).alias("like"))
    none = F.lit(None).cast("array<string>").alias("around")

    def units(lines: Column) -> Column:
        alone = F.transform(lines, lambda one, i: F.struct(i.alias("line"), one.alias("paragraph"), none))
        return F.when(F.col("like"), F.concat(alone, _wrapped(lines))).otherwise(alone)

    rows = marked.select("id", "doc", "like", F.explode(_let(F.split("text", LINE_END, -1), units)).alias("unit")).select("id", "doc", "like", "unit.*")
    made = F.coalesce(F.col("around"), words(F.col("paragraph")))
    return rows.select("*", F.explode(F.array(made)).alias("words")).where(F.size("words") > 0)


def cut_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every window of every text, as training and scanning take it.

    Gives `id`, `doc` (the text's hash), `line`, `wrapped`, `hash` (of the paragraph's words), `start`, `end`, `grams` and `own`
    (those of the templates that it holds), `like` (whether it has a licence's word) and `prose`: whether the paragraph is an
    example of none. Paragraphs that hold half of a template's word pairs or a word that is `LICENCE_LIKE` are not: licences
    that no template has may be among them, and shall come out as unknown.
    """
    known, pairs = _known(docs.sparkSession), _template_pairs(docs.sparkSession)
    marked = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(LICENCE_LIKE), i)), lambda i: i.isNotNull())
    wrapped = F.col("around").isNotNull()
    suspect = F.col("like") & (wrapped | F.col("paragraph").rlike(LICENCE_LIKE))
    places = F.when(suspect, marked).otherwise(F.array().cast("array<int>"))
    kept = ("id", "doc", "line", wrapped.alias("wrapped"), F.xxhash64("words").alias("hash"), (~suspect).alias("plain"), places.alias("places"), "words")
    windows = _exploded(_units(docs, id_col, text_col).select(*kept), known)
    like = F.exists("places", lambda i: (i >= F.col("start")) & (i < F.col("end")))
    least = min(len(own) for _, own in pairs) / 2
    half = F.greatest(*(_share(F.col("own"), own) for _, own in pairs)) >= 0.5
    prose = F.col("plain") & ~F.when(F.size("own") >= least, half).otherwise(False)
    return windows.select("id", "doc", "line", "wrapped", "hash", "start", "end", "grams", "own", like.alias("like"), prose.alias("prose"))


def train(docs: DataFrame, copies: int = 24, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """Train on altered templates and on all windows of all texts.

    The windows of half the texts, by their hashes, train the class `none`, and those of the other half
    calibrate: the threshold is the quantile `QUANTILE` of their licence probabilities, rounded up to a
    step of `STEPS`, and at least 0.5 for windows without a licence's words. Windows that hold the same of the templates'
    grams count once, lest the many that hold nothing decide; those that are no `prose` (see `cut_windows`) stay out of both.
    Each template gives `copies` examples that start and end at different words. They lie alone, and each
    different window that trains `none` has one of them added to it, which a hash names. All these windows
    together weigh `PROSE` times what the examples do, however many they are.
    """
    return _train(cut_windows(docs, id_col, text_col), copies)


def _train(windows: DataFrame, copies: int) -> Scanner:
    spark = windows.sparkSession
    half = F.pmod("doc", F.lit(2)).alias("half")
    different = checkpointed(windows.where("prose").select(half, "grams").distinct())
    total = {r.half: r.sets for r in different.groupBy("half").agg(F.count(F.lit(1)).alias("sets")).collect()}
    families = (NONE, *TEMPLATES)
    label = (F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1).cast("double").alias("label")
    cut = _cut_templates(spark, copies, _known(spark))
    cells = len(sum(TEMPLATES.values(), [])) * copies
    none = different.where("half = 0")
    rows = cut.select(label, "grams", F.lit(ALONE).alias("weight"))
    if 0 in total:
        within = none.withColumn("cell", F.pmod(F.xxhash64("grams"), F.lit(cells)).cast("int")).withColumnRenamed("grams", "around").join(F.broadcast(cut), "cell")
        rows = rows.unionByName(within.select(label, F.array_union("grams", "around").alias("grams"), F.lit((1 - ALONE) * cells / total[0]).alias("weight")))
        rows = rows.unionByName(none.select(F.lit(0.0).alias("label"), "grams", F.lit(PROSE * cells / total[0]).alias("weight")))
    tasks = 1 + (2 * total.get(0, 0)) // TASK_ROWS
    made = _features(rows).select("label", "features", "weight").coalesce(tasks)
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, weightCol="weight").fit(made)
    scanner = Scanner(model, families, 0.0, 0.0)
    bound = 0.0
    if 1 in total:
        step = F.ceil((1 - F.col("none_probability")) * STEPS).alias("step")
        steps = _score(different.where("half = 1"), scanner).groupBy(step).agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect()
        below = 0
        for row in steps:
            below += row.n
            if below >= QUANTILE * total[1]:
                bound = row.step / STEPS
                break
    return Scanner(model, families, max(0.5, min(0.999, bound)), min(0.999, bound))


def _score(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """Add the likeliest family, its probability and that of `none`."""
    scored = scanner.model.transform(_features(rows)).withColumn("p", vector_to_array("probability"))
    licences = F.slice("p", 2, len(scanner.families) - 1)
    names = F.array(*map(F.lit, scanner.families[1:]))
    return (
        scored.withColumn("probability", F.array_max(licences))
        .withColumn("family", F.element_at(names, F.array_position(licences, F.col("probability")).cast("int")))
        .withColumn("none_probability", F.col("p")[0])
        .drop("features", "rawPrediction", "prediction", "p")
    )


def _settled(found: DataFrame) -> DataFrame:
    """Finds of lines alone stand; those of wrapped lines only where no line near them names the family alone.

    Those of wrapped lines that lie together are one find, and take the place of what was
    unknown in their lines.
    """
    text = ["id", "doc"]
    near = Window.partitionBy(*text, "family").orderBy("line").rangeBetween(-REACH, REACH)
    all_near = Window.partitionBy(*text).orderBy("line").rangeBetween(-REACH, REACH)
    before = F.lag("line").over(Window.partitionBy(*text, "family", "wrapped").orderBy("line"))
    alone = found.withColumn("alone", F.max(~F.col("wrapped")).over(near)).where(~F.col("wrapped") | ~F.col("alone"))
    known = alone.withColumn("named", F.max("wrapped").over(all_near)).where((F.col("family") != UNKNOWN) | ~F.col("named"))
    again = F.col("wrapped") & F.coalesce(F.col("line") - before <= REACH, F.lit(False))
    return known.withColumn("rows", F.when(again, 0).otherwise(F.col("rows")))


def scan(
    docs: DataFrame, scanner: Scanner, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Find the licence paragraphs of each whole text.

    Returns one row for each `id_col` and `family`: `n_paragraphs`, `first_line`,
    `probability` (of a licence, the highest) and `likeness` (the highest share of a
    template's word pairs). Windows above the threshold get their family if `likeness`
    reaches `confirm`, and `unknown` otherwise. Windows that overlap, one after the other,
    are one find: it is `unknown` if none of them is named, and a name goes where all
    pairs it rests on belong to a likelier template. A notice wrapped over neighbouring
    lines, of `REACH` words at most, counts once if none of its lines is named alone, with
    the line of a licence's word as `first_line`; one that goes on over a line without a
    word is not found. Documents without a licence, null and
    empty texts have no row; rows with equal ids count together; other columns are ignored.
    """
    return _found(_hits(cut_windows(docs, id_col, text_col), scanner, confirm), id_col)


def train_and_scan(docs: DataFrame, copies: int = 24, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`scan` of a table by what `train` learns from it; its windows are cut once, and written to the shared folder meanwhile."""
    place = f"{shared_folder(docs.sparkSession)}/license-windows-{uuid.uuid4().hex}"
    windows = written(cut_windows(docs, id_col, text_col), place)
    hits = checkpointed(_hits(windows, _train(windows, copies), confirm))
    discard(docs.sparkSession, place)
    return _found(hits, id_col)


#: What makes windows ones of the same paragraph.
PARAGRAPH = ("id", "doc", "line", "wrapped", "hash")


def _hits(windows: DataFrame, scanner: Scanner, confirm: float) -> DataFrame:
    """The windows above the threshold, named or unknown, with how many `rows` are equal."""
    licensed = _score(windows, scanner).where(1 - F.col("none_probability") > F.when(F.col("like"), scanner.prose).otherwise(scanner.threshold))
    by_family: dict[str, list[list[int]]] = {}
    for family, pairs in _template_pairs(windows.sparkSession):
        by_family.setdefault(family, []).append(pairs)
    likeness, shared = F.lit(0.0), F.array().cast("array<bigint>")
    for family, every in sorted(by_family.items()):
        shares = [_share(F.col("own"), pairs) for pairs in every]
        likeness = F.when(F.col("family") == family, F.greatest(*shares, F.lit(0.0))).otherwise(likeness)
        shared = F.when(F.col("family") == family, F.array_intersect(F.col("own"), F.lit(sorted(set(sum(every, [])))))).otherwise(shared)
    compared = licensed.withColumn("likeness", likeness).withColumn("shared", shared)
    named = F.when(F.col("likeness") >= confirm, F.col("family")).otherwise(UNKNOWN)
    # equal rows are counted before they meet, so that no id gathers more than its different paragraphs
    return (
        compared.where((F.col("likeness") >= confirm) | ~F.col("wrapped"))
        .withColumn("family", named)
        .groupBy(*PARAGRAPH, "start", "end", "family", "likeness", "shared")
        .agg(F.count(F.lit(1)).alias("rows"), F.max(1 - F.col("none_probability")).alias("probability"))
    )


def _found(hits: DataFrame, id_col: str) -> DataFrame:
    """What is found of each family in each text."""
    ordered = Window.partitionBy(*PARAGRAPH).orderBy("start", "end")
    apart = F.coalesce(F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    runs = hits.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*PARAGRAPH, "run")
    bases = F.collect_set(F.struct("family", "likeness", "shared")).over(inside)
    better = F.exists(
        "bases",
        lambda o: (o.family != UNKNOWN)
        & ((F.col("family") == UNKNOWN) | ((o.family != F.col("family")) & (o.likeness > F.col("likeness")) & (F.size(F.array_except(F.col("shared"), o.shared)) == 0))),
    )
    kept = runs.withColumn("bases", bases).where(~better)
    found = kept.groupBy(*PARAGRAPH, "family").agg(
        F.max("rows").alias("rows"), F.max("probability").alias("probability"), F.max("likeness").alias("likeness")
    )
    return _settled(found).groupBy(F.col("id").alias(id_col), "family").agg(
        F.sum("rows").alias("n_paragraphs"),
        F.min("line").alias("first_line"),
        F.max("probability").alias("probability"),
        F.max("likeness").alias("likeness"),
    )
