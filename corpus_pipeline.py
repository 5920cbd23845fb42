"""A training-data pipeline of five stages, each built on one operator of `offerlake.llm`.

Every stage gets what its predecessor kept. All but the last return the columns of
`documents`; rows that a stage rejects are gone, and cut texts take the place of theirs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlake.llm import byte_bpe, decontamination, jaccard_join, language_id, queries, suffix_dedup
from offerlake.llm.tables import checkpointed, shared_folder, small, table, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put each document's predicted language into `lang`, and drop those of no known language.

    Rejected are null texts and texts without a letter, and texts of 100 letters or more
    whose best language needs more bits for each symbol than any held-back labelled text
    did, by a quarter: random letters, codes, a language that nobody labelled.
    """
    sample, bound = language_id.learn_and_calibrate(docs)
    found = language_id.predict(docs, sample, keep=COLUMNS[1:])
    strange = (F.col("bits") > bound) & (F.col("n_symbols") >= language_id.JUDGED_LETTERS)
    kept = found.where((F.col("lang_pred") != language_id.UNDECIDED) & ~F.coalesce(strange, F.lit(False)))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of similar texts, the one with the least id.

    Rows that share an id and a text are one document, of which the row with the least
    source, language and length stays. Rows with a null id are in no class, and all stay.
    """
    classes = jaccard_join.similarity_classes(docs)
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang", "n_chars")
    kept = docs.join(first, "doc_id", "left_semi").withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages that an earlier document has; drop documents of which nothing is left."""
    cut = suffix_dedup.remove_repeats(docs, keep=("lang", "source", "n_chars"))
    left = cut.where((F.length("kept_text") > 0) | (F.col("n_bytes") == 0))
    changed = F.size("spans") > 0
    return left.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; those without an id by their text's hash, as if it were one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    keyed = docs.withColumn("_key", key)
    found = decontamination.find_contained(keyed, table(spark, sf_dir, "benchmark"), id_col="_key")
    found = checkpointed(found.select("_key").distinct())
    return keyed.join(small(found, F.lit(64)), "_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts, and decode the ids to show that nothing is lost."""
    decoded = byte_bpe.encode_and_decode(docs, tokenizer_file(queries.RANKS), queries.pattern())
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded_text").alias("text"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: SQL can't express the language and similarity stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet and read again by the next.

    A stage's files go once its successor has written its own.
    """
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{number}")
        docs = spark.read.parquet(f"{place}/{number}")
        if number:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{number - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
