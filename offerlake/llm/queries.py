"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import byte_bpe, centroids, chat_format, decontamination, fingerprints, jaccard_join, language_id, license_scan, ranked_search, substring_dedup, suffix_dedup, token_counts, url_filters
from offerlake.llm.tables import table, tokenizer_file

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
MAX_TOKENS = 4096


#: Rules that the contract of op1 fixes.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: Words of host names that mark a page as one to block: the weak labels of op1. Fixed values.
SEED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a label: block where a part of the host's name is one of `SEED_WORDS`.

    Other pages have the label of the document of the same id: block if it is toxic or of
    low quality, else allow. That label says little about a URL, so alone it gives hardly a
    rule; it is the background that the words beside the seeds have to stand out from.
    """
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL OR quality IS NOT NULL")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    known = labels.select(F.col("doc_id").alias("page_id"), F.when(bad, "block").otherwise("allow").alias("known"))
    seeded = F.arrays_overlap(url_filters.host_words(F.col("url")), F.array(*map(F.lit, SEED_WORDS)))
    pages = table(spark, sf_dir, "pages").select("page_id", "url").join(known, "page_id", "left")
    label = F.when(seeded, "block").otherwise(F.col("known")).alias("label")
    return pages.select("page_id", "url", label).where("label IS NOT NULL")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.mine_rules(labelled_pages(spark, sf_dir))
    judged = url_filters.judge(table(spark, sf_dir, "pages"), rules, URL_RULES)
    return judged.withColumn("evidence", F.array_join("evidence", " "))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file(RANKS), pattern())
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.with_successors(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = language_id.learn(docs.where(~held_out()))
    return language_id.predict(docs, sample).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.train_and_scan(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return removed.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0), lambda n, s: n + s.end - s.start).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return removed.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0), lambda n, s: n + s.end - s.start).cast("long").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return clustered.withColumn("centroid_sha256", digest).drop("centroid")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation of control strings that the contract of op13 adds.
PROBE_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE_TURNS, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_paths(chat_format.as_replies(rows.unionByName(probe)), per_tree=1, template=chat_format.Template())
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        "formatted",
        chat_format.turns_of(F.col("formatted")).alias("turns"),
        F.array_join(chat_format.learned_texts(F.col("formatted"), F.col("loss_mask")), "").alias("learned"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_ranked_search": op12_ranked_search,
    "op13_chat_formatting": op13_chat_formatting,
}

OP6_SQL = r"""
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'item', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w
  FROM texts WHERE id IS NOT NULL AND text IS NOT NULL
), lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM split WHERE kind = 'item' AND len(w) > 0
), grams AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM (SELECT split.*, k FROM split JOIN lengths ON kind = 'doc' OR k = least(len(w), 5)) WHERE len(w) >= k
), sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 'item' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) / any_value(s.n) AS containment
FROM grams d JOIN grams i ON d.gram = i.gram AND d.kind = 'doc' AND i.kind = 'item' JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id HAVING count(*) / any_value(s.n) >= 0.8
"""

OP2_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram
  FROM split
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b, shared.n = x.n AND shared.n = y.n AS same FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-9
), reached AS (
  SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT id, b FROM reached JOIN links ON a = other
), classes AS (SELECT id, min(other) AS class_id FROM reached GROUP BY id
), counts AS (SELECT a, count(*) AS n, count(*) FILTER (WHERE same) AS equal FROM links GROUP BY a)
SELECT id AS doc_id, class_id, coalesce(n, 0) AS n_links, coalesce(equal, 0) + 1 AS n_copies FROM classes LEFT JOIN counts ON a = id
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)
), firsts AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s HAVING min(doc_id) <> max(doc_id)
), hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > first_id
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits)
), spans AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since
  FROM (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY ALL)
), cut AS (
  SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS rest, sum(b - a) AS removed, count(*) AS n
  FROM spans JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(rest, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split)
), firsts AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s HAVING min(doc_id) <> max(doc_id)
), hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > first_id
), covered AS (SELECT DISTINCT doc_id, i + k AS j FROM hits, range(0, 50) AS r(k)
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""



def _op11_sql(rounds: int = 3) -> str:
    """Clustering with the rounds written out one after the other."""
    nearest = """a{r} AS (
  SELECT rid, vec_id, v, c, d FROM (
    SELECT rid, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM kept, c{r}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)"""
    moved = """, c{n} AS (
  SELECT c, coalesce(new.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i)
    GROUP BY c) new USING (c)
), """
    steps = "".join(nearest.format(r=r) + moved.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM kept QUALIFY c < 16
), {steps}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


OP12_SQL = r"""
WITH terms AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark)
), found AS (SELECT kind, id, term, count(*) AS tf FROM terms GROUP BY ALL
), sizes AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM found WHERE kind = 'doc' GROUP BY id
), total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, total WHERE kind = 'doc' GROUP BY term, n_docs
), scores AS (
  SELECT i.id AS item_id, d.id AS doc_id, CAST(sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM found d JOIN found i ON d.term = i.term AND d.kind = 'doc' AND i.kind = 'item' JOIN weights w ON w.term = d.term JOIN sizes s ON s.id = d.id, total
  GROUP BY i.id, d.id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(role || text) + 32 AS plain,
    len(regexp_extract_all(role || chr(10) || text, '[<\\[]\\\\*(?:\\|im_start\\|>|\\|im_sep\\|>|\\|im_end\\|>|s>|/s>|INST\\]|/INST\\]|\\|endoftext\\|>)')) AS escaped
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(plain + escaped) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op2_jaccard_join": OP2_SQL,
    "op6_decontamination": OP6_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_centroid_clustering": _op11_sql(),
    "op12_ranked_search": OP12_SQL,
    "op13_chat_formatting": OP13_SQL,
}
