"""Token counts without token ids.

A piece model whose pieces hold the space mark only at their front never merges
across the boundary before a run of marks. A text is therefore a bag of pre-tokens
(a run of marks and the characters after it), and its token count is the sum of the
counts of its pre-tokens. A pre-token that repeats within a task's texts is counted once
there, and its documents' frequencies are multiplied at once; those a task sees a single
time are shuffled by pre-token, counted once per distinct value and joined to the
documents they came from. A frequent pre-token is thereby gathered before the shuffle
and cannot make a hot key, and most (document, pre-token) pairs, which are several times
the text itself, never travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.tables import in_small_batches

MARK = "▁"
_PARTIAL = "one long, two long, id long, rows int, n_bytes long, token string, n long"
_UNUSUAL = f"^$|^ |  | $|{MARK}"
_PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def _processor(model_file: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size())):
        raise ValueError(f"{model_file}: pieces cross spaces, so pre-tokens can't be counted apart")
    return processor


def _piece_counts(tokens: list[str], model_file: str) -> np.ndarray:
    encode = _processor(model_file).encode
    counts = np.fromiter(map(len, encode(tokens, num_threads=1)), dtype=np.int64, count=len(tokens))
    lone_mark = len(encode("x ")) - len(encode("x"))  # the library gives nothing for an empty text
    counts[[i for i, token in enumerate(tokens) if not token]] = lone_mark
    return counts


def _pre_tokens(texts: pa.Array) -> pa.ListArray:
    """Pre-tokens of each text, without the first of their marks; a lone mark is empty."""
    usual = pc.invert(pc.match_substring_regex(texts, _UNUSUAL))
    lists = pc.split_pattern(pc.if_else(usual, texts, ""), " ")
    if pc.all(usual).as_py():
        return lists
    rows = lists.to_pylist()
    for i in np.flatnonzero(~usual.to_numpy(zero_copy_only=False)):
        text = texts[i].as_py()
        rows[i] = [token[1:] for token in _PRE_TOKEN.findall(MARK + text.replace(" ", MARK))] if text else []
    return pa.array(rows, pa.list_(pa.string()))


def _count_local(batches: Iterator[pa.RecordBatch], model_file: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ones, twos, ids, texts = (table.column(i).combine_chunks() for i in range(4))
        texts = texts if isinstance(texts, pa.Array) else texts.chunk(0)
        lists = _pre_tokens(texts)
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        often = np.bincount(codes, minlength=len(encoded.dictionary)) > 1
        pieces = np.zeros(len(encoded.dictionary), dtype=np.int64)
        pieces[often] = _piece_counts(encoded.dictionary.filter(pa.array(often)).to_pylist(), model_file)
        known = np.bincount(owner, weights=pieces[codes], minlength=len(lists)).astype(np.int64)
        once = ~often[codes]
        back = pa.array(owner[once])
        n, m = len(lists), len(back)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ones, ones.take(back)]),
                pa.concat_arrays([twos, twos.take(back)]),
                pa.concat_arrays([ids, pa.nulls(m, pa.int64())]),
                pa.array(np.concatenate([np.ones(n, np.int32), np.zeros(m, np.int32)])),
                pa.concat_arrays([pc.binary_length(texts).cast(pa.int64()), pa.array(np.zeros(m, np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.string()), encoded.dictionary.take(pa.array(codes[once]))]),
                pa.array(np.concatenate([known, np.ones(m, np.int64)])),
            ],
            names=["one", "two", "id", "rows", "n_bytes", "token", "n"],
        )

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= chunk_bytes:
            yield flush()
            held, size = [], 0
    if sum(map(len, held)):
        yield flush()


def _count_rest(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    last, last_count = None, 0
    for batch in batches:
        token, n = batch.column("token"), batch.column("n").to_numpy(zero_copy_only=False).copy()
        if token.null_count < len(token):
            encoded = token.dictionary_encode()
            words = encoded.dictionary.to_pylist()
            known = bool(words) and words[0] == last
            counts = _piece_counts(words[known:], model_file)
            counts = np.concatenate([[last_count], counts]) if known else counts
            last, last_count = words[-1], int(counts[-1])
            real = np.flatnonzero(token.is_valid().to_numpy(zero_copy_only=False))
            n[real] *= counts[encoded.indices.drop_null().to_numpy()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("one", "two", "id", "rows", "n_bytes")), pa.array(n)],
            names=["one", "two", "id", "rows", "n_bytes", "n"],
        )


def count_tokens(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 32 << 20
) -> DataFrame:
    """Count the tokens that a sentencepiece model gives for each whole text.

    Returns one row per input row: `id_col`, `n_bytes` (UTF-8), `n_tokens`. A null text
    counts as empty and has no tokens; rows that repeat, or share an id with another
    text, each keep their own row; other columns are ignored; an empty table gives an
    empty result. No begin, end or special tokens are counted, and special strings in
    a text are ordinary text, as in the library's default. `chunk_bytes` bounds the
    text one task gathers before it counts.
    """
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    # the id and a hash of the text name a row while it is taken apart; without an id a second hash stands in
    keys = F.coalesce(own, F.xxhash64(text, F.lit(1))).alias("one"), F.xxhash64(text).alias("two")
    rows = docs.select(*keys, own.alias("id"), text.alias("text"))
    local = in_small_batches(rows).mapInArrow(lambda batches: _count_local(batches, model_file, chunk_bytes), _PARTIAL)
    place = F.coalesce(F.xxhash64("token") * F.when(F.col("token").isNotNull(), 1), F.col("one"))
    counted = (
        local.withColumn("place", place)
        .repartition("place")
        .drop("place")
        .sortWithinPartitions("token")
        .mapInArrow(
            lambda batches: _count_rest(batches, model_file), "one long, two long, id long, rows int, n_bytes long, n long"
        )
    )
    totals = counted.groupBy("one", "two").agg(
        F.max("id").alias("id"), F.sum("rows").alias("rows"), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n")
    )
    return totals.select(
        F.col("id").alias(id_col),
        F.expr("n_bytes div rows").alias("n_bytes"),
        F.expr("n div rows").alias("n_tokens"),
        F.explode(F.expr("array_repeat(0, cast(rows as int))")).alias("copy"),
    ).drop("copy")
