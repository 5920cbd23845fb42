"""Byte-level BPE encoding and decoding.

The vocabulary comes from a rank file: base64 of a token's bytes and its rank. The
bytes are written with the printable byte alphabet of byte-level BPE, every split of a
token into two known tokens becomes a merge in order of rank, and the tokenizers
library applies the merges. Decoding reads the tokens back through the same alphabet,
reversed. Texts are cut by the pattern first; a task keeps the ids
of the pre-tokens it has met, so the library sees each of them once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.tables import in_small_batches, one_model, slices

#: Pre-tokens whose ids a worker keeps, those it meets first; bounds its memory only.
MEMO_ENTRIES = 200_000
#: Bytes of text that one step encodes.
STEP_BYTES = 1 << 20


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def load_tokenizer(rank_file: str):
    """A tokenizer of the tokenizers library with the merges that the ranks imply."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, letters = load_ranks(rank_file), byte_alphabet()
    written = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = [(token[:i], token[i:]) for i in range(1, len(token))]
        known = [(a, b) for a, b in halves if a in ranks and b in ranks]
        merges += [(written[a], written[b]) for a, b in sorted(known, key=lambda ab: (ranks[ab[0]], ranks[ab[1]]))]
    vocabulary = {written[token]: rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id: the written tokens, read back through the reversed byte alphabet."""
    bytes_of = {letter: byte for byte, letter in byte_alphabet().items()}
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        table[number] = bytes(bytes_of[letter] for letter in token)
    return table


class _Codec:
    """A tokenizer and its table of bytes, which a Python worker builds once."""

    def __init__(self, rank_file: str):
        tokenizer = load_tokenizer(rank_file)
        table = token_bytes(tokenizer.get_vocab(with_added_tokens=False))
        self.memo = _Memo(tokenizer)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.widths = np.array([len(token) for token in table], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths


def _codec(rank_file: str) -> _Codec:
    return one_model(("byte-level BPE", rank_file), lambda: _Codec(rank_file))


class _Memo(dict):
    """Numbers pre-tokens, and keeps the ids of those numbered so far end to end.

    Beyond `MEMO_ENTRIES` a pre-token is kept for one step only.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.new: list[str] = []
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, token: str) -> int:
        self.new.append(token)
        self[token] = number = len(self)
        return number

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens end to end, and how many each of them has."""
        if self.new:
            fresh = []
            for i in range(0, len(self.new), 5_000):
                encoded = self.tokenizer.encode_batch_fast(self.new[i : i + 5_000], add_special_tokens=False)
                fresh += [e.ids for e in encoded]
            counts = np.fromiter(map(len, fresh), np.int64, len(fresh))
            self.ids = np.concatenate([self.ids, np.fromiter((i for ids in fresh for i in ids), np.int32, counts.sum())])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            self.new = []
        starts, counts = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        gathered = self.ids[shift + np.arange(len(shift))]
        while len(self) > MEMO_ENTRIES:
            self.popitem()
        self.ends = self.ends[: MEMO_ENTRIES + 1]
        self.ids = self.ids[: self.ends[-1]]
        return gathered, counts


def char_offsets(text_bytes: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token, from the bytes of a text.

    A token that starts or ends inside a character covers that whole character, so
    tokens which share a character overlap in it.
    """
    char_of = np.cumsum((text_bytes & 0xC0) != 0x80)
    ends = np.cumsum(token_bytes)
    return char_of[ends - token_bytes] - 1, char_of[ends - 1]


def _encode(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    import regex

    cut = regex.compile(pattern).findall
    codec = _codec(rank_file)
    memo, widths = codec.memo, codec.widths
    for batch in (part for whole in batches for part in slices(whole, "text", STEP_BYTES)):
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        numbers, tokens_of = [], []
        for text in texts:
            found = cut(text)
            numbers.append(np.fromiter(map(memo.__getitem__, found), np.int64, len(found)))
            tokens_of.append(len(found))
        ids, counts = memo.gather(np.concatenate(numbers))
        before = np.concatenate([[0], np.cumsum(counts)])
        ends = before[np.cumsum(tokens_of)]
        at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        columns = [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.ListArray.from_arrays(at, pa.array(ids))]
        if offsets:
            starts, stops, first = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32), 0
            for text, end in zip(texts, ends, strict=True):
                if end > first:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    starts[first:end], stops[first:end] = char_offsets(raw, widths[ids[first:end]])
                first = end
            columns += [pa.ListArray.from_arrays(at, pa.array(starts)), pa.ListArray.from_arrays(at, pa.array(stops))]
        names = [*batch.schema.names[:-1], "ids", "starts", "ends"][: len(columns)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True
) -> DataFrame:
    """Encode each whole text: `id_col`, `ids`, and with `offsets` also `starts`, `ends`.

    `starts` and `ends` are character offsets (end exclusive) of each token. Every match
    of `pattern` is encoded separately, without special tokens. One row per input row: a
    null text is empty and has no ids; repeated rows repeat; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(lambda batches: _encode(batches, rank_file, pattern, offsets), schema)


def _decode(batches: Iterator[pa.RecordBatch], rank_file: str, at: int) -> Iterator[pa.RecordBatch]:
    codec = _codec(rank_file)
    flat, widths, starts = codec.flat, codec.widths, codec.starts
    for batch in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
        lists = batch.column(at)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        n = widths[ids]
        written = np.concatenate([[0], np.cumsum(n)])
        raw = flat[np.repeat(starts[ids] - written[:-1], n) + np.arange(written[-1])].tobytes()
        per_row = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        cuts = written[np.concatenate([[0], np.cumsum(per_row)])]
        data = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        texts = [part.decode("utf-8", errors="replace") for part in data]
        columns = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(data, pa.binary()), pa.array(texts, pa.string())],
            names=[*batch.schema.names, "decoded", "decoded_text"],
        )


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode id lists: `id_col`, `ids_col`, `decoded` (bytes) and `decoded_text`.

    A list may begin or end inside a character; `decoded` holds its exact bytes, and
    `decoded_text` shows U+FFFD for the parts. Null and empty lists give empty bytes.
    """
    rows = encoded.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias(ids_col))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded binary, decoded_text string"
    return in_small_batches(rows).mapInArrow(lambda batches: _decode(batches, rank_file, 1), schema)


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids again: `id_col`, `ids`, `decoded`, `decoded_text`.

    The same as `decode(encode(...))` without offsets, but in one Python worker for each
    task, so the ids don't travel to the JVM and back in between.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(
        lambda batches: _decode(_encode(batches, rank_file, pattern, False), rank_file, 1),
        f"`{id_col}` {kind}, ids array<int>, decoded binary, decoded_text string",
    )
