import hashlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from offerlake.llm import byte_bpe, queries, token_counts
from offerlake.llm.tables import tokenizer_file

SF = "/root/testdata/sf0.001"
RANKS, PIECES = tokenizer_file(queries.RANKS), tokenizer_file(queries.PIECES)
ODD = ["", " ", "  ", " a  b ", "▁x ▁▁ y\n\n z\t<s>", "é€🙂 x\x00y", "x" * 30_000, "á    1٣", "don't  'll"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "other") for i, t in enumerate(ODD)] + [(1, " ", "again"), (1, "else", None), (None, "hi", None), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), rows


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_token_counts_equal_the_library(spark, odd):
    docs, rows = odd
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows)
    got = token_counts.count_tokens(docs, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_token_count_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, SF).collect()}
    for r in docs:
        n = len(library.encode(r.text))
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 4096)


def reference_encoding():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={}
    )


def test_bpe_round_trip_of_odd_texts(spark, odd):
    docs, rows = odd
    library = reference_encoding()
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=False)
    got = byte_bpe.decode(encoded, RANKS).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    assert all(r.decoded_text == bytes(r.decoded).decode() for r in got)
    both = byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_offsets_and_split_characters(spark):
    text = "héé €🙂 x"
    docs = spark.createDataFrame([(9, text)], "doc_id long, text string")
    row = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).head()
    table = {v: k for k, v in byte_bpe.load_ranks(RANKS).items()}
    raw, at = text.encode(), 0
    for i, a, b in zip(row.ids, row.starts, row.ends, strict=True):
        token = table[i]
        assert token in text[a:b].encode() and raw[at : at + len(token)] == token
        at += len(token)
    assert row.ends[-1] == len(text) and any(b > c for b, c in zip(row.ends, row.starts[1:], strict=False))
    part = spark.createDataFrame([(1, row.ids[5:6]), (2, None)], "doc_id long, ids array<int>")
    cut = {r.doc_id: r for r in byte_bpe.decode(part, RANKS).collect()}
    assert bytes(cut[1].decoded) == table[row.ids[5]] and "�" in cut[1].decoded_text
    assert bytes(cut[2].decoded) == b"" and cut[2].decoded_text == ""


def test_bpe_query(spark):
    library = reference_encoding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text)
        want = (len(ids), sha(",".join(map(str, ids)).encode()), sha(r.text.encode()))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want
