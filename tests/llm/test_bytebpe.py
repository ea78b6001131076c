"""Byte-level BPE beside the library that defines its results."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ruleloom.llm import bytebpe
from ruleloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bytebpe.RANKS)
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "中", "\x1c", "\x85", "\xa0", "abab", "the", "-", "...", "ing", "'LL", "'ll", "\r\n", "　", "\U0001f44d", "́", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tokens():
    return bytebpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@pytest.fixture(scope="module")
def encoder(tokens):
    return bytebpe.ByteEncoder(tokens, public_tokenizers.PATTERN)


def test_ids_are_the_librarys(encoder, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("aabehinorst") for _ in range(rng.randint(1, 200))) for _ in range(1000)]
    texts += [rng.choice(["a", "ab", "=", "-=", "  ", "\n", " a"]) * rng.randint(1, 2000) for _ in range(60)]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), text


def test_every_letter(encoder, library):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 97):
        for text in ("".join(letters[at : at + 97]), " ".join(letters[at : at + 97])):
            assert encoder.encode(text).tolist() == library.encode_ordinary(text), hex(at)


def test_a_token_without_merge_stands_for_whole_matches_only():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b" x"]
    plain = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    own = bytebpe.ByteEncoder(tokens, public_tokenizers.PATTERN)
    for text in ("abcd", "abcde", " abcd", "xab xabcd", "ab", " x xx"):
        assert own.encode(text).tolist() == plain.encode_ordinary(text)


def test_forgetting_changes_nothing(tokens, library, monkeypatch):
    for name in ("CACHED_RUNS", "CACHED_PAIRS", "CACHED_LETTERS"):
        monkeypatch.setattr(bytebpe, name, 3)
    own = bytebpe.ByteEncoder(tokens, public_tokenizers.PATTERN)
    text = "Onthren thwhesou, erblest'll heinthe onthsh thwhesou " * 3
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_a_long_match_takes_linear_steps(tokens):
    own = bytebpe.ByteEncoder(tokens, public_tokenizers.PATTERN)
    calls = []
    side_by_side = own._side_by_side
    own._side_by_side = lambda *a: calls.append(1) or side_by_side(*a)
    assert len(own.encode("x" * 400_000)) > 10
    assert len(calls) < 1000  # verdicts are remembered


def test_rows_nulls_long_texts_and_other_columns(spark, library):
    texts = ["Hello world", "", None, "   ", "x" * 50_000 + " end", "Hello world", "a\nb  ć \U0001f44d", "word " * 20_000]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 9), (0, texts[0], 9), (None, "null id", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = bytebpe.byte_encoded(docs).collect()
    assert len(found) == len(rows)
    wanted = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in found) == wanted
    assert bytebpe.byte_encoded(docs.limit(0)).count() == 0


def test_decoding_by_itself(spark, library):
    ids = [library.encode_ordinary("Any text, é 中."), [], None, [198, 198]]
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, ids array<int>")
    back = rows.select("k", bytebpe.decode(spark, F.col("ids"), PATH).alias("b")).orderBy("k").collect()
    assert [bytes(r.b) for r in back] == [library.decode_bytes(i or []) for i in ids]


def test_query_on_the_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["op11_byte_bpe_roundtrip"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
