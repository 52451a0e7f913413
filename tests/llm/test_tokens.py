import base64
import random

import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import queries, tokens

CODEC = tokens.codec(tokens.BYTE_BPE_50K)
PLAIN = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def test_whole_table_against_another_encoder(spark, folder):
    d = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    got = {r.doc_id: list(r.ids) for r in queries.p7_ids(spark, folder).collect()}
    assert got == {i: PLAIN.encode_ordinary(t) if t else [] for i, t in zip(d.doc_id, d.text)}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODEC.encode(text) == PLAIN.encode_ordinary(text) and CODEC.decode(CODEC.encode(text)) == text


def test_random_pieces():
    rng = random.Random(5)
    parts = ["a", "ab", "the", " ", "  ", "\n", "é", "1", "23", "!", "ing", "tion", "<|endoftext|>", "中", "aaaa", "'s"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert CODEC.encode(text) == PLAIN.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 100_000, " " * 100_000, "=-" * 50_000])
def test_long_pieces_in_linear_time(text):
    assert CODEC.encode(text) == PLAIN.encode_ordinary(text)


def test_small_vocabulary_that_needs_steps_back():
    words = [b"a", b"b", b"c", b"ab", b"bc", b"abcc", b"cc"]
    codec = tokens.Codec({w: i for i, w in enumerate(words)}, r"\w+")
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        assert list(codec.encode_piece(text)) == codec.merged(text.encode())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "Hello", "x"), (2, " \t", "x")], "doc_id bigint, text string, ids string")
    assert [(r.doc_id, r.ids) for r in tokens.encode(df, "doc_id", "text").collect()] == [(1, []), (2, []), (None, [15496]), (2, PLAIN.encode_ordinary(" \t"))]
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert [r[0] for r in df.select(tokens.token_count(F.col("text"))).collect()] == [0, 0, 1, len(PLAIN.encode_ordinary(" \t"))]


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "Grüße, 世界 ❤️"), (2, "")], "doc_id bigint, text string")
    back = tokens.encode(df, "doc_id", "text").select("doc_id", tokens.decode(F.col("ids")).alias("text"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert CODEC.decode(None) is None and CODEC.decode([10**6]) is None and CODEC.decode([-1]) is None
    assert all(base64.b64encode(CODEC.token[i]) for i in range(256))
