"""Operator 9 against the tokenizer library itself."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from churnlab.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(texts, library):
    got = T._Counter(PATH)(texts)
    assert got["n_tokens"] == [len(e) for e in library.encode(texts, num_threads=1)]
    assert got["n_bytes"] == [len(t.encode()) for t in texts]


def test_edge_texts(library):
    same(["", " ", "  ", "\n", "\n\n a", "a  b\n c ", "\x00a<s>▁b</s>", "é́ﬁ日本語😀", "▁▁▁", "a▁ b", "\tx\r\n"], library)


def test_long_pre_tokens(library):
    same(["a" * 5000, " " * 3001, "ab" * 3000, "the" * 2000, "日" * 1000, "- " * 4000], library)


def test_random_texts(library):
    rnd = random.Random(7)
    alphabets = ("ab cd▁  \n\tthe ing éß日本語😀\x00<s>.", "ethaonis", "  a")
    same(["".join(rnd.choice(a) for _ in range(rnd.randint(0, 60))) for a in alphabets for _ in range(3000)], library)


def test_whole_table(spark, library):
    from conftest import SF001
    from churnlab.llm.queries import op9_token_counts
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    got = op9_token_counts(spark, SF001).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(library.encode(t)) for k, t in docs.items()}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_nulls_repeats_empty_table_and_extra_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(T.count_tokens(df, PATH).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 0), ("1", 0), ("2", 2), ("None", 0)]
    empty = T.count_tokens(df.where(F.lit(False)), PATH)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0
