import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.counter(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert COUNTER.count(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", " the", "  ", "\n\n", "<|endoftext|>", "<|endof", "'s", "'S", "ü", "123", "٣", "½", " ", " ", "thineare", "...", "_", "😀", "́", "〇", "\x85", "\x1c"]), max_size=30))
def test_joined_pieces(parts):
    assert COUNTER.count("".join(parts)) == library("".join(parts))


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, " " * 10_000, "\n" * 5000 + "x", "aAbB1 " * 10_000])
def test_long_runs(text):
    assert COUNTER.count(text) == library(text)


def test_documents_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "x y"), (7, None), (7, None), (8, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'n_bytes' as lang")
    rows = docs.unionByName(odd)
    want = sorted(str((r.doc_id, len((r.text or "").encode()), library(r.text or ""), library(r.text or "") > 1024)) for r in rows.collect())
    assert sorted(str(tuple(r)) for r in tokens.count_tokens(rows, PATH).collect()) == want
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0
