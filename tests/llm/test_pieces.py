"""Piece encoding against the sentencepiece library, and decoding of any ids."""

import hashlib
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listings_spark.llm import pieces
from listings_spark.llm.queries import op11_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as file:
        return pieces.Pieces(file.read())


ODD = st.sampled_from([" ", "  ", "\n", "▁", "▁▁", "<s>", "</s>", "<0x0A>", "é", "é", "日本", "😀", "\x00", "​", "the", "ing"])
TEXTS = st.lists(st.one_of(ODD, st.text(max_size=6)), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_ids_and_text_equal_the_library(vocabulary, texts):
    texts = [t.encode(errors="replace").decode() for t in texts]
    told = vocabulary.library.encode(texts, add_eos=True)
    assert vocabulary.encode(texts) == told
    assert not any(vocabulary.doubtful)
    assert [vocabulary.decode(i) for i in told] == [vocabulary.library.decode(i) for i in told]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999), st.just(28705)), max_size=10))
def test_any_ids_decode_as_in_the_library(vocabulary, ids):
    assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdetingor▁", min_size=1, max_size=40))
def test_both_agendas_agree(vocabulary, chunk):
    symbols = vocabulary.table.single[[ord(c) for c in chunk]]
    known = [vocabulary.ids[p] for p in pieces.merged(chunk, vocabulary.ranks)]
    assert list(vocabulary.table.merge(symbols[None, :])[0]) == known


def test_a_wrong_chunk_is_named(vocabulary):
    vocabulary.learn(["▁one", "▁other", "\t"])
    vocabulary.recent["▁other"] = (5, 6)
    vocabulary.check(["▁one", "▁other", "\t"])
    assert vocabulary.wrong == {"▁other"}
    assert vocabulary.encode(["one", "one other"]) and vocabulary.doubtful == [False, True]
    vocabulary.wrong.clear()
    del vocabulary.recent["▁other"]


def test_long_text_without_spaces(vocabulary):
    text = "abcdefgh" * 40_000
    start = time.perf_counter()
    assert vocabulary.encode([text])[0] == vocabulary.library.encode(text, add_eos=True)
    assert time.perf_counter() - start < 60


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, None, "z"), (2, "", None), (3, "▁ \n long " * 9000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumnRenamed("n_tokens", "agrees")
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in pieces.encode(docs, MODEL).collect()}
    assert all(r["agrees"] for r in pieces.encode(docs, MODEL).collect())
    empty = hashlib.sha256(b"2").hexdigest()
    assert (None, 1, empty) in found and (2, 1, empty) in found and len(found) == 4
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_query_equals_the_library(spark, vocabulary):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    made = {r["doc_id"]: r for r in op11_pieces(spark, folder).collect()}
    assert len(made) == len(docs)
    for doc in docs:
        ids = vocabulary.library.encode(doc["text"] or "", add_eos=True)
        row = made[doc["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["agrees"]
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest()
