"""Ids and texts of the chunk table against the library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from plain import prose, sha

from voxledger.llm import marked_words
from voxledger.llm.queries import registry

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
SIGNS = [" ", "  ", "▁", "a", "b", "the", "\n", "\t", "\0", "①", "ﬁ", "é", "é", " ", "𝒳", "<s>", "</s>", "<0x41>", "中", "\x81", "ÁÁ"]


@pytest.fixture(scope="module")
def model():
    return marked_words.PieceModel(PATH)


def split(flat, ends):
    start, out = 0, []
    for end in ends:
        out.append([int(i) for i in flat[start:end]])
        start = end
    return out


def test_random_texts(model):
    rng = random.Random(7)
    assert model.by_words
    for _ in range(60):
        texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(12))) for _ in range(40)]
        flat, ends = model.encode(pa.array(texts))
        want = model.library.encode(texts, add_eos=True)
        assert split(flat, ends) == want
        assert model.decode(flat, ends) == [model.library.decode(ids) for ids in want]


def test_random_ids_decode_as_in_the_library(model):
    import numpy as np

    rng = random.Random(9)
    lists = [[rng.choice([0, 1, 2, 3, 35, 196, 198, 225, 259, 264, 300, 28705, 29000]) for _ in range(rng.randrange(6))] for _ in range(2000)]
    ends = np.cumsum([len(ids) for ids in lists])
    assert model.decode(np.array([i for ids in lists for i in ids], dtype=np.int32), ends) == [model.library.decode(ids) for ids in lists]


def test_table_is_begun_anew(model, monkeypatch):
    monkeypatch.setattr(marked_words, "TABLE_BYTES", 100)
    texts = [prose(50, i) for i in range(5)]
    for _ in range(3):
        flat, ends = model.encode(pa.array(texts))
        assert split(flat, ends) == model.library.encode(texts, add_eos=True)
        assert len(model.words) == 0


def test_model_without_word_borders_takes_whole_texts(model):
    other = marked_words.PieceModel(PATH)
    other.by_words = False
    texts = ["a b  c", "", " x ", prose(40)]
    assert split(*other.encode(pa.array(texts))) == model.library.encode(texts, add_eos=True)


def test_odd_documents(odd_docs, no_docs, model):
    got = marked_words.encode_documents(odd_docs, "doc_id", "text", PATH)
    assert got.columns == ["doc_id", "ids"]
    want = sorted(str((r["doc_id"], model.library.encode(r["text"] or "", add_eos=True))) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted(str((r["doc_id"], r["ids"])) for r in got.collect()) == want
    assert marked_words.encode_documents(no_docs, "doc_id", "text", PATH).count() == 0


def test_long_texts_are_worked_on_in_steps(spark, model, monkeypatch):
    rows = [(0, "y" * 200_000), (1, None), (2, "word " * 60_000), (3, " ")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    monkeypatch.setattr(marked_words, "STEP_BYTES", 1000)
    for r in marked_words.encode_documents(docs, "doc_id", "text", PATH).collect():
        assert r["ids"] == model.library.encode(rows[r["doc_id"]][1] or "", add_eos=True)


def test_query(spark, sf_dir, model):
    got = {r["doc_id"]: r for r in registry.queries["op11_sentencepiece"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = model.library.encode(text or "", add_eos=True)
        assert (got[doc_id]["n_tokens"], got[doc_id]["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[doc_id]["decoded_sha256"] == sha(model.library.decode(ids))
