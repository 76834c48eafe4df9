"""Registered queries against SQL or a plain version, on the smallest tables."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import difference, duck
from plain import base_spans, components, listed, quality, sha, simhash

from voxledger.llm.queries import registry


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def by_id(spark, sf_dir, name, key="doc_id"):
    rows = registry.queries[name](spark, sf_dir).collect()
    return {r[key]: r for r in rows}, len(rows)


@pytest.mark.parametrize("name", sorted(registry.twins))
def test_twin(spark, sf_dir, name):
    assert difference(registry.queries[name](spark, sf_dir), registry.twins[name], duck(sf_dir)) is None


def test_sharding_rows(spark, sf_dir, documents):
    got, n = by_id(spark, sf_dir, "op1_sharding")
    assert n == len(documents)
    for doc_id, text in documents:
        assert got[doc_id]["text_crc32"] == zlib.crc32((text or "").encode())
        assert got[doc_id]["grown_shard"] in (got[doc_id]["shard"], 40)


def test_quality(spark, sf_dir, documents):
    got, n = by_id(spark, sf_dir, "op2_quality_rules")
    assert n == len(documents)
    for doc_id, text in documents:
        row, want = got[doc_id], quality(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert row["kept"] == (not row["base_failed"] and row["probability"] >= 0.5)


def test_quality_agrees_with_labels(spark, sf_dir):
    got, _ = by_id(spark, sf_dir, "op2_quality_rules")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    right = sum(got[r["doc_id"]]["kept"] == bool(r["quality"]) for r in labels)
    assert right >= 0.9 * len(labels)
    assert all(got[r["doc_id"]]["kept"] for r in labels if r["quality"] and not got[r["doc_id"]]["base_failed"])


def test_pii(spark, sf_dir, documents):
    got, n = by_id(spark, sf_dir, "op3_pii")
    assert n == len(documents)
    for doc_id, text in documents:
        row, want = got[doc_id], base_spans(text)
        assert row["base_sha256"] == sha(listed(want))
        assert set(listed(want).split(",")) <= set(row["spans"].split(","))
        for kind in ("email", "ip", "card", "phone"):
            assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in want)


def test_toxicity(spark, sf_dir, documents):
    got, n = by_id(spark, sf_dir, "op4_toxicity")
    assert n == len(documents)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    for r in labels:
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)
    assert not any(got[r["doc_id"]]["predicted"] for r in labels if not r["toxic"])


def test_toxicity_on_held_out_rows(spark):
    """The larger tables hold enough toxic documents in other languages to learn their stems."""
    sf_dir = "/root/testdata/sf0.1"
    got, _ = by_id(spark, sf_dir, "op4_toxicity")
    held = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    toxic = [got[r["doc_id"]]["predicted"] for r in held if r["toxic"]]
    clean = [got[r["doc_id"]]["predicted"] for r in held if not r["toxic"]]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_simhash(spark, sf_dir, documents):
    got, n = by_id(spark, sf_dir, "op6_simhash")
    assert n == len(documents)
    prints = {doc_id: simhash(text) for doc_id, text in documents}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(prints, links)


def test_bpe(spark, sf_dir, documents):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, n = by_id(spark, sf_dir, "op8_bpe")
    assert n == len(documents)
    for doc_id, text in documents:
        ids = own.encode_ordinary(text or "")
        row = got[doc_id]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert row["decoded_sha256"] == sha(text or "")


def test_embedding(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got, n = by_id(spark, sf_dir, "op9_embedding_dedup", "vec_id")
    assert n == len(rows)
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    found = sum(r["n_links"] for r in got.values())
    assert 0.9 * hit.sum() <= found <= hit.sum()
    ids = [r["vec_id"] for r in rows]
    want = components(ids, [(ids[a], ids[b]) for a, b in np.argwhere(hit)])
    assert sum(got[i]["component_id"] == want[i] for i in ids) >= 0.98 * len(ids)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_packing(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    own.encode_special_tokens = True
    rows = registry.queries["op10_packing"](spark, sf_dir).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in documents:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    lengths = []
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        lengths.append(at)
    assert max(lengths) <= 1024 and sum(n < 1024 for n in lengths) <= 1
