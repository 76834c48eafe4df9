"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import base64

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from plain import base_spans, components, listed, quality, simhash

from voxledger.llm import bpe, chat, copies, embedding, packing, pii, sharding, toxicity, url_rules
from voxledger.llm import quality as rules
from voxledger.llm import simhash as prints


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(odd_docs):
    return rows_of(odd_docs.select("doc_id", "text"))


def test_sharding(odd_docs, no_docs, texts):
    tree = sharding.even_tree()
    got = sharding.shard_rows(odd_docs, "doc_id", "text", tree)
    found = got.collect()
    assert len(found) == len(texts)
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in found)
    assert sharding.shard_rows(no_docs, "doc_id", "text", tree).count() == 0


def test_weights_move_rows_only_into_what_grew(spark):
    tree = sharding.even_tree(12, 6, 3)
    heavier = tuple(x._replace(weight=3.0) if x.shard == 5 else x for x in tree)
    from pyspark.sql import functions as F

    moved = spark.range(4000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b"))
    region = {x.shard: x.region for x in tree}
    rack = {x.shard: x.rack for x in tree}
    changed = [(r["a"], r["b"]) for r in moved.collect() if r["a"] != r["b"]]
    assert changed
    for a, b in changed:
        # Into the region that grew, or within it into the rack and shard that grew.
        assert region[b] == region[5]
        if region[a] == region[5]:
            assert rack[b] == rack[5] and (rack[a] != rack[5] or b == 5)


def test_quality(odd_docs, no_docs, texts):
    for df in (odd_docs, no_docs):
        stats = df.select("doc_id", rules.text_stats("text").alias("stats"))
        model = rules.fit_quality(stats, "stats")
        found = stats.select("stats", rules.judge(stats["stats"], model)).collect()
        assert len(found) == df.count()
        for (_, text), (s, kept) in zip(texts, found, strict=False):
            want = quality(text)
            assert tuple(s)[:5] == want
            assert not (kept and want[0] < 50)


PII_TEXTS = [
    "mail a.b@c-d.example.org, or x@y, or @z.com; a@b.cx_y@z.w",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.2 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111112222 5",
    "+1 (555) 123-4567 +49 30 1234567 +1 2 +123456789012345678 ++12345678",
    "token = \"0123456789abcdef0123456789abcdef01234567\" password=da90f32ccfa9408d1c",
    "☃☃ é@x.de not, e@x.de yes 𝒳 10.0.0.1",
    "9" * 30_000,
    "1 " * 20_000,
    "a" * 30_000 + "@b.c",
    "1.1.1.1 " * 3_000,
    "4111 1111 1111 1111@x.com +4111111111111111.example",
]


def test_pii(spark, odd_docs, no_docs, texts):
    docs = odd_docs.select("doc_id", "text").union(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(PII_TEXTS)], "doc_id bigint, text string")
    )
    want = [*texts, *((100 + i, t) for i, t in enumerate(PII_TEXTS))]
    names = (*pii.KINDS, *pii.EXTRA)
    got = [(r["doc_id"], r["spans"]) for r in pii.find_pii(docs, "doc_id", "text").collect()]
    strict = sorted((i is None, i, listed([(names[s["kind"]], s["start"], s["end"]) for s in spans if s["base"]])) for i, spans in got)
    assert strict == sorted((i is None, i, listed(base_spans(t))) for i, t in want)
    assert pii.find_pii(no_docs, "doc_id", "text").count() == 0


def test_masking(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate([*PII_TEXTS, None])], "doc_id bigint, text string, spans string")
    masked = {r["doc_id"]: r for r in pii.mask_documents(docs, "text").collect()}
    for i, text in enumerate(PII_TEXTS):
        assert not base_spans(masked[i]["text"]), text[:60]
        assert masked[i]["spans"] == "keep"
    assert masked[5]["text"].endswith("yes 𝒳 <IP>")
    assert masked[len(PII_TEXTS)]["text"] is None
    assert pii.mask_documents(odd_docs, "text").columns == odd_docs.columns
    assert pii.mask_documents(no_docs, "text").count() == 0


def test_toxicity(spark, odd_docs, no_docs, texts):
    labels = spark.createDataFrame([(0, None), (None, 1), (12, 1), (12, 0)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(odd_docs, labels, "doc_id", "text", "toxic").collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(no_docs, labels, "doc_id", "text", "toxic").count() == 0
    assert toxicity.score_documents(odd_docs, labels.limit(0), "doc_id", "text", "toxic").count() == len(texts)


def test_toxic_terms_are_found_under_disguise():
    found = toxicity.automaton(("idiot", "clown", "loser"), ("class clown",))
    assert toxicity.find_terms("You 1D10T, іdіоt! An ìdíöt.", found) == {0: 3}
    assert toxicity.find_terms("idiotic clowns are the class clown; a l0ser, a CLOWN!!", found) == {2: 1, 1: 1}
    assert toxicity.find_terms("", found) == {}


def test_learned_words(spark):
    from plain import prose

    rows = [(i, prose(60, i) + (" zorblax" if i % 2 else ""), int(i % 2)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, labels, "doc_id", "text", "toxic").collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_simhash(odd_docs, no_docs, texts):
    found = prints.near_duplicates(odd_docs, "doc_id", "text").collect()
    assert len(found) == len(texts)
    mask = (1 << 64) - 1
    assert sorted(r["print"] & mask for r in found) == sorted(simhash(t) for _, t in texts)
    values = {(simhash(t)): None for _, t in texts}
    least = {v: min([i for i, t in texts if simhash(t) == v and i is not None], default=None) for v in values}
    near = components(range(len(values)), [(a, b) for a, x in enumerate(values) for b, y in enumerate(values) if (x ^ y).bit_count() <= 3])
    for r in found:
        root = near[list(values).index(r["print"] & mask)]
        ids = [least[v] for k, v in enumerate(values) if near[k] == root and least[v] is not None]
        assert r["component_id"] == min(ids, default=None)
    assert prints.near_duplicates(no_docs, "doc_id", "text").count() == 0
    kept = prints.keep_first(odd_docs, "doc_id", "text")
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r["component_id"] for r in found if r["doc_id"] is not None})
    assert ids.count(None) == 1


def test_split_shards_link_as_whole_ones(spark, monkeypatch):
    import random

    monkeypatch.setattr(prints, "TREE_ROWS", 8)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 120:
        value = rng.choice(sorted(values))
        for _ in range(rng.choice((1, 2, 3, 4))):
            value ^= 1 << rng.randrange(64)
        values.add(value)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    classes = spark.createDataFrame([(s,) for s in signed.values()], "print bigint")
    links = [tuple(r) for r in prints.linked_prints(classes, "print").collect()]
    want = components(signed.values(), [(signed[a], signed[b]) for a in values for b in values if (a ^ b).bit_count() <= 3])
    assert components(signed.values(), links) == want


def test_urls(spark):
    rules_ = (
        url_rules.host_rule("net", "/", "block"),
        url_rules.host_rule("example.net", "/en/", "allow"),
        url_rules.Rule("ad", "*/ads/*banner^", "block"),
        url_rules.Rule("any", "*track*", "block"),
    )
    urls = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        "http://Sub.Example.NET/en/x?q=/y#z": ("sub.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://internet/": ("internet", "/", None, "allow"),
        "http://a.org/ads/top-banner?x": ("a.org", "/ads/top-banner", "ad", "block"),
        "http://a.org/ads/bannered": ("a.org", "/ads/bannered", None, "allow"),
        "http://a.org/xtracker": ("a.org", "/xtracker", "any", "block"),
        "http://a?b://c": ("a", "", None, "allow"),
        "ftp://x#y/z": ("x", "", None, "allow"),
        "://h/p": ("h", "/p", None, "allow"),
    }
    df = spark.createDataFrame([(u, "clash") for u in urls], "url string, host string")
    for frame in (df, df.limit(0)):
        host, path, won = url_rules.judge_urls(frame, "url", rules_)
        found = frame.select("url", host, path, won["rule"], won["verdict"]).collect()
        assert all(tuple(r)[1:] == urls[r["url"]] for r in found) and len(found) == frame.count()


def test_chat(spark):
    kinds = "array<struct<type: string, text: string, ref: string, tokens: bigint>>"
    rows = [
        (1, 1, "assistant", [("text", "\\s <|im_end|>\n", None, None), ("image", None, "i.png", None), None]),
        (1, 0, "us\ner<|", [("document", None, "d.pdf", 9), ("text", None, None, None), ("odd", None, None, None)]),
        (None, None, None, None),
        (2, 0, "assistant", []),
        (2, 0, "assistant", []),
    ]
    turns = spark.createDataFrame(rows, f"conv bigint, turn int, role string, parts {kinds}").selectExpr("*", "1 AS formatted")
    done = chat.format_conversations(turns, "conv", "turn", "role", "parts")
    got = {
        r["conv"]: r
        for r in done.select("*", chat.read_turns(done["formatted"]).alias("turns"), chat.read_loss(done["formatted"], done["loss_spans"]).alias("loss")).collect()
    }
    assert [tuple(t) for t in got[1]["turns"]] == [("us\ner<|", "<|document|><|odd|>"), ("assistant", "\\s <|im_end|>\n<|image|>")]
    assert [(a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [("document", "d.pdf", 9), ("odd", None, 0), ("image", "i.png", 256)]
    assert got[1]["expanded_tokens"] == 265
    assert got[1]["loss"] == "\\s <|im_end|>\n<|image|>"
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")] and got[2]["n_turns"] == 2
    assert chat.format_conversations(turns.limit(0), "conv", "turn", "role", "parts").count() == 0


@pytest.fixture(scope="module")
def bpe_files():
    import tiktoken

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(odd_docs, no_docs, texts, bpe_files):
    path, own = bpe_files
    found = bpe.encode_documents(odd_docs, "doc_id", "text", path, public_tokenizers.PATTERN)
    found = found.withColumn("raw", bpe.decode_column(found["ids"], path, public_tokenizers.PATTERN)).collect()
    assert [r["ids"] for r in found] == [own.encode_ordinary(t or "") for _, t in texts]
    assert [bytes(r["raw"]) for r in found] == [(t or "").encode() for _, t in texts]
    assert bpe.encode_documents(no_docs, "doc_id", "text", path, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_texts(bpe_files):
    import random

    path, own = bpe_files
    mine, rng = bpe.encoder(path, public_tokenizers.PATTERN), random.Random(3)
    alphabets = ["ab", "aA ", "the ing.", "0123456789", "äöüß ", "\n \t\u00a0\u2003\x1c\x85x", "a \0b", "!?-=_*", "漢字🙂 ", " '’streldvm"]
    for k in range(3000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.choice((1, 3, 20, 90, 400))))
        assert mine.encode(text).tolist() == own.encode_ordinary(text), repr(text)


def test_packing(odd_docs, no_docs, texts):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(odd_docs, "doc_id", "text", path, capacity=64).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 0) == 1
    by_window = {}
    for r in got:
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], len(r["ids"]) // 4))
    for held in by_window.values():
        at = 0
        for offset, length, n in sorted(held):
            assert offset == at and length == n
            at += length
        assert at <= 64
    assert packing.pack_documents(no_docs, "doc_id", "text", path).count() == 0


def test_word_tokens_are_the_tokenizers():
    import random

    from tokenizers import Tokenizer

    from voxledger.llm.tokens import WordTokens

    path, rng = str(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    alphabets = ["ab ", "the ing. ", "012 ", "äß \n", "\n \t\u00a0\u2003\x1c\x85x", "a \0\rb", "!?-= '", "漢🙂 ", "<|endoftext|> "]
    texts_ = ["".join(rng.choices(rng.choice(alphabets), k=rng.choice((0, 1, 5, 60)))) for _ in range(2000)] + ["a <|endoftext|> b"]
    want = [e.ids for e in own.encode_batch(texts_, add_special_tokens=False)]
    import numpy as np

    assert [np.frombuffer(x, "<u4").tolist() for x in WordTokens(path).encode(texts_)] == want


def test_embedding(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], None, [nan, 1.0, 0.0], [inf, 0.0, 1.0], [None, 1.0, 0.0], [1.0], []]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, [1.0, 0.0, 0.0], "y"), (3, [0.0, 1.0, 0.0], "again")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node string")
    got = sorted((r["vec_id"] is None, r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df, "vec_id", "embedding").collect())
    # The row without an id counts as a link of others and shares their component.
    want = {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (1, 3), None: (3, 0)}
    assert len(got) == len(rows)
    for null, vec_id, links, component, kept in got:
        assert (links, component) == want.get(vec_id, (0, vec_id)) and kept == (not null and vec_id == component)
    assert embedding.near_duplicates(df.limit(0), "vec_id", "embedding").count() == 0
    nameless = embedding.near_duplicates(df.withColumn("vec_id", F.lit(None).cast("bigint")), "vec_id", "embedding").collect()
    assert sorted(r["n_links"] for r in nameless) == [0] * 7 + [1] * 2 + [3] * 4
    assert all(r["component_id"] is None and not r["kept"] for r in nameless)


def test_vectors_of_every_length_are_compared(spark, monkeypatch):
    import numpy as np

    # Few enough sampled that the rarest lengths have no trees of their own.
    monkeypatch.setattr(embedding, "SAMPLE_ROWS", 300)
    rng = np.random.default_rng(4)
    vectors = []
    for size, n in ((16, 500), (24, 300), (5, 3)):
        base = rng.standard_normal((n, size))
        vectors += [v for x in base for v in (x, x + 0.1 * rng.standard_normal(size))]
    vectors += [np.array([1.0]), np.array([3.0]), np.array([-1.0])]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding.near_duplicates(df, "vec_id", "embedding").collect()}
    hits = []
    for size in {len(v) for v in vectors}:
        at = [i for i, v in rows if len(v) == size]
        x = np.array([rows[i][1] for i in at])
        x /= np.linalg.norm(x, axis=1)[:, None]
        hits += [(at[a], at[b]) for a, b in np.argwhere(np.triu(x @ x.T >= 0.9, 1))]
    links = [sum(i in pair for pair in hits) for i in range(len(rows))]
    assert all(got[i]["n_links"] <= links[i] for i in got) and len(got) == len(rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(links)
    short = [i for i, v in rows if len(v) in (1, 5)]
    want = components(range(len(rows)), hits)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (links[i], want[i]) for i in short)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (0, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(rows_of(embedding.near_duplicates(df, "vec_id", "embedding")))
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 1, True), (2, 1, 1, False)]


def test_near_copies_with_columns_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, {"a": 2}), (5, text, {"a": 1}), (5, "another text", {}), (None, text + " more", None), (None, "x y", None), (None, "x y", {"b": 1})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tags map<string, int>")
    got = sorted((r["doc_id"] or 0, r["text"], str(r["tags"])) for r in copies.keep_first(docs, "doc_id", "text").collect())
    assert [(i, t) for i, t, _ in got] == [(0, "x y"), (5, "another text"), (5, text)] and got[2][2] == "{'a': 1}"
    assert copies.keep_first(docs.limit(0), "doc_id", "text").count() == 0


def test_dense_leaves_are_split(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(embedding, "BLOCK_ROWS", 50)
    monkeypatch.setattr(embedding, "TILE_ROWS", 16)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.standard_normal(8) + 0.02 * rng.standard_normal((200, 8)), rng.standard_normal((100, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding.near_duplicates(df, "vec_id", "embedding").collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    assert all(got[i]["n_links"] <= hit[i].sum() for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * hit.sum()
    want = components(range(len(x)), map(tuple, np.argwhere(hit)))
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.98 * len(x)
