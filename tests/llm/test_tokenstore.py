"""The token store against the library's encoder, by an exact round trip."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallywort.llm import common, queries, tokenstore

PATH = public_tokenizers.path(queries.TOKENIZER)
ODD = [
    "it's we'll 'S O'Neil don't", "a\u00a0b\u2003c\u0085d\u1680e", "e\u0301 \u0301 x\u0301\u0323", "\x0b\x0c\x1c\x1d\x1e\x1f\r\n\tx", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΑΣ. İSTANBUL ẞ",
    "ﬁ ½ ① 한국어 日本語テスト 👩\u200d👩\u200d👧 12,345.67%", "   ", "\n\n", "", None, "--- ... !!!??? \u2028\u2029", "x" * 5000, "a\x00b", "नमस्ते दुनिया", "\ud7ff\ufffd",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(library, texts, end=1):
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes() for t in texts]


def test_chunks_encode_like_whole_texts(library):
    r = random.Random(2)
    signs = [c for t in ODD if t for c in t[:40]] + list(" \n ' \t")
    texts = [t or "" for t in ODD] + ["".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(600)]
    e = tokenstore.Encoder(PATH, 1, True)
    for _ in range(2):
        assert [np.frombuffer(x, e.kind).astype("<u4").tobytes() for x in e.encode(texts)] == want(library, texts)
    assert e.kind.itemsize == 2 and not any(len(c) > tokenstore.CHUNK_CHARS for c in e.recent)


def test_remembered_chunks_are_bounded(library, monkeypatch):
    monkeypatch.setattr(tokenstore, "REMEMBERED", 50)
    e = tokenstore.Encoder(PATH, 1, True)
    for i in range(20):
        texts = [f"w{i} w{j} both" for j in range(40)]
        assert [np.frombuffer(x, e.kind).astype("<u4").tobytes() for x in e.encode(texts)] == want(library, texts)
        assert len(e.recent) + len(e.older) < 250


def documents():
    r = random.Random(7)
    ids = r.sample(range(-10_000, 10_000), 300)
    rows = [(i, " ".join(r.choice(["Haus", "river", "walks", "ünd", "2024", "-"]) for _ in range(r.choice([0, 1, 5, 60])))) for i in ids]
    return rows + [(20_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (None, "no id either"), (None, None), (2**62, "z " * 30_000), rows[5], rows[5], (rows[6][0], "again"), (-(2**63), "least")]


@pytest.mark.parametrize(("chunked", "parts", "block"), [(True, 4, tokenstore.KEYS_A_BLOCK), (False, 7, 16)])
def test_round_trip(spark, tmp_path, library, monkeypatch, chunked, parts, block):
    monkeypatch.setattr(tokenstore, "KEYS_A_BLOCK", block)
    monkeypatch.setattr(tokenstore, "READ_BYTES", 4096)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS shard", "3 AS name", "4 AS hash").repartition(5)
    store = tokenstore.write(df, str(tmp_path / "s"), PATH, 1, chunked)
    got = [(r["key"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in tokenstore.read(spark, store, df.select(F.col("doc_id").alias("key"))).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    got.sort(key=lambda x: x[1])
    assert len(store.names) > 1 and len(got) == len(rows)
    by_key = lambda key, data: (key is not None, key or 0, data)
    assert sorted(by_key(k, x) for k, _, _, x in got) == sorted(by_key(k, x) for (k, _), x in zip(rows, want(library, [t for _, t in rows]), strict=True))
    assert [x[0] for x in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    starts = np.cumsum([0, *(n for _, _, n, _ in got)])
    assert [x[1] for x in got] == starts[:-1].tolist() and all(len(x[3]) == 4 * x[2] for x in got)
    # keyed access without Spark
    first = {}
    for k, _, _, x in got:
        first.setdefault(k, x)
    for k in [None, -(2**63), 2**62, rows[0][0], rows[5][0], rows[6][0]]:
        assert store.get(k).tobytes() == first[k]
    assert store.get(123_456_789) is None
    asked = spark.createDataFrame([(rows[9][0],), (555_555,), (None,)], "key long")
    some = tokenstore.read(spark, store, asked).collect()
    assert sorted(bytes(r["ids"]) for r in some) == sorted(x for k, _, _, x in got if k in (None, rows[9][0]))


def test_index_is_minimal_and_perfect():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        h = np.unique(r.integers(0, 2**64, n, np.uint64))
        null = np.zeros(len(h), bool)
        values = np.empty(len(h), [(c, "<u8") for c in ("count", "shard", "record", "offset", "length")])
        for c in values.dtype.names:
            values[c] = np.arange(len(h))
        index = tokenstore.Index.load(tokenstore.Index.build(h, null, values).dump())
        slot = index.find(h, null)
        assert sorted(slot.tolist()) == list(range(len(h))) and (index.slots["offset"][slot] == np.arange(len(h))).all()
        other = r.integers(0, 2**64, 1000, np.uint64)
        assert (index.find(other[~np.isin(other, h)], np.zeros((~np.isin(other, h)).sum(), bool)) == -1).all()
        if n == 50_000:
            assert index.words.nbytes * 8 / len(h) < 6


def test_index_of_equal_hashes():
    h, null = np.array([tokenstore.SEED, tokenstore.SEED, 9], np.uint64), np.array([False, True, False])
    values = np.zeros(3, [(c, "<u8") for c in ("count", "shard", "record", "offset", "length")])
    values["offset"] = [1, 2, 3]
    index = tokenstore.Index.build(h, null, values)
    assert len(index.rest) == 2 and index.slots["offset"][index.find(h, null)].tolist() == [1, 2, 3]


def test_hash_is_that_of_spark(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 42, None]
    got = [r["h"] for r in spark.createDataFrame([(k,) for k in keys], "key long").select(tokenstore.key_hash(F.col("key")).alias("h")).collect()]
    assert [h % 2**64 for h in got] == [tokenstore.hash_of(k) for k in keys]


def test_bad_files_and_empty_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="index"):
        tokenstore.Index.load(b"something else" * 9)
    df = spark.createDataFrame([], "doc_id long, text string")
    store = tokenstore.write(df, str(tmp_path / "e"), PATH, 1)
    assert store.names == [] and store.get(1) is None and tokenstore.read(spark, store, df.select(F.col("doc_id").alias("key"))).count() == 0


def test_query_over_documents(spark, library):
    """The registered query over the whole small table."""
    out = {r["doc_id"]: r for r in queries.op12_token_store(spark, "/root/testdata/sf0.001").collect()}
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    at = 0
    for d in docs:
        ids = want(library, [d["text"]])[0]
        assert (out[d["doc_id"]]["start"], out[d["doc_id"]]["n_tokens"], out[d["doc_id"]]["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert len(out) == len(docs) and re.fullmatch(r".*tokens", common.fresh_path(spark, "tokens"))


def test_capitals_are_encoded_once(library):
    e = tokenstore.Encoder(PATH, 1, True)
    texts = ["Ab1 AB1, ÀB.c àb.C\nab1.", "", " \n", "İB1 ΑΣ. ẞB1!"]
    assert [x for t in e.encode(texts) for x in np.frombuffer(t, e.kind)] == [x for t in want(library, texts) for x in np.frombuffer(t, "<u4")]
    assert "ab1" in e.recent and not {"AB1", "AB1,", "ÀB.c", "àb.C"} & e.recent.keys()
    assert e.encode([]) == []


def test_capitals_spell_no_added_token(library):
    texts = ["A <|ENDOFTEXT|> B", "<|endoftext|> C", "X<|StartOfText|>"]
    e = tokenstore.Encoder(PATH, 1, True)
    assert [x for t in e.encode(texts) for x in np.frombuffer(t, e.kind)] == [x for t in want(library, texts) for x in np.frombuffer(t, "<u4")]
