import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vectrail.llm import bpe, sst
from vectrail.llm.tokens import Memo, encoder

LETTERS = "ab \n\t\x1c\x85\xa0é'sré日本 12!? \U0001F600aaaathe ing　ΣΑΣ İIK"


def samples():
    made = random.Random(2)
    return [t or "" for t in texts()] + ["".join(made.choice(LETTERS) for _ in range(made.randint(0, 60))) for _ in range(2000)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    own = encoder(P.path(name))
    for text, e in zip(samples(), whole.encode_batch(samples(), add_special_tokens=False), strict=True):
        assert own.encode(text) == np.array(e.ids, "<u4").tobytes()
    assert own.encode(None) == b""


def test_memo_is_bounded():
    memo = Memo(10)
    for i in range(100):
        memo.put(str(i), i)
        assert memo.get(str(i)) == i and len(memo.young) + len(memo.old) <= 20


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_backtracking_is_exact(tik, codec):
    for text in samples():
        ids = codec.encode(text)
        assert ids == tik.encode_ordinary(text) and codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes(tik, codec, data):
    assert codec.decode(codec.merge(data)) == data
    if data:
        assert codec.merge(data) == tik._encode_single_piece(data)


def test_columns(spark, tik):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs, *args), args[0]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == tik.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["v_print"] in ("x", None)  # other columns stay
    assert sorted(map(str, bpe.round_trip(docs, *args).select(*rows[0].__fields__).collect())) == sorted(map(str, rows))
    assert bpe.encode(docs.limit(0), *args).count() == 0
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), args[0]).first()["decoded"]) == b""
    odd = r"\w+|\W"  # a pattern whose matches say nothing about chunks
    assert bpe.codec(args[0], odd).encode("a-b, c") == [i for p in ("a", "-", "b", ",", " ", "c") for i in tik._encode_single_piece(p.encode())]


def test_shards(spark, tmp_path):
    docs, path = documents(spark), f"file://{tmp_path}/t"
    sst.write_table(docs, path, P.path("word_bpe_49k.json"), 1)
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    found = sst.read_table(spark, path).select("*", F.crc32("ids").alias("crc")).collect()
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in found] == [False] + [True] * (docs.count() - 1)
    assert [r["doc_id"] for r in found[1:]] == sorted(r["doc_id"] for r in docs.where("doc_id is not null").collect())
    at = 0
    wanted = {r["doc_id"]: np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in docs.collect()}
    for r in found:
        assert r["start"] == at and bytes(r["ids"]) == wanted[r["doc_id"]] and r["crc"] == zlib.crc32(wanted[r["doc_id"]])
        at += r["n_tokens"]
    assert len(sst.lookup(spark, path, [4]).collect()) == 3
    assert bytes(sst.lookup(spark, path, [8, 777]).first()["ids"]) == wanted[8]
    empty = f"file://{tmp_path}/e"
    sst.write_table(docs.limit(0), empty, P.path("word_bpe_49k.json"), 1)
    assert sst.read_table(spark, empty).count() == 0


def test_shard_file(tmp_path):
    made = random.Random(3)
    entries = sorted((sst.pack_key(made.randint(-1000, 1000)), bytes([n % 250]) * made.randint(0, 3000)) for n in range(3000))
    with open(tmp_path / "s", "wb") as f:
        writer = sst.ShardWriter(f, 2)
        for k, v in entries:
            writer.add(k, v)
        writer.finish()
    with open(tmp_path / "s", "rb") as f:
        reader = sst.ShardReader(f)
        assert list(reader) == entries and len(reader.blocks) > 20
        for key in range(-1005, 1006):
            assert reader.get(sst.pack_key(key)) == [v for k, v in entries if k == sst.pack_key(key)]
        assert reader.get(sst.pack_key(None)) == []
    damaged = bytearray((tmp_path / "s").read_bytes())
    damaged[10] ^= 1
    (tmp_path / "s").write_bytes(damaged)
    with open(tmp_path / "s", "rb") as f, pytest.raises(ValueError):
        list(sst.ShardReader(f))
