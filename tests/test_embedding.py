import os
import shutil
import threading
from concurrent.futures import CancelledError

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions.text import ChunkOptions
from vectrail.operators import embedding as E
from vectrail.operators.embedding import EmbeddingService, HashProvider, OnnxProvider, Provider, hash_embedding, unit_mean
from vectrail.operators.store import DiskStore
from vectrail.streaming.ingest import ingest


class Picky(Provider):
    dimension = 4

    def embed(self, texts, purpose):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return HashProvider(4).embed(texts, purpose)


def test_columns_and_driver_agree(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(99, None)], "id int, text string")
    service = EmbeddingService(lambda: HashProvider(8), concurrency=3, batch=4)
    found = {r["id"]: r["embedding"] for r in service.embed(docs).collect()}
    for i in range(20):
        assert np.allclose(found[i], service.embed_text(f"text {i}"), atol=1e-6)
    assert found[99] is None
    native = docs.where("id = 3").select(hash_embedding(F.col("text"), 8)).first()[0]
    assert np.allclose(native, found[3], atol=1e-6)
    assert service.embed(docs.limit(0)).count() == 0


def test_errors(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string")
    with pytest.raises(Exception, match="no"):
        EmbeddingService(Picky).embed(docs).collect()
    found = {r["id"]: (r["embedding"] is None, r["error"]) for r in EmbeddingService(Picky, permissive=True).embed(docs).collect()}
    assert found == {1: (False, None), 2: (True, "ValueError: no")}
    for bad in (dict(concurrency=0), dict(batch=0)):
        with pytest.raises(ValueError):
            EmbeddingService(Picky, **bad)
    with EmbeddingService(Picky) as service:
        pass
    with pytest.raises(RuntimeError):
        service.embed_text("x")
    with pytest.raises(ValueError):
        EmbeddingService(Picky).embed_text("x", "other")


def test_pooling():
    assert np.allclose(unit_mean(np.array([[3.0, 0.0], [3.0, 8.0], [100.0, 1.0]]), np.array([1, 1, 0])), [0.6, 0.8])
    with pytest.raises(ValueError):
        unit_mean(np.ones((2, 2)), np.zeros(2))


def test_model_files_are_needed(tmp_path):
    for folder in (tmp_path / "none", tmp_path):
        with pytest.raises(FileNotFoundError):
            OnnxProvider(str(folder))


def message(*fields):
    """A protobuf message of (number, value): integers, strings, or bytes of what is inside."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def model_folder(folder, table):
    """A model of one node, which looks token ids up in a table, and a tokenizer of three words."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    def value(name, kind, *dims):
        shape = message(*[(1, message((2, d) if isinstance(d, str) else (1, d))) for d in dims])
        return message((1, name), (2, message((1, message((1, kind), (2, shape))))))

    weights = message((1, table.shape[0]), (1, table.shape[1]), (2, 1), (8, "table"), (9, table.astype("<f4").tobytes()))
    node = message((1, "table"), (1, "input_ids"), (2, "hidden"), (4, "Gather"))
    graph = message((1, node), (2, "g"), (5, weights), (11, value("input_ids", 7, 1, "n")), (12, value("hidden", 1, 1, "n", table.shape[1])))
    (folder / "model_int8.onnx").write_bytes(message((1, 8), (7, graph), (8, message((1, ""), (2, 13)))))
    words = Tokenizer(models.WordLevel({"[UNK]": 0, "hello": 1, "world": 2}, "[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(folder / "tokenizer.json"))


def test_tokens_model_and_pooling(tmp_path):
    table = np.array([[0.0, 0.0], [3.0, 0.0], [0.0, 4.0]])
    model_folder(tmp_path, table)
    provider = OnnxProvider(str(tmp_path), dimension=2, max_tokens=6, threads=1)
    # The prefix is three unknown tokens here (its two words and the mark); what follows is looked up.
    assert np.allclose(provider.embed(["hello world", "hello"], "query"), [[0.6, 0.8], [1.0, 0.0]])
    n = len(provider.tokenizer.encode("search_document: " + "hello " * 20).ids)
    assert n == 6  # cut


def test_options(spark):
    service = EmbeddingService(lambda: HashProvider(5), batch=8, capacity=3)
    assert service.dimension == 5 and service.batch == 3
    stop = threading.Event()
    assert len(service.embed_text("x", cancelled=stop)) == 5
    stop.set()
    with pytest.raises(CancelledError):
        service.embed_text("x", cancelled=stop)
    with pytest.raises(ValueError):
        EmbeddingService(Picky, capacity=0)


class Counted(HashProvider):
    """The first component is how many of its kind this process has built."""

    built = 0

    def __init__(self):
        super().__init__(2)
        type(self).built += 1

    def embed(self, texts, purpose="document"):
        return np.array([[type(self).built, os.getpid()]] * len(texts), float)


def test_one_provider_for_each_worker(spark):
    docs = spark.range(64, numPartitions=16).select("id", F.lit("x").alias("text"))
    found = EmbeddingService(Counted).embed(docs).collect()
    assert {r["embedding"][0] for r in found} == {1.0}


def test_the_last_providers_stay():
    closed = []

    class Closing(HashProvider):
        def close(self):
            closed.append(self)

    made = [E.worker_provider(name, Closing) for name in "abac"]
    assert made[0] is made[2] and closed == [made[1]]
    E.close_providers()
    assert len(closed) == 3


def test_replayed_and_changed_documents(spark, tmp_path):
    store = DiskStore(spark, "s", f"file://{tmp_path}/store", 4)
    service, options = EmbeddingService(lambda: HashProvider(4)), ChunkOptions(2, "plain", "plain")

    def run(number):
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"file://{tmp_path}/in")
        ingest(stream, store, service, options, f"file://{tmp_path}/ck{number}").awaitTermination()
        return sorted(r["id"] for r in store.rows.collect())

    def write(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    write([(1, "one. two. three. four. five. "), (2, "four. ")])
    one = 1 << 20
    assert run(1) == [one, one + 1, one + 2, 2 << 20]
    shutil.rmtree(tmp_path / "ck1" / "commits")  # as if the stream had died before it noted the batch
    assert run(1) == [one, one + 1, one + 2, 2 << 20]
    write([(1, "new. ")])
    assert run(1) == [one, 2 << 20]
    assert np.allclose(store.rows.where(f"id = {one}").first()["values"], HashProvider(4).embed(["new. "])[0], atol=1e-6)


def test_streaming_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one. two. three. "), (2, "four. ")], "doc_id bigint, text string")
    docs.write.parquet(f"file://{tmp_path}/in")
    store = DiskStore(spark, "s", f"file://{tmp_path}/store", 4)
    stream = spark.readStream.schema(docs.schema).parquet(f"file://{tmp_path}/in")
    query = ingest(stream, store, EmbeddingService(lambda: HashProvider(4)), ChunkOptions(2, "plain", "plain"), f"file://{tmp_path}/ck")
    query.awaitTermination()
    assert sorted(r["id"] for r in store.rows.collect()) == [1 << 20, (1 << 20) + 1, 2 << 20]
