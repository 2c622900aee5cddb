"""Streaming ingest: documents are chunked and embedded as they come and appended to a store on disk."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.functions.text import ChunkOptions
from vectrail.operators.chunking import chunk
from vectrail.operators.embedding import EmbeddingService
from vectrail.operators.store import DiskStore


def ingest(docs: DataFrame, store: DiskStore, service: EmbeddingService, options: ChunkOptions, checkpoint: str, key_bits: int = 20) -> StreamingQuery:
    """Starts a query over a stream of (doc_id, text): a chunk's id is doc_id and chunk_index packed together.

    A document that comes again replaces its chunks. A batch that is replayed after a failure writes what it wrote, under
    the same name, so nothing is added twice. ``checkpoint`` names the stream: one for each store and source.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        rows = chunk(batch, options).withColumn("id", F.shiftleft("doc_id", key_bits) + F.col("chunk_index"))
        vectors = service.embed(rows, "chunk", output="values").select("id", "values")
        store.replace(vectors, F.shiftright("id", key_bits), batch.select("doc_id"), f"{stream}-{number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
