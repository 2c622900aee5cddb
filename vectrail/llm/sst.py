"""Token ids in sorted-string-table shards.

A shard holds entries in ascending key order: data blocks (keys prefix-compressed against their
predecessor, a restart point every few entries, zstd, CRC-32), a sparse index with each block's
first key, a Bloom filter over the keys, and a fixed-size footer. ``write_table`` range-partitions
documents by identifier and writes a shard for each partition; the manifest names the shards of the
attempts that Spark committed, so files of lost or repeated attempts are never read.

Results: a null or empty text has no ids but the end id. Very long texts are one entry, in a block of their own
size. Rows of equal doc_id are kept, ordered by a hash of their text and then by the text. A null doc_id sorts
before all others. An empty table gives no shards and reads back empty. Extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm.tokens import encoder
from vectrail.runtime import share_code

MAGIC = b"VTSSTBL1"
FOOTER = struct.Struct("<QQQQQIIQ8s")  # index at, length; Bloom at, length; bits; hashes; id bytes; entries; magic
BLOCK_BYTES, RESTART, BITS_PER_KEY, HASHES = 64 << 10, 16, 10, 7


def pack_key(doc_id: int | None) -> bytes:
    """Bytes that sort as doc_id does, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def unpack_key(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    step = h >> 32 | 1
    return [(h + i * step) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes one shard to a binary stream; keys must not descend."""

    def __init__(self, out, id_bytes: int):
        self.out, self.at, self.id_bytes = out, 0, id_bytes
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.hashes: list[bytes] = []
        self.entries = 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.first, self.last, self.count = bytearray(), [], None, b"", 0

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        if self.first is None:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.entries or key != self.last or not self.count:
            self.hashes.append(key)
        self.last = key
        self.count += 1
        self.entries += 1
        if len(self.block) >= BLOCK_BYTES:
            self._end()

    def _end(self) -> None:
        if self.count:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            stored = self.zstd.compress(body)
            at, n = self._write(stored)
            self.index.append((self.first, at, n, zlib.crc32(stored), self.count))
        self._begin()

    def finish(self) -> int:
        self._end()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIII", *rest) for k, *rest in self.index)
        bits = max(64, BITS_PER_KEY * len(self.hashes))
        bloom = np.zeros(bits, np.uint8)
        for key in self.hashes:
            bloom[_probes(key, bits)] = 1
        index_at, bloom_at = self._write(index), self._write(np.packbits(bloom).tobytes())
        self._write(FOOTER.pack(*index_at, *bloom_at, bits, HASHES, self.id_bytes, self.entries, MAGIC))
        return self.at


class ShardReader:
    """Reads a shard from a seekable binary stream: footer, index and filter first, blocks on demand."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        head = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        index_at, index_n, bloom_at, bloom_n, self.bits, _, self.id_bytes, self.entries, magic = head
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = self._read(bloom_at, bloom_n)
        self.blocks, data, at = [], self._read(index_at, index_n), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self.blocks.append((data[at : at + n], *struct.unpack_from("<QIII", data, at + n)))
            at += n + 20
        self.firsts = [b[0] for b in self.blocks]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, n, crc, _ = self.blocks[k]
        stored = self._read(at, n)
        if zlib.crc32(stored) != crc:
            raise ValueError(f"block {k} is damaged")
        body = zstandard.ZstdDecompressor().decompress(stored)
        (r,) = struct.unpack_from("<I", body, len(body) - 4)
        end = len(body) - 4 - 4 * r
        return body[:end], list(struct.unpack_from(f"<{r}I", body, end))

    @staticmethod
    def _entries(body: bytes, at: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < len(body):
            shared, at = _read_varint(body, at)
            own, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + own]
            at += own
            yield key, body[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._entries(self._block(k)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: Bloom filter, then binary search of the index and of restart points."""
        if not self.entries or not all(self.bloom[p >> 3] >> (7 - p % 8) & 1 for p in _probes(key, self.bits)):
            return []
        k = bisect_right(self.firsts, key) - 1
        while k > 0 and self.firsts[k] == key:  # equal keys may have begun in the block before
            k -= 1
        out: list[bytes] = []
        for k in range(max(k, 0), len(self.blocks)):
            if self.firsts[k] > key:
                break
            body, restarts = self._block(k)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart whose key is below the one sought
                mid = (low + high + 1) // 2
                if next(self._entries(body, restarts[mid]))[0] < key:
                    low = mid
                else:
                    high = mid - 1
            for found, value in self._entries(body, restarts[low]):
                if found > key:
                    break
                if found == key:
                    out.append(value)
        return out

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}")


def open_shard(path: str) -> ShardReader:
    system, at = fs.FileSystem.from_uri(path)
    return ShardReader(system.open_input_file(at))


MANIFEST = "part int, file string, first_id bigint, last_id bigint, docs bigint, ids bigint, bytes bigint"


def write_table(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text) and writes shards and a manifest under ``path`` (a folder all executors share)."""
    share_code(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        id_bytes = 2 if max(tokenizer.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
        part, writer, first, last, docs_n, ids_n = TaskContext.get().partitionId(), None, None, None, 0, 0
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), tokenizer.batch(batch.column(1)), strict=True):
                if writer is None:
                    system, folder = fs.FileSystem.from_uri(path)
                    system.create_dir(folder, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.sst"
                    out = system.open_output_stream(f"{folder}/{name}")
                    writer, first = ShardWriter(out, id_bytes), doc_id
                ids = np.append(np.frombuffer(found, "<u4"), np.uint32(end_id))
                writer.add(pack_key(doc_id), ids.astype(f"<u{id_bytes}").tobytes())
                last, docs_n, ids_n = doc_id, docs_n + 1, ids_n + len(ids)
        if writer is not None:
            size = writer.finish()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "first_id": first, "last_id": last, "docs": docs_n, "ids": ids_n, "bytes": size}],
                schema=pa.schema([("part", pa.int32()), ("file", pa.string()), *((n, pa.int64()) for n in ("first_id", "last_id", "docs", "ids", "bytes"))]),
            )

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text"))
    rows.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(write, MANIFEST).write.parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shard, with the number of ids in the shards before it (``start``)."""
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    share_code(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, rows, held = open_shard(f"{path}/{file}"), [], 0
                for key, value in shard:
                    ids = shard.ids(value)
                    rows.append((unpack_key(key), start, len(ids), ids.astype("<u4").tobytes()))
                    start, held = start + len(ids), held + 4 * len(ids)
                    if held > 8 << 20:
                        yield _ids_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _ids_batch(rows)

    shards = manifest(spark, path).select("file", "start")
    spread = shards.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _ids_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"]
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of the given documents (a short list), found by filter and binary search in the shards whose range holds them."""
    share_code(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(f"{path}/{row['file']}")
                found = [(d, 0, len(v) // shard.id_bytes, shard.ids(v).astype("<u4").tobytes()) for d in doc_ids for v in shard.get(pack_key(d))]
                if found:
                    yield _ids_batch(found)

    shards = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    near = [(F.col("last_id") >= d) & (F.coalesce(F.col("first_id"), F.lit(-(1 << 63))) <= d) for d in doc_ids]
    held = shards.where(F.exists(F.array(*near), lambda x: x) if near else F.lit(False))
    return held.mapInArrow(find, "doc_id bigint, start bigint, n_tokens bigint, ids binary").drop("start")
