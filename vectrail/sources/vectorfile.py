"""A data source for fixed-width binary vector files.

Little-endian. Header of 20 bytes: magic, version, dimension, key bytes, records, 4 zero bytes. Records: status (1:
deleted), key, magnitude, values. Record i stands at a known place, so files split by ranges of records.

A folder that this source wrote has manifests, each written when a job commits: only the files that they name are read,
so what lost, repeated or unfinished tasks leave is never seen. In a folder without any, every file is read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format.
MAGIC, VERSION, MOST_KEY = 0x5653, 1, 1024
HEADER = struct.Struct("<HHiii4x")
KEYS = {"int": ("<i4", 4, pa.int32()), "bigint": ("<i8", 8, pa.int64()), "guid": ("V16", 16, pa.string())}
#: Records of a split; bytes of a file that is written, about; the folder of manifests.
SPLIT, FILE_BYTES, MANIFESTS = 200_000, 64 << 20, "_manifests"


def _manifests(system: fs.FileSystem, folder: str) -> list[str] | None:
    """Paths of a folder's manifests, oldest first; None if it never had any."""
    at = f"{folder}/{MANIFESTS}"
    if system.get_file_info(at).type != fs.FileType.Directory:
        return None
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".json"))


def files_of(system: fs.FileSystem, folder: str) -> list[str]:
    """The files of a folder, in order: those that its manifests name, or all of them."""
    manifests = _manifests(system, folder)
    if manifests is None:
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    names: list[str] = []
    for path in manifests:
        with system.open_input_file(path) as f:
            stated = json.loads(f.read())
        names = stated["files"] if stated["replaces"] else names + stated["files"]
    return [f"{folder}/{n}" for n in names]


def record_size(key_bytes: int, dimension: int) -> int:
    return 1 + key_bytes + 4 + 4 * dimension


def pack_header(dimension: int, key_bytes: int, records: int) -> bytes:
    return HEADER.pack(MAGIC, VERSION, dimension, key_bytes, records)


def unpack_header(data: bytes) -> tuple[int, int, int]:
    """(dimension, key bytes, records); an error if the header is short or holds bad values."""
    if len(data) < HEADER.size:
        raise ValueError("the file is too short for a header")
    magic, version, dimension, key_bytes, records = HEADER.unpack(data[: HEADER.size])
    if magic != MAGIC:
        raise ValueError("not a vector file")
    if version > VERSION:
        raise ValueError(f"version {version} is not known")
    if dimension <= 0 or not 0 < key_bytes <= MOST_KEY or records < 0:
        raise ValueError("the header holds bad values")
    return dimension, key_bytes, records


def record_type(key: str, dimension: int) -> np.dtype:
    return np.dtype([("status", "u1"), ("key", KEYS[key][0]), ("magnitude", "<f4"), ("values", "<f4", (dimension,))])


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    dimension: int
    before: int = 0


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key = options["path"], options.get("keytype", "bigint")
        self.dimension = int(options.get("dimension", 0))
        self.split = int(options.get("recordspersplit", SPLIT))

    def partitions(self) -> list[Range]:
        system, at = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out, before = [], 0
        for path in [at] if info.type == fs.FileType.File else files_of(system, at):
            with system.open_input_file(path) as f:
                dimension, key_bytes, records = unpack_header(f.read(HEADER.size))
            if self.dimension and dimension != self.dimension:
                raise ValueError(f"the file has {dimension} dimensions, not {self.dimension}")
            if key_bytes != KEYS[self.key][1]:
                raise ValueError(f"the file's keys have {key_bytes} bytes")
            out += [Range(path, low, min(self.split, records - low), dimension, before) for low in range(0, records, self.split)]
            before += records
        return out or [Range("", 0, 0, 1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        kind = record_type(self.key, part.dimension)
        with system.open_input_file(part.path) as f:
            f.seek(HEADER.size + part.first * kind.itemsize)
            for low in range(0, part.count, 8192):
                n = min(8192, part.count - low)
                data = f.read(n * kind.itemsize)
                if len(data) < n * kind.itemsize:
                    raise ValueError("the file ends within its records")
                rows = np.frombuffer(data, kind)
                keys = [str(uuid.UUID(bytes_le=bytes(k))) for k in rows["key"]] if self.key == "guid" else np.ascontiguousarray(rows["key"])
                values = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * part.dimension, np.ascontiguousarray(rows["values"]).ravel())
                seq = np.arange(part.first + low, part.first + low + n) + part.before
                columns = [pa.array(keys, KEYS[self.key][2]), values, pa.array(np.ascontiguousarray(rows["magnitude"])), pa.array(rows["status"].astype(np.int32)), pa.array(seq)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "values", "magnitude", "status", "seq"])


class Writer(DataSourceArrowWriter):
    """Files of bounded size from each partition; a manifest, written last, names those of the tasks that committed.

    With the option ``records`` a partition is one file of that many records, written as they come.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.key, self.dimension = options["path"], options.get("keytype", "bigint"), int(options["dimension"])
        self.records = int(options["records"]) if "records" in options else None
        self.overwrite = overwrite

    def _records(self, batch: pa.RecordBatch) -> bytes:
        rows = np.zeros(batch.num_rows, record_type(self.key, self.dimension))
        ids = batch.column("id")
        if self.key == "guid":
            rows["key"] = np.array([np.void(uuid.UUID(k).bytes_le) for k in ids.to_pylist()], "V16")
        else:
            rows["key"] = ids.to_numpy(zero_copy_only=False)
        rows["magnitude"] = batch.column("magnitude").to_numpy(zero_copy_only=False)
        if batch.num_rows:
            rows["values"] = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.dimension)
        return rows.tobytes()

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
        size, part = record_size(KEYS[self.key][1], self.dimension), TaskContext.get().partitionId()
        names: list[str] = []

        def head(records: int) -> bytes:
            return pack_header(self.dimension, KEYS[self.key][1], records)

        def opened():
            names.append(f"part-{part:06d}-{len(names):06d}-{uuid.uuid4().hex}.vec")
            return system.open_output_stream(f"{folder}/{names[-1]}")

        if self.records is not None:
            written = 0
            with opened() as f:
                f.write(head(self.records))
                for batch in batches:
                    f.write(self._records(batch))
                    written += batch.num_rows
            if written != self.records:
                raise ValueError(f"{written} records came, not {self.records}")
            return Written(names)
        body, held = [], 0

        def close() -> None:
            with opened() as f:
                f.write(head(held // size))
                for data in body:
                    f.write(data)

        for batch in batches:
            body.append(self._records(batch))
            held += len(body[-1])
            if held >= FILE_BYTES:
                close()
                body, held = [], 0
        if held:
            close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
        older = _manifests(system, folder)
        stale = files_of(system, folder) if self.overwrite else []
        name = f"{folder}/{MANIFESTS}/{len(older) + 1:08d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps({"replaces": self.overwrite, "files": [n for m in messages if m for n in m.names]}).encode())
        system.move(f"{name}.tmp", f"{name}.json")
        for path in stale:
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for n in (n for m in messages if m for n in m.names):
            system.delete_file(f"{folder}/{n}")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        key = self.options.get("keytype", self.options.get("keyType", "bigint"))
        return f"id {'string' if key == 'guid' else key}, values array<float>, magnitude float, status int, seq bigint"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self._options(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("vectorfile")`` known to the session."""
    from vectrail.runtime import share_code

    share_code(spark)
    spark.dataSource.register(VectorFile)
