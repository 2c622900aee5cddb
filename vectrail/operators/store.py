"""Vector stores over DataFrames: immutable snapshots in memory, versioned Parquet on disk.

Rows are (id, values, magnitude, seq). ``seq`` is the order of insertion. Lengths are checked and magnitudes
computed when rows are added. Equal ids may repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.operators import search as S

ROWS = "id {key}, values array<float>, magnitude float, seq bigint"


def prepared(rows: DataFrame, dimension: int, first: int = 0) -> DataFrame:
    """``rows`` (id, values, order) as rows of a store; another length than ``dimension``, or null, is an error."""
    order = F.col("order") if "order" in rows.columns else F.monotonically_increasing_id()
    fine = F.coalesce(F.size("values") == dimension, F.lit(False))
    values = F.when(fine, F.col("values")).otherwise(F.raise_error(F.lit(f"a vector does not have {dimension} dimensions")).cast("array<float>"))
    return rows.select("id", values.cast("array<float>").alias("values"), V.magnitude(values).cast("float").alias("magnitude"), (order + F.lit(first)).cast("long").alias("seq"))


class VectorStore:
    """A named snapshot in memory; every change gives a new one."""

    def __init__(self, name: str, dimension: int, rows: DataFrame):
        if name is None:
            raise ValueError("a name is needed")
        if dimension <= 0:
            raise ValueError("dimension must be above 0")
        self.name, self.dimension, self.rows = name, dimension, rows

    @classmethod
    def create(cls, spark: SparkSession, name: str, dimension: int, key: str = "bigint") -> VectorStore:
        """An empty store."""
        return cls(name, dimension, spark.createDataFrame([], ROWS.format(key=key)))

    @classmethod
    def of(cls, name: str, dimension: int, rows: DataFrame) -> VectorStore:
        """A store of ``rows`` (id, values, and order, if that matters)."""
        return cls(name, dimension, prepared(rows, dimension))

    def _next(self) -> int:
        last = self.rows.agg(F.max("seq")).first()[0]
        return 0 if last is None else last + 1

    def add(self, rows: DataFrame) -> VectorStore:
        """Appends; ids may repeat."""
        return VectorStore(self.name, self.dimension, self.rows.unionByName(prepared(rows, self.dimension, self._next())))

    def _without(self, gone: DataFrame) -> VectorStore:
        """Without one row of each (id, seq) of ``gone``: callers may repeat an order, and then the others stay."""
        named = gone.select(F.col("id").alias("g_id"), F.col("seq").alias("g_seq"))
        same = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("seq") == F.col("g_seq"))
        nth = F.row_number().over(Window.partitionBy("id", "seq").orderBy("magnitude", "values"))
        tied = self.rows.join(named, same, "left_semi").withColumn("nth", nth).where("nth > 1").drop("nth")
        return VectorStore(self.name, self.dimension, self.rows.join(named, same, "left_anti").unionByName(tied))

    def remove(self, key) -> tuple[VectorStore, bool]:
        """Without the first row of a key, and whether there was one."""
        first = self.rows.where(F.col("id") == F.lit(key)).groupBy("id").agg(F.min("seq").alias("seq"))
        found = first.collect()  # one row at most
        return (self._without(self.rows.sparkSession.createDataFrame(found, first.schema)), True) if found else (self, False)

    def remove_first(self, keys: DataFrame) -> VectorStore:
        """Without the first row of each of many keys (a table of ids); only listed rows are looked at for it, without their vectors."""
        named = keys.select(F.col(keys.columns[0]).alias("id")).distinct()
        return self._without(self.rows.select("id", "seq").join(named, "id", "left_semi").groupBy("id").agg(F.min("seq").alias("seq")))

    def count(self) -> int:
        return self.rows.count()

    def search(self, query: Sequence[float], k: int, allow: Column | DataFrame | Callable | None = None) -> DataFrame:
        """The k most similar rows: id, score."""
        return S.top_k(self.rows, query, k, self.dimension, allow)

    def persist(self) -> VectorStore:
        self.rows.persist()
        return self

    def close(self) -> None:
        """Releases what ``persist`` holds."""
        self.rows.unpersist()

    def save(self, path: str, key: str, single: bool = False) -> None:
        """Writes the rows in order in the binary format: a file of each partition, or one file."""
        ordered = self.rows.orderBy("seq").select("id", "values", "magnitude")
        options = {"keyType": key, "dimension": str(self.dimension)}
        if single:
            ordered, options = ordered.coalesce(1), options | {"records": str(self.rows.count())}
        ordered.write.format("vectorfile").options(**options).mode("append").save(path)

    @classmethod
    def load(cls, spark: SparkSession, name: str, dimension: int, path: str, key: str) -> VectorStore:
        """The rows of binary files that are not deleted; magnitudes are taken as they stand."""
        rows = spark.read.format("vectorfile").options(keyType=key, dimension=str(dimension)).load(path)
        return cls(name, dimension, rows.where("status <> 1").select("id", "values", "magnitude", "seq"))


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows without a later tombstone of their id."""
    last = tombstones.groupBy("id").agg(F.max("seq").alias("gone"))
    return rows.join(last, "id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("seq"))).drop("gone")


class DiskStore:
    """A store in a folder: Parquet rows and tombstones of the current version, named by marker files.

    A removal hides all rows of a key that were there; rows added later are seen. ``compact`` writes the rows that
    are left as a new version and then names it; the old one stays until ``vacuum``. The dimension is stored, so an empty
    store has one too. Rows and tombstones stand in a folder for each addition; one that is named replaces what a first
    attempt under that name has left.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, dimension: int, key: str = "bigint"):
        if name is None or path is None:
            raise ValueError("a name and a path are needed")
        if dimension <= 0:
            raise ValueError("dimension must be above 0")
        self.spark, self.name, self.path, self.dimension, self.key = spark, name, path.rstrip("/"), dimension, key
        found = self._versions()
        if not found:
            self._write_empty(0)
            self._mark(0)
            found = [0]
        self.version = found[-1]
        stored = self._dimension()
        if stored != dimension:
            raise ValueError(f"the store has {stored} dimensions, not {dimension}")
        if self._read("rows").schema["id"].dataType.simpleString() != key:
            raise ValueError("the store's keys are of another type")

    def _dimension(self) -> int:
        """The stored dimension: the name of a marker file."""
        at, fs = self._fs(f"{self.path}/_dimension")
        if not fs.exists(at):
            fs.create(self._fs(f"{self.path}/_dimension/{self.dimension}")[0], False).close()
        return int(fs.listStatus(at)[0].getPath().getName())

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/_versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def _mark(self, version: int) -> None:
        at, fs = self._fs(f"{self.path}/_versions/{version:08d}")
        fs.create(at, False).close()

    def _folder(self, what: str, version: int | None = None) -> str:
        return f"{self.path}/v{self.version if version is None else version:08d}/{what}"

    def _write_empty(self, version: int) -> None:
        for what, schema in (("rows", ROWS.format(key=self.key)), ("tombstones", f"id {self.key}, seq bigint")):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self._folder(what, version)}/batch=start")

    def _write(self, what: str, df: DataFrame, batch: str | None = None) -> None:
        df.write.mode("overwrite").parquet(f"{self._folder(what)}/batch=b-{batch or uuid.uuid4().hex}")

    def _read(self, what: str, but: str | None = None) -> DataFrame:
        held = self.spark.read.parquet(self._folder(what))
        return (held.where(F.col("batch") != f"b-{but}") if but else held).drop("batch")

    @property
    def rows(self) -> DataFrame:
        """The live rows."""
        return live(self._read("rows"), self._read("tombstones"))

    def _next(self) -> int:
        both = self._read("rows").select("seq").unionByName(self._read("tombstones").select("seq"))
        last = both.agg(F.max("seq")).first()[0]
        return 0 if last is None else last + 1

    def add(self, rows: DataFrame, batch: str | None = None) -> None:
        """Appends; under the name of a ``batch``, only once however often it is repeated."""
        self._write("rows", prepared(rows, self.dimension, self._next()), batch)

    def remove(self, key) -> bool:
        if self.rows.where(F.col("id") == F.lit(key)).limit(1).count() == 0:
            return False
        self._write("tombstones", self.spark.createDataFrame([(key, self._next())], f"id {self.key}, seq bigint"))
        return True

    def replace(self, rows: DataFrame, old: Column, owners: DataFrame, batch: str) -> None:
        """Adds ``rows`` and removes the live rows whose ``old`` (an expression of id) is in ``owners``. May be repeated under its name."""
        first = self._next()
        named = owners.select(F.col(owners.columns[0]).alias("owner")).distinct()
        held = live(self._read("rows", batch), self._read("tombstones", batch)).select("id")
        gone = held.withColumn("owner", old).join(named, "owner", "left_semi").select("id", F.lit(first).cast("long").alias("seq")).distinct()
        self._write("tombstones", gone, batch)
        self._write("rows", prepared(rows, self.dimension, first + 1), batch)

    def count(self) -> int:
        return self.rows.count()

    def search(self, query: Sequence[float], k: int, allow: Column | DataFrame | Callable | None = None) -> DataFrame:
        return S.top_k(self.rows, query, k, self.dimension, allow)

    def compact(self) -> bool:
        """Drops what tombstones hide; False if there are none."""
        if self._read("tombstones").limit(1).count() == 0:
            return False
        version = self.version + 1
        self._write_empty(version)
        self.rows.write.mode("overwrite").parquet(f"{self._folder('rows', version)}/batch=compacted")
        self._mark(version)
        self.version = version
        return True

    def vacuum(self) -> None:
        """Deletes versions before the current one."""
        for v in self._versions():
            if v < self.version:
                for old in (f"{self.path}/v{v:08d}", f"{self.path}/_versions/{v:08d}"):
                    at, fs = self._fs(old)
                    fs.delete(at, True)
