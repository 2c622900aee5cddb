"""Session helpers shared by every operator: code shipping and shared scratch tables."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bounds of the Arrow batches that go to Python workers, where the session sets none: a batch of whole texts is then
#: as small as one of numbers.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from the driver's install path, and bounds what they get at a time.

    Workers on other hosts get the package by ``--py-files`` or an image as usual; the
    path entry is harmless there.
    """
    for key, most in BATCHES.items():
        if spark.conf.get(key, "1") == "1":  # not set
            spark.conf.set(key, most)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            root = held
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="vectrail-")
            spark.sparkContext.setCheckpointDir(root)
    at, system = _located(spark, root)
    full = system.makeQualified(at).toString().rstrip("/")  # the same place for Spark and for Python
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _located(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this process wrote to the shared folder; results that are not yet written anywhere else are lost."""
    while _SCRATCH:
        at, system = _located(spark, _SCRATCH.pop())
        system.delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    A lost executor then costs a reread, never a recomputation of everything above.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or that and underscores, so that no column has it (names do not differ by case)."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside carry ``tag``; the function that is given cancels them, from any thread."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)
