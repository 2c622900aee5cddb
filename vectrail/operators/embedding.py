"""Text to vector through providers that live in the Python workers."""

from __future__ import annotations

import atexit
import hashlib
import os
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import CancelledError
from threading import Event

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.text import task_prefix
from vectrail.runtime import share_code, unused

PURPOSES = ("document", "query")


class Provider(ABC):
    """Makes vectors; one instance serves one worker at a time and need not be thread-safe."""

    dimension: int

    @abstractmethod
    def embed(self, texts: list[str], purpose: str) -> np.ndarray:
        """A row for each text."""

    def close(self) -> None:
        """Releases what the provider holds."""


class HashProvider(Provider):
    """Deterministic vectors from MD5 digests: component i is the first 32 bits of md5(i:text), scaled to [-1, 1)."""

    def __init__(self, dimension: int = 16):
        self.dimension = dimension

    def embed(self, texts: list[str], purpose: str = "document") -> np.ndarray:
        out = [[int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:8], 16) / (1 << 31) - 1 for i in range(self.dimension)] for t in texts]
        return np.array(out, np.float64).reshape(len(texts), self.dimension)


def hash_embedding(text: Column, dimension: int = 16) -> Column:
    """``HashProvider`` as an expression."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), text)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 31)) - 1,
    )


class OnnxProvider(Provider):
    """A transformer in a local folder: prefix, tokenizer, model, masked mean, unit length.

    The folder holds ``model_int8.onnx`` and ``tokenizer.json``; a missing one is an error at construction.
    """

    def __init__(self, folder: str, dimension: int = 768, max_tokens: int = 8192, threads: int = 0):
        if not os.path.isdir(folder):
            raise FileNotFoundError(folder)
        self.paths = {n: os.path.join(folder, n) for n in ("model_int8.onnx", "tokenizer.json")}
        for path in self.paths.values():
            if not os.path.exists(path):
                raise FileNotFoundError(path)
        import onnxruntime
        from tokenizers import Tokenizer

        self.dimension = dimension
        self.tokenizer = Tokenizer.from_file(self.paths["tokenizer.json"])
        self.tokenizer.enable_truncation(max_tokens)
        options = onnxruntime.SessionOptions()
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
        if threads:
            options.intra_op_num_threads = threads
        self.session = onnxruntime.InferenceSession(self.paths["model_int8.onnx"], options)
        self.inputs = [i.name for i in self.session.get_inputs()]

    def embed(self, texts: list[str], purpose: str = "document") -> np.ndarray:
        prefix = "search_query: " if purpose == "query" else "search_document: "
        out = []
        for text in texts:  # one at a time: a quantized model need not give the same in a batch
            e = self.tokenizer.encode(prefix + text)
            given = {"input_ids": e.ids, "attention_mask": e.attention_mask, "token_type_ids": e.type_ids}
            hidden = self.session.run(None, {n: np.array([given[n]], np.int64) for n in self.inputs})[0][0]
            out.append(unit_mean(hidden, np.array(e.attention_mask)))
        return np.array(out).reshape(len(texts), self.dimension)


def unit_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the rows with mask 1, scaled to length 1 unless it is 0; an error if there are none."""
    if not (mask == 1).any():
        raise ValueError("no token to pool")
    mean = hidden[mask == 1].astype(np.float64).mean(axis=0)
    norm = np.sqrt(mean @ mean)
    return mean / norm if norm > 0 else mean


#: The providers of this Python worker, by service: the last ``WORKER_PROVIDERS`` that were asked for stay loaded.
_PROVIDERS: dict[str, Provider] = {}
WORKER_PROVIDERS = 2


def worker_provider(service: str, factory: Callable[[], Provider]) -> Provider:
    """The provider of a service in this process; tasks that follow each other in a worker share it."""
    found = _PROVIDERS.pop(service, None) or factory()
    _PROVIDERS[service] = found  # last
    while len(_PROVIDERS) > WORKER_PROVIDERS:
        _PROVIDERS.pop(next(iter(_PROVIDERS))).close()
    return found


@atexit.register
def close_providers() -> None:
    """Closes what this process still holds."""
    while _PROVIDERS:
        _PROVIDERS.popitem()[1].close()


class EmbeddingService:
    """Embeds columns with a provider from ``factory``, built once in each Python worker, whatever the number of its tasks.

    ``concurrency`` is the number of partitions that embed at a time (None: as the table comes). ``batch`` texts go to a
    provider at once and ``capacity``, if set, bounds those that wait for it in a worker; a slow provider holds back its
    input, since batches are pulled. In ``permissive`` mode a text that fails gives null and its message in ``error``.
    """

    def __init__(self, factory: Callable[[], Provider], concurrency: int | None = None, batch: int = 256, permissive: bool = False, capacity: int | None = None):
        for name, value in (("concurrency", concurrency), ("batch", batch), ("capacity", capacity)):
            if value is not None and value < 1:
                raise ValueError(f"{name} must be at least 1")
        self.factory, self.concurrency, self.permissive, self.closed = factory, concurrency, permissive, False
        self.batch, self.name, self._size = min(batch, capacity or batch), uuid.uuid4().hex, None

    def __enter__(self) -> EmbeddingService:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.closed = True

    def _check(self, purpose: str) -> None:
        if self.closed:
            raise RuntimeError("the service is closed")
        if purpose not in PURPOSES:
            raise ValueError(f"purpose must be one of {PURPOSES}")

    @property
    def dimension(self) -> int:
        """The length of the vectors, asked once of a provider."""
        if self._size is None:
            provider = self.factory()
            self._size = provider.dimension
            provider.close()
        return self._size

    def embed_text(self, text: str, purpose: str = "document", cancelled: Event | None = None) -> np.ndarray:
        """One text, here on the driver; not begun once ``cancelled`` is set. Jobs are cancelled by ``runtime.cancellable``."""
        self._check(purpose)
        if text is None:
            raise ValueError("a text is needed")
        if cancelled is not None and cancelled.is_set():
            raise CancelledError
        provider = self.factory()
        try:
            return provider.embed([text], purpose)[0]
        finally:
            provider.close()

    def embed(self, docs: DataFrame, text: str = "text", purpose: str = "document", output: str = "embedding") -> DataFrame:
        """``docs`` with the vectors of a text column; null texts have null vectors."""
        self._check(purpose)
        share_code(docs.sparkSession)
        rows = docs.repartition(self.concurrency) if self.concurrency else docs
        held = unused("v_text", rows.columns)
        rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != output], F.col(f"`{text}`").alias(held))
        factory, size, permissive, name = self.factory, self.batch, self.permissive, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from vectrail.operators import embedding  # the worker's own module, not a copy that came with the function

            provider = embedding.worker_provider(name, factory)
            for whole in batches:
                for low in range(0, whole.num_rows, size):
                    batch = whole.slice(low, size)
                    n = batch.num_columns - 1
                    texts = batch.column(n).to_pylist()
                    found, errors = _embedded(provider, texts, purpose, permissive)
                    columns = [*batch.columns[:n], pa.array(found, pa.list_(pa.float32()))]
                    names = [*batch.schema.names[:n], output]
                    if permissive:
                        columns, names = [*columns, pa.array(errors, pa.string())], [*names, "error"]
                    yield pa.RecordBatch.from_arrays(columns, names)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != held)
        return rows.mapInArrow(run, f"{schema}, `{output}` array<float>" + (", error string" if permissive else ""))


def _embedded(provider: Provider, texts: list, purpose: str, permissive: bool) -> tuple[list, list]:
    there = [i for i, t in enumerate(texts) if t is not None]
    found: list = [None] * len(texts)
    errors: list = [None] * len(texts)
    if not permissive:
        for i, v in zip(there, provider.embed([texts[i] for i in there], purpose) if there else [], strict=True):
            found[i] = v.astype(np.float32)
        return found, errors
    for i in there:
        try:
            found[i] = provider.embed([texts[i]], purpose)[0].astype(np.float32)
        except Exception as e:  # one text's failure is that text's alone
            errors[i] = f"{type(e).__name__}: {e}"
    return found, errors


def prefixed(docs: DataFrame, purpose: str, text: str = "text") -> DataFrame:
    """``docs`` with the purpose's prefix before the text."""
    return docs.withColumn(text, task_prefix(F.col(f"`{text}`"), purpose))
