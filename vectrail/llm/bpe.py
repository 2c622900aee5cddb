"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

A piece's bytes are read as Latin-1, so that pyahocorasick finds in one pass the longest token that
starts at each byte. The encoder takes the longest token that is compatible with the one before it;
two adjacent tokens are compatible if merging never joins across their border, which a walk down
their merge trees decides and a memo keeps. Where no token fits it steps back and tries the
next shorter prefix; a position that led nowhere is marked and never entered again. The outcome is
exactly that of the merges in rank order, in time linear in the piece.

Results: a null text encodes as an empty text, which has no ids; null ids decode to an empty binary.
Very long texts are encoded whole, one at a time. Rows are encoded each, so repeated rows give repeated
results; there are no ties. An empty table gives no rows. Extra columns are kept; an input column named as an
output is replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.tokens import Chunks, class_of_white, packed, slices
from vectrail.runtime import share_code, unused

#: Pairs of tokens that a worker remembers; emptied when full.
PAIRS = 250_000
#: Ids that are decoded at a time (those of one row at least).
DECODED = 1 << 20

_TABLES: dict[str, pa.Array] = {}
_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encodes and decodes by a file of ranks and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.size = [len(t) for t in self.bytes]
        self.split = regex.compile(class_of_white(pattern)).findall
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()
        self.shorter = [-1] * len(self.bytes)
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (r := ranks.get(token[:n])) is not None:
                    self.shorter[rank] = r
                    break
        self.memo: dict[int, bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts = [(i, i) for i in range(len(self.bytes))]
        for rank in sorted(ranks.values()):
            token, left = self.bytes[rank], self.shorter[rank]
            while left >= 0:
                right = ranks.get(token[self.size[left] :])
                if right is not None and left < rank and right < rank and self._apart(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
                left = self.shorter[left]
        self.memo.clear()
        #: Whether the pattern takes letters with a blank before them, and marks, as one piece each and never spans a
        #: border of non-space and white space; else texts are split whole.
        self.chunked = r"| ?\p{L}+|" in pattern and r"| ?[^\s\p{L}\p{N}]+|" in pattern
        self.chunks = Chunks(lambda word: self._ids(" " + word), self.split, self._ids)

    def _apart(self, a: int, b: int) -> bool:
        """Whether merges keep the border between tokens a and b.

        Walking back through the merges that made them, the younger one first, no pair
        across the border may have been merged before that step.
        """
        limit = 1 << 62
        merged, parts = self.merged, self.parts
        while True:
            joined = merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, inner = a, parts[a][1]
                if inner != a:
                    a = inner
                    continue
                limit, inner = b + 1, parts[b][0]
                if inner == b:
                    return True
                b = inner
            else:
                limit, inner = b + 1, parts[b][0]
                if inner != b:
                    b = inner
                    continue
                limit, inner = a, parts[a][1]
                if inner == a:
                    return True
                a = inner

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[key] = self._apart(a, b)
        return known

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        longest = [-1] * len(piece)
        size = self.size
        for end, rank in self.find.iter(piece.decode("latin-1")):
            longest[end - size[rank] + 1] = rank  # ends ascend: the longest comes last
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0] if piece else -1
        while at < len(piece):
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            else:
                if not out:
                    raise ValueError("bytes outside the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def _ids(self, piece: str) -> bytes:
        return array("i", self.merge(piece.encode())).tobytes()

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids as 32-bit integers."""
        if self.chunked:
            yield from packed(self.chunks, texts)
        else:
            for t in texts:
                yield b"".join(map(self._ids, self.split(t.as_py() or "")))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(next(self.batch(pa.array([text], pa.string()))), np.int32).tolist()

    def decode(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _table(path: str) -> pa.Array:
    """Each id's bytes."""
    if path not in _TABLES:
        with open(path, "rb") as f:
            ranks = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
        table = [b""] * (max(r for r, _ in ranks) + 1)
        for rank, token in ranks:
            table[rank] = token
        _TABLES[path] = pa.array(table, pa.large_binary())
    return _TABLES[path]


def _mapped(df: DataFrame, source: str, targets: dict[str, str], make: Callable[[], Callable[[pa.Array], Iterator[tuple[pa.Array, ...]]]]) -> DataFrame:
    """``df`` with columns made from another by ``make()``, a function from a batch's column to the new ones, run by run, built once in each task."""
    share_code(df.sparkSession)
    held = unused("v_source", [*df.columns, *targets])
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in targets], F.col(f"`{source}`").alias(held))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != held), *(f"`{n}` {kind}" for n, kind in targets.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            n, low = batch.num_columns - 1, 0
            for parts in columns(batch.column(n)):
                rows = batch.slice(low, len(parts[0]))
                yield pa.RecordBatch.from_arrays([*rows.columns[:n], *parts], [*batch.schema.names[:n], *targets])
                low += len(parts[0])

    return plain.mapInArrow(run, schema)


def _ids_of(batch: Callable[[pa.Array], Iterator[bytes]], texts: pa.Array) -> Iterator[pa.Array]:
    for part in slices(texts.cast(pa.large_string())):
        found = list(batch(part))
        ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
        yield pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), np.int32)))


def _bytes_of(table: pa.Array, lists: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.binary_length(table).to_numpy()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    borders = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    flat, low = lists.flatten(), 0
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(borders, borders[low] + DECODED, "right")) - 1)
        own = flat.slice(borders[low], borders[high] - borders[low])
        ends = np.concatenate([[0], np.cumsum(sizes[own.to_numpy(zero_copy_only=False)])])
        places = ends[borders[low : high + 1] - borders[low]].astype(np.int32)
        data = table.take(own).buffers()[2]  # the tokens' bytes, one after another
        yield pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(places), data])
        low = high


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids (``array<int>``) of a text column."""

    def make() -> Callable[[pa.Array], Iterator[tuple[pa.Array]]]:
        batch = codec(path, pattern).batch
        return lambda texts: ((x,) for x in _ids_of(batch, texts))

    return _mapped(df, text, {ids: "array<int>"}, make)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes (``binary``) of a column of ids."""

    def make() -> Callable[[pa.Array], Iterator[tuple[pa.Array]]]:
        table = _table(path)
        return lambda lists: ((x,) for x in _bytes_of(table, lists))

    return _mapped(df, ids, {decoded: "binary"}, make)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in the same workers: the ids of a text column, and the bytes that these ids stand for."""

    def make() -> Callable[[pa.Array], Iterator[tuple[pa.Array, pa.Array]]]:
        batch, table = codec(path, pattern).batch, _table(path)

        def columns(texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
            for found in _ids_of(batch, texts):
                low = 0
                for data in _bytes_of(table, found):
                    yield found.slice(low, len(data)), data
                    low += len(data)

        return columns

    return _mapped(df, text, {ids: "array<int>", decoded: "binary"}, make)
