"""Greedy token-bounded chunks of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions import text as T
from vectrail.functions.text import ADDITIVE, ChunkOptions
from vectrail.runtime import share_code, unused


def fold(segs: Column, options: ChunkOptions, count: Callable[[Column], Column] = T.count_words, additive: bool = False) -> Column:
    """Chunks (array of strings) of an array of segments.

    A segment joins the current chunk unless that is full, the segment starts with a stop signal, or the two together
    exceed the limit. ``additive`` says that counts of joined segments add up; else the joined text is counted.
    """
    most = F.lit(options.max_tokens)

    def step(acc: Column, seg: Column) -> Column:
        n = count(seg)
        joined = F.concat(acc["cur"], seg)
        total = acc["n"] + n if additive else count(joined)
        fits = (acc["n"] < most) & ~T.has_stop_signal(seg, options.stops) & (total <= most)
        first = F.struct(acc["out"].alias("out"), seg.alias("cur"), n.alias("n"))
        grown = F.struct(acc["out"].alias("out"), joined.alias("cur"), total.alias("n"))
        closed = F.struct(F.array_append(acc["out"], acc["cur"]).alias("out"), seg.alias("cur"), n.alias("n"))
        return F.when(acc["cur"].isNull(), first).when(fits, grown).otherwise(closed)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(segs, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))


def cut_segments(text: str, breaks: list[str]) -> list[str]:
    """Segments by any list of break strings: a segment ends where it stops to end with one."""
    ends = tuple(breaks)
    reach = max(map(len, breaks))
    out, start, cut = [], 0, -1
    for at in range(1, len(text) + 1):
        if text.endswith(ends, max(start, at - reach), at):
            cut = at
        elif cut >= 0:
            out.append(text[start:cut])
            start, cut = cut, -1
            if text.endswith(ends, max(start, at - reach), at):
                cut = at
    if start < len(text):
        out.append(text[start:])
    return out


#: The default counter's words: runs of what the JVM's ``\\S`` takes, so that both forms count alike.
_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")


def count_words(text: str) -> int:
    """``functions.text.count_words`` in Python."""
    return len(_WORDS.findall(text))


def fold_text(segs: list[str], options: ChunkOptions, count: Callable[[str], int]) -> list[str]:
    """``fold`` for segments and a counter in Python."""
    stops = tuple(s for s in options.stops if s)
    out: list[str] = []
    cur: str | None = None
    for seg in segs:
        if cur is None:
            cur = seg
        elif count(cur) < options.max_tokens and not (stops and seg.lstrip().startswith(stops)) and count(cur + seg) <= options.max_tokens:
            cur += seg
        else:
            out.append(cur)
            cur = seg
    return out if cur is None else [*out, cur]


def chunk(docs: DataFrame, options: ChunkOptions | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", counter: Callable[[str], int] | None = None) -> DataFrame:
    """``keep`` columns, chunk_index and chunk of every text; texts that are null or empty have none.

    A preset's break strings with word counts stay in the JVM. Other break strings, or a ``counter`` of one's own, run in
    Arrow batches.
    """
    options = options or ChunkOptions()
    held = [F.col(f"`{c}`") for c in keep]
    if isinstance(options.break_strings, str) and counter is None:
        segs = T.segments(F.col(f"`{text}`"), options.break_strings)
        chunks = fold(segs, options, additive=options.break_strings in ADDITIVE)
        return docs.select(*held, F.posexplode(chunks).alias("chunk_index", "chunk"))
    share_code(docs.sparkSession)
    count = counter or count_words
    held_text, held_chunks = unused("v_text", list(keep)), unused("v_chunks", list(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            texts = batch.column(n).to_pylist()
            found = [fold_text(cut_segments(t or "", options.breaks), options, count) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.list_(pa.string()))], [*batch.schema.names[:n], held_chunks])

    source = docs.select(*held, F.col(f"`{text}`").alias(held_text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != held_text)
    return source.mapInArrow(run, f"{schema}, {held_chunks} array<string>").select(*held, F.posexplode(held_chunks).alias("chunk_index", "chunk"))
