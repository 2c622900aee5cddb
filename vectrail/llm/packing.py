"""Packing token pieces into sequences of a fixed length by best-two-fit.

Best-two-fit fills a bin greedily (always the longest piece that fits), then, while room is left,
tries to replace the bin's smallest piece with two unpacked pieces that fill the widened gap more
tightly. Which document a piece belongs to does not matter to it, only how many pieces of each length
are left, so the plan is made from the histogram of lengths: at most ``capacity`` counts, however many
documents there are. Bins of the same content are made as often as the counts allow at once. Each piece
then takes its place by its rank among the pieces of its length; ranks come from counts of small
buckets, so a length that a third of all pieces share is still ranked by many tasks.

Results: a null text counts as empty and holds the end id alone; rows of equal doc_id are packed each;
an empty table gives no rows. Extra columns of documents are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.tokens import encoder
from vectrail.runtime import materialize, share_code

#: Pieces that one ranking bucket of a length holds on average, at most.
BUCKET = 1_000


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): each text's ids and the end id, cut if over ``capacity``.

    All pieces but the first have ``capacity`` ids.
    """
    share_code(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            held = 0
            for doc_id, found in zip(batch.column(0).to_pylist(), tokenizer.batch(batch.column(1)), strict=True):
                ids = found + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at - 1) % capacity + 1 if at == 0 else capacity
                    for column, x in zip(rows, (doc_id, piece, at, length, ids[4 * at : 4 * (at + length)]), strict=True):
                        column.append(x)
                    at, piece = at + length, piece + 1
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, held = [[], [], [], [], []], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) until all counts are used up."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is longer than a sequence")
    lengths = sorted(left)
    bins = []

    def free(n: int, used: list[int]) -> bool:
        return left[n] > used.count(n)

    def longest(room: int, used: list[int]) -> int | None:
        k = bisect_right(lengths, room) - 1
        while k >= 0 and not free(lengths[k], used):
            k -= 1
        return lengths[k] if k >= 0 else None

    while lengths:
        used: list[int] = []
        room = capacity
        while room and (n := longest(room, used)):
            used.append(n)
            room -= n
        if room:
            smallest = min(used)
            rest = list(used)
            rest.remove(smallest)
            best = _two(lengths, left, rest, room + smallest, smallest)
            if best:
                used = [*rest, *best]
        times = min(left[n] // used.count(n) for n in set(used))
        bins.append((used, times))
        for n in set(used):
            left[n] -= times * used.count(n)
            if not left[n]:
                lengths.remove(n)
    return bins


def _two(lengths: list[int], left: dict[int, int], rest: list[int], gap: int, replaced: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum that is over ``replaced`` and at most ``gap``."""
    free = {n: c for n in lengths if (c := left[n] - rest.count(n)) > 0 and n < gap}
    order = sorted(free)
    best, most, low, high = None, replaced, 0, len(order) - 1
    while low <= high:
        a, b = order[low], order[high]
        if a + b > gap:
            high -= 1
            continue
        if a + b > most and (a != b or free[a] > 1):
            best, most = (a, b), a + b
            if most == gap:
                break
        low += 1
    return best


def place(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each place of each kind of bin."""
    ranks: dict[int, int] = {}
    sequence, out = 0, []
    for used, times in bins:
        offset = 0
        for n in sorted(used, reverse=True):
            out.append((n, ranks.get(n, 0), times, sequence, offset))
            ranks[n] = ranks.get(n, 0) + times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """``pieces`` (with ``length``) with sequence_id and offset. ``order``: columns that tell pieces apart; equal rows may trade places.

    ``pieces`` must be a written table: it is read more than once.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(counts.values())
    spots = place(plan_bins(counts, capacity))  # bounded by the square of capacity, whatever the input
    schema = "v_length bigint, v_first bigint, v_ranks bigint, v_sequence bigint, v_offset bigint"
    starts = spark.createDataFrame(spots, schema)

    buckets = max(1, -(-total // BUCKET))
    split = {n: max(1, min(buckets, -(-c // BUCKET))) for n, c in counts.items()}
    widths = F.create_map(*[F.lit(x) for n, b in split.items() for x in (n, b)]) if split else F.create_map(F.lit(0), F.lit(1))
    rows = pieces.withColumn("v_bucket", F.pmod(F.xxhash64(*order), F.coalesce(widths[F.col("length")], F.lit(1))).cast("int"))
    sizes = rows.groupBy("length", "v_bucket").agg(F.count("*").alias("v_n"))
    before = Window.partitionBy("length").orderBy("v_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("v_len"), F.col("v_bucket").alias("v_b"), F.coalesce(F.sum("v_n").over(before), F.lit(0)).alias("v_base"))
    ranked = rows.withColumn("v_row", F.row_number().over(Window.partitionBy("length", "v_bucket").orderBy(*order)) - 1)
    ranked = ranked.join(sizes, (F.col("length") == F.col("v_len")) & (F.col("v_bucket") == F.col("v_b")), "left").withColumn("v_rank", F.col("v_row") + F.col("v_base"))
    # Each length's places as one sorted array: a bounded table, found by binary search on the rank.
    table = starts.groupBy("v_length").agg(F.sort_array(F.collect_list(F.struct("v_first", "v_ranks", "v_sequence", "v_offset"))).alias("v_spots"))
    held = ranked.join(F.broadcast(table), F.col("length") == F.col("v_length"))
    spot = F.element_at(F.filter("v_spots", lambda s: (s["v_first"] <= F.col("v_rank")) & (F.col("v_rank") < s["v_first"] + s["v_ranks"])), 1)
    held = held.withColumn("v_spot", spot)
    return held.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("v_spot.v_sequence") + F.col("v_rank") - F.col("v_spot.v_first")).alias("sequence_id"),
        F.col("v_spot.v_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = token_pieces(docs, vocabulary, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces, "pieces"), ["doc_id", "piece", "start", "ids_crc32"], capacity)
