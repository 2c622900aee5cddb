"""Self-join of a sorted sequence, interval by interval.

Rows sorted by (group, key) are cut into blocks of bounded size. Blocks carry a summary from which a bound
on the distance of their rows follows. Pairs of intervals of blocks are joined from the top: a pair that is
provably too far apart is dropped with all it holds, the others are split into their parts, down to
pairs of blocks. Blocks come from a range partitioning, so a group that holds a third of all rows is spread
over many tasks; what a task holds is two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.runtime import materialize, share_code

#: Parts that an interval is split into.
FANOUT = 16


def cut(rows: DataFrame, order: list[str], size: int, schema: str, pack: Callable[[pa.Table], dict], deal: str | None = None) -> DataFrame:
    """Blocks (block, grp, and what ``pack`` makes of at most ``size`` rows of one ``grp``) of ``rows``, sorted by grp and ``order``.

    With ``deal`` the rows of a group and of a value of that column make a block, whatever the number of partitions
    (see ``dealt``); else ranges do. The result is a written table.
    """
    share_code(rows.sparkSession)

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def key(batch: pa.RecordBatch) -> np.ndarray:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grp", deal or "grp")]
            return np.stack(columns, axis=1)

        def close() -> dict:
            nonlocal made, held
            out = pack(pa.Table.from_batches(held))
            out |= {"block": part << 32 | made, "grp": held[0].column("grp")[0].as_py()}
            made, held = made + 1, []
            return out

        ready: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = key(batch)
            borders = np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *borders.tolist()], [*borders.tolist(), len(groups)], strict=True):
                if held and (key(held[0].slice(0, 1))[0] != groups[low]).any():
                    ready.append(close())
                while low < high:
                    room = size - sum(b.num_rows for b in held)
                    held.append(batch.slice(low, min(room, high - low)))
                    low += held[-1].num_rows
                    if sum(b.num_rows for b in held) == size:
                        ready.append(close())
            if len(ready) >= 64:
                yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                ready = []
        if held:
            ready.append(close())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"block bigint, grp bigint, {schema}")
    arrow = to_arrow_schema(full)
    if deal:
        ordered = rows.repartition("grp", deal).sortWithinPartitions("grp", deal, *order)
    else:
        ordered = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    return materialize(ordered.mapInArrow(chop, full), "blocks")


def dealt(rows: DataFrame, by: str, size: int) -> DataFrame:
    """``rows`` with ``part``: as many parts of each grp as give about ``size`` rows each, dealt by a hash of ``by``.

    There must be few groups; how many rows they have is counted, so the number of parts follows.
    """
    counts = rows.groupBy(F.col("grp").alias("v_grp")).agg(F.count("*").alias("v_n"))
    sized = rows.join(F.broadcast(counts), F.col("grp") == F.col("v_grp"))
    part = F.pmod(F.xxhash64(by), F.ceil(F.col("v_n") / size)).cast("int")
    return sized.withColumn("part", part).drop("v_grp", "v_n")


def pairs(blocks: DataFrame, merge: list[Column], summary: list[str], far: Callable[[str, str], Column]) -> DataFrame:
    """(l, r), l < r, of the blocks of a group that are not provably far apart.

    ``merge`` aggregates the ``summary`` columns of an interval's parts; ``far(l, r)`` tells from summaries under the
    prefixes l and r that no rows of the two can be near.
    """
    nodes = blocks.select("grp", "block", *summary)
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    many = nodes.join(sizes.where("n > 1").select("grp"), "grp")
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("block")) - 1
    leaf = materialize(many.withColumn("node", nth.cast("long")), "nodes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    levels = [leaf]
    width = most
    while width > FANOUT:
        below = levels[-1].withColumn("node", F.shiftright("node", 4))
        levels.append(materialize(below.groupBy("grp", "node").agg(*merge), "nodes"))
        width = -(-width // FANOUT)

    def side(level: DataFrame, p: str) -> DataFrame:
        kept = [c for c in level.columns if c != "block" or level is leaf]
        return level.select(*[F.col(c).alias(f"{p}_{c}") for c in kept], F.shiftright("node", 4).alias(f"{p}_up"))

    top = levels[-1]
    found = side(top, "l").join(side(top, "r"), (F.col("l_grp") == F.col("r_grp")) & (F.col("l_node") <= F.col("r_node")) & ~far("l", "r"))
    for level in levels[-2::-1]:
        upper = found.select(F.col("l_grp").alias("grp"), F.col("l_node").alias("lu"), F.col("r_node").alias("ru"))
        found = upper.join(side(level, "l"), (F.col("grp") == F.col("l_grp")) & (F.col("lu") == F.col("l_up")))
        found = found.join(side(level, "r"), (F.col("grp") == F.col("r_grp")) & (F.col("ru") == F.col("r_up")) & (F.col("l_node") <= F.col("r_node")) & ~far("l", "r"))
    return found.where("l_node < r_node").select(F.col("l_block").alias("l"), F.col("r_block").alias("r"))


def join(blocks: DataFrame, near: DataFrame, payload: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Runs ``kernel(left, right)`` (dicts of payload values; right is None for a block with itself) and collects its arrow tables."""
    share_code(blocks.sparkSession)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from kernel(row, None).to_batches()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield from kernel({c: row[f"l_{c}"] for c in payload}, {c: row[f"r_{c}"] for c in payload}).to_batches()

    def side(p: str) -> DataFrame:
        return blocks.select(F.col("block").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in payload])

    spread = near.join(side("l"), "l").join(side("r"), "r")
    across = spread.select(*[f"{p}_{c}" for p in "lr" for c in payload]).mapInArrow(both, schema)
    return blocks.select(*payload).mapInArrow(alone, schema).unionByName(across)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        if (root[i] == root[j]).all():
            return root


def across(left: DataFrame, right: DataFrame, payloads: tuple[list[str], list[str]], kernel: Callable, schema: str) -> DataFrame:
    """Runs ``kernel(left row, right row)`` on every left and right block of the same grp.

    Blocks are paired by number first; their payloads then follow the pairs, so a large group's pairs spread over tasks.
    """
    share_code(left.sparkSession)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                sides = ({c: row[f"{p}_{c}"] for c in payload} for p, payload in zip("lr", payloads, strict=True))
                yield from kernel(*sides).to_batches()

    near = left.select("grp", F.col("block").alias("l")).join(right.select("grp", F.col("block").alias("r")), "grp").select("l", "r")
    for p, blocks, payload in (("l", left, payloads[0]), ("r", right, payloads[1])):
        near = near.join(blocks.select(F.col("block").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in payload]), p)
    columns = [f"{p}_{c}" for p, payload in zip("lr", payloads, strict=True) for c in payload]
    return near.select(*columns).mapInArrow(both, schema)
