"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label are scaled to length 1 and rotated so that the directions of largest spread lead. A
cosine of at least t is then a distance of at most e = sqrt(2 - 2t). A grid with cells of width e over the
leading dimensions orders the vectors; the sorted sequence is joined with itself interval by interval,
and a pair of intervals whose boxes are more than e apart is skipped with all it holds. The length that the
leading dimensions leave of a vector is one more side of the boxes. In two blocks that remain, smaller runs
are skipped by their boxes over all dimensions; of the rest, the leading dimensions are multiplied, and only
pairs that these and the remaining lengths allow to reach t are multiplied out.

Equal vectors are one entry of the sequence with a count, so copies are never expanded into pairs, and of the
links of a pair of blocks only the counts and a spanning forest leave the task. Rows meet their entry by two
64-bit hashes of label and vector; the rows of a vector with many copies, and the entries of a large component,
are dealt to many tasks.

Results: vectors that are null, empty or zero, hold null or non-finite components, or have no label link with
nothing; so do vectors of different lengths. Repeated rows are linked like any equal vectors. A component is
named by its smallest vec_id (null ones last; null if there is no other). An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm import intervals
from vectrail.llm.components import components
from vectrail.llm.spread import heavy_parts, spread_join
from vectrail.runtime import materialize, share_code

#: Vectors that the rotation is fitted on, about; dimensions of the grid, and of the first product; vectors of a block and of a run.
SAMPLE, GRID, LEAD, BLOCK, RUN = 8192, 8, 16, 1024, 64
#: Products this near the threshold are computed anew on the vectors as given.
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Whether a vector can have a cosine."""
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def sample(rows: DataFrame, size: int, *key: str) -> dict[int, list]:
    """About ``size`` of the vectors (all if there are fewer), chosen by a hash of ``key``, by their length."""
    unit, total = 1 << 30, max(rows.count(), 1)
    chosen = rows.where(F.pmod(F.xxhash64(*key), F.lit(unit)) < min(unit, -(-size * unit // total)))
    by_size: dict[int, list] = {}
    for (v,) in chosen.select("embedding").collect():
        by_size.setdefault(len(v), []).append(v)
    return by_size


def rotations(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors in a bounded sample: the rotation to principal directions, largest spread first."""
    by_size = sample(distinct, SAMPLE, "embedding")
    out = {}
    for n, vectors in by_size.items():
        u = unit(np.array(vectors, np.float64))
        u = u - u.mean(axis=0)
        out[n] = np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()
    return out


def _turn(u: np.ndarray, turns: dict[int, np.ndarray]) -> np.ndarray:
    turn = turns.get(u.shape[1])
    return u if turn is None else u @ turn


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(x), RUN)
    return np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)


def _apart(a: tuple, b: tuple) -> np.ndarray:
    """Squared distance of each box of a from each of b."""
    gap = np.maximum(np.maximum(a[0][:, None] - b[1][None], b[0][None] - a[1][:, None]), 0)
    return np.einsum("ijk,ijk->ij", gap, gap)


def near(a: np.ndarray, b: np.ndarray | None, least: float, turns: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b; i < j where b is None) with a cosine of at least ``least``."""
    ua = unit(a)
    ub = ua if b is None else unit(b)
    xa = _turn(ua, turns)
    xb = xa if b is None else _turn(ub, turns)
    far = _apart(_boxes(xa), _boxes(xb)) > 2 - 2 * least + SLACK
    # What the leading directions leave of a product is at most the product of the remaining lengths.
    (la, ra), (lb, rb) = ((x[:, :LEAD], np.sqrt(np.einsum("ij,ij->i", x[:, LEAD:], x[:, LEAD:]))) for x in (xa, xb))
    la, lb = np.column_stack([la, ra]), np.column_stack([lb, rb])
    c = a if b is None else b
    i, j = [], []
    for run in range(len(far)):
        low = run if b is None else 0
        others = np.flatnonzero(~far[run, low:]) + low
        if not len(others):
            continue
        at = (others[:, None] * RUN + np.arange(RUN)).ravel()
        at = at[at < len(ub)]
        p, q = np.nonzero(la[run * RUN : (run + 1) * RUN] @ lb[at].T >= least - SLACK)
        p, q = p + run * RUN, at[q]
        if b is None:
            p, q = p[p < q], q[p < q]
        exact = np.einsum("ij,ij->i", ua[p], ub[q])
        for k in np.flatnonzero(np.abs(exact - least) < SLACK):
            x, y = a[p[k]].astype(np.float64), c[q[k]].astype(np.float64)
            exact[k] = x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y))
        keep = exact >= least
        i.append(p[keep])
        j.append(q[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(i), np.concatenate(j)) if i else (none, none)


def links(vectors: DataFrame, least: float) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    share_code(spark)
    rows = vectors.select("vec_id", "embedding", "label")
    joinable = usable(F.col("embedding")) & F.col("label").isNotNull()
    group = (F.shiftleft(F.col("label").cast("long"), 24) + F.size("embedding")).alias("grp")
    valid = rows.where(joinable).select("vec_id", "embedding", group)
    key = F.concat(F.hex(F.xxhash64("grp", "embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "grp", "embedding")))
    keys = materialize(valid.select("vec_id", key.alias("key"), F.monotonically_increasing_id().alias("uid")), "keys")
    distinct = valid.groupBy("grp", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    distinct = materialize(distinct.withColumn("key", key).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    turns = rotations(distinct)
    width = math.sqrt(2 - 2 * least)

    def grid(batches):
        for batch in batches:
            values = batch.column("embedding").to_pylist()
            cells = []
            for v in values:
                cells.append(np.floor(_turn(unit(np.array([v], np.float64)), turns)[0, :GRID] / width).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    ordered = materialize(distinct.select("rep", "grp", "embedding", "n").mapInArrow(grid, "rep bigint, grp bigint, embedding array<float>, n bigint, cells array<int>"), "grid")
    sides = [f"{s}{k}" for k in range(GRID + 1) for s in ("lo", "hi")]

    def pack(table: pa.Table) -> dict:
        a = np.array(table.column("embedding").to_pylist(), np.float32)
        x = _turn(unit(a), turns)[:, :GRID]
        x = np.pad(x, ((0, 0), (0, GRID - x.shape[1])))
        rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))
        x = np.column_stack([x, rest])
        boxes = {f"lo{k}": float(x[:, k].min()) for k in range(GRID + 1)} | {f"hi{k}": float(x[:, k].max()) for k in range(GRID + 1)}
        return boxes | {"size": a.shape[1], "reps": table.column("rep").to_numpy().tobytes(), "counts": table.column("n").to_numpy().tobytes(), "vectors": a.tobytes()}

    blocks = intervals.cut(ordered, ["cells", "rep"], BLOCK, "size int, reps binary, counts binary, vectors binary, " + ", ".join(f"{s} double" for s in sides), pack)
    limit = 2 - 2 * least + SLACK

    def far(p: str, q: str) -> Column:
        total = F.lit(0.0)
        for k in range(GRID + 1):
            gap = F.greatest(F.col(f"{p}_lo{k}") - F.col(f"{q}_hi{k}"), F.col(f"{q}_lo{k}") - F.col(f"{p}_hi{k}"), F.lit(0.0))
            total = total + gap * gap
        return total > limit

    merge = [(F.min if s.startswith("lo") else F.max)(s).alias(s) for s in sides]
    pairs = intervals.pairs(blocks, merge, sides, far)

    def kernel(left: dict, right: dict | None) -> pa.Table:
        def part(side: dict) -> tuple:
            return np.frombuffer(side["reps"], np.int64), np.frombuffer(side["counts"], np.int64), np.frombuffer(side["vectors"], np.float32).reshape(-1, side["size"])

        reps, counts, a = part(left)
        b = None
        if right is not None:
            more_reps, more_counts, b = part(right)
        i, j = near(a, b, least, turns)
        if b is not None:
            reps, counts, j = np.concatenate([reps, more_reps]), np.concatenate([counts, more_counts]), j + len(a)
        linked = np.bincount(i, counts[j], len(reps)) + np.bincount(j, counts[i], len(reps))
        root = intervals.forest(i, j, len(reps))
        some = np.flatnonzero(linked)
        return pa.table({"rep": reps[some], "links": linked[some].astype(np.int64), "root": reps[root[some]]})

    found = materialize(intervals.join(blocks, pairs, ["size", "reps", "counts", "vectors"], kernel, "rep bigint, links bigint, root bigint"), "links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = distinct.select("rep", "key", "first", "n").join(totals, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("rep", "key", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")), "named")
    smallest = materialize(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "smallest")
    table = spread_join(named, smallest.drop("n"), "root", heavy_parts(smallest, "root", named.count()), F.col("rep"))
    table = materialize(table.select("key", "n", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"), "table")
    linked = spread_join(keys, table.drop("n"), "key", heavy_parts(table, "key", keys.count()), F.col("uid")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~joinable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
