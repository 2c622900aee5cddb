"""Exact cosine top-K: one query, batches of queries, several stores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.runtime import materialize, share_code

#: Queries that are multiplied with a batch at a time; bytes of queries that go along with tasks, at most; scores of a
#: product, at most.
QUERY_BLOCK, QUERY_BYTES, SCORES = 1024, 64 << 20, 4 << 20
#: Largest k whose rows every task may hold.
HEAP = 1_000_000


def _none(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.lit(0.0).alias("score")).where(F.lit(False))


def keep_keys(rows: DataFrame, allow: Column | DataFrame | Callable | None) -> DataFrame:
    """Rows whose id passes: a condition, a table of ids, a Python callable on the id, or None for all.

    The filter stands below the scoring; conditions reach the scan.
    """
    if allow is None:
        return rows
    if isinstance(allow, DataFrame):
        return rows.join(allow.select(F.col(allow.columns[0]).alias("id")).distinct(), "id", "left_semi")
    if isinstance(allow, Column):
        return rows.where(allow)
    return rows.where(F.udf(allow, "boolean", useArrow=True)(F.col("id")))


def scored(rows: DataFrame, query: Sequence[float]) -> DataFrame:
    """id and cosine of every row of ``rows`` (id, values, magnitude); other lengths, null and NaN scores are dropped, zero vectors score 0."""
    q = V.literal(query)
    norm = F.lit(math.sqrt(sum(float(x) * float(x) for x in query)))
    score = V.cosine(q, norm, F.col("values"), F.col("magnitude").cast("double"))
    fine = rows.where(F.size("values") == len(query))
    return fine.select("id", score.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))


def top_k(rows: DataFrame, query: Sequence[float], k: int, dimension: int | None = None, allow: Column | DataFrame | Callable | None = None) -> DataFrame:
    """The k rows of largest cosine, ties by id: id, score.

    Empty for k <= 0, an empty query or one of norm 0; a query of another length is an error.
    """
    if query is None:
        raise ValueError("a query is needed")
    if k <= 0 or not len(query):
        return _none(rows)
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has {len(query)} dimensions, the store {dimension}")
    if not any(float(x) for x in query):
        return _none(rows)
    found = scored(keep_keys(rows, allow), query)
    ordered = found.orderBy(F.desc("score"), "id")
    # A limit over an order makes room for k rows in every task: beyond this, a sort it is.
    return ordered.limit(k) if k <= HEAP or k < found.count() else ordered


def search_stores(stores: Sequence, query: Sequence[float], k: int) -> DataFrame:
    """The k best rows of several stores: id, score, store_name. Ids may repeat."""
    if query is None or stores is None:
        raise ValueError("a query and stores are needed")
    if not stores:
        raise ValueError("at least one store is needed")
    if k <= 0:
        raise ValueError("k must be above 0")
    found = None
    for store in stores:
        hits = store.search(query, k).withColumn("store_name", F.lit(store.name))
        found = hits if found is None else found.unionByName(hits)
    return found.orderBy(F.desc("score"), "store_name", "id").limit(k)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the k best of ``rows`` (id, values) for each of ``queries`` (query_id, values), ties by id.

    Ids are of any type that sorts. As in ``top_k``, null, NaN and infinite vectors and those of another length than the
    query's are no hits, zero vectors score 0, and a query that is null, empty, zero or not finite finds nothing.

    Queries of a checked size go along with the tasks: one pass over the rows, in which each task keeps its k best of every
    query, and a grouped limit joins them. More queries are cut into blocks, and blocks of queries meet blocks of rows.
    """
    key, asked = rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {asked}, id {key}, score double"
    if k <= 0:
        return rows.sparkSession.createDataFrame([], f"query_id {asked}, rank int, id {key}, score double")
    share_code(rows.sparkSession)
    there = queries.where("values is not null and size(values) > 0").select("query_id", "values")
    size = there.agg(F.sum(F.size("values").cast("long") * 8 + 64)).first()[0] or 0
    if size <= QUERY_BYTES:
        blocks = _blocks(there.toArrow().combine_chunks().to_batches())
        found = rows.select("id", "values").mapInArrow(lambda batches: _best_of(blocks, batches, k), schema)
    else:
        found = _paired(rows, there, k, schema, key, asked)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _blocks(batches: Iterator[pa.RecordBatch], most: int = QUERY_BLOCK) -> list[tuple[pa.Array, np.ndarray]]:
    """(ids, unit vectors) of runs of finite vectors (column 1) of one length; a zero vector stays zero."""
    out = []
    for batch in batches:
        vectors = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes[sizes > 0]).tolist():
            at = pa.array(np.flatnonzero(sizes == n))
            x = pc.list_flatten(vectors.take(at)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)  # null components: NaN
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            fine = np.isfinite(norm)
            ids, x, norm = batch.column(0).take(at).filter(pa.array(fine)), x[fine], norm[fine]
            x = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
            out += [(ids.slice(low, most), x[low : low + most]) for low in range(0, len(x), most)]
    return out


def _scores(queries: tuple[pa.Array, np.ndarray], rows: tuple[pa.Array, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, places of rows, scores) of all that may be among the k best."""
    q, x = queries[1], rows[1]
    products = q @ x.T
    if len(x) > k:
        products[products < np.partition(products, -k, axis=1)[:, -k, None] - 1e-12] = -np.inf
    products[~q.any(axis=1)] = -np.inf  # a zero query finds nothing
    i, j = np.nonzero(np.isfinite(products))
    return i, j, np.einsum("ij,ij->i", q[i], x[j])  # summed alike for equal vectors, so that these tie


class _Kept:
    """The k best rows of each query of a block, as tables that are cut back when they have grown."""

    def __init__(self, ids: pa.Array, k: int):
        self.ids, self.k, self.parts, self.held = ids, k, [], 0

    def add(self, i: np.ndarray, rows: pa.Array, scores: np.ndarray) -> None:
        self.parts.append(pa.table({"q": i, "id": rows, "score": scores}))
        self.held += len(i)
        if self.held > 2 * self.k * len(self.ids) + SCORES:
            self.parts = [self.best()]
            self.held = len(self.parts[0])

    def best(self) -> pa.Table:
        every = pa.concat_tables(self.parts)
        order = pc.sort_indices(every, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
        every = every.take(order)
        q = every.column("q").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return every.filter(pa.array(rank < self.k))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            best = self.best().combine_chunks()
            yield from pa.table({"query_id": self.ids.take(best.column("q")), "id": best.column("id"), "score": best.column("score")}).to_batches(1 << 16)


def _best_of(blocks: list[tuple[pa.Array, np.ndarray]], batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of all ``batches`` (id, values) for each query."""
    kept = [_Kept(ids, k) for ids, _ in blocks]
    for batch in batches:
        for rows in _blocks([batch], SCORES // QUERY_BLOCK):
            for n, queries in enumerate(blocks):
                if rows[1].shape[1] == queries[1].shape[1]:
                    i, j, scores = _scores(queries, rows, k)
                    kept[n].add(i, rows[0].take(pa.array(j)), scores)
    for x in kept:
        yield from x.batches()


def _paired(rows: DataFrame, queries: DataFrame, k: int, schema: str, key: str, asked: str) -> DataFrame:
    """Blocks of queries and of rows of one length, paired by number; the vectors follow the pairs, which spread over tasks."""

    def packed(side: DataFrame, p: str, kind: str) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x in _blocks([batch]):
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([x.tobytes()])], ["n", f"{p}_ids", f"{p}_values"])

        made = side.mapInArrow(pack, f"n bigint, {p}_ids array<{kind}>, {p}_values binary")
        return materialize(made.withColumn(p, F.monotonically_increasing_id()), "blocks")

    left, right = packed(queries, "q", asked), packed(rows.select("id", "values"), "r", key)
    near = left.select("n", "q").join(right.select("n", "r"), "n")
    both = near.join(right.drop("n"), "r").join(left.drop("n"), "q").select("n", "q_ids", "q_values", "r_ids", "r_values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                n, q_ids, q, r_ids, r = (batch.column(c)[at] for c in range(5))
                queries, rows = ((ids.values, np.frombuffer(x.as_py(), np.float64).reshape(-1, n.as_py())) for ids, x in ((q_ids, q), (r_ids, r)))
                kept = _Kept(queries[0], k)
                i, j, scores = _scores(queries, rows, k)
                kept.add(i, rows[0].take(pa.array(j)), scores)
                yield from kept.batches()

    return both.mapInArrow(run, schema)


def fetch_content(hits: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Hits with the rows that they name."""
    return hits.join(docs.withColumnRenamed(key, "id"), "id")
