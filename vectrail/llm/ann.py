"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

Vectors are dealt into lists by spherical k-means, fitted on a bounded sample; every vector is in one list. From
the sample also come the mean and the spread of each list: the expected number of its vectors whose product with
a query passes a threshold follows, and with it the threshold that k vectors should pass. A query probes the
lists with the most expected hits until they have ``COVER`` of them all, so how many it probes depends on the data.

All vectors are rotated at random, so that a part of the dimensions tells about the rest, and blocks of a list are
scanned a few columns at a time: from the partial inner products, a hypothesis test abandons the candidates that
are unlikely to reach the query's k-th best so far. What is left is scored anew on the vectors as given.

Queries are in blocks, each once, beside queries of the same nearest list; only (block, list) numbers are paired. A
task takes a block of queries and a share of the candidates, best lists first, and keeps k rows of each query.

Results: vectors that are null, empty or zero or hold null or non-finite components take no part; a query meets
vectors of its own length. A query is not its own candidate, but rows that repeat it are. Ties go to the smaller
vec_id, null ones last. All candidates are returned if there are fewer than k. Rows with a null vec_id are candidates.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm import intervals
from vectrail.llm.embed_join import sample, unit, usable
from vectrail.runtime import materialize, share_code

#: Vectors that centres are fitted on, about; rounds; lists, at least and at most; vectors of a list.
SAMPLE, ROUNDS, LEAST_LISTS, LISTS, PER_LIST = 16384, 8, 24, 1024, 1000
#: Share of the expected hits that probed lists have; candidates that they hold at least, in k.
COVER, LEAST_K = 0.95, 8
#: Vectors of a block of candidates and of queries, and of a share; columns of a step; standard deviations of the test.
BLOCK, QUERIES, SHARE, COLUMNS, SIGMAS = 4096, 1024, 32768, 16, 2.0
SEED = 11
#: Share of a normal distribution above -8 to 8 standard deviations.
_AT = np.linspace(-8, 8, 1601)
_ABOVE = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in _AT])


@dataclass(frozen=True)
class Model:
    """Lists of the vectors of one length."""

    centres: np.ndarray
    turn: np.ndarray
    share: np.ndarray  # of the vectors, by list
    mean: np.ndarray
    spread: np.ndarray  # standard deviation along a direction

    def expected(self, queries: np.ndarray, total: int, k: int) -> np.ndarray:
        """Hits that each list (column) should have for each query: vectors above the threshold that k of all pass."""
        q = queries.astype(np.float64)
        mean, sd = q @ self.mean.T, np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * self.spread
        sd = np.maximum(sd, 1e-12 * (1e-300 + np.abs(mean)))
        size = self.share * total
        low, high = (mean - 8 * sd).min(axis=1), (mean + 8 * sd).max(axis=1)
        for _ in range(30):
            mid = (low + high) / 2
            many = (np.interp((mid[:, None] - mean) / sd, _AT, _ABOVE) * size).sum(axis=1) >= k
            low, high = np.where(many, mid, low), np.where(many, high, mid)
        return np.interp((low[:, None] - mean) / sd, _AT, _ABOVE) * size


def fit(rows: DataFrame, lists: int) -> dict[int, Model]:
    """The lists of each length of vectors in a bounded sample."""
    out = {}
    for n, vectors in sorted(sample(rows, SAMPLE, "embedding", "uid").items()):
        x = np.array(vectors, np.float64)
        every = unit(x)
        u = np.unique(every, axis=0)
        random = np.random.default_rng(SEED)
        centres = u[random.permutation(len(u))[:lists]]
        for _ in range(ROUNDS):
            own = np.argmax(u @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, u)
            length = np.sqrt((sums * sums).sum(axis=1))
            centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
        own = np.argmax(every @ centres.T, axis=1)
        size = np.bincount(own, minlength=len(centres)).astype(np.float64)
        mean = np.zeros_like(centres)
        np.add.at(mean, own, x)
        mean /= np.maximum(size, 1)[:, None]
        apart = np.bincount(own, weights=((x - mean[own]) ** 2).sum(axis=1), minlength=len(centres))
        # A list of few sampled vectors leans on the spread of all.
        spread = np.sqrt((apart + apart.sum() / size.sum()) / (np.maximum(size, 1) * n))
        turn = np.linalg.qr(random.standard_normal((n, n)))[0]
        out[n] = Model(centres, turn, np.maximum(size, 0.5) / size.sum(), mean, spread)
    return out


def nearest(models: dict[int, Model], vectors: np.ndarray) -> np.ndarray:
    """The list of each vector; a length that the sample lacks has one list."""
    n = vectors.shape[1]
    return np.argmax(unit(vectors) @ models[n].centres.T, axis=1) if n in models else np.zeros(len(vectors), np.int64)


def probes(models: dict[int, Model], vectors: np.ndarray, totals: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists (column) each query probes, and the lists that any does, those with the most expected hits first."""
    n = vectors.shape[1]
    if n not in models:
        return np.ones((len(vectors), 1), bool), np.zeros(1, np.int64)
    total = totals[n]
    hits = models[n].expected(vectors, total, k)
    order = np.argsort(-hits, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(hits, order, axis=1), axis=1)
    held = np.cumsum((models[n].share * total)[order], axis=1)
    need = (before < COVER * before[:, -1:]) | (held < min(LEAST_K * k, total))
    need = np.concatenate([np.ones((len(need), 1), bool), need[:, :-1]], axis=1)
    if total <= LEAST_K * k:
        need[:] = True
    chosen = np.zeros_like(need)
    np.put_along_axis(chosen, order, need, axis=1)
    some = np.flatnonzero(chosen.any(axis=0))
    return chosen, some[np.argsort(-hits[:, some].sum(axis=0), kind="stable")]


def _cosine(kth: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The cosine that vectors of these products of lengths need for a score of ``kth``."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.nan_to_num(np.clip(kth / lengths, 0.0, 1.0))


def _reach(cosine: np.ndarray, left: int) -> np.ndarray:
    """The cosine over the ``left`` dimensions that a vector with ``cosine`` over all, rotated at random, stays below but for chance."""
    return np.minimum(1.0, cosine + SIGMAS / math.sqrt(left) * (1 - cosine * cosine))


class Best:
    """The k best candidates so far of each query of a block, sorted by query, falling score, vec_id and uid."""

    def __init__(self, queries: np.ndarray, uids: np.ndarray, turn: np.ndarray | None, k: int):
        self.queries, self.uids, self.turn, self.k = queries.astype(np.float64), uids, turn, k
        self.turned = self.queries if turn is None else self.queries @ turn
        self.rest = np.sqrt(np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1])
        self.kth = np.full(len(queries), -np.inf)
        self.held = [np.zeros(0, t) for t in (np.int64, np.float64, bool, np.int64, np.int64)]

    def scan(self, asking: np.ndarray, uids: np.ndarray, ids: np.ndarray, null: np.ndarray, vectors: np.ndarray) -> None:
        """Meets the queries at the places ``asking`` with a block of candidates. Partial products decide who is carried on."""
        x = vectors.astype(np.float64)
        turned = x if self.turn is None else x @ self.turn
        rest = np.sqrt(np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1])
        columns = np.ascontiguousarray(turned.T)
        q, rest_q, n = self.turned[asking], self.rest[asking], x.shape[1]
        _, own_q, own_x = np.intersect1d(self.uids[asking], uids, assume_unique=True, return_indices=True)
        low, chunk = 0, max(2 * self.k, 64)
        while low < len(x):
            high = min(low + chunk, len(x))
            kth = self.kth[asking] - 1e-9 * (1 + np.abs(self.kth[asking]))  # rounding must not part equal scores
            kth[np.isnan(kth)] = -np.inf
            done = min(COLUMNS, n)
            partial = q[:, :done] @ columns[:done, low:high]
            likely = partial >= kth[:, None]
            if done < n:
                cosine = _cosine(kth[:, None], rest_q[:, 0, None] * rest[low:high, 0])
                likely = partial + rest_q[:, done, None] * rest[low:high, done] * _reach(cosine, n - done) >= kth[:, None]
            here = (own_x >= low) & (own_x < high)
            likely[own_q[here], own_x[here] - low] = False
            i, j = np.nonzero(likely)
            sums = partial[i, j]
            j += low
            while done < n and len(i):
                upto = min(done + COLUMNS, n)
                if len(i) > 0.2 * partial.size:  # most are left: as one product
                    sums = sums + (q[:, done:upto] @ columns[done:upto, low:high])[i, j - low]
                else:
                    sums = sums + np.einsum("ij,ij->i", q[i, done:upto], turned[j, done:upto])
                done = upto
                left = 0.0 if done == n else rest_q[i, done] * rest[j, done] * _reach(_cosine(kth[i], rest_q[i, 0] * rest[j, 0]), n - done)
                keep = sums + left >= kth[i]
                i, j, sums = i[keep], j[keep], sums[keep]
            if len(i):
                scores = (self.queries[asking[i]] * x[j]).sum(axis=1)
                self._merge(asking[i], scores, null[j], ids[j], uids[j])
            low, chunk = high, min(2 * chunk, 1024)

    def _merge(self, *more: np.ndarray) -> None:
        query, score, null, ids, uids = (np.concatenate([a, b]) for a, b in zip(self.held, more, strict=True))
        order = np.lexsort((uids, ids, null, -score, query))
        starts = np.searchsorted(query[order], np.arange(len(self.kth)))
        rank = np.arange(len(order)) - starts[query[order]]
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.held = [a[order] for a in (query, score, null, ids, uids)]
        last = rank == self.k - 1
        self.kth[self.held[0][last]] = self.held[1][last]


def search(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) that is a query, the k largest inner products found."""
    spark = vectors.sparkSession
    share_code(spark)
    valid = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("embedding")))
    rows = materialize(valid.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    totals = {r["n"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("n")).count().collect()}
    total = sum(totals.values())
    models = fit(rows, max(1, min(LISTS, max(LEAST_LISTS, total // PER_LIST))))

    def assign(batches):
        for batch in batches:
            values = batch.column("embedding").to_pylist()
            groups, by_size = np.zeros(len(values), np.int64), {}
            for i, v in enumerate(values):
                by_size.setdefault(len(v), []).append(i)
            for n, places in by_size.items():
                groups[places] = (n << 24) + nearest(models, np.array([values[i] for i in places], np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups)], [*batch.schema.names, "grp"])

    def pack(table: pa.Table) -> dict:
        a, ids = np.array(table.column("embedding").to_pylist(), np.float32), table.column("vec_id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        held = {"uids": table.column("uid").to_numpy(), "ids": ids.fill_null(0).to_numpy(), "nulls": null, "vectors": a}
        return {"n": len(a), "size": a.shape[1]} | {c: v.tobytes() for c, v in held.items()}

    def pack_queries(table: pa.Table) -> dict:
        held = pack(table)
        n = held["size"]
        chosen, lists = probes(models, np.frombuffer(held["vectors"], np.float32).reshape(-1, n), totals, k)
        return held | {"chosen": np.packbits(chosen, axis=1).tobytes(), "lists": ((n << 24) + lists).tolist()}

    schema = "vec_id bigint, embedding array<float>, asks boolean, uid bigint, grp bigint"
    made = "n int, size int, uids binary, ids binary, nulls binary, vectors binary"
    listed = materialize(rows.mapInArrow(assign, schema), "listed")
    candidates = intervals.cut(intervals.dealt(listed, "uid", BLOCK // 2), ["uid"], BLOCK, made, pack, "part")
    # Queries of a length, those of the same list side by side.
    asked = listed.where("asks").withColumn("near", F.col("grp")).withColumn("grp", F.size("embedding").cast("long"))
    blocks = intervals.cut(asked, ["near", "uid"], QUERIES, f"{made}, chosen binary, lists array<bigint>", pack_queries)

    # Which share of the candidates' blocks a pair is in; only numbers are joined, and each share is some tasks' work.
    shares = max(1, -(-total // SHARE))
    wanted = blocks.select(F.col("block").alias("asking"), F.posexplode("lists").alias("rank", "grp"))
    numbers = candidates.select("grp", F.col("block").alias("met"), F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"))
    pairs = materialize(wanted.join(numbers, "grp"), "pairs")
    tasks = pairs.select("asking", "share").distinct()
    payload = ["grp", "size", "uids", "ids", "nulls", "vectors"]
    left = tasks.join(blocks.withColumnRenamed("block", "asking"), "asking").select("asking", "share", F.lit(-1).alias("rank"), F.lit(-1).cast("long").alias("met"), *payload, "chosen")
    right = pairs.drop("grp").join(candidates.withColumnRenamed("block", "met"), "met").select("asking", "share", "rank", "met", *payload, F.lit(None).cast("binary").alias("chosen"))
    width = max(1, min(tasks.count(), 1 << 16))
    work = left.unionByName(right).repartition(width, "asking", "share").sortWithinPartitions("asking", "share", "rank", "met")

    def scan(batches):
        best, q_ids, chosen = None, None, None

        def close():
            query, score, null, ids, uids = best.held
            names = ("q_uid", "query_id", "uid", "vec_id", "score")
            columns = pa.array(best.uids[query]), q_ids.take(pa.array(query)), pa.array(uids), pa.array(ids, mask=null), pa.array(score)
            return pa.RecordBatch.from_arrays(list(columns), list(names))

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                uids, ids = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids"))
                null, x = np.frombuffer(row["nulls"], bool), np.frombuffer(row["vectors"], np.float32).reshape(-1, row["size"])
                if row["rank"] < 0:
                    if best:
                        yield close()
                    model = models.get(row["size"])
                    best, q_ids = Best(x, uids, model.turn if model else None, k), pa.array(ids, mask=null)
                    chosen = np.unpackbits(np.frombuffer(row["chosen"], np.uint8).reshape(len(x), -1), axis=1)
                elif len(asking := np.flatnonzero(chosen[:, row["grp"] & 0xFFFFFF])):
                    best.scan(asking, uids, ids, null, x)
        if best:
            yield close()

    found = work.mapInArrow(scan, "q_uid bigint, query_id bigint, uid bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("q_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
