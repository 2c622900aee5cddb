"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, which puts those that share leading bits, and then differ in few,
side by side. The sorted sequence is cut into nodes; a node keeps the bits that all its members share (a
mask and a pattern), and so do the nodes above it. The difference of two nodes' patterns under both masks
is a lower bound for all their members; it accumulates down the levels and prunes whole groups.

Two fingerprints that differ in at most two of three parts' bits agree in one part. So the index is kept
in three orders, each with another part in front, and only members of the same leading bits of that
part (as many bits as make groups of about ``GROUP``, at most a part's) meet. Pairs of equal fingerprints
are never made: the index holds each fingerprint once.

Results: a null or blank text has fingerprint 0 and is linked like any other. Very long texts count whole, a
slice of shingles at a time. A bit that exactly half the shingles set is 0. Repeated rows have equal
fingerprints and are linked. A component is named by its smallest doc_id (null ones count last; null if
there is no other). An empty table gives no rows. Extra columns are not read, but for ``deduplicate``,
which keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm import intervals
from vectrail.llm.components import components
from vectrail.llm.spread import heavy_parts, spread_join
from vectrail.runtime import materialize, share_code, unused

SEED, WORDS, NEAR = 42, 3, 2
#: Fingerprints of a group with the same leading bits, about; of a block, at most; of a leaf node.
GROUP, BLOCK, LEAF = 1024, 2048, 32
PARTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(data: bytes | None) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned integer."""
    words = (data or b"").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)))
    n, ones, digest = len(shingles), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for low in range(0, n, 1 << 14):
        part = shingles[low : low + (1 << 14)]
        h = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the fingerprint of ``text``, as a signed 64-bit integer named v_print."""
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(n)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(prints)], [*batch.schema.names[:n], "v_print"])

    text = unused("v_text", keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text)
    return source.mapInArrow(run, f"{schema}, v_print bigint")


def _rotated(x: Column, by: int) -> Column:
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def gray_rank(x: Column) -> Column:
    """The place of a bit pattern in the reflected Gray code."""
    for n in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, n))
    return x


def _nodes(prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask of each run of n fingerprints."""
    starts = np.arange(0, len(prints), n)
    both, either = np.bitwise_and.reduceat(prints, starts), np.bitwise_or.reduceat(prints, starts)
    return both, ~(both ^ either)


def search(a: np.ndarray, b: np.ndarray | None, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b; i < j where b is None) of fingerprints at most ``near`` bits apart, both in Gray order."""
    c = a if b is None else b
    (pa_, ma), (pb, mb) = _nodes(a, LEAF), _nodes(c, LEAF)
    i, j = [], []
    for u in range(len(pa_)):
        low = u if b is None else 0
        apart = np.bitwise_count((pa_[u] ^ pb[low:]) & ma[u] & mb[low:])
        v = np.flatnonzero(apart <= near) + low
        if not len(v):
            continue
        x = a[u * LEAF : (u + 1) * LEAF]
        at = (v[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(c)]
        # Next level down: single members against what a node shares.
        p, q = np.nonzero(np.bitwise_count(x[:, None] ^ c[at][None, :]) <= near)
        p, q = p + u * LEAF, at[q]
        if b is None:
            p, q = p[p < q], q[p < q]
        i.append(p)
        j.append(q)
    none = np.zeros(0, np.int64)
    return (np.concatenate(i), np.concatenate(j)) if i else (none, none)


def _kernel(left: dict, right: dict | None) -> pa.Table:
    a = np.frombuffer(left["prints"], np.uint64)
    b = None if right is None else np.frombuffer(right["prints"], np.uint64)
    i, j = search(a, b)
    if b is not None:
        j = j + len(a)
    every = a if b is None else np.concatenate([a, b])
    root = intervals.forest(i, j, len(every))
    tied = np.flatnonzero(root != np.arange(len(root)))
    signed = every.view(np.int64)
    return pa.table({"a": signed[tied], "b": signed[root[tied]]})


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all of ``prints`` (v_print, each once, a written table) that differ in at most two bits."""
    bits = max(1, min(PARTS[-1][1], (prints.count() // GROUP).bit_length()))
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), gray_rank(_rotated(F.col("v_print"), at)).alias("rank")) for k, (at, _) in enumerate(PARTS)]))
    rows = prints.select("v_print", turned.alias("t")).select("v_print", F.col("t.rank").alias("rank"), (F.col("t.k") * F.lit(1 << 22) + F.shiftrightunsigned("t.rank", 64 - bits)).cast("long").alias("grp"))

    def pack(table: pa.Table) -> dict:
        x = table.column("v_print").to_numpy().view(np.uint64)
        both, either = np.bitwise_and.reduce(x), np.bitwise_or.reduce(x)
        return {"prints": x.tobytes(), "n": len(x), "ones": int(both.view(np.int64)), "any": int(either.view(np.int64))}

    blocks = intervals.cut(rows, ["rank"], BLOCK, "prints binary, n int, ones bigint, any bigint", pack)

    def far(p: str, q: str) -> Column:
        """Bits that all members of one node have and no member of the other has."""
        def c(s: str) -> Column:
            return F.col(s)
        differ = c(f"{p}_ones").bitwiseAND(F.bitwise_not(c(f"{q}_any"))).bitwiseOR(c(f"{q}_ones").bitwiseAND(F.bitwise_not(c(f"{p}_any"))))
        return F.bit_count(differ) > NEAR

    near = intervals.pairs(blocks, [F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any")], ["ones", "any"], far)
    return intervals.join(blocks, near, ["prints"], _kernel, "a bigint, b bigint")


def clusters(prints: DataFrame) -> DataFrame:
    """(v_print, v_root) of every fingerprint: equal roots for those that links connect. ``prints`` holds each v_print once."""
    joined = components(links(prints)).select(F.col("node").alias("v_print"), F.col("root").alias("v_root"))
    return prints.select("v_print").join(joined, "v_print", "left").select("v_print", F.coalesce("v_root", "v_print").alias("v_root"))


def _named(own: DataFrame, first: str) -> DataFrame:
    """v_print, n and ``first`` of its cluster (the least), for each of ``own`` (v_print, n, ``first``; a written table)."""
    root = clusters(own.select("v_print")).withColumnRenamed("v_print", "v_key")
    held = materialize(own.join(root, F.col("v_print") == F.col("v_key")).drop("v_key"), "roots")
    least = materialize(held.groupBy("v_root").agg(F.min(first).alias("v_least"), F.count("*").alias("n")), "least")
    parts = heavy_parts(least, "v_root", own.count())
    return spread_join(held, least.drop("n"), "v_root", parts, F.col("v_print")).select("v_print", "n", F.col("v_least").alias(first))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every document."""
    numbered = docs.select("doc_id", "text").withColumn("v_uid", F.monotonically_increasing_id())
    rows = materialize(fingerprints(numbered, ["doc_id", "v_uid"]), "prints")
    own = materialize(rows.groupBy("v_print").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "distinct")
    table = materialize(_named(own, "component_id"), "named")
    # A fingerprint that many copies share meets its name in many tasks.
    found = spread_join(rows, table.drop("n"), "v_print", heavy_parts(table, "v_print", rows.count()), F.col("v_uid"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("v_print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (of equal ones, any one)."""
    uid = unused("v_uid", docs.columns)
    held = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    ids = held.select(F.col("doc_id").alias("v_doc"), F.col(uid).alias("v_row"), "text")
    rows = materialize(fingerprints(ids, ["v_doc", "v_row"]), "prints")
    place = F.struct(F.col("v_doc").isNull().alias("n"), F.col("v_doc").alias("d"), F.col("v_row").alias("u"))
    own = materialize(rows.groupBy("v_print").agg(F.min(place).alias("v_first"), F.count("*").alias("n")), "distinct")
    root = clusters(own.select("v_print")).withColumnRenamed("v_print", "v_key")
    kept = own.join(root, F.col("v_print") == F.col("v_key")).groupBy("v_root").agg(F.min("v_first").alias("v_first"))
    kept = materialize(kept.select(F.col("v_first.u").alias(uid)), "kept")
    # Merged at every size: what moves then grows as the documents do.
    return held.join(kept.hint("merge"), uid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
