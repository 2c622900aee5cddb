import random

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F

from vectrail.llm import ann, components, embed_join, intervals
from vectrail.llm import simhash as H


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    made = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(made.randint(100, 300), made.randint(100, 300)) for _ in range(120)] + [(400, 400 + i) for i in range(50)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = closure(500, pairs)
    assert found == {x: root[x] for x in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_forest():
    made = np.random.default_rng(7)
    i, j = made.integers(0, 200, 150), made.integers(0, 200, 150)
    assert intervals.forest(i, j, 200).tolist() == closure(200, zip(i.tolist(), j.tolist(), strict=True))


def test_gray_rank(spark):
    rows = spark.range(256).select("id", H.gray_rank(F.col("id")).alias("g")).collect()
    order = [r["id"] for r in sorted(rows, key=lambda r: r["g"])]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("block, leaf, group", [(2048, 32, 1024), (16, 4, 100000), (8, 4, 16)])
def test_links_find_every_near_pair(spark, block, leaf, group, monkeypatch):
    """One group in many small blocks takes the recursion through several levels."""
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "LEAF", leaf)
    monkeypatch.setattr(H, "GROUP", group)
    made = random.Random(8)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        x = made.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for _ in range(made.randint(1, 3)):
                x ^= 1 << made.randrange(64)
    prints = sorted(prints)
    pairs = [(i, j) for i, a in enumerate(prints) for j in range(i) if (a ^ prints[j]).bit_count() <= 2]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    from vectrail.runtime import materialize

    table = materialize(spark.createDataFrame([(p,) for p in signed], "v_print bigint"), "p")
    found = {r["v_print"]: r["v_root"] for r in H.clusters(table).collect()}
    root = closure(len(prints), pairs)
    groups = {}
    for k, p in enumerate(signed):
        groups.setdefault(root[k], set()).add(found[p])
    assert len(found) == len(prints) and all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_fingerprints_over_documents(spark):
    import re

    import xxhash

    docs = documents(spark)
    rows = H.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for r in docs.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) if len(h) else 0
        assert int(by_id[r["doc_id"]]["fingerprint"], 16) == want
    assert by_id[0]["component_id"] == by_id[1]["component_id"] == by_id[2]["component_id"] == 0
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == by_id[6]["component_id"] == 4
    kept = H.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 4, None} <= set(ids) and not {1, 2, 5, 6} & set(ids)
    assert H.near_duplicates(docs.limit(0)).count() == 0 and H.deduplicate(docs.limit(0)).count() == 0


def vectors_of(made, n):
    """Clusters, chains, copies, and rows that take no part."""
    v = made.standard_normal((n, 16))
    for k in range(0, n, 4):
        v[k + 1 : k + 3] = v[k] + made.standard_normal((2, 16)) * 0.3
    v[7] = v[3]
    rows = [(i, [float(np.float32(x)) for x in r], i % 3, "clash") for i, r in enumerate(v)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + i, o, 1, None) for i, o in enumerate(odd)] + [(n + 50, rows[0][1], None, None), rows[3], rows[3], (None, rows[9][1], rows[9][2], None)]
    rows += [(n + 60 + i, [1e-30 * (i + 1)] * 16, 2, None) for i in range(2)]
    return rows


VECTORS = "vec_id bigint, embedding array<float>, label int, root string"


@pytest.mark.parametrize("block, run", [(1024, 64), (8, 4)])
def test_epsilon_join(spark, block, run, monkeypatch):
    monkeypatch.setattr(embed_join, "BLOCK", block)
    monkeypatch.setattr(embed_join, "RUN", run)
    rows = vectors_of(np.random.default_rng(9), 240)
    found = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embed_join.links(spark.createDataFrame(rows, VECTORS), 0.93).collect())
    fine = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) and lab is not None for _, e, lab, _ in rows]
    pairs, n = [], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    pairs.append((j, i))
                    n[i] += 1
                    n[j] += 1
    root = closure(len(rows), pairs)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    wanted = sorted((r[0] is None, r[0] or 0, n[k], least.get(root[k]), r[0] == least.get(root[k])) for k, r in enumerate(rows))
    assert found == wanted
    assert embed_join.links(spark.createDataFrame([], VECTORS), 0.93).count() == 0


def test_neighbours(spark):
    made = np.random.default_rng(10)
    rows = vectors_of(made, 1200)
    df = spark.createDataFrame(rows, VECTORS)
    found = {}
    for r in ann.search(df, 20, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.array(e, np.float32).astype(float)) for i, e, _, _ in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    hit = total = 0

    def place(vec_id, score):
        return -score, vec_id is None, vec_id or 0

    for q, (i, v) in enumerate(good):
        if i is None or i % 20 or len(v) != 16:
            continue
        best = sorted(place(j, v @ w) for k, (j, w) in enumerate(good) if k != q and len(w) == 16)[:20]
        got = sorted(found[i], key=lambda g: g[0])
        assert [g[0] for g in got] == list(range(1, 21)) and [place(j, s) for _, j, s in got] == sorted(place(j, s) for _, j, s in got)
        for _, j, s in got:
            assert any(abs(v @ w - s) < 1e-9 for k, w in good if k == j and len(w) == 16)
        hit += sum(s >= -best[-1][0] - 1e-9 for _, _, s in got)
        total += 20
    assert hit / total >= 0.9
    few = ann.search(df.limit(6), 20, F.col("vec_id") == 0).collect()
    assert len(few) == 5
    # One text in three is a copy: ties of one query are cut by vec_id, and a row without one comes last.
    copies = [(i, [1.0, 0.5], 0, "") for i in range(400)] + [(None, [1.0, 0.5], 0, "")] + [(400 + i, [float(x) for x in made.standard_normal(2).astype(np.float32) * 0.3], 0, "") for i in range(800)]
    tied = ann.search(spark.createDataFrame(copies, VECTORS), 20, F.col("vec_id") == 40).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in tied) == [(i + 1, i) for i in range(20)]
    last = ann.search(spark.createDataFrame(copies[398:401], VECTORS), 20, F.col("vec_id") == 399).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in last) == [(1, 398), (2, None)]


def test_a_hit_outlives_the_test(spark):
    """Vectors that share a direction: their products are far from zero, which the test must allow for."""
    made = np.random.default_rng(12)
    x = (made.standard_normal((3000, 64)) + 1.0).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in r], 0, "") for i, r in enumerate(x)], VECTORS)
    found = {}
    for r in ann.search(df, 20, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    y, hits = x.astype(float), 0
    for q in range(0, 3000, 20):
        products = y @ y[q]
        products[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-products, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * 150


def test_no_neighbours(spark):
    df = spark.createDataFrame(vectors_of(np.random.default_rng(10), 16), VECTORS)
    assert ann.search(df.limit(0), 20, F.col("vec_id") % 20 == 0).count() == 0
