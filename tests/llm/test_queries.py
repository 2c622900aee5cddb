"""The registered queries' own columns against plain computations over the smallest tables."""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import table
from tokenizers import Tokenizer

from vectrail.llm import langid as L
from vectrail.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").select("doc_id", "text").collect()}


def ids_of(name, text, end):
    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    return {d: np.array([*e.ids, end], "<u4") for d, e in zip(text, tokenizer.encode_batch(list(text.values()), add_special_tokens=False), strict=True)}


def test_op2(spark, docs):
    at, wanted = 0, []
    for d, ids in sorted(ids_of("word_bpe_49k.json", docs, 1).items()):
        wanted.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(Q.op2_sst_token_shards(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == wanted


def test_op4(spark, docs):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in Q.op4_byte_bpe(spark, SMALL).collect()}
    assert set(rows) == set(docs)
    for d, text in docs.items():
        ids = tik.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (rows[d]["n_tokens"], rows[d]["ids_sha256"], rows[d]["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())


def test_op5(spark, docs):
    wanted, total = set(), 0
    for d, ids in ids_of("byte_bpe_50k.json", docs, 2).items():
        at, k, total = 0, 0, total + len(ids)
        while at < len(ids):
            n = (len(ids) - at - 1) % 1024 + 1 if not k else 1024
            wanted.add((d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, k = at + n, k + 1
    rows = Q.op5_best_two_fit_packing(spark, SMALL).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted and len(rows) == len(wanted)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 1024) * 1.02 + 1


def test_op6_learns_what_a_plain_count_learns(spark, docs):
    """Profiles by counting strings, with all labelled documents (there are fewer than the sample)."""
    from collections import Counter

    rows = table(spark, "documents").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            for word in re.findall(r"[^\W\d_]+", r["text"].lower()):
                for n in (1, 2, 3):
                    for at in range(len(word) + 3 - n):
                        gram = f"_{word}_"[at : at + n]
                        if gram != "_":
                            counts.setdefault(r["lang"], Counter())[gram] += 1
    wanted = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], [ord(y) for y in x[0]]))[: L.PROFILE]] for lang, c in counts.items()}

    def shown(code):
        return "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0) if code >> s & 0x1FFFFF)

    learned = L.learn(table(spark, "documents"))
    assert {lang: [shown(g) for g, _ in sorted(p.items(), key=lambda x: x[1])] for lang, p in learned.items()} == wanted
    found = Q.op6_rank_order_language(spark, SMALL).collect()
    assert len(found) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    truth = {r["doc_id"]: r["lang"] for r in rows}
    judged = [r for r in found if r["held_out"] and truth[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in judged) >= 0.95 * len(judged)


def test_op8(spark, docs):
    from test_text_scans import base_spans

    rows = {r["doc_id"]: r for r in Q.op8_secret_spans(spark, SMALL).collect()}
    assert set(rows) == set(docs)
    for d, text in docs.items():
        spans = base_spans(text)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[d]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [rows[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(filter(None, shown.split(","))) <= set(rows[d]["spans"].split(","))


def test_op9(spark, docs):
    rows = Q.op9_simhash_gray_index(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in rows)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: find(d) for d in prints}


def test_op7_and_op10(spark):
    rows = table(spark, "embeddings").select("vec_id", "embedding", "label").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([r["label"] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None])
    found = {r["vec_id"]: r for r in Q.op7_epsilon_grid_join(spark, SMALL).collect()}
    assert {i: found[i]["n_links"] for i in ids.tolist()} == dict(zip(ids.tolist(), (linked.sum(axis=1) - 1).tolist(), strict=True))
    got = {}
    for r in Q.op10_adaptive_dimension_scan(spark, SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    place = {i: k for k, i in enumerate(ids.tolist())}
    for i in ids[ids % 20 == 0].tolist():
        products = x @ x[place[i]]
        products[place[i]] = -np.inf
        best = np.sort(products)[-20]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(products[place[v]] - s) < 1e-9 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += sum(s >= best - 1e-9 for _, _, s in mine)
    assert hits >= 0.9 * 20 * len(got)


def test_clashing_names(spark):
    """Columns with the names that operators use inside stay what they were."""
    from vectrail.llm import license_scan, secrets, simhash

    names = ["v_uid", "v_lang", "v_score", "v_text", "v_source", "v_made", "v_words", "v_at", "v_word", "v_rare", "v_part", "v_row", "v_doc", "v_at0"]
    some = spark.createDataFrame([(i, f"the cat and the dog number {i} MIT license", "en", *[f"{n}{i}" for n in names]) for i in range(6)], f"doc_id bigint, text string, lang string, {', '.join(f'{n} string' for n in names)}")
    for stage in (L.reject_unidentified, simhash.deduplicate, secrets.redact):
        rows = stage(some).collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    for rows in (license_scan.scan(some, ["doc_id", *names]).collect(), secrets.scan(some, ["doc_id", *names]).collect(), L.predict(some, ["doc_id", *names], {}).collect(), simhash.fingerprints(some, ["doc_id", *names]).collect()):
        assert len(rows) == 6 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
