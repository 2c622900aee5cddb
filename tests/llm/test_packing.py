import random
from collections import Counter, defaultdict

import public_tokenizers as P
from cases import documents
from tokenizers import Tokenizer

from vectrail.llm import packing as K


def test_plan_uses_every_piece():
    made = random.Random(4)
    for _ in range(60):
        counts = Counter(made.randint(1, 64) for _ in range(made.randint(0, 300)))
        bins = K.plan_bins(dict(counts), 64)
        used = Counter()
        for lengths, times in bins:
            assert sum(lengths) <= 64 and times > 0
            for n in lengths:
                used[n] += times
        assert used == counts
        low = -(-sum(n * c for n, c in counts.items()) // 64)
        assert low <= sum(t for _, t in bins) <= max(low * 1.25 + 1, sum(c for n, c in counts.items() if n > 32))


def test_two_for_one():
    # Greedy leaves 10 - 6 - 3 = 1 free; two pieces of 2 fill the gap of the 3.
    assert sorted(K.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0][0]) == [2, 2, 6]
    assert K.plan_bins({}, 10) == []


def test_pieces_and_places(spark):
    docs = documents(spark)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    K.BUCKET = 3
    rows = K.pack_documents(docs, P.path("byte_bpe_50k.json"), 2, 128).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= 128 and (r["piece"] == 0 or r["length"] == 128)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows)
    for r in docs.collect():
        n, at, k = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1, 0, 0
        while at < n:
            length = (n - at - 1) % 128 + 1 if not k else 128
            pieces[r["doc_id"], k, at, length] -= 1
            at, k = at + length, k + 1
    assert not any(pieces.values())
    assert K.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json"), 2, 128).count() == 0
