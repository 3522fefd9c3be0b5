import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from risklens.llm.packing import PackRules, choose_cuts, pack_public, pack_query


@pytest.fixture(scope="module")
def coder():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check_pieces(rows, texts, coder, window=1024):
    want = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in texts.items()}
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(parts) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return seqs


def test_every_id_once(spark, odd_docs, odd_texts, coder):
    once = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    rows = pack_query(once).collect()
    seqs = check_pieces(rows, dict(enumerate(odd_texts)), coder)
    assert sum(r.length for r in rows) > 0.9 * 1024 * (len(seqs) - 1)


def test_odd_rows_and_columns(spark, odd_docs, odd_texts, no_docs):
    rows = pack_query(odd_docs.coalesce(1)).collect()
    assert sum(r.length == r.doc_tokens == 1 for r in rows) == 2  # the null and the empty text
    assert any(r.doc_id is None for r in rows)
    assert pack_query(no_docs).collect() == []
    clash = odd_docs.selectExpr("*", "1 as ids", "2 as sequence_id", "3 as start", "4 as offset")
    assert len(pack_query(clash.coalesce(1)).collect()) == len(rows)


def test_order_is_kept(spark, odd_docs):
    rows = pack_public(odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").coalesce(1)).collect()
    placed = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert placed == sorted(placed)


def test_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.randint(4, 20)
        at = [0]
        for _ in range(rng.randint(1, 14)):
            at.append(at[-1] + rng.randint(1, window))
        fines = [rng.choice([0, 2, 7]) for _ in at]
        cost = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            cost[j] = min(cost[i] + window - (at[j] - at[i]) + fines[j] for i in range(j) if at[j] - at[i] <= window)
        cuts = choose_cuts(np.array(at), np.array(fines), window)
        total, last = 0, 0
        for j in cuts:
            assert at[j] - at[last] <= window
            total += window - (at[j] - at[last]) + fines[j]
            last = j
        assert last == len(at) - 1 and total == cost[-1]


def test_cuts_prefer_documents(spark, words):
    text = " ".join(words[:60]) + "."
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id bigint, text string").coalesce(1)
    rows = pack_public(docs, PackRules(sentence=2000, forced=5000)).collect()
    assert all(r.length == r.doc_tokens for r in rows)
