"""Structured long words, which polynomial hashes modulo a power of two confuse, and many
rows without an id."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from risklens.llm import line_dedup, ngram_join, packing, suffix_dedup
from risklens.llm.textvec import Hasher


def twins(n):
    """Two words of 2 ** n letters: each letter of one is the other letter in the other."""
    one, two = "a", "b"
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"{w} plain words after it {n} times over.\nshort {n}" for n in (10, 11, 12) for w in twins(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)


def test_words_of_twins_differ():
    for n in range(4, 14):
        one, two = (np.frombuffer(t.encode(), dtype=np.uint8) for t in twins(n))
        for seed in (0, 1):
            a, b = (Hasher(seed).words(x, np.array([0]), np.array([len(x)]))[0] for x in (one, two))
            assert a != b, n
    assert Hasher(0).words(one, np.array([0]), np.array([len(one)]))[0] != Hasher(1).words(one, np.array([0]), np.array([len(one)]))[0]


def test_packing_gives_each_its_ids(docs):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_public(docs).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, dtype="<u4").tolist())
    for r in docs.collect():
        assert got[r.doc_id] == [*coder.encode(r.text, add_special_tokens=False).ids, 0]


def test_lines_and_documents_stay_apart(docs):
    assert {r.doc_id: r.text for r in line_dedup.lines_stage(docs.select("doc_id", "text")).collect()}.keys() == {0, 1, 2, 3, 4, 5}
    assert all(r.doc_id == r.component_id for r in ngram_join.join_query(docs).collect())


def test_repeats_equal_plain_form(docs):
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        raw = r.text.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            window = raw[s : s + 100]
            if window in seen:
                gone[s : s + 100] = True
            seen.add(window)
        want[r.doc_id] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])).hexdigest())
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.repeats_query(docs).collect()} == want


def test_rows_without_an_id_meet_their_own_sets_only(spark, words):
    import random

    rng = random.Random(3)
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    rows = [(None, f"{t} tail{j}") for t in base for j in range(8)] + [(i, t) for i, t in enumerate(base)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    sets = ngram_join._members
    made = []
    try:
        ngram_join._members = lambda *a: made.append(sets(*a)) or made[-1]
        got = ngram_join.jaccard_components(docs, ngram_join.JoinRules(3, 90)).collect()
    finally:
        ngram_join._members = sets
    assert made[0].count() == 40 * 9  # one row for each text, not for each pair
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.n_shingles} == set(range(40))
    nameless = spark.createDataFrame([r for r in rows if r[0] is None], "doc_id bigint, text string")
    assert {r.component_id for r in ngram_join.jaccard_components(nameless, ngram_join.JoinRules(3, 90)).collect()} == {None}
