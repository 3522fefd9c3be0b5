import random
import re

import numpy as np
import pytest

from risklens.llm import ngram_join
from risklens.llm.ngram_join import JoinRules, jaccard_components, join_query, join_stage, parity_keys, size_bands
from risklens.llm.records import components
from risklens.llm.textvec import mix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


def families(words, rng, n=40, copies=6):
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([2, 3, 6, 9, 15, 30, 80, 300]))]
        for _ in range(rng.randint(1, copies)):
            new = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                new[rng.randrange(len(new))] = rng.choice(words)
            if rng.random() < 0.2:
                new = new[rng.randint(0, len(new) // 8) :]
            base = new if rng.random() < 0.4 else base
            texts.append((" " if rng.random() < 0.9 else "\n\t ").join(new).upper() if rng.random() < 0.2 else " ".join(new))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_equals_all_pairs(spark, words, odd_texts, k, percent):
    texts = families(words, random.Random(k)) + odd_texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, JoinRules(k, percent)).collect()}
    assert got == brute(texts, k, percent)


def test_large_family_in_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    rng = random.Random(2)
    base, texts = [rng.choice(words) for _ in range(90)], []
    for i in range(60):
        new = list(base)
        for _ in range(rng.randint(1, 3)):
            new[rng.randrange(len(new))] = f"w{i}"
        texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for k, percent in ((3, 90), (3, 85)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, JoinRules(k, percent)).collect()}
        assert got == brute(texts, k, percent)


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    bands = size_bands(percent)
    for _ in range(300):
        n = int(rng.choice([3, 8, 12, 20, 45, 101, 400, 1500]))
        pool = mix(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        swap = int(rng.integers(0, max(1, n * (100 - percent) // 90) + 1))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[swap:n], pool[n : n + int(rng.integers(0, swap + 1))]]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < percent * (len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        shared = set()
        keys = []
        for s in (a, b):
            keys.append({int(x) for ahead in (0, 1) for x in parity_keys([s], percent, bands, ahead)[0]})
        shared = keys[0] & keys[1]
        assert shared, (n, len(a), len(b), common)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    label = {}
    for u, v in edges:
        if u != v:
            label.setdefault(u, u), label.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                changed = True
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.label for r in got} == label and len(got) == len(label)


def test_stage_and_odd_rows(spark, odd_docs, no_docs, odd_texts):
    assert join_query(no_docs).collect() == [] and join_stage(no_docs).collect() == []
    assert join_query(odd_docs).count() == odd_docs.count()
    out = join_stage(odd_docs)
    assert out.columns == odd_docs.columns
    want = {i for i, (_, c) in brute(odd_texts, 5, 80).items() if i == c}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in rows) == 1
    clash = odd_docs.selectExpr("*", "1 as node", "2 as _keep", "3 as component_id", "4 as _rep")
    assert join_query(clash).count() == odd_docs.count()


def test_hamming_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 1024, 1025, 5000):
        pool = mix(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        for swap in (0, 1, n // 10, n // 2):
            a, b = np.unique(pool[:n]), np.unique(pool[swap : n + swap])
            narrow, bodies = ngram_join.whole_sketches([a, b, a[:0]])
            x, y = (np.frombuffer(s, dtype=np.uint64) for s in bodies[:2])
            width = min(len(x), len(y))
            far = int(np.bitwise_count(ngram_join.fold(x, width) ^ ngram_join.fold(y, width)).sum())
            assert far <= len(np.setxor1d(a, b)) and (far == 0) == (swap == 0)
            assert np.array_equal(narrow[0], ngram_join.fold(x, ngram_join.SKETCH)) and not narrow[2].any()


def test_unrelated_sets_share_no_key():
    rng = np.random.default_rng(4)
    bands = size_bands(80)
    sets = [np.unique(mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))) for _ in range(600)]
    for ahead in (0, 1):
        key, owner = parity_keys(sets, 80, bands, ahead)
        # parts of one element are among the keys; ten bits of it are not enough
        assert len(np.unique(key)) == len(key) and len(np.unique(owner)) == len(sets)


def test_unrelated_sets_are_not_near_by_sketch():
    rng = np.random.default_rng(6)
    bands = size_bands(80)
    for n in (520, 700, 890, 1000, 1024, 1100, 4000):
        sets = [np.unique(mix(rng.integers(0, 1 << 62, n).astype(np.uint64))) for _ in range(120)]
        bodies = [np.frombuffer(b, dtype=np.uint64) for b in ngram_join.whole_sketches(sets)[1]]
        reach = int(ngram_join.band_reach(80, bands, np.searchsorted(bands, n, side="right")))  # the next band's
        assert ngram_join.walk_sketches(bodies, [reach + 2 * (reach // 4)] * len(sets)) == [], n


def test_sketches_of_one_key_in_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SKETCHES", 3)
    monkeypatch.setattr(ngram_join, "FLUSH", 400)
    rng = random.Random(5)
    passage = [rng.choice(words) for _ in range(40)]
    texts = families(words, rng, 12, 12)
    texts += [" ".join(passage + [f"{rng.choice(words)}{i}" for _ in range(rng.randint(0, 60))]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for k, percent in ((5, 80), (3, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, JoinRules(k, percent)).collect()}
        assert got == brute(texts, k, percent)
