import hashlib
import random
import zlib

import numpy as np

from risklens.llm.periodic import kept_words, periodic_runs, runs_of, runs_query


def plain_runs(words):
    """All lags, all diagonals; of one stretch the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(6, 4 * q):
                best.setdefault((first - q, i), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
    best = (None,) * 4
    if runs:
        from fractions import Fraction

        s, l, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, l, q, 1000 * l // q)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_runs_equal_all_diagonals():
    rng = random.Random(3)
    for trial in range(400):
        words = []
        while len(words) < rng.randint(0, 160):
            if rng.random() < 0.5:
                words += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 9))]
            else:
                unit = [rng.randrange(rng.choice([2, 3, 40])) for _ in range(rng.randint(1, 12))]
                words += (unit * rng.randint(2, 9))[: rng.randint(1, 90)]
        ids = np.array(words, dtype=np.int64)
        assert runs_of(ids) == sorted(plain_runs(words), key=lambda r: (r[0], r[2])), words


def test_kept_words():
    assert kept_words(8, [(0, 6, 1)]).tolist() == [True] + [False] * 5 + [True, True]
    assert kept_words(0, []).tolist() == []


def test_query_equals_plain_form(spark, words):
    rng = random.Random(5)
    texts = {}
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            unit = [rng.choice(words) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(body))
            body[at:at] = unit * rng.randint(3, 12)
        texts[i] = rng.choice([" ", "  ", "\n", "\t\x0b"]).join(body) + rng.choice(["", " ", "\r\n"])
    rows = [(i, t, "x") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(5)
    out = {r.doc_id: tuple(r)[1:] for r in runs_query(docs).collect()}
    assert out == {i: expected(i, t) for i, t in texts.items()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and out[i][0] for i in out)


def test_odd_rows(spark, odd_docs, no_docs):
    assert runs_query(no_docs).collect() == [] and periodic_runs(no_docs).collect() == []
    rows = odd_docs.select("doc_id", "text").collect()
    have = sorted(map(str, (tuple(r) for r in runs_query(odd_docs).collect())))
    # the longest text is compared by its own test below
    want = sorted(str((r.doc_id, *expected(r.doc_id, r.text))) for r in rows if len((r.text or "").split()) < 3000)
    assert len(have) == len(rows) and set(want) <= set(have)


def test_frequent_words_cost_little():
    rng = np.random.default_rng(1)
    assert runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    ids = rng.integers(0, 3, 1000)
    ids = np.concatenate([ids, np.tile(rng.integers(0, 3, 777), 200), ids])
    s, l, q = max(runs_of(ids), key=lambda r: r[1])
    assert q == 777 and l >= 777 * 200 and s <= 1000
    twos = np.tile([0, 1], 100_000)
    assert runs_of(twos) == [(0, 200_000, 2)]


def test_real_outputs(spark):
    text = "start a b a b a b a b end"
    docs = spark.createDataFrame([(1, text, 9)], "doc_id bigint, text string, collapsed int")
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 8, 2)] and row.collapsed == "start a b end"
