import hashlib
import random

import numpy as np
import pytest

from risklens.llm import suffix_dedup
from risklens.llm.suffix_dedup import SuffixSorter, anchors, difference_cover, meeting_distance, remove_repeats, repeats_query


def brute(texts, length):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(words, rng):
    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [prose(rng.randint(15, 60)) for _ in range(4)]
    texts = []
    for _ in range(60):
        kind = rng.random()
        if kind < 0.3:
            texts.append(prose(rng.randint(1, 80)))
        elif kind < 0.6:
            texts.append(prose(rng.randint(0, 30)) + " " + rng.choice(shared) + " " + prose(rng.randint(0, 30)))
        elif kind < 0.75 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.9 and texts:
            t = rng.choice(texts)
            k = rng.randint(0, len(t))
            texts.append(t[:k] + "#" + t[k:])
        else:
            unit = prose(rng.randint(1, 4))[: rng.randint(1, 30)]
            texts.append(prose(3) + (unit + " ") * rng.randint(1, 60) + prose(3))
    return texts + ["a" * 700, "a" * 99, "a" * 100, "b" * 101, "ab" * 300, "abc" * 200, "x" * 50 + "a" * 120]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, words, odd_texts, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_BLOCK", 300)
    texts = corpus(words, random.Random(seed)) + odd_texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in repeats_query(docs).collect()}
    assert got == brute(texts, 100)


def test_odd_rows(spark, odd_docs, no_docs):
    assert repeats_query(no_docs).collect() == []
    rows = repeats_query(odd_docs.selectExpr("*", "1 as doc", "2 as lo", "3 as _doc", "4 as kept")).collect()
    assert len(rows) == odd_docs.count()
    long = "no id here but a long text " * 10
    nameless = spark.createDataFrame([(None, long), (3, long), (3, long), (4, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed) for r in repeats_query(nameless).collect())
    periodic = brute([long], 100)[0][1]
    assert [g[1] for g in got] == [periodic, periodic, 0, len(long)]


def test_spans_and_kept_make_up_the_text(spark, words):
    texts = corpus(words, random.Random(9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in remove_repeats(docs, 64).collect():
        raw, out, at = texts[r.doc_id].encode(), b"", 0
        for s in r.spans:
            assert s.start >= at and s.end > s.start
            out += raw[at : s.start]
            at = s.end
        assert out + raw[at:] == bytes(r.kept) and r.n_bytes == len(raw)


def test_cover():
    for v in (32, 64):
        cover = difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) < v / 2
        table = meeting_distance(v, cover)
        assert (table >= 0).all() and all((a + table[a, b]) % v in cover and (b + table[a, b]) % v in cover for a in range(v) for b in range(v))


def test_sorter_orders_suffixes():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 4):
        unit = rng.integers(97, 97 + alphabet, 90).astype(np.uint8)
        data = np.concatenate([unit, rng.integers(97, 100, 60).astype(np.uint8), unit, unit, np.full(150, 97, np.uint8), unit])
        at = np.arange(len(data) - 100)
        order = SuffixSorter(data).sort(at)
        raw = data.tobytes()
        got = [raw[p : p + 100] for p in at[order].tolist()]
        assert got == sorted(got)


def test_anchors_are_leftmost_minima():
    rng = np.random.default_rng(5)
    for high in (3, 1 << 40):
        kh = rng.integers(0, high, 900).astype(np.uint64) << np.uint64(8)
        got = anchors(kh, 77)
        assert got.tolist() == [i + int(np.argmin(kh[i : i + 77])) for i in range(len(kh) - 76)]


@pytest.mark.parametrize("tails", [("00003bb9", "0000a3c5"), ("00004cef", "0001495b"), ("00014538", "0001cf48")])
def test_runs_that_agree_in_32_bits(spark, tails):
    """One anchor, one window count, and bodies whose first hash agrees in its top 32 bits."""
    front = "this passage of one hundred bytes stands in front of every text of the pair and holds the common anchor of both runs "
    texts = [front + t for t in tails]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r[0]: tuple(r)[1:] for r in repeats_query(docs).collect()} == brute(texts, 100)


@pytest.mark.parametrize("hot", [1, 20])
def test_hot_anchors_are_split(spark, words, hot, monkeypatch):
    """A passage of most texts: its edges differ everywhere, and no suffix bucket gets them all."""
    rng = random.Random(hot)
    passage = " ".join(rng.choice(words) for _ in range(40))
    ends = ["", "one same end of many texts ", "y" * 60]
    texts = [f"{rng.randrange(10**12)} {rng.choice(ends)}{passage}{rng.choice(ends)} {rng.randrange(10**12)}" for _ in range(90)] + corpus(words, rng)
    sizes = []
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    whole = suffix_dedup._texts_of_open
    monkeypatch.setattr(suffix_dedup, "_texts_of_open", lambda d, runs, *a: sizes.append(runs.groupBy("anchor").count().agg({"count": "max"}).first()[0]) or whole(d, runs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    assert {r[0]: tuple(r)[1:] for r in repeats_query(docs).collect()} == brute(texts, 100)
    assert len(sizes) == 1 and (sizes[0] or 0) <= hot


def test_hot_anchors_whose_pieces_are_not_hot(spark, words, monkeypatch):
    """Runs of a hot anchor part by their edges into pieces that settle in suffix buckets."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abc") for _ in range(110))
    texts = []
    for k in range(60):
        left, right = ("".join(rng.choice("abc") for _ in range(12)) for _ in range(2))
        cut = rng.randint(0, 60)
        texts.append(left + passage[cut:] + right if k % 2 else left + passage[: 110 - cut] + right + left)
    texts += corpus(words, rng)
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 20)
    pieces_hot = []
    split = suffix_dedup._split
    monkeypatch.setattr(suffix_dedup, "_split", lambda d, hot, length, width: pieces_hot.append(width) or split(d, hot, length, width))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r[0]: tuple(r)[1:] for r in repeats_query(docs).collect()} == brute(texts, 100)
    assert pieces_hot == [suffix_dedup.PIECE]


def test_rows_without_an_id_or_with_one_id_are_documents(spark, words):
    rng = random.Random(12)
    a, b, c, d = (" ".join(rng.choice(words) for _ in range(40)) for _ in range(4))
    rows = [(1, a), (1, b), (1, c + a), (None, b + d), (None, c), (None, None), (None, d), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_bytes - r.n_removed) for r in repeats_query(docs).collect()]
    sizes = [len(x.encode()) for x in (a, b, c, d)]
    assert sorted(n for _, n, _ in got) == sorted(len((t or "").encode()) for _, t in rows)
    assert all(k >= 0 for _, _, k in got) and sum(k for _, _, k in got) == sum(sizes)
