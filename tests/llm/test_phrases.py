import random
import re
from collections import Counter

import pytest

from risklens.llm import phrases
from risklens.llm.phrases import Filter, PhraseRules, collocations, frequent_keys, phrase_counts

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows, bar, top=4):
    found, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, top + 1):
                for i in range(len(w) - k + 1):
                    found[lang, " ".join(w[i : i + k])] += 1
    return {k: v for k, v in found.items() if v >= bar}, {k: v for k, v in total.items() if v}


def plain_collocations(rows, rules):
    f, n = plain_counts(rows, rules.min_count, rules.max_words)
    out = {}
    many = {k: v for k, v in f.items() if " " in k[1]}
    for (lang, phrase), a in many.items():
        w = phrase.split(" ")
        if any(
            z == lang and len(q.split(" ")) > len(w) and 100 * c >= rules.covered_pct * a
            and any(q.split(" ")[i : i + len(w)] == w for i in range(len(q.split(" ")))) for (z, q), c in many.items()
        ):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[: rules.per_lang])
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    # "red" and "Red" are one word; a mark inside a number ends a piece
    few = ["the", "red", "Red", "fox", "in", "é", "3.14", "a", "of", "York", "new"]
    out = []
    for i in range(700):
        w = [rng.choice(few) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randint(0, 60))]
        for at in range(0, len(w), 9):
            w[at:at] = rng.choice([["new", "York", "city", "hall"], ["in", "the", "middle", "of", "a"], ["once", "More"], []])
        text = "".join(x + rng.choice([" "] * 12 + [", ", "\t", "  ", ". ", "\n", "; ", "!"]) for x in w)
        out.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)


def as_dict(df):
    got = df.collect()
    return {(r.lang, r.phrase): r.f for r in got if r.phrase is not None}, {r.lang: r.f for r in got if r.phrase is None}


@pytest.mark.parametrize("rules", [
    PhraseRules(), PhraseRules(sample_one_in=200), PhraseRules(sample_one_in=10**9), PhraseRules(sample_one_in=1, lowered=1.0, filter_bits=16),
    PhraseRules(min_count=7, max_words=3, filter_bits=18),
])
def test_counts_equal_plain_counting(spark, rows, docs, rules):
    assert as_dict(phrase_counts(docs, rules)) == plain_counts([r[1:] for r in rows], rules.min_count, rules.max_words)


def test_failures_of_the_border_bring_further_passes(docs):
    assert frequent_keys(docs, PhraseRules(sample_one_in=1, lowered=1.0))[1] == 1
    assert frequent_keys(docs, PhraseRules(sample_one_in=10**9))[1] == 4  # an empty proposal: one pass for each length


@pytest.mark.parametrize("rules", [PhraseRules(), PhraseRules(per_lang=3, min_count=12)])
def test_collocations_equal_plain_form(rows, docs, rules):
    got = sorted(tuple(r) for r in collocations(phrase_counts(docs, rules), rules).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations([r[1:] for r in rows], rules) and len(got) > 5


def test_large_counts_are_exact(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("x", "a b", 2, big), ("x", "a", 1, big + 1), ("x", "b", 1, big + 2), ("x", None, 0, 4 * big)], "lang string, phrase string, n_words int, f bigint")
    row = collocations(counts).first()
    assert row.score == 2000000 * big // (2 * big + 3) and row.n == 4 * big


def test_odd_rows(spark, odd_docs, no_docs):
    assert phrase_counts(no_docs).collect() == [] and collocations(phrase_counts(no_docs)).collect() == []
    rules = PhraseRules(min_count=2)
    own = [(r.text, r.lang) for r in odd_docs.select("text", "lang").collect()]
    clash = odd_docs.selectExpr("*", "1 as phrase", "2 as key", "3 as n", "4 as f")
    assert as_dict(phrase_counts(clash, rules)) == plain_counts(own, 2)


def test_structured_long_words_stay_apart(spark):
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    docs = spark.createDataFrame([(i, f"{one if i % 2 else two} end", "en") for i in range(8)], "doc_id bigint, text string, lang string")
    counts, _ = as_dict(phrase_counts(docs, PhraseRules(min_count=3)))
    assert counts["en", one] == counts["en", f"{two} end"] == 4 and counts["en", "end"] == 8


def test_filter_holds_what_it_was_given(spark):
    import numpy as np

    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    filled = Filter(20).joined(spark.createDataFrame([(int(k),) for k in keys] + [(0,), (-1,)], "key bigint"))
    assert filled.has(keys.view(np.uint64)).all() and filled.has(np.array([0, 2**64 - 1], dtype=np.uint64)).all()
    assert np.bitwise_count(filled.bytes).sum() <= 502


def test_words_of_a_phrase_are_sent_about_once(spark, monkeypatch):
    # 40 tasks each hold nearly every frequent phrase: once from each task would be 40 times the phrases
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{rng.randint(0, 11)}" for _ in range(60)), "en") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(40)
    sent, plain = spark.sparkContext.accumulator(0), type(docs).mapInArrow

    def counting(df, run, schema, *rest):
        def counted(batches):
            for b in run(batches):
                sent.add(b.num_rows if "phrase string" in schema else 0)
                yield b

        return plain(df, counted, schema, *rest)

    monkeypatch.setattr(type(docs), "mapInArrow", counting)
    f, totals = as_dict(phrase_counts(docs))
    assert (f, totals) == plain_counts([r[1:] for r in rows], 30) and len(f) > 1500
    assert sent.value < 4 * len(f)


def test_phrases_of_one_key_are_counted_apart():
    import numpy as np

    keys, marks, shares = np.array([9, 4, 9, 9, 4, 9], dtype=np.uint64), np.array([1, 5, -2, 1, 5, -2], dtype=np.int32), np.array([7, 3, 2, 6, 8, 4], dtype=np.int16)
    got = [x.tolist() for x in phrases.distinct(keys, marks, shares)]
    assert got == [[4, 9, 9], [5, -2, 1], [2, 2, 2], [3, 2, 6]]
    none = phrases.distinct(keys[:0], marks[:0], shares[:0])
    assert [len(x) for x in none] == [0, 0, 0, 0]


def test_marks_are_of_the_words_and_not_of_the_key():
    import numpy as np
    import pyarrow as pa

    from risklens.llm.textvec import Hasher

    texts, langs = ["new York city", "x  new york", "york new", "new york"], ["en", "en", "en", "fr"]
    grams = phrases.Grams(pa.RecordBatch.from_pydict({"text": texts, "lang": langs}), Hasher())
    at = np.array([0, 4, 6, 8])
    marks = grams.marks(at, 2, Hasher(1)).tolist()
    assert marks[0] == marks[1] and len(set(marks)) == 3
    grams.word[:] = 0  # every key of two words is one
    assert len({int(h[0]) for k, _, h in grams.of(2) if k == 2}) == 1 and grams.marks(at, 2, Hasher(1)).tolist() == marks
