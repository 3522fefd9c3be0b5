import random
import re

import numpy as np
import pytest

from risklens.llm import line_dedup
from risklens.llm.line_dedup import LineRules, lines_query, lines_stage, remove_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, rules=LineRules()):
    earlier, out = [], {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = []
        for k, line in enumerate(lines):
            words = frozenset(WORD.findall(line))
            if len(words) < rules.min_tokens:
                continue
            if any(100 * len(words & e) >= rules.percent * len(words | e) for e in earlier):
                gone.append(k)
            earlier.append(words)
        out[i] = (len(lines), gone, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def corpus(words, rng, n=70):
    pool, texts = [], []
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.45 or not pool:
                line = [rng.choice(words) for _ in range(rng.choice([1, 4, 6, 10, 25, 60, 200]))]
            else:
                line = list(rng.choice(pool))
                for _ in range(rng.randint(0, 1 + len(line) // 10)):
                    if kind < 0.9:
                        line[rng.randrange(len(line))] = rng.choice(words)
            pool.append(line)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  ", "\r"]))
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("percent,least", [(80, 5), (60, 2), (95, 1)])
def test_equals_all_pairs(spark, words, odd_texts, percent, least):
    texts = corpus(words, random.Random(percent)) + odd_texts
    rules = LineRules(percent, least)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    want = brute(texts, rules)
    for r in remove_lines(docs, rules).collect():
        assert (r.removed, r.text) == want[r.doc_id][1:], r.doc_id


def test_large_family(spark, words):
    rng = random.Random(3)
    base = [rng.choice(words) for _ in range(40)]
    texts = []
    for i in range(120):
        new = list(base)
        for _ in range(rng.randint(0, 5)):
            new[rng.randrange(40)] = f"new{i}x{rng.randint(0, 9)}"
        texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    want = brute(texts)
    assert {r.doc_id: r.n_removed for r in lines_query(docs).collect()} == {i: len(w[1]) for i, w in want.items()}


def test_odd_rows_and_stage(spark, odd_docs, no_docs, odd_texts):
    assert lines_query(no_docs).collect() == [] and lines_stage(no_docs).collect() == []
    once = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines_query(once).collect()}
    want = brute(odd_texts)
    assert got == {i: (n, len(gone), t) for i, (n, gone, t) in want.items()}
    stage = lines_stage(odd_docs)
    assert stage.columns == odd_docs.columns
    ids = [r.doc_id for r in stage.collect()]
    assert ids.count(9) == 0 or ids.count(9) == 2
    assert 0 in ids and 1 in ids and 8 not in ids
    clash = odd_docs.selectExpr("*", "1 as removed", "2 as line", "3 as doc", "4 as set")
    assert remove_lines(clash).count() == odd_docs.count()


def test_short_lines(spark):
    """Furniture of few distinct words, and a four-word line that is near a five-word one."""
    menu, few = "Home | About", "spam ham eggs tea " * 125
    texts = [f"{menu}\nthe first text has words of its own\nAll rights reserved.", f"{menu}\n{few}\nMore", f"all rights reserved.\n{few}\nMore",
             "More\nAll  rights reserved.\nspam ham eggs tea milk", menu, "Home"]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = {r.doc_id: (r.n_removed, r.text) for r in lines_query(docs).collect()}
    assert got == {0: (0, texts[0]), 1: (1, f"{few}\nMore"), 2: (2, "all rights reserved."), 3: (3, ""), 4: (1, ""), 5: (0, "Home")}
    assert {r.doc_id for r in lines_stage(docs).collect()} == {0, 1, 2, 5}


def test_rows_without_an_id_or_with_one_id_are_documents(spark):
    one, two, same = "first line of its own", "second one of another kind", "a line that all of them hold"
    rows = [(1, f"{same}\n{one}"), (2, f"{same}\nsome words"), (2, f"{two}\nyet more of it"), (None, f"{same}\nthird thing"), (None, "fourth\nfifth"),
            (None, None), (None, "sixth is twice here"), (None, "sixth is twice here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id or 9, r.removed, r.text or "") for r in remove_lines(docs).collect())
    assert got == sorted([(1, [], rows[0][1]), (2, [0], "some words"), (2, [], rows[2][1]), (9, [0], "third thing"), (9, [], "fourth\nfifth"),
                          (9, [], ""), (9, [], "sixth is twice here"), (9, [0], "")])


def test_a_scanning_task_works_on_little_at_a_time(words):
    """Texts of 6 MB: lines are held with their prefix tokens, and packed a few buckets at a time."""
    import tracemalloc

    import pyarrow as pa

    class Task:
        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(4)
    many = [f"{w}{i}" for w in words for i in range(50)]
    texts = ["\n".join(" ".join(rng.choices(many, k=12)) for _ in range(60)) for _ in range(1000)]
    ids = pa.array(range(1000), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc", "tie", "text"])
    run = line_dedup._scan(Task(), np.arange(line_dedup.RARITY_RANGES, dtype=np.uint64), line_dedup.LineRules())
    tracemalloc.start()
    try:
        blocks = sum(len(p) for b in run(iter([batch])) for p in b.column("payload").to_pylist() if p is not None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert blocks // line_dedup.TOKEN.itemsize == sum(12 - -(-12 * 80 // 100) + 1 for _ in range(60000))
    assert peak < 130 << 20


def test_results_do_not_depend_on_how_much_meets_at_once(spark, words, monkeypatch):
    rng = random.Random(5)
    base = [rng.sample(words, 12) for _ in range(40)]
    lines = lambda: [" ".join(w if rng.random() > 0.06 else rng.choice(words) for w in rng.choice(base)) for _ in range(rng.randint(1, 6))]
    docs = spark.createDataFrame([(i, "\n".join(lines())) for i in range(200)], "doc_id bigint, text string").repartition(3)
    want = sorted(map(tuple, line_dedup.lines_query(docs).collect()))
    monkeypatch.setattr(line_dedup, "AT_ONCE", 3)
    monkeypatch.setattr(line_dedup, "FLUSH", 50)
    assert sorted(map(tuple, line_dedup.lines_query(docs).collect())) == want
    assert sum(r[2] for r in want) > 100
