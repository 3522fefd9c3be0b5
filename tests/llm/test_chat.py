import random

from risklens.llm import chat
from risklens.llm.chat import chat_query, collapse_snapshots, prefix_hashes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def last(x):
    return (x is None, x if x is not None else 0)


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((last(t), (r is None, r or ""), (x is None, x or "")))
    convs = {c: [v[1:] for v in sorted(turns)] for c, turns in convs.items()}
    keep = []
    for c, a in convs.items():
        if any(len(b) > len(a) and b[: len(a)] == a for b in convs.values()):
            continue
        if any(b == a and last(d) < last(c) for d, b in convs.items()):
            continue
        keep.append(c)
    out = set()
    for c in keep:
        for i, ((rn, r), (_, x)) in enumerate(convs[c]):
            out.add((c, i + 1, len(convs[c]), None if rn else r, f"<|{'unknown' if rn else r}|>\n{x}<|end|>\n"))
    return out


def run(spark, rows):
    return {tuple(r) for r in chat_query(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_snapshots(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        seed = rng.randint(0, 5)
        n, first = rng.randint(1, 7), rng.choice([0, 1, 10])
        for t in range(n):
            role = "user" if t % 2 == 0 else "assistant"
            text = f"s{seed} t{t}" + (" other" if rng.random() < 0.1 else "")
            rows.append((c, first + t, role, text))
    rows += [(100, 0, None, None), (101, 0, "", ""), (102, 0, "user", None), (103, 0, None, "user")]
    rows += [(None, 0, "user", "alone"), (104, None, "user", "late"), (104, 1, "user", "tie"), (104, 1, "user", "tie b")]
    rows += rows[:5]
    assert run(spark, rows) == brute(rows)


def test_long_conversation_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_TURNS", 4)
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 30), (2, 17), (3, 31), (4, 31)) for t in range(n)]
    rows += [(5, t, "user", f"turn {t}" if t != 13 else "changed") for t in range(20)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing(spark):
    assert run(spark, []) == set()
    rows = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "b")], SCHEMA)
    clash = rows.selectExpr("*", "1 as position", "2 as h1", "3 as _key", "4 as n_turns")
    assert {r.conv_id for r in collapse_snapshots(clash).collect()} == {2}
    assert prefix_hashes(clash).count() == 3
