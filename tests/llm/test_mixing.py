import random

import numpy as np
import pytest

from risklens.llm.mixing import MixRules, domains_of, fit_rates, mix_query, mix_stage, mixing_rates


@pytest.fixture(scope="module")
def tables(spark, words):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        kind = rng.choice(["clean"] * 6 + ["low"] * 2 + ["toxic"] * 2)
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        extra = {"clean": [], "low": ["%%%", "&&&", "***"], "toxic": ["vile1", "vile2", "vile3"]}[kind]
        for w in extra:
            for _ in range(2):
                text[rng.randrange(len(text))] = w
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 0 if kind == "low" else 1, 1 if kind == "toxic" else 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_targets_and_held_out_accuracy(spark, tables):
    docs, labels = tables
    seen = labels.filter("doc_id % 2 = 0")
    rules = MixRules({"clean": 0.9, "low": 0.06, "toxic": 0.04}, per_domain=60)
    rows = mix_query(docs, seen, rules).collect()
    assert len(rows) == 600
    total = sum(r.n_tokens for r in rows)
    for name, share in rules.targets.items():
        reached = sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows)
        assert abs(reached - share * total) < 1e-4 * total
    truth = {r.doc_id: r.domain for r in domains_of(labels).collect()}
    held = [r for r in rows if r.doc_id % 2]
    right = sum(max(rules.targets, key=lambda d: r[f"p_{d}"]) == truth[r.doc_id] for r in held)
    assert right >= 0.9 * len(held)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    clean = [r.copies for r in held if truth[r.doc_id] == "clean"]
    assert np.mean([c >= 1 for c in clean]) > 0.95


def test_fit_equals_bounded_least_squares(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 40)
    n = rng.integers(1, 100, 40)
    soft = spark.createDataFrame([(i, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(n, p))], "doc_id bigint, n_tokens bigint, p array<double>")
    for shares, high in (([0.5, 0.3, 0.2], 4.0), ([0.9, 0.05, 0.05], 1.6), ([0.0, 0.0, 1.0], 4.0)):
        fitted, reached = fit_rates(soft, shares, MixRules(max_rate=high, rounds=80))
        rate = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
        u = p * n[:, None]
        inverse = np.linalg.inv((u / n[:, None]).T @ u)
        own = np.ones(40)
        for _ in range(20000):
            own = np.clip(own - p @ inverse @ (own @ u - np.array(shares) * n.sum()), 0, high)
        miss = lambda r: (r @ u - np.array(shares) * n.sum()) @ inverse @ (r @ u - np.array(shares) * n.sum())
        assert (rate >= 0).all() and (rate <= high).all()
        assert miss(rate) <= miss(own) + 0.02 * miss(np.ones(40)) + 1e-6


def test_stage(spark, tables, no_docs, odd_docs):
    docs, labels = tables
    rules = MixRules({"clean": 0.9, "low": 0.06, "toxic": 0.04})
    copies = {r.doc_id: r.copies for r in mix_query(docs, labels, rules).collect()}
    out = mix_stage(docs, labels, rules)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    assert mix_stage(no_docs, labels).collect() == [] and mix_query(no_docs, labels).collect() == []
    assert mix_query(odd_docs, labels).count() == odd_docs.count()
    clash = odd_docs.selectExpr("*", "1 as p", "2 as rate", "3 as domain", "4 as _id0")
    assert mix_query(clash, labels.limit(0)).count() == odd_docs.count()
    nulls = spark.createDataFrame([(0, None, None), (None, 1, 1), (1, 0, None)], labels.schema)
    assert mixing_rates(odd_docs, domains_of(nulls)).count() == odd_docs.count()
