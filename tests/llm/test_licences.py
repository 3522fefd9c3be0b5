import random

import pytest

from risklens.llm.licences import FAMILIES, TEMPLATES, LicenceRules, find_licences, licence_query, train_model


@pytest.fixture(scope="module")
def corpus(spark, words):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows, truth = [], {}
    for i in range(900):
        lines = [prose(rng.randint(5, 80)) for _ in range(rng.randint(1, 5))]
        if i % 10 == 0:
            family = FAMILIES[i // 10 % len(FAMILIES)]
            stated = TEMPLATES[family][i // 90 % len(TEMPLATES[family])]
            k = rng.randrange(len(lines) + 1)
            if i % 20 == 0:
                stated = prose(rng.randint(10, 60)) + " " + stated + " " + prose(rng.randint(10, 60))
            lines.insert(k, stated)
            truth[i] = (k, family)
        rows.append((i, "\n".join(lines)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), truth


def test_finds_families_and_leaves_prose_alone(spark, corpus):
    docs, truth = corpus
    rows = licence_query(docs).collect()
    found = {r.doc_id: (r.paragraph, r.family) for r in rows if r.confirmed}
    assert not set(found) - set(truth)
    assert sum(found.get(i) == want for i, want in truth.items()) >= 0.9 * len(truth)
    assert sum(found.get(i, (None,))[0] == want[0] for i, want in truth.items()) >= 0.95 * len(truth)
    for r in rows:
        assert 0 < r.probability <= 1 and r.confirmed == (r.similarity >= 60)


def test_odd_rows(spark, corpus, odd_docs, no_docs):
    docs, _ = corpus
    model = train_model(docs)
    assert find_licences(no_docs, model).collect() == []
    assert find_licences(odd_docs, model).filter("confirmed").collect() == []
    assert licence_query(no_docs).collect() == []
    line = "Released under the MIT License."
    rows = [(1, line), (1, line), (None, f"\n\n{line}"), (2, "mit License"), (3, f"{line}\n{line}"), (4, "x " * 5000 + line)]
    got = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as family", "2 as paragraph")
    found = find_licences(got, model, LicenceRules()).filter("confirmed").collect()
    assert sorted(((r.doc_id or -1), r.paragraph, r.family) for r in found) == [
        (-1, 2, "MIT"), (1, 0, "MIT"), (1, 0, "MIT"), (3, 0, "MIT"), (3, 1, "MIT"), (4, 0, "MIT")
    ]
    assert next(r.first_word for r in found if r.doc_id == 4) > 4900


def test_every_paragraph_trains_and_tasks_do_not_matter(spark, words):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, f"{prose(12)}\n{prose(60)}\n{prose(30)} version two of the terms") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first_lines = spark.createDataFrame([(i, t.split("\n")[0]) for i, t in rows], "doc_id bigint, text string")
    stated = [t for ts in TEMPLATES.values() for t in ts]
    probe = spark.createDataFrame([(i, f"{prose(8)} {t}") for i, t in enumerate(stated)], "doc_id bigint, text string")

    def found(table):
        return sorted((r.doc_id, r.family, r.probability) for r in find_licences(probe, train_model(table)).collect())

    want = found(docs)
    assert len(want) > 0.8 * len(stated)
    assert found(docs.repartition(7)) == want  # sums in fixed point: equal to the last bit
    assert found(first_lines) != want  # further lines of a document train too
