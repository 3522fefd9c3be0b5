import random
import zlib

import pytest

from risklens.llm.compression import CompressionRules, held_out, labelled_sample, quality_scores, score_query, train_model


@pytest.fixture(scope="module")
def tables(spark, words):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1200):
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good = i % 4 != 0
        if not good:
            body = rng.choice([
                lambda: [w.upper() + "!!" for w in body], lambda: [x for w in body for x in (w, "|")], lambda: [w + rng.choice(["%%%", "***", "###"]) for w in body]
            ])()
        lines = [" ".join(body[k : k + 12]) + "." for k in range(0, len(body), 12)]
        docs.append((i, "\n".join(["The same first line everywhere."] + lines)))
        if i % 5 < 4:
            labels.append((i, int(good)))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
        spark.createDataFrame(labels, "doc_id bigint, quality int"),
        {i: int(i % 4 != 0) for i in range(1200)},
    )


def test_held_out_accuracy_and_calibration(spark, tables):
    docs, labels, truth = tables
    rows = score_query(docs, labels, CompressionRules(per_label=150)).collect()
    assert len(rows) == 1200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    good = [r.score for r in held if truth[r.doc_id]]
    assert sum(s > 0.9 for s in good) > 0.9 * len(good)


def test_held_out_labels_are_never_used(spark, tables):
    docs, labels, _ = tables
    flipped = labels.withColumn("quality", held_out(labels.doc_id).cast("int").bitwiseXOR(labels.quality))
    a = {r.doc_id: r.score for r in score_query(docs, labels).collect()}
    b = {r.doc_id: r.score for r in score_query(docs, flipped).collect()}
    assert a == b


def test_sample_is_bounded(spark, tables):
    docs, labels, _ = tables
    known = labels.selectExpr("doc_id", "quality as label")
    # copies of a document and of its label do not make the sample larger
    rules = CompressionRules(per_label=20)
    rows = labelled_sample(docs.union(docs).union(docs.selectExpr("doc_id", "concat(text, 'x')")), known.union(known), rules).collect()
    assert sorted((r.label, r.place) for r in rows) == [(c, n) for c in (0, 1) for n in range(1, 41)]
    small = labelled_sample(docs, known, CompressionRules(per_label=200, sample_bytes=5000)).collect()
    for c in (0, 1):
        for odd in (0, 1):
            assert 0 < sum(len(r.text.encode()) for r in small if r.label == c and r.place % 2 == odd) <= 5000


def test_length_does_not_matter_and_empty_texts_get_the_share(spark, tables):
    docs, labels, _ = tables
    model = train_model(docs, labels.selectExpr("doc_id", "quality as label"))
    clean, bad = docs.filter("doc_id = 1").first().text, docs.filter("doc_id = 4").first().text
    texts = {r.doc_id: r.text for r in docs.collect()}
    long = {c: "\n".join(t for i, t in texts.items() if (i % 4 != 0) == c) for c in (True, False)}
    rows = [(1, clean), (2, long[True]), (3, bad), (4, long[False]), (5, ""), (6, None), (None, " ")]
    out = quality_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    s = {r.doc_id: r.score for r in out}
    assert s[1] > 0.9 and s[2] > 0.9 and s[3] < 0.3 and s[4] < 0.3
    assert abs(s[5] - 0.75) < 0.05 and s[5] == s[6]


def test_odd_rows(spark, odd_docs, no_docs, tables):
    _, labels, _ = tables
    assert score_query(no_docs, labels).collect() == []
    clash = odd_docs.selectExpr("*", "1 as score", "2 as label", "3 as _id", "4 as place")
    assert score_query(clash, labels).count() == odd_docs.count()
    # without labels, with one label only, with labels of no document
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.selectExpr("doc_id + 100000 as doc_id", "quality")):
        rows = score_query(odd_docs, some).collect()
        assert len(rows) == odd_docs.count() and all(0 < r.score < 1 for r in rows)
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 0), (3, 1)], "doc_id bigint, quality int")
    assert score_query(odd_docs, nulls).count() == odd_docs.count()
