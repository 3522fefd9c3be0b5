"""Stages keep every column, whatever its name, and judge rows without an id one by one."""

import pytest

from risklens.llm import line_dedup, mixing, ngram_join, quality

NAMES = [
    "_quality", "quality", "_removed", "removed", "_repeated", "repeated", "_kept_id", "kept_id", "_copies", "copies", "copy", "_id",
    "text_hash", "component_id", "node", "c0", "c1", "c7", "__doc", "__tie", "__lines", "a.b",
]


@pytest.mark.parametrize("stage", ["quality", "lines", "join", "mix"])
def test_columns_survive(spark, odd_docs, stage):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    run = {
        "quality": quality.quality_stage,
        "lines": line_dedup.lines_stage,
        "join": ngram_join.join_stage,
        "mix": lambda d: mixing.mix_stage(d, labels),
    }[stage]
    wide = odd_docs.selectExpr("*", *[f"concat(coalesce(doc_id, -1), '{n}') as `{n}`" for n in NAMES])
    out = run(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{-1 if r.doc_id is None else r.doc_id}{n}" for r in rows for n in NAMES)
    assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, ((r.doc_id, r.text) for r in run(odd_docs).collect())))


def test_copies_of_rows_without_an_id_follow_their_texts(spark, words):
    texts = [f"{w} good plain text {i}" for i, w in enumerate(words[:300])]
    docs = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    rates = {(r.doc_id, r.text_hash): r for r in mixing.mixing_rates(docs, mixing.domains_of(labels)).collect()}
    assert len(rates) == 300
    counted = mixing.mix_stage(docs, labels).selectExpr("doc_id", "xxhash64(text) as h").groupBy("doc_id", "h").count().collect()
    assert {(r.doc_id, r.h): r["count"] for r in counted} == {k: r.copies for k, r in rates.items() if r.copies}


def test_an_id_of_many_rows_trains_once(spark):
    docs = spark.createDataFrame([(1, "good text")] * 50 + [(2, "bad %%% text")], "doc_id bigint, text string").repartition(6)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    seen = []
    original = mixing.Logistic
    try:
        mixing.Logistic = lambda texts, y, k, priors=None: seen.append(len(y)) or original(texts, y, k, priors=priors)
        assert mixing.mixing_rates(docs, mixing.domains_of(labels)).count() == 51
    finally:
        mixing.Logistic = original
    assert seen == [2]
