import os

import pytest

import corpus_pipeline
from risklens.llm.mixing import domains_of, mixing_rates
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_join
from test_packing import check_pieces, coder  # noqa: F401
from test_quality import brute as brute_quality

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_each_stage_on_its_own_input(spark, tmp_path, coder):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, states = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], SMALL).write.parquet(str(tmp_path / str(i)))
        states.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert states[-1].columns == columns
    rows = [{r.doc_id: r.text for r in s.collect()} for s in states[:4]]
    # quality: exactly the documents that pass
    assert set(rows[1]) == {i for i, t in rows[0].items() if brute_quality(t)[-1]}
    # lines: in order of id
    ids = sorted(rows[1])
    want = brute_lines([rows[1][i] for i in ids])
    kept = {i: want[k][2] for k, i in enumerate(ids) if not want[k][1] or want[k][2].strip(" \t\n\r\x0b\x0c")}
    assert rows[2] == kept
    # join: one document per component
    ids = sorted(rows[2])
    part = brute_join([rows[2][i] for i in ids], 5, 80)
    assert set(rows[3]) == {ids[k] for k, (_, c) in part.items() if k == c}
    # mixing: as often as the copies say
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    copies = {r.doc_id: r.copies for r in mixing_rates(states[3], domains_of(labels)).collect()}
    counted = {r.doc_id: r["count"] for r in states[4].groupBy("doc_id").count().collect()}
    assert counted == {i: c for i, c in copies.items() if c}
    # packing: all tokens of every copy
    pieces = states[5].collect()
    once = [r for r in pieces if counted[r.doc_id] == 1]
    for i in {r.doc_id for r in once}:
        own = sorted((r for r in once if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == own[0].doc_tokens
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(total[i] * c for i, c in counted.items())
    assert set(total) == set(counted)


def test_run_and_empty_input(spark, tmp_path):
    if os.path.isdir(SMALL):
        assert corpus_pipeline.run(spark, SMALL).count() > 0
        spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
        spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
