import zlib
from collections import Counter

from pyspark.sql import functions as F

from risklens.llm.hilbert import curve_shards, hilbert_index, quantise_hash, quantise_log, shard_query, write_shards


def test_curve_visits_every_cell_by_steps_of_one(spark):
    for bits, dims in ((1, 2), (3, 2), (2, 3), (3, 3)):
        side = 1 << bits
        cells = spark.range(side**dims).select(*[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"c{i}") for i in range(dims)])
        rows = cells.select("*", hilbert_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(side**dims))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(x - y) for x, y in zip(a[:dims], b[:dims])) == 1


def test_rows_law(spark, odd_docs, odd_texts):
    rows = shard_query(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        if r.doc_id is not None:
            raw = (odd_texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_few_rows_one_cell_and_empty(spark, no_docs):
    assert shard_query(no_docs).collect() == []
    same = spark.range(1000).selectExpr("id as doc_id", "'same' as text", "'s' as source", "'en' as lang", "4L as n_chars")
    assert set(Counter(r.shard for r in shard_query(same).collect()).values()) == {62, 63}
    assert sorted(r.shard for r in shard_query(same.limit(3)).collect()) == [0, 5, 10]


def test_shards_prune(spark):
    rows = spark.range(4096).selectExpr("id", "id % 64 as a", "(id * 37) % 61 as b", "'x' as shard", "1 as curve", "2 as slot")
    cells = [quantise_log(F.col("a")), quantise_log(F.col("b"))]
    out = curve_shards(rows, cells, 16, ["id"]).cache()
    assert out.count() == 4096 and "id" in out.columns
    spans = out.groupBy("shard").agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b")).collect()
    assert sum(r.a < 62 or r.b < 59 for r in spans) >= 12


def test_quantisers_take_nulls(spark):
    rows = spark.createDataFrame([(None, None), ("x", -5), ("x", 10**12)], "s string, n bigint")
    got = rows.select(quantise_hash(F.col("s")).alias("s"), quantise_log(F.col("n")).alias("n")).collect()
    assert (got[0].s, got[0].n) == (0, 0) and got[1].s == got[2].s and got[2].n == 31


def test_files(spark, odd_docs, tmp_path):
    cells = [quantise_log(F.col("n_chars"))]
    write_shards(curve_shards(odd_docs, cells, 4, ["doc_id"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()
