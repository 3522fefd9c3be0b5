import datetime
import json

from risklens.sources.documents import upsert_documents, with_doc_id
from risklens.streaming import index, progress

FEED = [
    {"session": 1, "seq": 1, "phase": "init", "message": "start", "type": "info"},
    {"session": 1, "seq": 2, "phase": "red_team", "message": "go", "type": "recon"},
    {"session": 2, "seq": 1, "phase": "init", "message": "start", "type": "odd"},
    {"session": 2, "seq": 2, "phase": "error", "message": "lost", "type": "error"},
    {"session": 1, "seq": 3, "phase": "blue_team", "message": "fix", "type": "patch"},
    {"session": 1, "seq": 4, "phase": "other", "message": "?", "type": "info"},
    {"session": 1, "seq": 5, "success": True, "pr_url": "u"},
    {"session": 2, "seq": 3, "success": False, "error": "Not verified"},
    {"session": 1, "seq": 6, "phase": "pr", "message": "late", "type": "info"},
    {"session": 3, "seq": 1, "phase": "init", "message": "", "type": "info"},
]


def _write(folder, name, records, junk=True):
    lines = [json.dumps(r) for r in records] + (["", "{broken"] if junk else [])
    (folder / name).write_text("\n".join(lines) + "\n")


def _state(df):
    return {r.session: (r.n_lines, r.lane, r.last_error, r.done, r.success, r.pr_url) for r in df.collect()}


WANT = {
    1: (3, "B", None, True, True, "u"),
    2: (1, "A", "Not verified", True, False, None),
    3: (0, None, None, False, None, None),
}


def test_junk_is_skipped_and_the_stream_equals_the_table(spark, tmp_path):
    _write(tmp_path, "a.json", FEED)
    stream = progress.run_to_table(progress.read_progress_stream(spark, str(tmp_path)), "t")
    assert stream.count() == len(FEED)
    assert sorted(map(str, stream.collect())) == sorted(map(str, progress.read_progress(spark, str(tmp_path)).collect()))


def test_routes_types_and_ends(spark, tmp_path):
    _write(tmp_path, "a.json", FEED)
    rows = progress.read_progress(spark, str(tmp_path))
    routed = progress.route(rows).withColumn("shown", progress.map_type(rows["type"]))
    assert sorted((r.session, r.seq, r.lane, r.shown) for r in routed.collect()) == [
        (1, 1, "A", "info"), (1, 2, "A", "recon"), (1, 3, "B", "patch"), (1, 6, "B", "info"),
        (2, 1, "A", "info"), (2, 2, "error", "info"),
    ]
    assert {r.session for r in progress.terminal(rows).collect()} == {1, 2}
    assert {r.session for r in progress.terminal(rows, strict=True).collect()} == {1}


def test_state_of_a_table(spark, tmp_path):
    _write(tmp_path, "a.json", FEED)
    assert _state(progress.session_state(progress.read_progress(spark, str(tmp_path)))) == WANT


def test_state_over_batches_equals_the_table(spark, tmp_path):
    feed, state, checkpoint = tmp_path / "feed", str(tmp_path / "state"), str(tmp_path / "cp")
    feed.mkdir()
    for i in range(5):
        _write(feed, f"{i}.json", FEED[2 * i: 2 * i + 2])
        stream = progress.read_progress_stream(spark, str(feed))
        progress.start_session_state(stream, state, checkpoint, snapshot_every=3).awaitTermination()
    assert _state(progress.read_state(spark, state)) == WANT
    assert _state(progress.read_state(spark, state, 4)) == WANT and progress.read_state(spark, state, -1).count() == 0
    # versions hold only what changed, snapshots everything
    assert spark.read.parquet(f"{state}/version=1").count() == 1
    assert spark.read.parquet(f"{state}/version=3").count() == 2


def test_lane_and_error_follow_the_sequence(spark):
    old = [(1, 2, "B", 9, "late", 8, False, None, None), (2, 1, "A", 1, None, None, False, None, None), (3, 1, "A", 1, None, None, True, True, "u")]
    new = [(1, 1, "A", 5, "early", 4, False, None, None), (2, 1, "B", 2, "e", 3, False, None, None), (3, 1, "B", 2, "e", 3, False, None, None)]
    merged = progress.merge_state(spark.createDataFrame(old, progress.STATE), spark.createDataFrame(new, progress.STATE))
    have = {r.session: (r.n_lines, r.lane, r.lane_seq, r.last_error, r.done) for r in merged.collect()}
    assert have == {1: (3, "B", 9, "late", False), 2: (2, "B", 2, "e", False), 3: (1, "A", 1, None, True)}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    feed, state = tmp_path / "feed", str(tmp_path / "state")
    feed.mkdir()
    _write(feed, "a.json", FEED)
    for attempt in ("cp1", "cp2"):
        # a fresh checkpoint makes the stream run batch 0 again
        stream = progress.read_progress_stream(spark, str(feed))
        progress.start_session_state(stream, state, str(tmp_path / attempt)).awaitTermination()
        assert _state(progress.read_state(spark, state, 0)) == WANT


def test_index_over_deliveries_equals_the_upsert(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))

    def delivery(rows):
        full = [("p", path, text, datetime.datetime(2024, 1, day)) for path, text, day in rows]
        return with_doc_id(spark.createDataFrame(full, "project_name string, file_path string, content string, analyzed_at timestamp"))

    deliveries = [delivery([("a", "a1", 1), ("b", "b1", 1)]), delivery([("a", "a2", 2), ("c", "c1", 2)]), delivery([("b", "b0", 0 + 1)])]
    for d in deliveries:
        d.write.mode("append").parquet(source)
        stream = spark.readStream.schema(index.SCHEMA).parquet(source)
        index.start_index_stream(stream, table, checkpoint).awaitTermination()
    want = deliveries[0]
    for d in deliveries[1:]:
        want = upsert_documents(want, d)
    have = {r.file_path: r.content for r in index.read_index(spark, table).collect()}
    assert have == {r.file_path: r.content for r in want.collect()} == {"a": "a2", "b": "b0", "c": "c1"}
    index.compact_index(spark, table, str(tmp_path / "small"))
    assert index.read_index(spark, str(tmp_path / "small")).count() == 3
