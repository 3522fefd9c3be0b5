import datetime

from pyspark.sql import functions as F

from risklens.sources import corpus, documents, sessions


def test_tree_of_files(spark, tmp_path):
    (tmp_path / "pkg/sub").mkdir(parents=True)
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "pkg/sub/b c.py").write_text("größe = 1\n", encoding="utf-8")
    (tmp_path / "pkg/bad.py").write_bytes(b"ok\xff = 1\n")
    (tmp_path / "pkg/note.txt").write_text("no")
    files = {r.file_path: r.content for r in corpus.read_corpus(spark, str(tmp_path), "p").collect()}
    assert files == {"a.py": "x = 1\n", "pkg/sub/b c.py": "größe = 1\n", "pkg/bad.py": "ok = 1\n"}
    strict = corpus.read_corpus(spark, str(tmp_path), "p", on_bad_utf8="skip")
    assert {r.file_path for r in strict.collect()} == {"a.py", "pkg/sub/b c.py"}
    assert {r.file_path for r in corpus.read_corpus(spark, str(tmp_path), "p", glob="*.txt").collect()} == {"pkg/note.txt"}


def test_missing_tree_is_empty(spark, tmp_path):
    assert corpus.read_corpus(spark, str(tmp_path / "nowhere"), "p").count() == 0


def test_the_replacement_character_itself_is_kept(spark):
    df = spark.createDataFrame([(bytearray("a�b".encode()),)], "content binary")
    assert corpus.decode_files(df).collect()[0].content == "a�b"


def _docs(spark, rows):
    stamped = [("p", path, text, datetime.datetime(2024, 1, day)) for path, text, day in rows]
    df = spark.createDataFrame(stamped, "project_name string, file_path string, content string, analyzed_at timestamp")
    return documents.with_doc_id(df)


def test_upsert(spark):
    old = _docs(spark, [("a", "a1", 1), ("b", "b1", 1), ("c", "c9", 9)])
    new = _docs(spark, [("a", "a2", 2), ("b", "b1x", 1), ("c", "c2", 2), ("d", "d1", 2), ("d", "d2", 3)])
    once = documents.upsert_documents(old, new)
    want = {"a": "a2", "b": "b1x", "c": "c9", "d": "d2"}
    assert {r.file_path: r.content for r in once.collect()} == want
    again = documents.upsert_documents(once, new)
    assert {r.file_path: r.content for r in again.collect()} == want and again.count() == 4
    assert {r.file_path for r in documents.upsert_documents(old.limit(0), new).collect()} == set("abcd")


def test_stored_projects_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "docs")
    first = _docs(spark, [("a", "a1", 1), ("b", "b1", 1)])
    other = first.withColumn("project_name", F.lit("q"))
    documents.write_documents(first.unionByName(other), path)
    documents.write_documents(_docs(spark, [("a", "a2", 2)]), path)
    have = {(r.project_name, r.file_path): r.content for r in documents.read_documents(spark, path).collect()}
    assert have == {("p", "a"): "a2", ("q", "a"): "a1", ("q", "b"): "b1"}


def test_clear_and_lookup(spark):
    docs = _docs(spark, [("a", "a1", 1), ("b", "b1", 1)])
    rest, deleted = documents.clear_project(docs, "p")
    assert rest.count() == 0 and deleted.collect()[0].deleted == 2
    rest, deleted = documents.clear_project(docs, "q")
    assert rest.count() == 2 and deleted.collect()[0].deleted == 0
    assert documents.get_document(docs, "p", "b").collect()[0].content == "b1"
    assert documents.get_document(docs, "q", "b").count() == 0


def test_key_is_the_hash_of_project_and_path(spark):
    import hashlib

    row = _docs(spark, [("a/b.py", "", 1)]).collect()[0]
    assert row.doc_id == hashlib.sha256(b"p:a/b.py").hexdigest()


def test_sessions(spark):
    scans = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 2, 3), ("t", 1, 4)], "session_id string, scanned_at int, scan_id int")
    assert {r.session_id: r.scan_id for r in sessions.latest_scan(scans).collect()} == {"s": 3, "t": 4}
    assert sessions.drop_session(scans, "s").count() == 1
    found = spark.createDataFrame([("s", 1), ("s", 2)], "project_name string, seq int")
    assert sessions.findings_for(found, "s").count() == 2
    assert sessions.findings_for(found, "s", 2).count() == 1 and sessions.findings_for(found, "x", 2).count() == 0


def test_corpus_root_in_any_spelling(spark, tmp_path):
    (tmp_path / "r" / "pkg").mkdir(parents=True)
    (tmp_path / "r" / "pkg" / "a.py").write_text("x = 1\n")
    for root in (f"{tmp_path}/r", f"{tmp_path}/r/", f"{tmp_path}/r/../r", f"file://{tmp_path}/r", f"file:{tmp_path}//r"):
        assert [r.file_path for r in corpus.read_corpus(spark, root, "p").collect()] == ["pkg/a.py"], root
