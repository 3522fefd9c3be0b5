import pytest
from pyspark.sql import functions as F

from risklens.operators import publish, scoring
from risklens.operators.filters import min_risk

SCHEMA = (
    "project_name string, file string, function string, start_line int, end_line int, risk_score int, "
    "vulnerable boolean, type string, description string, verified boolean, evidence string"
)


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame([
        ("p", "a.py", "login", 1, 9, 9, True, "SQL Injection", "bad", True, "proof"),
        ("p", "b.py", "login", 1, 9, 7, True, "SQL Injection", "bad", False, ""),
        ("p", "c.py", "hash", 2, 3, 3, True, "Weak Hashing", None, None, None),
        ("p", "d.py", "safe", 2, 3, 0, False, "none", "ok", None, None),
    ], SCHEMA)


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame([
        (1, "[Security] SQL Injection in login()", "u1", "open", ["security", "tool"], False),
        (2, "[Security] Weak Hashing in hash()", "u2", "closed", ["security", "tool"], False),
        (3, "[Security] Weak Hashing in hash()", "u3", "open", ["security"], False),
        (4, "other", "u4", "open", ["security", "tool"], True),
    ], "number int, title string, url string, state string, labels array<string>, is_pr boolean")


def test_existing_issues(issues):
    def numbers(**kw):
        return [r.number for r in publish.existing_issues(issues, **kw).orderBy("number").collect()]

    assert numbers(labels=["security", "tool"]) == [1]
    assert numbers(labels=["security"]) == [1, 3]
    assert numbers(state="all") == [1, 2, 3] and numbers(state="closed") == [2]


def test_known_titles_are_dropped_and_batch_duplicates_stay(findings, issues):
    known = publish.existing_issues(issues, labels=["security", "tool"])
    assert publish.new_issues(min_risk(findings), known).count() == 0
    none = issues.limit(0)
    assert publish.new_issues(min_risk(findings), none).count() == 2
    assert publish.new_issues(min_risk(findings), none, within_batch=True).count() == 1


def test_labels(findings):
    rows = scoring.score(findings).select(
        "file", publish.issue_labels("audit", ("base",)).alias("a"), publish.issue_labels("verified", ("base",)).alias("v")
    ).orderBy("file").collect()
    assert [r.a for r in rows] == [["base", "critical"], ["base", "high-priority"], ["base"], ["base"]]
    assert rows[0].v == ["base", "critical", "verified"] and rows[1].v == ["base"]


def test_bodies(findings):
    scored = scoring.score(findings).withColumn("exploit_output", F.repeat(F.lit("x"), 900))
    full = {r.file: r.body for r in publish.issue_body(scored, "verified", footer="by us").collect()}
    assert "x" * 500 in full["a.py"] and "x" * 501 not in full["a.py"] and "VERIFIED" in full["a.py"]
    assert "### Verification" not in full["b.py"] and "No description available" in full["c.py"]
    assert all(b.endswith("by us\n") for b in full.values())
    audit = {r.file: r.body for r in publish.issue_body(findings).collect()}
    assert audit["a.py"].startswith("## 🔴") and audit["b.py"].startswith("## 🟠") and "**Lines:** 1-9" in audit["a.py"]


def test_change_records(spark):
    fixes = spark.createDataFrame(
        [("o/r", 5, "SQL Injection", "a.py", "fixed"), ("o/r", 6, "X", "b.py", ""), ("o/r", 7, "X", "b.py", None),
         ("o/r", 5, "SQL Injection", "z.py", "fixed")],
        "repo string, number int, type string, file string, content string",
    )
    known = spark.createDataFrame(
        [("o/r", "security/fix-5", "closed", "a"), ("o/r", "security/fix-5", "open", "b")],
        "repo string, branch string, state string, url string",
    )
    rows = publish.change_records(fixes, known).collect()
    assert len(rows) == 1 and rows[0].existing_url == "b" and rows[0].file == "a.py"
    assert rows[0].commit_message == "fix: SQL Injection security vulnerability\n\nFixes #5"
    assert publish.change_records(fixes, known, prefix="bot").collect()[0].existing_url is None
