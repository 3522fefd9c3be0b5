import pytest
from pyspark.sql import functions as F

from risklens.functions.severity import severity, should_verify
from risklens.operators import filters, reports, scoring

SCHEMA = (
    "project_name string, seq int, file string, function string, start_line int, end_line int, risk_score int, "
    "vulnerable boolean, type string, verified boolean, evidence string"
)


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        full = [
            ("p", i, f"{s}.py", f"f{i}", i, i + 1, s, v, "SQL Injection", ver, ev)
            for i, (s, v, ver, ev) in enumerate(rows, 1)
        ]
        return spark.createDataFrame(full, SCHEMA)

    return build


# score, verified, evidence -> final score, label, priority
TABLE = [
    (7, True, "", 9, "CRITICAL - VERIFIED", "CRITICAL"),
    (6, True, "x", 10, "CRITICAL - VERIFIED WITH EXPLOIT", "CRITICAL"),
    (9, False, "", 9, "High - Unverified", "CRITICAL"),
    (8, False, "x", 8, "High - Unverified", "CRITICAL"),
    (12, False, "", 12, "High - Unverified", "CRITICAL"),
    (12, True, "", 10, "CRITICAL - VERIFIED", "CRITICAL"),
    (3, False, "", 0, "False Positive - Low Risk", "LOW"),
    (0, True, "", 2, "CRITICAL - VERIFIED", "LOW"),
    (5, True, "", 7, "CRITICAL - VERIFIED", "HIGH"),
    (5, False, "", 4, "Medium - Unverified", "LOW"),
    (6, False, "", 5, "Medium - Unverified", "MEDIUM"),
    (7, None, None, 6, "Medium - Unverified", "MEDIUM"),
    (None, None, None, 0, "False Positive - Low Risk", "LOW"),
]


def test_decision_table(make):
    rows = scoring.score(make([(s, True, v, e) for s, v, e, *_ in TABLE])).orderBy("seq").collect()
    assert [(r.final_score, r.label, r.priority) for r in rows] == [tuple(t[3:]) for t in TABLE]


def test_ladders_at_their_edges(spark):
    df = spark.createDataFrame([(float(s),) for s in range(11)] + [(8.5,)], "s double")
    cols = ["priority", "api", "ui", "report", "label", "badge"]
    rows = {r.s: r for r in df.select("s", *[severity(F.col("s"), c).alias(c) for c in cols]).collect()}
    assert [rows[s].api for s in (3, 4, 5, 6, 7, 8)] == ["low", "medium", "medium", "high", "high", "critical"]
    assert [rows[s].ui for s in (3, 4, 7)] == ["LOW", "MEDIUM", "HIGH"]
    assert [rows[s].priority for s in (4, 5, 7, 8)] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert [rows[s].label for s in (6, 7, 8)] == [None, "high-priority", "critical"]
    assert [rows[s].badge for s in (0, 4, 5, 7, 9, 8.5)] == ["green", "green", "yellow", "orange", "red", None]


def test_order_is_by_score_and_stable(make):
    rows = scoring.prioritize(make([(s, True, None, "") for s in (2, 10, 5, 8, 10)])).collect()
    assert [(r.risk_score, r.seq) for r in rows] == [(10, 2), (10, 5), (8, 4), (5, 3), (2, 1)]


def test_filters(make):
    df = make([(9, True, True, ""), (4, True, False, ""), (7, True, None, ""), (9, None, None, ""), (9, False, None, "")])
    assert filters.actionable(df, 7).count() == 4
    assert filters.actionable(df, 7, verified_only=True).count() == 1
    assert filters.vulnerable_only(df).count() == 3
    assert filters.min_risk(df).count() == 2
    alerts = [r.alert for r in filters.alert_level(df).orderBy("seq").collect()]
    assert alerts == ["high", "info", "high", None, None]
    gate = filters.release_gate(df).collect()[0]
    assert (gate.blocking, gate.passed) == (1, False)
    assert filters.release_gate(df.filter("risk_score < 8")).collect()[0].passed


def test_strategies(spark):
    df = spark.createDataFrame([(8,), (2,), (10,), (7,), (None,)], "s int")
    pick = {n: should_verify(F.col("s"), n).alias(n) for n in ("smart", "all", "none", "critical", "other")}
    rows = df.select(*pick.values()).collect()
    assert [r.smart for r in rows] == [True, False, True, True, False]
    assert all(r.all for r in rows) and not any(r.none for r in rows)
    assert [r.critical for r in rows] == [True, False, True, False, False]
    assert [r.other for r in rows] == [r.smart for r in rows]


def test_path_filters(spark):
    paths = ["a.py", "venv/x.py", "pkg/venv/y.py", "pkg/venv/deep/z.py", ".git/h.py", "p/.hidden.py", "build/b.py",
             ".github/c.py", "p/venvs/d.py"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")

    def kept(x):
        return [r.file_path for r in x.collect()]

    assert kept(filters.exclude_segments(df)) == ["a.py", "p/venvs/d.py"]
    assert "pkg/venv/deep/z.py" in kept(filters.exclude_globs(df)) and "venv/x.py" not in kept(filters.exclude_globs(df))
    assert "venv/x.py" in kept(filters.exclude_globs(df, root=""))
    deep = kept(filters.exclude_globs(df, ["**/venv/**"], "recursive", root=""))
    assert not [p for p in deep if "/venv/" in f"/{p}"]
    assert ".github/c.py" not in kept(filters.exclude_substrings(df))


def test_reports(make):
    df = make([(10, True, None, ""), (7, True, None, ""), (0, False, None, "")])
    row = reports.audit_report(df).collect()[0]
    assert (row.functions, row.vulnerable, row.critical, row.high, row.medium, row.low) == (3, 2, 1, 1, 0, 0)
    assert [(r.risk_score, r.band) for r in reports.audit_report_rows(df).orderBy("seq").collect()] == [
        (10, "critical"), (7, "high")
    ]
    # a missing final score is zero for the audit, the raw score for the report
    mixed = df.withColumn("final_score", F.when(F.col("seq") == 1, F.lit(10)))
    audit, report = reports.audit_summary(mixed).collect()[0], reports.priority_report(mixed).collect()[0]
    assert (audit.critical, audit.high, audit.false_positives) == (1, 0, 2)
    assert (report.critical, report.high, report.false_positives) == (1, 1, 1)


def test_empty_inputs(make):
    none = make([]).select("*")
    assert reports.audit_report(none).count() == 0
    assert scoring.ranked(none).count() == 0
    assert reports.verification_summary(scoring.score(none)).collect()[0].total == 0


def test_merge_keeps_unverified_and_unscored_rows(spark, make):
    df = make([(6, True, None, ""), (6, True, None, ""), (None, True, None, "")]).withColumn("finding_id", F.col("seq"))
    results = spark.createDataFrame(
        [(1, True, "out", "proof", ""), (2, False, "", "", "boom")],
        "finding_id int, verified boolean, output string, evidence string, error string",
    )
    rows = scoring.merge_verification(df, results).orderBy("finding_id").collect()
    assert [(r.verified, r.final_score, r.label) for r in rows] == [
        (True, 10, "CRITICAL - VERIFIED WITH EXPLOIT"), (False, 5, "Medium - Unverified"), (False, 0, "UNKNOWN")
    ]
    assert [r.verification_error for r in rows] == [None, "boom", None]
    assert "priority" not in scoring.merge_verification(df, results).columns


def test_pin_first(make):
    ranked = scoring.ranked(make([(s, True, None, "") for s in (9, 8, 7, 6)]))
    rows = scoring.pin_first(ranked, 3).orderBy("position").collect()
    assert [r.risk_score for r in rows] == [7, 9, 8, 6]


def test_actions_stop_at_the_first_exit(spark):
    log = spark.createDataFrame(
        [(1, 1, "F", True), (1, 2, "F", False), (1, 3, "S", None), (1, 4, "E", None), (1, 5, "F", True), (2, 1, "S", None)],
        "session int, seq int, action string, success boolean",
    )
    rows = {r.session: (r.fixed, r.skipped, r.total) for r in scoring.session_actions(log).collect()}
    assert rows == {1: (1, 1, 5), 2: (0, 1, 1)}


def test_remediated_takes_the_last_link(spark):
    findings = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3)], "project_name string, seq int")
    done = spark.createDataFrame([("p", 1), ("p", 2), ("p", 9)], "project_name string, seq int")
    links = spark.createDataFrame([("p", 1, "a", 1), ("p", 1, "b", 2)], "project_name string, seq int, url string, number int")
    rows = {r.seq: r.url for r in scoring.remediated(findings, done, links, ["project_name", "seq"]).collect()}
    assert rows == {1: "b", 2: None}
    assert [r.seq for r in scoring.remaining(findings, done, ["project_name", "seq"]).collect()] == [3]


def test_dashboard_default(spark, make):
    files = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "project_name string, file string")
    rows = {r.project_name: (r.threats, r.scanned, r.risk_score) for r in
            reports.dashboard_metrics(make([(7, True, None, "")]), files).collect()}
    assert rows == {"p": (1, 200, 7.0), "q": (0, 100, 8.0)}
