import pytest

from risklens.operators import attempts as att

SCHEMA = "finding_id int, attempt int, strategy string, stdout string, stderr string, exit_code int"
OK, BAD = "EXPLOIT_SUCCESS", "EXPLOIT_FAILED"


@pytest.fixture(scope="module")
def log(spark):
    def build(outputs, first=1, finding=1):
        rows = [
            (finding, i, f"plan {i}", out, "boom" if code else "", code)
            for i, (out, code) in enumerate(outputs, first)
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return build


def test_first_matching_rule_decides(spark):
    cases = [
        (OK.lower() + " and " + BAD, 1, "success_marker", True), (BAD + " uid=0", 0, "failure_marker", False),
        ("uid=0", 1, "nonzero_exit", False), ("UID=0(root)", 0, "indicator", True), ("plain", 0, "clean_output", True),
        (" \n\t", 0, "no_evidence", False), (None, None, "nonzero_exit", False), (None, 0, "no_evidence", False),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, stdout string, exit_code int")
    rows = att.classify_outcome(df).orderBy("i").collect()
    assert [(r.reason, r.ok) for r in rows] == [c[2:] for c in cases]


def test_markers_are_arguments(spark):
    df = spark.createDataFrame([("PROVEN", 0), ("nope", 0)], "stdout string, exit_code int")
    rows = att.classify_outcome(df, success="proven", failure="NOPE", indicators=[]).collect()
    assert [r.ok for r in rows] == [True, False]


def test_success_on_the_second_attempt(log):
    row = att.first_success(log([(BAD, 0), (OK, 0), ("later", 0)])).collect()[0]
    assert (row.verified, row.attempts, row.output, row.error) == (True, 2, OK, "")


def test_three_failures(log):
    df = log([(BAD, 0), ("", 1), (BAD + "!", 0), (OK, 0)])
    row = att.first_success(df).collect()[0]
    assert (row.verified, row.attempts, row.output) == (False, 3, BAD + "!")
    records = att.failure_records(df).orderBy("attempt").collect()
    assert [r.attempt for r in records] == [1, 2, 3] and records[1].stderr == "boom"


def test_digest_shows_earlier_failures_only(log):
    rows = att.history_digest(log([(BAD, 0), ("", 1), (OK, 0)])).orderBy("attempt").collect()
    assert [r.earlier_failures for r in rows] == [0, 1, 2]
    assert rows[0].digest == ""
    assert rows[1].digest == "\nAttempt #1:\nStrategy: plan 1\nResult: FAILED\n"
    assert "Attempt #2:\nStrategy: plan 2\nError: boom\nResult: FAILED\n" in rows[2].digest


def test_texts_are_cut(spark):
    df = spark.createDataFrame([(1, 1, "s" * 400, "o" * 400, "e" * 400, 1)], SCHEMA)
    row = att.failure_records(df).collect()[0]
    assert (len(row.strategy), len(row.stdout), len(row.stderr)) == (150, 200, 200)


def test_fix_at_the_second_attempt(log):
    row = att.first_fixed(log([(OK, 0), (OK, 0), (BAD, 0)], first=0)).collect()[0]
    assert (row.fixed, row.attempts, row.verification_output, row.crashed) == (True, 2, BAD, False)


def test_a_crashed_check_counts_as_fixed_and_is_marked(log):
    row = att.first_fixed(log([(OK, 0), ("", 1)], first=0)).collect()[0]
    assert (row.fixed, row.attempts, row.crashed) == (True, 1, True)


def test_no_baseline_no_fix(log):
    for df in (log([(BAD, 0), (BAD, 0)], first=0), log([(BAD, 0)])):
        row = att.first_fixed(df).collect()[0]
        assert (row.baseline_ok, row.fixed, row.attempts) == (False, False, 0)
        assert not att.baseline_gate(df).collect()[0].baseline_ok


def test_never_fixed(log):
    row = att.first_fixed(log([(OK, 0)] * 5, first=0)).collect()[0]
    assert (row.fixed, row.attempts, row.verification_output) == (False, 3, "")
    assert "after 3 attempts" in row.error


def test_rates(spark, log):
    logs = log([(OK, 0), (BAD, 0)], 0, 1)
    for finding, outputs in ((2, [(OK, 0), (OK, 0), (BAD, 0)]), (3, [(OK, 0)] * 4), (4, [(BAD, 0)])):
        logs = logs.unionByName(log(outputs, 0, finding))
    results = att.first_fixed(logs).selectExpr("*", "'all' AS grp")
    row = att.attempt_rates(results, "grp").collect()[0]
    assert (row.findings, row.baseline_ok, row.false_positive_pct) == (4, 3, 25.0)
    assert (row.fixed_by_1_pct, row.fixed_by_2_pct, row.fixed_by_3_pct) == (33.33, 66.67, 66.67)


def test_status_rows(log):
    done = att.verification_status(att.first_success(log([(OK, 0)]))).collect()[0]
    failed = att.verification_status(att.first_success(log([(BAD, 0)]))).collect()[0]
    assert (done.status, done.error) == ("VERIFIED", None)
    assert failed.status == "NOT VERIFIED" and failed.error.startswith("Error: ")
    fix = att.verification_status(att.first_fixed(log([(OK, 0), (BAD, 0)], 0)), "fix").collect()[0]
    assert (fix.status, fix.attempts) == ("PATCH VERIFIED", 1)
