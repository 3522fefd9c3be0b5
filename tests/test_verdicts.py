import json

from pyspark.sql import functions as F

from risklens.functions.errors import classify_error, is_retryable
from risklens.functions.text import repo_slug, session_key, stem, strip_fences, valid_payload
from risklens.operators import rules, verdicts
from risklens.operators.filters import require_keys


def _parse(spark, replies, **kw):
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    return verdicts.parse_verdict(df, **kw).orderBy("id").collect()


def test_replies_of_every_shape(spark):
    good = '{"vulnerable": true, "risk_score": 7, "type": "t", "description": "d"}'
    rows = _parse(spark, [
        good, f"```json\n{good}\n```", f"  ```\n{good}\n```  ", f"Sure: {good} bye", "nothing", "{broken", "{bro} ken",
        "[1]", "null", "{}", '{"risk_score": 99}', '{"risk_score": -3.5, "vulnerable": 1}',
        '{"risk_score": " 8 "}', '{"risk_score": "7.9"}', '{"risk_score": true}', '{"risk_score": null}',
        '{"risk_score": [1]}', '{"risk_score": 7.9}', '{"risk_score": 1, "risk_score": 2}',
        '{"risk_score": 5, "file": "other.py", "n": 3}', "", '{"risk_score": "99999999999999999999999999999999999999999"}',
    ])
    full = (True, 7, "t", "d", None)
    have = [(r.vulnerable, r.risk_score, r.type, r.description, r.error) for r in rows]
    assert have[:4] == [full] * 4
    default = (False, 0, "error", "Failed to parse LLM response", None)
    assert have[4] == have[5] == have[20] == default
    assert [h[4] for h in have[6:9]] == ["invalid JSON", "reply is not an object", "reply is not an object"]
    assert have[9] == (False, 0, "unknown", "unknown", None)
    assert [h[1] for h in have[10:13]] == [10, 0, 8] and have[11][0] is True
    assert [h[4] for h in (have[13], have[15], have[16])] == ["risk_score is not a number"] * 3
    assert (have[14][1], have[17][1], have[18][1], have[21][1]) == (1, 7, 2, 10)
    assert rows[19].extras == {"file": "other.py", "n": "3"}


def test_truth_of_values(spark):
    values = ["true", "false", '"false"', '""', "0", "0.5", "null", "[]", "[0]", "{}", '{"a": 1}']
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string").withColumn("v", F.try_parse_json("v"))
    rows = df.select("id", verdicts.truthy(F.col("v")).alias("t"), verdicts.truthy(F.col("v"), False).alias("r"))
    have = [(r.t, r.r) for r in rows.orderBy("id").collect()]
    assert [t for t, _ in have] == [bool(json.loads(v)) for v in values]
    assert have[2] == (True, False)


def test_errors_become_findings(spark):
    df = verdicts.with_analysis_errors(verdicts.parse_verdict(spark.createDataFrame([("[1]",)], "reply string")))
    row = df.collect()[0]
    assert (row.vulnerable, row.risk_score, row.type) == (False, 0, "analysis_error")
    assert row.description.startswith("Failed to analyze: ")


def test_fences(spark):
    df = spark.createDataFrame([("```json\n{}\n```",), ("```\nx\n```",), ("a ``` b",), ("```python\ncode()\n```",)], "c string")
    rows = df.select(
        strip_fences(F.col("c")).alias("r"), strip_fences(F.col("c"), "split_python").alias("p"),
        valid_payload(F.col("c"), 6).alias("ok"),
    ).collect()
    assert [r.r for r in rows] == ["{}", "x", "a ``` b", "python\ncode()"]
    assert [r.p for r in rows] == ["json\n{}", "x", "a ``` b", "code()"]
    assert [r.ok for r in rows] == [True, False, True, True]


def test_fields_of_broken_json(spark):
    text = '{"recon": "say \\"hi\\"\\nnow", "plan" : "p", "other": 1'
    df = spark.createDataFrame([(text,), ('{"recon": "only"',)], "c string")
    rows = verdicts.extract_json_strings(df, "c", ["recon", "plan"]).collect()
    assert (rows[0].recon, rows[0].plan) == ('say "hi"\nnow', "p")
    assert rows[1].recon is None
    long = '{"recon": "' + "x" * 200_000 + '", "plan": "p"'
    row = verdicts.extract_json_strings(spark.createDataFrame([(long,)], "c string"), "c", ["recon", "plan"]).collect()[0]
    assert len(row.recon) == 200_000


def test_first_missing_key(spark):
    df = spark.createDataFrame([({"recon": "x"},), ({"recon": "x", "plan": "y"},), ({},)], "m map<string,string>")
    rows = require_keys(df, "m", ["recon", "plan"]).collect()
    assert [r.error for r in rows] == ["Missing required key: plan", None, "Missing required key: recon"]


def test_tiers(spark):
    rows = [
        (1, 1, True, "one", None), (1, 2, True, "two", None), (2, 1, False, None, "429"), (2, 2, True, "two", None),
        (3, 1, False, None, "429"), (3, 2, False, None, "down"),
    ]
    df = spark.createDataFrame(rows, "k int, tier int, ok boolean, reply string, error string")
    have = {r.k: (r.reply, r.switches, r.error) for r in verdicts.resolve_tiers(df, "k").collect()}
    assert have[1] == ("one", 0, None) and have[2] == ("two", 1, None)
    assert have[3][0] is None and "429" in have[3][2] and "down" in have[3][2]


def test_more_tiers_than_names(spark):
    rows = [(1, t, False, None, f"e{t}") for t in (2, 4, 1, 3)] + [(2, 1, False, None, "e1"), (2, 2, False, None, None), (2, 3, True, "r", None)]
    df = spark.createDataFrame(rows, "k int, tier int, ok boolean, reply string, error string")
    have = {r.k: (r.tier, r.reply, r.switches, r.error) for r in verdicts.resolve_tiers(df, "k").collect()}
    assert have[1] == (None, None, 4, "All tiers failed. Tier 1 (primary): e1. Tier 2 (fallback): e2. Tier 3 (tier 3): e3. Tier 4 (tier 4): e4.")
    assert have[2] == (3, "r", 2, None)


def test_chat_puts_the_system_message_first(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "system", "be kind"), (2, 0, "assistant", "x")],
        "conv_id int, turn int, role string, text string",
    )
    rows = verdicts.assemble_chat(df).filter("conv_id = 1").orderBy("position").collect()
    assert [r.role for r in rows] == ["system", "user", "assistant"]
    assert {r.conv_id: r.user_prompt for r in verdicts.user_prompts(df).collect()} == {1: "hello", 2: ""}


def test_error_classes(spark):
    texts = ["Rate limit", "429 timeout", "Read timeout", "connection lost", "quota exceeded", "other", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(classify_error(F.col("t")).alias("c"), is_retryable(F.col("t")).alias("r")).collect()
    assert [r.c for r in rows] == ["rate_limit", "rate_limit", "timeout", "connection", "non_retryable", "non_retryable", None]
    assert [r.r for r in rows] == [True, True, True, False, True, False, False]


def test_repository_names(spark):
    cases = {
        "https://github.com/o/r": "o/r", "https://github.com/o/r.git": "o/r", "git@github.com:o/r.git": "o/r",
        "o/r": "o/r", "o/r/": "o/r/", "plain": "plain", "https://example.org/a/b": "https://example.org/a/b",
    }
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    rows = df.select("u", repo_slug(F.col("u")).alias("s"), repo_slug(F.col("u"), "rstrip").alias("l"),
                     session_key(repo_slug(F.col("u"))).alias("k")).collect()
    assert {r.u: r.s for r in rows} == cases
    # the lenient form eats trailing letters of the set
    have = spark.createDataFrame([("https://github.com/o/edit",), ("https://github.com/o/r/tree",)], "u string")
    assert [r[0] for r in have.select(repo_slug(F.col("u"), "rstrip")).collect()] == ["o/ed", "o/r"]
    assert {r.k for r in rows} >= {"o_r", "plain"}


def test_stems(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), ("a/.bashrc",), ("c",), ("x/y.py",)], "p string")
    assert [r[0] for r in df.select(stem(F.col("p"))).collect()] == ["b.tar", ".bashrc", "c", "y"]


def test_rules(spark):
    texts = {
        "hardcoded_credentials": 'password = "x"', "insecure_random": "import random\nrandom.choice(x)",
        "weak_hash": "hashlib.MD5(x)", "sql_fstring": 'q = f"SELECT * FROM t WHERE a = {a}"',
        "shell_fstring": 'os.system(f"ls {x}")', "unsafe_pickle": "pickle.loads(b)",
        "path_concat": 'open("/data/" + name)', "debug_print": 'print(f"DEBUG {x}")',
    }
    df = spark.createDataFrame([("p", k, v) for k, v in texts.items()] + [("p", "none", "x = 1"), ("p", "none", "import random")],
                               "project_name string, k string, t string")
    hits = rules.scan_rules(df, "t")
    assert {r.k: r.rule for r in hits.collect()} == {k: k for k in texts}
    assert {r.rule: r.hits for r in rules.rule_summary(hits).collect()} == {k: 1 for k in texts}
