import re
import time

from risklens.operators import rules
from risklens.operators.graph import unpack_bundle


def test_every_place_of_every_rule(spark):
    text = 'x = hashlib.md5(a); y = SHA1\n\ntoken = "t"\n  password =\n   \'p\nq\'; secret="é" md5\n'
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, ""), (5, "import random\n"), (6, "import random\nr = random.random()\n")], "id int, text string")
    got = {(r.id, r.rule, r.nth): (r.line, r.column, r.match) for r in rules.rule_places(docs, "text").collect()}
    want = {}
    for r in docs.filter("text is not null").collect():
        for rule in rules.RULES:
            if all(re.search(p, r.text) for p in rule.patterns):
                for n, m in enumerate(re.finditer(rule.patterns[0], r.text), 1):
                    before = r.text[: m.start()]
                    want[r.id, rule.name, n] = (before.count("\n") + 1, len(before) - before.rfind("\n"), m[0])
    assert got == want and len(got) == 7


def test_many_places_in_one_text(spark):
    docs = spark.createDataFrame([(1, "md5\n" * 3000)], "id int, text string")
    rows = rules.rule_places(docs, "text").collect()
    assert sorted((r.nth, r.line, r.column) for r in rows) == [(i, i, 1) for i in range(1, 3001)]


def test_a_bundle_of_ten_thousand_sections(spark):
    text = "".join(f"=== Context: d{i}/f{i % 9000}.py ===\nbody {i}\n\n" for i in range(10_000)) + "=== Target: t.py ===\nend"
    docs = spark.createDataFrame([(1, text)], "id int, bundle string")
    start = time.time()
    rows = unpack_bundle(docs, "bundle").collect()
    assert time.time() - start < 60
    assert len(rows) == 9001
    have = {r.name: r.content for r in rows}
    assert have["f5.py"] == "body 9005" and have["f8999.py"] == "body 8999" and [r.name for r in rows][-1] == "t.py"
