import random
from collections import defaultdict

import pytest

from risklens.plans import views as V

SCHEMA = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
)


@pytest.fixture()
def lines(spark, tmp_path):
    """Orders of one to 40 lines, rows that come twice, and nulls in every column."""
    rng = random.Random(3)
    rows = []
    for order in [None, *range(40)]:
        for line in range(rng.randint(1, 40)):
            part = rng.choice([None, *range(1, 30)])
            rows.append((order, part, rng.choice([None, *range(1, 45)]), rng.choice([None, line % 7]), float(rng.randint(1, 50)), 1.5, 0.1,
                         rng.choice([0.0, 0.08, None]), rng.choice("NRA"), rng.choice("FO"), None))
    rows += rows[:20]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), rows


def _key(row):
    order = (0, 3, 1, 2, 4, 5, 6, 7)
    return [(row[c] is not None, row[c] or 0) for c in order]


@pytest.mark.parametrize("long_order", [1 << 16, 10, 0])
def test_graph_of_short_and_long_orders(spark, lines, long_order, monkeypatch):
    folder, rows = lines
    want, orders = [], defaultdict(list)
    for row in rows:
        if row[0] is not None:
            orders[row[0]].append(row)
    for order, mine in orders.items():
        mine.sort(key=_key)
        want += [(a[1], b[1], order, i) for i, (a, b) in enumerate(zip(mine, mine[1:]), 1)]
    written = []
    keep = V.materialize
    monkeypatch.setattr(V, "LONG_ORDER", long_order)
    monkeypatch.setattr(V, "materialize", lambda df, label="stage": written.append(label) or keep(df, label))
    got = [tuple(r) for r in V.graph(spark, folder).select("src", "dst", "ord", "pos").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # orders that a task can hold are not numbered through written tables
    assert ("positions" in written) == (long_order < 1 << 16)


def test_findings_sort_carries_no_texts(spark, lines, monkeypatch):
    folder, rows = lines
    carried = []
    number = V.group_position
    monkeypatch.setattr(V, "group_position", lambda df, *a, **k: carried.extend(df.dtypes) or number(df, *a, **k))
    found = V.findings(spark, folder)
    assert not {"project_name", "file", "function", "type", "evidence"} & {c for c, _ in carried}
    assert found.columns == [*V.finding_rows(spark, folder).columns, "seq"]
    projects = defaultdict(list)
    for row in rows:
        projects[None if row[2] is None else f"proj{row[2] % 20}"].append(row)
    want = []
    for project, mine in projects.items():
        mine.sort(key=_key)
        want += [(project, i, r[3] and r[3] * 10, r[1] and f"pkg{r[1] % 10}/mod_{r[1]}.py") for i, r in enumerate(mine, 1)]
    got = [(r.project_name, r.seq, r.start_line, r.file) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
