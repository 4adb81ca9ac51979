import datetime as dt
import random

import pytest

from railspoke.operators.orphans import judged_references, orphan_references, orphan_report

T0 = dt.datetime(2024, 1, 31, 12)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def tables(spark, edges, nodes, gone):
    return {
        "rows": spark.createDataFrame(
            [(i, a, b, at(h), "x", 1) for i, a, b, h in edges],
            "row_id long, from_node long, to_node long, loaded_at timestamp, side string, key int",
        ),
        "id_key": "row_id",
        "sides": ["from_node", "to_node"],
        "at": "loaded_at",
        "parents": spark.createDataFrame([(n, at(h)) for n, h in nodes], "osmid long, loaded_at timestamp"),
        "deletions": spark.createDataFrame([(n, at(h)) for n, h in gone], "osmid long, deleted_at timestamp"),
        "key": "osmid",
        "delivered": "loaded_at",
        "deleted": "deleted_at",
    }


def brute(edges, nodes, gone):
    born = {n for n, _ in nodes}
    out = set()
    for i, a, b, h in edges:
        for side, k in (("from_node", a), ("to_node", b)):
            if k is None:
                continue
            past = [(t, 0) for n, t in nodes if n == k and h is not None and t <= h]
            past += [(t, 1) for n, t in gone if n == k and h is not None and t <= h]
            if k not in born:
                out.add((i, side, "missing"))
            elif not past:
                out.add((i, side, "late"))
            elif max(past)[1]:
                out.add((i, side, "deleted"))
    return out


@pytest.mark.parametrize("heavy", [10**6, 20])
def test_against_brute_force(spark, heavy):
    r = random.Random(4)
    pick = lambda: 0 if r.random() < 0.35 else r.randrange(1, 25)
    nodes = [(pick(), r.randrange(100)) for _ in range(60)]
    gone = [(r.randrange(0, 27), r.randrange(100) + 0.5) for _ in range(30)]
    edges = [(i, pick(), None if r.random() < 0.1 else r.randrange(0, 30), r.randrange(100)) for i in range(300)]
    edges.append((999, 1, 2, None))
    how = tables(spark, edges, nodes, gone)
    got = [tuple(x) for x in orphan_references(**how, heavy_rows=heavy).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(edges, nodes, gone)


def test_empty_tables_and_repeats(spark):
    edges = [(1, 5, 6, 1), (1, 5, 6, 1)]
    how = tables(spark, edges, [], [])
    assert [x["kind"] for x in orphan_references(**how).collect()] == ["missing"] * 4
    assert judged_references(**tables(spark, [], [(1, 1)], [])).count() == 0


def test_report(spark):
    edges = [(1, 5, 6, 1), (2, 5, 7, 24 * 3)]
    rows = orphan_report(table="edges", **tables(spark, edges, [(5, 0), (6, 5)], [(5, 30)])).collect()
    got = {(r["month"], r["side"]): (r["refs"], r["missing"], r["late"], r["deleted"]) for r in rows}
    assert got == {
        ("2024-01", "from_node"): (1, 0, 0, 0),
        ("2024-01", "to_node"): (1, 0, 1, 0),
        ("2024-02", "from_node"): (1, 0, 0, 1),
        ("2024-02", "to_node"): (1, 1, 0, 0),
    }
