import pytest
from pyspark.sql import functions as F

from railspoke.operators import impute as I


@pytest.fixture(scope="module")
def graph(spark):
    ref = spark.createDataFrame(
        [("surface", "asphalt", "Asphalt"), ("surface", "gravel", "Schotter"), ("highway", "path", "Pfad")],
        "tag_field string, canonical string, label_de string",
    )
    rows = [
        (1, 10, "gravel"), (2, 10, "asphalt"), (3, 10, "asphalt"), (4, 10, None), (5, 10, " \xa0"),
        (6, 20, "gravel"), (7, 20, "asphalt"), (8, 20, ""), (9, 30, "Asphalt"), (10, 30, None), (11, None, None), (12, None, "gravel"),
    ]
    edges = spark.createDataFrame(
        [(i, w, s, "path", "r1", "bike") for i, w, s in rows] + [(99, 10, None, None, "r1", "rail")],
        "row_id long, way_id long, surface string, highway string, region_key string, mode string",
    )
    nodes = spark.createDataFrame(
        [
            (1, 100.0, "a"), (2, 101.0, "a"), (2, 101.0, "a"), (3, None, "a"), (4, float("nan"), "b"), (5, -9999.0, None),
            (6, -12.0, "c"), (7, None, "c"), (8, 1e6, None),
        ],
        "osmid long, elevation_m double, place_key string",
    ).selectExpr("*", "'r' AS region_key", "'bike' AS node_type", "0 AS open", "1.0 AS fill")
    return edges, nodes, ref


def test_found(graph):
    got = {(r["target"], r["record_id"]): r["fill_value"] for r in I.fill_edges_and_nodes(*graph).collect()}
    assert got == {
        ("edges.surface", 4): "asphalt",
        ("edges.surface", 5): "asphalt",
        ("edges.surface", 8): "asphalt",
        ("edges.surface", 10): "none",
        ("edges.surface", 11): "none",
        ("nodes.elevation_m", 3): "100",  # 100.5 goes to the even metre
        ("nodes.elevation_m", 4): "none",
        ("nodes.elevation_m", 5): "none",
        ("nodes.elevation_m", 7): "-12",
    }


def test_empty(graph):
    edges, nodes, ref = graph
    assert I.fill_edges_and_nodes(edges.limit(0), nodes.limit(0), ref).count() == 0
    left = I.fill_edges_and_nodes(edges, nodes, ref.limit(0)).where("target = 'edges.surface'")
    assert {r["fill_value"] for r in left.collect()} == {"none"}


def test_tree_is_the_best_of_all(spark):
    # c depends on b, b on a; d is noise; e has a value of its own for almost each row
    rows = [(f"a{i % 4}", f"b{(i % 4) // 2}", f"c{(i % 4) // 2}" if i % 5 else "c9", f"d{i * 7 % 11 % 3}", f"e{i * 61 % 199}") for i in range(240)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    cells = I.Cells(df, ["a", "b", "c", "d"])
    edges = {frozenset(x[:2]) for x in cells.tree()}
    assert len(edges) == 3 and frozenset("ab") in edges and frozenset("bc") in edges
    # the field of most values is no neighbour for its values alone
    wide = I.Cells(df, ["b", "c", "d", "e"])
    plain, scores = ({(a, b): x[k] for a, b, *x in wide.information()} for k in (0, 1))
    assert "e" in max(plain, key=plain.get) and max(scores, key=scores.get) == ("b", "c") and max(scores[x, "e"] for x in "bcd") < 0.1
    from itertools import combinations

    def is_tree(es):
        seen = {es[0][0]}
        for _ in es:
            seen |= {x for e in es if seen & set(e) for x in e}
        return len(seen) == 4

    whole = {(a, b): score for a, b, _, score in cells.information()}
    best = max((es for es in combinations(whole, 3) if is_tree(es)), key=lambda es: sum(whole[e] for e in es))
    assert {frozenset(e) for e in best} == edges


def brute(rows, fields, tree, target, evidence):
    """Posterior by summing over all assignments of the unknown fields."""
    from collections import Counter
    from itertools import product

    n = {f: Counter(r[f] for r in rows) for f in fields}
    two = {frozenset(e[:2]): Counter(frozenset((f, r[f]) for f in e[:2]) for r in rows) for e in tree}
    free = [f for f in fields if f not in evidence]
    out = Counter()
    for values in product(*[n[f] for f in free]):
        at = {**evidence, **dict(zip(free, values, strict=True))}
        p = 1.0
        for a, b, _ in tree:
            p *= two[frozenset((a, b))][frozenset(((a, at[a]), (b, at[b])))]
        degree = Counter(x for e in tree for x in e[:2])
        for f in fields:
            p /= n[f][at[f]] ** (degree[f] - 1)
        out[at[target]] += p
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "fork"])
def test_messages_against_all_assignments(spark, shape):
    import random

    r = random.Random(4)
    fields = ["a", "b", "c", "t"]
    rows = []
    for _ in range(400):
        x = r.randint(0, 2)
        rows.append({"a": f"a{x}", "b": f"b{(x + (r.random() < 0.3)) % 3}", "c": f"c{(x + (r.random() < 0.4)) % 3}", "t": f"t{(x + (r.random() < 0.2)) % 3}"})
    tree = {
        "chain": [("t", "a", 1.0), ("a", "b", 1.0), ("b", "c", 1.0)],
        "star": [("t", "a", 1.0), ("t", "b", 1.0), ("t", "c", 1.0)],
        "fork": [("t", "a", 1.0), ("a", "b", 1.0), ("a", "c", 1.0)],
    }[shape]
    known = [{}] + [{f: f"{f}{k % 3}" for k, f in enumerate(fields[:3]) if m >> k & 1} for m in range(1, 8)]
    asked = [(i, *(e.get(f) for f in fields[:3]), None, True) for i, e in enumerate(known)]
    df = spark.createDataFrame([(None, *(x[f] for f in fields), False) for x in rows] + asked, "k long, a string, b string, c string, t string, open boolean")
    cells = I.Cells(df.where("not open"), fields)
    got = {x["k"]: x["fill"] for x in I.fill_missing(df, F.col("open"), "k", "t", cells, tree).collect()}
    assert got[0] is None
    for i, e in enumerate(known[1:], 1):
        want = brute(rows, fields, tree, "t", e)
        assert want[got[i]] == pytest.approx(max(want.values())), (shape, e)


def test_another_tree_gives_other_fills(spark):
    rows = [("w1", "h1", "x")] * 3 + [("w2", "h1", "y")] * 9 + [("w3", "h2", "x")] * 5
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(99, "w1", "h1", None), (100, None, "h1", None)], "k long, w string, h string, t string")
    cells = I.Cells(df, ["w", "h", "t"])

    def fills(tree, **how):
        got = I.fill_missing(df, F.col("t").isNull(), "k", "t", cells, tree, **how).collect()
        return {r["k"]: (r["fill"], r["told_by"]) for r in got}

    by_way = [("w", "t", 1.0), ("w", "h", 1.0)]
    assert fills(by_way) == {99: ("x", "w"), 100: ("y", "h")}
    assert fills([("h", "t", 1.0), ("w", "h", 1.0)]) == {99: ("y", "h"), 100: ("y", "h")}
    # the check: the group's own rows, whatever the tree
    for tree in (by_way, [("h", "t", 1.0), ("w", "h", 1.0)]):
        assert {k: f for k, (f, _) in fills(tree, group="w").items()} == {99: "x", 100: None}


def test_bins(spark):
    df = spark.createDataFrame([(k, "g", float(v)) for k, v in enumerate((10, 20, 60, 60, 470))] + [(9, "g", None)], "k long, g string, v double")
    df = df.withColumn("bin", I.binned(F.col("v"), 50.0))
    cells = I.Cells(df, ["g", "bin"], "v")
    for decode, want in ((I.decode_median, 1), (I.decode_mean, pytest.approx(124.0)), (I.decode_mode, "0")):
        assert I.fill_missing(df, F.col("v").isNull(), "k", "bin", cells, cells.tree(), decode).collect()[0]["fill"] == want
    assert spark.range(1).select(I.binned(F.lit(-1.0), 50.0)).collect()[0][0] == -1


def test_posterior_fills(graph):
    got = {(r["target"], r["record_id"]): (r["fill_value"], r["told_by"]) for r in I.posterior_fills(*graph).collect()}
    assert got["edges.surface", 4][0] == "asphalt" and len(got) == 9
