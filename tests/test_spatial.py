import numpy as np

from railspoke.operators.spatial import Quadtree, RTree, boxes_around, great_circle_m, points_within


def brute(left, right, radius):
    return {
        (a[0], b[0])
        for a in left
        for b in right
        if None not in (a[1], a[2], b[1], b[2])
        and great_circle_m(*map(np.array, (a[1], a[2], b[1], b[2]))) <= radius
    }


def frame(spark, rows):
    return spark.createDataFrame(rows, "osmid long, lat double, lon double")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([50, 8], [50.05, 8.05], (400, 2)))]
    right = [(1000 + i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([50, 8], [50.05, 8.05], (400, 2)))]
    want = brute(left, right, 250.0)
    assert len(want) > 100
    assert pairs(points_within(frame(spark, left), frame(spark, right), 250.0)) == want
    # crowded leaves are cut into blocks; copies give a pair once
    again = points_within(frame(spark, left * 2), frame(spark, right), 250.0, sample_rows=20, most_rows=50)
    assert pairs(again) == want


def test_crowded_leaves_are_split(spark):
    """Two clusters of a thousandth of the width that the sample sees, and a crowd of one side alone."""
    rng = np.random.default_rng(9)
    place = lambda k, n, lat, lon: [(k + i, float(lat + a), float(lon + b)) for i, (a, b) in enumerate(rng.uniform(0, 0.02, (n, 2)))]
    left = place(0, 700, 50.0, 8.0) + place(5000, 600, 10.0, -70.0) + place(9000, 900, -20.0, 100.0)
    right = place(20_000, 700, 50.0, 8.0) + place(30_000, 500, 10.0, -70.0)
    want = brute(left[:1300], right, 60.0)
    got = points_within(frame(spark, left), frame(spark, right), 60.0, sample_rows=10, most_rows=100)
    assert pairs(got) == want and len(want) > 100
    several = frame(spark, [*left, (0, 10.0, -70.0)])
    assert pairs(points_within(several, frame(spark, right), 60.0, sample_rows=10, most_rows=100)) >= want


def test_one_place_poles_and_date_line(spark):
    same = [(i, 10.0, 10.0) for i in range(60)]
    got = pairs(points_within(frame(spark, same), frame(spark, same), 1.0, most_rows=20))
    assert len(got) == 3600
    a = [(1, 0.0, 179.9995), (2, 89.9999, 0.0), (3, -60.0, -179.9999)]
    b = [(4, 0.0, -179.9995), (5, 89.9999, 180.0), (6, -60.0, 179.9999)]
    assert pairs(points_within(frame(spark, a), frame(spark, b), 200.0)) == {(1, 4), (2, 5), (3, 6)}


def test_broken_and_empty_rows(spark):
    bad = [(1, None, 8.0), (2, float("nan"), 8.0), (3, 50.0, None), (None, 50.0, 8.0), (5, 95.0, 8.0), (6, 50.0, 8.0)]
    good = frame(spark, [(9, 50.0, 8.0)])
    assert pairs(points_within(frame(spark, bad), good, 10.0)) == {(6, 9)}
    assert pairs(points_within(frame(spark, []), good, 10.0)) == set()


def test_extra_columns_do_no_harm(spark):
    rows = frame(spark, [(1, 50.0, 8.0)]).selectExpr("*", "'x' AS id", "1 AS side", "2.0 AS x0", "'l' AS leaf")
    assert pairs(points_within(rows, rows, 1.0)) == {(1, 1)}


def test_boxes(spark):
    points = frame(spark, [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, None, 1.0), (4, 2.0, 2.0), (1, 1.0, 1.0)])
    boxes = spark.createDataFrame(
        [("a", 0.0, 0.0, 2.0, 2.0), ("b", 1.0, 1.0, 3.0, 3.0)],
        "region_key string, west double, south double, east double, north double",
    )
    got = sorted(map(tuple, boxes_around(points, boxes).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "b"), (2, None), (3, None), (4, "a"), (4, "b")], key=str)


def test_trees():
    rng = np.random.default_rng(1)
    lo = rng.uniform(0, 100, (500, 2))
    boxes = np.column_stack([lo[:, 0], lo[:, 0] + 3, lo[:, 1], lo[:, 1] + 3])
    q = boxes[:50] + 1.5
    got = set(zip(*(x.tolist() for x in RTree(boxes).probe(q)), strict=True))
    want = {
        (i, j)
        for i, a in enumerate(q)
        for j, b in enumerate(boxes)
        if a[0] <= b[1] and a[1] >= b[0] and a[2] <= b[3] and a[3] >= b[2]
    }
    assert got == want
    tree = Quadtree(lo[:, 0], lo[:, 1], 8)
    rows, leaves = tree.touched(lo[:, 0], lo[:, 0], lo[:, 1], lo[:, 1])
    assert sorted(rows.tolist()) == list(range(500))
    low_x, high_x, low_y, high_y = tree.bounds[leaves].T
    assert ((lo[rows, 0] >= low_x) & (lo[rows, 0] < high_x) & (lo[rows, 1] >= low_y) & (lo[rows, 1] < high_y)).all()
