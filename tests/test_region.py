import pytest
from pyspark.sql import functions as F

from railspoke.operators import geocode as N
from railspoke.operators import region as R
from railspoke.operators import report as P

NODE = "osmid long, lat double, lon double, elevation_m double, node_type string, station_name string"
EDGE = (
    "from_node long, to_node long, key long, length_m double, height_diff_m double, surface string, highway string, "
    "mode string, geometry_wkt string, way_id long, row_id long"
)


def graph(spark, places, edges):
    """places: osmid -> (lat, lon, height, kind); edges: (from, to, length, mode)."""
    nodes = spark.createDataFrame([(i, *p[:3], p[3] if len(p) > 3 else "bike", None) for i, p in places.items()], NODE)
    text = lambda p: f"{p[1]:.6f} {p[0]:.6f} {p[2]:.1f}"
    rows = [
        (a, b, 0, float(n), places[b][2] - places[a][2], "asphalt", "path", m, f"LINESTRING Z ({text(places[a])}, {text(places[b])})" if m == "bike" else None, 7 if m == "bike" else None, k)
        for k, (a, b, n, m) in enumerate(edges)
    ]
    return nodes, spark.createDataFrame(rows, EDGE)


def ways(edges):
    return sorted((r["from_node"], r["to_node"], r["length_m"]) for r in edges.collect())


@pytest.fixture(scope="module")
def chain(spark):
    """A junction 1 with two dead ends, a road 1-2-...-9 both ways, a branch at 9, a ring 20-21-22 and a one-way hop."""
    at = {i: (48.0, 8.0 + i / 1000, 100.0 + i) for i in [*range(1, 13), 20, 21, 22, 30, 31]}
    pairs = [(i, i + 1) for i in range(1, 9)] + [(1, 10), (1, 11), (9, 12), (9, 30), (20, 21), (21, 22), (22, 20)]
    edges = [(a, b, 10 + a, "bike") for a, b in pairs] + [(b, a, 10 + a, "bike") for a, b in pairs] + [(30, 31, 5, "bike"), (4, 31, 3, "station")]
    return graph(spark, at, edges)


def test_contraction(spark, chain):
    nodes, edges = R.contracted_graph(*chain)
    got = ways(edges)
    # 4 has a station and stays; 2-3 and 5-8 go; the branch over 30 runs through to 31
    assert (1, 4, 36.0) in got and (4, 1, 36.0) in got and (4, 9, 14.0 + 15 + 16 + 17 + 18) in got and (9, 31, 24.0) in got
    assert {(20, 21, 30.0), (21, 22, 31.0), (22, 20, 32.0)} <= set(got)
    assert sum(n for *_, n in got) == sum(n for *_, n in ways(chain[1]))
    assert {r["osmid"] for r in nodes.collect()} == {1, 4, 9, 10, 11, 12, 20, 21, 22, 30, 31}
    line = edges.where("from_node = 1 and to_node = 4").collect()[0]["geometry_wkt"]
    assert line.count(",") == 3 and line.startswith("LINESTRING Z (8.001000 48.000000 101.0")
    assert edges.groupBy("from_node", "to_node", "key").count().where("count > 1").isEmpty()
    assert R.contracted_graph(chain[0], chain[1].limit(0))[1].count() == 0


def test_consolidation_rebuilds_edges(spark):
    at = {1: (48.0, 8.0, 100.0), 2: (48.0001, 8.0, 110.0), 3: (48.01, 8.0, 50.0), -1: (48.0, 8.0, 0.0, "rail")}
    nodes, edges = R.consolidated_graph(*graph(spark, at, [(1, 2, 11, "bike"), (2, 3, 1100, "bike"), (3, 1, 1111, "bike"), (-1, 2, 9, "station")]))
    assert {(r["osmid"], r["elevation_m"]) for r in nodes.collect()} == {(1, 105.0), (3, 50.0), (-1, 0.0)}
    rows = {(r["from_node"], r["to_node"]): r for r in edges.collect()}
    assert set(rows) == {(1, 3), (3, 1), (-1, 1)}
    assert rows[1, 3]["length_m"] == pytest.approx(1106.4, abs=0.2) and rows[1, 3]["height_diff_m"] == -55.0
    assert rows[1, 3]["geometry_wkt"].startswith("LINESTRING Z (8.000000 48.000050 ")


def test_split_makes_nodes(spark):
    nodes, edges = graph(spark, {1: (48.0, 8.0, 100.0), 2: (48.0, 8.02, 110.0)}, [(1, 2, 1500, "bike"), (2, 1, 1500, "bike")])
    hill = "LINESTRING Z (8.0 48.0 100.0, 8.01 48.0 200.0, 8.02 48.0 110.0)"
    back = "LINESTRING Z (8.02 48.0 110.0, 8.01 48.0 200.0, 8.0 48.0 100.0)"
    edges = edges.withColumn("geometry_wkt", F.when(F.col("from_node") == 1, hill).otherwise(back))
    new, parts = R.split_graph(nodes, edges)
    assert {(r["osmid"], r["elevation_m"]) for r in new.collect()} == {(1, 100.0), (2, 110.0), (3, 200.0)}
    rows = {(r["from_node"], r["to_node"]): r for r in parts.collect()}
    assert set(rows) == {(1, 3), (3, 2), (2, 3), (3, 1)} and rows[1, 3]["height_diff_m"] == 100.0
    assert rows[1, 3]["length_m"] == pytest.approx(744.0, abs=1.0)


def test_union_and_composition(spark):
    nodes, edges = graph(spark, {5: (48.0, 8.0, 0.0), 3: (48.0, 8.1, 0.0), 9: (49.0, 8.0, 0.0)}, [(5, 3, 1, "bike"), (9, 5, 2, "bike")])
    keyed = nodes.withColumn("region_key", F.when(F.col("osmid") == 9, "a").otherwise("b"))
    n, e = R.regions_united(keyed, edges)
    assert {(r["osmid"], r["region_key"]) for r in n.collect()} == {(0, "a"), (1, "b"), (2, "b")} and ways(e) == [(0, 2, 2.0), (2, 1, 1.0)]
    n, e = R.composed((nodes, edges), (nodes, edges))
    assert sorted(r["osmid"] for r in n.collect()) == [3, 5, 9, 10, 12, 16] and (12, 10, 1.0) in ways(e)
    inside, kept = R.clipped(nodes, edges, 7.9, 48.9, 8.05, 49.1)
    # the way is taken whole
    assert kept.count() == 2 and inside.count() == 3


def test_raster(spark):
    raster = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(10) for c in range(10)], "row int, col int, elev double")
    b = R.raster_bounds(raster, 10.0, 8.0, 50.0).collect()[0]
    assert (b["west"], b["east"]) == (8.0, 9.0) and b["south"] == pytest.approx(49.0)
    assert R.raster_crop(raster, 10.0, 8.0, 50.0, (8.45, 49.45, 8.55, 49.55), 0.1).count() == 16
    nodes, edges = graph(spark, {1: (49.95, 8.05, 0.0), 2: (49.85, 8.15, 0.0)}, [(1, 2, 1, "bike")])
    n, e = R.baked(nodes, edges, raster, "row_id", 10.0, 8.0, 50.0, -9999.0)
    assert {r["elevation_m"] for r in n.collect()} == {0.0, 11.0}
    assert e.collect()[0]["geometry_wkt"] == "LINESTRING Z (8.050000 49.950000 0.0, 8.150000 49.850000 11.0)"
    st = spark.createDataFrame([(1, 1.0, 2.0, "Halt", " "), (2, 1.0, 2.0, "signal", "x"), (3, None, 2.0, "station", "x")], "osmid long, lat double, lon double, railway string, name string")
    assert [r["station_name"] for r in R.station_points(st).collect()] == ["station"]


def test_geocoding(spark):
    places = spark.createDataFrame([("p1", "Au", 48.0, 8.0), ("p2", "au", 50.0, 9.0), ("p3", None, 1.0, 1.0), ("p4", "Aubach", None, 8.0)], "place_key string, name string, lat double, lon double")
    centre = spark.createDataFrame([(49.9, 9.0)], "m_lat double, m_lon double")
    texts = spark.createDataFrame([(1, " AU "), (2, "48.5, 8.25 (Hier)"), (3, "  "), (4, None), (5, "Aubach"), (6, "95, 8"), (1, " AU ")], "id long, text string")
    got = sorted((r["id"], r["lat"], r["status"]) for r in N.geocoded(texts, places, centre, "id").collect() if r["id"] != 4)
    assert got == [(1, 50.0, "place"), (1, 50.0, "place"), (2, 48.5, "literal"), (3, None, "empty"), (5, None, "not_found"), (6, None, "not_found")]
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0]["v"]
    assert one(N.feature_label(F.lit("Au "), F.lit("Au"), F.lit(" "), F.lit("BW"))) == "Au, BW"
    assert one(N.station_label(F.lit("Au "))) == "Au Bahnhof" and one(N.station_label(F.lit("Au bahnhof"))) == "Au bahnhof"
    assert one(N.display_label(F.lit("48.5, 8.25 (Hier)"))) == "Hier" and one(N.display_label(F.lit("Ort (x)"))) == "Ort (x)"
    assert one(N.box_value(F.lit(1.5), F.lit(2.0), F.lit(" "))) == "1.50000, 2.00000" and one(N.extract_leaf(F.lit("a/b/c"))) == "c"
    named = places.withColumn("osmid", F.col("place_key"))
    terms = spark.createDataFrame([("A",), ("au",), ("x",), (" ",)], "term string")
    assert [(r["term"], r["osmid"]) for r in N.suggested(terms, named, centre, 1).orderBy("term").collect()] == [("a", "p2"), ("au", "p2")]


def test_texts(spark):
    text = P.stats_text(F.lit(7.04), F.lit(24.5), F.lit(218.4), F.lit(25.5))
    assert spark.range(1).select(text.alias("v")).collect()[0]["v"] == "7.0 km · 24 min · +218 m / −26 m"
    points = spark.createDataFrame([("q", k, 48.0, 8.0 + k / 100, 100.0 + k, 60.0 * k) for k in range(3)], "query_id string, seq int, lat double, lon double, elevation_m double, elapsed_s double")
    doc = P.gpx_documents(points, F.to_timestamp(F.lit("2024-06-01 08:00:00")), F.lit("a & b")).collect()[0]["gpx"]
    import xml.etree.ElementTree as ET

    root = ET.fromstring(doc.encode())
    assert len(root.findall(".//{*}trkpt")) == 3 and root.find(".//{*}name").text == "a & b" and "08:02:00Z" in doc
    marks = spark.createDataFrame([("q", "m", 48.001, 8.011)], "query_id string, marker string, lat double, lon double")
    got = P.markers_on_track(marks, points).collect()[0]
    assert got["elevation_m"] == 101.0 and got["km"] == pytest.approx(0.744, abs=0.001)
