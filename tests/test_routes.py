import pytest
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K
from railspoke.operators import build as B
from railspoke.operators import graph as G
from railspoke.operators import lineage
from railspoke.operators import simplify as S
from railspoke.operators import track as T
from railspoke.plans.routes import params_token
from railspoke.sources import tiles

NODE = "osmid long, lat double, lon double, elevation_m double, node_type string, station_name string"
EDGE = (
    "from_node long, to_node long, key long, length_m double, height_diff_m double, surface string, "
    "highway string, mode string, geometry_wkt string"
)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def test_constants():
    assert K.SURFACE_WEIGHT["asphalt"] == 0 and K.SURFACE_WEIGHT["cobblestone"] == pytest.approx(2.0)
    assert pytest.approx(0.64) == K.SURFACE_UNTAGGED
    with pytest.raises(ValueError):
        params_token({"uphill": 101.0})


def test_scalars(spark):
    lit = F.lit
    assert value(spark, C.haversine_m(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(111194.93, abs=0.01)
    assert value(spark, C.tile(lit(-0.1))) == -1
    tags = F.array(lit("Asphalt"), lit(None), lit("SETT"))
    assert value(spark, C.worst_weight(C.normal_tags(tags), K.SURFACE_WEIGHT, 9.0)) == pytest.approx(1.2)
    assert value(spark, C.surface_weight(lit("mud"))) == pytest.approx(0.64)
    assert value(spark, C.allowed(C.tag_list(lit("gravel;dirt")), K.SURFACE_WEIGHT)) is False
    assert [value(spark, C.colour_tier(lit(w))) for w in (0.5, 0.51, 1.5)] == [0, 1, 1]
    assert value(spark, C.bike_kmh(lit(0.0), lit(-0.1))) == 25.0
    assert value(spark, C.bike_kmh(lit(1.0), lit(0.06))) == pytest.approx(10.0)
    assert value(spark, C.bike_kmh(lit(0.0), lit(0.5))) == 5.0
    assert value(spark, C.zoom_for_span(lit(8000.0))) == 11.0
    assert value(spark, C.slug(lit("  Bad Wildbad, BW!"))) == "bad_wildbad_bw"
    assert value(spark, C.short_place(lit("Bad Wildbad, BW"))) == "bad_wildbad"
    assert value(spark, C.parsed_latlon(lit("48.5, 8.25 (Hier)"))).asDict() == {"lat": 48.5, "lon": 8.25, "name": "Hier"}
    assert value(spark, C.parsed_latlon(lit("95, 8"))) is None and value(spark, C.parsed_latlon(lit("Pforzheim"))) is None
    assert value(spark, C.hex_rgb(lit("#1565c0"))) == [21, 101, 192]


def test_cost(spark):
    cost = lambda mode, n, climb, s, h: value(spark, C.edge_cost(*map(F.lit, (mode, n, climb, s, h))))
    assert cost("bike", 100.0, 10.0, "asphalt", "cycleway") == pytest.approx(100 + 1200)
    assert cost("bike", 1000.0, -50.0, None, None) == pytest.approx(1000 + 0.64 * 3000 + 1000)
    assert cost("rail", 1000.0, 99.0, None, None) == pytest.approx(2000)
    assert cost("station", 100.0, 5.0, None, None) == pytest.approx(10100)
    assert cost("boat", 1.0, 0.0, None, None) is None
    with pytest.raises(Exception, match="unknown mode"):
        value(spark, C.edge_cost(*map(F.lit, ("boat", 1.0, 0.0, "a", "b")), strict=True))


@pytest.fixture(scope="module")
def graph(spark):
    """A steep direct road 1-2, a flat detour 1-3-2, and a train 10-11 with stations at both ends."""
    nodes = spark.createDataFrame(
        [
            (1, 48.0, 8.0, 100.0, "bike", None), (2, 48.0, 8.02, 400.0, "bike", None), (3, 48.01, 8.01, 100.0, "bike", None),
            (-10, 48.0005, 8.0, 101.0, "rail", "Alt"), (-11, 48.0005, 8.02, 399.0, "rail", None), (7, 10.0, 8.0, 0.0, "bike", None),
        ],
        NODE,
    )
    wkt = "LINESTRING Z (8.02 48.0 400.0, 8.01 48.0 250.0, 8.0 48.0 100.0)"
    edges = [
        (1, 2, 0, 1500.0, "asphalt", "residential", "bike", wkt), (1, 2, 1, 1600.0, "sett", "primary", "bike", None),
        (2, 1, 0, 1500.0, "asphalt", "residential", "bike", wkt), (1, 3, 0, 1400.0, "gravel", "track", "bike", None),
        (3, 2, 0, 1400.0, "gravel", "track", "bike", None), (1, -10, 0, 60.0, None, None, "station", None),
        (-10, -11, 0, 1500.0, None, None, "rail", None), (-11, 2, 0, 60.0, None, None, "station", None),
        (7, 7, 0, 5.0, None, None, "bike", None), (1, 99, 0, 5.0, None, None, "bike", None),
    ]
    raw = spark.createDataFrame(
        [(a, b, k, n, 0.0, s, h, m, g) for a, b, k, n, s, h, m, g in edges], EDGE
    ).selectExpr("*", "cast(null as long) AS way_id", "monotonically_increasing_id() AS row_id", "timestamp '2024-01-01' AS loaded_at")
    return nodes, G.clean_edges(raw.unionByName(raw.withColumn("row_id", F.col("row_id") + (1 << 40))), nodes)


def routed(spark, graph, prefs):
    nodes, edges = graph
    q = spark.createDataFrame([("q", 1, 2), ("none", 1, 7)], "query_id string, source long, target long")
    p = {k: F.lit(float(v)) for k, v in prefs.items()}
    rows = G.costed(edges, p)
    each = q.select("query_id").crossJoin(G.min_collapse(rows))
    return G.shortest_paths(q, each), rows


def test_clean(graph):
    _, edges = graph
    assert edges.count() == 8 and edges.where("from_node = 1 and to_node = 2 and key = 0").collect()[0]["height_diff_m"] == 300.0


@pytest.mark.parametrize(
    ("prefs", "want"),
    [
        ({"uphill": 0, "unpaved": 0, "main": 0, "rail": 0, "boarding": 20}, [1, 2]),
        ({"uphill": 12, "unpaved": 3, "main": 1, "rail": 1, "boarding": 100}, [1, 2]),
        ({"uphill": 12, "unpaved": 3, "main": 1, "rail": 0, "boarding": 0.5}, [1, -10, -11, 2]),
    ],
)
def test_search(spark, graph, prefs, want):
    paths, rows = routed(spark, graph, prefs)
    got = paths.orderBy("seq").collect()
    assert [r["osmid"] for r in got] == want and {r["query_id"] for r in got} == {"q"}
    start = spark.createDataFrame([("q", 1)], "query_id string, source long")
    every = G.min_collapse(rows).withColumn("query_id", F.lit("q"))
    reached = {r["osmid"]: r["reached"] for r in G.reach_all(start, every).collect()}
    assert reached[2] == pytest.approx(got[-1]["reached"]) and 7 not in reached


def test_track(spark, graph):
    nodes, _ = graph
    paths, rows = routed(spark, graph, {"uphill": 0, "unpaved": 0, "main": 0, "rail": 0, "boarding": 20})
    h = T.hops(G.path_edges(paths, rows), nodes)
    assert h.count() == 1
    climb = T.windowed_climb(h).collect()[0]
    assert (climb["bike_up"], climb["bike_down"]) == (pytest.approx(300.0), 0.0)
    dense = T.densified(h).orderBy("seq", "pt").collect()
    assert [round(r["elevation_m"]) for r in dense] == [100, 250, 400]
    stats = T.route_stats(h).collect()[0]
    assert stats["plausible_speed"] and stats["bike_km"] == pytest.approx(1.5)
    comp = {(r["dimension"], r["label"]): r["pct"] for r in T.composition(T.track_points(h)).collect()}
    assert comp == {("Quality", "good"): 100.0, ("Grade", "uphill"): 100.0, ("Mode", "bike route"): 100.0}


def test_train_legs(spark, graph):
    nodes, _ = graph
    paths, rows = routed(spark, graph, {"uphill": 12, "unpaved": 3, "main": 1, "rail": 0, "boarding": 0.5})
    h = T.hops(G.path_edges(paths, rows), nodes)
    assert [r["line"] for r in T.rail_leg_lines(h).collect()] == ["Train 1: Alt → (unnamed stop)"]
    assert [r["run"] for r in T.mode_runs(h).orderBy("seq").collect()] == [1, 2, 3]
    end = T.track_points(h).orderBy(F.desc("seq")).first()
    assert end["elapsed_s"] == pytest.approx(1800 + 1500 / (80 / 3.6))
    assert T.bike_leg_lines(h, F.lit("A"), F.lit("B")).count() == 0


def test_corridor_pruning_is_exact(spark, graph):
    nodes, _ = graph
    q = spark.createDataFrame(
        [("q", 48.0, 8.0, 48.0, 8.02)], "query_id string, lat_a double, lon_a double, lat_b double, lon_b double"
    )
    for half in (0.5, 1.2, 30.0):
        got = {r["osmid"] for r in G.corridor_nodes(q, nodes, half, 0.1).collect()}
        whole = nodes.crossJoin(q.withColumns(C.axis(*map(F.col, ("lat_a", "lon_a", "lat_b", "lon_b")))))
        inside = C.in_corridor(F.col("lat"), F.col("lon"), half, 0.1)
        assert got == {r["osmid"] for r in whole.where(inside).collect()}
    assert {r["verdict"] for r in G.trip_guard(q, 0.0, 0.0, 90.0, 90.0).collect()} == {"too_short"}


def test_components_and_prune(spark, graph):
    nodes, edges = graph
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "from_node long, to_node long")
    got = {r["osmid"]: r["component"] for r in G.components(chain).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}
    kept, left = G.prune(nodes, edges, 1000.0)
    assert {r["osmid"] for r in kept.collect()} == {1, 2, 3, -10, -11} and left.count() == 8
    assert G.components(chain.limit(0)).count() == 0


def test_nearest_ties_and_rings(spark):
    nodes = spark.createDataFrame([(2, 48.0, 8.001), (1, 48.0, 7.999), (3, 48.05, 8.0)], "osmid long, lat double, lon double")
    points = spark.createDataFrame([("a", 48.0, 8.0), ("b", 48.049, 8.0), ("far", 10.0, 10.0)], "p string, lat double, lon double")
    got = {(r["p"], r["osmid"]) for r in G.nearest(points, nodes, "p").collect()}
    assert got == {("a", 1), ("b", 3), ("far", 2)}
    here = {(r["p"], r["osmid"]) for r in G.nearest(points, nodes, "p", radii=(500.0,), beyond=False).collect()}
    assert here == {("a", 1), ("b", 3)}
    # over the 180th meridian and at the poles
    round_ = spark.createDataFrame([(5, 0.0, 179.999), (6, 89.99, 90.0), (7, -89.0, 0.0)], "osmid long, lat double, lon double")
    ends = spark.createDataFrame([("d", 0.0, -179.999), ("n", 89.99, -90.0), ("s", -89.5, 180.0), ("none", None, 1.0)], "p string, lat double, lon double")
    assert {(r["p"], r["osmid"]) for r in G.nearest(ends, round_, "p").collect()} == {("d", 5), ("n", 6), ("s", 7)}
    assert G.nearest(points, nodes, "p", 3).where("p = 'a'").count() == 3


def test_identity(spark, graph):
    nodes, edges = graph
    ids = {r["osmid"]: r["new_id"] for r in B.dense_ids(nodes).collect()}
    assert ids == {n: k for k, n in enumerate(sorted(ids))}
    twin = nodes.unionByName(nodes.where("osmid = 2").withColumn("osmid", F.lit(50).cast("long")))
    kept = {r["osmid"]: r["kept"] for r in B.merged_places(twin).collect()}
    assert kept[50] == 2 and kept[1] == 1
    same = edges.unionByName(edges.where("to_node = 2 and mode = 'bike'").withColumn("to_node", F.lit(50).cast("long")))
    merged = B.merged_places(twin)
    out = B.repointed(same, merged)
    assert out.count() == edges.count() and out.groupBy("from_node", "to_node", "key").count().where("count > 1").isEmpty()


def test_geometry(spark, graph):
    _, edges = graph
    lines = B.densified_lines(edges.where("geometry_wkt is not null"))
    for r in lines.collect():
        gaps = [((a["lon"] - b["lon"]) ** 2 + (a["lat"] - b["lat"]) ** 2) ** 0.5 * 111_320 for a, b in zip(r["line"], r["line"][1:], strict=False)]
        assert max(gaps) <= 135 and len(r["line"]) > 15
    assert B._cuts([0, 50, 0, -40, 0], 30.0) == [1, 3] and B._cuts([0, 10, 0], 30.0) == []
    parts = B.split_at_extrema(edges, "from_node", "to_node", "key")
    assert parts.count() == 2
    assert B.wired(spark.createDataFrame([(-1, 48.0, 8.0)], "osmid long, lat double, lon double"), graph[0].where("node_type = 'bike'")).count() == 2


def test_waypoints(spark):
    xs = [(0.0, 0.0), (1.0, 0.1), (2.0, -0.1), (3.0, 5.0), (4.0, 6.0), (5.0, 7.0), (6.0, 8.1), (7.0, 9.0)]
    line = spark.createDataFrame([("l", xs)], "k string, line array<struct<lon:double,lat:double>>")
    got = S.waypoints(line, "k", 4).collect()[0]["points"]
    assert [p["lon"] for p in got] == [0.0, 2.0, 3.0, 7.0]
    assert len(S.waypoints(line, "k", 10).collect()[0]["points"]) == 10
    thin = S.waypoints(line, "k", 8).select(S.thinned(F.col("points"), 300.0).alias("p")).collect()[0]["p"]
    assert (thin[0]["lon"], thin[-1]["lon"]) == (0.0, 7.0) and len(thin) < 8


def test_store(spark, graph, tmp_path):
    nodes, edges = graph
    tiles.write_store(nodes, edges, str(tmp_path / "store"))
    assert tiles.read_store(spark, str(tmp_path / "store"), "edges").count() == edges.count()
    box = tiles.covering_tiles(8.0, 48.0, 8.1, 48.1)
    assert tiles.read_store(spark, str(tmp_path / "store"), "nodes", box).count() == 5
    assert tiles.read_meta(spark, str(tmp_path / "store")).collect()[0]["n_stations"] == 2
    assert tiles.read_store(spark, str(tmp_path / "store"), "nodes", [(96, 16)]).count() == 5
    checks = tiles.checked_store(spark, str(tmp_path / "store"))
    assert checks["missing_end"] == checks["types"] == checks["heights"] == 0 and checks["no_geometry"] == 3 and checks["gap"] == 2


def test_grouped_search_gives_the_same_as_single(spark):
    """Random towns: each query in its own corridor, groups split into blocks, and all of them over the cap."""
    import random

    rng = random.Random(2)
    at = {n: (48.0 + rng.random() * 0.5, 8.0 + rng.random() * 0.7, "bike" if n % 5 else "rail") for n in range(1, 160)}
    nodes = spark.createDataFrame([(n, la, lo, 0.0, k) for n, (la, lo, k) in at.items()], "osmid long, lat double, lon double, elevation_m double, node_type string")
    near = lambda n: sorted(at, key=lambda m: (at[m][0] - at[n][0]) ** 2 + (at[m][1] - at[n][1]) ** 2)[1:5]
    edges = spark.createDataFrame([(n, m, float(rng.randint(1, 9))) for n in at for m in near(n)], "from_node long, to_node long, cost double")
    rows = [(f"q{i}", a, b, *at[a][:2], *at[b][:2]) for i, (a, b) in enumerate((rng.choice([n for n in at if n % 5]), rng.choice([n for n in at if n % 5])) for _ in range(40))]
    rows += [("none", 1, 999, *at[1][:2], 48.2, 8.2)]
    queries = spark.createDataFrame(rows, "query_id string, source long, target long, lat_a double, lon_a double, lat_b double, lon_b double").where("source <> target")
    tubes = {"bike": (6.0, 2.0), "rail": (12.0, 3.0)}
    own = G.corridor_edges(queries, nodes.withColumn("station_name", F.lit("x")), edges, **tubes)
    want = {tuple(r) for r in G.shortest_paths(queries, own).collect()}
    assert len({r[0] for r in want}) > 10
    for how in ({}, {"block": 3}, {"most": 1}):
        assert {tuple(r) for r in G.routes(queries, nodes, edges, **tubes, **how).collect()} == want, how


def test_corridors_of_large_groups_are_copied_in_waves(spark, graph, monkeypatch):
    """However many trips a group above the limit has, few of their corridors lie on disk at a time; all are answered."""
    from pathlib import Path

    n = 60
    nodes = spark.range(1, n + 1).select(F.col("id").alias("osmid"), (F.lit(48.0) + F.col("id") * 1e-4).alias("lat"), F.lit(8.0).alias("lon"), F.lit(0.0).alias("elevation_m"), F.lit("bike").alias("node_type"), F.lit("x").alias("station_name"))
    edges = spark.range(1, n).select(F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node"), F.lit(1.0).alias("cost"))
    rows = [(f"q{k:02}", 1 + k, n - k, 48.0 + (1 + k) * 1e-4, 8.0, 48.0 + (n - k) * 1e-4, 8.0) for k in range(6)]
    queries = spark.createDataFrame(rows, "query_id string, source long, target long, lat_a double, lon_a double, lat_b double, lon_b double")
    copied, all_paths = [], G.all_paths

    def counted(queries, edges, *rest):
        copied.append(edges.count())
        return all_paths(queries, edges, *rest)

    monkeypatch.setattr(G, "all_paths", counted)
    monkeypatch.setattr(G, "LEAST_WAVE", 1, raising=False)
    lineage.clean(spark)
    found = G.routes(queries, nodes, edges, most=n - 2)
    assert sorted(tuple(r) for r in found.groupBy("query_id").count().collect()) == [(f"q{k:02}", n - 2 * k) for k in range(6)]
    assert sum(copied) == 6 * (n - 1) and max(copied) <= 3 * (n - 1), copied
    assert {p.name[:-33] for p in Path(lineage.application_folder(spark)).glob("*")} <= {"found"}


def test_tiles_of_a_list():
    f = tiles.tile_filter([(1, 2), (1, 3), (1, 5), (2, 2)])
    assert str(f).count("tile_row") == 3


def test_violations_come_out(spark, graph):
    from railspoke.operators import validate as V

    nodes, edges = graph
    crossed = edges.select("from_node", "to_node", "key", F.when(F.col("mode") == "bike", "rail").otherwise(F.col("mode")).alias("mode"))
    assert G.typed_edges(G.with_ends(crossed, nodes), False).count() == 5
    path = spark.createDataFrame([("q", 1, 1, 2), ("q", 2, 2, 3), ("q", 3, 9, 4)], "query_id string, seq int, from_node long, to_node long")
    assert [r["seq"] for r in V.broken_paths(path).collect()] == [3]
    regions = spark.createDataFrame([("a",), ("b",)], "region_key string")
    assert [r["region_key"] for r in V.missing_regions(regions, regions.where("region_key = 'a'")).collect()] == ["b"]
    lines = [
        (1, "LINESTRING Z (8.0 48.0 1.0, 8.0005 48.0 2.0)"), (2, None), (3, "LINESTRING (8.0 48.0, 8.0005 48.0)"),
        (4, "LINESTRING Z (8.0 48.0 1.0, 8.01 48.0 2.0)"), (5, "LINESTRING Z (8.0 48.0 1.0, 8.0001 48.0 50.0, 8.0002 48.0 1.0)"),
    ]
    faults = V.geometry_faults(spark.createDataFrame(lines, "row_id long, geometry_wkt string"), "row_id")
    assert {(r["row_id"], r["fault"]) for r in faults.collect()} == {(2, "no_geometry"), (3, "no_height"), (4, "gap"), (5, "band")}
    assert V.worst(faults, "off_m", "row_id").collect()[0]["row_id"] == 4
    assert V.reduction_ok(spark.range(30), spark.range(10)).collect()[0]["sound"] and not V.reduction_ok(spark.range(30), spark.range(20)).collect()[0]["sound"]


def test_routes_leave_only_what_they_return(spark, graph):
    from pathlib import Path

    from railspoke.operators import lineage

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    lineage.clean(spark)
    before = files()
    sums = lineage.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    # the shuffle of the table written is gone
    assert files() <= before
    assert sums.count() == 7
    lineage.clean(spark)
    queries = spark.createDataFrame([("q", 1, 2, 48.0, 8.0, 48.0, 8.01)], "query_id string, source long, target long, lat_a double, lon_a double, lat_b double, lon_b double")
    nodes, edges = graph
    G.routes(queries, nodes, edges.select("from_node", "to_node", F.lit(1.0).alias("cost"))).count()
    left = {p.name[:-33] for p in Path(lineage.application_folder(spark)).glob("*")}
    assert left <= {"found", "rest"}, left


def _block(rng, side):
    """A grid of a few one-way streets and steep costs, a part apart from it, rail nodes among the others; a block's chunks and queries."""
    import pandas as pd

    at = {r * side + c + 1: (48.0 + r * 0.002, 8.0 + c * 0.003, int(rng.random() < 0.1)) for r in range(side) for c in range(side)}
    at |= {10_000 + k: (48.01, 8.01 + k * 1e-4, 0) for k in range(3)}
    pairs = [(n, m) for n in at if n < 10_000 for m in (n + 1, n + side) if m in at and m % side != 1]
    pairs = [p for a, b in pairs for p in ((a, b), (b, a)) if rng.random() < 0.9] + [(10_000, 10_001), (10_001, 10_002)]
    edges = [(a, b, float(rng.randint(1, 9)) * 100.0) for a, b in pairs]
    rows = [(at[a][2], 96, 16, a, b, x, float("nan")) for a, b, x in edges] + [(k, 96, 16, n, k, la, lo) for n, (la, lo, k) in at.items()]
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["rail", "tile_row", "tile_col", "a", "b", "x", "y"])
    chunks = pd.concat(list(G._packed(iter([frame[: len(frame) // 2], frame[len(frame) // 2 :]]))))
    ends = [tuple(rng.sample(range(1, side * side + 1), 2)) for _ in range(60)] + [(1, 10_001), (10_000, 10_002), (10_002, 10_000)]
    return at, edges, chunks, ends


def _asked(at, ends):
    import math

    import pandas as pd

    out = []
    for k, (s, t) in enumerate(ends):
        (ya, xa, _), (yb, xb, _) = at[s], at[t]
        scale = math.cos(math.radians((ya + yb) / 2))
        dx, dy = (xb - xa) * scale, yb - ya
        n = math.hypot(dx, dy)
        out.append((f"q{k}", s, t, scale, xa * scale, ya, n, dx / n, dy / n))
    return pd.DataFrame(out, columns=["query_id", "source", "target", *C.AXIS])


@pytest.mark.parametrize("tubes", [{"bike": (1.0, 0.3), "rail": (1.5, 0.5)}, {"bike": (50.0, 9.0), "rail": (50.0, 9.0)}])
def test_bounded_search_gives_the_paths_of_a_plain_one(tubes):
    import random

    at, edges, chunks, ends = _block(random.Random(5), 20)
    queries = _asked(at, ends)
    got = G._search_group(tubes, 1)(queries, chunks)
    for q in queries.to_dict("records"):
        import numpy as np
        import pandas as pd

        inside = {n for n, (la, lo, rail) in at.items() if G._near(np.array([la]), np.array([lo]), q, *tubes["rail" if rail else "bike"])[0]}
        own = pd.DataFrame([e for e in edges if e[0] in inside and e[1] in inside], columns=["from_node", "to_node", "cost"])
        want = G._search(own.assign(query_id=q["query_id"], source=q["source"], target=q["target"])) if len(own) else got[:0]
        mine = got[got["query_id"] == q["query_id"]]
        assert mine[["seq", "osmid", "reached"]].values.tolist() == want[["seq", "osmid", "reached"]].values.tolist(), q["query_id"]
    assert got["query_id"].nunique() > 15


def test_copies_of_a_group_are_small():
    """A row that travels with every copy takes a few bytes, and comes back as it was."""
    import random

    at, edges, chunks, _ = _block(random.Random(7), 60)
    assert chunks["data"].map(len).sum() < 12 * (len(edges) + len(at))
    (a, b, x), (ids, rail, lat, lon) = G._unpacked(chunks)
    assert sorted(zip(a.tolist(), b.tolist(), x.tolist(), strict=True)) == sorted(edges)
    assert {n: (y, z, int(k)) for n, k, y, z in zip(ids.tolist(), rail.tolist(), lat.tolist(), lon.tolist(), strict=True)} == at


def test_hop_edges_once_an_edge(spark):
    """Two trips over the same edges: each edge is found once, the cheapest of a pair."""
    paths = spark.createDataFrame([(q, k, n, 0.0) for q in "ab" for k, n in enumerate((1, 2, 3))], "query_id string, seq int, osmid long, reached double")
    edges = spark.createDataFrame([(1, 2, 0, 5.0), (1, 2, 1, 4.0), (2, 3, 0, 1.0), (3, 1, 0, 1.0)], "from_node long, to_node long, key long, cost double")
    hops = G.path_hops(paths)
    assert hops.count() == 4
    assert {tuple(r) for r in G.hop_edges(hops, edges).collect()} == {(1, 2, 1, 4.0), (2, 3, 0, 1.0)}
    assert {tuple(r) for r in G.path_edges(paths, edges).collect()} == {(q, s, *e) for q in "ab" for s, e in ((1, (1, 2, 1, 4.0)), (2, (2, 3, 0, 1.0)))}


def test_track_stats_reads_geometry(spark):
    import os

    from railspoke.plans.routes import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    assert "bike_ascent_m" in queries()["track_stats"](spark, "/root/testdata/sf0.001").columns
