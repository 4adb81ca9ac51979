"""Registered queries give all of their input's rows."""

import random

import pytest
from pyspark.sql import functions as F

from railspoke.operators import build as B
from railspoke.operators import graph as G
from railspoke.plans import routes

#: place, longitudes and latitudes of two bike nodes; one place per row.
PLACES = [
    ("west", 8.0, 48.0, 8.3, 48.0), ("middle", 12.4, 50.0, 12.6, 50.0), ("east", 16.5, 48.2, 16.7, 48.2),
    ("swapped", 9.0, 49.0, 49.0, 9.0), ("outside", 20.0, 48.0, 20.2, 48.0),
]


#: Off the axis of "west": a bike node by 11 km, a rail node by 56 km.
OFF_AXIS = [(101, 48.1, 8.15, 100.0, "bike", None, None, "r"), (-101, 48.5, 8.15, 100.0, "rail", None, None, "r")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables of a graph with one bike edge in each place."""
    d = str(tmp_path_factory.mktemp("stored"))
    nodes, edges = [*OFF_AXIS], []
    for k, (place, lon_a, lat_a, lon_b, lat_b) in enumerate(PLACES):
        a, b = 2 * k + 1, 2 * k + 2
        nodes += [(a, lat_a, lon_a, 100.0, "bike", None, place, place), (b, lat_b, lon_b, 100.0, "bike", None, place, place)]
        edges.append((a, b, 0, 20_000.0, 0.0, "asphalt", "residential", "bike", None, None, k))
    spark.createDataFrame(
        nodes,
        "osmid long, lat double, lon double, elevation_m double, node_type string, station_name string, place_key string, region_key string",
    ).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame(
        edges,
        "from_node long, to_node long, key long, length_m double, height_diff_m double, surface string, highway string, "
        "mode string, geometry_wkt string, way_id long, row_id long",
    ).withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame(
        [(p, p, "town", lat, lon) for p, lon, lat, _, _ in PLACES],
        "place_key string, name string, kind string, lat double, lon double",
    ).write.parquet(f"{d}/gazetteer.parquet")
    spark.createDataFrame(
        [("r", 6.0, 46.15, 16.8, 54.25)], "region_key string, west double, south double, east double, north double"
    ).write.parquet(f"{d}/build_regions.parquet")
    return d


def test_round_trip_gives_every_row(spark, stored):
    got = routes.queries()["tiled_store_round_trip"](spark, stored)
    sums = {r["table_name"]: r["n"] for r in got.groupBy("table_name").agg(F.count("tile").alias("n")).collect()}
    assert sums == {"nodes": 2 * len(PLACES) + len(OFF_AXIS), "edges": len(PLACES)}
    assert routes.queries()["store_meta"](spark, stored).collect()[0]["n_edges"] == len(PLACES)


def test_the_store_follows_the_files(spark, stored, tmp_path):
    import shutil

    d = str(tmp_path / "copy")
    shutil.copytree(stored, d)
    before = routes.Graph(spark, d).saved()
    assert routes.Graph(spark, d).saved().path == before.path
    more = spark.read.parquet(f"{d}/nodes.parquet").where("osmid = 101").withColumn("osmid", F.lit(202).cast("long"))
    more.write.mode("append").parquet(f"{d}/nodes.parquet")
    after = routes.Graph(spark, d).saved()
    assert after.path != before.path and after.nodes.count() == before.nodes.count() + 1


def test_queries_over_the_cap_get_the_same_paths(spark):
    rng = random.Random(7)
    side = 12
    at = {(i, j): side * i + j + 1 for i in range(side) for j in range(side)}
    nodes = spark.createDataFrame(
        [(n, 48.0 + 0.03 * i, 8.0 + 0.03 * j) for (i, j), n in at.items()], "osmid long, lat double, lon double"
    )
    # whole costs make ties
    rows = [
        (n, at[i + a, j + b], float(rng.randint(1, 3))) for (i, j), n in at.items() for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (i + a, j + b) in at
    ]
    edges = spark.createDataFrame([(q, *r) for q in ("p", "q", "r") for r in rows], "query_id string, from_node long, to_node long, cost double")
    queries = spark.createDataFrame([("p", 1, 144), ("q", 140, 7), ("r", 1, 999)], "query_id string, source long, target long")
    want = {tuple(r) for r in G.shortest_paths(queries, edges).collect()}
    assert {r[0] for r in want} == {"p", "q"}
    assert {tuple(r) for r in G.all_paths(queries, edges, nodes, 10).collect()} == want


def test_large_paths_pass_edges_without_cost(spark):
    nodes = spark.createDataFrame([(n, 48.0, 8.0 + 0.2 * (n % 3)) for n in range(1, 6)], "osmid long, lat double, lon double")
    pairs = [(5, 4, 0.0), (4, 5, 0.0), (4, 3, 0.0), (3, 4, 0.0), (3, 1, 2.0), (5, 5, 0.0), (4, 1, 2.0)]
    edges = spark.createDataFrame([("q", *p) for p in pairs], "query_id string, from_node long, to_node long, cost double")
    queries = spark.createDataFrame([("q", 5, 1), ("same", 2, 2)], "query_id string, source long, target long")
    got = G.large_paths(queries, edges, nodes).orderBy("query_id", "seq").collect()
    assert [(r["query_id"], r["osmid"], r["reached"]) for r in got] == [("q", 5, 0.0), ("q", 4, 0.0), ("q", 3, 0.0), ("q", 1, 2.0), ("same", 2, 0.0)]


def test_every_trip_has_a_verdict(spark, stored):
    got = {r["query_id"]: r["verdict"] for r in routes.queries()["trip_guards"](spark, stored).collect()}
    assert got == {
        "west/west": None, "middle/middle": None, "east/east": None, "swapped/swapped": "too_long", "outside/outside": "out_of_coverage",
        "east/next": "too_long", "middle/next": "too_long", "outside/next": "too_long", "swapped/next": None,
        "west/south": "out_of_coverage", "east/south": "out_of_coverage", "outside/south": "out_of_coverage", "middle/south": "too_long", "swapped/south": "too_long",
    }
    assert routes.queries()["route_queries"](spark, stored).count() == len(got)
    outcome = {r["query_id"]: (r["specified"], r["outcome"]) for r in routes.queries()["route_verdicts"](spark, stored).collect()}
    assert outcome["west/west"] == ("ok", "ok") and outcome["swapped/next"] == ("ok", "no_route")
    assert {k: o for k, (o, _) in outcome.items()} == {k: v or "ok" for k, v in got.items()}


def test_corridors_are_as_wide_as_specified(spark, stored):
    for kind, node in (("bike", 101), ("rail", -101)):
        got = routes.queries()[f"corridor_nodes_{kind}"](spark, stored).where(F.col("osmid") == node)
        assert {r["query_id"] for r in got.collect()} == {"west/west", "swapped/next"}


def test_scans_are_pruned(spark, stored):
    plan = routes.queries()["corridor_edges_combined"](spark, stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((tile_row" in plan or "PartitionFilters: [(((" in plan
    assert "geometry_wkt" not in plan


def test_stations_are_linked_to_their_track(spark):
    place = "osmid long, lat double, lon double"
    stations = spark.createDataFrame([(-1, 48.001, 8.001), (-2, 48.01, 8.001), (-3, 48.0, 8.0)], place)
    bike = spark.createDataFrame([(1, 48.001, 8.0015), (2, 48.01, 8.0015)], place)
    track = spark.createDataFrame(
        [(-3, -12, 48.0, 8.0, 48.0, 8.02)],
        "from_node long, to_node long, from_lat double, from_lon double, to_lat double, to_lon double",
    )
    got = {(r["from_node"], r["to_node"], r["mode"]): r["length_m"] for r in B.wired(stations, bike, track).collect()}
    # -2 is a kilometre off the line, -3 lies on it
    links = {(-1, 1, "station"), (1, -1, "station"), (-1, -3, "rail"), (-3, -1, "rail"), (-3, 1, "station"), (1, -3, "station")}
    assert set(got) == links
    assert got[-1, -3, "rail"] == pytest.approx(133.7, abs=0.5)
    assert {r["from_node"] for r in B.wired(stations, bike, track.limit(0)).collect()} == {-1, -2, -3, 1, 2}


def _towns(spark, n=150, asked=30):
    import random

    rng = random.Random(5)
    at = {i: (48.0 + rng.random() * 0.5, 8.0 + rng.random() * 0.7, "bike" if i % 5 else "rail") for i in range(1, n)}
    nodes = spark.createDataFrame([(i, la, lo, 0.0, k) for i, (la, lo, k) in at.items()], "osmid long, lat double, lon double, elevation_m double, node_type string")
    pairs = [(i, rng.randint(1, n - 1), float(rng.randint(1, 9)), rng.choice(["bike", "rail", None])) for i in at for _ in range(6)]
    edges = spark.createDataFrame(pairs, "from_node long, to_node long, cost double, mode string")
    ends = [(a, b) for a, b in ((rng.randint(1, n - 1), rng.randint(1, n - 1)) for _ in range(asked)) if a != b]
    rows = [(f"q{i}", a, b, *at[a][:2], *at[b][:2]) for i, (a, b) in enumerate(ends)]
    return spark.createDataFrame(rows, "query_id string, source long, target long, lat_a double, lon_a double, lat_b double, lon_b double"), nodes, edges


TUBES = {"bike": (11.0, 2.0), "rail": (14.0, 3.0)}


def test_corridor_edges_are_counted_without_making_them(spark):
    queries, nodes, edges = _towns(spark)
    made = G.corridor_edges(queries, nodes, edges, **TUBES).groupBy("query_id", "mode").count()
    counted = G.corridor_edge_counts(queries, nodes, edges, "mode", **TUBES)
    want = {tuple(r) for r in made.collect()}
    assert len(want) > 40 and {tuple(r) for r in counted.collect()} == want


def test_what_grows_with_the_input_is_never_broadcast(spark):
    queries, nodes, edges = _towns(spark)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(G.corridor_nodes(queries, nodes, 11.0, 2.0))
