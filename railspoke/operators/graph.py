"""The route graph: clean tables, costs, corridors, snapping, search, path materialisation, components.

All operators take and return DataFrames. Route operators carry ``query_id``, so
one plan answers any number of route queries. Ties are always broken by node id
(or by from, to, key), never by storage order.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K
from railspoke.operators.lineage import forget, scratch, written
from railspoke.operators.spatial import points_within


# --- ingest ---


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node with a place: osmid, lat, lon, elevation_m, node_type, station_name, place_key, region_key.

    Nodes without coordinates, or at exactly 0, 0, are left out. Missing
    elevations (null, NaN, below -500 m) are filled with the mean of the known
    ones, to one decimal.
    """
    e = F.col("elevation_m")
    known = F.when(e.isNotNull() & ~F.isnan(e) & (e >= -500.0), e)
    placed = nodes.where("osmid is not null and lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    one = placed.groupBy("osmid").agg(
        F.max("lat").alias("lat"),
        F.max("lon").alias("lon"),
        F.max(known).alias("_known"),
        F.max(F.lower(F.trim("node_type"))).alias("node_type"),
        F.max(F.nullif(F.trim("station_name"), F.lit(""))).alias("station_name"),
        F.max("place_key").alias("place_key"),
        F.max("region_key").alias("region_key"),
    )
    mean = one.agg(F.round(F.avg(F.col("_known").cast("decimal(18,4)")).cast("double"), 1).alias("_mean"))
    # one row
    return one.crossJoin(F.broadcast(mean)).select(
        "osmid",
        "lat",
        "lon",
        F.coalesce("_known", "_mean", F.lit(0.0)).alias("elevation_m"),
        "node_type",
        "station_name",
        "place_key",
        "region_key",
    )


def clean_edges(edges: DataFrame, nodes: DataFrame, *carried: Column) -> DataFrame:
    """One row per (from_node, to_node, key, mode), the first delivered, with both ends and their elevation difference.

    ``row_id`` is unique per delivered row. Self-loops of bike edges are dropped, and edges whose ends do not fit their mode.
    ``carried``: further columns, of what ``with_ends`` adds.
    """
    # everything is decided over narrow columns; geometries are moved once, for the rows that stay
    same = Window.partitionBy("from_node", "to_node", "key", "mode").orderBy("loaded_at", "row_id")
    narrow = edges.select("from_node", "to_node", "key", "mode", "loaded_at", "row_id")
    first = narrow.withColumn("_nth", F.row_number().over(same)).where("_nth = 1 and not (mode = 'bike' and from_node = to_node)")
    typed = typed_edges(with_ends(first.select("from_node", "to_node", "mode", "row_id"), nodes), True)
    kept = typed.select("row_id", (F.col("to_elev") - F.col("from_elev")).alias("height_diff_m"), *carried)
    added = [c for c in kept.columns if c not in ("row_id", "height_diff_m")]
    return edges.drop("height_diff_m").join(kept.hint("merge"), "row_id").select(
        "from_node",
        "to_node",
        "key",
        "length_m",
        "height_diff_m",
        "surface",
        "highway",
        "mode",
        "geometry_wkt",
        "way_id",
        "row_id",
        *added,
    )


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with place, elevation and kind of both ends; edges with a missing end are dropped."""
    out = edges
    for side in ("from", "to"):
        ends = nodes.select(
            F.col("osmid").alias(f"{side}_node"),
            F.col("lat").alias(f"{side}_lat"),
            F.col("lon").alias(f"{side}_lon"),
            F.col("elevation_m").alias(f"{side}_elev"),
            F.col("node_type").alias(f"{side}_type"),
        )
        out = out.join(ends, f"{side}_node")
    return out


def typed_edges(edges: DataFrame, fits: bool) -> DataFrame:
    """Edges whose ends fit their mode (bike-bike, rail-rail, one of each for a station link), or those that do not."""
    a, b, m = F.col("from_type"), F.col("to_type"), F.col("mode")
    ok = (
        F.when(m == "bike", (a == "bike") & (b == "bike"))
        .when(m == "rail", (a == "rail") & (b == "rail"))
        .when(m == "station", (a != b) & a.isin("bike", "rail") & b.isin("bike", "rail"))
        .otherwise(False)
    )
    ok = F.coalesce(ok, F.lit(False))
    return edges.where(ok if fits else ~ok)


# --- cost ---


def costed(edges: DataFrame, prefs: dict[str, Column] | None = None, strict: bool = False) -> DataFrame:
    """Edges with ``cost``; ``height_diff_m`` is the climb in travel direction."""
    cost = C.edge_cost(
        F.col("mode"), F.col("length_m"), F.col("height_diff_m"), F.col("surface"), F.col("highway"), prefs, strict
    )
    return edges.withColumn("cost", cost)


def min_collapse(edges: DataFrame, *keys: str) -> DataFrame:
    """Cheapest edge per directed pair (and further keys): from_node, to_node, cost, key."""
    return edges.groupBy(*keys, "from_node", "to_node").agg(
        F.min("cost").alias("cost"), F.min_by("key", F.struct("cost", "key")).alias("key")
    )


# --- corridors ---

_ENDS = ("lat_a", "lon_a", "lat_b", "lon_b")


#: Fine cells along each side of a coarse one.
COARSE = 10


def corridor_cells(
    queries: DataFrame, half_km: float, extend_km: float, cell: float, occupied: DataFrame | None = None
) -> DataFrame:
    """(query_id, axis, row, col) of the grid cells that a corridor can touch; the exact test comes later.

    ``occupied`` has the row and col of the cells that hold anything: then only
    those come out, met over coarse cells, and a corridor's empty cells are never made.
    """
    if occupied is not None:
        coarse = corridor_cells(queries, half_km, extend_km, cell * COARSE)
        coarse = coarse.withColumnsRenamed({"row": "_row", "col": "_col"})
        fine = occupied.select("row", "col").distinct().withColumns({f"_{c}": F.floor(F.col(c) / COARSE) for c in ("row", "col")})
        # cells of few queries and columns that repeat pack so well that their bytes look broadcastable: they are not
        cells = coarse.hint("merge").join(fine.hint("merge"), ["_row", "_col"])
    else:
        reach = (half_km + extend_km) * 1000.0 / K.METRES_PER_DEGREE
        scale = F.cos(F.radians((F.col("lat_a") + F.col("lat_b")) / 2))
        low = lambda a, b, r: F.floor((F.least(F.col(a), F.col(b)) - r) / cell)
        high = lambda a, b, r: F.floor((F.greatest(F.col(a), F.col(b)) + r) / cell)
        wide = F.lit(reach) / scale
        cells = (
            queries.where((F.col("lat_a") != F.col("lat_b")) | (F.col("lon_a") != F.col("lon_b")))
            .withColumns(C.axis(*map(F.col, _ENDS)))
            .withColumn("row", F.explode(F.sequence(low("lat_a", "lat_b", reach), high("lat_a", "lat_b", reach))))
            .withColumn("col", F.explode(F.sequence(low("lon_a", "lon_b", wide), high("lon_a", "lon_b", wide))))
        )
    return cells.where(_cell_near("row", "col", cell, half_km, extend_km, 1)).select("query_id", *C.AXIS, "row", "col")


def _cell_near(row: str, col: str, cell: float, half_km: float, extend_km: float, sign: int) -> Column:
    """Whether a corridor touches a cell (sign 1; a few more may pass) or holds all of it (sign -1; a few may fail)."""
    middle = [(F.col(row) + 0.5) * cell, (F.col(col) + 0.5) * cell]
    return C.near_axis(*middle, F.lit(half_km * 1000.0 / K.METRES_PER_DEGREE + sign * cell * 0.7072), extend_km)


def _in_cells(rows: DataFrame, cell: float, side: str = "", to: str = "") -> DataFrame:
    return rows.withColumns({f"{to}{c}": F.floor(F.col(f"{side}{x}") / cell) for c, x in (("row", "lat"), ("col", "lon"))})


def corridor_nodes(
    queries: DataFrame, nodes: DataFrame, half_km: float, extend_km: float, cell: float = 0.05
) -> DataFrame:
    """(query_id, node columns) of the nodes in each query's corridor."""
    placed = _in_cells(nodes, cell)
    cells = corridor_cells(queries, half_km, extend_km, cell, placed)
    inside = C.in_corridor(F.col("lat"), F.col("lon"), half_km, extend_km)
    met = cells.hint("merge").join(placed.hint("merge"), ["row", "col"])
    return met.where(inside).select("query_id", *nodes.columns)


def corridor_edges(
    queries: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    bike: tuple[float, float] = (K.BIKE_HALF_WIDTH_KM, K.BIKE_EXTEND_KM),
    rail: tuple[float, float] = (K.RAIL_HALF_WIDTH_KM, K.RAIL_EXTEND_KM),
    cell: float = 0.05,
) -> DataFrame:
    """(query_id, edge columns): bike nodes in the narrow tube, rail nodes in the wide one, edges with both ends in.

    A station link has one end in each tube, which its ends' kinds see to.
    """
    tubes = {"bike": bike, "rail": rail}
    placed = _in_cells(with_ends(edges, nodes), cell, "from_")
    # one equi-join on the cell of the edge's start; the other end is tested by its own place
    out = None
    for kind, (half, extend) in tubes.items():
        own = placed.where(F.col("from_type") == kind)
        cells = corridor_cells(queries, half, extend, cell, own)
        rows = cells.hint("merge").join(own.hint("merge"), ["row", "col"]).where(_ends_inside(tubes, kind))
        rows = rows.select("query_id", *edges.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def _ends_inside(tubes: dict[str, tuple[float, float]], kind: str) -> Column:
    """Whether an edge that starts at a node of ``kind`` has both ends in their tubes."""

    def inside(side: str, kind: str) -> Column:
        return C.in_corridor(F.col(f"{side}_lat"), F.col(f"{side}_lon"), *tubes[kind])

    end = F.when(F.col("to_type") == "bike", inside("to", "bike")).otherwise(inside("to", "rail"))
    return inside("from", kind) & end


def corridor_edge_counts(
    queries: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    *by: str,
    bike: tuple[float, float] = (K.BIKE_HALF_WIDTH_KM, K.BIKE_EXTEND_KM),
    rail: tuple[float, float] = (K.RAIL_HALF_WIDTH_KM, K.RAIL_EXTEND_KM),
    cell: float = 0.05,
) -> DataFrame:
    """(query_id, by, n_edges): how many rows ``corridor_edges`` has, without making them.

    Edges are counted once per pair of cells; a query adds the counts of the
    pairs that it holds as a whole and tests single edges only where its rim passes.
    """
    tubes = {"bike": bike, "rail": rail}
    pair = ["row", "col", "to_row", "to_col", "to_rail", *by]
    placed = with_ends(edges.select("from_node", "to_node", *by), nodes)
    placed = _in_cells(_in_cells(placed, cell, "from_"), cell, "to_", "to_").withColumn("to_rail", F.coalesce(F.col("to_type") != "bike", F.lit(True)))
    ends = ["from_lat", "from_lon", "to_lat", "to_lon"]
    placed = placed.select("from_type", "to_type", *ends, *pair)
    # few, and a plan that made them over and over would be large
    counts = written(placed.groupBy("from_type", *pair).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    out = None
    for kind, (half, extend) in tubes.items():
        own = placed.where(F.col("from_type") == kind)
        pairs = counts.where(F.col("from_type") == kind).drop("from_type")
        cells = corridor_cells(queries, half, extend, cell, pairs)

        def to(sign: int) -> Column:
            one = {k: _cell_near("to_row", "to_col", cell, *tube, sign) for k, tube in tubes.items()}
            return F.when(F.col("to_rail"), one["rail"]).otherwise(one["bike"])

        met = cells.hint("merge").join(pairs.hint("merge"), ["row", "col"]).where(to(1))
        whole = _cell_near("row", "col", cell, half, extend, -1) & to(-1)  # noqa: B023
        met = met.withColumn("_whole", whole)
        sums = met.where("_whole").select("query_id", *by, "_n")
        rim = met.where("not _whole").select("query_id", *C.AXIS, *pair)
        same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in pair])
        tested = rim.alias("l").hint("merge").join(own.alias("r").hint("merge"), same)
        tested = tested.select("query_id", *C.AXIS, "from_lat", "from_lon", "to_lat", "to_lon", "to_type", *[F.col(f"r.{c}").alias(c) for c in by])
        tested = tested.where(_ends_inside(tubes, kind)).select("query_id", *by, F.lit(1).cast("long").alias("_n"))
        both = sums.unionByName(tested)
        out = both if out is None else out.unionByName(both)
    return out.groupBy("query_id", *by).agg(F.sum("_n").alias("n_edges"))


def too_large(edges: DataFrame, most: int = K.MAX_CORRIDOR_EDGES) -> DataFrame:
    """(query_id, edges) of queries whose corridor holds more edges than a search may take."""
    return edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > most)


def trip_guard(
    queries: DataFrame,
    west: Column | float,
    south: Column | float,
    east: Column | float,
    north: Column | float,
    min_km: float = K.MIN_TRIP_KM,
    max_km: float = K.MAX_TRIP_KM,
) -> DataFrame:
    """Queries with ``trip_km`` and ``verdict``: too_short, too_long, out_of_coverage or null."""
    km = C.haversine_m(*map(F.col, _ENDS)) / 1000.0
    inside = reduce(
        lambda a, b: a & b,
        [F.col(f"lat_{e}").between(south, north) & F.col(f"lon_{e}").between(west, east) for e in "ab"],
    )
    verdict = (
        F.when(km < min_km, "too_short")
        .when(km > max_km, "too_long")
        .when(~inside, "out_of_coverage")
    )
    return queries.withColumn("trip_km", km).withColumn("verdict", verdict)


# --- nearest ---


#: Half the way around the globe, and a little.
EVERYWHERE_M = 20_100_000.0


def _around(points: DataFrame, nodes: DataFrame, radius_m: float) -> DataFrame:
    """The nodes in the grid cells that the radius around any point touches; a bounded number of cells per point."""
    rows = max(1, int(180.0 / max(radius_m / K.METRES_PER_DEGREE, 0.01)))
    cell = 180.0 / rows
    # columns lie around the globe; near the poles a point would touch them all, so its row is taken whole
    reach = F.lit(radius_m / K.METRES_PER_DEGREE * 1.01)
    wide = reach / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(80.0))))
    row = lambda y: F.floor((y + 90.0) / cell)
    col = lambda x: F.floor((x + 180.0) / cell)
    polar = F.abs("lat") + reach >= 80.0
    cells = points.select("lat", "lon", F.explode(F.sequence(row(F.col("lat") - reach), row(F.col("lat") + reach))).alias("_row"), polar.alias("_polar"), wide.alias("_w"))
    cells = cells.select(
        "_row",
        F.explode(F.when(F.col("_polar"), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(col(F.col("lon") - F.col("_w")), col(F.col("lon") + F.col("_w"))))).alias("_col"),
    )
    cells = cells.select("_row", F.when(F.col("_col") >= 0, F.pmod("_col", F.lit(2 * rows))).otherwise(F.when(F.col("_col") < -1, F.pmod("_col", F.lit(2 * rows))).otherwise(F.col("_col"))).alias("_col")).distinct()
    placed = nodes.withColumn("_row", row(F.col("lat"))).withColumn("_at", F.array(F.pmod(col(F.col("lon")), F.lit(2 * rows)), F.lit(-1).cast("long")))
    hit = placed.withColumn("_col", F.explode("_at")).join(cells, ["_row", "_col"], "left_semi")
    return hit.select(*nodes.columns).distinct()


def nearest(
    points: DataFrame,
    nodes: DataFrame,
    key: str,
    most: int = 1,
    radii: tuple[float, ...] = (500.0, 2000.0, 8000.0),
    beyond: bool = True,
) -> DataFrame:
    """(key, osmid, distance_m, rank) of the ``most`` nodes nearest to each point, ties by osmid.

    Radii are tried in turn, the next one only for points that found too few
    nodes, and each search meets only nodes in the cells around those points.
    With ``beyond`` the radius then grows fourfold until it goes around the
    globe, so every point gets its nodes; without, points with fewer nodes than
    ``most`` within the last radius give those.
    """
    whole = "lat is not null and lon is not null"
    at = points.where(whole).select(F.col(key).alias("_p"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    place = nodes.where(whole).select("osmid", "lat", "lon")
    kind = "string"
    steps = list(radii)
    while beyond and steps[-1] < EVERYWHERE_M:
        steps.append(min(EVERYWHERE_M, 4 * steps[-1]))
    left = at.select(F.col("_p").cast(kind).alias("osmid"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    found = None
    for k, radius in enumerate(steps):
        near = _around(left, place, radius) if radius <= 50_000.0 else place
        right = near.select(F.col("osmid").cast(kind).alias("osmid"), "lat", "lon")
        pairs = points_within(left, right, radius, one_sided=True)
        rows = (
            pairs.join(at, F.col("left_id") == F.col("_p").cast(kind))
            .join(near, F.col("right_id") == F.col("osmid").cast(kind))
            .select("_p", "osmid", C.haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")).alias("distance_m"))
        )
        # equal to the micrometre is a tie
        w = Window.partitionBy("_p").orderBy(F.round("distance_m", 6), "osmid")
        ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
        last = k == len(steps) - 1
        if last and found is None:
            found = ranked
            break
        ranked = written(ranked, "nearest")
        full = ranked.where(F.col("rank") == most).select(F.col("_p").cast(kind).alias("osmid"))
        done = ranked if last else ranked.join(full.withColumnRenamed("osmid", "_f"), F.col("_p").cast(kind) == F.col("_f"), "left_semi")
        found = done if found is None else found.unionByName(done)
        if last:
            break
        left = written(left.join(full, "osmid", "left_anti"), "unresolved")
        if left.isEmpty():
            break
    return found.select(F.col("_p").alias(key), "osmid", "distance_m", "rank")


# --- search ---


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Binary-heap Dijkstra of one query; rows (query_id, seq, osmid, reached) along the cheapest path."""
    query, source, target = pdf["query_id"].iat[0], int(pdf["source"].iat[0]), int(pdf["target"].iat[0])
    ids, codes = np.unique(
        np.concatenate([pdf["from_node"].to_numpy(), pdf["to_node"].to_numpy(), [source, target]]), return_inverse=True
    )
    n = len(pdf)
    tail, head, cost = codes[:n], codes[n : 2 * n], pdf["cost"].to_numpy("float64")
    s, t = int(codes[2 * n]), int(codes[2 * n + 1])
    by_tail = np.argsort(tail, kind="stable")
    begin = np.searchsorted(tail[by_tail], np.arange(len(ids) + 1))
    heads, costs = head[by_tail].tolist(), cost[by_tail].tolist()
    begin = begin.tolist()
    best, before = {s: 0.0}, {s: -1}
    heap, settled = [(0.0, s)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in settled:
            continue
        settled.add(u)
        if u == t:
            break
        for k in range(begin[u], begin[u + 1]):
            v, reached = heads[k], d + costs[k]
            old = best.get(v)
            if old is None or reached < old or (reached == old and u < before[v]):
                best[v], before[v] = reached, u
                heapq.heappush(heap, (reached, v))
    path = []
    if t in settled:
        u = t
        while u >= 0:
            path.append(u)
            u = before[u]
        path.reverse()
    return pd.DataFrame(
        {
            "query_id": pd.Series([query] * len(path), dtype="object"),
            "seq": np.arange(len(path), dtype="int32"),
            "osmid": ids[path].astype("int64") if path else np.array([], dtype="int64"),
            "reached": [best[u] for u in path],
        }
    )


def shortest_paths(queries: DataFrame, edges: DataFrame, most: int = K.MAX_CORRIDOR_EDGES) -> DataFrame:
    """(query_id, seq, osmid, reached): the cheapest path of each query, none where the target is not reached.

    ``queries`` has query_id (string), source and target; ``edges`` has
    query_id, from_node, to_node and cost. One task searches one query, over
    four narrow columns; queries with more than ``most`` edges are left out
    here (see ``too_large``) and are answered by ``large_paths``.
    """
    return _small_paths(queries, written(edges.select("query_id", "from_node", "to_node", "cost"), "corridors"), most)


def _small_paths(queries: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    small = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select("query_id")
    rows = (
        edges.join(small, "query_id", "left_semi")
        .join(queries.select("query_id", "source", "target"), "query_id")
        .select("query_id", "from_node", "to_node", "cost", "source", "target")
    )
    return rows.groupBy("query_id").applyInPandas(_search, "query_id string, seq int, osmid long, reached double")


def _spread(key: tuple, known: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Costs carried from the changed nodes of one block along its edges until nothing in the block gets cheaper."""
    best = {u: (d, h) for u, d, h in zip(known["osmid"].tolist(), known["reached"].tolist(), known["hops"].tolist(), strict=True)}
    inner = set(edges["from_node"].tolist()) | set(best)
    out: dict[int, list[tuple[int, float]]] = {}
    for u, v, c in zip(edges["from_node"].tolist(), edges["to_node"].tolist(), edges["cost"].tolist(), strict=True):
        out.setdefault(u, []).append((v, c))
    heap = [(*best[u], u) for u in known.loc[known["changed"], "osmid"].tolist()]
    heapq.heapify(heap)
    new = {}
    while heap:
        d, h, u = heapq.heappop(heap)
        if (d, h) > best[u]:
            continue
        for v, c in out.get(u, ()):
            reached = (d + c, h + 1)
            if v not in best or reached < best[v]:
                best[v] = new[v] = reached
                if v in inner:
                    heapq.heappush(heap, (*reached, v))
    return pd.DataFrame(
        {
            "query_id": pd.Series([key[0]] * len(new), dtype="object"),
            "osmid": np.array(list(new), dtype="int64"),
            "reached": np.array([d for d, _ in new.values()], dtype="float64"),
            "hops": np.array([h for _, h in new.values()], dtype="int64"),
            "across": np.array([v not in inner for v in new], dtype="bool"),
        }
    )


def large_paths(queries: DataFrame, edges: DataFrame, nodes: DataFrame, cell: float = 0.1) -> DataFrame:
    """As ``shortest_paths``, for corridors too large for one task: a task searches one grid cell of one query.

    Rounds run until no cost crosses into another cell and gets a node cheaper
    there, so their number grows with the cells along a path. A node's state is
    its cost and, at equal cost, its number of hops; the predecessor is the
    smallest node id that gives the node's cost, as in ``shortest_paths``.
    Paths are read back by pointer doubling. ``nodes`` has osmid, lat and lon.
    """
    block = F.concat_ws("/", F.floor(F.col("lat") / cell), F.floor(F.col("lon") / cell)).alias("block")
    at = written(nodes.select("osmid", block), "blocks")
    edges = written(
        edges.select("query_id", "from_node", "to_node", "cost").join(at.withColumnRenamed("osmid", "from_node"), "from_node"), "edges"
    )
    state = "query_id", "osmid", "reached", "hops"
    start = queries.select("query_id", F.col("source").alias("osmid"), F.lit(0.0).alias("reached"), F.lit(0).cast("long").alias("hops"))
    known = written(start.join(at, "osmid").withColumn("changed", F.lit(True)).select(*state, "block", "changed"), "reach")
    while not known.where("changed").isEmpty():
        open_ = known.where("changed").select("query_id", "block").distinct()
        there = known.join(open_, ["query_id", "block"], "left_semi").groupBy("query_id", "block")
        along = edges.join(open_, ["query_id", "block"], "left_semi").groupBy("query_id", "block")
        new = there.cogroup(along).applyInPandas(
            _spread, "query_id string, osmid long, reached double, hops long, across boolean"
        )
        both = known.select(*state, F.lit(False).alias("across")).unionByName(new)
        label = F.struct("reached", "hops")
        one = both.groupBy("query_id", "osmid").agg(
            F.min(label).alias("_l"), F.min(F.when(~F.col("across"), label)).alias("_own")
        )
        changed = F.col("_own").isNull() | (F.col("_l") < F.col("_own"))
        one = one.select("query_id", "osmid", "_l.*", changed.alias("changed")).join(at, "osmid")
        known = written(one.select(*state, "block", "changed"), "reach")
    known = known.select(*state)
    # a predecessor is strictly before its node in (reached, hops), so pointers have no cycle
    head = known.select("query_id", F.col("osmid").alias("to_node"), F.col("reached").alias("_r"), F.col("hops").alias("_h"))
    pointer = (
        known.withColumnRenamed("osmid", "from_node")
        .join(edges, ["query_id", "from_node"])
        .join(head, ["query_id", "to_node"])
        .where("reached + cost = _r and (reached < _r or hops < _h)")
        .groupBy("query_id", "to_node")
        .agg(F.min("from_node").alias("before"))
        .select("query_id", F.col("to_node").alias("osmid"), "before")
    )
    # nothing leads on from a source
    ends = queries.select("query_id", F.col("source").alias("osmid"))
    pointer = written(pointer.join(ends, ["query_id", "osmid"], "left_anti"), "pointers")
    ends = queries.select("query_id", F.col("target").alias("osmid"))
    path = written(ends.join(known, ["query_id", "osmid"], "left_semi"), "path")
    while True:
        found = path.join(pointer, ["query_id", "osmid"]).select("query_id", F.col("before").alias("osmid"))
        if found.isEmpty():
            break
        path = written(path.unionByName(found), "path")
        onward = pointer.select("query_id", F.col("osmid").alias("before"), F.col("before").alias("_b"))
        pointer = written(pointer.join(onward, ["query_id", "before"]).select("query_id", "osmid", F.col("_b").alias("before")), "pointers")
    w = Window.partitionBy("query_id").orderBy("reached", "hops")
    return path.join(known, ["query_id", "osmid"]).select(
        "query_id", (F.row_number().over(w) - 1).cast("int").alias("seq"), "osmid", "reached"
    )


def all_paths(queries: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = K.MAX_CORRIDOR_EDGES) -> DataFrame:
    """``shortest_paths``, and ``large_paths`` for the queries that have more than ``most`` edges."""
    edges = written(edges.select("query_id", "from_node", "to_node", "cost"), "corridors")
    large = written(too_large(edges, most).select("query_id"), "large")
    found = _small_paths(queries, edges, most)
    if large.isEmpty():
        return found
    rest = [rows.join(large, "query_id", "left_semi") for rows in (queries, edges)]
    return found.unionByName(large_paths(*rest, nodes))


#: Queries that one task searches at most on the edges it holds, while copies of its group's edges are few.
BLOCK_QUERIES = 250

#: Edges that a group's copies may hold together; a group has two copies even so, so edges moved do not grow with queries.
COPIED_EDGES = 500_000

#: Edges that one task holds at most for the queries of a group: 82 bytes each were measured, with the states of a search.
#: Larger groups are answered trip by trip, on copies of a trip's corridor.
HELD_EDGES = 3_300_000

#: Edges that the corridors copied at a time may hold, for each edge of the graph, and at least.
WAVE_COPIES, LEAST_WAVE = 2, 5_000_000

#: Queries of a connected part from which bounds for it are worth their searches, and from which twice as many are.
BOUNDED_QUERIES, MORE_BOUNDS = 12, 100

#: Rows that one packed chunk is made from, about.
PACKED_ROWS = 500_000


#: Degrees of the cells by whose pair, of a trip's ends, queries are grouped.
GROUP_DEG = 1.0


def query_groups(queries: DataFrame, tubes: dict[str, tuple[float, float]], size: float = K.TILE_DEG) -> tuple[DataFrame, DataFrame]:
    """(query_id, group) and (group, kind, tile_row, tile_col): queries between the same two cells of a degree are one
    group, with the tiles that any of their corridors touches, for bike and for rail nodes.
    """
    # a number, as it travels with every edge: cells are below 1000 in each direction
    key = sum(((F.floor(F.col(c) / GROUP_DEG) + 500) * F.lit(1000**k) for k, c in enumerate(_ENDS)), F.lit(0).cast("long"))
    named = written(queries.select("query_id", key.alias("group")), "groups")
    tiles = None
    for kind, (half, extend) in tubes.items():
        one = corridor_cells(queries, half, extend, size).select(
            "query_id", F.lit(kind).alias("kind"), F.col("row").cast("int").alias("tile_row"), F.col("col").cast("int").alias("tile_col")
        )
        tiles = one if tiles is None else tiles.unionByName(one)
    return named, tiles.join(named, "query_id").select("group", "kind", "tile_row", "tile_col").distinct()


def _near(lat: np.ndarray, lon: np.ndarray, q: dict, half_km: float, extend_km: float) -> np.ndarray:
    """As ``in_corridor``, over arrays."""
    reach, ext = half_km * 1000.0 / K.METRES_PER_DEGREE, extend_km * 1000.0 / K.METRES_PER_DEGREE
    px, py = lon * q["ax_scale"] - q["ax_x"], lat - q["ax_y"]
    along = np.clip(px * q["ax_ux"] + py * q["ax_uy"], -ext, q["ax_len"] + ext)
    return np.hypot(px - along * q["ax_ux"], py - along * q["ax_uy"]) <= reach


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 8-byte values, all first ones first: neighbours repeat, so that they pack well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes()


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges and nodes as chunks by kind and tile, a few bytes a row; ``_unpacked`` gives them back."""

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        rail, row, col, a, b, x, y = (rows[c].to_numpy() for c in ("rail", "tile_row", "tile_col", "a", "b", "x", "y"))
        edge = np.isnan(y)
        order = np.lexsort((b, a, edge, col, row, rail))
        rail, row, col, a, b, x, y, edge = (v[order] for v in (rail, row, col, a, b, x, y, edge))
        new = np.flatnonzero((np.diff(rail) != 0) | (np.diff(row) != 0) | (np.diff(col) != 0)) + 1
        out = []
        for k, n in zip([0, *new.tolist()], [*new.tolist(), len(a)], strict=True):
            nodes = int((~edge[k:n]).sum())
            m = k + nodes
            data = [np.diff(a[k:n], prepend=0), np.concatenate([b[k:m], b[m:n] - a[m:n]]), x[k:n], y[k:m]]
            out.append(("rail" if rail[k] else "bike", row[k], col[k], n - m, nodes, zlib.compress(b"".join(map(_planes, data)), 1)))
        return pd.DataFrame(out, columns=["kind", "tile_row", "tile_col", "edges", "nodes", "data"])

    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= PACKED_ROWS:
            yield packed(held)
            held = []
    if sum(map(len, held)):
        yield packed(held)


def _unpacked(chunks: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(ends and costs of edges; ids, whether rail, latitude and longitude of nodes)."""
    edges: list[list] = [[], [], []]
    nodes: list[list] = [[], [], [], []]
    for n, m, data in zip(chunks["edges"].tolist(), chunks["nodes"].tolist(), chunks["data"].tolist(), strict=True):
        flat = np.frombuffer(zlib.decompress(data), np.uint8)

        def values(at: int, count: int, kind: str) -> np.ndarray:
            return np.ascontiguousarray(flat[8 * at : 8 * (at + count)].reshape(8, count).T).view(kind).ravel()  # noqa: B023

        a, b, x = np.cumsum(values(0, n + m, "int64")), values(n + m, n + m, "int64"), values(2 * (n + m), n + m, "float64")
        for to, v in zip(edges, (a[m:], a[m:] + b[m:], x[m:]), strict=True):
            to.append(v)
        for to, v in zip(nodes, (a[:m], b[:m] == 1, x[:m], values(3 * (n + m), m, "float64")), strict=True):
            to.append(v)
    return [np.concatenate(v) for v in edges], [np.concatenate(v) for v in nodes]


def _by_end(ends: np.ndarray, others: np.ndarray, cost: np.ndarray, n: int) -> tuple[array, array, array]:
    """Edges by one end: where each node's begin, their other ends and their costs, in packed arrays."""
    order = np.argsort(ends, kind="stable")
    begin = np.searchsorted(ends[order], np.arange(n + 1)).astype("int64")
    return array("q", begin.tobytes()), array("i", others[order].astype("int32").tobytes()), array("d", cost[order].tobytes())


def _connected(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A number per node, the same for all nodes that edges connect, whatever their direction."""
    label = np.arange(n)
    while True:
        a, b = label[tail], label[head]
        if (a == b).all():
            return np.unique(label, return_inverse=True)[1]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != label[label]).any():
            label = label[label]


def _costs_from(s: int, n: int, begin: array, others: array, costs: array) -> np.ndarray:
    """The cost from a node to every node, infinite where there is no way."""
    best = [math.inf] * n
    best[s] = 0.0
    heap = [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for k in range(begin[u], begin[u + 1]):
            v, reached = others[k], d + costs[k]
            if reached < best[v]:
                best[v] = reached
                heapq.heappush(heap, (reached, v))
    return np.array(best)


def _search_group(tubes: dict[str, tuple[float, float]], bounded: int = BOUNDED_QUERIES):
    """The cheapest paths of the queries of a block, over the edges they share, each in its own corridor.

    Where a connected part has many queries, the costs from and to a few of its
    outermost nodes bound what is left to the target from below (by the triangle
    inequality; a corridor only makes ways dearer), and a search leaves out what
    cannot be on a cheapest path. Costs, paths and ties are those of a plain search.
    """

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        (a, b, cost), (ids, rail, lat, lon) = _unpacked(rows)
        ids, first = np.unique(ids, return_index=True)
        rail, lat, lon, n = rail[first], lat[first], lon[first], len(ids)
        found: dict[str, list] = {"query_id": [], "seq": [], "osmid": [], "reached": []}
        asked = queries.to_dict("records") if n else []
        if n:
            # a node without a row lies in no tile of the group, so in no corridor
            tail, head = (np.minimum(np.searchsorted(ids, v), n - 1) for v in (a, b))
            known = (ids[tail] == a) & (ids[head] == b)
            tail, head, cost = tail[known], head[known], cost[known]
            part = _connected(n, tail, head)
            begin, heads, costs = _by_end(tail, head, cost, n)
            back = _by_end(head, tail, cost, n)
            by_part = np.argsort(part, kind="stable")
            starts = np.searchsorted(part[by_part], np.arange(part.max() + 2))
            del tail, head, cost, known
        del a, b, rows

        def at(osmid: int) -> int:
            k = int(np.searchsorted(ids, osmid))
            return k if k < n and ids[k] == osmid else -1

        ends = [(at(int(q["source"])), at(int(q["target"]))) for q in asked]
        many: dict[int, int] = {}
        for s, t in ends:
            if s >= 0 and t >= 0 and part[s] == part[t]:
                many[int(part[s])] = many.get(int(part[s]), 0) + 1
        boxes: dict[int, list] = {}
        bounds: dict[int, np.ndarray] = {}
        free = array("d", bytes(8 * n))

        def inside(q: dict, p: int) -> bytes | None:
            """Which nodes are in the corridor, right for the nodes of a part; None: all of them."""
            own = by_part[starts[p] : starts[p + 1]]
            if p not in boxes:
                boxes[p] = [
                    (k, np.repeat([lat[m].min(), lat[m].max()], 2), np.tile([lon[m].min(), lon[m].max()], 2))
                    for k, m in (("rail", own[rail[own]]), ("bike", own[~rail[own]]))
                    if len(m)
                ]
            # a corridor is convex: it holds a box whose corners it holds
            if all(_near(y, x, q, tubes[k][0] * (1 - 1e-9), tubes[k][1]).all() for k, y, x in boxes[p]):
                return None
            out = np.zeros(n, bool)
            out[own] = np.where(rail[own], _near(lat[own], lon[own], q, *tubes["rail"]), _near(lat[own], lon[own], q, *tubes["bike"]))
            return out.tobytes()

        def bound(s: int, t: int, p: int) -> array | None:
            """For every node of a part what is left to t at least; None where t cannot be reached from s."""
            if many[p] < bounded:
                return free
            own = by_part[starts[p] : starts[p + 1]]
            if p not in bounds:
                sides = (lat[own] + lon[own], lat[own] - lon[own], lat[own], lon[own])[: 4 if many[p] >= MORE_BOUNDS else 2]
                marks = sorted({int(own[f(v)]) for v in sides for f in (np.argmin, np.argmax)})
                both = [_costs_from(m, n, *way)[own] * sign for way, sign in (((begin, heads, costs), -1.0), (back, 1.0)) for m in marks]
                bounds[p] = np.vstack(both)
            table = bounds[p]
            k, m = (int(np.searchsorted(own, v)) for v in (s, t))
            with np.errstate(invalid="ignore"):
                best = np.nan_to_num(table[:, k] - table[:, m], nan=-math.inf, posinf=math.inf, neginf=-math.inf)
                if best.max() == math.inf:
                    return None
                top = np.argsort(best)[-4:]
                left = np.fmax(np.fmax.reduce(table[top] - table[top, m][:, None]), 0.0)
            out = np.zeros(n)
            # a little less, for what sums are rounded by
            out[own] = left * (1 - 1e-9)
            return array("d", out.tobytes())

        for q, (s, t) in zip(asked, ends, strict=True):
            if s < 0 or t < 0 or part[s] != part[t]:
                continue
            p = int(part[s])
            here = inside(q, p)
            if here is not None and not (here[s] and here[t]):
                continue
            left = bound(s, t, p)
            if left is None:
                continue
            best, before, heap, most = {s: 0.0}, {s: -1}, [(left[s], 0.0, s)], math.inf
            while heap:
                f, d, u = heapq.heappop(heap)
                if f > most:
                    break
                if d > best[u] or u == t:
                    continue
                for k in range(begin[u], begin[u + 1]):
                    v = heads[k]
                    if here is not None and not here[v]:
                        continue
                    reached = d + costs[k]
                    old = best.get(v)
                    if old is None or reached < old:
                        f = reached + left[v]
                        # beyond the best way known, or no way to the target
                        if f > most or f == math.inf:
                            continue
                        best[v], before[v] = reached, u
                        heapq.heappush(heap, (f, reached, v))
                        if v == t:
                            # ways that cost the same, but for rounding, are still seen
                            most = reached * (1 + 1e-9) + 1e-6
                    elif reached == old and d < old and u < before[v]:
                        before[v] = u
            if t not in best:
                continue
            path, u = [], t
            while u >= 0:
                path.append(u)
                u = before[u]
            path.reverse()
            found["query_id"] += [q["query_id"]] * len(path)
            found["seq"] += range(len(path))
            found["osmid"] += ids[path].tolist()
            found["reached"] += [best[u] for u in path]
        kinds = {"seq": "int32", "osmid": "int64", "reached": "float64"}
        return pd.DataFrame({c: pd.Series(v, dtype=kinds.get(c, "object")) for c, v in found.items()})

    return run


def routes(
    queries: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    bike: tuple[float, float] = (K.BIKE_HALF_WIDTH_KM, K.BIKE_EXTEND_KM),
    rail: tuple[float, float] = (K.RAIL_HALF_WIDTH_KM, K.RAIL_EXTEND_KM),
    most: int = HELD_EDGES,
    block: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, seq, osmid, reached): the cheapest path of each query within its corridor, none where there is none.

    ``queries``: query_id, source, target, lat_a, lon_a, lat_b, lon_b; ``edges``
    has a cost. Queries between the same two cells of a degree share copies of
    the edges of their corridors' tiles, one for every ``block`` queries while they hold
    few edges together (``COPIED_EDGES``), else two, and each query is searched within its
    own corridor there; so the edges moved grow with the groups and not with the queries. Groups of more than ``most`` edges are answered query
    by query, on corridor edges (``all_paths``), in waves, so that copies grow with the graph and not with the queries. Trips that begin
    where they end have no corridor and no path.
    """
    tubes = {"bike": bike, "rail": rail}
    named, tiles = query_groups(queries, tubes)
    tile = {"tile_row": C.tile(F.col("lat")), "tile_col": C.tile(F.col("lon"))}
    at = nodes.where("not isnan(lat) and not isnan(lon)").withColumn("rail", F.coalesce(F.col("node_type") == "rail", F.lit(False)).cast("int"))
    at = at.withColumns(tile)
    start = at.where("node_type in ('bike', 'rail')").select(F.col("osmid").alias("from_node"), "rail", *tile)
    # edges between two nodes count once, the cheapest: a and b are their ends, x the cost; nodes have kind, latitude and longitude there
    slim = edges.select("from_node", "to_node", "cost").groupBy("from_node", "to_node").agg(F.min("cost").alias("cost")).where("cost is not null and not isnan(cost)").join(start, "from_node")
    of = ["rail", *tile]
    slim = slim.select(*of, F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("cost").alias("x"), F.lit(math.nan).alias("y"))
    known = at.select(*of, F.col("osmid").alias("a"), F.col("rail").cast("long").alias("b"), F.col("lat").alias("x"), F.col("lon").alias("y"))
    # chunks of many rows, as they travel with every copy
    placed = slim.unionByName(known).mapInPandas(_packed, "kind string, tile_row int, tile_col int, edges long, nodes long, data binary")
    placed, here = written(placed, "placed"), ["kind", *tile]
    # counts per tile, then per group: the edges themselves are not joined for it
    per_tile = placed.groupBy(*here).agg(F.sum("edges").alias("_n"))
    tiles = written(tiles, "tiles")
    sizes = tiles.join(per_tile, here).groupBy("group").agg(F.sum("_n").alias("edges"))
    sizes = written(sizes.where("edges > 0"), "sizes")
    small = sizes.where(F.col("edges") <= most)
    w = Window.partitionBy("group")
    # searching takes time, copies take room: many small blocks of small groups, two of large ones
    copies = F.greatest(F.lit(2), F.floor(F.lit(COPIED_EDGES) / F.col("edges")))
    asked = queries.join(named, "query_id").join(small, "group").withColumn("_blocks", F.least(copies, F.ceil(F.count(F.lit(1)).over(w) / block)))
    asked = asked.withColumn("block", F.pmod(F.row_number().over(w.orderBy("query_id")), "_blocks"))
    asked = written(asked.withColumns(C.axis(*map(F.col, _ENDS))).select("group", "block", "query_id", "source", "target", *C.AXIS), "asked")
    blocks = asked.select("group", "block").distinct().toDF("group", "block")
    shared = tiles.join(blocks, "group").join(placed, here).select("group", "block", "edges", "nodes", "data")
    # as many tasks as blocks, which must not be merged for their size
    tasks = min(10_000, max(1, 2 * blocks.count()))
    found = (
        asked.repartition(tasks, "group", "block")
        .groupBy("group", "block")
        .cogroup(shared.repartition(tasks, "group", "block").groupBy("group", "block"))
        .applyInPandas(_search_group(tubes), "query_id string, seq int, osmid long, reached double")
    )
    found = written(found, "found")
    # the copies of a wave hold together some edges for each of the graph and those of one corridor at most
    held = max(LEAST_WAVE, WAVE_COPIES * (per_tile.agg(F.sum("_n")).first()[0] or 0))
    rest = queries.join(named, "query_id").join(sizes.where(F.col("edges") > most), "group")
    # narrow rows of the queries of large groups only
    so_far = F.sum("edges").over(Window.orderBy("group", "query_id").rowsBetween(Window.unboundedPreceding, -1))
    rest = written(rest.select(*queries.columns, F.floor(F.coalesce(so_far, F.lit(0)) / held).alias("_wave")), "rest")
    waves = [r["_wave"] for r in rest.select("_wave").distinct().orderBy("_wave").collect()]
    for done in (placed, tiles, sizes, asked, named):
        forget(done)
    every = [found]
    for k in waves:
        own = written(rest.where(F.col("_wave") == k).select(*queries.columns), "asked")
        every.append(_wave_paths(own, nodes, edges, bike, rail, min(most, K.MAX_CORRIDOR_EDGES)))
        forget(own)
    forget(rest)
    return found if not waves else queries.sparkSession.read.schema(found.schema).parquet(*sorted({f.rpartition("/")[0] for d in every for f in d.inputFiles()}))


def _wave_paths(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, bike: tuple[float, float], rail: tuple[float, float], most: int
) -> DataFrame:
    """``all_paths`` of a few queries on copies of their corridors; what it writes on the way is deleted."""
    with scratch(queries.sparkSession) as kept:
        own = corridor_edges(queries, nodes, edges.select("from_node", "to_node", "cost"), bike, rail)
        own = own.groupBy("query_id", "from_node", "to_node").agg(F.min("cost").alias("cost"))
        return kept(all_paths(queries, own, nodes, most), "found")


def reach_all(sources: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(query_id, osmid, reached) of every node that a query's source reaches, by rounds of relaxation on DataFrames.

    ``sources`` has query_id and source; ``edges`` from_node, to_node and cost,
    and query_id where each query has its own. Each round extends only the nodes
    that got cheaper in the last one and writes only rows that are new; the rows
    of all rounds are folded into one table now and then. More than ``rounds``
    rounds are an error, not a result.
    """
    spark = sources.sparkSession
    own = "query_id" in edges.columns
    front = written(sources.select("query_id", F.col("source").alias("osmid"), F.lit(0.0).alias("reached")), "reach")
    deltas = [front]
    for k in range(rounds):
        walk = front.withColumnRenamed("osmid", "from_node")
        step = walk.join(edges, ["query_id", "from_node"] if own else "from_node")
        step = step.groupBy("query_id", F.col("to_node").alias("osmid")).agg(F.min(F.col("reached") + F.col("cost")).alias("new"))
        known = deltas[0]
        for d in deltas[1:]:
            known = known.unionByName(d)
        if len(deltas) > 8:
            # a node's last row is its cheapest
            folded = written(known.groupBy("query_id", "osmid").agg(F.min("reached").alias("reached")), "reach")
            for d in deltas[:-1]:
                forget(d)
            deltas, known = [folded], folded
        best = known.groupBy("query_id", "osmid").agg(F.min("reached").alias("reached")) if len(deltas) > 1 else known
        better = step.join(best, ["query_id", "osmid"], "left").where("reached is null or new < reached")
        front = written(better.select("query_id", "osmid", F.col("new").alias("reached")), "reach")
        if front.isEmpty():
            break
        deltas.append(front)
    else:
        raise RuntimeError(f"costs still fall after {rounds} rounds")
    every = spark.read.schema(deltas[0].schema).parquet(*sorted({f.rpartition("/")[0] for d in deltas for f in d.inputFiles()}))
    return every.groupBy("query_id", "osmid").agg(F.min("reached").alias("reached"))


def path_hops(paths: DataFrame) -> DataFrame:
    """(query_id, seq of the hop's end, from_node, to_node) of each hop."""
    w = Window.partitionBy("query_id").orderBy("seq")
    hops = paths.select("query_id", "seq", F.lag("osmid").over(w).alias("from_node"), F.col("osmid").alias("to_node"))
    return hops.where("from_node is not null")


def hop_edges(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """The cheapest edge of each pair of nodes that hops go between: from_node, to_node, edge columns and cost.

    Many trips take the same edges: what is known of an edge is found once, not once a hop.
    """
    rest = [c for c in edges.columns if c not in ("from_node", "to_node")]
    best = F.min_by(F.struct(*rest), F.struct("cost", "key"))
    asked = hops.select("from_node", "to_node").distinct()
    # node ids pack so well that their bytes look broadcastable: they are not
    met = edges.join(asked.hint("merge"), ["from_node", "to_node"], "left_semi")
    return met.groupBy("from_node", "to_node").agg(best.alias("_e")).select("from_node", "to_node", "_e.*")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The cheapest edge of each hop: query_id, seq (of the hop's end), edge columns and cost.

    ``edges`` has a cost of the same preferences as the search's.
    """
    hops = path_hops(paths)
    found = hops.join(hop_edges(hops, edges), ["from_node", "to_node"])
    return found.select("query_id", "seq", "from_node", "to_node", *[c for c in edges.columns if c not in ("from_node", "to_node")])


# --- components ---


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(osmid, component): the smallest node id of the weakly connected component of each node that has an edge.

    Labels are hooked to the smallest neighbouring label and then shortened by
    pointer jumping, so the number of rounds grows with the logarithm of a
    component's diameter, not with the diameter.
    """
    both = edges.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "pairs")
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    for _ in range(rounds):
        # smallest label among a node's neighbours
        near = (
            both.join(label.select(F.col("u").alias("v"), F.col("l").alias("nl")).hint("merge"), "v")
            .groupBy("u")
            .agg(F.min("nl").alias("nl"))
        )
        hooked = label.join(near.hint("merge"), "u").select("u", "l", F.least("l", "nl").alias("m"))
        # every node of a label learns the smallest label that any of them saw
        root = hooked.groupBy(F.col("l").alias("r")).agg(F.min("m").alias("rm"))
        joined = hooked.join(root.hint("merge"), hooked["l"] == root["r"]).select("u", F.col("l").alias("old"), F.col("rm").alias("l"))
        jump = joined.select(F.col("u").alias("j"), F.col("l").alias("jl"))
        stepped = joined.join(jump.hint("merge"), joined["l"] == jump["j"], "left").select(
            "u", "old", F.least(F.col("l"), F.coalesce("jl", "l")).alias("l")
        )
        stepped = written(stepped, "labels")
        forget(label)
        label = stepped.select("u", "l")
        if stepped.where("old <> l").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return label.select(F.col("u").alias("osmid"), F.col("l").alias("component"))


def component_sizes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, nodes, length_m): length over undirected pairs, of each pair the longest (from, to, key)'s length."""
    pair = [F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")]
    one = edges.groupBy(*pair).agg(F.max_by("length_m", F.struct("from_node", "to_node", "key")).alias("length_m"))
    lengths = (
        one.join(labels.hint("merge"), one["a"] == labels["osmid"])
        .groupBy("component")
        .agg(F.round(F.sum(F.col("length_m").cast("decimal(20,4)")).cast("double"), 4).alias("length_m"))
    )
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).join(lengths.hint("merge"), "component")


def prune(nodes: DataFrame, edges: DataFrame, min_bike_m: float = K.MIN_BIKE_COMPONENT_M) -> tuple[DataFrame, DataFrame]:
    """Rail: the component of most nodes (ties: smallest id). Bike: components of at least ``min_bike_m``.

    Edges survive if both ends do.
    """
    keep = []
    for mode in ("bike", "rail"):
        own = edges.where(F.col("mode") == mode)
        labels = components(own)
        sizes = component_sizes(own, labels)
        if mode == "bike":
            good = sizes.where(F.col("length_m") >= min_bike_m)
        else:
            good = sizes.orderBy(F.desc("nodes"), "component").limit(1)
        keep.append(labels.join(good.select("component").hint("merge"), "component", "left_semi").select("osmid"))
    kept = written(keep[0].unionByName(keep[1]).distinct(), "kept")
    # node ids pack so well that their bytes look broadcastable: they are not
    kept = kept.hint("merge")
    inner = edges.join(kept.withColumnRenamed("osmid", "from_node").hint("merge"), "from_node", "left_semi").join(
        kept.withColumnRenamed("osmid", "to_node").hint("merge"), "to_node", "left_semi"
    )
    return nodes.join(kept, "osmid", "left_semi"), inner.select(*edges.columns)
