"""Graph preparation: deduplication, re-numbering, elevation, geometry, station wiring, consolidation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K
from railspoke.operators.graph import components, nearest
from railspoke.operators.lineage import written
from railspoke.operators.spatial import box_join, points_within

# --- filters ---


def allowed_edges(edges: DataFrame) -> DataFrame:
    """Edges whose tags are missing or known (both surface and road class); rail and station edges have none."""
    return edges.where(
        C.allowed(C.tag_list(F.col("surface")), K.SURFACE_WEIGHT) & C.allowed(C.tag_list(F.col("highway")), K.ROAD_WEIGHT)
    )


def used_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    ends = edges.select(F.col("from_node").alias("osmid")).unionByName(edges.select(F.col("to_node").alias("osmid")))
    return nodes.join(ends, "osmid", "left_semi")


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("not (mode = 'bike' and from_node = to_node)")


# --- identity ---


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(osmid, new_id): rank of the ids from 0, by counts per range partition and not in one task."""
    ids = nodes.select("osmid").distinct()
    ranged = written(
        ids.repartitionByRange("osmid").withColumn("_part", F.spark_partition_id()), "ids"
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("osmid").alias("_first"))
    # one row per range partition
    begin = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"),
    )
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("osmid"))
    return ranged.withColumn("_rank", rank).join(F.broadcast(begin), "_part").select(
        "osmid", (F.col("_begin") + F.col("_rank") - 1).cast("long").alias("new_id")
    )


def renumbered(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    new = nodes.join(ids, "osmid").withColumn("osmid", F.col("new_id")).drop("new_id")
    out = edges
    for side in ("from_node", "to_node"):
        out = out.join(ids.withColumnRenamed("osmid", side), side).withColumn(side, F.col("new_id")).drop("new_id")
    return new.select(*nodes.columns), out.select(*edges.columns)


def region_offsets(nodes: DataFrame, region: str = "region_key") -> DataFrame:
    """(region, nodes, first_id): where each region's ids begin in the union of all regions, regions in name order."""
    sizes = nodes.groupBy(region).agg(F.countDistinct("osmid").alias("nodes"))
    # one row per region
    before = F.sum("nodes").over(Window.orderBy(region).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(region, "nodes", F.coalesce(before, F.lit(0)).alias("first_id"))


def merged_places(nodes: DataFrame, digits: int = K.COORD_DIGITS) -> DataFrame:
    """(osmid, kept): nodes of one kind at one rounded place become the first of them by (lat, lon, osmid)."""
    place = [F.round("lat", digits).alias("_lat"), F.round("lon", digits).alias("_lon"), "node_type"]
    first = nodes.groupBy(*place).agg(F.min(F.struct("lat", "lon", "osmid")).alias("_f"))
    at = nodes.select("osmid", *place)
    same = ["_lat", "_lon", "node_type"]
    return at.join(first, same).select("osmid", F.col("_f.osmid").alias("kept"))


def repointed(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges between the kept nodes; equal edges (ends, mode, geometry) once, keys numbered anew per pair."""
    out = edges
    for side in ("from_node", "to_node"):
        out = out.join(merged.withColumnRenamed("osmid", side), side).withColumn(side, F.col("kept")).drop("kept")
    out = without_loops(out.select(*edges.columns))
    rest = [c for c in edges.columns if c not in ("from_node", "to_node", "mode", "key", "length_m")]
    wkt = F.coalesce("geometry_wkt", F.lit("")).alias("_wkt")
    one = out.groupBy("from_node", "to_node", "mode", wkt).agg(
        F.min(F.struct("key", "length_m", *rest)).alias("_e")
    )
    number = F.row_number().over(Window.partitionBy("from_node", "to_node").orderBy("mode", "_e.key", "_wkt"))
    return one.select(
        "from_node", "to_node", "mode", (number - 1).cast("long").alias("key"), *[F.col(f"_e.{c}").alias(c) for c in ("length_m", *rest)]
    ).select(*edges.columns)


# --- elevation ---


def sampled(points: DataFrame, raster: DataFrame, per_degree: float, west: float, north: float, nodata: float) -> DataFrame:
    """Points with ``elevation_m`` of the raster cell they lie in (no interpolation); null off the raster or at nodata."""
    row = F.floor((F.lit(north) - F.col("lat")) * per_degree).cast("int")
    col = F.floor((F.col("lon") - F.lit(west)) * per_degree).cast("int")
    cells = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.nullif("elev", F.lit(nodata)).alias("_z"))
    z = F.when(~F.isnan("_z"), F.col("_z"))
    at = points.withColumn("_row", row).withColumn("_col", col)
    return at.join(cells, ["_row", "_col"], "left").withColumn("elevation_m", z).drop("_row", "_col", "_z")


def mean_filled(rows: DataFrame, column: str) -> DataFrame:
    """Null and NaN become the mean of the finite values, 0 where there is none."""
    x = F.col(column)
    finite = F.when(x.isNotNull() & ~F.isnan(x), x)
    mean = rows.agg(F.avg(finite).alias("_mean"))
    # one row
    return rows.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(finite, "_mean", F.lit(0.0))).drop("_mean")


# --- geometry ---


def vertices(edges: DataFrame, *keep: str) -> DataFrame:
    """(keep, v, lon, lat, z) of every stored vertex, numbered from 0."""
    return edges.select(*keep, F.posexplode(C.parsed_wkt(F.col("geometry_wkt"))).alias("v", "_v")).select(
        *keep, "v", "_v.lon", "_v.lat", "_v.z"
    )


def densified_lines(edges: DataFrame, most_m: float = K.MAX_VERTEX_GAP_M) -> DataFrame:
    """Edges with ``line``: vertices with linear inserts so that no gap exceeds 0.9 of ``most_m`` by much.

    A gap of g metres is cut into floor(g / (0.9 most_m)) + 1 equal steps.
    """
    line = C.parsed_wkt(F.col("geometry_wkt"))
    rows = edges.withColumn("_l", line).where("_l is not null and size(_l) >= 2")
    gap = lambda k: C.haversine_m(
        F.get("_l", k)["lat"], F.get("_l", k)["lon"], F.get("_l", k + 1)["lat"], F.get("_l", k + 1)["lon"]
    )
    steps = lambda k: (F.floor(gap(k) / (0.9 * most_m)) + 1).cast("int")
    between = lambda k, i, n, c: F.get("_l", k)[c] + (F.get("_l", k + 1)[c] - F.get("_l", k)[c]) * i / n
    parts = F.transform(
        F.sequence(F.lit(0), F.size("_l") - 2),
        lambda k: F.transform(
            F.sequence(F.lit(0), steps(k) - 1),
            lambda i: F.struct(*[between(k, i, steps(k), c).alias(c) for c in ("lon", "lat", "z")]),
        ),
    )
    end = F.array(F.element_at("_l", -1))
    return rows.withColumn("line", F.concat(F.flatten(parts), end)).drop("_l")


def wkt_text(line: Column) -> Column:
    """LINESTRING Z with 6 digits for degrees and 1 for heights."""
    text = F.transform(line, lambda v: F.format_string("%.6f %.6f %.1f", v["lon"], v["lat"], v["z"]))
    return F.concat(F.lit("LINESTRING Z ("), F.array_join(text, ", "), F.lit(")"))


def _cuts(z: list[float], band: float) -> list[int]:
    """Interior vertices at which a line is cut until each part stays within ``band`` of its ends' heights."""
    cuts, stack = [], [(0, len(z) - 1)]
    while stack:
        a, b = stack.pop()
        low, high = min(z[a], z[b]), max(z[a], z[b])
        worst, at = band, -1
        for k in range(a + 1, b):
            out = max(low - z[k], z[k] - high)
            if out > worst:
                worst, at = out, k
        if at >= 0:
            cuts.append(at)
            stack += [(a, at), (at, b)]
    return sorted(cuts)


def split_at_extrema(edges: DataFrame, *keys: str, band_m: float = K.Z_BAND_M) -> DataFrame:
    """(keys, part, line, length_m) of bike edges cut at vertices more than ``band_m`` outside their ends' heights.

    Lengths are great-circle metres along the part. Edges without stored
    heights stay whole.
    """
    kinds = dict(edges.dtypes)
    own = edges.where("mode = 'bike'").select(*keys, C.parsed_wkt(F.col("geometry_wkt")).alias("line"))
    own = own.where("line is not null and size(line) >= 2")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cuts"] = [
                [] if any(h is None or np.isnan(h) for h in zs) else _cuts(list(zs), band_m) for zs in pdf.pop("zs")
            ]
            yield pdf

    zs = F.transform("line", lambda v: v["z"]).alias("zs")
    cut = own.select(*keys, "line", zs).mapInPandas(
        run, f"{schema}, line array<struct<lon:double,lat:double,z:double>>, cuts array<int>"
    )
    ends = F.concat(F.array(F.lit(0)), "cuts", F.array(F.size("line") - 1))
    parts = cut.withColumn("_ends", ends).select(
        *keys,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("_ends") - 1),
                lambda k: F.slice("line", F.get("_ends", k - 1) + 1, F.get("_ends", k) - F.get("_ends", k - 1) + 1),
            )
        ).alias("part", "line"),
    )
    length = F.aggregate(
        F.sequence(F.lit(1), F.size("line") - 1),
        F.lit(0.0),
        lambda acc, k: acc
        + C.haversine_m(
            F.get("line", k - 1)["lat"], F.get("line", k - 1)["lon"], F.get("line", k)["lat"], F.get("line", k)["lon"]
        ),
    )
    return parts.withColumn("length_m", length)


# --- stations ---


def entrances(stations: DataFrame, bike_nodes: DataFrame, radius_m: float = K.STATION_RADIUS_M, most: int = K.STATION_ENTRANCES) -> DataFrame:
    """(station, osmid, distance_m, rank): up to ``most`` bike nodes within the radius of each station."""
    named = stations.withColumnRenamed("osmid", "station")
    return nearest(named, bike_nodes, "station", most, (radius_m,), beyond=False)


def nearest_track(stations: DataFrame, rail_edges: DataFrame, radius_m: float = K.STATION_RADIUS_M) -> DataFrame:
    """(station, from_node, to_node, distance_m, node) of the nearest straight rail edge within the radius and its nearer end.

    ``stations``: osmid, lat, lon; ``rail_edges``: from_node, to_node and both ends' places (as ``with_ends``).
    Each undirected edge counts once; ties by (from_node, to_node).
    """
    grow = radius_m / K.METRES_PER_DEGREE * 1.01
    lines = rail_edges.select("from_node", "to_node", "from_lat", "from_lon", "to_lat", "to_lon").distinct()
    name = F.concat_ws("/", "from_node", "to_node")
    lines = lines.withColumn("line_id", name)
    wide = F.lit(grow) / F.cos(F.radians("lat"))
    a = stations.select(
        F.lit(0).alias("side"), F.col("osmid").cast("string").alias("id"),
        (F.col("lon") - wide).alias("x0"), (F.col("lon") + wide).alias("x1"),
        (F.col("lat") - grow).alias("y0"), (F.col("lat") + grow).alias("y1"),
        F.col("lon").alias("x"), F.col("lat").alias("y"),
    )
    b = lines.select(
        F.lit(1).alias("side"), F.col("line_id").alias("id"),
        F.least("from_lon", "to_lon").alias("x0"), F.greatest("from_lon", "to_lon").alias("x1"),
        F.least("from_lat", "to_lat").alias("y0"), F.greatest("from_lat", "to_lat").alias("y1"),
        F.col("from_lon").alias("x"), F.col("from_lat").alias("y"),
    )
    pairs = box_join(a.unionByName(b))
    at = stations.select(F.col("osmid").cast("string").alias("left_id"), F.col("osmid").alias("station"), "lat", "lon")
    rows = pairs.join(at, "left_id").join(lines, F.col("right_id") == F.col("line_id"))
    scale = F.cos(F.radians("lat"))
    metres = F.lit(K.METRES_PER_DEGREE)
    ax, ay = (F.col("from_lon") - F.col("lon")) * scale * metres, (F.col("from_lat") - F.col("lat")) * metres
    bx, by = (F.col("to_lon") - F.col("lon")) * scale * metres, (F.col("to_lat") - F.col("lat")) * metres
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / long2))).otherwise(0.0)
    off = F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))
    node = F.when(ax * ax + ay * ay <= bx * bx + by * by, F.col("from_node")).otherwise(F.col("to_node"))
    rows = rows.withColumn("distance_m", off).withColumn("node", node).where(F.col("distance_m") <= radius_m)
    best = F.min_by(
        F.struct("from_node", "to_node", "distance_m", "node"), F.struct(F.round("distance_m", 6), "from_node", "to_node")
    )
    return rows.groupBy("station").agg(best.alias("_b")).select("station", "_b.*")


def wired(stations: DataFrame, bike_nodes: DataFrame, rail_edges: DataFrame | None = None) -> DataFrame:
    """Edges, both ways, of each station: from_node, to_node, key, length_m, mode.

    Station edges lead to its entrances. With ``rail_edges`` (as in
    ``nearest_track``) rail edges lead to the nearer end of its nearest track,
    and stations more than the radius off every track are dropped; one that is
    that end itself needs no rail edge. Without any track no station is dropped.
    """
    links = None
    if rail_edges is not None and not rail_edges.isEmpty():
        near = written(nearest_track(stations, rail_edges).select("station", "node"), "tracks")
        stations = stations.join(near.select(F.col("station").alias("osmid")), "osmid", "left_semi")
        ends = [rail_edges.select(F.col(f"{e}_node").alias("node"), F.col(f"{e}_lat").alias("_lat"), F.col(f"{e}_lon").alias("_lon")) for e in ("from", "to")]
        length = C.haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
        links = (
            near.where("station <> node")
            .join(stations.select(F.col("osmid").alias("station"), "lat", "lon"), "station")
            .join(ends[0].unionByName(ends[1]).dropDuplicates(["node"]), "node")
            .select("station", F.col("node").alias("osmid"), length.alias("distance_m"), F.lit("rail").alias("mode"))
        )
    ways = entrances(stations, bike_nodes).select("station", "osmid", "distance_m", F.lit("station").alias("mode"))
    ways = ways if links is None else ways.unionByName(links)
    there = ways.select(F.col("station").alias("from_node"), F.col("osmid").alias("to_node"), "distance_m", "mode")
    back = ways.select(F.col("osmid").alias("from_node"), F.col("station").alias("to_node"), "distance_m", "mode")
    return there.unionByName(back).select(
        "from_node", "to_node", F.lit(0).cast("long").alias("key"), F.col("distance_m").alias("length_m"), "mode"
    )


def top_stations(nodes: DataFrame, radius_m: float = K.DOMINANCE_M, prominence_m: float = K.PROMINENCE_M) -> DataFrame:
    """Named rail nodes that no named rail node within the radius overtops, and that stand out by the prominence."""
    named = nodes.where("node_type = 'rail' and station_name is not null").select(
        "osmid", "lat", "lon", "elevation_m", "station_name"
    )
    pairs = points_within(named, named, radius_m)
    other = named.select(F.col("osmid").alias("right_id"), F.col("elevation_m").alias("_e"))
    around = pairs.join(other, "right_id").groupBy(F.col("left_id").alias("osmid")).agg(
        F.max("_e").alias("highest_m"), F.min("_e").alias("lowest_m")
    )
    e = F.col("elevation_m")
    return named.join(around, "osmid").where((e >= F.col("highest_m")) & (e - F.col("lowest_m") >= prominence_m))


# --- consolidation ---


def consolidated(nodes: DataFrame, tolerance_m: float = K.MERGE_TOLERANCE_M) -> DataFrame:
    """(osmid, cluster, lat, lon, members): bike nodes linked by steps of at most twice the tolerance, and the mean place.

    Nodes without a neighbour keep themselves.
    """
    bike = nodes.where("node_type = 'bike'").select("osmid", "lat", "lon")
    near = points_within(bike, bike, 2 * tolerance_m).where("left_id < right_id")
    links = near.select(F.col("left_id").alias("from_node"), F.col("right_id").alias("to_node"))
    labels = components(links)
    all_ = bike.join(labels, "osmid", "left").withColumn("cluster", F.coalesce("component", "osmid")).drop("component")
    mid = all_.groupBy("cluster").agg(
        F.avg(F.col("lat").cast("decimal(12,8)")).cast("double").alias("c_lat"),
        F.avg(F.col("lon").cast("decimal(12,8)")).cast("double").alias("c_lon"),
        F.count(F.lit(1)).alias("members"),
    )
    return all_.select("osmid", "cluster").join(mid, "cluster").select(
        "osmid", "cluster", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), "members"
    )


def contracted(edges: DataFrame, *, mode: str = "bike") -> DataFrame:
    """(osmid, chain): inner nodes of degree 2 (two neighbours, undirected) with the smallest node id of their chain."""
    own = edges.where(F.col("mode") == mode).where("from_node <> to_node")
    both = own.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    inner = both.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("u")
    links = (
        both.join(inner, "u", "left_semi")
        .join(inner.select(F.col("u").alias("v")), "v", "left_semi")
        .select(F.col("u").alias("from_node"), F.col("v").alias("to_node"))
    )
    labels = components(links)
    return inner.select(F.col("u").alias("osmid")).join(labels, "osmid", "left").select(
        "osmid", F.coalesce("component", "osmid").alias("chain")
    )
