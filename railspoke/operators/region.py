"""Building a region's graph: edges rebuilt after consolidation, contraction and splitting, baked heights, union of regions.

Every step takes and returns (nodes, edges) in the stored columns; ``row_id`` and
other extra columns of edges are carried where an edge survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K
from railspoke.operators import build as B
from railspoke.operators.lineage import forget, written

EDGE = ["from_node", "to_node", "key", "length_m", "height_diff_m", "surface", "highway", "mode", "geometry_wkt"]
NODE = ["osmid", "lat", "lon", "elevation_m", "node_type", "station_name"]


def line_length(line: str) -> Column:
    """Great-circle metres along an array of vertices."""
    step = lambda k: C.haversine_m(
        F.get(line, k - 1)["lat"], F.get(line, k - 1)["lon"], F.get(line, k)["lat"], F.get(line, k)["lon"]
    )
    return F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), F.lit(0.0), lambda acc, k: acc + step(k))


def numbered(edges: DataFrame, *order: str) -> DataFrame:
    """``key`` numbered anew from 0 for each directed pair of nodes."""
    w = Window.partitionBy("from_node", "to_node").orderBy("mode", "length_m", *order)
    return edges.withColumn("key", (F.row_number().over(w) - 1).cast("long"))


# --- consolidation ---


def consolidated_graph(nodes: DataFrame, edges: DataFrame, tolerance_m: float = K.MERGE_TOLERANCE_M) -> tuple[DataFrame, DataFrame]:
    """Bike nodes near each other become one at their mean place and height; edges are rebuilt between the new nodes.

    A bike edge runs from the new node over its inner vertices to the new node,
    with the length of that line; one whose ends became one node goes. Dead ends
    stay. Other edges keep their geometry and get the new ids.
    """
    at = written(B.consolidated(nodes, tolerance_m).select("osmid", "cluster", "lat", "lon"), "clusters")
    bike = nodes.where("node_type = 'bike'").select(*NODE)
    height = F.avg(F.col("elevation_m").cast("decimal(18,6)")).cast("double")
    merged = (
        bike.drop("lat", "lon")
        .join(at, "osmid")
        .groupBy(F.col("cluster").alias("osmid"))
        .agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), height.alias("elevation_m"), F.lit("bike").alias("node_type"), F.max("station_name").alias("station_name"))
    )
    out_nodes = nodes.where("node_type <> 'bike'").select(*NODE).unionByName(merged.select(*NODE))
    rest = [c for c in edges.columns if c not in EDGE]
    out = edges
    for side in ("from", "to"):
        new = at.select(F.col("osmid").alias(f"{side}_node"), F.col("cluster").alias(f"_{side}"), F.col("lat").alias(f"_{side}_lat"), F.col("lon").alias(f"_{side}_lon"))
        out = out.join(new, f"{side}_node", "left").withColumn(f"{side}_node", F.coalesce(f"_{side}", f"{side}_node"))
    out = B.without_loops(out)
    line = C.parsed_wkt(F.col("geometry_wkt"))
    end = lambda s, k: F.struct(F.col(f"_{s}_lon").alias("lon"), F.col(f"_{s}_lat").alias("lat"), F.element_at(line, k)["z"].alias("z"))
    moved = (F.col("mode") == "bike") & (F.size(line) >= 2) & F.col("_from_lat").isNotNull() & F.col("_to_lat").isNotNull()
    inner = F.slice(line, 2, F.greatest(F.size(line) - 2, F.lit(0)))
    out = out.withColumn("_line", F.when(moved, F.concat(F.array(end("from", 1)), inner, F.array(end("to", -1)))))
    out = out.withColumn("length_m", F.when(F.col("_line").isNotNull(), line_length("_line")).otherwise(F.col("length_m")))
    out = out.withColumn("geometry_wkt", F.when(F.col("_line").isNotNull(), B.wkt_text(F.col("_line"))).otherwise(F.col("geometry_wkt")))
    heights = out_nodes.select("osmid", "elevation_m")
    out = out.join(heights.toDF("from_node", "_a"), "from_node").join(heights.toDF("to_node", "_b"), "to_node")
    out = out.withColumn("height_diff_m", F.col("_b") - F.col("_a"))
    return out_nodes, numbered(out.select(*EDGE, *rest), *rest)


# --- contraction ---


def contracted_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bike edges through nodes of two neighbours joined to one edge per chain and direction, geometries in order.

    Each directed edge points at the one before it on its chain; pointers are
    doubled until all of them have reached the chain's first edge, so rounds grow
    with the logarithm of the longest chain. Rings without a junction stay as
    they are. Of parallel edges between neighbours the shortest takes part;
    the others, and other modes, stay. Tags are those of the chain's first edge.
    """
    bike = edges.where("mode = 'bike' and from_node <> to_node")
    both = bike.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    stations = edges.where("mode <> 'bike'").select(F.col("from_node").alias("u")).unionByName(edges.where("mode <> 'bike'").select(F.col("to_node").alias("u")))
    inner = written(both.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("u").join(stations, "u", "left_anti"), "inner")
    shortest = bike.groupBy("from_node", "to_node").agg(F.min_by("key", F.struct("length_m", "key")).alias("key"))
    hops = shortest.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), "key")
    # the hop before (u, v), if u is inner: the one that comes to u from its other neighbour
    before = hops.select(F.col("u").alias("pu"), F.col("v").alias("_at")).join(inner.select(F.col("u").alias("_at")), "_at", "left_semi")
    state = hops.join(before, (F.col("u") == F.col("_at")) & (F.col("v") != F.col("pu")), "left")
    state = state.select("u", "v", "key", F.col("pu"), F.when(F.col("pu").isNotNull(), F.col("u")).alias("pv"), F.when(F.col("pu").isNotNull(), 1).otherwise(0).cast("long").alias("rank"))
    state = written(state.withColumn("hu", F.coalesce("pu", "u")).withColumn("hv", F.coalesce("pv", "v")), "chain")
    n = state.count()
    for _ in range(max(1, n.bit_length() + 1)):
        if state.where("pu is not null").isEmpty():
            break
        up = state.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("_pu"), F.col("pv").alias("_pv"), F.col("rank").alias("_rank"), F.col("hu").alias("_hu"), F.col("hv").alias("_hv"))
        stepped = state.join(up, ["pu", "pv"], "left").select(
            "u", "v", "key", F.col("_pu").alias("pu"), F.col("_pv").alias("pv"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank"), F.coalesce("_hu", "hu").alias("hu"), F.coalesce("_hv", "hv").alias("hv"),
        )
        last, state = state, written(stepped, "chain")
        forget(last)
    # pointers that never end go round a ring
    chained = state.select(
        F.col("u").alias("from_node"), F.col("v").alias("to_node"), "key", F.when(F.col("pu").isNull(), F.col("hu")).otherwise(F.col("u")).alias("hu"),
        F.when(F.col("pu").isNull(), F.col("hv")).otherwise(F.col("v")).alias("hv"), F.when(F.col("pu").isNull(), F.col("rank")).otherwise(0).alias("rank"),
    )
    own = bike.join(chained, ["from_node", "to_node", "key"])
    rest = [c for c in edges.columns if c not in EDGE]
    first = lambda c: F.min_by(c, "rank").alias(c)
    verts = F.col("_v")
    joined = own.groupBy("hu", "hv").agg(
        first("from_node"),
        F.max_by("to_node", "rank").alias("to_node"),
        first("key"),
        F.round(F.sum(F.col("length_m").cast("decimal(20,4)")).cast("double"), 4).alias("length_m"),
        F.round(F.sum(F.col("height_diff_m").cast("decimal(20,6)")).cast("double"), 6).alias("height_diff_m"),
        *[first(c) for c in ("surface", "highway", "mode", *rest)],
        F.sort_array(F.collect_list(F.struct("rank", "from_node", C.parsed_wkt(F.col("geometry_wkt")).alias("line")))).alias("_parts"),
    )
    whole = F.forall("_parts", lambda p: p["line"].isNotNull())
    line = F.flatten(F.transform("_parts", lambda p, k: F.when(k == 0, p["line"]).otherwise(F.slice(p["line"], 2, F.greatest(F.size(p["line"]) - 1, F.lit(0))))))
    joined = joined.withColumn("_v", line).withColumn("geometry_wkt", F.when(whole, B.wkt_text(verts)))
    parallel = edges.join(chained.select("from_node", "to_node", "key"), ["from_node", "to_node", "key"], "left_anti")
    out = numbered(parallel.select(*EDGE, *rest).unionByName(joined.select(*EDGE, *rest)), *rest)
    return B.used_nodes(nodes, out), out


# --- splitting ---


def split_graph(nodes: DataFrame, edges: DataFrame, band_m: float = K.Z_BAND_M, id_key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Bike edges cut at their extrema, with a new bike node at each cut; cuts at one place (6 digits) share it.

    New ids follow the largest present, in the order of (lat, lon).
    """
    cut = written(B.split_at_extrema(edges, id_key, band_m=band_m), "parts")
    place = lambda k: [F.round(F.element_at("line", k)[c], K.COORD_DIGITS).alias(c) for c in ("lat", "lon")]
    spots = cut.where("part > 0").select(*place(1), F.element_at("line", 1)["z"].alias("z")).groupBy("lat", "lon").agg(F.max("z").alias("elevation_m"))
    most = nodes.agg(F.max("osmid").alias("_most"))
    # ranked by ranges, not in one task; one row of the largest id
    ranked = B.dense_ids(spots.select(F.struct("lat", "lon").alias("osmid")))
    new = ranked.crossJoin(F.broadcast(most)).select("osmid.lat", "osmid.lon", (F.col("new_id") + 1 + F.coalesce("_most", F.lit(-1))).alias("osmid"))
    new = written(new.join(spots, ["lat", "lon"]), "spots")
    made = new.select("osmid", "lat", "lon", "elevation_m", F.lit("bike").alias("node_type"), F.lit(None).cast("string").alias("station_name"))
    last = F.max("part").over(Window.partitionBy(id_key))
    parts = cut.withColumn("_last", last)
    for side, k, inner in (("a", 1, F.col("part") > 0), ("b", -1, F.col("part") < F.col("_last"))):
        lat, lon = place(k)
        ids = new.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("osmid").alias(f"_{side}"))
        parts = parts.withColumn("_lat", F.when(inner, lat)).withColumn("_lon", F.when(inner, lon)).join(ids, ["_lat", "_lon"], "left").drop("_lat", "_lon")
    rest = [c for c in edges.columns if c not in EDGE]
    bike = edges.join(cut.select(id_key).distinct(), id_key, "left_semi").drop("length_m", "geometry_wkt", "height_diff_m")
    z = lambda k: F.element_at("line", k)["z"]
    whole = F.col("_last") == 0
    old = edges.select(id_key, F.col("length_m").alias("_old"), F.col("height_diff_m").alias("_oldh"), F.col("geometry_wkt").alias("_oldw"))
    out = parts.join(bike, id_key).join(old, id_key).select(
        F.coalesce("_a", "from_node").alias("from_node"), F.coalesce("_b", "to_node").alias("to_node"), "key",
        F.when(whole, F.col("_old")).otherwise(F.col("length_m")).alias("length_m"),
        F.when(whole, F.col("_oldh")).otherwise(z(-1) - z(1)).alias("height_diff_m"),
        "surface", "highway", "mode", F.when(whole, F.col("_oldw")).otherwise(B.wkt_text(F.col("line"))).alias("geometry_wkt"), *rest,
    )
    others = edges.join(cut.select(id_key).distinct(), id_key, "left_anti")
    return nodes.select(*NODE).unionByName(made), numbered(out.unionByName(others.select(*EDGE, *rest)), *rest)


# --- heights ---


def baked(nodes: DataFrame, edges: DataFrame, raster: DataFrame, key: str, *frame: float) -> tuple[DataFrame, DataFrame]:
    """Heights of all nodes and of every stored vertex from the raster, gaps filled with the mean of each kind.

    ``frame``: cells per degree, west, north and the nodata value, as in ``sampled``.
    """
    z_nodes = B.mean_filled(B.sampled(nodes.drop("elevation_m"), raster, *frame), "elevation_m")
    verts = B.vertices(edges, key).drop("z")
    z = B.mean_filled(B.sampled(verts, raster, *frame), "elevation_m")
    lines = z.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("v", "lon", "lat", F.col("elevation_m").alias("z")))).alias("_l"))
    out = edges.join(lines, key, "left").withColumn("geometry_wkt", F.when(F.col("_l").isNotNull(), B.wkt_text(F.col("_l"))))
    heights = z_nodes.select("osmid", F.col("elevation_m").alias("_z"))
    out = out.drop("_l").join(heights.toDF("from_node", "_a"), "from_node").join(heights.toDF("to_node", "_b"), "to_node")
    return z_nodes.select(*nodes.columns), out.withColumn("height_diff_m", F.col("_b") - F.col("_a")).select(*edges.columns)


# --- several graphs ---


def regions_united(nodes: DataFrame, edges: DataFrame, region: str = "region_key") -> tuple[DataFrame, DataFrame]:
    """Ids shifted so that those of each region follow those of the regions before it, in name order, densely from 0."""
    ids = written(B.dense_ids(nodes.select(F.struct(region, "osmid").alias("osmid"))).select("osmid.osmid", "new_id"), "united")
    return B.renumbered(nodes, edges, ids)


def composed(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both graphs as one; ids of the second follow the largest of the first, so nothing is shared."""
    most = a[0].agg((F.coalesce(F.max("osmid"), F.lit(-1)) + 1).alias("_most"))
    low = b[0].agg(F.coalesce(F.min("osmid"), F.lit(0)).alias("_low"))
    # one row each
    shift = most.crossJoin(F.broadcast(low)).select((F.col("_most") - F.col("_low")).alias("_by"))
    moved = [rows.crossJoin(F.broadcast(shift)).withColumns({c: F.col(c) + F.col("_by") for c in ids}).select(*rows.columns) for rows, ids in zip(b, (["osmid"], ["from_node", "to_node"]), strict=True)]
    return a[0].unionByName(moved[0]), a[1].unionByName(moved[1])


def clipped(nodes: DataFrame, edges: DataFrame, west: float, south: float, east: float, north: float, way: str = "way_id") -> tuple[DataFrame, DataFrame]:
    """The ways with a node in the box, whole; edges without a way if one of their ends is in it."""
    inside = nodes.where(F.col("lon").between(west, east) & F.col("lat").between(south, north)).select("osmid")
    touch = edges.join(inside.withColumnRenamed("osmid", "from_node"), "from_node", "left_semi").unionByName(
        edges.join(inside.withColumnRenamed("osmid", "to_node"), "to_node", "left_semi")
    )
    ways = touch.where(F.col(way).isNotNull()).select(way).distinct()
    loose = touch.where(F.col(way).isNull()).dropDuplicates(["from_node", "to_node", "key", "mode"])
    kept = edges.join(ways, way, "left_semi").select(*edges.columns).unionByName(loose.select(*edges.columns))
    return B.used_nodes(nodes, kept), kept


def covered(nodes: DataFrame, edges: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes within the box of all regions, and the edges between them: places off the map (swapped coordinates) go."""
    box = regions.agg(*[f(c).alias(f"_{c}") for c, f in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max))])
    # one row
    inside = nodes.crossJoin(F.broadcast(box)).where("lon between _west and _east and lat between _south and _north").select(*nodes.columns)
    ids = inside.select("osmid")
    kept = edges.join(ids.withColumnRenamed("osmid", "from_node"), "from_node", "left_semi").join(ids.withColumnRenamed("osmid", "to_node"), "to_node", "left_semi")
    return inside, kept.select(*edges.columns)


def station_points(features: DataFrame) -> DataFrame:
    """(osmid, lat, lon, station_name) of features whose ``railway`` is station or halt; nameless ones are called "station"."""
    return features.where(F.lower("railway").isin("station", "halt") & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "osmid", "lat", "lon", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("station")).alias("station_name")
    )


def raster_bounds(raster: DataFrame, per_degree: float, west: float, north: float) -> DataFrame:
    """(west, south, east, north) of the raster's cells, in degrees."""
    return raster.agg(
        (F.lit(west) + F.min("col") / per_degree).alias("west"), (F.lit(north) - (F.max("row") + 1) / per_degree).alias("south"),
        (F.lit(west) + (F.max("col") + 1) / per_degree).alias("east"), (F.lit(north) - F.min("row") / per_degree).alias("north"),
    )


def raster_crop(raster: DataFrame, per_degree: float, west: float, north: float, box: tuple[float, float, float, float], margin: float = 0.4) -> DataFrame:
    """Cells that the box (west, south, east, north), grown by the margin, touches; row and column keep their numbers."""
    w, s, e, n = box
    rows = F.col("row").between(int((north - n - margin) * per_degree // 1), int((north - s + margin) * per_degree // 1))
    return raster.where(rows & F.col("col").between(int((w - margin - west) * per_degree // 1), int((e + margin - west) * per_degree // 1)))


def region_build(
    nodes: DataFrame, edges: DataFrame, raster: DataFrame, frame: tuple[float, float, float, float], band_m: float = K.Z_BAND_M
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one region as they are stored, from its raw ones.

    Bike layer: edges with unknown tags go, nodes near each other become one, lines
    get vertices at most a step apart. Rail layer: as it is. Then heights for all
    vertices, loops out, edges cut at their extrema, stations wired to track and
    entrances; ``edges`` has a unique ``row_id``.
    """
    bike = B.allowed_edges(edges.where("mode = 'bike'"))
    bike_nodes, bike = consolidated_graph(B.used_nodes(nodes.where("node_type = 'bike'"), bike), bike)
    bike_nodes, bike = written(bike_nodes, "nodes"), written(bike, "bike")
    dense = B.densified_lines(bike).withColumn("geometry_wkt", B.wkt_text(F.col("line"))).drop("line")
    bike = written(dense.select(*bike.columns).unionByName(bike.join(dense.select("row_id"), "row_id", "left_anti").select(*bike.columns)), "bike")
    rail_nodes = nodes.where("node_type = 'rail'").select(*NODE)
    both = written(bike_nodes.unionByName(rail_nodes), "nodes")
    rows = bike.unionByName(edges.where("mode = 'rail'").select(*bike.columns))
    high_nodes, high = baked(both, rows, raster, "row_id", *frame)
    high_nodes = written(high_nodes, "nodes")
    out_nodes, out = split_graph(high_nodes, B.without_loops(written(high, "edges")), band_m)
    out_nodes = written(out_nodes, "nodes")
    stations = out_nodes.where("node_type = 'rail' and station_name is not null")
    from railspoke.operators.graph import with_ends

    out = written(out, "edges")
    wires = B.wired(stations, out_nodes.where("node_type = 'bike'"), with_ends(out.where("mode = 'rail'"), out_nodes))
    heights = out_nodes.select("osmid", "elevation_m")
    wires = wires.join(heights.toDF("from_node", "_a"), "from_node").join(heights.toDF("to_node", "_b"), "to_node")
    empty = {c: F.lit(None).cast(dict(out.dtypes)[c]) for c in out.columns if c not in wires.columns and c != "height_diff_m"}
    wires = wires.withColumn("height_diff_m", F.col("_b") - F.col("_a")).withColumns(empty).select(*out.columns)
    return out_nodes, numbered(out.unionByName(wires), "row_id")
