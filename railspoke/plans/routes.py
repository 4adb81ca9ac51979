"""Queries of the route operators over the stored graph (tables nodes, edges, gazetteer, build_regions)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K
from railspoke.operators import build as B
from railspoke.operators import geocode as N
from railspoke.operators import graph as G
from railspoke.operators import region as R
from railspoke.operators import report as P
from railspoke.operators import simplify as S
from railspoke.operators import track as T
from railspoke.operators import validate as V
from railspoke.operators.lineage import application_folder, exists, forget, written
from railspoke.sources import tiles
from railspoke.sources.tables import table

#: Corridors, half width and extension in km, bike and rail.
BIKE_TUBE, RAIL_TUBE = (K.BIKE_HALF_WIDTH_KM, K.BIKE_EXTEND_KM), (K.RAIL_HALF_WIDTH_KM, K.RAIL_EXTEND_KM)
#: The shortest trip of the registered route queries. The stored graph is 24 towns some 3 to 7 km wide, without a way
#: between them, so that with the specified 5 km nearly no trip would have a route; ``route_verdicts`` has both.
SHORTEST_KM = 1.0
#: Preferences of the registered route queries: a rider who likes trains, so that rides occur on short trips.
ROUTE_PREFS = {"uphill": 12.0, "unpaved": 3.0, "main": 1.0, "rail": 0.0, "boarding": 0.5}
#: Five sets of preferences for the what-if query.
SWEEP = [
    ("default", 12.0, 3.0, 1.0, 1.0, 20.0),
    ("zero", 0.0, 0.0, 0.0, 0.0, 0.0),
    ("flat", 40.0, 0.0, 0.0, 0.0, 0.0),
    ("paved", 0.0, 10.0, 0.0, 1.0, 20.0),
    ("quiet", 5.0, 1.0, 8.0, 2.0, 5.0),
]


#: Tiled stores that this session has built: by application, folder and what lay in it.
_STORES: dict[tuple, str] = {}


def _contents(s: SparkSession, files: list[str]) -> tuple:
    """Names, sizes and times of the files of a table."""
    conf = s._jsparkSession.sessionState().newHadoopConf()
    out = []
    for f in sorted(files):
        path = s._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


class Graph:
    def __init__(self, s: SparkSession, d: str) -> None:
        self.s, self.d = s, d
        self.nodes = G.clean_nodes(table(s, d, "nodes"))
        self.edges = G.clean_edges(table(s, d, "edges"), self.nodes)
        self.places = table(s, d, "gazetteer")
        self.regions = table(s, d, "build_regions")

    def saved(self) -> Graph:
        """Over the tiled store of the clean graph, which a session builds once for the same files."""
        raw = [table(self.s, self.d, name) for name in ("nodes", "edges")]
        key = (self.s.sparkContext.applicationId, self.d, *(_contents(self.s, r.inputFiles()) for r in raw))
        if key not in _STORES or not exists(self.s, _STORES[key]):
            path = f"{application_folder(self.s)}/store-{uuid.uuid4().hex}"
            nodes = written(G.clean_nodes(raw[0]), "nodes")
            edges = written(G.clean_edges(raw[1], nodes, *tiles.from_tile()), "edges")
            tiles.write_store(nodes, edges, path, extra=(["place_key", "region_key"], ["row_id", "way_id"]))
            forget(nodes)
            forget(edges)
            _STORES[key] = path
        self.path = _STORES[key]
        self.nodes, self.edges = (tiles.read_store(self.s, self.path, name).drop("tile_row", "tile_col") for name in ("nodes", "edges"))
        return self

    def pruned(self) -> Graph:
        """Over the tiles of the store that the searched trips' corridors touch."""
        asked = self.queries()
        cells = None
        for tube in (BIKE_TUBE, RAIL_TUBE):
            one = G.corridor_cells(asked, *tube, K.TILE_DEG).select("row", "col")
            cells = one if cells is None else cells.unionByName(one)
        # at most as many as the globe has tiles
        touched = [(int(r["row"]), int(r["col"])) for r in cells.distinct().collect()]
        out = Graph(self.s, self.d)
        out.path, out.asked = self.path, asked
        out.nodes, out.edges = (tiles.read_store(self.s, self.path, name, touched).drop("tile_row", "tile_col") for name in ("nodes", "edges"))
        return out

    asked: DataFrame | None = None

    def trips(self) -> DataFrame:
        """Trips of any length: from each place's westernmost bike node to the easternmost of the next place of its region
        (a region of one place: of itself); from each region to the next one; and from each region to a place south of all.
        """
        bike = self.nodes.where("node_type = 'bike' and place_key is not null")
        end = lambda f: f(F.struct("lon", "osmid", "lat"))
        places = bike.groupBy("region_key", "place_key").agg(end(F.min).alias("a"), end(F.max).alias("b"))
        # one row per place
        ring = Window.partitionBy("region_key").orderBy("place_key")
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        near = places.select(
            F.concat("region_key", F.lit("/"), "place_key").alias("query_id"), "a", F.coalesce(F.lead("b").over(ring), F.first("b").over(whole)).alias("b")
        )
        # one row per region
        first = places.groupBy("region_key").agg(F.min_by("a", "place_key").alias("a"))
        far = first.select(F.concat("region_key", F.lit("/next")).alias("query_id"), "a", F.lead("a").over(Window.orderBy("region_key")).alias("b"))
        south = self.regions.agg((F.min("south") - 0.5).alias("_s"))
        off = F.struct(F.col("a.lon").alias("lon"), F.lit(0).cast("long").alias("osmid"), F.col("_s").alias("lat"))
        out = first.crossJoin(F.broadcast(south)).select(F.concat("region_key", F.lit("/south")).alias("query_id"), "a", off.alias("b"))
        every = near.unionByName(far.where("b is not null")).unionByName(out)
        return every.where("a.osmid <> b.osmid").select(
            "query_id",
            F.col("a.osmid").alias("source"),
            F.col("b.osmid").alias("target"),
            F.col("a.lat").alias("lat_a"),
            F.col("a.lon").alias("lon_a"),
            F.col("b.lat").alias("lat_b"),
            F.col("b.lon").alias("lon_b"),
        )

    def guarded(self, min_km: float = SHORTEST_KM) -> DataFrame:
        """Every trip with its length and the verdict of the guards; covered is the box of the build regions."""
        box = self.regions.agg(*[f(c).alias(c) for c, f in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max))])
        # one row
        trips = self.trips().crossJoin(F.broadcast(box))
        return G.trip_guard(trips, *map(F.col, ("west", "south", "east", "north")), min_km).drop("west", "south", "east", "north")

    def queries(self) -> DataFrame:
        """The trips that pass the guards."""
        if self.asked is None:
            self.asked = written(self.guarded().where("verdict is null").drop("verdict", "trip_km"), "queries")
        return self.asked

    def paths(self) -> DataFrame:
        return G.routes(self.queries(), self.nodes, G.costed(self.edges, route_prefs()))

    def hops(self, geometry: bool = False) -> DataFrame:
        """Geometries are moved only where they are asked for; ends and speeds are found once an edge, not once a hop."""
        paths = self.paths()
        walked = written(G.path_hops(paths), "walked")
        forget(paths)
        kept = ["from_node", "to_node", "key", "length_m", "surface", "highway", "mode", *["geometry_wkt"] * geometry]
        edges = G.costed(self.edges, route_prefs()).select(*kept, "cost")
        best = written(T.hops(G.hop_edges(walked, edges), self.nodes), "best")
        out = written(walked.join(best.hint("merge"), ["from_node", "to_node"]), "hops")
        forget(walked)
        forget(best)
        return out


def route_prefs() -> dict:
    return {k: F.lit(v) for k, v in ROUTE_PREFS.items()}


def _r(rows: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Doubles rounded at the query's boundary, negative zero made zero."""
    return rows.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in rows.select(*(columns or rows.columns)).dtypes
        ]
    )


def _g(f: Callable[[Graph], DataFrame], saved: bool = False, pruned: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """``saved``: over the tiled store; ``pruned``: over its tiles that the trips' corridors touch."""

    def run(s: SparkSession, d: str) -> DataFrame:
        g = Graph(s, d)
        if saved or pruned:
            g = g.saved()
        return f(g.pruned() if pruned else g)

    return run


def _sweep(g: Graph) -> DataFrame:
    sets = g.s.createDataFrame(SWEEP, "prefs string, uphill double, unpaved double, main double, rail double, boarding double")
    prefs = {k: F.col(k) for k in K.PREFERENCES}
    # five rows of parameters
    costs = G.costed(g.edges.crossJoin(F.broadcast(sets)), prefs)
    return _r(costs.groupBy("prefs", "mode").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("cost").alias("cost")), digits=2)


def _tag_query(g: Graph, field: str, weights: dict, default: float) -> DataFrame:
    w = C.worst_weight(C.tag_list(F.col(field)), weights, default)
    tags = table(g.s, g.d, "edges").where("mode = 'bike'").groupBy(field).agg(F.count(F.lit(1)).alias("n_edges"))
    return tags.select(
        field,
        "n_edges",
        F.round(w, 4).alias("weight"),
        C.colour_tier(w).alias("tier"),
        C.allowed(C.tag_list(F.col(field)), weights).alias("allowed"),
    )


def _speed(g: Graph) -> DataFrame:
    grade = F.when(F.col("length_m") > 0, F.col("height_diff_m") / F.col("length_m"))
    weight = C.surface_weight(F.col("surface"))
    kmh = C.edge_kmh(F.col("mode"), weight, grade)
    rows = g.edges.select(
        "row_id", "mode", grade.alias("grade"), kmh.alias("kmh"), C.edge_seconds(F.col("mode"), F.col("length_m"), kmh).alias("seconds"),
        C.grade_class(F.col("mode"), grade).alias("grade_class"),
        C.condition_class(
            F.col("mode"),
            (F.col("mode") == "bike") & (C.colour_tier(weight) != 0),
            (F.col("mode") == "bike") & (C.colour_tier(C.road_weight(F.col("highway"))) != 0),
        ).alias("condition_class"),
        F.when(F.col("mode") == "bike", C.ribbon_width_m(kmh)).otherwise(F.lit(K.RIBBON_WIDTH_M)).alias("ribbon_m"),
    )
    return _r(rows)


def _round_trip(g: Graph) -> DataFrame:
    """All tiles of the store read again: every row with its tile."""
    out = None
    for name, ends in (("nodes", ("osmid", "osmid")), ("edges", ("from_node", "to_node"))):
        rows = tiles.read_store(g.s, g.path, name)
        rows = rows.select(
            F.lit(name).alias("table_name"),
            C.tile_name(F.col("tile_row"), F.col("tile_col")).alias("tile"),
            F.col(ends[0]).alias("a"),
            F.col(ends[1]).alias("b"),
            F.lit(0).cast("long").alias("key") if name == "nodes" else F.col("key"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _meta_file(g: Graph) -> DataFrame:
    """What the store's meta.json says."""
    m = tiles.read_meta(g.s, g.path)
    box = [m["bbox"][k].alias(n) for k, n in enumerate(("west", "south", "east", "north"))]
    return m.select(*box, "tile_deg", "tolerance_m", "n_nodes", "n_edges", "n_stations")


def _meta(g: Graph) -> DataFrame:
    m = tiles.meta(g.nodes, g.edges)
    return m.select(*[m["bbox"][k].alias(n) for k, n in enumerate(("west", "south", "east", "north"))], "n_nodes", "n_edges", "n_stations")


def _snap(g: Graph, kind: str | None) -> DataFrame:
    nodes = g.nodes if kind is None else g.nodes.where(F.col("node_type") == kind)
    found = G.nearest(g.places.where("lat is not null and lon is not null"), nodes, "place_key")
    return _r(found.select("place_key", "osmid", "distance_m"))


def _nearest_place(g: Graph) -> DataFrame:
    """The settlement nearest to each named station, within 10 km."""
    stations = g.nodes.where("node_type = 'rail' and station_name is not null").select(F.col("osmid").alias("station"), "lat", "lon")
    places = g.places.where("lat is not null").select(F.col("place_key").alias("osmid"), "lat", "lon")
    found = G.nearest(stations, places, "station", 1, (1000.0, 10_000.0), beyond=False)
    names = g.places.select(F.col("place_key").alias("osmid"), "name")
    return _r(found.join(names, "osmid").select("station", F.col("osmid").alias("place_key"), "name", "distance_m"))


def _track(g: Graph) -> DataFrame:
    return T.track_points(g.hops())


def _dense(g: Graph) -> DataFrame:
    return T.densified(g.hops(geometry=True))


def _dense_numbered(g: Graph) -> DataFrame:
    """Dense points with one running number, each carrying the hop that its segment lies on."""
    w = Window.partitionBy("query_id").orderBy("seq", "pt")
    points = _dense(g)
    carried = ["mode", "surface_bad", "road_bad", "grade", "kmh"]
    # a hop's first vertex ends the segment of the hop before
    own = [F.when(F.col("pt") == 0, F.coalesce(F.lag(c).over(w), F.col(c))).otherwise(F.col(c)).alias(c) for c in carried]
    return points.select("query_id", (F.row_number().over(w) - 1).alias("seq"), "lat", "lon", "elevation_m", "elapsed_s", *own)


def _legs(g: Graph) -> DataFrame:
    h = g.hops()
    names = g.queries().select("query_id")
    lines = T.bike_leg_lines(h.join(names, "query_id"), F.concat(F.lit("start of "), "query_id"), F.concat(F.lit("end of "), "query_id"))
    return lines.select("query_id", "leg", "line").unionByName(T.rail_leg_lines(h).select("query_id", "leg", "line"))


def _waypoint_points(g: Graph) -> DataFrame:
    h = T.mode_runs(T.hop_vertices(g.hops(geometry=True))).where("mode = 'bike'")
    points = S.waypoints(S.joined_lines(h.withColumn("leg_id", F.concat_ws("/", "query_id", "run")), "leg_id"), "leg_id")
    return points.withColumn("points", S.thinned(F.col("points"), 0.2))


def _waypoints(g: Graph) -> DataFrame:
    return _waypoint_points(g).select("leg_id", F.size("points").alias("n_points"), C.maps_url(F.col("points")).alias("url"))


def _maps_url(g: Graph) -> DataFrame:
    ends = F.array(*[F.struct(F.col(f"lat_{e}").alias("lat"), F.col(f"lon_{e}").alias("lon")) for e in "ab"])
    return g.queries().select("query_id", C.maps_url(ends).alias("url"))


def _gpx(g: Graph) -> DataFrame:
    return T.gpx_points(_track(g), F.to_timestamp(F.lit(START)))


START = "2024-06-01 08:00:00"


def _gpx_documents(g: Graph) -> DataFrame:
    return P.gpx_documents(_track(g), F.to_timestamp(F.lit(START)), F.col("query_id"))


def _reports(g: Graph) -> DataFrame:
    h = g.hops(geometry=True)
    return P.trip_reports(h, _r(T.route_stats(h), digits=3), T.track_points(h))


def _markers(g: Graph) -> DataFrame:
    h = g.hops()
    return _r(P.markers_on_track(P.station_markers(h), T.track_points(h)), digits=5)


def _sub_paths(g: Graph) -> DataFrame:
    """The second to the fifth node of every path."""
    return P.sub_path(g.paths(), F.lit(1), F.lit(4)).select("query_id", "seq", "osmid")


def _geocode(g: Graph) -> DataFrame:
    """Names, coordinate literals, blanks and names of nothing, as typed by hand."""
    n = F.pmod(F.length("place_key") + F.ascii(F.substring("place_key", -1, 1)), F.lit(5))
    text = (
        F.when(n == 0, F.upper("name")).when(n == 1, F.concat(F.lit("  "), "name", F.lit(" "))).when(n == 2, N.box_value(F.col("lat"), F.col("lon"), F.col("name")))
        .when(n == 3, F.lit("  ")).otherwise(F.concat("name", F.lit(" xyz")))
    )
    return _r(N.geocoded(g.places.select(F.col("place_key").alias("id"), text.alias("text")), g.places, N.middle(g.nodes), "id"), digits=5)


def _suggestions(g: Graph) -> DataFrame:
    """For each beginning of two and of four letters of a station's name: the station button and three places (a top-k report)."""
    st = g.nodes.where("node_type = 'rail' and station_name is not null").select("osmid", F.col("station_name").alias("name"), "lat", "lon")
    terms = st.select(F.explode(F.array(F.substring("name", 1, 2), F.substring("name", 1, 4))).alias("term"))
    centre = N.middle(g.nodes)
    button = N.suggested(terms, st, centre, 1).select("term", F.lit(0).alias("rank"), N.box_value(F.col("lat"), F.col("lon"), N.station_label(F.col("name"))).alias("suggestion"))
    places = g.places.select(F.col("place_key").alias("osmid"), "name", "lat", "lon", "kind")
    found = N.suggested(terms, places, centre, 3)
    kinds = places.select("osmid", "kind")
    label = N.feature_label(F.col("name"), F.col("name"), F.col("kind"))
    return button.unionByName(found.join(kinds, "osmid").select("term", "rank", label.alias("suggestion")))


def _labels(g: Graph) -> DataFrame:
    """What is shown for the stations' box values, and the leaves of the regions' paths."""
    st = g.nodes.where("node_type = 'rail' and station_name is not null")
    shown = N.display_label(N.box_value(F.col("lat"), F.col("lon"), N.station_label(F.col("station_name"))))
    a = st.select(F.col("osmid").cast("string").alias("id"), shown.alias("label"))
    return a.unionByName(g.regions.select(F.col("region_key").alias("id"), N.extract_leaf(F.col("extract_path")).alias("label")))


def _named_waypoints(g: Graph) -> DataFrame:
    """Waypoints of the bike legs that have a place within 10 km, with its name; the others are dropped."""
    legs = _waypoint_points(g).select("leg_id", F.posexplode("points").alias("k", "_p"))
    at = legs.select(F.concat_ws("#", "leg_id", "k").alias("waypoint"), "_p.lat", "_p.lon")
    places = g.places.where("lat is not null").select(F.col("place_key").alias("osmid"), "lat", "lon")
    found = G.nearest(at, places, "waypoint", 1, (1000.0, 10_000.0), beyond=False)
    return _r(found.join(g.places.select(F.col("place_key").alias("osmid"), "name"), "osmid").where("name is not null").select("waypoint", "name", "distance_m"), digits=3)


def _colours(g: Graph) -> DataFrame:
    """Edges per condition, with its colour as hex and as red, green and blue."""
    weight, road = C.surface_weight(F.col("surface")), C.road_weight(F.col("highway"))
    bike = F.col("mode") == "bike"
    label = C.condition_class(F.col("mode"), bike & (C.colour_tier(weight) != 0), bike & (C.colour_tier(road) != 0))
    rows = g.edges.groupBy(label.alias("condition")).agg(F.count(F.lit(1)).alias("n_edges"))
    rgb = C.hex_rgb(T.condition_colour(F.col("condition")))
    return rows.select("condition", "n_edges", T.condition_colour(F.col("condition")).alias("colour"), *[rgb[k].alias(n) for k, n in enumerate(("red", "green", "blue"))])


def _names(g: Graph) -> DataFrame:
    stem = F.concat_ws("__", F.concat(C.short_place(F.col("name")), F.lit("__to__"), C.short_place(F.concat("name", F.lit(", Landkreis")))), F.lit(params_token()))
    return g.places.select("place_key", C.slug(F.col("name")).alias("slug"), stem.alias("stem"))


def params_token(prefs: dict[str, float] = K.PREFERENCES) -> str:
    for k, v in prefs.items():
        if not 0.0 <= v <= K.MAX_PREFERENCE:
            raise ValueError(f"preference {k} must lie between 0 and {K.MAX_PREFERENCE}")
    return "_".join(f"{k}-{v:.3f}".replace(".", "-") for k, v in prefs.items())


def _literals(g: Graph) -> DataFrame:
    """Coordinates written as text, read again; the names of the places that are no coordinates."""
    text = F.when(F.col("kind").isNull(), F.col("name")).otherwise(
        F.format_string("%.4f, %.4f (%s)", F.col("lat"), F.when(F.col("kind") == "hamlet", F.col("lon") + 400.0).otherwise(F.col("lon")), "name")
    )
    at = C.parsed_latlon(F.col("text"))
    return g.places.select("place_key", text.alias("text")).select("place_key", "text", at["lat"].alias("lat"), at["lon"].alias("lon"), at["name"].alias("label"))


def _autocomplete(g: Graph) -> DataFrame:
    """The five places nearest to the graph's middle for each two-letter beginning of a name (a top-k report)."""
    mid = g.nodes.agg(((F.min("lat") + F.max("lat")) / 2).alias("m_lat"), ((F.min("lon") + F.max("lon")) / 2).alias("m_lon"))
    # one row
    rows = g.places.where("name is not null and lat is not null").crossJoin(F.broadcast(mid))
    rows = rows.select("place_key", "name", F.lower(F.substring("name", 1, 2)).alias("prefix"), C.haversine_m(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon")).alias("distance_m"))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.round("distance_m", 3), "place_key"))
    return _r(rows.withColumn("rank", rank).where("rank <= 5"), digits=3)


def _pruned(g: Graph) -> DataFrame:
    nodes, edges = G.prune(g.nodes, g.edges, 5_000.0)
    a = nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    b = edges.groupBy(F.concat(F.lit("edge "), "mode").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def _components(g: Graph) -> DataFrame:
    bike = g.edges.where("mode = 'bike'")
    labels = written(G.components(bike), "labels")
    return G.component_sizes(bike, labels)


def _raster(g: Graph) -> DataFrame:
    """A raster made from a formula, a cell per thousandth of a degree around every node; every 50th cell is nodata."""
    return _raster_around(g.nodes)


def _raster_around(places: DataFrame) -> DataFrame:
    at = places.select(
        F.floor((F.lit(60.0) - F.col("lat")) * 1000.0).cast("int").alias("row"), F.floor((F.col("lon") - F.lit(0.0)) * 1000.0).cast("int").alias("col")
    ).distinct()
    mixed = F.col("row") * 31 + F.col("col") * 17
    return at.withColumn("elev", F.when(mixed % 50 == 0, F.lit(-9999.0)).otherwise((mixed % 1000).cast("double") / 10.0))


def _dem(g: Graph) -> DataFrame:
    out = B.sampled(g.nodes.select("osmid", "lat", "lon"), _raster(g), *FRAME)
    return out.select("osmid", "elevation_m")


def _filled(g: Graph) -> DataFrame:
    return _r(B.mean_filled(_dem(g), "elevation_m"))


def _dense_lines(g: Graph) -> DataFrame:
    lines = B.densified_lines(g.edges.where("mode = 'bike'"))
    total = lambda c: F.aggregate("line", F.lit(0.0), lambda acc, v: acc + v[c])
    # times a number without a short form, so that no sum lies halfway between two rounded ones
    sums = [(F.round(total(c) * 0.7310585786, d) + F.lit(0.0)).alias(f"sum_{c}") for c, d in (("lon", 6), ("lat", 6), ("z", 4))]
    return lines.select("row_id", F.size("line").alias("n_vertices"), *sums)


def _wkt(g: Graph) -> DataFrame:
    """Stored geometries parsed and written again."""
    return g.edges.where("geometry_wkt is not null").select("row_id", B.wkt_text(C.parsed_wkt(F.col("geometry_wkt"))).alias("wkt"))


def _splits(g: Graph) -> DataFrame:
    parts = B.split_at_extrema(g.edges, "row_id", band_m=2.0)
    return _r(parts.select("row_id", "part", F.size("line").alias("n_vertices"), "length_m"), digits=3)


def _consolidated(g: Graph) -> DataFrame:
    return _r(B.consolidated(g.nodes), digits=8)


def _merged(g: Graph) -> DataFrame:
    """Nodes merged at four digits of a degree, and how many edges are left between them."""
    return B.merged_places(g.nodes, 4)


def _repointed(g: Graph) -> DataFrame:
    out = B.repointed(g.edges, written(_merged(g), "merged"))
    return out.select("from_node", "to_node", "key", "mode", F.coalesce("geometry_wkt", F.lit("")).alias("geometry_wkt"), "row_id")


def _renumbered(g: Graph) -> DataFrame:
    ids = written(B.dense_ids(g.nodes), "dense")
    _, edges = B.renumbered(g.nodes, g.edges, ids)
    return edges.select("row_id", "from_node", "to_node")


def _wired(g: Graph) -> DataFrame:
    st = g.nodes.where("node_type = 'rail' and station_name is not null")
    return _r(B.wired(st, g.nodes.where("node_type = 'bike'"), G.with_ends(g.edges.where("mode = 'rail'"), g.nodes)))


def _entrances(g: Graph) -> DataFrame:
    st = g.nodes.where("node_type = 'rail'")
    return _r(B.entrances(st, g.nodes.where("node_type = 'bike'")))


def _track_of_station(g: Graph) -> DataFrame:
    st = g.nodes.where("node_type = 'rail' and station_name is not null")
    return _r(B.nearest_track(st, G.with_ends(g.edges.where("mode = 'rail'"), g.nodes)), digits=3)


def _chains(g: Graph) -> DataFrame:
    _, out = R.contracted_graph(g.nodes, g.edges)
    return _r(out.select("from_node", "to_node", "mode", "length_m"))


def _merged_towns(g: Graph) -> DataFrame:
    nodes, edges = R.consolidated_graph(g.nodes, g.edges)
    a = nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("elevation_m").alias("total"))
    b = edges.groupBy(F.concat(F.lit("edge "), "mode").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("length_m").alias("total"))
    return _r(a.unionByName(b), digits=2)


def _split_rows(g: Graph) -> DataFrame:
    nodes, edges = R.split_graph(g.nodes, g.edges, 2.0)
    a = nodes.select(F.lit("node").alias("kind"), F.col("osmid").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("length_m"))
    return _r(a.unionByName(edges.select(F.concat(F.lit("edge "), "mode"), "from_node", "to_node", "length_m").toDF(*a.columns)), digits=3)


#: Cells per degree, west, north and nodata of the raster made from a formula.
FRAME = (1000.0, 0.0, 60.0, -9999.0)


def _vertex_raster(g: Graph) -> DataFrame:
    """Cells of the formula's raster around every node and every stored vertex."""
    at = g.nodes.select("lat", "lon").unionByName(B.vertices(g.edges).select("lat", "lon"))
    return _raster_around(at)


def _baked(g: Graph) -> DataFrame:
    _, edges = R.baked(g.nodes, g.edges, _vertex_raster(g), "row_id", *FRAME)
    return _r(edges.select("row_id", "height_diff_m", F.coalesce("geometry_wkt", F.lit("")).alias("wkt")))


def _united(g: Graph) -> DataFrame:
    nodes, edges = R.regions_united(g.nodes, g.edges)
    a = nodes.select(F.lit("node").alias("kind"), F.col("osmid").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("row_id"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("from_node").alias("a"), F.col("to_node").alias("b"), "row_id"))


def _composed(g: Graph) -> DataFrame:
    """The bike part and the rail part of the graph, composed apart."""
    parts = [(g.nodes.where(F.col("node_type") == k).select("osmid"), g.edges.where(F.col("mode") == k).select("from_node", "to_node")) for k in ("bike", "rail")]
    nodes, edges = R.composed(*parts)
    return nodes.select(F.lit("node").alias("kind"), F.col("osmid").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("from_node").alias("a"), F.col("to_node").alias("b")))


#: West, south, east and north of the registered clip.
CLIP = (8.88, 50.0, 8.91, 50.03)


def _clipped(g: Graph) -> DataFrame:
    nodes, edges = R.clipped(g.nodes, g.edges, *CLIP)
    return nodes.select(F.lit("node").alias("kind"), F.col("osmid").alias("id")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("row_id").alias("id")))


def _region_build(g: Graph) -> DataFrame:
    nodes, edges = R.region_build(*R.covered(g.nodes, g.edges, g.regions), _vertex_raster(g), FRAME)
    ends = G.with_ends(edges, nodes)
    ok = G.typed_edges(ends, True).where(F.abs(F.col("height_diff_m") - (F.col("to_elev") - F.col("from_elev"))) <= 0.5)
    kinds = edges.groupBy("mode").agg(F.count(F.lit(1)).alias("n_edges")).join(ok.groupBy("mode").agg(F.count(F.lit(1)).alias("n_sound")), "mode", "left")
    return kinds.crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n_nodes"))))


def _types(g: Graph) -> DataFrame:
    rows = G.typed_edges(G.with_ends(table(g.s, g.d, "edges").select("row_id", "from_node", "to_node", "mode"), g.nodes), False)
    return rows.select("row_id", "mode", "from_type", "to_type")


def _stored_types(g: Graph) -> DataFrame:
    """Edges as delivered whose ends, with their kinds as delivered (unevenly written), do not fit the mode."""
    kinds = table(g.s, g.d, "nodes").where("osmid is not null").groupBy("osmid").agg(F.max("node_type").alias("node_type"))
    ends = kinds.select("osmid", *[F.lit(0.0).alias(c) for c in ("lat", "lon", "elevation_m")], "node_type")
    rows = G.typed_edges(G.with_ends(table(g.s, g.d, "edges").select("row_id", "from_node", "to_node", "mode"), ends), False)
    return rows.select("row_id", "mode", "from_type", "to_type")


def _way_breaks(g: Graph) -> DataFrame:
    """Ways whose edges, in the order of delivery, do not chain: continuity of what was delivered."""
    ways = table(g.s, g.d, "edges").where("way_id is not null").select(F.col("way_id").alias("query_id"), F.col("row_id").alias("seq"), "from_node", "to_node")
    return V.broken_paths(ways).select("query_id", "seq", "from_node", "to_node")


def _region_months(g: Graph) -> DataFrame:
    """Regions that no node was delivered for in a month in which others had deliveries."""
    nodes = table(g.s, g.d, "nodes").select("region_key", F.date_format("loaded_at", "yyyy-MM").alias("month"))
    # a row per month and region
    months = nodes.select("month").where("month is not null").distinct()
    due = g.regions.select("region_key").crossJoin(F.broadcast(months))
    return due.join(nodes.distinct(), ["region_key", "month"], "left_anti").select("region_key", "month")


def _heights(g: Graph) -> DataFrame:
    stored = table(g.s, g.d, "edges").select("row_id", "from_node", "to_node", "height_diff_m")
    return _r(V.height_mismatches(G.with_ends(stored, g.nodes)).select("row_id", "off_m"))


def _dropped(g: Graph) -> DataFrame:
    kept = B.allowed_edges(g.edges)
    left = B.used_nodes(g.nodes, kept)
    return kept.select(F.lit("edge").alias("kind"), F.col("row_id").alias("id")).unionByName(left.select(F.lit("node").alias("kind"), F.col("osmid").alias("id")))


def _guard(g: Graph) -> DataFrame:
    return _r(g.guarded(K.MIN_TRIP_KM).select("query_id", "trip_km", "verdict"), digits=6)


def _verdicts(g: Graph) -> DataFrame:
    """Every trip: what the guards say with the specified and with the registered shortest trip, and what the search found."""
    specified = g.guarded(K.MIN_TRIP_KM).select("query_id", F.coalesce("verdict", F.lit("ok")).alias("specified"))
    found = g.pruned().paths().groupBy("query_id").agg(F.max("reached").alias("cost"))
    trips = g.guarded().join(found, "query_id", "left").join(specified, "query_id")
    outcome = F.coalesce("verdict", F.when(F.col("cost").isNull(), "no_route").otherwise("ok"))
    return _r(trips.select("query_id", "specified", outcome.alias("outcome"), "cost"))


def _view(g: Graph) -> DataFrame:
    span = C.haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    mid = [((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2).alias(f"mid_{c}") for c in ("lat", "lon")]
    return _r(g.queries().select("query_id", *mid, C.zoom_for_span(span).alias("zoom")), digits=7)


def _stats(g: Graph) -> DataFrame:
    return _r(T.route_stats(g.hops(geometry=True)), digits=3)


def _one_to_all(g: Graph) -> DataFrame:
    """From the lowest bike node of every region, by relaxation rounds over the whole graph."""
    start = g.nodes.where("node_type = 'bike'").groupBy(F.col("region_key").alias("query_id")).agg(F.min("osmid").alias("source"))
    slim = written(G.min_collapse(G.costed(g.edges)).select("from_node", "to_node", "cost"), "slim")
    # each query walks the same graph: edges are not copied per query, sources are labelled instead
    return _r(G.reach_all(start, slim))


def route_costs(g: Graph) -> DataFrame:
    ends = g.paths().groupBy("query_id").agg(F.max("reached").alias("cost"), F.count(F.lit(1)).alias("n_nodes"))
    return _r(ends)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    points = lambda r: T.composition(r)
    return {
        # ingest, store
        "clean_nodes": _g(lambda g: g.nodes.select(*tiles.NODE_COLUMNS)),
        "clean_edges": _g(lambda g: _r(g.edges.select("row_id", "from_node", "to_node", "key", "mode", "length_m", "height_diff_m"))),
        "tile_assign_nodes": _g(lambda g: tiles.with_tile(g.nodes).select("osmid", "tile_row", "tile_col", C.tile_name(F.col("tile_row"), F.col("tile_col")).alias("tile"))),
        "tile_assign_edges": _g(lambda g: tiles.edges_with_tile(g.edges, g.nodes).select("row_id", "tile_row", "tile_col")),
        "tile_counts": _g(lambda g: tiles.with_tile(g.nodes).groupBy("tile_row", "tile_col", "node_type").agg(F.count(F.lit(1)).alias("n"))),
        "tiled_store_round_trip": _g(_round_trip, True),
        "store_meta": _g(_meta_file, True),
        "bbox_meta": _g(_meta),
        # cost
        "edge_cost_default": _g(lambda g: _r(G.costed(g.edges).select("row_id", "cost"))),
        "edge_cost_zero_prefs": _g(lambda g: _r(G.costed(g.edges, {k: F.lit(0.0) for k in K.PREFERENCES}).select("row_id", "cost"))),
        "edge_cost_by_mode_sum": _g(lambda g: _r(G.costed(g.edges).groupBy("mode").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("cost").alias("cost")), digits=2)),
        "edge_cost_param_sweep": _g(_sweep),
        "min_collapse_parallel": _g(lambda g: _r(G.min_collapse(G.costed(g.edges)))),
        "tag_surface_weight_tier": _g(lambda g: _tag_query(g, "surface", K.SURFACE_WEIGHT, K.SURFACE_UNTAGGED)),
        "tag_road_weight_tier": _g(lambda g: _tag_query(g, "highway", K.ROAD_WEIGHT, K.ROAD_UNTAGGED)),
        "edge_speed_and_classes": _g(_speed),
        # corridors, snapping, search
        "route_queries": _g(lambda g: g.trips().select("query_id", "source", "target"), True),
        "trip_guards": _g(_guard, True),
        "route_verdicts": _g(_verdicts, True),
        "view_state": _g(_view, True),
        "corridor_nodes_bike": _g(lambda g: G.corridor_nodes(g.queries(), g.nodes.where("node_type = 'bike'"), K.BIKE_HALF_WIDTH_KM, K.BIKE_EXTEND_KM).select("query_id", "osmid"), pruned=True),
        "corridor_nodes_rail": _g(lambda g: G.corridor_nodes(g.queries(), g.nodes.where("node_type = 'rail'"), K.RAIL_HALF_WIDTH_KM, K.RAIL_EXTEND_KM).select("query_id", "osmid"), pruned=True),
        "corridor_edges_combined": _g(lambda g: G.corridor_edge_counts(g.queries(), g.nodes, g.edges, "mode"), pruned=True),
        "snap_nearest_any": _g(lambda g: _snap(g, None), True),
        "snap_nearest_bike": _g(lambda g: _snap(g, "bike"), True),
        "nearest_place": _g(_nearest_place, True),
        "route_shortest_cost": _g(route_costs, pruned=True),
        "route_path_nodes": _g(lambda g: _r(g.paths()), pruned=True),
        "route_one_to_all_cost": _g(_one_to_all, True),
        "path_edges_cheapest": _g(lambda g: _r(g.hops().select("query_id", "seq", "from_node", "to_node", "key", "mode", "cost")), pruned=True),
        # tracks
        "track_points": _g(lambda g: _r(_track(g), digits=6), pruned=True),
        "track_cumulative_km": _g(lambda g: _r(T.cumulative_km(_track(g)).select("query_id", "seq", "leg_km", "km"), digits=6), pruned=True),
        "track_stats": _g(_stats, pruned=True),
        "windowed_climb": _g(lambda g: _r(T.windowed_climb(g.hops(geometry=True)), digits=3), pruned=True),
        "mode_runs": _g(lambda g: T.mode_runs(g.hops()).select("query_id", "seq", "mode", "run"), pruned=True),
        "leg_lines": _g(_legs, pruned=True),
        "rail_leg_tooltips": _g(lambda g: T.rail_leg_lines(g.hops()).select("query_id", "leg", "tooltip"), pruned=True),
        "densified_track": _g(lambda g: _r(_dense(g), digits=6), pruned=True),
        "composition_long": _g(lambda g: _r(points(_track(g)).select("query_id", "dimension", "label", "ord", "km"), digits=6), pruned=True),
        "composition_pct": _g(lambda g: _r(points(_dense_numbered(g)).select("query_id", "dimension", "label", "pct"), digits=3), pruned=True),
        "ribbon_runs": _g(lambda g: T.ribbon_runs(_track(g)), pruned=True),
        "profile_runs": _g(lambda g: _r(T.profile_runs(_track(g)), digits=5), pruned=True),
        "gpx_points": _g(_gpx, pruned=True),
        "waypoints_visvalingam": _g(_waypoints, pruned=True),
        "named_waypoints": _g(_named_waypoints, pruned=True),
        "gpx_documents": _g(_gpx_documents, pruned=True),
        "trip_reports": _g(_reports, pruned=True),
        "markers_on_track": _g(_markers, pruned=True),
        "sub_paths": _g(_sub_paths, pruned=True),
        "geocode_places": _g(_geocode, True),
        "station_suggestions": _g(_suggestions, True),
        "place_labels": _g(_labels, True),
        "condition_colours": _g(_colours, True),
        "overview_cells": _g(lambda g: _r(P.overview(g.edges, g.nodes), digits=5), True),
        "maps_url": _g(_maps_url, True),
        "output_names": _g(_names),
        "parse_latlon_literals": _g(_literals),
        "autocomplete_prefix": _g(_autocomplete),
        # stations
        "station_entrances": _g(_entrances),
        "station_nearest_track": _g(_track_of_station),
        "station_wiring": _g(_wired),
        "top_stations": _g(lambda g: _r(B.top_stations(g.nodes).select("osmid", "station_name", "elevation_m", "highest_m", "lowest_m"))),
        # building
        "allowlist_filter": _g(_dropped),
        "dedup_nodes": _g(_merged),
        "dedup_edges": _g(_repointed),
        "reid_contiguous": _g(lambda g: B.dense_ids(g.nodes)),
        "reid_edges": _g(_renumbered),
        "combine_offsets": _g(lambda g: B.region_offsets(g.nodes)),
        "components_bike": _g(_components, True),
        "prune_components": _g(_pruned, True),
        "contracted_chains": _g(lambda g: B.contracted(g.edges), True),
        "contracted_edges": _g(_chains, True),
        "consolidate_nodes": _g(_consolidated),
        "consolidated_graph": _g(_merged_towns, True),
        "split_graph": _g(_split_rows, True),
        "baked_vertices": _g(_baked, True),
        "regions_united": _g(_united, True),
        "composed_graphs": _g(_composed, True),
        "clipped_ways": _g(_clipped, True),
        "raster_bounds": _g(lambda g: _r(R.raster_bounds(_raster(g), *FRAME[:3]))),
        "region_build": _g(_region_build, True),
        "dem_sample_nodes": _g(_dem),
        "nan_fill_mean": _g(_filled),
        "densify_edges": _g(_dense_lines),
        "wkt_text": _g(_wkt),
        "split_edges_extrema": _g(_splits),
        # validation
        "validate_types": _g(_types),
        "validate_types_stored": _g(_stored_types),
        "validate_way_continuity": _g(_way_breaks),
        "region_months": _g(_region_months),
        "validate_height_diff": _g(_heights),
        "validate_vertex_gap": _g(lambda g: _r(V.vertex_gaps(g.edges.where("mode = 'bike'"), "row_id"))),
        "validate_z_band": _g(lambda g: _r(V.z_excess(g.edges.where("mode = 'bike'"), "row_id"))),
        "validate_path_continuity": _g(lambda g: V.broken_paths(g.hops()).select("query_id", "seq", "from_node", "to_node"), pruned=True),
        "sanity_cost_model": _g(lambda g: _r(V.cost_sanity(G.costed(g.edges)))),
        "region_overlap": _g(lambda g: V.region_overlaps(g.regions)),
        "region_completeness": _g(lambda g: V.missing_regions(g.regions, table(g.s, g.d, "nodes"))),
    }
