"""Trajectory analytics over materialised paths: timing, climb, composition, legs, ribbons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K


def _route():
    return Window.partitionBy("query_id").orderBy("seq")



def hops(path_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path edges with both ends, condition, grade, speed and seconds; seq 1 is the first hop."""
    out = path_edges
    for side in ("from", "to"):
        ends = nodes.select(
            F.col("osmid").alias(f"{side}_node"),
            F.col("lat").alias(f"{side}_lat"),
            F.col("lon").alias(f"{side}_lon"),
            F.col("elevation_m").alias(f"{side}_elev"),
            F.col("station_name").alias(f"{side}_name"),
        )
        out = out.join(ends, f"{side}_node")
    mode = F.col("mode")
    weight, road = C.surface_weight(F.col("surface")), C.road_weight(F.col("highway"))
    grade = F.when(F.col("length_m") > 0, (F.col("to_elev") - F.col("from_elev")) / F.col("length_m"))
    bike = mode == "bike"
    out = out.withColumn("grade", grade).withColumn("kmh", C.edge_kmh(mode, weight, grade))
    return out.select(
        "*",
        (bike & (C.colour_tier(weight) != 0)).alias("surface_bad"),
        (bike & (C.colour_tier(road) != 0)).alias("road_bad"),
        C.edge_seconds(mode, F.col("length_m"), F.col("kmh")).alias("leg_s"),
    )


def track_points(h: DataFrame) -> DataFrame:
    """(query_id, seq, lat, lon, elevation_m, elapsed_s, mode, surface_bad, road_bad, grade, kmh); seq 0 is the start."""
    carried = ["mode", "surface_bad", "road_bad", "grade", "kmh"]
    elapsed = F.sum("leg_s").over(_route().rowsBetween(Window.unboundedPreceding, 0))
    arriving = h.select(
        "query_id",
        "seq",
        F.col("to_lat").alias("lat"),
        F.col("to_lon").alias("lon"),
        F.col("to_elev").alias("elevation_m"),
        elapsed.alias("elapsed_s"),
        *carried,
    )
    start = h.where("seq = 1").select(
        "query_id",
        F.lit(0).alias("seq"),
        F.col("from_lat").alias("lat"),
        F.col("from_lon").alias("lon"),
        F.col("from_elev").alias("elevation_m"),
        F.lit(0.0).alias("elapsed_s"),
        *carried,
    )
    return start.unionByName(arriving)


def cumulative_km(points: DataFrame) -> DataFrame:
    """Points with ``leg_km`` to the point before and ``km`` from the start."""
    before = [F.lag(c).over(_route()) for c in ("lat", "lon")]
    leg = F.coalesce(C.haversine_m(*before, F.col("lat"), F.col("lon")) / 1000.0, F.lit(0.0))
    return points.withColumn("leg_km", leg).withColumn(
        "km", F.sum("leg_km").over(_route().rowsBetween(Window.unboundedPreceding, 0))
    )


def mode_runs(h: DataFrame) -> DataFrame:
    """Hops with ``run``: the number, from 1, of their maximal run of hops of one mode."""
    new = F.when(F.col("mode") == F.lag("mode").over(_route()), 0).otherwise(1)
    return h.withColumn("_new", new).withColumn(
        "run", F.sum("_new").over(_route().rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ).drop("_new")


def legs(h: DataFrame, mode: str) -> DataFrame:
    """One row per run of the mode: first and last hop and the nodes at both ends, numbered by ``leg``."""
    runs = mode_runs(h).where(F.col("mode") == mode)
    first = lambda c: F.min_by(c, "seq")
    last = lambda c: F.max_by(c, "seq")
    one = runs.groupBy("query_id", "run").agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        first("from_node").alias("begin_node"),
        last("to_node").alias("end_node"),
        first("from_name").alias("begin_name"),
        last("to_name").alias("end_name"),
        first("from_elev").alias("begin_elev"),
        last("to_elev").alias("end_elev"),
    )
    w = Window.partitionBy("query_id").orderBy("run")
    return one.withColumn("leg", F.row_number().over(w)).drop("run")


def rail_leg_lines(h: DataFrame) -> DataFrame:
    """(query_id, leg, line, tooltip) of each train ride."""
    a, b = F.coalesce("begin_name", F.lit(K.UNNAMED_STOP)), F.coalesce("end_name", F.lit(K.UNNAMED_STOP))
    tip = [C.place_label(F.col(f"{e}_name"), F.col(f"{e}_elev")) for e in ("begin", "end")]
    return legs(h, "rail").select(
        "query_id",
        "leg",
        F.format_string("Train %d: %s → %s", "leg", a, b).alias("line"),
        F.format_string("Train: %s → %s", *tip).alias("tooltip"),
    )


def bike_leg_lines(h: DataFrame, origin: Column, destination: Column) -> DataFrame:
    """(query_id, leg, from_place, to_place, line): ends are the trip's, or the stations beside the leg."""
    ends = h.groupBy("query_id").agg(F.max("seq").alias("_last"))
    names = h.select("query_id", "seq", "from_name", "to_name")
    before = names.select("query_id", (F.col("seq") + 1).alias("first_seq"), F.col("from_name").alias("_before"))
    after = names.select("query_id", (F.col("seq") - 1).alias("last_seq"), F.col("to_name").alias("_after"))
    rows = (
        legs(h, "bike")
        .join(ends, "query_id")
        .join(before, ["query_id", "first_seq"], "left")
        .join(after, ["query_id", "last_seq"], "left")
    )
    unnamed = F.lit(K.UNNAMED_STOP)
    a = F.when(F.col("first_seq") == 1, origin).otherwise(F.coalesce("_before", unnamed))
    b = F.when(F.col("last_seq") == F.col("_last"), destination).otherwise(F.coalesce("_after", unnamed))
    return rows.select("query_id", "leg", a.alias("from_place"), b.alias("to_place")).withColumn(
        "line", F.format_string("Bike Route %d: %s → %s", "leg", "from_place", "to_place")
    )


# --- geometry along the path ---


def hop_vertices(h: DataFrame) -> DataFrame:
    """Hops with ``verts``: oriented (lon, lat, z) vertices, the two ends where no geometry is stored.

    Bike hops keep stored heights; other hops, and vertices without one, get
    heights linear in the distance along the hop.
    """
    end = lambda s: F.struct(
        F.col(f"{s}_lon").alias("lon"), F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_elev").alias("z")
    )
    stored = C.parsed_wkt(F.col("geometry_wkt"))
    usable = stored.isNotNull() & (F.size(stored) >= 2) & F.forall(stored, lambda v: v["lon"].isNotNull() & v["lat"].isNotNull())
    out = h.withColumn(
        "_v", F.when(usable, C.oriented(stored, F.col("from_lat"), F.col("from_lon"))).otherwise(F.array(end("from"), end("to")))
    )
    # distance of each vertex along the hop
    zero = F.array(F.lit(0.0))
    step = lambda acc, k: F.concat(
        acc,
        F.array(
            F.element_at(acc, -1)
            + C.haversine_m(
                F.get("_v", k - 1)["lat"], F.get("_v", k - 1)["lon"], F.get("_v", k)["lat"], F.get("_v", k)["lon"]
            )
        ),
    )
    out = out.withColumn("along", F.aggregate(F.sequence(F.lit(1), F.size("_v") - 1), zero, step))
    total = F.coalesce(F.nullif(F.element_at("along", -1), F.lit(0.0)), F.lit(1.0))
    baked = (F.col("mode") == "bike") & F.forall("_v", lambda v: v["z"].isNotNull())
    linear = lambda k: F.col("from_elev") + (F.col("to_elev") - F.col("from_elev")) * F.get("along", k) / total
    verts = F.transform(
        "_v",
        lambda v, k: F.struct(
            v["lon"].alias("lon"), v["lat"].alias("lat"), F.when(baked, v["z"]).otherwise(linear(k)).alias("z")
        ),
    )
    return out.withColumn("verts", verts).drop("_v")


def densified(h: DataFrame) -> DataFrame:
    """Track points at every vertex: (query_id, seq, pt, lat, lon, elevation_m, elapsed_s, ...), ordered by (seq, pt).

    The vertex that two hops share is emitted by the later one, and by the last
    hop at its end. ``edge_seq`` is the hop on which the segment that ends at
    the point lies; ``seq`` is the hop that emitted it.
    """
    rows = hop_vertices(h)
    end = F.sum("leg_s").over(_route().rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("seq").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_t1", end).withColumn("_t0", F.col("_t1") - F.col("leg_s")).withColumn("_last", last)
    total = F.coalesce(F.nullif(F.element_at("along", -1), F.lit(0.0)), F.lit(1.0))
    keep = F.when(F.col("seq") == F.col("_last"), F.size("verts")).otherwise(F.size("verts") - 1)
    each = rows.withColumn("_total", total).select("*", F.posexplode(F.slice("verts", F.lit(1), keep)).alias("pt", "_v"))
    at = F.get("along", F.col("pt"))
    return each.select(
        "query_id",
        "seq",
        "pt",
        F.col("_v.lat").alias("lat"),
        F.col("_v.lon").alias("lon"),
        F.col("_v.z").alias("elevation_m"),
        (F.col("_t0") + (F.col("_t1") - F.col("_t0")) * at / F.col("_total")).alias("elapsed_s"),
        "mode",
        "surface_bad",
        "road_bad",
        "grade",
        "kmh",
    )


def windowed_climb(h: DataFrame, window_m: float = K.CLIMB_WINDOW_M) -> DataFrame:
    """(query_id, bike_up, bike_down, other_up, other_down).

    Bike terrain is resampled per contiguous leg to evenly spaced points at most
    ``window_m`` apart; other hops give the difference of their ends.
    """
    rows = mode_runs(hop_vertices(h))
    bike = rows.where("mode = 'bike'")
    leg = Window.partitionBy("query_id", "run").orderBy("seq")
    length = F.element_at("along", -1)
    begun = F.coalesce(F.sum(length).over(leg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lasting = F.sum(length).over(Window.partitionBy("query_id", "run"))
    placed = bike.withColumn("_begin", begun).withColumn("_leg_m", lasting).where(F.col("_leg_m") > 0)
    # grid points of the leg that fall on this hop, each interpolated on the hop's vertices
    n = F.greatest(F.lit(2), F.ceil(F.col("_leg_m") / window_m).cast("int") + 1)
    placed = placed.withColumn("_n", n).withColumn("_step", F.col("_leg_m") / (F.col("_n") - 1))
    is_last = F.col("seq") == F.max("seq").over(Window.partitionBy("query_id", "run"))
    low = F.ceil(F.col("_begin") / F.col("_step")).cast("int")
    high = F.ceil((F.col("_begin") + length) / F.col("_step")).cast("int") - 1
    high = F.when(is_last, F.col("_n") - 1).otherwise(F.least(high, F.col("_n") - 2))
    placed = placed.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    grid = placed.withColumn("_g", F.explode(F.sequence("_low", "_high"))).withColumn(
        "_x", F.least(F.col("_g") * F.col("_step") - F.col("_begin"), length)
    )
    at = F.greatest(F.lit(1), F.size(F.filter("along", lambda d: d <= F.col("_x"))))
    k = F.least(at, F.size("along") - 1)
    x0, x1 = F.element_at("along", k), F.element_at("along", k + 1)
    z0, z1 = F.element_at("verts", k)["z"], F.element_at("verts", k + 1)["z"]
    z = F.when(x1 > x0, z0 + (z1 - z0) * (F.col("_x") - x0) / (x1 - x0)).otherwise(z1)
    heights = grid.select("query_id", "run", "_g", z.alias("z"))
    d = F.col("z") - F.lag("z").over(Window.partitionBy("query_id", "run").orderBy("_g"))
    up = lambda x: F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    x = F.col("_d")
    on_bike = heights.withColumn("_d", d).groupBy("query_id").agg(up(x).alias("bike_up"), up(-x).alias("bike_down"))
    x = F.col("to_elev") - F.col("from_elev")
    other = h.where("mode <> 'bike'").groupBy("query_id").agg(up(x).alias("other_up"), up(-x).alias("other_down"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return (
        h.select("query_id")
        .distinct()
        .join(on_bike, "query_id", "left")
        .join(other, "query_id", "left")
        .select("query_id", *map(zero, ("bike_up", "bike_down", "other_up", "other_down")))
    )


def route_stats(h: DataFrame) -> DataFrame:
    """Bike and whole-trip distance, minutes, ascent and descent per query, and whether the bike speed is plausible."""
    bike = F.col("mode") == "bike"
    length = F.col("length_m")
    sums = h.groupBy("query_id").agg(
        (F.coalesce(F.sum(F.when(bike, length)), F.lit(0.0)) / 1000.0).alias("bike_km"),
        (F.coalesce(F.sum(F.when(bike, F.col("leg_s"))), F.lit(0.0)) / 60.0).alias("bike_min"),
        (F.sum(length) / 1000.0).alias("total_km"),
        (F.sum("leg_s") / 60.0).alias("total_min"),
    )
    kmh = F.col("bike_km") / F.nullif(F.col("bike_min") / 60.0, F.lit(0.0))
    ok = F.coalesce(kmh.between(K.WALK_KMH - 1e-9, K.BASE_KMH + 1e-9), F.lit(True))
    return sums.join(windowed_climb(h), "query_id").select(
        "query_id",
        "bike_km",
        "bike_min",
        F.col("bike_up").alias("bike_ascent_m"),
        F.col("bike_down").alias("bike_descent_m"),
        "total_km",
        "total_min",
        (F.col("bike_up") + F.col("other_up")).alias("total_ascent_m"),
        (F.col("bike_down") + F.col("other_down")).alias("total_descent_m"),
        ok.alias("plausible_speed"),
    )


def composition(points: DataFrame) -> DataFrame:
    """(query_id, dimension, label, ord, km, pct) from points in order; each segment goes to the hop it lies on.

    ``points`` has query_id, seq (one number per point), lat, lon, mode,
    surface_bad, road_bad, grade of the hop that ends at the point.
    """
    measured = cumulative_km(points).where("seq > 0")
    bike = F.col("mode") == "bike"
    quality = C.condition_class(F.col("mode"), F.col("surface_bad"), F.col("road_bad"))
    quality = F.when(quality == "main road + unpaved", "main road").otherwise(quality)
    buckets = F.array(
        F.when(bike, F.struct(F.lit("Quality").alias("dimension"), quality.alias("label"))),
        F.when(bike, F.struct(F.lit("Grade").alias("dimension"), C.grade_class(F.col("mode"), F.col("grade")).alias("label"))),
        F.struct(
            F.lit("Mode").alias("dimension"),
            F.when(F.col("mode") == "rail", "train path").otherwise("bike route").alias("label"),
        ),
    )
    long = measured.select("query_id", "leg_km", F.explode(F.array_compact(buckets)).alias("_b"))
    km = long.groupBy("query_id", "_b.dimension", "_b.label").agg(F.sum("leg_km").alias("km"))
    order = {x: k for labels in (K.QUALITY_LABELS, K.GRADE_LABELS, K.MODE_LABELS) for k, x in enumerate(labels)}
    whole = F.sum("km").over(Window.partitionBy("query_id", "dimension"))
    return km.select(
        "query_id",
        "dimension",
        "label",
        F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("label")].alias("ord"),
        "km",
        (F.col("km") / F.nullif(whole, F.lit(0.0)) * 100.0).alias("pct"),
    )


def condition_colour(label: Column) -> Column:
    return (
        F.when(label == "train", "#9600c8")
        .when(label == "good", "#1565c0")
        .when(label == "unpaved", "#ef7f18")
        .otherwise("#c80d29")
    )


def ribbon_runs(points: DataFrame) -> DataFrame:
    """(query_id, run, first_seq, last_seq, colour, width_m, tooltip): neighbouring runs share the seam point."""
    colour = condition_colour(C.condition_class(F.col("mode"), F.col("surface_bad"), F.col("road_bad")))
    width = F.when(F.col("mode") == "bike", C.ribbon_width_m(F.col("kmh"))).otherwise(F.lit(K.RIBBON_WIDTH_M))
    pct = F.col("grade") * 100.0
    way = F.when(pct > 0.5, "uphill").when(pct < -0.5, "downhill").otherwise("flat")
    tip = F.when(F.col("mode") == "rail", "Train").otherwise(
        F.concat_ws(
            " · ",
            F.when(F.col("surface_bad"), "unpaved path").otherwise("paved road"),
            F.when(F.col("road_bad"), "main road").otherwise("quiet way"),
            F.format_string("%+.0f%% %s", F.bround(pct, 0), way),
            F.format_string("~%.0f km/h", F.bround("kmh", 0)),
            F.format_string("%.0f m", F.bround("elevation_m", 0)),
        )
    )
    looks = points.where("seq > 0").select(
        "query_id", "seq", colour.alias("colour"), F.round(width, 4).alias("width_m"), tip.alias("tooltip")
    )
    same = F.lit(True)
    for c in ("colour", "width_m", "tooltip"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(_route()))
    first = F.lag("seq").over(_route()).isNull()
    runs = looks.withColumn("_new", F.when(same & ~first, 0).otherwise(1)).withColumn(
        "run", F.sum("_new").over(_route().rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )
    return runs.groupBy("query_id", "run", "colour", "width_m", "tooltip").agg(
        (F.min("seq") - 1).alias("first_seq"), F.max("seq").alias("last_seq")
    )


def profile_runs(points: DataFrame) -> DataFrame:
    """(query_id, run, mode, from_km, to_km, low_m, high_m) of each run of one mode, ends shared."""
    at = cumulative_km(points)
    before = [F.lag(c).over(_route()).alias(f"_{c}") for c in ("km", "elevation_m")]
    rows = at.select("*", *before).where("seq > 0")
    new = F.when(F.col("mode") == F.lag("mode").over(_route()), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn(
        "run", F.sum("_new").over(_route().rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )
    return runs.groupBy("query_id", "run", "mode").agg(
        F.min("_km").alias("from_km"),
        F.max("km").alias("to_km"),
        F.min(F.least("elevation_m", "_elevation_m")).alias("low_m"),
        F.max(F.greatest("elevation_m", "_elevation_m")).alias("high_m"),
    )


def gpx_points(points: DataFrame, start: Column) -> DataFrame:
    """(query_id, seq, trkpt): one GPX track point per track point, its time counted from ``start``."""
    time = F.date_format(F.timestamp_micros((F.unix_micros(start) + F.col("elapsed_s") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.format_string(
        '<trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele><time>%s</time></trkpt>', "lat", "lon", "elevation_m", time
    )
    return points.select("query_id", "seq", text.alias("trkpt"))
